"""Every stage of the corpus pipeline, on the input it gets there, against plain computations."""

import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import BASE, linked, luhn
from tidegauge.llm.vocabularies import WORD_BPE


@pytest.fixture(scope="module")
def stages(spark, data):
    """Rows before and after every stage but the last, and the last one's rows."""
    docs, out = corpus_pipeline.table(spark, data, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(spark, stage(spark, docs, data), "stage")
        assert after.columns == docs.columns
        out[name], docs = (docs.collect(), after.collect()), after
    out["best-fit packing"] = docs.collect(), corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    return out


def test_language_keeps_labelled_prose(stages):
    before, after = stages["language identification"]
    assert Counter(after) <= Counter(before) and len(after) >= 0.9 * len(before)
    lost = Counter(before) - Counter(after)
    letters = lambda t: sum(c.isalpha() for c in t or "")
    # What goes has few letters, or is in no language that was learnt.
    assert all(letters(r.text) < 0.5 * len(r.text or "x") or r.lang is None or len((r.text or "").split()) < 30 for r in lost)


def test_join_keeps_the_first_of_every_component(stages):
    before, after = stages["n-gram Jaccard join"]
    _, component = linked([(r.doc_id, r.text) for r in before], 5, 80)
    wordless = [r.doc_id for r in before if not (r.text or "").split()]
    assert sorted(r.doc_id for r in after) == sorted([*{c for r, c in zip(before, component) if (r.text or "").split()}, *wordless])
    assert Counter(after) <= Counter(before)


def test_leaks_go_and_strangers_stay(spark, data, stages):
    before, after = stages["benchmark decontamination"]
    kept = {r.doc_id for r in after}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    items = [words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    triples = set().union(*(grams(w, 3) for w in items))
    for r in before:
        own = words(r.text)
        if not triples & grams(own, 3):
            assert r.doc_id in kept
        flat = " ".join(own)
        if any(len(w) >= 8 and " ".join(w) in flat for w in items):
            assert r.doc_id not in kept


def test_no_personal_data_is_left(stages):
    before, after = stages["personal data"]
    assert [r.doc_id for r in sorted(before)] == [r.doc_id for r in sorted(after)]
    holds = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
             "card": lambda s: 16 <= sum(c.isdigit() for c in s) <= 19 and luhn(s), "phone": lambda s: 8 <= sum(c.isdigit() for c in s) <= 15}
    found = Counter()
    for kind, pattern in BASE.items():
        for r in before:
            found[kind] += sum(holds[kind](m.group()) for m in re.finditer(pattern, r.text or ""))
        assert not any(holds[kind](m.group()) for r in after for m in re.finditer(pattern, r.text or "")), kind
    assert found["email"] and found["ip"]
    assert all(r.n_chars == len(r.text or "") for r in after if r.text is not None)


def test_packing_holds_every_id_once(stages):
    before, after = stages["best-fit packing"]
    library = Tokenizer.from_file(WORD_BPE)
    library.encode_special_tokens = True
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before)
    got, sequences = Counter(), defaultdict(list)
    for r in after:
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == {doc: n for doc, n in want}
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(got.values()) // 2048) * 1.05 + 1
