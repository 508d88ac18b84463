"""The training-data operators against brute force, on a small hand-made table and on a test table."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from oracle import compare, connect
from tokenizers import Tokenizer

import corpus_pipeline
from tidegauge.llm import benchmark, binary, jaccard, language, packing, pii, sharding, substrings, topk, urls
from tidegauge.llm.encoding import PieceEncoder
from tidegauge.llm.queries import ORACLES, QUERIES, URL_RULES
from tidegauge.llm.vocabularies import BYTE_BPE, WORD_BPE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long"


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, repeated rows, equal ids with other texts, near copies."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    base = [word() for _ in range(120)]
    out = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, "ONE two"), (7, "\u00c9t\u00e9 \u00e9t\u00e9"),
           (8, "x " * 400), (9, " ".join(base)), (9, " ".join(base)), (9, " ".join(base[:60])), (None, " ".join(base))]
    for i in range(40):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = word()
        out.append((100 + i, " ".join(own)))
    out.append((300, " ".join(word() for _ in range(30_000))))
    out += [(400 + i, " ".join(word() for _ in range(rnd.randint(1, 80))) + ", " + " ".join(base[20:45])) for i in range(30)]
    mail = "kim.lee@mail.example.com"
    out += [(500 + i, f"{' '.join(word() for _ in range(12))} Zanzibar {mail} call +1 (555) 010-{1000 + i} or "
             f"4111 1111 1111 111{i % 3} at 10.0.{i}.{250 + i}") for i in range(9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "aa", None, None, "r", 7) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return (text or "").encode().split()


def shingles(text, n):
    own = words_of((text or "").encode().lower().decode())
    return {tuple(own[j:j + n]) for j in range(max(1, len(own) - n + 1))} if own else set()


def linked(rows, n, percent):
    """Component (smallest known id) per row, over all pairs."""
    sets, root = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sets, [least.get(find(i)) if s else rows[i][0] for i, s in enumerate(sets)]


def order(values):
    return sorted(values, key=repr)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, rows, n, percent):
    sets, comp = linked(rows, n, percent)
    got = jaccard.link(docs, jaccard.Similarity(n, percent)).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(
        (d, len(s), c) for (d, _), s, c in zip(rows, sets, comp))


def test_jaccard_keeps_one(docs, rows):
    _, comp = linked(rows, 5, 80)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = {c for (d, t), c in zip(rows, comp) if words_of(t)}
    assert order(ids) == order([*named, None, 1, 2, 3])


def test_substrings(docs, rows):
    for rule in (substrings.Repeats(20), substrings.Repeats(20, shard_segments=2), substrings.Repeats(6, 3)):
        distinct = sorted({((-(1 << 63) if d is None else d), t or "") for d, t in rows})
        keys = {(r.doc_id, r.text): r.key for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS key").collect()}
        null_key = docs.sparkSession.range(1).selectExpr("xxhash64(CAST(NULL AS STRING)) AS k").first().k
        distinct.sort(key=lambda x: (x[0], keys.get((None if x[0] == -(1 << 63) else x[0], x[1]), null_key)))
        seen, want = set(), {}
        for d, t in distinct:
            own = words_of(t)
            gone = [False] * len(own)
            for j in range(len(own) - rule.window + 1):
                k = tuple(own[j:j + rule.window])
                if k in seen:
                    gone[j:j + rule.window] = [True] * rule.window
                seen.add(k)
            want[d, t] = (len(own), sum(gone), b" ".join(w for w, g in zip(own, gone) if not g).decode())
        got = substrings.remove(docs, rule).collect()
        assert order((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == order(
            (d, *want[(-(1 << 63) if d is None else d), t or ""]) for d, t in rows)
        assert all(sum(s.high - s.low for s in r.spans) == r.n_removed for r in got)


def test_automaton():
    rnd = random.Random(3)
    for _ in range(50):
        parts = [[rnd.randrange(3) for _ in range(rnd.randint(0, 12))] for _ in range(4)]
        text = [rnd.randrange(3) for _ in range(15)]
        a = substrings.Automaton()
        for p in parts:
            a.add(p)
        have = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i, len(p) + 1)}
        want = [max(n for n in range(e + 2) if n == 0 or tuple(text[e + 1 - n:e + 1]) in have) for e in range(len(text))]
        assert a.statistics(text) == want


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_spans(text):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
          "card": lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and luhn(m),
          "phone": lambda m: 8 <= sum(c.isdigit() for c in m) <= 15}
    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_pii_base():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1.@+- ()\u00e92") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_pii(docs, rows, empty):
    got = pii.spans(docs).collect()
    assert order((r.doc_id, r.base_sha256) for r in got) == order(
        (d, hashlib.sha256(pii.listed(plain_spans(t or "")).encode()).hexdigest()) for d, t in rows)
    by_id = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 500}
    texts = dict(rows)
    # The name stands by the address in every document and nowhere else: it tells who is meant.
    for i, r in by_id.items():
        terms = [s.split(":") for s in r.spans.split(",") if s.startswith("term")]
        assert "Zanzibar" in [texts[i][int(a):int(b)] for _, a, b in terms]
    assert all(r.n_term == 0 for r in got if r.n_email + r.n_ip + r.n_card + r.n_phone == 0)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    new = {r.doc_id: r.text for r in clean.collect()}
    assert "Zanzibar" not in new[500] and "[email]" in new[500] and "@" not in new[500] and new[1] is None
    assert new[300] == texts[300]
    assert pii.spans(empty).count() == 0 and pii.sanitise(empty).count() == 0


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_equals_library(path):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    enc, rnd = PieceEncoder(path, max_pieces=500), random.Random(2)
    texts = ["", "a  b", "a \n b", "a\n\nb", "a\t b", "\x1cy z", "it's don't.", "<|endoftext|> a<|endoftext|>", "\u03a3\u0391\u03a3. \u0130, \u017f."]
    texts += ["".join(rnd.choice("aB \u00e9\n\t.,'1\u0301\u3000\u00a0\u4e2d\u01c5*") for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    assert enc.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def ids_of(path, text):
    t = Tokenizer.from_file(path) if path not in _known else _known[path]
    t.encode_special_tokens = True
    _known[path] = t
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


_known = {}


def test_token_files(spark, docs, rows, empty):
    got = binary.token_files(docs, BYTE_BPE, block_ids=300).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    at, expected = 0, []
    for d, t in want:
        ids = ids_of(BYTE_BPE, t)
        expected.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert binary.token_files(empty, BYTE_BPE).count() == 0


def test_token_files_random_access(spark, docs, rows):
    from tidegauge.session import fresh_path

    path = fresh_path(spark, "ids")
    binary.write_ids(docs.where("doc_id < 300"), BYTE_BPE, path, block_ids=500)
    own = sorted((r for r in rows if r[0] is not None and r[0] < 300), key=lambda r: (r[0], zlib.crc32((r[1] or "").encode())))
    flat = np.concatenate([ids_of(BYTE_BPE, t) for _, t in own])
    for low, high in ((0, 10), (333, 2222), (len(flat) - 5, len(flat))):
        assert (binary.read_range(spark, path, low, high) == flat[low:high]).all()


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype("<u4")
    packed = binary.pack(ids, width)
    assert len(packed) == -(-1001 * width // 8)
    for low, high in ((0, 1001), (0, 0), (3, 4), (500, 977)):
        assert (binary.unpack(packed, width, low, high) == ids[low:high]).all()


def test_packing(docs, rows, empty):
    got = packing.pack(docs, WORD_BPE, 64).collect()
    want = []
    for d, t in rows:
        ids = ids_of(WORD_BPE, t)
        want += [(d, p, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for p, a in enumerate(range(0, len(ids), 64))]
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= 1.01 * -(-sum(w[3] for w in want) // 64) + 1
    assert packing.pack(empty, WORD_BPE, 64).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(4)
    for n in (1, 10, 5000, 200_000):
        counts = np.bincount(rng.integers(1, 257, n), minlength=257)
        plan = packing.make_plan(counts, 256)
        placed = np.zeros(257, np.int64)
        np.add.at(placed, plan.length, plan.high - plan.low)
        assert (placed == counts).all()
        assert plan.sequences <= 1.02 * (counts * np.arange(257)).sum() / 256 + 2


def test_language(docs, empty, spark):
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= got
    assert {p for d, p, _ in got} == {"aa", "und"}
    assert language.identify(empty).count() == 0
    untaught = language.identify(docs.withColumn("lang", language.F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    assert language.accepted(docs, language.fit(docs)).columns == docs.columns


def test_language_accuracy(spark, data):
    got = QUERIES["op5_language_id"](spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count() > 0
    assert got.where("lang_rejected").count() <= 0.01 * got.count()


def test_urls(spark):
    rnd = random.Random(8)
    parts = ["com", "net", "example", "www", "org", "en", "fr", "es", "EXAMPLE", ""]
    made = [None, "", "no scheme", "http://", "http://com", "http://com/", "x://net/es", "http://www.example.com/en/?q#f"]
    made += ["http://" + ".".join(rnd.choices(parts, k=rnd.randint(1, 4))) + rnd.choice(["", "/", "?a", "#b"])
             + "/".join(rnd.choices(parts, k=rnd.randint(0, 3))) + rnd.choice(["", "/", "?x=/en/"]) for _ in range(500)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(made)], "page_id long, url string, rule string")
    for r in urls.filter_urls(pages, URL_RULES).collect():
        m = re.match(r"([^/?#]*)([^?#]*)", (made[r.page_id] or "").partition("://")[2])
        host, path = m[1].lower(), m[2]
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.host), len(x.path)), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (
            host, path, best and best.name, best.verdict if best else "allow"), made[r.page_id]
    with pytest.raises(ValueError):
        urls.Trie([urls.Rule("a", "/", "allow"), urls.Rule("a", "/", "block")])


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)).astype("float32")
    x[100:400] = x[100]
    bad = [(1000, None), (1020, [float("nan")] * 8), (None, [1.0] * 8), (1040, [None] * 8), (1060, [float("inf")] * 8)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad + [(0, x[0].tolist())],
                                  "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(
        frame, topk.F.col("vec_id") % 20 == 0, 20, 64).collect())
    ints = np.floor(64 * x.astype(float)).astype(int)
    want = []
    for q in range(0, 700, 20):
        best = sorted((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(frame.limit(0), topk.F.col("vec_id") % 20 == 0).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert order((r.doc_id, r["size"], r.text_crc32) for r in got) == order(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.shard for r in got} <= set(range(4))
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_sharding_is_even(spark, data):
    size = [r.b for r in QUERIES["op8_sharding"](spark, data).groupBy("shard").sum("size").toDF("shard", "b").collect()]
    longest = spark.read.parquet(f"{data}/documents.parquet").selectExpr("max(octet_length(text))").first()[0]
    assert len(size) == 16 and max(size) - min(size) <= 2 * longest


def test_benchmark(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, "Which alpha beta gamma delta stands here today? The answer is epsilon zeta."), (2, None), (3, ""),
         (4, "Ein zwei drei vier. Sieben acht neun zehn elf.")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(300))
    own = spark.createDataFrame(
        [(1, f"{filler} which Alpha beta, gamma delta stands here today the answer is epsilon zeta {filler}"),
         (2, filler), (3, None), (4, "which alpha beta gamma"), (5, "ein zwei drei vier sieben acht neun zehn elf"),
         (None, "ein zwei drei vier sieben acht neun zehn elf")], "doc_id long, text string")
    assert order((r.doc_id, r.item_id) for r in benchmark.contamination(own, items).collect()) == order([(1, 1), (5, 4), (None, 4)])
    assert order(r.doc_id for r in benchmark.uncontaminated(own, items).collect()) == [2, 3, 4]
    assert benchmark.contamination(empty, items).count() == 0
    assert benchmark.contamination(docs, items.limit(0)).count() == 0


def test_block_max_search():
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    for score in (0.2, 0.5, 0.9):
        index = benchmark.Index(items, benchmark.Rule(score=score))
        for _ in range(100):
            terms = sorted({index.term[w] for w in rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 8))})
            total = {}
            for t in terms:
                for item, x in index.postings[t]:
                    total[item] = total.get(item, 0) + x
            want = {i for i, x in total.items() if x >= score - 1e-9}
            assert {i for i, _ in index.search(terms)} == want


def test_leaks_found(spark, data):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op9_benchmark_decontamination"](spark, data).collect()}
    flat = lambda t: " ".join(t.split())
    documents = spark.read.parquet(f"{data}/documents.parquet").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    assert {(d.doc_id, i.item_id) for d in documents for i in items if flat(i.text) in flat(d.text)} <= found


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, data, name):
    assert compare(QUERIES[name](spark, data), connect(data), ORACLES[name]) == []


def test_pipeline(spark, data):
    docs = corpus_pipeline.table(spark, data, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(spark, stage(spark, before, data), "stage")
        assert after.columns == docs.columns and 0.8 * before.count() <= after.count() <= before.count(), name
        before = after
    kept = before.collect()
    sets = [shingles(r.text, 5) for r in kept if r.text]
    assert not any(p.search(r.text or "") for r in kept for p in [re.compile(BASE["email"])])
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert packed.select("doc_id").distinct().count() == len(kept) == len(sets)


def test_pipeline_on_odd_rows(spark, docs, data):
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = corpus_pipeline.written(spark, stage(spark, before, data), "stage")
        assert before.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, before, data).count() > 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0
