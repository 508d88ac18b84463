"""Source divergence against plain loops over all terms and pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect

from tidegauge.llm import divergence
from tidegauge.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, row long"


def expected(rows, most=200):
    groups, langs, docs = {}, {}, {}
    for text, lang, source in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups.setdefault((lang, source), Counter()).update(words)
        langs.setdefault(lang, Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang, counts in langs.items():
        kept = sorted(t for t in counts if docs[lang][t] >= 3)

        def share(own, total, t):
            return 1 + 10**9 * (own[t] + 1) // (total + len(kept))

        own = {s: (c, sum(c[t] for t in kept)) for (g, s), c in groups.items() if g == lang}
        total = sum(counts[t] for t in kept)
        for source, (c, n) in own.items():
            values = {s: sum((share(c, n, t) - share(d, m, t)) ** 2 // share(d, m, t) for t in kept)
                      for s, (d, m) in own.items() if s != source}
            parts = [("pair", values, None)]
            p, q = {t: share(c, n, t) for t in kept}, {t: share(counts, total, t) for t in kept}
            parts.append(("term", {t: (p[t] - q[t]) ** 2 // q[t] for t in kept if c[t] and p[t] > q[t]}, most))
            for part, found, cut in parts:
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:cut]
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i % 5, *r, 1, "x", 2) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


def texts(rnd, sources, docs, hot=0.3):
    """A third of the rows from one source; 300 words, some frequent, some of one source only."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    out = []
    for _ in range(docs):
        source = 0 if rnd.random() < hot else rnd.randrange(sources)
        own = [rnd.choice(words[:rnd.choice([5, 60, 300])]) for _ in range(rnd.randint(0, 40))]
        out.append((" ".join(own + [f"only{chr(97 + source % 26)}x"] * rnd.randint(0, 2)), rnd.choice(["en", "en", "de"]), f"s{source}"))
    return out


def test_nulls_cases_and_repeats(spark):
    rows = texts(random.Random(1), 6, 150)
    rows += [(None, None, None), ("Été ÉTÉ étÉ a-b_c", None, "s1"), ("", "en", "empty"), (None, "en", None), ("one", "xx", "s1"),
             ("one two", "xx", "s2"), ("A1b2C", "en", "s1")] * 3 + [("x" * 200_000 + " y", "en", "s2")] * 3 + [("lone", "zz", "s")]
    assert got(divergence.audit(frame(spark, rows))) == expected(rows)


def test_many_sources_meet_over_tiles(spark):
    """150 sources: three tiles, of which some have no cell in a slab."""
    rows = texts(random.Random(2), 150, 500)
    assert got(divergence.audit(frame(spark, rows, 5), most_terms=7)) == expected(rows, 7)


def test_slabs_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLAB_CELLS", 40)
    rows = texts(random.Random(4), 9, 200)
    assert got(divergence.audit(frame(spark, rows))) == expected(rows)


def test_empty_table(spark):
    assert got(divergence.audit(frame(spark, []))) == []


def test_joint_traversal_equals_dense(monkeypatch):
    rnd = np.random.default_rng(3)
    for density, most in ((0.0, 1 << 19), (0.01, 1 << 19), (0.3, 64)):
        monkeypatch.setattr(divergence, "CELLS_AT_ONCE", most)
        width, made = 150, []
        for _ in range(2):
            dense = rnd.integers(1, 9, (64, width)) * (rnd.random((64, width)) < density)
            rows, columns = np.nonzero(dense)
            forest = divergence.Forest.build(rows, columns, dense[rows, columns], width)
            made.append((dense, divergence.Forest.unpack(*forest.pack())))
        (a, fa), (b, fb) = made
        n, both = np.zeros((64, 64), int), np.zeros((64, 64), int)
        for row_a, row_b, p, q in divergence.traverse(fa, fb):
            np.add.at(n, (row_a, row_b), 1)
            np.add.at(both, (row_a, row_b), 10 * p + q)
        some = (a[:, None, :] != 0) | (b[None, :, :] != 0)
        assert (n == some.sum(2)).all()
        assert (both == (10 * a.sum(1)[:, None] + b.sum(1)[None, :])).all()


def test_large_counts_are_exact(spark):
    n, total, terms = 10**13 + 7, 9 * 10**14 + 3, 1234567
    row = spark.range(1).select(divergence.probability(*(divergence.F.lit(x) for x in (n, total, terms))).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + terms)


def test_query_equals_sql(spark, data):
    name = "op12_source_divergence"
    assert compare(QUERIES[name](spark, data), connect(data), ORACLES[name]) == []


@pytest.mark.parametrize("value", [0, 1, 63, 4095])
def test_cells_keep_their_place(value):
    row, column = np.array([value // 64]), np.array([value % 64])
    forest = divergence.Forest.build(row, column, np.array([5]), 64)
    found = [x for x in divergence.traverse(forest, forest)]
    assert any((a == row[0]).any() and (p == 5).any() for a, _, p, _ in found)
