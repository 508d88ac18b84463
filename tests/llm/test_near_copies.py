"""The join on one large group of near copies around the limit: all links, few pairs tested."""

import random

import pytest

from tidegauge.llm import jaccard


def brute(texts, n, percent):
    sets = [{tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("edits", [(1, 2), (0, 4)])
def test_a_group_of_near_copies(spark, monkeypatch, edits):
    rnd = random.Random(sum(edits))
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(400):
        own = list(base)
        for _ in range(rnd.randint(*edits)):
            at = rnd.randrange(len(own))
            own[at:at + 1] = rnd.choice([[], ["x"], [f"y{rnd.randrange(30)}"], [own[at], "z"]])
        texts.append(" ".join(own))
    texts += [" ".join(f"v{rnd.randrange(50)}" for _ in range(60)) for _ in range(50)]
    seen = {}

    def kept(spark, df, name, own=jaccard.written):
        out = own(spark, df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.link(docs, jaccard.Similarity(4, 85)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 4, 85)
    tested = sum(seen[name][0].count() for name in ("stars", "near", "rest"))
    assert tested < 25 * len(texts)
