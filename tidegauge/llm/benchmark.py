"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every training document is cut into overlapping passages, each long enough to hold a whole item, and every passage is
a query against the index. A score is the item's BM25 weights that the passage's words collect, over the weights of
all its words: 1 means the passage has them all. All items above the threshold are retrieved and verified: the item's
question part and answer part must both be found in the passage as word sequences.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import prepare, tables

WORD = re.compile(r"\w+")
ITEMS_PER_INDEX = 1000  # items of one broadcast index; larger test sets take several passes
GROUP = 4  # items that share one bound


@dataclass(frozen=True)
class Rule:
    """Score to reach, length of compared word sequences, and the share of them that must be found in each part."""

    score: float = 0.5
    n: int = 3
    overlap: float = 0.5


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last sentence is the answer; a single sentence is cut in half."""
    sentences = [w for w in (words(s) for s in re.split(r"[.?!\n]+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    own = sentences[0] if sentences else []
    return own[:len(own) // 2], own[len(own) // 2:]


def sequences(own: Sequence[str], n: int) -> set[tuple[str, ...]]:
    """Distinct runs of n words; a shorter text is one run."""
    if not own:
        return set()
    return {tuple(own[i:i + n]) for i in range(max(1, len(own) - n + 1))}


class Index:
    """Postings `(item, impact)` in item order with the greatest impact of every group of items.

    Impacts are BM25 weights over the item's total, so scores lie between 0 and 1. `k1` and `b` are the usual ones.
    """

    def __init__(self, items: Sequence[tuple[int, str]], rule: Rule, k1: float = 1.2, b: float = 0.75):
        items = sorted((i, t) for i, t in items if words(t))
        self.rule, self.ids = rule, [i for i, _ in items]
        texts = [words(t) for _, t in items]
        self.longest = max(map(len, texts), default=0)
        mean = sum(map(len, texts)) / max(1, len(texts))
        df = Counter(w for t in texts for w in set(t))
        self.term = {w: i for i, w in enumerate(sorted(df))}
        idf = {w: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.groups = -(-len(items) // GROUP)
        self.bound = np.zeros((len(self.term) + 1, max(1, self.groups)), np.float32)  # the last row: unknown words
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for at, text in enumerate(texts):
            norm = k1 * (1 - b + b * len(text) / mean)
            weight = {w: idf[w] * n * (k1 + 1) / (n + norm) for w, n in Counter(text).items()}
            total = sum(weight.values())
            for w, x in weight.items():
                self.postings[self.term[w]].append((at, x / total))
                self.bound[self.term[w], at // GROUP] = max(self.bound[self.term[w], at // GROUP], x / total)
        self.top = self.bound.max(axis=1).tolist()
        self.parts = [tuple(sequences(p, rule.n) for p in parts_of(t)) for _, t in items]

    def may_match(self, terms: np.ndarray) -> np.ndarray:
        """Groups whose greatest impacts add up to the threshold for these distinct terms."""
        return np.flatnonzero(self.bound[terms].sum(axis=0) >= self.rule.score - 1e-4)

    def search(self, terms: Sequence[int]) -> list[tuple[int, float]]:
        """Block-max WAND: `(item, score)` of every item that reaches the threshold, for distinct known terms.

        Lists advance by item. The pivot is the first item at which the lists' overall maxima could reach the
        threshold; if the maxima of its group cannot, all lists skip to the next group whose maxima can, else the
        item is scored.
        """
        least = self.rule.score - 1e-9
        groups = self.may_match(np.array(terms, np.int32)).tolist() if len(terms) else []
        lists = [self.postings[t] for t in terms]
        tops = [self.top[t] for t in terms]
        at = [0] * len(lists)
        found, here, goal = [], range(len(lists)), groups[0] * GROUP if groups else 0
        while groups:
            for i in here:
                at[i] = bisect_left(lists[i], (goal,), at[i])
            live = sorted((own[a][0], i) for i, (own, a) in enumerate(zip(lists, at)) if a < len(own))
            upper, pivot = 0.0, None
            for item, i in live:
                upper += tops[i]
                if upper >= least - 1e-4:
                    pivot = item
                    break
            if pivot is None:
                break
            near = bisect_left(groups, pivot // GROUP)
            if near == len(groups):
                break
            here = [i for item, i in live if item <= pivot]
            goal = max(pivot, groups[near] * GROUP)
            if goal == pivot and live[0][0] == pivot:
                score = sum(lists[i][at[i]][1] for i in here)
                if score >= least:
                    found.append((pivot, score))
                goal = pivot + 1
            elif goal > pivot:
                here = [i for item, i in live if item < goal]
        return found

    def verify(self, item: int, passage: Sequence[str]) -> tuple[float, float]:
        """Shares of the item's question and answer sequences that the passage has; an empty part counts as found."""
        have = sequences(passage, self.rule.n)
        for n in {len(next(iter(p))) for p in self.parts[item] if p} - {self.rule.n}:
            have |= sequences(passage, n)
        return tuple(len(p & have) / len(p) if p else 1.0 for p in self.parts[item])

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """Per item found in the text: `(id, score, question, answer, start word)` of its best passage."""
        own = words(text)
        if not own or not self.ids:
            return []
        get, unknown = self.term.get, len(self.term)
        terms = np.array([get(w, unknown) for w in own], np.int32)
        size = 2 * self.longest
        if len(own) > size and not len(self.may_match(np.unique(terms))):
            return []
        best: dict[int, tuple] = {}
        for low in range(0, max(1, len(own) - self.longest), self.longest):
            distinct = np.unique(terms[low:low + size])
            if not len(self.may_match(distinct)):
                continue
            for item, score in self.search([int(t) for t in distinct if t != unknown]):
                question, answer = self.verify(item, own[low:low + size])
                if min(question, answer) >= self.rule.overlap:
                    key = (score, question + answer, -low)
                    if item not in best or key > best[item][0]:
                        best[item] = key, (self.ids[item], score, question, answer, low)
        return [row for _, row in sorted(best.values(), key=lambda x: x[1][0])]


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start_word int"


def _indexes(items: DataFrame, rule: Rule) -> Iterator[Index]:
    """Indexes of at most about `ITEMS_PER_INDEX` items each; every item is in one."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    shards = max(1, -(-rows.count() // ITEMS_PER_INDEX))
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()
        yield Index([(r["item_id"], r["text"]) for r in part], rule)


def contamination(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of `docs` and test item found in it, with its best passage.

    Null texts and texts without words match nothing; null items and items without words are no items; items that
    share an id count apart; null ids and repeated rows are searched like any other; other columns are ignored. An
    empty table on either side gives no row.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = None
    for index in _indexes(items, rule):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in tables(batches):
                rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                        for m in index.matches(t)]
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                names = [f.split()[0] for f in FOUND.split(", ")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        found = docs.select("doc_id", "text").mapInArrow(search, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """All columns of `docs` of the rows in which no test item is found."""
    spark = docs.sparkSession
    prepare(spark)
    for index in _indexes(items, rule):
        shared = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in tables(batches):
                yield batch.filter(pa.array([not index.matches(t) for t in batch.column("text").to_pylist()]))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
