"""Substring deduplication: suffix automata of reference shards and the matching statistics of streamed documents.

A window of `window` consecutive words is removed where its words also start earlier in the corpus, by document id
and then by place. The reference is the corpus itself, so its automata cannot be broadcast: they grow with the input.
They are cut into shards instead, and the shuffle brings the documents to them:

1. Every window has an anchor, the least hash among its runs of `anchor` words; equal windows have equal anchors.
   Consecutive windows with one anchor are a segment. Segments with the same anchor are a shard: any two equal
   windows of the corpus meet in exactly one shard. Anchors that stand at one place only are dropped.
2. In a shard, segments arrive in corpus order. A segment equal to an earlier one matches it in full length and is
   not streamed again. Of the others, the words are fetched and streamed through the shard's automaton: the matching
   statistics give, for every word, the longest run ending there that an earlier segment has. From `window` words on
   it is repeated. Then the segment is added to the automaton.
3. A shard with more than `shard_segments` different segments (a common line with ever different neighbours) is cut
   finer: its windows are their own anchors, and nothing of it is held in memory.

Maximal spans are the unions of the repeated windows of a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import among, prepare, tables, utf8, written
from tidegauge.llm.shingles import mix, runs, word_hashes

NO_ID = -(1 << 63)  # stands for a null id: such documents come first


@dataclass(frozen=True)
class Repeats:
    """Words of a window and of an anchor, and different segments of one shard."""

    window: int = 20
    anchor: int = 8
    shard_segments: int = 5000


class Automaton:
    """Suffix automaton over word numbers, built online; segments are kept apart by numbers of their own."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.gap = 0, -1

    def _extend(self, word: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        at = self.last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            to = nxt[at][word]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and nxt[at].get(word) == to:
                    nxt[at][word] = copy
                    at = link[at]
        self.last = new

    def add(self, words: list[int]) -> None:
        self._extend(self.gap)
        self.gap -= 1
        for word in words:
            self._extend(word)

    def statistics(self, words: list[int]) -> list[int]:
        """For every word the length of the longest run ending there that some added segment has."""
        nxt, link, length = self.next, self.link, self.length
        at, size, out = 0, 0, []
        for word in words:
            while at and word not in nxt[at]:
                at = link[at]
                size = length[at]
            if word in nxt[at]:
                at, size = nxt[at][word], size + 1
            out.append(size)
        return out


def spans_of(covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word ranges, as maximal ranges in order."""
    out: list[list[int]] = []
    for low, high in sorted(covered):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
ROW = ("key long, content long, id long, text_key long, low int, size int, done boolean")
ROW_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
ROW_NAMES = [f.split()[0] for f in ROW.split(", ")]


def segments(words: list[np.ndarray], rule: Repeats):
    """Of documents given as word hashes: document number, first window, windows, anchor hash, content hash."""
    sizes = np.array([len(w) for w in words], np.int64)
    none = np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < rule.window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    flat = np.concatenate(words)
    ends = np.cumsum(sizes)
    width = rule.window - rule.anchor + 1
    h = runs(flat, rule.anchor)
    # Least run of every window, the first of equals: narrower minima are joined into wider ones.
    start = np.arange(len(flat) - rule.window + 1)
    doc = np.searchsorted(ends, start, "right")
    start = start[start + rule.window <= ends[doc]]
    least = np.lib.stride_tricks.sliding_window_view(h, width)[start].argmin(axis=1) + start
    cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1])])
    first, n = start[cut], np.diff(np.r_[cut, len(start)])
    stop = first + n + rule.window - 1
    sums = np.r_[np.uint64(0), np.cumsum(flat * _powers(BASE, len(flat))[:-1], dtype=np.uint64)]
    content = mix((sums[stop] - sums[first]) * _powers(BASE_INVERSE, len(flat))[first] + n.astype(np.uint64))
    doc = np.searchsorted(ends, first, "right")
    return doc, first - (ends - sizes)[doc], n, h[least[cut]], content


def _merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Word ranges of documents joined where they touch."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    if not len(doc):
        return doc, low, high
    far = np.maximum.accumulate(high + doc * (1 << 33)) - doc * (1 << 33)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (low[1:] > far[:-1])])
    return doc[new], low[new], np.maximum.reduceat(high, new)


def _occurrences(batches: Iterator[pa.RecordBatch], rule: Repeats) -> Iterator[pa.RecordBatch]:
    """Segments of the documents. Of equal segments of one batch only the first goes on; the others are `done`, as
    an earlier one is known, and become word ranges."""
    for whole in tables(batches):
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            ids = np.array(batch.column("id").to_numpy(), np.int64)
            keys = np.array(batch.column("text_key").to_numpy(), np.int64)
            doc, low, n, anchor, content = segments([word_hashes(t) for t in utf8(batch.column("text"))], rule)
            if not len(doc):
                continue
            order = np.lexsort((low, keys[doc], ids[doc], content, anchor))
            doc, low, n, anchor, content = (x[order] for x in (doc, low, n, anchor, content))
            same = np.r_[False, (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])]
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
            # Rows equal in id and text are one document: their segment is not earlier than itself.
            own = (ids[doc] == ids[doc[lead]]) & (keys[doc] == keys[doc[lead]]) & (low == low[lead])
            d, a, z = _merged(*(x[same & ~own] for x in (doc, low, low + n + rule.window - 1)))
            go = np.flatnonzero(~same)
            yield pa.record_batch([
                pa.array(np.r_[anchor[go].view(np.int64), keys[d]]), pa.array(np.r_[content[go].view(np.int64), keys[d] * 0]),
                pa.array(np.r_[ids[doc[go]], ids[d]]), pa.array(np.r_[keys[doc[go]], keys[d]]),
                pa.array(np.r_[low[go], a].astype(np.int32)), pa.array(np.r_[n[go], z - a].astype(np.int32)),
                pa.array(np.r_[np.zeros(len(go), bool), np.ones(len(d), bool)]),
            ], names=ROW_NAMES)


REPEATED, STREAM, FINER = 0, 1, 2
FOUND = "kind int, key long, id long, text_key long, low int, size int"
FOUND_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
FOUND_NAMES = [f.split()[0] for f in FOUND.split(", ")]


def _rows(rows: list[tuple], types, names) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _meet(batches: Iterator[pa.RecordBatch], rule: Repeats) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and corpus order: repeated word ranges, and segments that must be streamed.

    Holds the contents of one shard, up to `shard_segments`; a shard with more is passed on whole, to be cut finer.
    """
    margin = rule.window - 1
    key, first, seen, finer = None, None, {}, False
    for batch in tables(batches):
        keys = batch.column("key").to_numpy()
        done = batch.column("done").to_numpy(zero_copy_only=False)
        if done.any():
            own = batch.filter(pa.array(done))
            yield pa.record_batch([pa.array(np.zeros(own.num_rows, np.int32)), *(own.column(n) for n in FOUND_NAMES[1:])],
                                  names=FOUND_NAMES)
        same = keys[1:] == keys[:-1]
        near = np.ones(len(keys), bool)
        near[1:-1] = same[1:] | same[:-1]
        part = batch.filter(pa.array(near & ~done))
        out = []
        for k, c, i, t, low, n in zip(*(part.column(x).to_pylist() for x in ROW_NAMES[:6])):
            if k != key:
                key, first, finer = k, (k, i, t, low, n), False
                seen = {c: (i, t, low)}
                continue
            place = seen.get(c)
            if place == (i, t, low):
                continue  # the same document once more
            if place is not None:
                out.append((REPEATED, k, i, t, low, n + margin))
                continue
            if first is not None:
                out.append((STREAM, *first))
                first = None
            if finer:
                out.append((FINER, k, i, t, low, n))
                continue
            out.append((STREAM, k, i, t, low, n))
            seen[c] = (i, t, low)
            if len(seen) > rule.shard_segments:
                finer = True  # windows of the segments so far are handed over for comparison with the later ones
        if out:
            yield _rows(out, FOUND_TYPES, FOUND_NAMES)


WORDS = "kind int, key long, id long, text_key long, low int, words binary"


def _fetch(batches: Iterator[pa.RecordBatch], rule: Repeats) -> Iterator[pa.RecordBatch]:
    """Words of the segments to be streamed; of shards to be cut finer, every window by its own hash."""
    for batch in tables(batches):
        out = []
        for i, t, text, wanted in zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(),
                                      utf8(batch.column("text")), batch.column("wanted").to_pylist()):
            words = word_hashes(text).view(np.int64)
            for w in wanted:
                own = words[w["low"]:w["low"] + w["size"] + rule.window - 1]
                if w["kind"] == STREAM:
                    out.append((STREAM, w["key"], i, t, w["low"], own.tobytes()))
                    continue
                for at, h in enumerate(runs(own.view(np.uint64), rule.window).view(np.int64).tolist()):
                    out.append((FINER, h, i, t, w["low"] + at, None))
        if out:
            yield _rows(out, [*FOUND_TYPES[:5], pa.binary()], [f.split()[0] for f in WORDS.split(", ")])


RANGE = "id long, text_key long, low int, size int"


def _stream(batches: Iterator[pa.RecordBatch], rule: Repeats) -> Iterator[pa.RecordBatch]:
    """Word ranges of the streamed segments that an earlier segment of the shard has.

    Words of a shard are renumbered, so that the numbers that keep segments apart are never words.
    """
    key, shard, number, place = None, None, {}, None
    for batch in tables(batches):
        out = []
        for kind, k, i, t, low, words in zip(*(c.to_pylist() for c in batch.columns)):
            if (kind, k) != key:
                key, shard, number, place = (kind, k), Automaton(), {}, (i, t, low)
                if kind == FINER:
                    continue
            elif place == (i, t, low):
                continue  # the same document once more
            if kind == FINER:  # equal windows: the first one is the reference, all others match it
                out.append((i, t, low, rule.window))
                continue
            place = (i, t, low)
            own = [number.setdefault(w, len(number)) for w in np.frombuffer(words, "<i8").tolist()]
            covered = [(e - rule.window + 1, e + 1) for e, size in enumerate(shard.statistics(own)) if size >= rule.window]
            out += [(i, t, low + a, z - a) for a, z in spans_of(covered)]
            shard.add(own)
        if out:
            yield _rows(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], [f.split()[0] for f in RANGE.split(", ")])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_key"), "text")


def repeated(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """`id, text_key, ranges`: per document with any, the word ranges `(low, size)` of its repeated windows.

    `id` is the document's, or the least long where it is null; `text_key` the hash of its text. Documents are in
    order of both; rows equal in both are one document.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = _keyed(docs)
    order = ["id", "text_key", "low"]
    met = (
        rows.mapInArrow(lambda it: _occurrences(it, rule), ROW).repartition("key")
        .sortWithinPartitions("key", *order).mapInArrow(lambda it: _meet(it, rule), FOUND)
    )
    met = written(spark, met, "segments")
    wanted = met.where(F.col("kind") != REPEATED).groupBy("id", "text_key").agg(
        F.collect_list(F.struct("kind", "key", "low", "size")).alias("wanted"))  # within one document
    wanted = written(spark, _with_finer(met, wanted), "wanted")
    texts = among(rows, wanted, "text_key").dropDuplicates(["id", "text_key"])
    words = texts.join(wanted, ["id", "text_key"]).mapInArrow(lambda it: _fetch(it, rule), WORDS)
    streamed = (
        words.repartition("kind", "key").sortWithinPartitions("kind", "key", *order)
        .mapInArrow(lambda it: _stream(it, rule), RANGE)
    )
    ranges = met.where(F.col("kind") == REPEATED).select(*order, "size").union(streamed)
    return ranges.groupBy("id", "text_key").agg(F.collect_list(F.struct("low", "size")).alias("ranges"))


def _with_finer(met: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shards cut finer need the windows of their first segments too."""
    shards = met.where(F.col("kind") == FINER).select("key").distinct()
    first = met.where(F.col("kind") == STREAM).join(shards, "key", "left_semi").select(
        "id", "text_key", F.lit(FINER).alias("kind"), "key", "low", "size")
    again = first.groupBy("id", "text_key").agg(F.collect_list(F.struct("kind", "key", "low", "size")).alias("more"))
    none = F.array().cast("array<struct<kind:int,key:bigint,low:int,size:int>>")
    both = wanted.join(again, ["id", "text_key"], "left")
    return both.select("id", "text_key", F.concat("wanted", F.coalesce("more", none)).alias("wanted"))


def _kept(text: bytes, ranges) -> tuple[int, int, bytes]:
    """Words, removed words and the words that stay, joined by one space."""
    words = text.split()
    keep, done = [], 0
    for low, high in spans_of([(r["low"], r["low"] + r["size"]) for r in ranges or []]):
        keep += words[done:low]
        done = high
    keep += words[done:]
    return len(words), len(words) - len(keep), b" ".join(keep)


REMOVED = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<low:int,high:int>>"


def remove(docs: DataFrame, rule: Repeats = Repeats(), digest: bool = False) -> DataFrame:
    """Per row of `docs`: `doc_id`, its words, how many are removed, what stays (or only its sha256), and the spans.

    Null texts have no words. Documents that share an id come in the order of their text hashes; rows equal in id and
    text are one document and are treated alike; null ids come first. Other columns are ignored; an empty table gives
    no row.
    """
    prepare(docs.sparkSession)
    # Read twice: once for its segments, once for what is left of the texts.
    found = repeated(docs, rule)
    both = docs.select("doc_id", *(c for c in (F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
                                               F.xxhash64("text").alias("text_key"))), "text").join(
        found, ["id", "text_key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            ranges = batch.column("ranges").to_pylist()
            got = [_kept(t, r) for t, r in zip(utf8(batch.column("text")), ranges)]
            kept = [hashlib.sha256(k).hexdigest() if digest else k.decode() for _, _, k in got]
            spans = [[{"low": a, "high": z} for a, z in spans_of([(r["low"], r["low"] + r["size"]) for r in own or []])]
                     for own in ranges]
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()),
                                   pa.array([r for _, r, _ in got], pa.int64()), pa.array(kept, pa.string()),
                                   pa.array(spans, kind)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return both.select("doc_id", "text", "ranges").mapInArrow(cut, REMOVED)
