"""Best-fit packing of documents into sequences: a configuration linear program over the length histogram.

Only the histogram of lengths (one number per length up to the sequence size) reaches the driver. There the program
"cover every length's count with configurations that fit one sequence" is solved by multiplicative weights: the
weights price the lengths, a knapsack dynamic program finds the best configuration at these prices, its use counts
as a step, and the weights of what it covers fall. Whole multiples of the configurations are taken; what rounding
leaves goes best-fit, longest first, over classes of equal sequences. The plan's size depends on the sequence size
and the number of steps, never on the number of documents. Executors then give the r-th piece of a length its place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.common import prepare, tables, written
from tidegauge.llm.encoding import ID, encoder

END_ID = 0
PIECES_KEPT = 100_000  # of text, in the encoder of a worker
LEAST = 1e-6  # of a piece: less than that lacks nothing
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def _piece_rows(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path, PIECES_KEPT), np.array([END_ID], ID).tobytes()
    for batch in tables(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encoded(texts)):
            ids += end
            for piece, low in enumerate(range(0, len(ids), 4 * size)):
                part = ids[low:low + 4 * size]
                rows.append((doc_id, piece, low // 4, len(part) // 4, zlib.crc32(part)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                              names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces_of(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """Pieces of at most `size` ids of every document; only longer documents are cut."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _piece_rows(it, tokenizer, size), PIECES)


@dataclass
class Plan:
    """Rows: pieces `low <= rank < high` of `length` stand `each` to a sequence, from `sequence` and `offset` on."""

    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


class Pricing:
    """Knapsack dynamic program: the value of the best content of every room at given prices per length."""

    def __init__(self, prices: np.ndarray, size: int):
        self.size = size
        self.lengths = np.flatnonzero(prices > 0)
        self.worth = prices[self.lengths]
        self.best = np.zeros(size + 1)
        for room in range(1, size + 1):
            n = np.searchsorted(self.lengths, room, "right")
            gain = (self.best[room - self.lengths[:n]] + self.worth[:n]).max(initial=0.0)
            self.best[room] = max(gain, self.best[room - 1])

    def content(self, lack: np.ndarray, slack: float, rng: np.random.Generator) -> Counter:
        """A content whose value is within `slack` of the best at every step back, drawn by what still lacks."""
        room, content = self.size, Counter()
        while room:
            n = np.searchsorted(self.lengths, room, "right")
            fits = self.lengths[:n]
            good = self.best[room - fits] + self.worth[:n] >= self.best[room] - slack
            weight = np.cumsum(np.where(good, lack[fits] * fits, 0.0))
            if not n or weight[-1] < LEAST:
                room -= 1
                continue
            length = int(fits[min(n - 1, np.searchsorted(weight, rng.random() * weight[-1], "right"))])
            content[length] += 1
            room -= length
        return content


def fractional(counts: np.ndarray, size: int, rate: float, step: float, rounds: int, draws: int, rest: float):
    """Configurations and how often the program uses each: multiplicative weights over the covering constraints.

    A piece's first price is its length, the program's optimum wherever short pieces fill every gap. Each of `rounds`
    prices the lengths and draws contents of (nearly) the best value; a content is used for the `step`-th part of
    what its scarcest length lacks, and what is covered loses weight. The last `rest` of the tokens is left to rounding. The draws are
    seeded.
    """
    lengths, rng = np.arange(size + 1), np.random.default_rng(0)
    lack = counts.astype(float)
    uses: Counter = Counter()
    for _ in range(rounds):
        if (lack * lengths).sum() < rest * (counts * lengths).sum():
            break
        weight = np.exp(-rate * (1 - lack / np.maximum(counts, 1)))
        pricing = Pricing(np.where(lack > 0, lengths * weight, 0.0), size)
        for _ in range(draws):
            content = pricing.content(lack, 1e-4 * pricing.best[size], rng)
            if not content:
                break
            use = step * min(lack[length] / n for length, n in content.items())
            uses[tuple(sorted(content.items()))] += use
            for length, n in content.items():
                lack[length] -= n * use
    return [(Counter(dict(key)), use) for key, use in uses.items()]


def best_fit(counts: np.ndarray, size: int) -> list[tuple[Counter, int]]:
    """Best fit, longest first, over classes of equal sequences: `(content, number of sequences)`."""
    by_gap: list[list[tuple[Counter, int]]] = [[] for _ in range(size + 1)]
    filled = np.zeros(size + 1, bool)

    def put(content: Counter, copies: int) -> None:
        gap = size - sum(length * n for length, n in content.items())
        by_gap[gap].append((content, copies))
        filled[gap] = True

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            gaps = np.flatnonzero(filled[length:])
            if not len(gaps):
                each = size // length
                if left // each:
                    put(Counter({length: each}), left // each)
                if left % each:
                    put(Counter({length: left % each}), 1)
                break
            gap = length + int(gaps[0])
            content, copies = by_gap[gap].pop()
            filled[gap] = bool(by_gap[gap])
            each = min(gap // length, left)
            take = min(copies, left // each)
            if take < copies:
                put(content, copies - take)
            put(content + Counter({length: each}), take)
            left -= take * each
    return [c for classes in by_gap for c in classes]


SCALES = (1.0, 0.9, 0.75, 0.5, 0.25)


def rounded(program: list[tuple[Counter, float]], counts: np.ndarray, size: int, scale: float):
    """Whole multiples of the program's configurations, `scale` times their use, and best fit for what is left."""
    left, classes = counts.copy(), []
    for content, use in program:
        copies = int(scale * use)
        if copies:
            classes.append((content, copies))
            for length, n in content.items():
                left[length] -= copies * n
    return classes + best_fit(left, size)


def make_plan(counts: np.ndarray, size: int, rate: float = 0.5, step: float = 0.25, rounds: int = 40,
              draws: int = 256, rest: float = 0.1) -> Plan:
    """Places for `counts[l]` pieces of every length l up to `size`: the program, rounded down.

    Rounding leaves scarce lengths that fit together badly; the more of the program is kept, the fewer other pieces
    are left to go with them. Of several scales the one with the fewest sequences is taken.
    """
    left = counts.astype(np.int64).copy()
    full, left[size] = int(left[size]), 0
    classes: list[tuple[Counter, int]] = [(Counter({size: 1}), full)] if full else []
    if left.sum():
        program = fractional(left, size, rate, step, rounds, draws, rest)
        tries = [rounded(program, left, size, scale) for scale in SCALES]
        classes += min(tries, key=lambda c: sum(copies for _, copies in c))
    rows, used, sequences = [], np.zeros(size + 1, np.int64), 0
    for content, copies in classes:
        offset = 0
        for length, n in sorted(content.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * copies, sequences, n, offset))
            used[length] += n * copies
            offset += n * length
        sequences += copies
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    return Plan(*columns, sequences)


def _ranked(pieces: DataFrame) -> DataFrame:
    """`rank` of every piece among those of its length, from 0: buckets number their own rows and are added up."""
    buckets = max(64, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    numbered = parts.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))


def _place(plan: Plan, size: int):
    """A function over Arrow batches that looks the place of every ranked piece up in the plan."""
    start = np.searchsorted(plan.length, np.arange(size + 2))
    # One sorted key for all lengths: the rank ranges of a length lie one after another.
    base = np.zeros(size + 2, np.int64)
    for length in range(size + 1):
        top = plan.high[start[length]:start[length + 1]].max(initial=0)
        base[length + 1] = base[length] + top
    key = base[plan.length] + plan.low

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(key, base[length] + rank, "right") - 1
            at = rank - plan.low[row]
            sequence = plan.sequence[row] + at // plan.each[row]
            offset = plan.offset[row] + at % plan.each[row] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                                  names=[*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Null texts are empty and still end with id 0; null ids and repeated rows are packed like any other; other columns
    are ignored; an empty table gives no row. Pieces of equal length are told apart by id, piece and checksum; equal
    ones may take each other's place.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = written(spark, pieces_of(docs, tokenizer, size), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `size` rows
        counts[row["length"]] = row["count"]
    if not counts.any():
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = make_plan(counts, size)
    ranked = _ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_place(plan, size), PLACED)
