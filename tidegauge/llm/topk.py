"""Exact top-k inner products: candidates by descending length, rotated partial sums, Cauchy-Schwarz bounds.

All vectors are rotated by the singular vectors of the candidates (their second moments are summed up over the whole
table), so that the first coordinates carry most of a product. Candidates lie in blocks by descending length. A block
of queries meets a block of candidates only while the product of the lengths can still reach the queries' k-th best
score; inside, the exact partial sum over the first coordinates plus the product of the residual lengths bounds each
score, and only candidates above the k-th best are multiplied out, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.common import prepare, tables, written

CANDIDATES = 4096  # rows of a candidate block
QUERIES = 512  # rows of a query block
VECTOR = "vec_id long, vector array<long>, length double"


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """`vec_id`, floor(scale * x) per component and the length; vectors that are null or hold a null or a number
    that is not finite take no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select("vec_id", ints.alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("length", F.sqrt(squares))


def _matrix(column) -> np.ndarray:
    values = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rotation(rows: DataFrame, size: int) -> np.ndarray:
    """Eigenvectors of the second moments of all rows, strongest first: one matrix of `size` squared per task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in tables(batches):
            x = _matrix(batch.column("vector")).astype(float)
            total += x.T @ x
        yield pa.record_batch({"at": pa.array(range(size), pa.int32()), "row": pa.array(list(total))})

    parts = rows.select("vector").mapInArrow(moments, "at int, row array<double>")
    sums = parts.select("at", F.posexplode("row")).groupBy("at", "pos").agg(F.sum("col").alias("v"))
    got = sums.toArrow()  # size squared numbers
    moment = np.zeros((size, size))
    moment[got.column("at").to_numpy(), got.column("pos").to_numpy()] = got.column("v").to_numpy()
    return np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1]


def _blocks(rows: DataFrame, per_block: int, name: str, parts: int) -> DataFrame:
    """Rows in blocks by descending length: `block`, ids, vectors and the greatest length. Blocks come from
    range partitions cut into pieces, so that equal lengths may share out over many."""

    def close(ids, vectors, lengths):
        return pa.record_batch({
            "ids": pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([np.concatenate(vectors).astype("<i8").tobytes()], pa.binary()),
            "top": pa.array([max(float(x.max()) for x in lengths)], pa.float64()),
        })

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, lengths, held = [], [], [], 0
        for batch in tables(batches):
            for low in range(0, batch.num_rows, per_block):
                part = batch.slice(low, min(per_block - held, batch.num_rows - low) if held else per_block)
                ids.append(part.column("vec_id").to_numpy(zero_copy_only=False))
                vectors.append(_matrix(part.column("vector")))
                lengths.append(part.column("length").to_numpy(zero_copy_only=False))
                held += part.num_rows
                rest = batch.slice(low + part.num_rows, max(0, min(per_block, batch.num_rows - low) - part.num_rows))
                if held >= per_block:
                    yield close(ids, vectors, lengths)
                    ids, vectors, lengths, held = [], [], [], 0
                if rest.num_rows:
                    ids.append(rest.column("vec_id").to_numpy(zero_copy_only=False))
                    vectors.append(_matrix(rest.column("vector")))
                    lengths.append(rest.column("length").to_numpy(zero_copy_only=False))
                    held += rest.num_rows
        if held:
            yield close(ids, vectors, lengths)

    # The id breaks ties, so that many equal lengths do not meet in one range.
    ordered = rows.repartitionByRange(parts, F.desc("length"), F.asc("vec_id")).sortWithinPartitions(
        F.desc("length"), F.asc("vec_id"))
    packed = ordered.mapInArrow(gather, "ids binary, vectors binary, top double")
    return written(rows.sparkSession, packed.withColumn("block", F.monotonically_increasing_id()), name)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _search(q_ids, q, c_ids, c, least, k, turn, head):
    """Best candidates of one block for one block of queries; `least` is each query's score to reach."""
    norm = np.linalg.norm
    cr, qr = c @ turn, q @ turn
    partial = qr[:, :head] @ cr[:, :head].T
    rest = np.outer(norm(qr[:, head:], axis=1), norm(cr[:, head:], axis=1))
    bound = partial + rest
    # The rotation is in floating point; the slack covers its rounding.
    slack = 1e-9 * np.outer(norm(q, axis=1), norm(c, axis=1)) + 1e-6
    out = []
    whole_c = c.astype(np.int64)
    for i, query in enumerate(q.astype(np.int64)):
        alive = np.flatnonzero((bound[i] + slack[i] >= least[i]) & (c_ids != q_ids[i]))
        # Best bounds first: their scores raise the bar for the others.
        first = alive[np.argsort(-bound[i, alive], kind="stable")[:4 * k]]
        score = whole_c[first] @ query
        if len(first) < len(alive):
            bar = max(least[i], np.partition(score, len(score) - k)[len(score) - k])
            alive = alive[bound[i, alive] + slack[i, alive] >= bar]
            score = whole_c[alive] @ query
        else:
            alive = first
        best = _best(c_ids[alive], score, k)
        out.append((c_ids[alive[best]], score[best]))
    return out


FOUND = "query_id long, vec_id long, score long"


def _searched(pairs: DataFrame, k: int, turn: np.ndarray, head: int, size: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q = np.frombuffer(row["q_vectors"], "<i8").reshape(-1, size).astype(float)
                c = np.frombuffer(row["vectors"], "<i8").reshape(-1, size).astype(float)
                least = np.frombuffer(row["least"], "<f8") if row["least"] else np.full(len(q), -np.inf)
                found = _search(q_ids, q, c_ids, c, least, k, turn, head)
                yield pa.record_batch({
                    "query_id": pa.array(np.repeat(q_ids, [len(i) for i, _ in found]), pa.int64()),
                    "vec_id": pa.array(np.concatenate([i for i, _ in found]), pa.int64()),
                    "score": pa.array(np.concatenate([s for _, s in found]).astype(np.int64), pa.int64()),
                })

    return pairs.select("q_ids", "q_vectors", "least", "ids", "vectors").mapInArrow(search, FOUND)


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's k greatest whole-number inner products with the other rows.

    `is_query` is a condition on `vec_id`. Ties go to the smaller `vec_id`; candidates are all rows but those with
    the query's own id; rows with equal ids and vectors count once. An empty table gives no row; all vectors must
    have the same number of components, else an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(spark, whole(vectors, scale).dropDuplicates(), "vectors")
    n, low, high = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not n or not high:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if low != high:
        raise ValueError("vectors of different sizes")
    turn, head, parts = rotation(rows, high), max(1, high // 2), max(1, -(-n // CANDIDATES))
    queries = rows.where(is_query)
    q_blocks = _blocks(queries, QUERIES, "query-blocks", max(1, -(-n // (20 * QUERIES)))).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
        F.col("top").alias("q_top"))
    c_blocks = _blocks(rows, CANDIDATES, "candidate-blocks", parts)

    # First the block of the longest candidates: it gives every query a score to reach.
    first = c_blocks.orderBy(F.desc("top"), "block").limit(1).withColumn("at", F.lit(0))
    seed = _searched(q_blocks.withColumn("at", F.lit(0)).withColumn("least", F.lit(None).cast("binary"))
                     .join(first, "at"), k, turn, head, high)
    seed = written(spark, seed, "seed")
    # The k-th best of each query, if it has k, in the order of its block.
    reach = seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s")).select(
        "query_id", F.when(F.col("n") >= k, F.col("s")).otherwise(float("-inf")).alias("s"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            for block, ids in zip(batch.column("q_block").to_pylist(), batch.column("q_ids").to_pylist()):
                own = np.frombuffer(ids, "<i8")
                yield pa.record_batch({"q_block": pa.array([block] * len(own), pa.int64()),
                                       "query_id": pa.array(own), "at": pa.array(range(len(own)), pa.int32())})

    members = q_blocks.select("q_block", "q_ids").mapInArrow(ids_of, "q_block long, query_id long, at int")
    bars = members.join(reach, "query_id", "left").groupBy("q_block").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("s", F.lit(float("-inf"))).alias("s")))).alias("bars"),
        F.min(F.coalesce("s", F.lit(float("-inf")))).alias("least_bar"))

    def pack_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            packed = [np.array([b["s"] for b in bars], "<f8").tobytes() for bars in batch.column("bars").to_pylist()]
            yield pa.record_batch([batch.column("q_block"), batch.column("least_bar"), pa.array(packed, pa.binary())],
                                  names=["q_block", "least_bar", "least"])

    bars = written(spark, bars.mapInArrow(pack_bars, "q_block long, least_bar double, least binary"), "bars")
    # Which blocks meet is decided on block numbers and lengths alone, one list per block of queries.
    others = c_blocks.join(first.select(F.col("block").alias("seen")), F.col("block") == F.col("seen"), "left_anti")
    tops = others.agg(F.collect_list(F.struct("block", "top")).alias("c"))
    meet = (
        q_blocks.select("q_block", "q_top").join(bars.select("q_block", "least_bar"), "q_block").withColumn("at", F.lit(0))
        .join(tops.withColumn("at", F.lit(0)), "at").select("q_block", "q_top", "least_bar", F.explode("c").alias("c"))
        .where(F.col("c.top") * F.col("q_top") * (1 + 1e-9) + 1e-6 >= F.col("least_bar"))
        .select("q_block", F.col("c.block").alias("block"))
    )
    pairs = meet.join(q_blocks, "q_block").join(bars.select("q_block", "least"), "q_block").join(others, "block")
    found = seed.unionByName(_searched(pairs, k, turn, head, high))
    # At most k rows per query and block of candidates: cut down once by bucket, then as a whole.
    bucket = Window.partitionBy("query_id", "bucket").orderBy(F.desc("score"), "vec_id")
    whole_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    few = (
        found.withColumn("bucket", F.pmod(F.col("vec_id"), F.lit(max(1, parts // 8)))).withColumn(
            "r", F.row_number().over(bucket)).where(F.col("r") <= k)
    )
    return (
        few.withColumn("rank", F.row_number().over(whole_query)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
