"""How the sources of a language differ in their words: a K-squared quadtree over the matrix of groups and terms.

Rows of the matrix are the sources of a language, columns its kept terms. Columns are dealt to slabs of about equal
numbers of nonzero cells, rows to tiles; every (slab, tile) is a forest of quadtrees, one bit per quadrant. Two tiles
are traversed together from the roots: a quadrant that is zero in both is left at once, because all of its cells
have the same price, the one of two counts of zero; what remains at the leaves are the columns in which at least one of
the two sources has the term, and only those are priced one by one. So a pair costs what its two sources hold, not
what the language does.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.common import prepare, tables, utf8, written

SCALE = 1_000_000_000
ROWS_BITS = 6  # a tile has 64 sources, a tree as many columns
SLAB_CELLS = 1 << 16
HELD_TERMS = 200_000  # different (group, term) a task counts before it hands them on
CELLS_AT_ONCE = 1 << 19  # pairs of nodes traversed together

# Everything but letters is a space; A-Z become a-z. Bytes from 0x80 on belong to letters beyond ASCII.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every (lang, source, term), combined within the task."""
    seen: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
    docs: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
    names = ["lang", "source", "term", "n", "docs"]

    def out() -> Iterator[pa.RecordBatch]:
        for group, counts in seen.items():
            terms, own = list(counts), docs[group]
            for at in range(0, len(terms), 20_000):
                some = terms[at:at + 20_000]
                yield pa.record_batch([
                    pa.array([group[0]] * len(some), pa.binary()).cast(pa.string()),
                    pa.array([group[1]] * len(some), pa.binary()).cast(pa.string()),
                    pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array([counts[t] for t in some], pa.int64()), pa.array([own[t] for t in some], pa.int64()),
                ], names=names)
        seen.clear()
        docs.clear()

    for batch in tables(batches):
        for lang, source, text in zip(*(utf8(batch.column(c)) for c in ("lang", "source", "text"))):
            words = text.translate(LETTERS).split()
            seen[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, seen.values())) > HELD_TERMS:
            yield from out()
    yield from out()


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    wide = "decimal(38,0)"
    share = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"),
                            (total + terms).cast(wide))
    return (share + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q  # at most SCALE + 1, its square fits
    return d * d // q


def _interleave(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Row and column bits in turn: the place of a cell in the order of quadrants."""
    out = np.zeros(len(row), np.int64)
    for bit in range(ROWS_BITS):
        out |= ((row >> bit) & 1) << (2 * bit + 1) | ((column >> bit) & 1) << (2 * bit)
    return out


class Forest:
    """Quadtrees over 64 x 64 cells: per level one bit per quadrant, at the leaves the value of a cell."""

    def __init__(self, bits: list[np.ndarray], values: np.ndarray) -> None:
        self.bits, self.values = bits, values
        self.child = [np.cumsum(level) - 1 for level in bits]  # number of the node a set bit leads to

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> Forest:
        """From the nonzero cells of a tile with `width` columns."""
        side = 1 << ROWS_BITS
        code = (columns // side) << (2 * ROWS_BITS) | _interleave(rows, columns % side)
        order = np.argsort(code)
        code, values = code[order], values[order]
        bits = []
        above = np.arange(-(-width // side), dtype=np.int64)  # one root a tree, empty trees too
        for level in range(ROWS_BITS - 1, -1, -1):
            nodes = np.unique(code >> (2 * level))
            level_bits = np.zeros(4 * len(above), np.bool_)
            level_bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            bits.append(level_bits)
            above = nodes
        return cls(bits, values)

    def pack(self) -> tuple[list[bytes], list[int], bytes]:
        return [np.packbits(b).tobytes() for b in self.bits], [len(b) for b in self.bits], self.values.astype("<i8").tobytes()

    @classmethod
    def unpack(cls, bits: list[bytes], lengths: list[int], values: bytes) -> Forest:
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(np.bool_) for b, n in zip(bits, lengths)]
        return cls(levels, np.frombuffer(values, "<i8"))

    def below(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """Numbers of the children in one quadrant; -1 for a quadrant of zeros."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.child[level][at], -1)


def traverse(a: Forest, b: Forest) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cells (row of a, row of b, value in a or 0, value in b or 0) of every column where one of the two is not zero."""
    roots = np.arange(len(a.bits[0]) // 4)
    zero = np.zeros(len(roots), np.int64)
    stack = [(0, roots, roots, zero, zero)]
    while stack:
        level, in_a, in_b, row_a, row_b = stack.pop()
        if level == ROWS_BITS:
            yield (row_a, row_b, np.where(in_a >= 0, a.values[in_a], 0) if len(a.values) else np.zeros_like(in_a),
                   np.where(in_b >= 0, b.values[in_b], 0) if len(b.values) else np.zeros_like(in_b))
            continue
        if len(in_a) > CELLS_AT_ONCE // 8:  # depth first, so that the memory stays bounded
            cut = len(in_a) // 2
            stack += [(level, in_a[:cut], in_b[:cut], row_a[:cut], row_b[:cut]),
                      (level, in_a[cut:], in_b[cut:], row_a[cut:], row_b[cut:])]
            continue
        found = []
        for column in (0, 1):
            for upper in (0, 1):
                child_a = a.below(level, in_a, 2 * upper + column)
                for lower in (0, 1):
                    child_b = b.below(level, in_b, 2 * lower + column)
                    some = (child_a >= 0) | (child_b >= 0)  # the rest is zero in both
                    found.append((child_a[some], child_b[some], 2 * row_a[some] + upper, 2 * row_b[some] + lower))
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*found))))


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in the order of (lang, slab, term) to forests, one per tile of the language, empty ones too."""
    side = 1 << ROWS_BITS
    names = ["lang", "slab", "tile", "width", "bits", "lengths", "p"]
    key, last, width, held = None, None, 0, []

    def out() -> Iterator[pa.RecordBatch]:
        rows, columns, values = (np.array(x, np.int64) for x in zip(*held))
        for tile in range(tiles):
            own = rows // side == tile
            bits, lengths, p = Forest.build(rows[own] % side, columns[own], values[own], width).pack()
            yield pa.record_batch([
                pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([tile], pa.int64()),
                pa.array([width], pa.int64()), pa.array([bits], pa.list_(pa.binary())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([p], pa.binary()),
            ], names=names)

    for batch in tables(batches):
        for lang, slab, term, row, p, n_tiles in zip(*(batch.column(c).to_pylist() for c in (
                "lang", "slab", "term", "row", "p", "tiles"))):
            if (lang, slab) != key:
                if held:
                    yield from out()
                key, last, width, held, tiles = (lang, slab), None, 0, [], n_tiles
            if term != last:
                last, width = term, width + 1
            held.append((row, width - 1, p))
    if held:
        yield from out()


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles to sums of every pair of sources: prices of the columns one of them has, and their number."""
    side = 1 << ROWS_BITS
    sums: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), (there, back, n) in sums.items():
            a, b = np.nonzero(n)
            keep = a + side * i != b + side * j
            a, b = a[keep], b[keep]
            ways = [(a + side * i, b + side * j, there)]
            if i != j:
                ways.append((b + side * j, a + side * i, back))
            for rows, others, values in ways:
                yield pa.record_batch([
                    pa.array([lang] * len(a), pa.string()), pa.array(rows, pa.int64()), pa.array(others, pa.int64()),
                    pa.array(values[a, b], pa.int64()), pa.array(n[a, b], pa.int64()),
                ], names=["lang", "row", "other", "value", "n"])
        sums.clear()

    for batch in tables(batches):
        for r in batch.to_pylist():
            pair = (r["lang"], r["tile"], r["tile_b"])
            if pair not in sums:
                if len(sums) >= 64:
                    yield from out()
                sums[pair] = tuple(np.zeros((side, side), np.int64) for _ in range(3))
            there, back, n = sums[pair]
            zero_a, zero_b = np.array(r["zeros"], np.int64), np.array(r["zeros_b"], np.int64)
            a, b = Forest.unpack(r["bits"], r["lengths"], r["p"]), Forest.unpack(r["bits_b"], r["lengths_b"], r["p_b"])
            for row_a, row_b, p, q in traverse(a, b):
                # Rows beyond the last source have no zeros to be priced.
                real = (row_a < len(zero_a)) & (row_b < len(zero_b))
                row_a, row_b, p, q = row_a[real], row_b[real], p[real], q[real]
                p, q = np.where(p, p, zero_a[row_a]), np.where(q, q, zero_b[row_b])
                np.add.at(there, (row_a, row_b), price(p, q))
                if pair[1] != pair[2]:
                    np.add.at(back, (row_a, row_b), price(q, p))
                np.add.at(n, (row_a, row_b), 1)
    yield from out()


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """`lang, source, part, item, value, rank`: how far every source is from the others of its language, and its terms.

    Null language, source and text count as empty; a group without terms is compared all the same; repeated rows count
    as documents of their own; equal values follow the item's bytes; other columns are ignored; an empty table
    gives no row. `value` of a pair is the sum of all terms, whole and exact.
    """
    spark = docs.sparkSession
    prepare(spark)
    group = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*group, "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = (
        counted.repartition("lang", "term").groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    term = Window.partitionBy("lang", "term")
    kept = written(spark, (
        counts.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
        .withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
        .where(F.col("lang_docs") >= least_docs).select("lang", "term", "source", "n", "lang_n", "first")
    ), "terms")

    # One row a group: its number, its total, and what holds for the whole language.
    totals = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("n"), F.count("*").alias("cells"), F.count_if("first").alias("own_terms"))
    lang = Window.partitionBy("lang")
    groups = written(spark, (
        docs.select(*group).distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["n", "cells", "own_terms"])
        .withColumns({
            "row": F.row_number().over(lang.orderBy("source")) - 1, "terms": F.sum("own_terms").over(lang),
            "lang_total": F.sum("n").over(lang), "sources": F.count("*").over(lang),
            "slabs": F.ceil(F.sum("cells").over(lang) / SLAB_CELLS).cast("long"),
        })
        .withColumn("zero", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("n"), F.col("terms"))).otherwise(F.lit(1)))
    ), "groups")
    side = 1 << ROWS_BITS

    facts = groups.select("lang", "source", "row", "sources", "terms", "lang_total", "slabs", F.col("n").alias("total"))
    cells = kept.join(facts, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        cells.withColumn("q", q).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                divergence(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)
    )

    slab = F.pmod(F.xxhash64("term"), F.col("slabs")).alias("slab")
    planted = written(spark, (
        cells.select("lang", slab, "term", "row", "p", F.ceil(F.col("sources") / side).cast("long").alias("tiles"))
        .repartition("lang", "slab").sortWithinPartitions("lang", "slab", "term")
        .mapInArrow(_plant, "lang string, slab long, tile long, width long, bits array<binary>, lengths array<long>, p binary")
    ), "forests")
    # The price of a zero, in the order of the tile's rows.
    zeros = groups.groupBy("lang", F.floor(F.col("row") / side).cast("long").alias("tile")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row", "zero"))), lambda x: x["zero"]).alias("zeros"))
    forests = planted.join(zeros, ["lang", "tile"])
    others = forests.select("lang", "slab", *(F.col(c).alias(f"{c}_b") for c in ("tile", "bits", "lengths", "p", "zeros")))
    sums = (
        forests.join(others, ["lang", "slab"]).where(F.col("tile") <= F.col("tile_b"))
        .mapInArrow(_price, "lang string, row long, other long, value long, n long")
        .groupBy("lang", "row", "other").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    )
    # All pairs of sources are the result; the terms both lack are priced here, at once.
    one = groups.select("lang", "source", F.col("row").cast("long").alias("row"), "zero", "terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("row").cast("long").alias("other"), F.col("zero").alias("q"))
    pairs = (
        one.join(two, "lang").where("row <> other").join(sums, ["lang", "row", "other"], "left")
        .withColumn("rest", F.col("terms") - F.coalesce("n", F.lit(0)))
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                (F.coalesce("value", F.lit(0)) + F.col("rest") * divergence(F.col("zero"), F.col("q"))).alias("value"))
        .withColumn("rank", F.row_number().over(best))
    )
    return pairs.unionByName(terms)
