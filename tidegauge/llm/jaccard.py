"""Similarity join of documents by the Jaccard coefficient of word shingles: a grouped prefix join.

1. Equal sets are one class. A set is ordered by how common its shingles are, rare ones first; the frequencies come
   from a counting pass over all documents into a table of fixed size, and any order is exact.
2. Two sets that link share a shingle within the first `n - ceil(t n) + 1` of each. Classes with equal prefixes and
   equal size are one group, and only groups are indexed: group pairs come from the lists of their prefix shingles
   and must pass the size and position filters.
3. Groups are expanded and their members verified on whole sets. In a list and in a group everything is first
   compared with a leader, which is linear in their size; links found so far make components. Then every member is
   compared with those of other components whose sketches are nearest to its own, which joins nearly all of a group of
   near copies, and at last every remaining pair of a list or group whose members lie in different components is
   verified. A pair inside one component needs no verification, as its link would change nothing, nor does one whose
   sketches differ in more bits than linked sets have different shingles; so no link between components is lost and a
   group of copies of any size never becomes all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.common import among, prepare, tables, unused, utf8, written
from tidegauge.llm.components import components
from tidegauge.llm.shingles import shingle_set

BUCKETS = 1 << 20  # of the frequency table, whatever the size of the corpus
STRIP = 1 << 12  # buckets that travel as one row
SKETCH = 8  # longs of a set's sketch: one bit per bucket of shingles, set if it has an odd number of them
LEADERS = 4  # of a list, and orders in which they are taken
NEAREST = 3  # members of other components each one is compared with before the rest
NEAR_ROWS = 4096  # of a list among which the nearest are looked for


@dataclass(frozen=True)
class Similarity:
    """Words of a shingle, and the coefficient from which on documents link, in percent."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= self.percent * (len(x) + len(y) - both)


def _frequencies(docs: DataFrame, rule: Similarity) -> np.ndarray:
    """Documents per bucket of shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in tables(batches):
            sets = [shingle_set(t, rule.words) for t in utf8(batch.column("text"))]
            total += np.bincount((np.concatenate(sets) % BUCKETS).astype(np.int64), minlength=BUCKETS)
        strips = [(i, strip.tobytes()) for i, strip in enumerate(total.reshape(-1, STRIP)) if strip.any()]
        yield pa.record_batch({"strip": pa.array([i for i, _ in strips], pa.int32()),
                               "counts": pa.array([c for _, c in strips], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in tables(batches):
            for i, counts in zip(batch.column("strip").to_pylist(), batch.column("counts").to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(counts, np.int64)
        yield pa.record_batch({"strip": pa.array(total.keys(), pa.int32()),
                               "counts": pa.array([c.tobytes() for c in total.values()], pa.binary())})

    strips = docs.select("text").mapInArrow(count, "strip int, counts binary").repartition("strip")
    out = np.zeros((BUCKETS // STRIP, STRIP), np.int64)
    for row in strips.mapInArrow(add, "strip int, counts binary").collect():  # the table, BUCKETS numbers
        out[row["strip"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


SIGNED = "doc_id long, text_key long, n int, class binary, grp long, prefix array<long>, sketch array<long>"


def _sign(docs: DataFrame, rule: Similarity) -> DataFrame:
    """Per row: size and digest of its set, its group, and its prefix; no class without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, rule))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in tables(batches):
            n, classes, groups, prefixes, sketches = [], [], [], [], []
            for text in utf8(batch.column("text")):
                own = shingle_set(text, rule.words)
                n.append(len(own))
                if not len(own):
                    classes.append(None)
                    groups.append(None)
                    prefixes.append(None)
                    sketches.append(None)
                    continue
                order = np.lexsort((own, common[(own % BUCKETS).astype(np.int64)]))
                prefix = own[order[:rule.prefix(len(own))]]
                classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                # Should two groups ever share a number, they are compared as one: nothing is lost.
                groups.append(xxhash.xxh3_64_intdigest(prefix.tobytes(), len(own)) - (1 << 63))
                prefixes.append(prefix.view(np.int64))
                odd = np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int32()), pa.array(classes, pa.binary()),
                 pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=[f.split()[0] for f in SIGNED.split(", ")])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return written(docs.sparkSession, rows.mapInArrow(sign, SIGNED), "signed")


SPREAD = "token long, n int, grp long, pos int"
LISTED = "token long, n int, grp long, pos int, leader long"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per prefix shingle of every group; a group that is met again in the batch is left out."""
    for batch in tables(batches):
        groups, first = np.unique(batch.column("grp").to_numpy(), return_index=True)
        part = batch.take(pa.array(first))
        prefix = part.column("prefix")
        size = np.diff(prefix.offsets.to_numpy())
        ends = np.cumsum(size)
        yield pa.record_batch([
            prefix.flatten(), pa.array(np.repeat(part.column("n").to_numpy(), size)), pa.array(np.repeat(groups, size)),
            pa.array((np.arange(size.sum()) - np.repeat(ends - size, size)).astype(np.int32)),
        ], names=[f.split()[0] for f in SPREAD.split(", ")])


def _lists(rows: DataFrame, rule: Similarity) -> DataFrame:
    """Rows `(token, n, grp, pos)` of every token that several groups have, each with its leader.

    Rows of a token come in an order that depends on the group alone and on the token's last bits, so a task holds
    few leaders, and a group of near copies meets the same few ones in all its lists. A row's leader is the first with
    which the sizes and the places of the token leave room for enough shared shingles; a row without any becomes one.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaders, first, last = None, [], None, None
        for batch in tables(batches):
            token = batch.column("token").to_numpy()
            same = token[1:] == token[:-1]
            near = np.ones(len(token), bool)
            near[1:-1] = same[1:] | same[:-1]
            part = batch.filter(pa.array(near))
            out = []
            for t, n, g, p in zip(*(c.to_pylist() for c in part.columns)):
                if t != current:
                    current, leaders, first, last = t, [(g, n, p)], (t, n, g, p, None), g
                    continue
                if g == last:
                    continue
                if first is not None:
                    out.append(first)
                    first = None
                leader = next((x for x, m, q in leaders if 100 * min(n, m) >= rule.percent * max(n, m)
                               and (100 + rule.percent) * min(n - p, m - q) >= rule.percent * (n + m)), None)
                if leader is None and len(leaders) < LEADERS:
                    leaders.append((g, n, p))
                out.append((t, n, g, p, leader))
                last = g
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                      names=[f.split()[0] for f in LISTED.split(", ")])

    order = F.xxhash64("grp", F.pmod("token", F.lit(LEADERS)))
    ordered = rows.repartition("token").sortWithinPartitions("token", order, "grp")
    return written(rows.sparkSession, ordered.select("token", "n", "grp", "pos").mapInArrow(lead, LISTED), "lists")


def _close(x: str, y: str, rule: Similarity) -> F.Column:
    """Whether two sketches allow a link: a bit in which they differ is a shingle that only one of the sets has."""
    bits = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH)]
    return (100 + rule.percent) * sum(bits[1:], bits[0]) <= (100 - rule.percent) * (F.col("x_n") + F.col("y_n"))


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """`class, text` of the wanted classes, from one document of each."""
    keys = written(docs.sparkSession, wanted.join(classes, "class").select("class", "key_id", "text_key"), "keys")
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key_id"), F.xxhash64("text").alias("text_key"), "text")
    # Rows equal in id and text hash stand for the same class once.
    rows = among(rows, keys, "text_key").dropDuplicates(["key_id", "text_key"])
    return written(docs.sparkSession, rows.join(keys, ["key_id", "text_key"]).select("class", "text"), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs `(a, b)` whose sets link, by their whole texts."""
    either = pairs.select(F.col("a").alias("class")).distinct().union(pairs.select("b").distinct()).distinct()
    texts = _texts(docs, classes, either)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in tables(batches):
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), utf8(batch.column("text_a")), utf8(batch.column("text_b"))):
                if a != last:
                    last, own = a, shingle_set(x, rule.words)
                keep.append(rule.linked(own, shingle_set(y, rule.words)))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return written(docs.sparkSession, both.mapInArrow(verify, "a binary, b binary"), "verified")


def _listed(members: DataFrame, lists: DataFrame, root: DataFrame) -> DataFrame:
    """Rows of all lists and groups, `(list, own, pos, class, n, sketch, root)`, with the component of every class."""
    of = members.join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    # A group is one list more: equal prefixes share every position, so only the component tells its pairs apart.
    inside = of.select(F.col("grp").alias("list"), F.lit(True).alias("own"), F.lit(0).alias("pos"), "class", "n", "sketch", "root")
    return lists.select(F.col("token").alias("list"), F.lit(False).alias("own"), "pos", "grp").join(of, "grp").select(
        "list", "own", "pos", "class", "n", "sketch", "root").unionByName(inside)


NEAR = "a binary, b binary, list long, own boolean"


def _nearest(rows: DataFrame, rule: Similarity) -> DataFrame:
    """Up to NEAREST pairs `(a, b)` of every row of a list: with the members of other components that may link with it and
    whose sketches differ least from its own, told once a task; and the lists `(list, own)` that hold more such pairs.

    A list of more than NEAR_ROWS rows is looked at in parts and counts as holding more.
    """

    def pairs(t: pa.Table, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows i < j of all pairs in the lists that end at `ends` which may link, and how far their sketches are."""
        names, where = np.unique(np.array(t.column("root").to_pylist(), dtype="S16"), return_inverse=True)
        n, pos = t.column("n").to_numpy().astype(np.int64), t.column("pos").to_numpy().astype(np.int64)
        sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
        end = np.repeat(ends, np.diff(ends, prepend=0))
        found, i, step = [], np.arange(len(n)), 1
        while True:
            i = i[i + step < end[i]]
            if not len(i):
                break
            j = i + step
            both = n[i] + n[j]
            ok = (where[i] != where[j]) & (100 * np.minimum(n[i], n[j]) >= rule.percent * np.maximum(n[i], n[j]))
            ok &= (100 + rule.percent) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= rule.percent * both
            x, y, total = i[ok], j[ok], both[ok]
            differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
            ok = (100 + rule.percent) * differ <= (100 - rule.percent) * total
            found.append((x[ok], y[ok], differ[ok] / total[ok]))
            step += 1
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(c) for c in zip(*found))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[bytes, bytes]] = set()
        held: list[pa.RecordBatch] = []  # whole lists, or parts of one
        ends: list[int] = []
        keys: list[tuple[int, bool]] = []
        cut: set[tuple[int, bool]] = set()

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            x, y, far = pairs(t, np.array(ends))
            row, order = np.concatenate([x, y]), np.concatenate([far, far])
            at = np.lexsort((order, row))
            row = row[at]
            first = np.searchsorted(row, row)
            chosen = np.zeros(len(x), bool)
            chosen[(at % max(len(x), 1))[np.arange(len(at)) - first < NEAREST]] = True
            classes = t.column("class").to_pylist()
            new = {tuple(sorted((classes[i], classes[j]))) for i, j in zip(x[chosen], y[chosen])} - told
            if len(told) > 200_000:
                told.clear()
            told.update(new)
            more = {keys[k] for k in np.unique(np.searchsorted(ends, x[~chosen], "right"))} | cut
            cut.clear()
            if new or more:
                none, nothing = [None] * len(more), [None] * len(new)
                yield pa.record_batch([
                    pa.array([a for a, _ in new] + none, pa.binary()), pa.array([b for _, b in new] + none, pa.binary()),
                    pa.array(nothing + [k for k, _ in more], pa.int64()), pa.array(nothing + [o for _, o in more], pa.bool_()),
                ], names=[f.split()[0] for f in NEAR.split(", ")])

        size, current, own_size = 0, None, 0
        for batch in tables(batches):
            lists, own = batch.column("list").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
            low = 0
            for high in [*(np.flatnonzero((lists[1:] != lists[:-1]) | (own[1:] != own[:-1])) + 1).tolist(), len(lists)]:
                key = (int(lists[low]), bool(own[low]))
                while low < high:
                    if key != current or own_size >= NEAR_ROWS:
                        if key == current:
                            cut.add(key)
                        if size >= 8 * NEAR_ROWS:
                            yield from done()
                            held, ends, keys, size = [], [], [], 0
                        current, own_size = key, 0
                        ends.append(size)
                        keys.append(key)
                    take = min(high - low, NEAR_ROWS - own_size)
                    held.append(batch.slice(low, take))
                    size, own_size, low = size + take, own_size + take, low + take
                    ends[-1] = size
        if held:
            yield from done()

    ordered = rows.repartition("list", "own").sortWithinPartitions("list", "own", "n", "class")
    return ordered.mapInArrow(near, NEAR)


def _rest(rows: DataFrame, tried: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs of a list or a group whose classes lie in different components and that were not tried yet."""
    x = rows.select("list", "own", *(F.col(c).alias(f"x_{c}") for c in ("pos", "class", "n", "sketch", "root")))
    y = rows.select("list", "own", *(F.col(c).alias(f"y_{c}") for c in ("pos", "class", "n", "sketch", "root")))
    # At most this many shingles are shared if the one at hand is the first in common.
    most = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    pairs = x.join(y, ["list", "own"]).where(
        (F.col("x_class") < F.col("y_class")) & (F.col("x_root") != F.col("y_root"))
        & (100 * F.least("x_n", "y_n") >= rule.percent * F.greatest("x_n", "y_n"))
        & ((100 + rule.percent) * most >= rule.percent * (F.col("x_n") + F.col("y_n")))
        & _close("x_sketch", "y_sketch", rule)
    )
    return pairs.select(F.col("x_class").alias("a"), F.col("y_class").alias("b")).distinct().join(
        tried, ["a", "b"], "left_anti")


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """`class, root` after more links: only the roots they lie between are joined anew."""
    if not links.take(1):
        return root
    a, b = (root.select(F.col("class").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = root.join(above, "root", "left").select("class", F.coalesce("top", "root").alias("root"))
    new = above.join(root.select(F.col("class").alias("root")), "root", "left_anti")
    return written(root.sparkSession, moved.union(new.select(F.col("root").alias("class"), F.col("top").alias("root"))), "roots")


def link(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """`doc_id, text_key, n_shingles, component_id` per row of `docs`; `text_key` is the hash of its text.

    Null texts and texts without a word have no shingle, link with nothing and are their own component. Rows that
    share an id are judged by their own texts; rows equal in text are one class. A null id never names a component:
    one made of such rows alone has none. Other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    signed = _sign(docs, rule)
    some = signed.where(F.col("class").isNotNull())
    classes = written(spark, some.groupBy("class").agg(
        F.min("doc_id").alias("least_id"), F.min("n").alias("n"), F.min("grp").alias("grp"),
        F.min("sketch").alias("sketch"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key_id"), "text_key")).alias("key"),
    ).select("class", "least_id", "n", "grp", "sketch", "key.*"), "classes")

    lists = _lists(some.select("n", "grp", "prefix").mapInArrow(_spread, SPREAD), rule)

    # A group's own leader is its smallest class.
    heads = classes.groupBy("grp").agg(F.min("class").alias("head"))
    members = classes.select("class", "grp", "n").join(heads, "grp")
    in_group = members.where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    of_lists = (
        lists.where("leader IS NOT NULL").select("leader", "grp").distinct()
        .join(heads.select(F.col("grp").alias("leader"), F.col("head").alias("a")), "leader")
        .join(heads.select("grp", F.col("head").alias("b")), "grp").select("a", "b")
    )
    stars = in_group.union(of_lists).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = (classes.select(F.col("class").alias(c), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch"))
            for c, p in (("a", "x"), ("b", "y")))
    stars = written(spark, stars.join(x, "a").join(y, "b").where(_close("x_sketch", "y_sketch", rule)).select("a", "b"),
                    "stars")
    root = components(_verified(stars, docs, classes, rule)).select(F.col("node").alias("class"), "root")
    members = classes.select("class", "grp", "n", "sketch")
    found = written(spark, _nearest(_listed(members, lists, root), rule), "nearest")
    near = written(spark, found.where("a IS NOT NULL").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"), "near")
    root = _joined(root, _verified(near, docs, classes, rule))
    # Only lists that hold more pairs than those are gone through once more, with the components as they are now.
    more = found.where("list IS NOT NULL").select("list", "own").distinct()
    rest = written(spark, _rest(_listed(members, lists, root).join(more, ["list", "own"], "left_semi"), stars.union(near), rule),
                   "rest")
    if rest.take(1):
        root = _joined(root, _verified(rest, docs, classes, rule))

    named = classes.join(root, "class", "left").select("class", "least_id", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "root").select("class", "component_id")
    linked = signed.join(of_class, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """The rows of `docs`, all columns kept, of which one of each component of linked documents stays.

    The one with the smallest id stays; of rows that share it, the one with the smallest text hash, and of rows equal
    in both any one. Rows without an id stay only where no row of the component has one. Rows without a word all stay.
    """
    found = link(docs, rule).where("n_shingles > 0")
    # One row per component with its text hash; equal rows collapse.
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    comp = F.coalesce(F.col("component_id"), F.col("text_key"))
    best = found.groupBy(comp.alias("g"), F.col("component_id").isNull().alias("nameless")).agg(
        F.min(F.struct(key.alias("k"), "text_key")).alias("one")).select("one.*")
    id_, hash_, wordless, turn, best_id, best_hash = unused(docs, "id", "hash", "wordless", "turn", "best_id", "best_hash")
    kept = best.select(F.col("k").alias(best_id), F.col("text_key").alias(best_hash)).distinct()
    no_word = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = docs.withColumns({id_: key, hash_: F.xxhash64("text"), wordless: no_word})
    with_words = own.where(~F.col(wordless)).join(
        kept, (F.col(id_) == F.col(best_id)) & (F.col(hash_) == F.col(best_hash)), "left_semi")
    same = Window.partitionBy(id_, hash_).orderBy(hash_)
    once = with_words.withColumn(turn, F.row_number().over(same)).where(F.col(turn) == 1)
    return once.select(*docs.columns).unionByName(own.where(F.col(wordless)).select(*docs.columns))
