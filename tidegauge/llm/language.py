"""Language identification by nearest centroids of hashed character n-grams.

A text is the TF-IDF vector of its letters' 1- to 3-grams, hashed to a fixed number of dimensions and normalised.
Every language has several centroids (spherical k-means of its labelled texts), the nearest one by cosine decides,
and a text farther from it than its training texts ever were is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidegauge.llm.common import prepare, tables

DIMENSIONS = 4096
PER_LANGUAGE = 500  # labelled texts a language is learnt from: the bound of the sample
MAX_LANGUAGES = 500
CENTROIDS = 4
FULL = 300  # n-grams of a text from which on a centroid's own bar holds; it falls in proportion below
UNDEFINED = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """1 for every code point that is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams over the whole text, words set apart by one space; null without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    c = np.concatenate(([np.uint64(32)], codes[keep], [np.uint64(32)]))
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - DIMENSIONS.bit_length() + 1)
    counts = np.bincount(((c * mix) >> shift).astype(np.int64), minlength=DIMENSIONS)
    for n in (2, 3):
        if len(c) >= n:
            h = c[:len(c) - n + 1].copy()
            for i in range(1, n):
                h = h * np.uint64(1_000_003) + c[i:len(c) - n + 1 + i]
            counts += np.bincount(((h * mix) >> shift).astype(np.int64), minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid
    language_of: np.ndarray
    least: np.ndarray  # cosine below which a centroid rejects

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts, dtype=np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine of the nearest centroid and whether it rejects, per text."""
        names, scores, rejected = [UNDEFINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.languages:
            return names, scores, rejected
        for low in range(0, len(texts), 256):
            found = [(i, g) for i, t in enumerate(texts[low:low + 256], low)
                     if t and (g := grams(t)) is not None]
            if not found:
                continue
            cosine = self.vectors(np.stack([g for _, g in found]).astype(np.float32)) @ self.centroids.T
            near = cosine.argmax(axis=1)
            for (i, g), n, row in zip(found, near, cosine):
                size = int(g.sum())
                names[i] = self.languages[self.language_of[n]]
                scores[i] = float(min(1.0, max(0.0, row[n])))
                rejected[i] = bool(row[n] < self.least[n] * min(1.0, size / FULL))
        return names, scores, rejected


def _clusters(vectors: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts are far from each other, ties go to the first row, so that it is repeatable."""
    starts = [0]
    while len(starts) < min(k, len(vectors)):
        nearest = (vectors @ vectors[starts].T).max(axis=1)
        starts.append(int(nearest.argmin()))
    centre = vectors[starts]
    for _ in range(rounds):
        near = (vectors @ centre.T).argmax(axis=1)
        sums = np.stack([vectors[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learns from `text` and `lang` of a sample of about `per_language` texts per language, drawn by a text hash.

    Rows without a language or a letter teach nothing. Counting languages covers all rows; the sample is what the
    driver gets, as n-gram counts.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    empty = np.zeros((0, DIMENSIONS), np.float32)
    model = Model([], np.ones(DIMENSIONS, np.float32), empty, np.zeros(0, int), np.zeros(0))
    if not sizes:
        return model
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            found = [(lang, np.minimum(g, 65535).astype("<u2").tobytes())
                     for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
                     if (g := grams(text)) is not None]
            yield pa.record_batch({"lang": pa.array([x for x, _ in found], pa.string()),
                                   "grams": pa.array([x for _, x in found], pa.binary())})

    got = sorted((r["lang"], bytes(r["grams"])) for r in sample.mapInArrow(count, "lang string, grams binary").collect())
    if not got:
        return model
    counts = np.stack([np.frombuffer(g, "<u2") for _, g in got]).astype(np.float32)
    model.languages = sorted({lang for lang, _ in got})
    model.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    vectors, labels = model.vectors(counts), np.array([lang for lang, _ in got])
    centre, language_of, least = [], [], []
    for k, lang in enumerate(model.languages):
        own = vectors[labels == lang]
        c = _clusters(own, centroids)
        near = own @ c.T
        centre.append(c)
        language_of += [k] * len(c)
        # Half the cosine of the farthest training text: only texts unlike anything learnt are rejected.
        least += [0.5 * float(near.max(axis=1).min())] * len(c)
    model.centroids = np.concatenate(centre).astype(np.float32)
    model.language_of, model.least = np.array(language_of), np.array(least)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with `lang_pred, score, lang_rejected`; only `text` is looked at.

    A null text or one without a letter is `und` with score 0 and rejected; equal cosines go to the first language
    in alphabetical order. Columns of these names are replaced.
    """
    prepare(docs.sparkSession)
    names = ["lang_pred", "score", "lang_rejected"]
    kept = docs.drop(*names)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            lang, score, rejected = model.predict(batch.column("text").to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                   pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *names])

    schema = StructType(kept.schema.fields + [
        StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("lang_rejected", BooleanType())])
    return kept.mapInArrow(label, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns kept, whose text the model does not reject."""
    prepare(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            rejected = model.predict(batch.column("text").to_pylist())[2]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no language is learnt from: crc32 of the id as text leaves remainder 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score, lang_rejected` of every row, learnt from the rows not held out."""
    prepare(docs.sparkSession)
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
