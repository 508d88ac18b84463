"""Information-theoretic sanitisation of personal data.

The protected entities are what fixed patterns find: mail addresses, IP addresses, card and phone numbers. A corpus
pass counts, for every term that stands near a mention, in how many documents term and entity occur and occur
together. With document frequencies as probabilities, an entity has the information content `IC = -log2 p(e)` and a
term tells `PMI = log2 p(e, t) / (p(e) p(t))` of it. A term that tells at least `generalise` of the content is
replaced by its word shape, from `remove` on it is taken out. Pairs count only with `support` different contexts, so that copies of one
passage are one witness. Texts without a mention are never changed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import prepare, tables, unused, written

KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: a later start could match nothing an earlier one did not.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
FLUSH = 200_000
NEAR = 2048  # characters on each side of a mention in which its context is looked for


@dataclass(frozen=True)
class Disclosure:
    """Words on each side of a mention, different contexts a pair needs, and the two thresholds."""

    reach: int = 10
    support: int = 3
    generalise: float = 0.7
    remove: float = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the local part is the run before it, up to where the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)  # nothing matches across this @
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """`(kind, start, end)` in code points, end exclusive; per kind leftmost and non-overlapping, failing matches
    dropped. By kind, then start."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _contexts(text: str, spans, reach: int) -> Iterator[tuple[str, str, list[tuple[str, int, int]]]]:
    """Entity, hash of its context and the terms there, for every mention."""
    taken = sorted((s, e) for _, s, e in spans)
    for kind, start, end in spans:
        before = list(TERM.finditer(text, max(0, start - NEAR), start))[-reach:]
        after = list(islice(TERM.finditer(text, end, end + NEAR), reach))
        words = [m for m in before + after if not any(s < m.end() and m.start() < e for s, e in taken)]
        context = hashlib.blake2b("\0".join(m[0].lower() for m in words).encode(), digest_size=8).hexdigest()
        yield f"{kind}:{text[start:end].lower()}", context, [(m[0].lower(), m.start(), m.end()) for m in words]


FOUND = ("doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
         "mentions array<struct<entity:string,context:string,"
         "terms:array<struct<term:string,start:int,end:int>>>>")
ARROW_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()),
    ("base_sha256", pa.string()),
    ("mentions", pa.list_(pa.struct([("entity", pa.string()), ("context", pa.string()), ("terms", pa.list_(pa.struct(
        [("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]))),
])


def _find(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    for batch in tables(batches):
        rows = []
        for doc_id, row, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row", "text"))):
            text = text or ""
            spans = base_spans(text)
            base, counts = listed(spans), Counter(k for k, _, _ in spans)
            mentions = [{"entity": e, "context": c, "terms": [dict(zip(("term", "start", "end"), t)) for t in terms]}
                        for e, c, terms in _contexts(text, spans, reach)] if spans else []
            rows.append((doc_id, row, *(counts[k] for k in KINDS), base, hashlib.sha256(base.encode()).hexdigest(),
                         mentions))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW_FOUND)], schema=ARROW_FOUND)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, added up within the task as far as memory is bounded."""
    seen: Counter = Counter()

    def flush():
        out = pa.record_batch({"term": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
        seen.clear()
        return out

    for batch in tables(batches):
        for text in batch.column("text").to_pylist():
            if text:
                seen.update({w.lower() for w in set(TERM.findall(text))})
            if len(seen) > FLUSH:
                yield flush()
    if seen:
        yield flush()


def row_key() -> F.Column:
    """Tells rows with different id or text apart; equal rows share it."""
    return F.xxhash64("doc_id", "text")


def find(docs: DataFrame, reach: int) -> DataFrame:
    """One row per document: base spans, counts, digest, and its mentions with their contexts."""
    parts = docs.select("doc_id", row_key().alias("row"), "text")
    return written(docs.sparkSession, parts.mapInArrow(lambda it: _find(it, reach), FOUND), "pii")


def disclosing(docs: DataFrame, found: DataFrame, rule: Disclosure) -> DataFrame:
    """`entity, term, told`: the share of the entity's information that the term tells, from `generalise` on."""
    mention = found.select("doc_id", "row", F.explode("mentions").alias("m")).select("doc_id", "row", "m.*")
    near = mention.select("entity", "context", "doc_id", "row", F.explode("terms.term").alias("term"))
    pairs = (
        near.groupBy("entity", "term", "context", "doc_id", "row").agg(F.count("*").alias("k"))
        .groupBy("entity", "term", "context").agg(F.count("*").alias("docs"))
        .groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("docs").alias("both"))
        .where(F.col("contexts") >= rule.support)
    )
    pairs = written(docs.sparkSession, pairs, "pii-pairs")
    entity = (
        mention.select("entity", "doc_id", "row").groupBy("entity", "doc_id", "row").agg(F.count("*").alias("k"))
        .groupBy("entity").agg(F.count("*").alias("df_entity"))
    )
    wanted = pairs.select("term").distinct()
    term = (
        docs.select("text").mapInArrow(_term_counts, "term string, n long")
        .groupBy("term").agg(F.sum("n").alias("df_term")).join(wanted, "term", "left_semi")
    )
    total = docs.count()
    both = F.least("both", "df_entity", "df_term")
    told = F.log2(total * both / (F.col("df_entity") * F.col("df_term"))) / F.log2(total / F.col("df_entity"))
    return (
        pairs.join(entity, "entity").join(term, "term")
        .where((F.col("df_entity") < total) & (told >= rule.generalise))
        .select("entity", "term", told.alias("told"))
    )


def term_spans(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document with any: `terms`, the spans of terms that disclose an entity near by, in order of place."""
    near = found.select("doc_id", "row", F.explode("mentions").alias("m")).select(
        "doc_id", "row", "m.entity", F.explode("m.terms").alias("t"))
    hits = near.select("doc_id", "row", "entity", "t.*").join(pairs, ["entity", "term"])
    once = hits.groupBy("doc_id", "row", "start", "end").agg(F.max("told").alias("told"))
    # One row per document, as long as its text allows.
    return once.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "told"))).alias("terms"))


def spans(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """`doc_id`, counts and digest of the base spans, `spans` (base spans, then terms), `n_term`, per row of `docs`.

    Null texts are empty; null ids and repeated rows are judged like any other; other columns are ignored; an empty
    table gives no row.
    """
    prepare(docs.sparkSession)
    found = find(docs, rule.reach)
    terms = term_spans(found, disclosing(docs, found, rule)).select(
        F.col("row").alias("__row"), F.col("doc_id").alias("__id"), "terms")
    texts = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    all_spans = F.array_join(F.concat(F.when(F.col("base") != "", F.array("base")).otherwise(
        F.array().cast("array<string>")), F.coalesce(texts, F.array().cast("array<string>"))), ",")
    return (
        found.join(terms, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
        .select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", all_spans.alias("spans"),
                F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))
    )


def _shape(word: str) -> str:
    """A word's class: what it tells is that a word stood there, and whether it began with a capital."""
    return "Xxx" if word[:1].isupper() else "xxx"


def _rewrite(text: str, terms, rule: Disclosure) -> str:
    """The text with base spans as their kind in brackets, and disclosing terms generalised or removed."""
    changes = [(s, e, f"[{kind}]") for kind, s, e in base_spans(text)]
    for t in terms or []:
        changes.append((t["start"], t["end"], "" if t["told"] >= rule.remove else _shape(text[t["start"]:])))
    out, done = [], 0
    for s, e, new in sorted(changes, key=lambda c: (c[0], -c[1])):
        if s >= done:
            out += [text[done:s], new]
        done = max(done, e)
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The rows of `docs`, all columns kept, with personal data and disclosing terms taken out of `text`.

    Null texts stay null. Where spans overlap, the first and longest decides.
    """
    prepare(docs.sparkSession)
    found = find(docs, rule.reach)
    row, id_, own = unused(docs, "row", "id", "terms")
    terms = term_spans(found, disclosing(docs, found, rule)).select(
        F.col("row").alias(row), F.col("doc_id").alias(id_), F.col("terms").alias(own))
    both = docs.join(terms, (row_key() == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            texts = zip(batch.column("text").to_pylist(), batch.column(own).to_pylist())
            new = pa.array([None if t is None else _rewrite(t, terms, rule) for t, terms in texts], pa.string())
            keep = [n for n in batch.schema.names if n != own]
            yield pa.record_batch([new if n == "text" else batch.column(n) for n in keep], names=keep)

    return both.select(*docs.columns, own).mapInArrow(rewrite, docs.schema)
