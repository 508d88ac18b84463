"""URL filter: a trie over reversed host labels and path segments, longest match between allow and block entries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import prepare, tables

MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, a path prefix that starts with a slash, and the verdict for both."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Trie:
    """Host labels from the last to the first, then the path's segments; a prefix may end inside a segment.

    A node holds its children by label or whole segment, and the rules that end in it, each with what the rest of
    the path must start with. The deepest host wins, then the longest path.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {"next": {}, "path": None}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.lower().split(".")):
                node = node["next"].setdefault(label, {"next": {}, "path": None})
            node["path"] = node["path"] or _path_node()
            at = node["path"]
            *whole, last = rule.path.split("/")
            for segment in whole:
                at = at["next"].setdefault(segment, _path_node())
            if any(tail == last and known.verdict != rule.verdict for tail, known in at["ends"]):
                raise ValueError(f"{rule.name} is both allowed and blocked")
            at["ends"].append((last, rule))
            at["ends"].sort(key=lambda e: -len(e[0]))

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits, or none."""
        node, found, segments = self.root, None, None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["path"] is not None:
                segments = path.split("/") if segments is None else segments
                found = _longest(node["path"], segments) or found
        return found


def _path_node() -> dict:
    return {"next": {}, "ends": []}


def _longest(node: dict, segments: list[str]) -> Rule | None:
    found = None
    for i, segment in enumerate(segments):
        found = next((rule for tail, rule in node["ends"] if segment.startswith(tail)), found)
        node = node["next"].get(segment) if i + 1 < len(segments) else None
        if node is None:
            break
    return found


def split_url(column) -> tuple:
    """Host and path columns: after the first `://`; A-Z of the host lower-cased. Null or no `://`: both empty."""
    rest = F.when(F.instr(column, "://") > 0, F.expr(f"substr({column}, instr({column}, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """`page_id, host, path, rule, verdict` of every row; `rule` is null and the verdict `default` where none fits.

    Null ids and urls, repeated rows and empty tables pass through row by row; other columns are ignored. The rules
    travel with the tasks: at most `MAX_RULES`, else an error.
    """
    prepare(pages.sparkSession)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to every task")
    trie = Trie(rules)
    host, path = split_url("url")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            found = list(map(trie.find, batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            names = pa.array([r.name if r else None for r in found], pa.string())
            verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.record_batch([*batch.columns, names, verdicts], names=[*batch.schema.names, "rule", "verdict"])

    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
