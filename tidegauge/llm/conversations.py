"""Repair of conversations: the cheapest edits that make the roles read system?, then user and assistant in turn.

A row moves the conversation between four states (nothing yet, after the system turn, after a user, after an
assistant), at a cost that depends on the row alone. Hirschberg's divide and conquer finds the edits in linear space:
the costs forward from the first row and backward from the last one meet in the middle, the crossing state is the one
of least total cost, and among these the one whose edits read ASCII-least; then both halves follow in the same way.

Order among equal costs needs no strings. Insertions belong to the row that follows them, so the edits up to a row
hold one other letter per row and end with one: of two different ways up to the same row neither begins with the
other. A front therefore lists its states in the order of their edits, and extending it keeps that order.

What a run of rows does to the four states is a small table of the same form as one row's, so long conversations are
cut into chunks, spread over tasks, summed up level by level, and crossed from the top down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.llm.common import prepare, tables, written

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
CHUNK_ROWS = 512
CHUNK_CHARS = 1 << 20
FAN = 1024  # chunks or parts summed up in one group

Step = tuple[tuple[tuple[int, int], ...], ...]  # per state before: (state after, cost) in the order of the edits


def _next(state: int) -> int:
    """State after the turn that may follow: an assistant after a user, else a user."""
    return ASSISTANT if state == USER else USER


def _edits(initial: str, doomed: bool, truncated: bool) -> list[dict[int, tuple[int, str]]]:
    """Per state before a row, the cheapest and then ASCII-least edits up to every state after it."""
    extra, out = TRUNCATED if truncated else 0, []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}
        state = before
        for inserts in range(3):
            ways = [(state, DELETE, "D")]
            if not doomed:
                ways.append((_next(state), REROLE + extra, "R"))
                if initial == "s" and state == NOTHING:
                    ways.append((SYSTEM, KEEP + extra, "K"))
                if initial == ("a" if state == USER else "u"):
                    ways.append((_next(state), KEEP + extra, "K"))
            for after, cost, letter in ways:
                way = (cost + INSERT * inserts, "I" * inserts + letter)
                best[after] = min(best.get(after, way), way)
            state = _next(state)
        out.append(best)
    return out


# A row's kind: 0 must go; else by the initial of its role and whether its text breaks off.
INITIALS = "sua"
EDITS = [_edits("", True, False)] + [_edits(i, False, t) for i in (*INITIALS, "") for t in (False, True)]
STEPS: list[Step] = [
    tuple(tuple((y, way[0]) for y, way in sorted(row.items(), key=lambda item: item[1][1])) for row in table)
    for table in EDITS
]
FINISH = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # turns to insert after the last row


def kind(role: str, truncated: bool) -> int:
    at = INITIALS.find(role[:1]) if role else -1
    return 1 + 2 * (at if at >= 0 else 3) + truncated


def advance(front: list[tuple[int, int]], step: Step) -> list[tuple[int, int]]:
    """The front (state, cost), in the order of its edits, after one more step."""
    best: dict[int, tuple[int, int]] = {}
    place = 0
    for before, cost in front:
        for after, more in step[before]:
            place += 1
            known = best.get(after)
            if known is None or cost + more < known[0]:
                best[after] = (cost + more, place)
    return [(state, cost) for state, (cost, place) in sorted(best.items(), key=lambda item: item[1][1])]


def forward(steps: list[Step], low: int, high: int, start: int) -> list[tuple[int, int]]:
    front = [(start, 0)]
    for i in range(low, high):
        front = advance(front, steps[i])
    return front


def backward(steps: list[Step], low: int, high: int, end: int) -> dict[int, int]:
    """Cost from every state before `low` to state `end` after `high`."""
    costs = {end: 0}
    for i in range(high - 1, low - 1, -1):
        costs = {
            before: min(more + costs[after] for after, more in row if after in costs)
            for before, row in enumerate(steps[i]) if any(after in costs for after, _ in row)
        }
    return costs


def compose(steps: list[Step]) -> Step:
    return tuple(tuple(forward(steps, 0, len(steps), start)) for start in range(4))


def crossings(steps: list[Step], start: int, end: int) -> list[int]:
    """State after every step, on the cheapest and then ASCII-least way from `start` to `end`."""
    out = [end] * len(steps)

    def split(low: int, high: int, start: int, end: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        behind = backward(steps, middle, high, end)
        state, _ = min(((s, c + behind[s]) for s, c in forward(steps, low, middle, start) if s in behind),
                       key=lambda pair: pair[1])  # the first of equal ones: the front is in order
        out[middle - 1] = state
        split(low, middle, start, state)
        split(middle, high, state, end)

    split(0, len(steps), start, end)
    return out


def goal(front: list[tuple[int, int]]) -> tuple[int, int]:
    """Last state and cost of the whole conversation."""
    return min(((s, c + INSERT * FINISH[s]) for s, c in front), key=lambda pair: pair[1])


def edited(rows: list[tuple[str, str]], kinds: list[int], start: int, end: int, last: bool) -> tuple[str, list[dict]]:
    """Edits and repaired turns of the rows between two states, with the turns missing at the end."""
    state, audit, turns = start, [], []
    after = crossings([STEPS[k] for k in kinds], start, end)
    names = {USER: "user", ASSISTANT: "assistant"}
    for (role, text), k, reached in zip(rows, kinds, after):
        letters = EDITS[k][state][reached][1]
        audit.append(letters)
        for letter in letters:
            if letter == "K":
                turns.append({"role": role, "text": text})
            elif letter != "D":
                turns.append({"role": names[_next(state)], "text": text if letter == "R" else ""})
                state = _next(state)
        state = reached
    if last:
        for _ in range(FINISH[state]):
            audit.append("I")
            turns.append({"role": names[_next(state)], "text": ""})
            state = _next(state)
    return "".join(audit), turns


TURNS = "array<struct<role:string,text:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns_seen", "n")
PIECE = (f"part int, no int, open boolean, {', '.join(f'{c} long' for c in COUNTS)}, low long, high long, "
         f"first_turn long, last_turn long, first_role string, last_role string, cost long, audit string, "
         f"turns {TURNS}, kinds binary, digests array<binary>")
LEGAL = {"su", "ua", "au"}


class _Chunk:
    """Rows of one conversation in order, with what the repair has to know about them."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[int] = []
        self.digests: list[bytes | None] = []
        self.seen: set[bytes] = set()
        self.chars = 0
        self.low = self.high = self.first = self.last = None
        self.count = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str) -> None:
        count, digest = self.count, None
        bare = text.strip(SPACE)
        truncated = bool(bare) and bare[-1] not in ".!?"
        if not bare:
            count["blank"] += 1
            self.kinds.append(0)
        else:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            if digest in self.seen:
                count["duplicate"] += 1
                self.kinds.append(0)
                digest = None
            else:
                self.seen.add(digest)
                count["truncated"] += truncated
                self.kinds.append(kind(role, truncated))
        self.digests.append(digest)
        if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
            count["illegal"] += 1
        if turn is not None:
            if turn != self.high:
                count["turns_seen"] += 1
            if self.low is None:
                self.low = turn
            self.high = turn
        if not self.rows:
            self.first = turn
        self.last = turn
        self.rows.append((role, text))
        self.chars += len(text)
        count["n"] += 1

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.chars >= CHUNK_CHARS

    def row(self, conv, part: int, no: int, whole: bool) -> dict:
        out = {"conv_id": conv, "part": part, "no": no, "open": not whole, **self.count, "low": self.low, "high": self.high,
               "first_turn": self.first, "last_turn": self.last,
               "first_role": self.rows[0][0][:1] if self.rows else None,
               "last_role": self.rows[-1][0][:1] if self.rows else None}
        if whole:
            steps = [STEPS[k] for k in self.kinds]
            end, out["cost"] = goal(forward(steps, 0, len(steps), NOTHING))
            out["audit"], out["turns"] = edited(self.rows, self.kinds, NOTHING, end, True)
        else:
            out["turns"] = [{"role": r, "text": t} for r, t in self.rows]
            out["kinds"] = bytes(self.kinds)
            out["digests"] = self.digests
        return out


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 64, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t["text"]) for t in row.get("turns") or ()) + 100
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(schema: pa.Schema, most: int):
    """Rows in order to chunks; a conversation that lies within one chunk and off the task's ends is repaired at once."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, begun, conv, chunk, no, edge = TaskContext.get().partitionId(), False, None, None, 0, True
        for batch in tables(batches):
            for own, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "text", "copies"))):
                if not begun or own != conv:
                    if begun:
                        yield chunk.row(conv, part, no, whole=not edge and no == 0)
                        edge = False
                    begun, conv, chunk, no = True, own, _Chunk(), 0
                for _ in range(copies):
                    if chunk.full(most):
                        yield chunk.row(conv, part, no, whole=False)
                        chunk, no = _Chunk(), no + 1
                    chunk.add(turn, role, text)
        if begun:
            yield chunk.row(conv, part, no, whole=False)

    return lambda batches: _batched(pieces(batches), schema)


def _steps(value: list[int]) -> Step:
    """Back from the flat list `_flat` makes."""
    at, out = 0, []
    for _ in range(4):
        n = value[at]
        out.append(tuple((value[at + 1 + 2 * i], value[at + 2 + 2 * i]) for i in range(n)))
        at += 1 + 2 * n
    return tuple(out)


def _flat(steps: Step) -> list[int]:
    return [x for row in steps for x in (len(row), *(v for pair in row for v in pair))]


def _judge(schema: pa.Schema):
    """Open chunks, knowing which rows come first in the whole conversation: final kinds, counts and table of states."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in tables(batches):
            for row in batch.to_pylist():
                kinds, first = bytearray(row["kinds"]), set(row.pop("firsts") or ())
                for i, digest in enumerate(row.pop("digests")):
                    if digest is not None and i not in first:
                        row["truncated"] -= (kinds[i] - 1) % 2
                        row["duplicate"] += 1
                        kinds[i] = 0
                row["kinds"] = bytes(kinds)
                row["steps"] = _flat(compose([STEPS[k] for k in kinds]))
                yield row

    return lambda batches: _batched(judge(batches), schema)


def _sum(rows: list[dict]) -> dict:
    """Neighbouring chunks as one."""
    out = {c: sum(r[c] for r in rows) for c in COUNTS}
    held = [r for r in rows if r["n"]]
    for a, b in zip(held, held[1:]):
        out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
        out["turns_seen"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    known = [r for r in held if r["low"] is not None]
    out |= {"low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None}
    for name, at in (("first", 0), ("last", -1)):
        out |= {f"{name}_{c}": held[at][f"{name}_{c}"] if held else None for c in ("turn", "role")}
    return out | {"steps": _flat(compose([_steps(r["steps"]) for r in rows]))}


def _up(schema: pa.Schema):
    def up(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["at"])
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "at": rows[0]["above"], **_sum(rows)}], schema)

    return up


def _down(schema: pa.Schema):
    def down(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["at"])
        start, end, last = (rows[0][c] for c in ("start", "end", "last"))
        ends = crossings([_steps(r["steps"]) for r in rows], start, end)
        out = [{"conv_id": r["conv_id"], "at": r["at"], "start": s, "end": e, "last": last and r is rows[-1]}
               for r, s, e in zip(rows, [start, *ends], ends)]
        return pa.Table.from_pylist(out, schema)

    return down


def _mend(schema: pa.Schema):
    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in tables(batches):
            for r in batch.to_pylist():
                rows = [(t["role"], t["text"]) for t in r["turns"]]
                audit, turns = edited(rows, list(r["kinds"]), r["start"], r["end"], r["last"])
                yield {"conv_id": r["conv_id"], "at": r["at"], "audit": audit, "turns": turns}

    return lambda batches: _batched(mend(batches), schema)


def _arrow(spark, ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)
    return schema, to_arrow_schema(schema)


def _same(a: DataFrame, b: DataFrame, *keys: str) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def repair(conversations: DataFrame, copies: Column | None = None, chunk_rows: int = CHUNK_ROWS,
           fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Repaired pieces `conv_id, at, whole, audit, turns`, and per conversation `conv_id, gaps, blank, duplicate, truncated,
    illegal, cost`.

    `copies` says how often a row stands in its conversation (0: nowhere, but the conversation is known). A short
    conversation is one piece (`whole`); a long one, of over `chunk_rows` rows, has several, in the order of `at`. Null
    role and text are one space, a null conversation id is a conversation of its own, null turns come first. Rows of one turn stand by role, by the first 32
    characters of the text and by a hash of it; repeated rows all count. Other columns are ignored; an empty table
    gives no row.
    """
    spark = conversations.sparkSession
    prepare(spark)
    key = dict(conversations.dtypes)["conv_id"]
    blank = F.lit(" ")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    ).withColumns({"near": F.substring("text", 1, 32), "hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "near", "hash", "salt"]
    piece, arrow = _arrow(spark, f"conv_id {key}, {PIECE}")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = written(spark, ordered.mapInArrow(_cut(arrow, chunk_rows), piece), "turns")

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns_seen"), F.lit(0)).alias("gaps")
    shown = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = cut.where("not open")
    pieces = whole.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(True).alias("whole"), "audit", "turns")
    parts = cut.where("open").agg(F.max("part")).first()[0]
    if parts is None:
        return pieces, whole.select(*shown)

    # Rows seen before, across the chunks of a conversation.
    opened = cut.where("open")
    firsts = (
        opened.select("conv_id", "part", "no", F.posexplode("digests").alias("i", "digest")).where("digest is not null")
        .groupBy("conv_id", "digest").agg(F.min(F.struct("part", "no", "i")).alias("first"))
        .groupBy(F.col("conv_id").alias("f_conv"), F.col("first.part").alias("f_part"), F.col("first.no").alias("f_no"))
        .agg(F.collect_list("first.i").alias("firsts"))  # at most a chunk's rows
    )
    found = F.expr("conv_id <=> f_conv and part = f_part and no = f_no")
    known = opened.join(firsts, found, "left").drop("f_conv", "f_part", "f_no")
    judged, arrow = _arrow(spark, f"conv_id {key}, {PIECE.removesuffix(', digests array<binary>')}, steps array<long>")
    chunks = written(spark, known.mapInArrow(_judge(arrow), judged), "chunks").withColumn(
        "at", F.col("part").cast("long") * (1 << 32) + F.col("no"))

    # Up: chunks of a part as one, then `fan` parts as one, until one is left.
    node = (f"conv_id {key}, at long, {', '.join(f'{c} long' for c in COUNTS)}, low long, high long, first_turn long, "
            "last_turn long, first_role string, last_role string, steps array<long>")
    schema, arrow = _arrow(spark, node)
    levels, size, left = [chunks.select(*schema.names)], 1 << 32, parts + 1
    while True:
        below = levels[-1].withColumn("above", F.floor(F.col("at") / size).cast("long"))
        levels[-1] = below
        up = below.groupBy("conv_id", "above").applyInArrow(_up(arrow), schema)
        levels.append(written(spark, up, "levels"))
        if left == 1:
            break
        size, left = fan, -(-left // fan)

    top, arrow = _arrow(spark, f"conv_id {key}, at long, start int, end int, last boolean, cost long")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            goals = [(r, goal(list(_steps(r["steps"])[NOTHING]))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "at": r["at"], "start": NOTHING, "end": state,
                                               "last": True, "cost": cost} for r, (state, cost) in goals], arrow)

    roots = levels.pop()
    bounds = written(spark, roots.mapInArrow(ends, top), "bounds")
    counted = roots.join(bounds, _same(roots, bounds, "conv_id")).select(roots["*"], bounds["cost"])

    # Down: the states between the members of every group, from the top to the chunks.
    bound, arrow = _arrow(spark, f"conv_id {key}, at long, start int, end int, last boolean")
    for level in reversed(levels):
        inside = level.join(bounds, [level["conv_id"].eqNullSafe(bounds["conv_id"]), level["above"] == bounds["at"]]).select(
            level["conv_id"], level["at"], level["above"], level["steps"], *(bounds[c] for c in ("start", "end", "last")))
        down = inside.groupBy("conv_id", "above").applyInArrow(_down(arrow), bound)
        bounds = written(spark, down, "bounds")
    mended, arrow = _arrow(spark, f"conv_id {key}, at long, audit string, turns {TURNS}")
    ready = chunks.join(bounds, _same(chunks, bounds, "conv_id", "at")).select(
        chunks["conv_id"], chunks["at"], "turns", "kinds", "start", "end", "last")
    return (
        pieces.unionByName(ready.mapInArrow(_mend(arrow), mended).withColumn("whole", F.lit(False))),
        whole.select(*shown).unionByName(counted.select(*shown)),
    )


def digest(pieces: DataFrame) -> DataFrame:
    """`conv_id, audit, repaired_sha256` of every conversation; pieces of one stream through one hash in order."""
    key = dict(pieces.dtypes)["conv_id"]
    schema, arrow = _arrow(pieces.sparkSession, f"conv_id {key}, audit string, repaired_sha256 string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, audit, some, out = None, None, [], False, []

        def close() -> dict:
            return {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        for batch in tables(batches):
            for own, letters, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "turns"))):
                if sha is None or own != conv:
                    if sha is not None:
                        out.append(close())
                    conv, sha, audit, some = own, hashlib.sha256(), [], False
                audit.append(letters)
                for turn in turns:
                    sha.update(("\n" if some else "").encode() + f"{turn['role']}:{turn['text']}".encode())
                    some = True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if sha is not None:
            out.append(close())
        yield pa.RecordBatch.from_pylist(out, arrow)

    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = pieces.where("whole").select("conv_id", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    rest = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return whole.unionByName(rest.mapInArrow(stream, schema))


def report(conversations: DataFrame, copies: Column | None = None, chunk_rows: int = CHUNK_ROWS,
           fan: int = FAN) -> DataFrame:
    """One row per conversation: its faults, the cost and edits of its repair and a hash of the repaired lines."""
    pieces, counted = repair(conversations, copies, chunk_rows, fan)
    found = digest(pieces).withColumnRenamed("conv_id", "own")
    return counted.join(found, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by a checksum of id and turn, and how often each then stands in its conversation.

    Of 20 classes, 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it a
    user's. Nulls count as one space.
    """
    blank = F.lit(" ")
    text = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.encode(F.concat(text[0], F.lit(":"), text[1]), "UTF-8")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(text[2]).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text[3], ".!?", "")).otherwise(text[3]).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )
    return rows, F.col("copies")
