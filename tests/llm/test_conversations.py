"""Repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidegauge.llm import conversations
from tidegauge.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies_ int"
SPACE = r"[\x20\x09-\x0D]"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2:]
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows, faults):
    """Audit and repaired turns by uniform-cost search; equal costs by the audit."""
    legal = re.compile("(s?(ua)+)?")
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, at, roles, turns = heapq.heappop(heap)
        ends = roles.endswith("a") or not roles
        state = (at, roles[-1:], not roles)
        if at == len(rows) and ends:
            assert legal.fullmatch(roles)
            return cost, audit, turns
        if (state, at == len(rows)) in seen:
            continue
        seen.add((state, at == len(rows)))
        want = "a" if roles.endswith("u") else "u"
        name = {"u": "user", "a": "assistant"}[want]
        heapq.heappush(heap, (cost + 5, audit + "I", at, roles + want, (*turns, (name, ""))))
        if at < len(rows):
            role, text = rows[at]
            more = 5 if faults[at] == "truncated" else 0
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, turns))
            if faults[at] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, roles + want, (*turns, (name, text))))
                if role[:1] == want or (not roles and role[:1] == "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*turns, (role, text))))


def expected(rows):
    """The contract of the query, row by row."""
    whole, out = {}, []
    for r in rows:
        whole.setdefault(r[0], [])
    for r in damage(rows):
        whole[r[0]].append(r)
    for conv, own in whole.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = re.sub(SPACE, "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                          "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest([r[2:] for r in own], faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, repeated rows, one turn for several rows, other roles, blank and unfinished texts."""
    rnd, out = random.Random(11), []
    for conv in [None, *range(70)]:
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rnd.choice(["Yes.", "no", " \t", "", None, "What? \n", "Well!", f"t{turn}.", " ", "So éè"])
            row = (conv, rnd.choice([turn, turn, turn, turn + 2, None]), role, text)
            out += [row] * rnd.choice([1, 1, 1, 2, 3])
    return out


def test_small_table(spark, rows):
    assert got(conversations.report(*conversations.damaged(frame(spark, rows)))) == expected(rows)


@pytest.mark.parametrize("chunk,fan", [(1, 2), (4, 3)])
def test_long_conversations_are_cut(spark, rows, chunk, fan):
    """One conversation holds half of the rows, a third of all rows are equal; chunks of a few rows in every task."""
    rnd = random.Random(3)
    long = [(1000, rnd.randint(0, 900), rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b", f"c{i}.", f"d{i}!"]))
            for i in range(400)]
    every = rows + long + [(1000, 5, "user", "same.")] * 300 + [(None, None, "user", None)] * 40
    found = conversations.report(*conversations.damaged(frame(spark, every, 7)), chunk_rows=chunk, fan=fan)
    assert got(found) == expected(every)


def test_divide_and_conquer_equals_one_pass():
    rnd = random.Random(2)
    for _ in range(300):
        rows = [(rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b"])) for _ in range(rnd.randint(0, 12))]
        faults = [rnd.choice(["", "", "truncated", "blank"]) for _ in rows]
        kinds = [0 if f == "blank" else conversations.kind(r, f == "truncated") for (r, _), f in zip(rows, faults)]
        steps = [conversations.STEPS[k] for k in kinds]
        end, cost = conversations.goal(conversations.forward(steps, 0, len(steps), 0))
        audit, turns = conversations.edited(rows, kinds, 0, end, True)
        assert (cost, audit, tuple((t["role"], t["text"]) for t in turns)) == cheapest(rows, faults)


def test_empty_table_and_very_long_text(spark):
    assert got(conversations.report(*conversations.damaged(frame(spark, [])))) == []
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", "word " * 200_000 + str(i) + ".") for i in range(6)]
    assert got(conversations.report(*conversations.damaged(frame(spark, rows)))) == expected(rows)


def test_query_on_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op11_conversation_repair"](spark, data)
    assert dict(df.dtypes) | dict.fromkeys(COLUMNS[1:7], "bigint") == dict(df.dtypes)
    assert got(df) == expected(rows)
