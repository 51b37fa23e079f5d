import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from quire.llm import conversations
from quire.llm.catalog import op12_repair_conversations
from quire.llm.conversations import as_rows, best_audits, damaged, repair

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) by a search over all edits; rows: (role, text, fault)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, out = heapq.heappop(queue)
        if at == len(rows) and LEGAL.fullmatch(state):
            return cost, audit, out
        if (at, key := (state[:1] == "s", len(state) > (state[:1] == "s"), state[-1:])) in done:
            continue
        done.add((at, key))
        ways = [(5, "I", at, r, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            ways.append((2, "D", at + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways += [(more, "K", at + 1, role[:1] or "?", (role, text)), *((1 + more, "R", at + 1, r, (r, text)) for r in ("user", "assistant"))]
        for by, edit, to, role, row in ways:
            new = state + role[:1]
            if re.fullmatch(r"s?(ua)*u?", new):
                heapq.heappush(queue, (cost + by, audit + edit, to, new, (*out, row) if row else out))
    raise AssertionError


def brute(rows, plant=True):
    of = {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    out = set()
    for conv, mine in of.items():
        kept = []
        for turn, role, text in sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if plant else 9
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn, "user" if fault == 4 else role, text)] * (fault > 0) * (1 + (fault == 3))
        seen, faults = set(), []
        for _, role, text in kept:
            faults.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, left = cheapest([(r, t, f) for (_, r, t), f in zip(kept, faults, strict=True)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


def test_query_is_brute_force(spark):
    got = [tuple(r) for r in op12_repair_conversations(spark, SF).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def drawn(seed, n, length):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", " \n", "Why?", "Why? ", "end.\n\n", None]
    return [
        (None if k == 3 else k, draw.choice([t, t, t, t + 1, None]), draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), draw.choice(texts))
        for k in range(n) for t in range(draw.randrange(1, length))
    ]


def test_random_conversations(spark):
    rows = drawn(1, 60, 9) + drawn(2, 4, 60)
    rows += rows[:40] + [(900, 0, "user", "x.")] * 30 + [(901, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in repair(damaged(docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {tuple(r) for r in repair(as_rows(docs)).collect()} == brute(rows, plant=False)
    with duckdb.connect() as db:
        conversations_ = docs.toArrow()
        db.register("conversations", conversations_)
        assert set(db.sql(conversations.REPAIR_SQL).fetchall()) == set(got)


def test_pieces_of_a_long_conversation(spark):
    """A conversation over several ranges and batches is what it is in one."""
    rows = drawn(3, 2, 3) + [(5, t, "user" if t % 2 else "assistant", f"{t // 3}{'.' * (t % 7 > 0)}") for t in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {tuple(r) for r in repair(damaged(spark.createDataFrame(rows, SCHEMA).repartition(7))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert got == brute(rows)


def test_one_node_for_all_that_end_alike():
    signatures = sorted({"".join(random.Random(k).choices("suaoSUAOx", k=k % 9)) for k in range(400)}, key=lambda x: x[::-1])
    faults = lambda x: [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in x]
    for word, cost, audit in best_audits(x[::-1] for x in signatures):
        assert (cost, audit) == cheapest(faults(word))[:2], word
    assert conversations.step.cache_info().currsize < 300


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair(damaged(none)).count() == 0
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "ok.")]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fault", "'x' AS signature", "2 AS copies", "3 AS conv")
    assert {tuple(r) for r in repair(damaged(clash)).collect()} == brute(rows)
    every = [c for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    gone = spark.createDataFrame([(c, 0, "user", "a.") for c in every], SCHEMA)
    assert [tuple(r)[1:] for r in repair(damaged(gone)).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2


@pytest.mark.parametrize("plant", [True, False])
def test_reruns_agree(spark, plant):
    docs = spark.createDataFrame(drawn(9, 20, 8), SCHEMA)
    make = damaged if plant else as_rows
    assert sorted(repair(make(docs)).collect(), key=str) == sorted(repair(make(docs.repartition(5))).collect(), key=str)
