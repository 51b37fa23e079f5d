"""Repair of the structure of conversations: the cheapest edits that make roles alternate and leave no faulty row.

A row's fault is the first that holds of blank, duplicate (role and text seen earlier in the conversation) and truncated (its last
character that isn't white space is none of `.!?`). With `s`, `u` and `a` for the initials of roles, the repaired roles read
`(s?(ua)+)?`. Keeping a row costs 0, making it user or assistant 1, deleting it 2 (blank and duplicate rows must go), an empty row put in 5,
and a truncated row that stays 5 more. Of the cheapest edits those whose initials (D, I, K, R) are least in ASCII are taken.

* Rows are dealt out by ranges of (conversation, turn, ...), so that a conversation of any size is cut into pieces, each piece one letter
  a row: role and fault. The pieces of a conversation, not its rows, meet in its signature.
* Distinct signatures, read from the end and sorted, are the words of an automaton that shares suffixes: a DAWG whose nodes are suffixes.
  Each range of them is walked once with a stack, so a node is made once for all conversations that end alike (but for the suffixes at the
  edges of ranges). Nodes whose cost-to-go differs by a constant are one state of a minimal machine; its moves, with the best edit for each
  state of the grammar, are worked out once. At one node the edits differ in their first letter, so the least of the cheapest is a link to the best
  audit of a later node and no strings are compared.
* Texts meet their audit in one sorted stream for each conversation, since a SHA-256 can only be made in order; no conversation is held.

Edge cases: nulls in conversation, role or text count as one space, a null turn comes first and is no turn of the gaps; a null conversation is one of its
own. Rows of one turn follow each other by role and text (its first 64 characters, then a hash). Repeated rows count each (all but one of them are duplicates). A conversation of
which no row is left has zeros, an empty audit and the hash of nothing. An empty table gives an empty result; other columns play no part.
What a conversation's result holds, one letter a row, must fit a cell.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a; where each initial leads.
MOVES = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEXT = ["u", "u", "a", "u"]
ENDS = (0, 3)
#: A letter of a signature: the initial of the role (o: another), a capital for truncated rows; x: a row that must go.
GONE = "x"
NEVER = 1 << 60
BLOCK_BYTES = 1 << 20
ROLES = {"u": "user", "a": "assistant"}


def settle(costs: list[int], edits: list[str]) -> tuple[int, tuple[int, ...], tuple[str, ...]]:
    """Adds insertions, and takes the least cost out: (it, costs, edits)."""
    for _ in range(3):  # more rows in a row only go round
        for q in range(4):
            by = INSERT + costs[MOVES[q][NEXT[q]]]
            if by < costs[q] or by == costs[q] and "I" < edits[q]:
                costs[q], edits[q] = by, "I"
    least = min(costs)
    return least, tuple(c - least for c in costs), tuple(edits)


def at_end() -> tuple[int, tuple[int, ...], tuple[str, ...]]:
    return settle([0 if q in ENDS else NEVER for q in range(4)], ["" if q in ENDS else "~" for q in range(4)])


@lru_cache(maxsize=None)
def step(letter: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[str, ...]]:
    """The node before `after`: (what all costs grow by, costs of the grammar's states, their edits). There are few such pairs."""
    costs, edits = [], []
    for q in range(4):
        ways = [(DELETE + after[q], "D")]
        if letter != GONE:
            more = TRUNCATED if letter.isupper() else 0
            if letter.lower() in MOVES[q]:
                ways.append((KEEP + more + after[MOVES[q][letter.lower()]], "K"))
            ways.append((REROLE + more + after[MOVES[q][NEXT[q]]], "R"))
        cost, edit = min(ways)
        costs.append(cost)
        edits.append(edit)
    return settle(costs, edits)


def best_audits(words: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures that come sorted, read from the end."""
    base, costs, edits = at_end()
    nodes, total, before = [(costs, edits)], [base], ""
    for word in words:
        shared = len(os.path.commonprefix((before, word)))
        del nodes[shared + 1 :], total[shared + 1 :]
        for letter in word[shared:]:
            more, costs, edits = step(letter, nodes[-1][0])
            nodes.append((costs, edits))
            total.append(total[-1] + more)
        before, q, at, audit = word, 0, len(word), []
        cost = total[at] + nodes[at][0][0]
        while edit := nodes[at][1][q]:
            audit.append(edit)
            if edit in "IR":
                q = MOVES[q][NEXT[q]]
            elif edit == "K":
                q = MOVES[q][word[at - 1].lower()]
            at -= edit != "I"
        yield word[::-1], cost, "".join(audit)


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct values of the column `signature`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str]] = []
        held = 0
        for row in best_audits(word for batch in batches for word in batch.column(0).to_pylist()):
            rows.append(row)
            held += len(row[0]) + 100
            if held > BLOCK_BYTES:
                yield as_batch(rows)
                rows, held = [], 0
        yield as_batch(rows)

    words = signatures.select(F.reverse("signature").alias("word")).distinct()
    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(work, "signature string, cost long, audit string")


def as_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    words, costs, found = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(costs, pa.int64()), pa.array(found, pa.string())], ["signature", "cost", "audit"])


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows with planted faults, by crc32 of `conv:turn` modulo 20: 0 drops the row (its role becomes null), 1 empties its text, 2 takes `.!?` out of it,
    3 repeats it, 4 makes its role user. Nulls become one space, but for conversations and turns."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space(conv), space(turn)).cast("binary")) % 20
    new_text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    new_role = F.when(fault == 0, F.lit(None)).when(fault == 4, "user").otherwise(space(role))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), new_role.alias("role"), F.when(fault > 0, new_text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"), space(role).alias("old_role"), F.left(space(text), F.lit(64)).alias("old_lead"), F.xxhash64(space(text)).alias("old_text"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Rows that are alike become one with their number, so that the rows of a conversation differ: (conv, turn, role, text, old_role, old_lead, old_text, copies)."""
    return rows.groupBy("conv", "turn", "role", "text", "old_role", "old_lead", "old_text").agg(F.sum("copies").alias("copies"))


#: Rows of a turn: by role, then text, of which 64 characters and a hash are kept.
ORDER = ["turn", "old_role", "old_lead", "old_text"]


def signed(rows: DataFrame) -> DataFrame:
    """(conv, turn, old_role, old_lead, old_text, copies, initial, fault): fault is blank, duplicate, truncated, '' or null for a row that isn't there."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    short = rows.select(
        "conv", *ORDER, "copies", F.substring("role", 1, 1).alias("initial"), F.col("role").isNotNull().alias("there"), blank.alias("blank"), truncated.alias("truncated"),
        F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("same"),
    )
    short = stored(short)
    # only what several rows of a conversation say can be said again; the first of them isn't a duplicate
    place = F.struct(*[F.col(c) for c in ORDER])
    firsts = short.where("there and not blank").groupBy("conv", "same").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("conv", "same", "first")
    firsts = stored(firsts)
    joined = short.alias("s").join(firsts.alias("f"), F.col("s.conv").eqNullSafe(F.col("f.conv")) & (F.col("s.same") == F.col("f.same")), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct(*[F.col(f"s.{c}").alias(c) for c in ORDER]))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    return joined.select("s.conv", *[f"s.{c}" for c in ORDER], "copies", "initial", F.when(F.col("there"), fault).alias("fault"))


PIECE = "nth long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first string, last string, signature string"
LEGAL = {"su", "ua", "au"}


def pieces(rows: DataFrame) -> DataFrame:
    """(conv, piece fields): what each batch of a range of rows holds of a conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {PIECE}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        nth = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "copies", "initial", "fault", "part")]
            out: dict[str, list] = {n: [] for n in ["conv", *(f.split()[0] for f in PIECE.split(", "))]}
            begun = False
            for conv, turn, copies, initial, fault, part in zip(*columns, strict=True):
                if not begun or conv != at:
                    at, begun, nth = conv, True, nth + 1
                    for name, value in (("conv", conv), ("nth", part << 32 | nth), ("turns", 0), ("first_turn", None), ("last_turn", None), ("blank", 0), ("duplicate", 0), ("truncated", 0), ("illegal", 0), ("first", None), ("last", None), ("signature", [])):
                        out[name].append(value)
                if fault is None:
                    continue
                if turn is not None and turn != out["last_turn"][-1]:
                    out["turns"][-1] += 1
                    out["last_turn"][-1] = turn
                    if out["first_turn"][-1] is None:
                        out["first_turn"][-1] = turn
                letter = initial if initial in ("s", "u", "a") else "o"
                letters = (GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter) + GONE * (copies - 1)
                out["signature"][-1].append(letters)
                if fault:
                    out[fault][-1] += 1
                out["blank" if fault == "blank" else "duplicate"][-1] += copies - 1
                before = out["last"][-1]
                out["illegal"][-1] += (copies - 1) * (initial + initial not in LEGAL) + (before is not None and before + initial not in LEGAL)
                if before is None:
                    out["first"][-1] = initial
                out["last"][-1] = initial
            out["signature"] = ["".join(x) for x in out["signature"]]
            yield pa.RecordBatch.from_arrays([pa.array(out["conv"], batch.column("conv").type), *(pa.array(out[n], pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in PIECE.split(", ")))], names=list(out))

    ranged = rows.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    return ranged.withColumn("part", F.spark_partition_id()).select("conv", "turn", "copies", "initial", "fault", "part").mapInArrow(work, schema)


def put_together(found: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of all pieces of a conversation, in order."""
    fields = [f.split()[0] for f in PIECE.split(", ")]
    listed = found.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("pieces"))

    def edge(name: str, same: bool) -> Column:
        """Over neighbouring pieces that have rows: how often the last of one and the first of the next are the same, or make no legal pair."""
        some = F.filter("pieces", lambda p: p[f"first{name}"].isNotNull())
        pair = lambda p, q: (p[f"last{name}"] == q[f"first{name}"]) if same else ~F.concat(p["last"], q["first"]).isin(*LEGAL)
        both = F.zip_with(F.slice(some, F.lit(1), F.greatest(F.size(some) - 1, F.lit(0))), F.slice(some, F.lit(2), F.greatest(F.size(some), F.lit(1))), pair)
        return F.size(F.filter(both, lambda x: x)).cast("long")

    total = lambda name: F.aggregate(F.transform("pieces", lambda p: p[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.array_min(F.transform("pieces", lambda p: p["first_turn"]))
    last = F.array_max(F.transform("pieces", lambda p: p["last_turn"]))
    return listed.select(
        "conv", F.coalesce(last - first + 1 - (total("turns") - edge("_turn", True)), F.lit(0)).cast("long").alias("gaps"), *[total(n).alias(n) for n in ("blank", "duplicate", "truncated")],
        (total("illegal") + edge("", False)).alias("illegal"), F.array_join(F.transform("pieces", lambda p: p["signature"]), "").alias("signature"),
    )


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): rows and their audits in one stream, sorted by conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    texts = rows.where("role is not null").select("conv", F.lit(1).alias("kind"), *ORDER, "copies", "role", "text")
    heads = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("old_role"), F.lit(None).cast("string").alias("old_lead"), F.lit(None).cast("long").alias("old_text"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = audit = None
        conv, at, q, some = None, 0, 0, False
        ids: list = []
        out: list[str] = []

        def put(role: str, text: str) -> None:
            nonlocal some
            hashed.update(("\n" * some + f"{role}:{text}").encode())
            some = True

        def insert() -> None:
            nonlocal at, q
            while audit[at : at + 1] == "I":
                put(ROLES[NEXT[q]], "")
                q = MOVES[q][NEXT[q]]
                at += 1

        def over() -> None:
            if hashed is not None:
                insert()
                ids.append(conv)
                out.append(hashed.hexdigest())

        for batch in batches:
            for c, kind, copies, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "copies", "role", "text")), strict=True):
                if kind == 0:
                    over()
                    hashed, audit, conv, at, q, some = hashlib.sha256(), text, c, 0, 0, False
                    continue
                for _ in range(copies):
                    insert()
                    edit = audit[at]
                    at += 1
                    if edit == "R":
                        put(ROLES[NEXT[q]], text)
                        q = MOVES[q][NEXT[q]]
                    elif edit == "K":
                        put(role, text)
                        q = MOVES[q][role[0]]
            last = batch.column("conv").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, last), pa.array(out, pa.string())], ["conv", "repaired_sha256"])
            ids, out = [], []
        over()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, last), pa.array(out, pa.string())], ["conv", "repaired_sha256"])

    both = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)
    return both.mapInArrow(work, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows as `damaged` gives them: a row for each conversation."""
    rows = stored(numbered(rows))
    whole = stored(put_together(pieces(signed(rows))))
    found = stored(whole.join(stored(audits(whole)), "signature").drop("signature"))
    shas = repaired(rows, found)
    joined = found.alias("a").join(shas.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")))
    return joined.select(F.col("a.conv").alias(conv), *[f"a.{n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], "b.repaired_sha256")


def as_rows(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as `repair` takes them, without planted faults."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).alias("copies"), space(role).alias("old_role"), F.left(space(text), F.lit(64)).alias("old_lead"), F.xxhash64(space(text)).alias("old_text"))


def way(cost: str, audit: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}}}"


def state_sql(q: int) -> str:
    """The ways from state q at one row, without insertions."""
    more = f"{TRUNCATED} * truncated"
    keep = [f"CASE WHEN NOT gone AND initial = '{x}' THEN {way(f'{more} + s{to}.c', f"'K' || s{to}.a")} END" for x, to in MOVES[q].items()]
    change = MOVES[q][NEXT[q]]
    rerole = f"CASE WHEN NOT gone THEN {way(f'{REROLE} + {more} + s{change}.c', f"'R' || s{change}.a")} END"
    return f"list_min([{way(f'{DELETE} + s{q}.c', f"'D' || s{q}.a")}, {rerole}, {', '.join(keep)}])"


REPAIR_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 20 AS fault
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, role AS old_role, text AS old_text, copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE fault > 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, old_role, old_text, copy) AS place FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS next_initial, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut_off AND NOT again AND NOT blank) AS truncated, count(*) FILTER (WHERE initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), walked AS (
  SELECT conv_id, 0::BIGINT AS place, any_value(n)::BIGINT AS n, {way("0", "''")} AS s0, {way("10", "'II'")} AS s1, {way("5", "'I'")} AS s2, {way("0", "''")} AS s3 FROM faulty GROUP BY conv_id
  UNION ALL
  SELECT conv_id, place, n, list_min([b0, {way("10 + b3.c", "'II' || b3.a")}, {way("5 + b2.c", "'I' || b2.a")}]), list_min([b1, {way("10 + b3.c", "'II' || b3.a")}, {way("5 + b2.c", "'I' || b2.a")}]),
    list_min([b2, {way("5 + b3.c", "'I' || b3.a")}]), list_min([b3, {way("5 + b2.c", "'I' || b2.a")}])
  FROM (
    SELECT conv_id, place, n, {state_sql(0)} AS b0, {state_sql(1)} AS b1, {state_sql(2)} AS b2, {state_sql(3)} AS b3
    FROM (SELECT w.conv_id, w.place + 1 AS place, w.n, w.s0, w.s1, w.s2, w.s3, f.initial, f.blank OR f.again AS gone, f.cut_off::INT AS truncated
      FROM walked w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.n - w.place)
  )
), audited AS (
  SELECT conv_id, s0.c::BIGINT AS cost, s0.a AS audit FROM walked WHERE place = n
), letters AS (
  SELECT conv_id, audit, j, substr(audit, j, 1) AS edit, len(replace(left(audit, j), 'I', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM audited)
), left_over AS (
  SELECT l.*, f.role, f.text, f.initial, row_number() OVER (PARTITION BY l.conv_id ORDER BY j) AS nth
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.place = l.place AND edit <> 'I' WHERE edit <> 'D'
), led AS (
  SELECT *, coalesce(max(CASE WHEN nth = 1 AND edit = 'K' AND initial = 's' THEN 1 END) OVER (PARTITION BY conv_id), 0) AS led FROM left_over
), written AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS repaired_sha256 FROM led GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted d ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN audited a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN written w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""
