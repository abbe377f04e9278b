"""Repair of conversation structure: cheapest edits that turn each conversation's roles into ``(s?(ua)+)?``.

A row's signature is one character: its role's initial (``o`` for one that is no s, u or a), in upper case where the row is truncated, or ``x``
where it must go (blank or duplicate). A conversation is the string of its rows' signatures, and its edits
depend on that string alone. The strings of a batch of conversations are sorted, which walks their prefix trie in order: the costs of a
trie node (the least cost of each grammar state after that prefix) are computed once for all strings below it, and at a
string's end the edits are read back. Costs less their minimum take few values, so a node holds two bytes, the number of its layer.

Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end. ``Keep`` costs 0, ``Rerole`` 3, ``Delete`` 4,
``Insert`` 3, and a truncated row that stays 3 more. Among the cheapest edits those whose initials are least in ASCII order win: the edges of
cheapest paths are marked from the end, then followed from the start by least initial.

Rows of a conversation are ordered by turn (nulls first), then role and text; equal rows stand next to each other. Null roles and texts
count as one space, as does a null id or turn where damage is dealt; rows with a null id are one conversation. A role's
initial is its first character ("" for an empty role). Repeated rows are duplicates of the first. No rows give no conversations; other columns are ignored.

How it scales: one shuffle by conversation brings rows to their order, a stream of one row at a time; a conversation in memory is one byte a row.
Texts come by in a second such stream, which has the edits of a conversation before its rows. So a conversation of any length is neither a
group nor an array, though a single digest over all of its text makes it one task's stream by definition.
"""

from __future__ import annotations

import hashlib
import os.path
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from junctura.tables import cut

SPACES = " \t\n\x0b\x0c\r"
RES, DEL, INS, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 20
#: Grammar: state -> {initial: next state}.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: A batch is solved when it holds this many signatures (characters).
BATCH = 1 << 20
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SCHEMA = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def edges(state: int, kind: str) -> list[tuple[str, int, int]]:
    """(initial of the edit, cost, next state) of the ways to pass a row, in ASCII order of the initial."""
    out = [("D", DEL, state)]
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        if (to := NEXT[state].get(kind.lower())) is not None:
            out.append(("K", more, to))
        out += [("R", RES + more, to) for role, to in NEXT[state].items() if role != "s"]
    return out


def inserts(state: int) -> list[int]:
    return [to for role, to in NEXT[state].items() if role != "s"]


class Layers:
    """Numbered layers of least costs, less their minimum, and the steps between them; each step is computed once."""

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.marks: dict[tuple[int, str, int], int] = {}
        self.first = self.number(self.closed([0, FAR, FAR, FAR]))[0]

    def number(self, costs: list[int]) -> tuple[int, int]:
        """(number, minimum) of a layer."""
        least = min(costs)
        key = tuple(min(c - least, FAR) for c in costs)
        if key not in self.numbers:
            self.numbers[key] = len(self.costs)
            self.costs.append(key)
        return self.numbers[key], least

    @staticmethod
    def closed(costs: list[int]) -> list[int]:
        """Costs after any inserts at this place."""
        for _ in range(3):
            for state in range(4):
                for to in inserts(state):
                    costs[to] = min(costs[to], costs[state] + INS)
        return costs

    def step(self, layer: int, kind: str) -> tuple[int, int]:
        """(layer after a row of ``kind``, cost that all its states have in common more than before)."""
        if (layer, kind) not in self.steps:
            costs = [FAR] * 4
            for state, have in enumerate(self.costs[layer]):
                if have < FAR:
                    for _, cost, to in edges(state, kind):
                        costs[to] = min(costs[to], have + cost)
            self.steps[layer, kind] = self.number(self.closed(costs))
        return self.steps[layer, kind]

    def at_end(self, layer: int) -> tuple[int, set[int]]:
        """(least cost of a state that may end, those states)."""
        costs = self.costs[layer]
        least = min(costs[s] for s in ENDS)
        return least, {s for s in ENDS if costs[s] == least}

    def with_inserts(self, layer: int, marked: int) -> int:
        """``marked`` (a bit a state) with the states that reach it by cheapest inserts."""
        costs = self.costs[layer]
        for _ in range(3):
            for state in range(4):
                if any(marked >> to & 1 and costs[state] + INS == costs[to] for to in inserts(state)):
                    marked |= 1 << state
        return marked

    def before(self, layer: int, kind: str, marked: int) -> int:
        """States before a row of ``kind`` from which cheapest paths lead to ``marked`` after it."""
        if (layer, kind, marked) not in self.marks:
            after, more = self.step(layer, kind)
            out = 0
            for state, have in enumerate(self.costs[layer]):
                if have < FAR and any(marked >> to & 1 and have + cost == self.costs[after][to] + more for _, cost, to in edges(state, kind)):
                    out |= 1 << state
            self.marks[layer, kind, marked] = self.with_inserts(layer, out)
        return self.marks[layer, kind, marked]


class Trie:
    """Answers for signatures that come in sorted order; only the path to the last one is held, two bytes a node."""

    def __init__(self) -> None:
        self.layers = Layers()
        self.last, self.path, self.total = "", array("H", [self.layers.first]), array("q", [0])
        self.nodes = 0

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits."""
        shared = len(os.path.commonprefix([self.last, signature]))
        del self.path[shared + 1 :], self.total[shared + 1 :]
        for kind in signature[shared:]:
            layer, more = self.layers.step(self.path[-1], kind)
            self.path.append(layer)
            self.total.append(self.total[-1] + more)
        self.nodes += len(signature) - shared
        self.last = signature
        least, ends = self.layers.at_end(self.path[-1])
        return self.total[-1] + least, self.audit(signature, ends)

    def audit(self, signature: str, ends: set[int]) -> str:
        layers, n = self.layers, len(signature)
        marked = bytearray(n + 1)
        marked[n] = layers.with_inserts(self.path[n], sum(1 << s for s in ends))
        for i in range(n - 1, -1, -1):
            marked[i] = layers.before(self.path[i], signature[i], marked[i + 1])
        out, state, i = bytearray(), 0, 0
        while i < n or state not in ends:
            costs = layers.costs[self.path[i]]
            ways = [("I", to, 0) for to in inserts(state) if marked[i] >> to & 1 and costs[state] + INS == costs[to]]
            if i < n:
                after, more = layers.step(self.path[i], signature[i])
                ways += [(e, to, 1) for e, cost, to in edges(state, signature[i]) if marked[i + 1] >> to & 1 and costs[state] + cost == layers.costs[after][to] + more]
            edit, state, passed = min(ways)
            out += edit.encode()
            i += passed
        return out.decode()


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the conversation that ``audit`` makes of ``rows`` (role, text)."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if state == 2 else "user"
        state = NEXT[state][role[:1]]
        yield role, text


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with kind (a signature) and initial, by one shuffle to their conversations' partitions.

    Rows that are ``gone`` only tell that there is a conversation.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    at = "row_number() over (partition by conv_id, gone, role, md5(text) order by turn nulls first)"
    known = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    kind = F.when(bare == "", "b").when(F.col("_seen") > 1, "d").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), known).otherwise(F.upper(known))
    return rows.repartition("conv_id").withColumn("_seen", F.expr(at)).select(*rows.columns, first.alias("initial"), kind.alias("kind"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in range(0, batch.num_rows, 1024):
            yield from zip(*[c.to_pylist() for c in batch.slice(part, 1024).columns], strict=True)


class _Conversation:
    """Counts of a conversation while its rows go by; b and d in ``kinds`` stand for x."""

    def __init__(self, key: object) -> None:
        self.key, self.kinds, self.illegal, self.initial = key, bytearray(), 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, kind: str) -> None:
        if self.kinds and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.kinds += kind.encode()
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        text = self.kinds.decode()
        cut_short = sum(map(text.count, "SUAO"))
        return {"conv_id": self.key, "gaps": gaps, "blank": text.count("b"), "duplicate": text.count("d"), "truncated": cut_short, "illegal": self.illegal, "signature": text.replace("b", "x").replace("d", "x")}


def edits(faulty: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, cost and audit. ``faulty`` is ``with_faults``'s result."""
    schema = SCHEMA.format(id=faulty.schema["conv_id"].dataType.simpleString())

    def solve(held: list[dict]) -> pa.RecordBatch:
        trie, answers = Trie(), {}
        for signature in sorted({h["signature"] for h in held}):
            answers[signature] = trie.solve(signature)
        rows = [{**h, "cost": answers[h["signature"]][0], "audit": answers[h["signature"]][1]} for h in held]
        for r in rows:
            del r["signature"]
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for key, turn, gone, initial, row_kind in _runs(batches):
            if now is None or key != now.key:
                if now is not None:
                    held.append(now.row())
                    size += len(now.kinds) + 64
                if size > BATCH:
                    yield solve(held)
                    held, size = [], 0
                now = _Conversation(key)
            if not gone:
                now.add(turn, initial, row_kind)
        if now is not None:
            yield solve([*held, now.row()])

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return faulty.sortWithinPartitions(*order).select("conv_id", "turn", "gone", "initial", "kind").mapInArrow(run, schema)


def _with_edits(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's head (its facts, its audit in place of a role), then its rows in order, by one shuffle."""
    heads = solved.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit("").alias("text"), F.array(*FACTS).alias("facts"))
    body = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(None).cast("array<bigint>").alias("facts"))
    return heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(head row, its repaired rows as they come by) of each conversation of a sorted stream; rows that nobody takes are passed over."""
    rows = _runs(batches)
    head = next(rows, None)
    while head is not None:
        ahead: list = []

        def own() -> Iterator[tuple[str, str]]:
            for row in rows:
                if row[1] == 0:
                    ahead.append(row)
                    return
                yield row[3], row[4]

        source = own()
        yield head, repaired(head[3], source)
        for _ in source:  # rows after the last edit: none but for those not taken
            pass
        head = ahead[0] if ahead else None


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_rows, repaired_sha256), one row a conversation.

    ``rows``: (conv_id, turn, role, text, gone), nulls read as spaces (``ready``).
    """
    solved = cut(edits(with_faults(rows)), "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for (key, _, _, audit, _, facts), turns in _conversations(batches):
            n, digest = 0, hashlib.sha256()
            for role, text in turns:
                digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
            done.append({"conv_id": key, **dict(zip(FACTS, facts, strict=True)), "audit": audit, "repaired_rows": n, "repaired_sha256": digest.hexdigest()})
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema=arrow)

    schema = f"{SCHEMA}, repaired_rows long, repaired_sha256 string".format(id=rows.schema["conv_id"].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return _with_edits(rows, solved).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, positions from 0; ``rows`` as for ``repair``."""
    solved = cut(edits(with_faults(rows)), "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, *_), turns in _conversations(batches):
            held = []
            for at, (role, text) in enumerate(turns):
                held.append({"conv_id": key, "position": at, "role": role, "text": text})
                if len(held) == 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, role string, text string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return _with_edits(rows, solved).mapInArrow(run, schema)


def ready(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversation rows: null roles and texts as one space, nothing gone."""
    spaced = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", "turn", *spaced, F.lit(False).alias("gone"))


def damaged(rows: DataFrame) -> DataFrame:
    """``ready`` rows with faults dealt by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = ready(rows).withColumn("_d", F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn"))) % 20)
    text: Column = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    out = dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"), F.when(F.col("_d") == 3, 2).otherwise(1).alias("_n"))
    return out.withColumn("_n", F.explode(F.expr("sequence(1, _n)"))).drop("_n")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows)).drop("repaired_rows")


def _add(x: str, cost: str, edits_: str) -> str:
    return f"(lpad(CAST(CAST(substr({x}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || '{edits_}' || substr({x}, 11))"


def _oracle() -> str:
    """The same by costs to the end: for each grammar state the cost (ten digits) and edits of the best way on, from the last row to the first."""
    more = "(CASE WHEN k = upper(k) THEN 3 ELSE 0 END)"
    keep = lambda to, kinds: f"CASE WHEN lower(k) IN ({kinds}) THEN {_add(to, more, 'K')} END"
    change = lambda to: f"CASE WHEN k <> 'x' THEN {_add(to, '3 + ' + more, 'R')} END"
    w = [
        f"least({_add('v0', '4', 'D')}, {keep('v1', chr(39) + 's' + chr(39))}, {keep('v2', chr(39) + 'u' + chr(39))}, {change('v2')})",
        f"least({_add('v1', '4', 'D')}, {keep('v2', chr(39) + 'u' + chr(39))}, {change('v2')})",
        f"least({_add('v2', '4', 'D')}, {keep('v3', chr(39) + 'a' + chr(39))}, {change('v3')})",
        f"least({_add('v3', '4', 'D')}, {keep('v2', chr(39) + 'u' + chr(39))}, {change('v2')})",
    ]
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS cell FROM conversations
), dealt AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(cell, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS d FROM src
), hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS two FROM placed
), faulty AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN initial ELSE upper(initial) END AS kind FROM seen
), convs AS MATERIALIZED (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate,
    count(*) FILTER (kind IN ('S', 'U', 'A', 'O')) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(CASE WHEN kind IN ('b', 'd') THEN 'x' ELSE kind END, '' ORDER BY i) AS signature
  FROM faulty GROUP BY conv_id
), best AS (
  SELECT signature, length(signature) AS i, '0000000000' AS v0, '0000000006II' AS v1, '0000000003I' AS v2, '0000000000' AS v3 FROM (SELECT DISTINCT signature FROM convs)
  UNION ALL
  SELECT signature, i - 1, least(w0, {_add("w2", "3", "I")}, {_add("w3", "6", "II")}), least(w1, {_add("w2", "3", "I")}, {_add("w3", "6", "II")}), least(w2, {_add("w3", "3", "I")}), least(w3, {_add("w2", "3", "I")})
  FROM (SELECT signature, i, {w[0]} AS w0, {w[1]} AS w1, {w[2]} AS w2, {w[3]} AS w3 FROM (SELECT *, substr(signature, i, 1) AS k FROM best WHERE i > 0))
), solved AS (
  SELECT c.*, CAST(substr(v0, 1, 10) AS BIGINT) AS cost, substr(v0, 11) AS audit FROM convs c JOIN best b ON c.signature = b.signature AND b.i = 0
), edits AS (
  SELECT conv_id, j, substr(audit, j, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM solved)
), walked AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), met AS (
  SELECT w.conv_id, j, e, o, CASE WHEN e = 'I' THEN '' ELSE role END AS role, CASE WHEN e = 'I' THEN '' ELSE text END AS text FROM walked w LEFT JOIN faulty f ON w.conv_id = f.conv_id AND w.i = f.i AND e <> 'I' WHERE e <> 'D'
), begun AS (SELECT conv_id, bool_or(o = 1 AND e = 'K' AND substr(role, 1, 1) = 's') AS s FROM met GROUP BY conv_id
), written AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - CAST(s AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS repaired FROM met JOIN begun USING (conv_id) GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN solved USING (conv_id) LEFT JOIN written USING (conv_id)
"""


ORACLE = _oracle()
