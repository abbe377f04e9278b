"""Conversation repair against exhaustive search, and small tables with nulls, ties, repeats and no rows."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from junctura.llm import repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, kind string, signature string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def search(initials, faults):
    """(cost, audit, edits) by trying every edit at every place."""

    @functools.cache
    def go(i, state, inserted):
        found = [(0, "", ())] if i == len(initials) and state in ("", "a") else []

        def way(cost, edit, role, rest):
            if rest:
                found.append((rest[0] + cost, edit + rest[1], ((edit, role), *rest[2])))

        for role in NEXT[state]:
            if inserted < 3 and role != "s":
                way(3, "I", role, go(i, role, inserted + 1))
        if i < len(initials):
            way(4, "D", "", go(i + 1, state, 0))
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                for role in NEXT[state]:
                    if role == initials[i]:
                        way(more, "K", "", go(i + 1, role, 0))
                    if role != "s":
                        way(more + 3, "R", role, go(i + 1, role, 0))
        return min(found, default=None)

    return go(0, "", 0)


def plain(rows):
    """{conv_id: the columns} of (conv_id, turn, role, text), row by row."""
    convs = {}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs.setdefault(c, []).extend([(t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1))
    return {c: answer(sorted(held, key=lambda z: ((0, 0) if z[0] is None else (1, z[0]), *z[1:]))) for c, held in convs.items()}


def answer(held):
    faults, seen = [], set()
    for _, r, x in held:
        bare = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((r, x))
    turns = [t for t, _, _ in held if t is not None]
    initials = [r[:1] for _, r, _ in held]
    cost, audit, edits = search(tuple(initials), tuple(faults))
    out, rows = [], iter(held)
    for edit, role in edits:
        _, r, x = (None, "", "") if edit == "I" else next(rows)
        if edit != "D":
            out.append(f"{ {'u': 'user', 'a': 'assistant'}.get(role, r) }:{x}")
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def by_id(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "user", "assistant", None, ""], ["Hi.", "Hi", "yes!", "no", "a b?", " ", "", None, "x. ", "x. "]
    some = [(c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in range(300) for _ in range(rng.randrange(12))]
    long = [(1000, i, rng.choice(roles), f"{i % 40} {rng.choice(texts)}") for i in range(120)]
    return some + long + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None), (-5, -1, "user", "z" * 200_000)]


def test_repair_against_search(spark, rows):
    df = spark.createDataFrame([(*r, "x", "ua") for r in rows], SCHEMA)
    assert by_id(repair.repair(repair.damaged(df))) == plain(rows)
    assert repair.repair(repair.damaged(df.filter("false"))).count() == 0


def test_conversations_whose_rows_are_all_dropped(spark):
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = by_id(repair.repair(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))))
    assert out == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_follow_the_grammar(spark, rows):
    ready = repair.ready(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = repair.repaired_turns(ready).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "role"))), lambda r: F.substring(r["role"], 1, 1)), "").alias("r")).collect()
    assert turns and all(re.fullmatch("(s?(ua)+)?", t.r) for t in turns)


def test_nodes_are_shared():
    trie = repair.Trie()
    words = sorted({"".join(random.Random(i).choices("suaSUAox", k=9)) for i in range(2000)})
    for w in words:
        initials = ["t" if k == "o" else k.lower() for k in w]
        assert trie.solve(w) == search(tuple(initials), tuple("blank" if k == "x" else "truncated" if k.isupper() else "" for k in w))[:2]
    assert trie.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_small_batches(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(repair, "BATCH", 100)
    assert by_id(repair.repair(repair.damaged(df))) == plain(rows)
