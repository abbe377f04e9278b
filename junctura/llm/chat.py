"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (all of it, no other text)::

    conversation = turn*
    turn         = '<turn role="' role '" esc="' ( "0" | "1" ) '">\\n' body '\\n</turn>\\n'

A body holds no '</turn>' and no '<turn'; an escaped one holds no '<'; a role holds none of '"<>'. The parser checks
each turn against this and gives a null text for one that breaks it, so that such a conversation never equals its source.

A conversation is first written as it is (all turns esc="0"), parsed again and compared with the source. Where they differ,
turns with control strings are written escaped (esc="1"): '\\' as '\\b', then '<' as '\\l', which leaves no control
string and is undone in the opposite order; if they still differ, all turns are. Each try is made only for conversations that
the one before did not give back, and ``ok`` says whether the last one did. Roles are always escaped so, with '"' as '\\q' and '>' as '\\g' too.

Turns are ordered by turn, then role and text, so ties have one order and equal rows stand next to each other; null roles and
texts count as empty; rows without a conversation id form one conversation; no rows give no conversations; other columns are ignored.
The loss mask covers the bodies of assistant turns. A conversation becomes one value by definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\n</turn>\n"


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


BODY = [("\\", "\\b"), ("<", "\\l")]
ROLE = [*BODY, ('"', "\\q"), (">", "\\g")]


def _undo(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(b, a) for a, b in reversed(pairs)]


def render_turn(role: Column, text: Column, escape: Column) -> Column:
    body = F.when(escape, _swap(text, BODY)).otherwise(text)
    return F.concat(F.lit('<turn role="'), _swap(role, ROLE), F.lit('" esc="'), F.when(escape, "1").otherwise("0"), F.lit('">\n'), body, F.lit(END))


HEAD = r'<turn role="[^"<>]*" esc="[01]">\n'


def parse(formatted: Column) -> Column:
    """array<struct<role, text, body, head, size>> of the turns of a formatted conversation, by the grammar alone; null parts where it is broken."""
    chunks = F.split(formatted, "</turn>", -1)
    whole = F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))
    # each step names its values once, so that nothing is computed again for each use
    lines = F.transform(whole, lambda c, i: F.when(i == 0, c).when(c.startswith("\n"), F.substr(c, F.lit(2))))  # without the line break of the end before
    heads = F.transform(lines, lambda c: F.struct(c.alias("c"), c.rlike(rf"\A{HEAD}(?s:.*)\n\z").alias("sound"), F.substring_index(c, '">\n', 1).alias("head")))
    bodies = F.transform(heads, lambda t: F.struct(t["sound"], t["head"], F.length(t["c"]).alias("length"), F.substr(t["c"], F.length(t["head"]) + 4, F.length(t["c"]) - F.length(t["head"]) - 4).alias("raw"), t["head"].endswith('esc="1').alias("escaped")))

    def turn(t: Column) -> Column:
        raw = t["raw"]
        role = F.substring_index(F.substr(t["head"], F.lit(len('<turn role="') + 1)), '" esc="', 1)
        text = F.when(t["sound"] & t["escaped"] & ~raw.contains("<"), _swap(raw, _undo(BODY))).when(t["sound"] & ~t["escaped"] & ~raw.contains("<turn"), raw)
        return F.struct(_swap(role, _undo(ROLE)).alias("role"), text.alias("text"), raw.alias("body"), F.length(t["head"]).alias("head"), (t["length"] - 1).alias("size"))

    whole = F.transform(bodies, turn)
    broken = F.struct(F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.lit("").alias("body"), F.lit(0).alias("head"), F.lit(0).alias("size"))
    return F.when(F.element_at(chunks, -1) == "\n", whole).when(formatted.isNotNull(), F.array(broken))


def _renderer(escape: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda r: render_turn(r["role"], r["text"], escape(r))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans, ok) of (conv_id, turn, role, text); other columns are ignored.

    turns: array<struct<role, text>> read back from ``formatted``; loss_spans: array<struct<start, length>> in
    code points of ``formatted``, the (possibly escaped) bodies of assistant turns.
    """
    ready = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    now = ready.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    now = now.withColumn("source", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))))
    tries = (lambda r: F.lit(False), lambda r: r["text"].contains("<turn") | r["text"].contains("</turn>"), lambda r: F.lit(True))
    still = F.lit(True)
    for k, escape in enumerate(tries):
        written = F.array_join(F.transform("rows", _renderer(escape)), "")
        now = now.withColumn(f"written{k}", F.when(still, written)).withColumn(f"parsed{k}", parse(F.col(f"written{k}")))
        now = now.withColumn(f"same{k}", F.transform(f"parsed{k}", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).eqNullSafe(F.col("source")))
        still = still & ~F.col(f"same{k}")
    last = range(len(tries) - 1)
    pick = lambda name: F.coalesce(*[F.when(F.col(f"same{k}"), F.col(f"{name}{k}")) for k in last], F.col(f"{name}{len(tries) - 1}"))
    done = now.withColumns({"formatted": pick("written"), "parsed": pick("parsed"), "ok": ~still})
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["head"] + 3).alias("start"), F.length(t["body"]).alias("length"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + t["size"] + len(END)).alias("at"), spans.alias("spans"))

    spans = F.aggregate("parsed", begin, step, lambda acc: acc["spans"])
    turns = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return done.select("conv_id", "formatted", turns.alias("turns"), spans.alias("loss_spans"), "ok")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text"))
    chats = format_chats(rows.union(more))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: F.struct(F.substr("formatted", s["start"] + 1, s["length"]).alias("body"), F.substr("formatted", s["start"] - 3, F.lit(1)).alias("esc")))
    loss = F.array_join(F.transform(masked, lambda m: F.when(m["esc"] == "1", _swap(m["body"], _undo(BODY))).otherwise(m["body"])), "")
    read = chats.withColumn("loss", loss)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "ok",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, contains(text, '<turn') OR contains(text, '</turn>') AS x FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(32 + length(role) + length(text) + CASE WHEN x THEN len(text) - len(replace(replace(text, '\', ''), '<', '')) ELSE 0 END
    + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '"', ''), '>', ''))) AS BIGINT) AS formatted_chars, true AS ok
FROM m GROUP BY conv_id
"""
