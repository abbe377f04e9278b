"""Secret scans: one automaton for all rules, one pass over each text's bytes.

Each rule becomes a minimal automaton that tells at each byte whether a match of it is open (``watch_rule``), and all of
these are joined to a single one. One pass over a text gives where matches of any rule open and end; where the lead of a
match began is read back from there. Matches that fail the least length are dropped afterwards: they still
take their place. Rules without a lead open only after ENOUGH characters, since shorter runs of theirs can hide nothing.
A private key's span runs on from its BEGIN line to its END line, or through the base64 lines where there is none.
Null and empty texts have no matches; each row is scanned by itself, so repeated rows give repeated results, and an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from junctura.llm.automaton import compile_rules, joined, watch_rule
from junctura.llm.common import documents, map_batches, map_rows, resident, with_column


@dataclass(frozen=True)
class Rule:
    """A match is ``lead`` then ``body``, which is the secret part and must have ``least`` characters; body repeats ``unit``."""

    kind: str
    lead: str
    unit: str
    least: int
    whole: bool = False  # the lead belongs to the secret and counts for ``least``
    block: bool = False  # the span runs on to the end of a key's block


#: The contract's three kinds, then public token formats. Rules that can be open together multiply the states:
#: these make 7 179; Google keys, SendGrid keys and JSON web tokens, whose units take "-" and "_", would make 62 572.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 20, True),
    Rule("hex", "", "[0-9a-f]", 24, True),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", r"xox[abprs]\-", r"[A-Za-z0-9\-]", 10),
    Rule("private_key", r"\-\-\-\-\-BEGIN ([A-Z]+ )*PRIVATE KEY\-\-\-\-\-", "", 0, True, True),
    Rule("github_pat", "github_pat_", "[A-Za-z0-9_]", 60),
    Rule("gitlab", r"glpat\-", r"[A-Za-z0-9_\-]", 20),
    Rule("npm", "npm_", "[A-Za-z0-9]", 36),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]", 24),
    Rule("hugging_face", "hf_", "[A-Za-z0-9]", 34),
    Rule("digitalocean", "do[opr]_v1_", "[a-f0-9]", 64),
    Rule("shopify", "shp(at|ca|pa|ss)_", "[A-Fa-f0-9]", 32),
    Rule("linear", "lin_api_", "[A-Za-z0-9]", 40),
    Rule("databricks", "dapi", "[a-f0-9]", 32),
    Rule("slack_hook", r"https://hooks\.slack\.com/services/", "[A-Za-z0-9/]", 40),
)
BASE = ("assign", "access", "hex")
ENOUGH = 6
#: What follows a BEGIN line; line breaks may be written as escapes, lines indented, quoted or commented.
_BREAK = rb"""[\x20\t"',;]*+(?:\r?\n|(?:\\r)?\\n)[\x20\t>#*|"']*+"""
_HEADERS = rb"(?:(?:" + _BREAK + rb")++[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+"
_LINE = rb"""[A-Za-z0-9+/]++={0,2}+(?=[\x20\t"',;]*+(?:[\r\n\\]|\Z))"""
CLOSED = re.compile(_HEADERS + rb"""[A-Za-z0-9+/=\s\\>#*|"',;]*+-----END (?:[A-Z]+ )*PRIVATE KEY-----""")
UNCLOSED = re.compile(_HEADERS + rb"(?:" + _BREAK + rb")++" + _LINE + rb"(?:" + _BREAK + _LINE + rb")*+")


def scanner(rules: tuple[Rule, ...] = RULES) -> tuple:
    """(the automaton of all rules; by rule: the automaton of its lead read backward, and the characters at which it opens)."""
    opening = tuple((1 if r.lead else min(ENOUGH, r.least)) if r.unit else 0 for r in rules)
    both = joined([watch_rule(r.lead, r.unit, n) for r, n in zip(rules, opening, strict=True)])
    leads = [compile_rules([r.lead], backward=True).flat() if r.lead else None for r in rules]
    return both.flat(), tuple(leads), opening


def lead_start(data: bytes, at: int, least: int, flat: tuple | None) -> int:
    """Where the longest lead that ends at ``at`` and begins at ``least`` or later begins, or -1."""
    if flat is None:
        return at
    classes, table, accept, state = flat
    found = -1
    for i in range(at - 1, least - 1, -1):
        state = table[state + classes[data[i]]]
        if not state:
            break
        if accept[state]:
            found = i
    return found


def key_end(data: bytes, at: int) -> int:
    """End of the key block whose BEGIN line ends at ``at``."""
    found = CLOSED.match(data, at) or UNCLOSED.match(data, at)
    return found.end() if found else at


def spans(text: str | None, parts: tuple, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, int]]:
    """(start, number of the rule, start of the secret part, end) in code points, sorted; ends are exclusive."""
    data = (text or "").encode()
    (classes, table, accept, state), leads, opening = parts
    out = []
    opened, free = [0] * len(rules), [0] * len(rules)  # by rule: where its match opened, where its last one ended

    def close(k: int, end: int) -> None:
        rule, body = rules[k], opened[k]
        start = lead_start(data, body, free[k], leads[k])
        if start >= 0:
            end = key_end(data, end) if rule.block else end
            secret = start if rule.whole else body
            if end - secret >= rule.least:
                out.append((start, k, secret, end))
            free[k] = end

    now = 0
    for i, c in enumerate(data.translate(classes)):
        state = table[state + c]
        if accept[state] != now:
            was, now = now, accept[state]
            for k in range(len(rules)):
                bit = 1 << k
                if was & bit and not now & bit and opening[k]:
                    close(k, i)
                elif now & bit and not was & bit:
                    opened[k] = i + 1 - opening[k]
                    if not opening[k]:
                        close(k, i + 1)
    for k in range(len(rules)):
        if now >> k & 1 and opening[k]:
            close(k, len(data))
    if out and len(data) != len(text):
        place = {0: 0}
        last = 0
        for b in sorted({x for s in out for x in (s[0], s[2], s[3])}):
            place[b] = place[last] + len(data[last:b].decode())
            last = b
        out = [(place[a], k, place[b], place[c]) for a, k, b, c in out]
    return sorted(out)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, secrets): for each row the array of (kind, start, end, secret_start) of its text, in order."""

    def make(batch: pa.RecordBatch) -> dict:
        parts = resident(("secrets", rules), lambda: scanner(rules))
        found = [spans(t.as_py(), parts, rules) for t in batch.column(1)]
        return {"id": batch.column(0), "secrets": [[{"kind": rules[k].kind, "start": a, "end": c, "secret_start": b} for a, k, b, c in s] for s in found]}

    ready = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return map_batches(ready, ["id", "text"], make, "id long, secrets array<struct<kind:string,start:int,end:int,secret_start:int>>")


def redact(text: str | None, parts: tuple, mark: str = "[SECRET]") -> str | None:
    """``text`` with the secret parts of all matches, joined where they overlap, replaced by ``mark``."""
    if not text:
        return text
    out, at = [], 0
    for begin, end in sorted((b, c) for _, _, b, c in spans(text, parts)):
        if begin >= at:
            out += [text[at:begin], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan_secrets(documents(spark, sf_dir))
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars counts the new text."""

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = resident(("secrets", RULES), scanner)
        before = batch.column("text").to_pylist()
        texts = [redact(t, parts) for t in before]
        batch = with_column(batch, "text", pa.array(texts, pa.string()))
        if "n_chars" in batch.schema.names:
            counts = batch.column("n_chars")
            now = [n if t == u else len(u) for n, t, u in zip(counts.to_pylist(), before, texts, strict=True)]
            batch = with_column(batch, "n_chars", pa.array(now, counts.type))
        return batch

    return map_rows(docs, change)
