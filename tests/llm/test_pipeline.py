"""The pipeline against brute force: edit distances cell by cell, secrets by regexes, near-duplicates by SQL, the unchanged library."""

import hashlib
import random
import re
import shutil

import duckdb
import numpy as np
import public_tokenizers as files
import sentencepiece

import corpus_pipeline
from junctura.llm import dedup, secret_scan, sp_encode

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def least_edits(item, text):
    """Least word edit distance between ``item`` and any run of ``text``, cell by cell."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    t = np.array([number.get(w, -1) for w in text])
    j = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, w in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (t != number[w])]))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def without_secrets(text):
    """The secret parts of all rules' matches, found by regexes, joined where they overlap and replaced; no key blocks are in these texts."""
    parts = []
    for rule in secret_scan.RULES:
        if rule.unit:
            for m in re.finditer(f"(?P<lead>{rule.lead})(?P<body>{rule.unit}+)", text):
                if m.end() - (m.start() if rule.whole else m.start("body")) >= rule.least:
                    parts.append((m.start() if rule.whole else m.start("body"), m.end()))
    out, at = [], 0
    for begin, end in sorted(parts):
        if begin >= at:
            out += [text[at:begin], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def edited(rng, item, k):
    out = list(item)
    for at in sorted(rng.sample(range(len(out)), k), reverse=True):
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(10**9)}"]
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    con = duckdb.connect()
    items = [words(t) for (t,) in con.execute(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    rng = random.Random(12)
    rows = con.execute(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' where text is not null and length(text) < 4000 order by doc_id limit 70").fetchall()
    prose = lambda n: " ".join("".join(rng.choices("abcdeinorst", k=rng.randrange(2, 9))) for _ in range(n))
    for i in range(60):
        item = items[i % len(items)]
        k = int(0.2 * len(item)) + (0, 0, 1, 3)[i % 4]
        secret = ("token = 'abcdef123'", "AKIA" + "ABCD1234" * 3, "hf_" + "aB3" * 12, "0123456789abcdef" * 2, "no key")[i % 5]
        text = f"{prose(40)}. {secret} {', '.join(edited(rng, item, k))}! {prose(30)}"
        rows.append((10_000 + i, text, "en", "s", len(text)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    at_stage = dedup.ORACLE.replace("85 * (a.n", f"{dedup.STAGE_PERCENT} * (a.n")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({at_stage}) WHERE kept").fetchall()}
    lib = sentencepiece.SentencePieceProcessor(model_file=files.path(sp_encode.MODEL))
    want, held, most = {}, 0, {}
    for i, t, *_ in rows:
        if i in kept and any(c.isalpha() for c in t):
            own = words(t)
            distances = [least_edits(x, own) - int(0.2 * len(x)) for x in items]
            if min(distances) <= 0:
                held += 1
                most[i] = min(distances)
                continue
            ids = lib.encode(without_secrets(t))
            want[i] = (len(ids), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert held >= 30 and sum(i >= 10_000 for i in want) >= 15
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the search is by LSH with a target of 0.98: of the documents with as many edits as allowed one may stay, no clean one may go
    missed = [i for i in most if i in got]
    assert len(missed) <= 1 and all(most[i] == 0 for i in missed)
    assert {i: x for i, x in got.items() if i not in most} == want
