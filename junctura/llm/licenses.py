"""Licence scans over a positional rare-token index, in DataFrame functions only.

The index holds, for every licence template, its highest-IDF words (of equal ones the longer), as many as carry MASS of its IDF, with the positions where they
stand: word -> IDF and postings (template, position). All of a file's words that are in the index are looked up (the index is small, so their
postings are bounded), and their places minus the postings' positions give offsets: words of one template at one offset stand as they
do in the template. An offset's share of the IDF of the template's indexed words is its score. A label counts

* if at some offset the score reaches LEAST and the template's mandatory phrase stands there; the best such offset gives its score, and equal ones give the same;
* or else, since inserted and dropped words move offsets, if positions found at offsets within a band reach MOST together, each counted once, and the phrase stands among the
  text's licence words (those of any template), whatever other words come between. Bands are two of BAND offsets side by side, so that offsets that
  are at most BAND apart share one. So "GNU Lesser General Public License" is no "GNU General Public License", but one split by a comment sign is.
* or if an SPDX licence identifier names it (score 1).

Everything happens within a row: no shuffle, no keys, so null or repeated ids and repeated rows do no harm; other columns are
ignored; no rows give no rows. Only texts with a word that each phrase here needs are cut into words (a necessary
condition that is made from the phrases). Null and empty texts have no words.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import documents

#: Phrases with their labels; public licence notices with their label and mandatory phrase.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("lgpl", "gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("cc-by", "cc by", "this work is licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc", "this work is licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("agpl", "gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "boost software license", "distributed under the boost software license version 1 0"),
    ("cc0", "cc0 1 0 universal", "to the extent possible under law the author has waived all copyright and related rights under cc0 1 0 universal"),
    ("cc-by-sa", "cc by sa", "this work is licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("artistic", "artistic license", "you may redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("eupl", "european union public licence", "licensed under the european union public licence"),
    ("ofl", "sil open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("wtfpl", "do what the fuck you want to public license", "everyone is permitted to copy and distribute verbatim or modified copies under the do what the fuck you want to public license"),
    ("ms-pl", "microsoft public license", "this code is licensed under the microsoft public license"),
    ("psf", "psf license agreement", "licensed to you under the terms of the psf license agreement for python"),
)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's IDF that its indexed words carry; score that an offset needs, and one that a band of offsets needs; offsets of half a band.
MASS, LEAST, MOST, BAND = 0.75, 0.6, 0.85, 8
#: What SPDX identifiers call a label, where that is another name.
SPDX = {"python": "psf"}


@functools.cache
def index() -> tuple[dict[str, tuple[float, list[tuple[int, int]]]], list[float]]:
    """(word -> (IDF, postings), by template: IDF of its indexed words at all their positions)."""
    words = [t.split() for _, _, t in TEMPLATES]
    idf = {w: math.log(1 + len(words) / sum(w in ws for ws in words)) for ws in words for w in ws}
    table: dict[str, tuple[float, list[tuple[int, int]]]] = {}
    most = []
    for t, ws in enumerate(words):
        rare, total = set(), sum(idf[w] for w in ws)
        for w in sorted(set(ws), key=lambda w: (-idf[w], -len(w), w)):
            if sum(idf[x] for x in ws if x in rare) < MASS * total:
                rare.add(w)
        most.append(sum(idf[w] for w in ws if w in rare))
        for p, w in enumerate(ws):
            if w in rare:
                table.setdefault(w, (idf[w], []))[1].append((t, p))
    return table, most


@functools.cache
def needed() -> str:
    """A pattern that every text with one of the phrases matches: each phrase's longest word, or the whole phrase if its words are short."""
    wanted = set()
    for phrase in (*(p for p, _ in BASE), *(p for _, p, _ in TEMPLATES)):
        longest = max(phrase.split(), key=len)
        wanted.add(longest if len(longest) > 3 else GAP.join(phrase.split()))
    least = [w for w in wanted if not any(v != w and v in w for v in wanted)]
    return "(?i)" + "|".join(sorted(least))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda w: w != "")


def starts(words: Column, phrase: str) -> Column:
    """Places (from 0) where the words of ``phrase`` stand one after another."""
    want = phrase.split()
    here = F.transform(words, lambda w, i: F.when(w == want[0], i))
    return F.filter(F.array_compact(here), lambda i: F.slice(words, i + 1, len(want)) == F.array(*map(F.lit, want)))


def template_scores(words: Column) -> Column:
    """array<double> by template: the best share of the rare words at an offset that reaches LEAST and has the mandatory phrase; else that of a band that reaches MOST; else 0."""
    table, most = index()
    entry = lambda idf, ps: F.struct(F.lit(idf).alias("idf"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]).alias("ps"))
    lookup = F.create_map(*[x for w, (idf, ps) in table.items() for x in (F.lit(w), entry(idf, ps))])
    # a hash set tells licence words from others; the map, which is searched in order, is asked for these only
    known = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda k: k["w"].isin(*table))
    kept = F.transform(known, lambda k: F.struct(k["i"], F.try_element_at(lookup, k["w"]).alias("e")))
    hits = F.array_sort(F.flatten(F.transform(kept, lambda k: F.transform(k["e"]["ps"], lambda p: F.struct(p["t"].alias("t"), (k["i"] - p["p"]).alias("at"), p["p"].alias("p"), k["e"]["idf"].alias("idf"))))))
    keys = [phrase.split() for _, phrase, _ in TEMPLATES]
    places = [next(i for i in range(len(want)) if want[i : i + len(key)] == key) for key, want in zip(keys, (text.split() for _, _, text in TEMPLATES), strict=True)]
    place, phrase = F.array(*map(F.lit, places)), F.array(*[F.array(*map(F.lit, key)) for key in keys])
    enough = F.array(*[F.lit(LEAST * m) for m in most])
    begin = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("at"), F.lit(0.0).alias("run"), F.array_repeat(F.lit(0.0), len(TEMPLATES)).alias("best"))

    def step(acc: Column, h: Column) -> Column:
        run = F.when((acc["t"] == h["t"]) & (acc["at"] == h["at"]), acc["run"]).otherwise(0.0) + h["idf"]
        first = h["at"] + F.get(place, h["t"]) + 1
        stands = F.slice(words, F.greatest(first, F.lit(1)), F.size(F.get(phrase, h["t"]))) == F.get(phrase, h["t"])
        better = F.when((run >= F.get(enough, h["t"])) & (run > F.get(acc["best"], h["t"])) & (first >= 1), stands).otherwise(False)
        best = F.when(better, F.transform(acc["best"], lambda b, i: F.when(i == h["t"], run).otherwise(b))).otherwise(acc["best"])
        return F.struct(h["t"].alias("t"), h["at"].alias("at"), run.alias("run"), best.alias("best"))

    shares = F.array(*map(F.lit, most))
    strict = F.transform(F.aggregate(hits, begin, step, lambda acc: acc["best"]), lambda b, i: F.least(F.lit(1.0), b / F.get(shares, i)))
    among = F.filter(words, lambda w: w.isin(sorted({w for _, _, t in TEMPLATES for w in t.split()})))
    stands = lambda i: F.size(F.filter(F.transform(among, lambda _, j: F.slice(among, j + 1, F.size(F.get(phrase, i))) == F.get(phrase, i)), lambda x: x)) > 0
    bands = band_shares(hits)
    loose = F.transform(bands, lambda b, i: F.when((b > 0) & stands(i), b).otherwise(0.0))
    return F.when(F.exists(bands, lambda b: b > 0), F.zip_with(strict, loose, lambda a, b: F.when(a > 0, a).otherwise(b))).otherwise(strict)


def band_shares(hits: Column) -> Column:
    """array<double> by template: the best share of its indexed words at offsets of one band, each position counted once, where that reaches MOST; else 0."""
    most = index()[1]
    enough, shares = F.array(*[F.lit(MOST * m) for m in most]), F.array(*map(F.lit, most))
    entry = lambda h, less: F.struct(h["t"].alias("t"), (F.floor(h["at"] / BAND) - less).alias("b"), h["p"].alias("p"), h["idf"].alias("idf"))
    entries = F.array_sort(F.flatten(F.transform(hits, lambda h: F.array(entry(h, 0), entry(h, 1)))))
    begin = F.struct(F.lit(-1).alias("t"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("p"), F.lit(0.0).alias("run"), F.array_repeat(F.lit(0.0), len(TEMPLATES)).alias("best"))

    def step(acc: Column, e: Column) -> Column:
        same = (acc["t"] == e["t"]) & (acc["b"] == e["b"])
        run = F.when(same, acc["run"]).otherwise(0.0) + F.when(same & (acc["p"] == e["p"]), 0.0).otherwise(e["idf"])
        better = (run >= F.get(enough, e["t"])) & (run > F.get(acc["best"], e["t"]))
        best = F.when(better, F.transform(acc["best"], lambda b, i: F.when(i == e["t"], run).otherwise(b))).otherwise(acc["best"])
        return F.struct(e["t"].alias("t"), e["b"].alias("b"), e["p"].alias("p"), run.alias("run"), best.alias("best"))

    return F.transform(F.aggregate(entries, begin, step, lambda acc: acc["best"]), lambda b, i: F.least(F.lit(1.0), b / F.get(shares, i)))


def spdx_labels(text: Column) -> Column:
    """Labels of the SPDX identifiers of a text: of those that one begins with, up to a hyphen or its end, the longest."""
    names = {g: g for g in sorted({g for _, g in BASE} | {g for g, _, _ in TEMPLATES})} | SPDX
    known = "|".join(sorted(map(re.escape, names), key=len, reverse=True))
    lines = F.regexp_extract_all(text, F.lit(r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"), F.lit(1))
    ids = F.flatten(F.transform(lines, lambda x: F.split(F.translate(x, UPPER, LOWER), r"[^a-z0-9.+-]+")))
    found = F.filter(F.transform(ids, lambda x: F.regexp_extract(x, rf"^({known})(?:-|\+|$)", 1)), lambda x: x != "")

    def label(x: Column) -> Column:
        out = x
        for name, other in SPDX.items():
            out = F.when(x == name, other).otherwise(out)
        return out

    found = F.transform(found, label)
    return F.when(text.contains("SPDX") | text.contains("spdx"), found)


def found_templates(scores: Column) -> Column:
    """array<struct<label, score>> of the templates that were found."""
    each = [F.when(F.get(scores, F.lit(t)) > 0, F.struct(F.lit(label).alias("label"), F.get(scores, F.lit(t)).alias("score"))) for t, (label, _, _) in enumerate(TEMPLATES)]
    return F.array_compact(F.array(*each))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), GAP, "")).cast("long").alias("n_words"), F.when(text.rlike(needed()), words_of(text)).alias("words"), spdx_labels(text).alias("spdx"))
    places = rows.withColumns({f"p{k}": starts(F.col("words"), phrase) for k, (phrase, _) in enumerate(BASE)}).withColumn("scores", F.when(F.col("words").isNotNull(), template_scores(F.col("words"))))
    found = places.withColumn("found", F.when(F.col("scores").isNotNull(), found_templates(F.col("scores"))))
    at = F.flatten(F.array(*[F.col(f"p{k}") for k in range(len(BASE))]))
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    none = F.array().cast("array<string>")
    more = F.concat(F.coalesce(F.transform("found", lambda f: f["label"]), none), F.coalesce("spdx", none))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        F.when(F.size("spdx") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
