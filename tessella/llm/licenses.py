"""Operator 7: license scans by diagonal voting.

Every text is cut into words; a hash rolls over each k words. Spark joins these hashes to the positions that the same
k-gram has in the templates, and each match votes for one diagonal: word number in the text minus word number in the
template. Votes are summed by diagonal; neighbouring diagonals of a template (a few words inserted or left out) are
merged into spans; a span is verified by the grams' own words and scored by the share of the template's words it
covers. Three kinds of templates go the same way: phrases and short notices, which count only if all their words stand on
one diagonal, and license texts, which count from `least` coverage. Of notices that start at one word the longest counts;
only phrases make the base columns.

The templates are a fixed, small table. So that grams without any template position never leave the scan, the scan
tests each rolling hash against the set of template hashes (a broadcast semi-join); the join proper is Spark's.

Edge cases: a null or empty text has no words; texts are taken whole; repeated rows are scanned one by one (each row gets
its own number in the written scan); ties between labels all count; an empty table gives an empty result; extra columns
take no part; words are bytes, so texts need be no valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import raw_texts, write_table
from tessella.runtime import ship_package

# Phrases that name a license.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def _notices() -> tuple[tuple[str, str], ...]:
    """Short notices: names and addresses of the Creative Commons family, one-line notices of other licenses."""
    rights = {
        "": ("", ""), "-sa": ("sa", "sharealike|share alike"), "-nc": ("nc", "noncommercial|non commercial"), "-nd": ("nd", "noderivatives|no derivatives|noderivs|no derivs"),
        "-nc-sa": ("nc sa", "noncommercial sharealike|non commercial share alike|noncommercial share alike"),
        "-nc-nd": ("nc nd", "noncommercial noderivatives|non commercial no derivatives|noncommercial no derivatives|noncommercial noderivs"),
    }
    out = [("cc0 1 0", "cc0"), ("cc0 license", "cc0"), ("creative commons zero", "cc0"), ("creativecommons org publicdomain zero", "cc0"), ("creative commons license", "cc"), ("creative commons licence", "cc")]
    for right, (short, names) in rights.items():
        # "cc by" alone also stands in other texts: it takes a version or the word license.
        ends = (short,) if short else ("1 0", "2 0", "2 5", "3 0", "4 0", "license", "licence")
        out += [(f"cc by {end}", f"cc-by{right}") for end in ends] + [(f"creativecommons org licenses by {short}".strip(), f"cc-by{right}")]
        out += [(f"creative commons attribution {name}".strip(), f"cc-by{right}") for name in names.split("|")]
    for label, names in (("mit", "mit"), ("apache", "apache"), ("gpl", "gpl|gnu gpl"), ("bsd", "bsd|new bsd|simplified bsd"), ("isc", "isc"), ("mpl", "mpl")):
        out += [(f"{start} {name}", label) for name in names.split("|") for start in ("licensed under", "licensed under the", "spdx license identifier")]
    return (*out, ("bsd license", "bsd"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("isc license", "isc"), ("mozilla public license", "mpl"), ("the unlicense", "unlicense"))


# Lines that name a license and are no phrase of the base columns.
NOTICES = _notices()

# Opening or notice paragraphs of public licenses.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
PHRASE_K, TEXT_K = 2, 4
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def license_words(text: bytes) -> list[bytes]:
    """ASCII letters (lower-cased), digits and all non-ASCII characters make words."""
    return text.translate(_TO_WORDS).split()


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring word numbers; the number 0 stands for a word of no template."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * _M
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def template_rows() -> tuple[list[tuple], dict[bytes, int]]:
    """(template, label, phrase?, whole?, words, k, hash, position, gram) rows, and numbers of all template words."""
    texts = [(p, label, True, True) for p, label in PHRASES] + [(t, label, False, False) for label, t in TEXTS] + [(t, label, False, True) for t, label in NOTICES]
    number: dict[bytes, int] = {}
    for t, *_ in texts:
        for w in license_words(t.encode()):
            number.setdefault(w, len(number) + 1)
    rows = []
    for i, (t, label, phrase, whole) in enumerate(texts):
        ws, k = license_words(t.encode()), PHRASE_K if whole else TEXT_K
        for j, h in enumerate(_rolling(np.array([number[w] for w in ws]), k).tolist()):
            rows.append((i, label, phrase, whole, len(ws), k, h, j, b" ".join(ws[j : j + k]).decode()))
    return rows, number


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows()[0], "template int, label string, phrase boolean, whole boolean, size int, k int, hash long, at int, gram string")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: row (its number in this scan), doc_id, n_words, grams array<struct<k, hash, pos, gram>>."""
    ship_package(docs.sparkSession)
    rows, number = template_rows()
    wanted = {k: np.array(sorted({r[6] for r in rows if r[5] == k}), np.int64) for k in (PHRASE_K, TEXT_K)}
    kind = pa.struct([("k", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()), ("gram", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, sizes, grams = [], [], []
            for t in raw_texts(batch.column(1)):
                ws = license_words(t or b"")
                word = np.fromiter((number.get(w, 0) for w in ws), np.int64, len(ws))
                found = []
                for k, hashes in wanted.items():
                    h = _rolling(word, k)
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    for p in np.flatnonzero(hashes[at] == h).tolist():
                        found.append({"k": k, "hash": int(h[p]), "pos": p, "gram": b" ".join(ws[p : p + k]).decode("utf-8", "replace")})
                ids.append((part << 40) + seen)
                seen += 1
                sizes.append(len(ws))
                grams.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(kind))], names=["row", "doc_id", "n_words", "grams"])

    base = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = f"row long, doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words long, grams array<struct<k:int,hash:long,pos:long,gram:string>>"
    return base.mapInArrow(run, schema)


def spans(scanned: DataFrame, gap: int = 4, reach: int = 40) -> DataFrame:
    """Merged diagonals: row, template, label, phrase, size, start, stop (word numbers), covered (words of the template)."""
    templates = F.broadcast(_templates(scanned.sparkSession))  # fixed size
    votes = scanned.where(F.size("grams") > 0).select("row", F.explode("grams").alias("g")).select("row", "g.*")
    votes = votes.join(templates, ["k", "hash", "gram"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    # Votes of one diagonal that stand together; a template that stands twice on nearby diagonals makes two runs.
    same = Window.partitionBy("row", "template", "diagonal").orderBy("pos")
    jump = (F.col("pos") - F.lag("pos").over(same) > reach) | (F.col("at") < F.lag("at").over(same))
    votes = votes.withColumn("run", F.sum(F.coalesce(jump, F.lit(False)).cast("int")).over(same))
    lines = votes.groupBy("row", "template", "label", "phrase", "whole", "size", "k", "diagonal", "run").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("start"), (F.max("pos") + F.col("k")).alias("stop"),
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)))).alias("covered"),
    )  # at most as many votes as the template has grams
    whole = lines.where(F.col("whole") & (F.col("votes") == F.col("size") - F.col("k") + 1))
    longest = F.max("size").over(Window.partitionBy("row", "phrase", "start"))
    whole = whole.withColumn("longest", longest).where(F.col("phrase") | (F.col("size") == F.col("longest")))
    texts = lines.where(~F.col("whole"))
    near = Window.partitionBy("row", "template").orderBy("start", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(near)) > gap) | (F.col("start") - F.lag("stop").over(near) > reach)
    texts = texts.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(near))
    texts = texts.groupBy("row", "template", "label", "phrase", "size", "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered")
    )
    columns = ["row", "template", "label", "phrase", "size", "start", "stop", "covered"]
    return whole.withColumn("covered", F.col("size")).select(*columns).unionByName(texts.select(*columns))


def scan_licenses(docs: DataFrame, least: float = 0.6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, found array<struct<label, phrase, start, stop, score>>, in order of start."""
    scanned = write_table(scan(docs, doc_id, text), "licenses")
    found = spans(scanned).withColumn("score", F.col("covered") / F.col("size")).where(F.col("score") >= least)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label", "phrase", "score"))).alias("found"))
    none = F.array().cast("array<struct<start:long,stop:long,label:string,phrase:boolean,score:double>>")
    return scanned.select("row", "doc_id", "n_words").join(found, "row", "left").select("doc_id", "n_words", F.coalesce("found", none).alias("found"))


def license_digest(docs: DataFrame, **options) -> DataFrame:
    """The columns of the contract, from the spans."""
    df = scan_licenses(docs, **options)
    base = F.filter("found", lambda s: s["phrase"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    return df.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
