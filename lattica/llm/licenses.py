"""License scans by DataFrame functions alone: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public license notices that are looked for: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without prior written permission",
}
SHINGLE = 3
#: One row a band. At Jaccard similarity s a window meets its template with probability 1 - (1 - s) ** BANDS. A window is at
#: most four times as long as its template, so even one crowded with other templates' shingles has s >= 0.8 / 4.2: 0.998.
BANDS = 32
#: The least stride. Strides double from it up to the longest template; a window is two strides long, so a template no
#: longer than its stride lies whole in some window.
STRIDE = 16


def shingles(text: Column) -> tuple[Column, Column]:
    """Words, and hashes of the 3-word shingles of ``_words`` by position: lower-case words of letters and digits; null and short texts: none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")), " ")
    last = F.size(words) - SHINGLE
    hashed = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(SHINGLE)])
    return words, F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<bigint>"))


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    words, hashed = shingles(F.col(text))
    return df.withColumn("_words", words).withColumn("_shingles", hashed).drop("_words")


def templates(spark, texts: dict[str, str]) -> DataFrame:
    """(template, stride, set): a row a template, of any length; the table is the caller's and of fixed size."""
    rows = spark.createDataFrame(sorted(texts.items()), "template string, body string")
    made = with_shingles(rows, "body").select("template", F.array_distinct("_shingles").alias("set"), F.size("_shingles").alias("n"))
    if made.where("n = 0").count():
        raise ValueError(f"a template has fewer than {SHINGLE} words")
    made = made.withColumn("stride", (STRIDE * F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / STRIDE))))).cast("int"))
    return made.select("template", "stride", "set")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def bands(column: str) -> Column:
    """MinHash of a set, a value a band."""

    def hashed(b: int):
        return lambda h: F.xxhash64(h, F.lit(b))  # one parameter: a second would be the index

    return F.array(*[F.array_min(F.transform(F.col(column), hashed(b))) for b in range(BANDS)])


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """(row, doc_id, template, containment, position) of every template of which a window holds ``containment`` of the shingles.

    Windows are reduced to the shingles that some template has before they are signed: the others can take no part in a
    containment and would only lower the similarity. A row is scanned by itself: rows are told apart by a hash of id and
    text, so rows with a null or a repeated id share nothing but equal texts. No row for other texts, for null, empty and
    short ones. All columns but id and text are left out, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = templates(spark, TEMPLATES if texts is None else texts)
    vocabulary = [r[0] for r in known.select(F.explode("set")).distinct().collect()]  # as large as the templates
    strides = sorted(r[0] for r in known.select("stride").distinct().collect())
    mine = with_shingles(docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").select("row", "doc_id", "_shingles")
    at = F.filter(F.transform("_shingles", lambda h, i: F.when(h.isin(vocabulary), F.struct(i.alias("i"), h.alias("h")))), lambda x: x.isNotNull())
    hits = mine.select("row", "doc_id", F.inline(at))
    spread = F.explode(F.array(*[F.struct(F.lit(s).alias("stride"), (F.floor(F.col("i") / s) - k).cast("long").alias("window")) for s in strides for k in (0, 1)]))
    windows = hits.select("row", "doc_id", "h", "i", spread.alias("w")).select("row", "doc_id", "h", "i", "w.*").where("window >= 0 or i < stride")
    windows = windows.groupBy("row", "stride", "window").agg(F.first("doc_id").alias("doc_id"), F.collect_set("h").alias("held"), F.min("i").alias("position"))
    signed = windows.withColumn("band", bands("held")).select("row", "doc_id", "stride", "window", "held", "position", F.posexplode("band").alias("b", "value"))
    wanted = known.withColumn("band", bands("set")).select("template", "stride", "set", F.posexplode("band").alias("b", "value"))
    found = signed.join(F.broadcast(wanted), ["stride", "b", "value"])
    share = F.size(F.array_intersect("held", "set")) / F.size("set")
    found = found.select("row", "doc_id", "template", "position", share.alias("containment")).where(F.col("containment") >= containment)
    return found.groupBy("row", "template").agg(F.first("doc_id").alias("doc_id"), F.max("containment").alias("containment"), F.min("position").cast("long").alias("position"))


def contract(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_licenses, licenses (sorted, comma-joined), containment (the best, 0 without any).
    The odd cases are those of :func:`scan_licenses`; rows that repeat an id or a text each give a row."""
    found = scan_licenses(docs).groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("template")), ",").alias("licenses"), F.count("*").alias("n"), F.max("containment").alias("best"))
    joined = docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(found, "row", "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("containment"))
