"""License scans: MinHash bands over overlapping windows. DataFrame functions only.

A text is its lower-cased words (runs of letters and digits) and their five-word
shingles. A template of t shingles belongs to the scale s, the least power of two
that is t or more. Windows of 2 s shingles start every s shingles, so every run of
s lies whole in one of them. A window that holds ``CONTAIN`` of a template has a
Jaccard similarity J of at least 0.8 t / (2 s + 0.2 t) > 0.19 with it; with bands
of one minimum each, ``BANDS`` = 40 of them collide at least once with probability
1 - (1 - J)^40 > 0.9997 (and above 0.999999 for a window twice the template).

Steps
1. A window can only have a template's band value if it holds the shingle that
   takes that minimum in the template, and so its longest word. Documents without
   any of these words or shingles, and windows without such a shingle of their
   scale, are passed over; this loses nothing.
2. The other windows' band values are joined with the templates'.
3. Each (window, template) is verified by exact containment: the share of the
   template's shingles that stand in the window.

Defined results
  null or empty text, under five words   nothing found
  very long text       scanned whole
  ties                 of equal containment the earliest window counts
  repeated rows        rows of a doc_id count as one document
  null doc_id          a document like others
  templates of under five words are an error: they have no shingle
  empty table          empty result
  extra columns        not read
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

SHINGLE, BANDS, CONTAIN = 5, 40, 0.8

#: Wording of license statements and of the openings of license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": "Released under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "BSD text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"),
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"),
    "LGPL": "under the terms of the GNU Lesser General Public License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC BY 4.0": "Licensed under CC BY 4.0",
    "CC BY-NC 4.0": "Licensed under CC BY-NC 4.0",
    "CC BY-SA 4.0": "Licensed under CC BY-SA 4.0",
    "CC attribution": "This work is licensed under a Creative Commons Attribution",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def shingled(rows: DataFrame, text: str, keep: list[str], with_words: bool = False) -> DataFrame:
    """``rows``'s columns ``keep`` and ``shingles``: hashes in text order, or with
    their words structs (hash, words)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", " ")), " ")

    def hashed(w):   # a lambda's variable, so that the words are split once and not for each shingle
        places = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)))
        if with_words:
            return F.transform(places, lambda i: F.struct(F.xxhash64(F.slice(w, i, SHINGLE)).alias("hash"),
                                                          F.slice(w, i, SHINGLE).alias("words")))
        return F.transform(places, lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))

    return rows.select(*keep, F.transform(F.array(words), hashed)[0].alias("shingles"))


def holds_any(text: str, parts: list[str]):
    """Whether the lower-cased text contains one of the strings."""
    these = F.array(*[F.lit(p) for p in parts])
    return F.transform(F.array(F.lower(col(text))),
                       lambda body: F.exists(these, lambda p: F.contains(body, p)))[0]


def minima(shingles: str) -> str:
    """SQL of the band values: for each band the least hash of the shingles under it."""
    return (f"transform(sequence(0, {BANDS - 1}), b -> struct(b AS band, "
            f"array_min(transform({shingles}, s -> xxhash64(b, s))) AS value))")


def bands_of(spark, templates: dict[str, str]) -> DataFrame:
    """(template, scale, own, band, value, key, anchor): ``key`` is the shingle of the
    minimum, ``anchor`` the longest of its words."""
    short = [n for n, t in templates.items() if len(t.split()) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    rows = [F.struct(F.lit(n).alias("template"), F.lit(t).alias("body")) for n, t in sorted(templates.items())]
    texts = spark.range(1).select(F.inline(F.array(*rows)))
    longest = F.array_max(F.transform(F.col("at.words"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return (shingled(texts, "body", ["template"], with_words=True)
            .withColumn("own", F.array_distinct("shingles.hash"))
            .withColumn("scale", F.expr("cast(pow(2, ceil(log2(size(own)))) AS int)"))
            .select("template", "scale", "own", "shingles", F.inline(F.expr(minima("own"))))
            .withColumn("at", F.expr("filter(shingles, s -> xxhash64(band, s.hash) = value)[0]"))
            .select("template", "scale", "own", "band", "value", F.col("at.hash").alias("key"),
                    longest["w"].alias("anchor")))


def find(docs: DataFrame, templates: dict[str, str] | None = None, doc: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc, template, containment, word_at): best window of each template found."""
    spark = docs.sparkSession
    table = bands_of(spark, TEMPLATES if templates is None else templates)
    # The templates are a parameter: a few, and their bands are read once to the driver.
    known = table.collect()
    keys: dict[int, set[int]] = {}
    for r in known:
        keys.setdefault(r["scale"], set()).add(r["key"])

    def among(values: set[int]):
        return F.array(*[F.lit(v).cast("long") for v in sorted(values)])

    anchors = sorted({r["anchor"] for r in known})
    source = docs.select(col(doc).alias("doc"), col(text).alias("body")).where(holds_any("body", anchors))
    some = (shingled(source, "body", ["doc"])
            .where(F.arrays_overlap("shingles", among(set().union(*keys.values())))))
    scales = F.array(*[F.struct(F.lit(s).alias("scale"), among(v).alias("keys")) for s, v in sorted(keys.items())])
    windows = (some.select("doc", "shingles", F.inline(scales))
               .where(F.arrays_overlap("shingles", "keys"))
               .select("doc", "shingles", "scale", "keys",
                       F.explode(F.expr("sequence(0, size(shingles) - 1, scale)")).alias("word_at"))
               .select("doc", "scale", "keys", "word_at",
                       F.expr("slice(shingles, word_at + 1, 2 * scale)").alias("held"))
               .where(F.arrays_overlap("held", "keys"))
               .select("doc", "scale", "word_at", "held", F.inline(F.expr(minima("held")))))
    share = F.size(F.array_intersect("own", "held")) / F.size("own")
    return (windows.join(table.drop("key", "anchor"), ["scale", "band", "value"])
            .select("doc", "template", share.alias("containment"), "word_at")
            .where(F.col("containment") >= CONTAIN)
            .groupBy("doc", "template").agg(F.max(F.struct("containment", (-F.col("word_at")).alias("back"))).alias("best"))
            .select("doc", "template", "best.containment", (-F.col("best.back")).alias("word_at")))
