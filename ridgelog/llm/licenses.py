"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelog.llm.common import alnum_words, bands_for, row_keys

#: words of a shingle
SHINGLE = 5
#: share of a template's shingles that a window must hold
CONTAINED = 0.8
#: chance that no band of a window retrieves a template it holds
MISS = 1e-6
#: templates, whose shingles and bands are broadcast
MOST_TEMPLATES = 2000

# Usual license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``(license, text)`` rows of a short list."""
    if not templates:
        return spark.range(0).select(F.lit("").alias("license"), F.lit("").alias("text"))
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in templates])))


@dataclass(frozen=True)
class Band:
    """Templates of ``words // 2 + 1`` to ``words`` words are sought in windows of twice ``words``, one every ``words``."""

    words: int
    bands: int


def band_settings(words: int, miss: float = MISS) -> Band:
    """Bands of one row, as many as it takes for a window that holds enough of the shortest template of its length."""
    template = max(1, words // 2 + 1 - SHINGLE + 1)
    window = 2 * words - SHINGLE + 1
    shared = template if template == 1 else CONTAINED * template
    return Band(words, bands_for(shared / (template + window - shared), miss))


def _seeds(n: int) -> list[int]:
    rng = random.Random(42)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(n)]


def _hash(words: str, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def _hashes(words: str) -> Column:
    """The different hashes of all shingles of an array of words; none for fewer words than a shingle has."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(places, lambda i: _hash(words, i)))).otherwise(F.array().cast("array<bigint>"))


def _texts(words: str) -> Column:
    """The different shingles themselves."""
    places = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def _signature(hashes: str, bands: int, shingles: bool = False) -> Column:
    """The smallest of the hashes, hashed anew with each of the seeds; with ``shingles`` as (least, hash of that shingle).

    Only a hash that mixes all bits makes every shingle the smallest equally often; h XOR seed does not.
    """
    seeds = F.array(*[F.lit(s) for s in _seeds(bands)])
    mixed = lambda h, s: F.struct(F.xxhash64(h, s).alias("least"), h.alias("hash")) if shingles else F.xxhash64(h, s)
    return F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: mixed(h, s))))


def scan_licenses(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, license, containment, first_word)`` for every license whose template a document holds.

    Words are lower-cased runs of letters and digits, shingles have five. A template is held if a
    window has at least CONTAINED of its shingles; ``containment`` is the largest share over templates of the
    license and windows, ``first_word`` the place of the first window with that share. Windows of twice the
    template's length (up to the next power of two) start every length, so each occurrence
    lies whole in one. Documents without a license, null and empty texts have no row; rows that repeat doc_id and text
    count once; null doc_ids stay null. Templates without a license, with fewer
    than five words, or null have nothing to find; more than MOST_TEMPLATES raise an error.

    A band of a window equals a template's only if the window holds the shingle with the template's smallest
    hash. So the texts are read once, by a join with these few hashes, and only windows with one of them are given
    a signature, retrieved by bands and verified; nothing that a band could retrieve is lost.
    """
    rows = templates.where("license IS NOT NULL").select("license", alnum_words(F.col("text").cast("string")).alias("words")).where(F.size("words") >= SHINGLE).distinct()
    sizes = [r[0] for r in rows.select(F.size("words")).limit(MOST_TEMPLATES + 1).collect()]
    if len(sizes) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    wide = lambda n: max(8, 1 << (n - 1).bit_length())
    settings = [band_settings(w) for w in sorted({wide(n) for n in sizes})]
    if not settings:
        nothing = F.lit(None)
        return docs.where("false").select(F.col(doc_id).alias("doc_id"), nothing.cast("string").alias("license"), nothing.cast("double").alias("containment"), nothing.cast("long").alias("first_word"))

    def by_class(frame: DataFrame, hashes: str, shingles: bool = False) -> DataFrame:
        """Rows with (band, least) of the signature that their class of windows has."""
        signature = F.array().cast("array<struct<least:bigint,hash:bigint>>" if shingles else "array<bigint>")
        for s in settings:
            signature = F.when(F.col("wide") == s.words, _signature(hashes, s.bands, shingles)).otherwise(signature)
        return frame.select("*", F.posexplode(signature).alias("band", "least"))

    wide_of = F.greatest(F.lit(8), F.pow(F.lit(2), F.ceil(F.log2(F.size("words")))).cast("int"))
    named = F.xxhash64("license", "words").alias("template")
    known = rows.select("license", named, wide_of.alias("wide"), _texts("words").alias("shingles"), _hashes("words").alias("hashes"))
    signed = by_class(known, "hashes", shingles=True)
    bands = signed.select("template", "wide", "band", F.col("least.least").alias("least"))
    smallest = signed.select("wide", F.col("least.hash").alias("hash")).distinct()

    id_key, text_key = row_keys(doc_id, text)
    texts = docs.select(F.col(doc_id).alias("doc_id"), id_key.alias("id_key"), text_key.alias("text_key"), alnum_words(F.col(text).cast("string")).alias("all_words"))
    shingles = texts.where(F.size("all_words") >= SHINGLE).select("*", F.posexplode("all_words").alias("place", "word")).withColumn("hash", _hash("all_words", F.col("place")))
    met = shingles.join(F.broadcast(smallest), "hash")
    held = F.floor(F.col("place") / F.col("wide")).cast("int")
    met = met.select("doc_id", "id_key", "text_key", "wide", "all_words", F.explode(F.array(held, held - 1)).alias("k")).where("k >= 0")
    cut = met.select("doc_id", "id_key", "text_key", "wide", "k", F.slice("all_words", F.col("k") * F.col("wide") + 1, 2 * F.col("wide")).alias("words"))
    windows = cut.dropDuplicates(["id_key", "text_key", "wide", "k"]).select("*", _texts("words").alias("own"), _hashes("words").alias("hashes"))
    found = by_class(windows, "hashes").join(F.broadcast(bands), ["wide", "band", "least"])
    found = found.select("doc_id", "id_key", "text_key", "template", "own", (F.col("k") * F.col("wide")).cast("long").alias("first_word"))
    found = found.dropDuplicates(["id_key", "text_key", "template", "first_word"]).join(F.broadcast(known.select("template", "license", "shingles")), "template")
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    best = found.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    best = best.groupBy("doc_id", "id_key", "text_key", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("first_word"))
