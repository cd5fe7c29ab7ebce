"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies them.

Everything is Column expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math
import re
import struct

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and texts of common license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
    ("BSD-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)

#: Words of a shingle; a template of fewer words is one shingle.
SHINGLE = 5
#: Least share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: Bands of one minimum each. A window that holds 0.8 of a template has at least a quarter of their union in
#: common (see ``_classes``), so that 24 bands miss it with probability under 0.75^24 = 0.1 %.
BANDS = 24

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Lower-case runs of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _SEPARATORS, " "), " "), lambda w: w != "")


def _shingles(words: Column, first: Column, last: Column, size: int) -> Column:
    """Hashes of the shingles that begin at words ``first`` to ``last``, from 0."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")))).otherwise(F.array().cast("array<bigint>"))


def _salted(band: int):
    return lambda s: F.xxhash64(F.lit(-band), s)


def _band_keys(shingles: Column, bands: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.array_min(F.transform(shingles, _salted(b)))) for b in range(bands)])


def _plain_words(text: str) -> list[str]:
    return re.sub(_SEPARATORS, " ", text.lower()).split()


def _hash(value: bytes, seed: int = 42) -> int:
    """As Spark's xxhash64, unsigned; its argument list is hashed left to right, each hash the seed of the next."""
    return xxhash.xxh64_intdigest(value, seed)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _template_shingles(words: list[str], size: int) -> list[int]:
    return list(dict.fromkeys(_long(_hash(" ".join(words[i : i + size]).encode())) for i in range(len(words) - size + 1)))


def _template_keys(shingles: list[int], bands: int) -> list[int]:
    """As ``_band_keys``."""
    least = [min(_long(_hash(struct.pack("<q", s), _hash(struct.pack("<i", -b)))) for s in shingles) for b in range(bands)]
    return [_long(_hash(struct.pack("<q", m), _hash(struct.pack("<i", b)))) for b, m in enumerate(least)]


def anchors(words: list[str], size: int, containment: float) -> list[str]:
    """Words of which a window with that share of the template's shingles must hold one: their shingles are too many to be missing.

    Long words first, as they are rare.
    """
    n = len(words) - size + 1
    missing = n - math.ceil(containment * n - 1e-9)
    covered: set[int] = set()
    chosen = []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        own = {i for at, x in enumerate(words) if x == w for i in range(max(0, at - size + 1), min(at, n - 1) + 1)}
        if not own <= covered:
            covered |= own
            chosen.append(w)
        if len(covered) > missing:
            return chosen
    return chosen


def _classes(templates: list[tuple[str, str]], size: int, containment: float) -> dict[tuple[int, int], list[tuple[str, list[str]]]]:
    """Templates by (words of a shingle, shingles up to a power of two C).

    Windows of C + C/2 shingles at every C/2 shingles hold any C in a row whole. A template of S > C/2
    shingles, 0.8 of them in the window, has at least 0.8 S / (1.5 C + 0.2 S) > 1/4 of the union in common.
    """
    found: dict[tuple[int, int], list[tuple[str, list[str]]]] = {}
    for name, text in templates:
        if words := _plain_words(text):
            k = min(size, len(words))
            found.setdefault((k, 1 << (len(words) - k).bit_length()), []).append((name, words))
    return found


def _matches(words: Column, at: Column, known: Column, every: Column, k: int, stride: int, length: int, last: Column, bands: int) -> Column:
    """(name, containment, start) of the templates ``known`` that bands retrieve for windows over the words at ``at``.

    Windows over place p have numbers (p - k - length + 2) / stride, rounded up, to p / stride.
    """

    def numbers(p: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.ceil((p - k - length + 2) / stride).cast("int")), F.floor(p / stride).cast("int"))

    def window(w: Column) -> Column:
        own = _shingles(words, w * stride, F.least(w * stride + length - 1, last), k)
        return F.struct((w * stride).alias("start"), F.array_distinct(own).alias("shingles"))

    def with_keys(w: Column) -> Column:
        return F.struct(w["start"].alias("start"), w["shingles"].alias("shingles"), _band_keys(w["shingles"], bands).alias("keys"))

    def verified(w: Column) -> Column:
        retrieved = F.filter(known, lambda t: F.arrays_overlap(w["keys"], t["keys"]))
        share = lambda t: F.size(F.array_intersect(w["shingles"], t["shingles"])) / F.size(F.array_distinct(t["shingles"]))
        return F.transform(retrieved, lambda t: F.struct(t["name"].alias("name"), share(t).alias("containment"), w["start"].alias("start")))

    windows = F.transform(F.array_distinct(F.flatten(F.transform(at, numbers))), window)
    windows = F.transform(F.filter(windows, lambda w: F.size(w["shingles"]) > 0), with_keys)
    return F.flatten(F.transform(F.filter(windows, lambda w: F.arrays_overlap(w["keys"], every)), verified))


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, size: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """Per row: id and matches, an array of (name, containment, start) sorted by name: each template found, its best
    share of shingles and the first word, from 0, of the first window with that share.

    Windows without any anchor word cannot hold enough of a template and are never hashed; this loses no match.
    Bands retrieve templates for the others, and exact shingle containment decides. Null and empty
    texts match nothing; repeated rows and null ids give a row each. Everything is one projection over the
    scan: no shuffle, no broadcast but the templates themselves, which are literals.
    """
    text, words, at = F.col(text_col).cast("string"), F.col("_words"), F.col("_at")
    classes = _classes(list(templates), size, containment)
    needed = sorted({w for (k, _), own in classes.items() for _, ws in own for w in anchors(ws, k, containment)})
    literal = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    found = []
    for (k, most), own in classes.items():
        stride = max(1, most // 2)
        length = most + stride
        shingled = [(n, _template_shingles(ws, k)) for n, ws in own]
        keyed = [(n, hs, _template_keys(hs, bands)) for n, hs in shingled]
        known = F.array(*[F.struct(F.lit(n).alias("name"), literal(hs, "bigint").alias("shingles"), literal(ks, "bigint").alias("keys")) for n, hs, ks in keyed])
        every = literal(sorted({x for _, _, ks in keyed for x in ks}), "bigint")
        last = F.size(words) - k
        found.append(_matches(words, at, known, every, k, stride, length, last, bands))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("_text"))
    may = F.lit(False)
    lowered = F.lower("_text")
    for w in needed:
        may = may | lowered.contains(w)
    rows = rows.withColumn("_words", F.when(may, _words(F.col("_text"))))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(literal(needed, "string"), F.get(words, i)))
    rows = rows.select("id", "_words", F.when(F.size(words) > 0, places).alias("_at"))
    hits = F.filter(F.concat(*found), lambda m: m["containment"] >= containment - 1e-9)
    rows = rows.select("id", F.when(F.size(at) > 0, hits).alias("_hits"))
    names = F.array_sort(F.array_distinct(F.transform("_hits", lambda m: m["name"])))
    best = lambda n: F.array_max(F.transform(F.filter("_hits", lambda m: m["name"] == n), lambda m: F.struct(m["containment"].alias("containment"), (-m["start"]).alias("back"))))
    matches = F.transform(names, lambda n: F.struct(n.alias("name"), best(n)["containment"].alias("containment"), (-best(n)["back"]).alias("start")))
    return rows.select("id", F.coalesce(matches, F.array().cast("array<struct<name:string,containment:double,start:int>>")).alias("matches"))
