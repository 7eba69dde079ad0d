"""License scan: finds the notices of known licenses in texts, with DataFrame functions only.

A text becomes lower-case words (letters and digits) and shingles of five words. Overlapping windows of shingles
are cut for every size class of templates, so that each run as long as a template lies whole in one window. A
window's MinHash signature is the ``bands`` smallest of its hashed shingles (one permutation, one row to a band).
A window and a template that share a band are compared exactly: the share of the template's shingles, as strings,
that the window holds.

Guarantee: a class holds templates of more than half its length L, and its windows are max(2 L, bands) long, so at
containment 0.8 the Jaccard similarity is 0.19 or more and all bands miss with probability under
0.81 ** 32 = 0.0012. Windows of up to ``bands`` shingles keep every shingle, so templates of up to
``bands`` / 2 shingles whose windows are that short cannot be missed at all.

Defined cases: null texts count as empty; texts and templates of fewer than five words never match; a null
``doc_id`` is a document of its own kind; rows that repeat a ``doc_id`` give one result for each license, the best;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import texts

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
SMALLEST_CLASS = 8
# Templates are broadcast while all of them together are shorter than this; beyond it they are joined by shuffle.
BROADCAST_CHARS = 4_000_000

# The wording of public license notices.
TEMPLATES: dict[str, str] = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-2.0": (
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License"),
    "GPL-3.0": (
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License"),
    "LGPL-2.1": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License"),
    "LGPL-3.0": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License"),
    "AGPL-3.0": (
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so"),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "OFL-1.1": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, "
        "and is also available with a FAQ at: https://scripts.sil.org/OFL"),
    "PostgreSQL": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without "
        "fee, and without a written agreement is hereby granted, provided that the above copyright notice and this "
        "paragraph and the following two paragraphs appear in all copies."),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens: Column) -> Column:
    """The five-word shingles as strings, in order; none if there are fewer words."""
    count = F.size(tokens) - (SHINGLE - 1)
    return F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, SHINGLE), " "))).otherwise(
            F.array().cast("array<string>"))


def hashes(tokens: Column) -> Column:
    """One hash for each shingle, without building its string."""
    count = F.size(tokens) - (SHINGLE - 1)
    return F.when(count > 0, F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(SHINGLE))))).otherwise(
            F.array().cast("array<bigint>"))


def signature(window: Column, bands: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(window)), 1, bands)


def size_class(length: int) -> int:
    size = SMALLEST_CLASS
    while size < length:
        size *= 2
    return size


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT,
         bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``license_id`` and the best ``containment`` of each license found in a document."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    small = F.broadcast if sum(map(len, templates.values())) <= BROADCAST_CHARS else (lambda df: df)

    given = spark.createDataFrame(list(templates.items()), "license_id string, text string").select(
        "license_id", words(F.col("text")).alias("words")).select(
        "license_id", shingles(F.col("words")).alias("wanted"), hashes(F.col("words")).alias("hashes")).where(
        F.size("wanted") > 0).withColumn("size", F.size("hashes"))
    longest = max((len(t.split()) + t.count("-") + t.count("/") + t.count(".") for t in templates.values()), default=0)
    sizes, size = [SMALLEST_CLASS], SMALLEST_CLASS
    while size < longest:
        size *= 2
        sizes.append(size)
    given = given.withColumn("class", F.least(*(
        F.when(F.col("size") <= s, F.lit(s)).otherwise(F.lit(sizes[-1])) for s in sizes))
        if len(sizes) > 1 else F.lit(sizes[0]))
    used = sorted(r[0] for r in given.select("class").distinct().collect())  # a handful of sizes
    if not used:
        return docs.sparkSession.createDataFrame([], "doc_id long, license_id string, containment double")
    keys = given.select("license_id", "class", F.explode(signature(F.col("hashes"), bands)).alias("band"))

    def windows(size: int) -> Column:
        length = max(2 * size, bands)
        step = length - size
        last = F.greatest(F.size("hashes") - size - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda start: F.struct(
            F.lit(size).alias("class"), start.alias("start"),
            signature(F.slice("hashes", start + 1, length), bands).alias("bands")))

    candidates = (
        texts(docs).select("doc_id", words(F.col("text")).alias("words"))
        .where(F.size("words") >= SHINGLE)
        .select("doc_id", "words", hashes(F.col("words")).alias("hashes"))
        .select("doc_id", "words", F.explode(F.concat(*(windows(s) for s in used))).alias("window"))
        .select("doc_id", "words", "window.class", "window.start", F.explode("window.bands").alias("band"))
        .join(small(keys), ["band", "class"]))
    length = F.greatest(2 * F.col("class"), F.lit(bands)) + (SHINGLE - 1)
    found = (
        candidates.select("doc_id", "license_id", F.slice("words", F.col("start") + 1, length).alias("words"))
        .select("doc_id", "license_id", shingles(F.col("words")).alias("held"))
        .join(small(given.select("license_id", F.array_distinct("wanted").alias("wanted"))), "license_id")
        .select("doc_id", "license_id", (
            F.size(F.array_intersect("wanted", "held")) / F.size("wanted")).alias("containment"))
        .where(F.col("containment") >= containment))
    return found.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"))


def oracle(templates: dict[str, str] | None = None, containment: float = CONTAINMENT, bands: int = BANDS) -> str:
    """DuckDB SQL that compares every window with every template."""
    templates = TEMPLATES if templates is None else templates
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates.items())

    def cut(text: str) -> str:
        return (f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), "
                "lambda x: x <> '')")

    def five(tokens: str) -> str:
        return f"[array_to_string({tokens}[i:i + 4], ' ') for i in range(1, len({tokens}) - 3)]"

    return f"""
WITH given AS (SELECT license_id, {cut('body')} AS w FROM (VALUES {values}) AS v(license_id, body)),
wanted AS (SELECT license_id, list_distinct({five('w')}) AS s, len(w) - 4 AS n FROM given WHERE len(w) >= 5),
classed AS (SELECT license_id, s, {SMALLEST_CLASS} * pow(2, greatest(0, ceil(log2(n / {SMALLEST_CLASS}))))::BIGINT AS c
            FROM wanted),
tokens AS (SELECT doc_id, {cut('text')} AS w FROM documents),
held AS (SELECT doc_id, {five('w')} AS h FROM tokens WHERE len(w) >= 5),
compared AS (
  SELECT doc_id, license_id, len(list_intersect(s, h[b + 1 : b + greatest(2 * c, {bands})]))::DOUBLE / len(s) AS part
  FROM (SELECT doc_id, license_id, s, h, c, unnest(range(
          0, greatest(len(h) - c - 1, 0) + 1, greatest(2 * c, {bands}) - c)) AS b
        FROM held, classed))
SELECT doc_id, license_id, max(part) AS containment FROM compared WHERE part >= {containment}
GROUP BY doc_id, license_id"""
