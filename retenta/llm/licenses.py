"""Licence scans by diagonal voting.

Every run of k words of the templates is a table of hashes and places. Runs of a document that occur in it are joined; each
match votes for the diagonal (place in the document less place in the template). Diagonals next to each other, as left by
inserted or lost words, are merged, and the stretch they span is checked by the share of the template's words it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from retenta.llm.seeds import bloom_filter, passing, plain_words, seed_column
from retenta.session import stage

RUN = 4
#: Diagonals at most this far apart are one alignment.
GAP = 8
#: Least share of a template's words that an alignment covers.
COVER = 0.8

# Public licence notices and texts.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "cc-by": ("Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}
# Phrases that name a licence by themselves.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def templates(spark: SparkSession) -> DataFrame:
    """``template``, ``label`` and ``text`` of the library's own templates."""
    rows = [(f"{label}-{i}", label, text) for label, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "template string, label string, text string")


def _phrase_places(words: str) -> Column:
    """``at`` and ``label`` of every place where the words of a phrase stand one after another."""
    found = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        places = F.when(F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]),
                        F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        found.append(_labelled(places, words, parts, label))
    return F.concat(*found)


def _labelled(places: Column, words: str, parts: list[str], label: str) -> Column:
    def stands(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return hit
    return F.transform(F.filter(places, stands), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def alignments(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc``, ``label``, ``template``, ``start``, ``end`` (words of the document) and ``cover`` of every verified stretch.

    ``hits`` has ``doc``, ``template``, ``at`` and ``template_at``; ``sizes`` has ``template``, ``label`` and ``size``.
    Votes are counted per diagonal before anything is ordered. Alignments of a document with one template are cut where the
    next diagonal is more than ``GAP`` away, and where its first vote lies as far on as the template is long: there another copy
    begins.
    """
    votes = hits.groupBy("doc", "template", (F.col("at") - F.col("template_at")).alias("diagonal")).agg(
        F.min("at").alias("start"), (F.max("at") + RUN).alias("end"), F.collect_set("template_at").alias("places")).join(sizes, "template")
    order = Window.partitionBy("doc", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP) | (F.col("start") - F.lag("start").over(order) >= F.col("size"))
    merged = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(order)) \
        .groupBy("doc", "template", "label", "size", "group").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")) \
        .withColumn("places", F.array_sort("places"))
    gains = F.transform("places", lambda p, i: F.when(i == 0, RUN).otherwise(F.least(F.lit(RUN), p - F.get("places", i - 1))))
    return merged.withColumn("cover", F.aggregate(gains, F.lit(0), lambda s, x: s + x) / F.col("size")) \
        .filter(F.col("cover") >= COVER).select("doc", "label", "template", "start", "end", "cover")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``places`` (``at``, ``label`` of each phrase) and ``stretches`` (``label``,
    ``template``, ``start``, ``end``, ``cover`` of each verified alignment), both in order.

    Null texts count as empty; repeated rows and null ids stay, each row for itself; an empty table gives an empty result.
    ``wanted`` may name other templates (``template``, ``label``, ``text``); those shorter than four words find nothing.
    A row is known by its number within its partition, so neither null nor repeated ids are mixed up.
    """
    spark = docs.sparkSession
    wanted = templates(spark) if wanted is None else wanted
    texts = wanted.select("template", "label", plain_words(F.col("text")).alias("words"))
    texts = stage(texts.select("template", "label", F.transform("words", lambda w: F.xxhash64(w)).alias("hs")), "templates")
    offsets = tuple(range(RUN))
    runs = stage(texts.select("template", F.posexplode(seed_column(offsets, 0)).alias("template_at", "seed")), "runs")
    table, bits = bloom_filter(runs)
    words = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), plain_words(F.col(f"`{text_col}`")).alias("words"))
    hashed = words.select("doc_id", F.size("words").cast("bigint").alias("n_words"), _phrase_places("words").alias("places"),
                          F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    seeded = hashed.withColumn("seeds", seed_column(offsets, 0))
    found = F.transform(passing("seeds", RUN, table, bits, 0), lambda x: F.struct(x["at"], x["seed"]))
    rows = stage(seeded.select("doc_id", "n_words", F.array_sort("places").alias("places"), found.alias("found"),
                               F.monotonically_increasing_id().alias("doc")), "rows")
    hits = rows.select("doc", F.inline("found")).join(runs, "seed").select("doc", "template", "at", "template_at")
    spans = alignments(hits, texts.select("template", "label", F.size("hs").alias("size")))
    stretches = spans.groupBy("doc").agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "label", "template", "cover"))).alias("stretches"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,template:string,cover:double>>")
    return rows.join(stretches, "doc", "left").select("doc_id", "n_words", "places", F.coalesce("stretches", none).alias("stretches"))
