"""Licence scans by a positional index of licence words, by built-in functions only.

Every template and phrase is indexed as postings (word, template, place). A phrase, base ones too, is proposed by the rarest of its
words alone (by inverse document frequency over all documents), a place being the difference of the word's position in the
text and in the phrase, and stands where every posting of it agrees. A notice is proposed where the rarest of its mandatory
phrases stands: it must stand anyway, so no notice is missed, and none hides another. The other mandatory phrases have to
stand too, and enough weight of all its words has to agree. Words inserted or left out shift what follows, so both may be out of
place by as many words as the notice has.

A text is split once. Texts without all words of some phrase are settled by that; the others keep their words. Each row has a
number of its own: repeated rows and rows with a null id are scanned each for themselves. Null and empty texts have no words
and no labels. Words of a very long text are rows by position, so none of the joins has a whole text for a key, however often a
phrase repeats in it. All places of a phrase count; labels that tie are all given. An empty table gives an empty result;
columns other than id and text are left behind. The index and the document frequencies are as large as the templates, so
they are broadcast.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.tables import texts
from ruleloom.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices in common use: (label, text, phrases of it that must stand).
NOTICES = [
    ("mit", "Released under the MIT License", ["the mit license"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
        ["apache license version 2 0", "in compliance with the license"],
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    (
        "gpl-3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or any later version",
        ["gnu general public license", "version 3 of the license"],
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    (
        "cc-by-nc",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ["creative commons attribution noncommercial 4 0"],
    ),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ["redistribution and use in source and binary forms", "are permitted provided that"],
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ["mozilla public license v 2 0"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "with or without fee is hereby granted"],
    ),
    ("lgpl-3", "under the GNU Lesser General Public License, version 3", ["gnu lesser general public license version 3"]),
    (
        "lgpl-3",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or any later version",
        ["gnu lesser general public license", "version 3 of the license"],
    ),
    ("agpl-3", "under the GNU Affero General Public License, version 3", ["gnu affero general public license version 3"]),
    (
        "agpl-3",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or any later version",
        ["gnu affero general public license", "version 3 of the license"],
    ),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", ["cc0 1 0 universal"]),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ["free and unencumbered software released into the public domain"],
    ),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ["boost software license version 1 0"]),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software",
        ["provided as is without any express or implied warranty", "in no event will the authors be held liable"],
    ),
]

# Identifiers of licence lines with their labels.
IDENTIFIERS = {
    "MIT": "mit",
    "Apache-2.0": "apache-2",
    "GPL-3.0": "gpl-3",
    "LGPL-3.0": "lgpl-3",
    "AGPL-3.0": "agpl-3",
    "BSD-2-Clause": "bsd",
    "BSD-3-Clause": "bsd",
    "MPL-2.0": "mpl-2",
    "ISC": "isc",
    "CC-BY-4.0": "cc-by",
    "CC-BY-NC-4.0": "cc-by-nc",
    "CC0-1.0": "cc0",
    "Unlicense": "unlicense",
    "BSL-1.0": "bsl-1",
    "Zlib": "zlib",
}
NOTICES += [(label, f"SPDX-License-Identifier: {name}", [f"spdx license identifier {name}"]) for name, label in IDENTIFIERS.items()]

#: Least share of a template's weight that must agree with a place.
AGREE = 0.6
#: Positions of a text that are joined under one key.
BIN = 64


def spelled(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def words(text: Column) -> Column:
    """Words of a text: A-Z lowered, then runs of anything but ASCII marks, blanks and controls."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    spaced = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


class Index:
    """Postings of base phrases, mandatory phrases and notices."""

    def __init__(self, base: dict[str, str], notices: list[tuple[str, str, list[str]]]):
        self.units: list[tuple[str, str, list[str]]] = []  # kind, label, words
        self.must: list[tuple[int, int, int]] = []  # notice, phrase, its place in the notice
        numbers: dict[tuple[str, ...], int] = {}
        for phrase, label in base.items():
            self.units.append(("base", label, spelled(phrase)))
        for label, text, phrases in notices:
            whole = spelled(text)
            notice = len(self.units)
            self.units.append(("notice", label, whole))
            for phrase in phrases:
                own = spelled(phrase)
                at = next(i for i in range(len(whole)) if whole[i : i + len(own)] == own)
                if tuple(own) not in numbers:
                    numbers[tuple(own)] = len(self.units)
                    self.units.append(("phrase", "", own))
                self.must.append((notice, numbers[tuple(own)], at))
        self.words = sorted({w for _, _, ws in self.units for w in ws})

    def complete(self, own: Column) -> Column:
        """Whether a text with the index words `own` has all words of some phrase; without that it has no label."""
        phrases = {tuple(sorted(set(ws))) for kind, _, ws in self.units if kind != "notice"}
        return reduce(or_, [F.size(F.array_except(F.array(*map(F.lit, ws)), own)) == 0 for ws in sorted(phrases)], F.lit(False))

    def rarest(self, weight: dict[str, float]) -> dict[int, tuple[str, int]]:
        """The word of largest weight of every phrase, base ones too, and its first place there."""
        best = {u: max(ws, key=lambda w: (weight[w], w)) for u, (kind, _, ws) in enumerate(self.units) if kind != "notice"}
        return {u: (w, self.units[u][2].index(w)) for u, w in best.items()}

    def keys(self, spark: SparkSession, weight: dict[str, float]) -> DataFrame:
        """(word, unit, at, n): the one posting that proposes a phrase."""
        rows = [(w, u, at, len(self.units[u][2])) for u, (w, at) in self.rarest(weight).items()]
        return spark.createDataFrame(rows, "word string, unit int, at int, n int")

    def leads(self, spark: SparkSession, weight: dict[str, float]) -> DataFrame:
        """(phrase, notice, label, at, n, total): the one mandatory phrase that proposes a notice."""
        rarest, rows = self.rarest(weight), []
        for notice in sorted({m[0] for m in self.must}):
            _, label, ws = self.units[notice]
            _, phrase, at = max((m for m in self.must if m[0] == notice), key=lambda m: (weight[rarest[m[1]][0]], -m[2]))
            rows.append((phrase, notice, label, at, len(ws), float(sum(weight[w] for w in ws))))
        return spark.createDataFrame(rows, "unit int, notice int, label string, at int, n int, total double")

    def postings(self, spark: SparkSession, weight: dict[str, float], notices: bool) -> DataFrame:
        chosen = [(u, ws) for u, (kind, _, ws) in enumerate(self.units) if (kind == "notice") == notices]
        return spark.createDataFrame([(u, i, w, weight[w]) for u, ws in chosen for i, w in enumerate(ws)], "unit int, at int, word string, weight double")


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: list[tuple[str, str, list[str]]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    spark = docs.sparkSession
    index = Index(base, notices)
    split = texts(docs).select("doc_id", words(F.col("text")).alias("words"))
    split = split.withColumn("own", F.array_intersect(F.array(*map(F.lit, index.words)), F.col("words")))
    kept = split.select("doc_id", F.size("words").cast("long").alias("n_words"), "own", F.when(index.complete(F.col("own")), F.col("words")).alias("words"))
    all_ = stage(kept.withColumn("row", F.monotonically_increasing_id()), "licence-texts")
    # One row for each word of the index at most.
    counted = all_.select(F.explode("own").alias("word")).groupBy("word").count().collect()
    frequency = {r["word"]: r["count"] for r in counted}
    top = max(frequency.values(), default=0)
    weight = {w: math.log((top + 1) / (frequency.get(w, 0) + 1)) + 0.1 for w in index.words}
    found = _labels(spark, all_.where(F.col("words").isNotNull()), index, weight)
    out = all_.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _bin(position: Column) -> Column:
    return F.floor(position / BIN).cast("int")


def _bins(first: Column, last: Column) -> Column:
    """The bins that positions first to last lie in."""
    return F.explode(F.sequence(_bin(first), _bin(last)))


def _standing(hits: DataFrame, keys: DataFrame, postings: DataFrame) -> DataFrame:
    """(row, unit, place): where every word of a phrase stands. Only its rarest word proposes places."""
    proposed = hits.join(F.broadcast(keys), "word").select("row", "unit", "n", (F.col("pos") - F.col("at")).alias("place"))
    spelt = proposed.join(F.broadcast(postings), "unit").select("row", "unit", "n", "place", (F.col("place") + F.col("at")).alias("pos"), "word")
    agreed = spelt.join(hits, ["row", "pos", "word"]).groupBy("row", "unit", "place", "n").agg(F.count("*").alias("matched"))
    return agreed.where("matched = n").select("row", "unit", "place")


def _agreeing(hits: DataFrame, proposed: DataFrame, postings: DataFrame) -> DataFrame:
    """`proposed` places of notices (row, notice, label, n, total, place) of which enough weight agrees, with the `share` of it."""
    window = proposed.withColumn("bin", _bins(F.col("place") - F.col("n"), F.col("place") + 2 * F.col("n")))
    met = window.join(hits.withColumn("bin", _bin(F.col("pos"))), ["row", "bin"])
    met = met.join(F.broadcast(postings.withColumnRenamed("unit", "notice").withColumnRenamed("at", "own_at")), ["notice", "word"])
    met = met.where(F.abs(F.col("pos") - F.col("place") - F.col("own_at")) <= F.col("n"))
    words_met = met.groupBy("row", "notice", "label", "n", "total", "place").agg(F.collect_set(F.struct("own_at", "weight")).alias("met"))
    weight = F.aggregate("met", F.lit(0.0), lambda total, m: total + m["weight"])
    return words_met.withColumn("share", weight / F.col("total")).where(F.col("share") >= AGREE).drop("met")


def _verified(likely: DataFrame, there: DataFrame, must: DataFrame, needs: DataFrame) -> DataFrame:
    """The likely notices whose mandatory phrases all stand near their places: (row, more labels, share)."""
    due = F.col("place") + F.col("at")
    wanted = likely.join(F.broadcast(must), "notice").withColumn("due", due).withColumn("bin", _bins(F.col("due") - F.col("n"), F.col("due") + F.col("n")))
    stood = there.select("row", F.col("unit").alias("phrase"), F.col("place").alias("stood"), _bin(F.col("place")).alias("bin"))
    checked = wanted.join(stood, ["row", "phrase", "bin"]).where(F.abs(F.col("stood") - F.col("due")) <= F.col("n"))
    checked = checked.groupBy("row", "notice", "label", "place").agg(F.count_distinct("phrase").alias("standing"), F.max("share").alias("share"))
    whole = checked.join(F.broadcast(needs), "notice").where("standing = needed")
    return whole.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))


def _labels(spark: SparkSession, near: DataFrame, index: Index, weight: dict[str, float]) -> DataFrame:
    """What was found in each row of `near`."""
    must = spark.createDataFrame(index.must, "notice int, phrase int, at int")
    needs = spark.createDataFrame([(u, sum(m[0] == u for m in index.must)) for u in {m[0] for m in index.must}], "notice int, needed long")
    known = F.broadcast(spark.createDataFrame([(w,) for w in index.words], "word string"))
    base = spark.createDataFrame([(u, label) for u, (kind, label, _) in enumerate(index.units) if kind == "base"], "unit int, label string")
    hits = stage(near.select("row", F.posexplode("words").alias("pos", "word")).join(known, "word"), "licence-words")
    there = stage(_standing(hits, index.keys(spark, weight), index.postings(spark, weight, False)), "licence-phrases")

    proposed = there.join(F.broadcast(index.leads(spark, weight)), "unit").withColumn("place", F.col("place") - F.col("at")).drop("unit", "at")
    likely = _agreeing(hits, proposed, index.postings(spark, weight, True))
    verified = _verified(likely, there, must, needs)
    plain = there.join(F.broadcast(base), "unit").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"), F.collect_set("label").alias("own")
    )
    none = F.array().cast("array<string>")
    both = plain.join(verified, "row", "full_outer")
    labels = F.sort_array(F.array_union(F.coalesce("own", none), F.coalesce("more", none)))
    return both.select(
        "row", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array(F.coalesce("own", none)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("share"))).alias("score"),
    )
