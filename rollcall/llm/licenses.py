"""License scan by diagonal voting.

All rolling word k-grams of the documents are joined to the places where the templates have
them. A hit votes for a diagonal, its place in the document less its place in the template: text
that quotes a template votes for one diagonal again and again, and a word put in or left out moves the votes to a
neighbouring one. Neighbouring diagonals are merged, and what they cover of the template is the score.
The join is on the words themselves, behind a broadcast set of their hashes, so each vote is verified; a base
phrase stands where its diagonal has all its votes.

Defined results: null and empty texts have no words and no labels, and score 0. Documents repeated
with the same id and text come back as often as they came. An empty table gives no rows. Other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.llm.common import let, places, words
from rollcall.llm.decontaminate import window_key, word_keys

K = 3
# A label needs so much of a template; neighbouring diagonals are up to so many words apart.
ENOUGH, APART = 0.6, 4
# How far the diagonals of one span may lie apart in all, as a share of the template.
DRIFT = 0.2

# The base phrases, and templates of the licenses looked for.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd-3-clause", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
]


def templates() -> list[tuple[int, str, list[str], bool]]:
    """(number, label, words, whether it is a base phrase)."""
    rows = [(label, text.split(), True) for text, label in PHRASES.items()] + [(label, text.split(), False) for label, text in TEMPLATES]
    return [(i, label, ws, base) for i, (label, ws, base) in enumerate(rows)]


def positions(spark: SparkSession) -> DataFrame:
    """(gram, key, template, tpos): every k-gram of every template. A fixed few hundred rows."""
    rows = [(" ".join(ws[p : p + K]), i, p) for i, _, ws, _ in templates() for p in range(len(ws) - K + 1)]
    grams = spark.createDataFrame(rows, "gram string, template int, tpos int")
    return grams.withColumn("key", window_key(word_keys(F.split("gram", " "))))


def hit_places(ws: Column, keys: list[int]) -> Column:
    """(pos, gram) of the k-grams whose hash some template has; pos from 0."""

    def of(ws: Column) -> Column:
        hit = let(word_keys(ws), lambda hs: F.filter(places(F.size(ws) - K + 1), lambda i: window_key(F.slice(hs, i, K)).isin(keys)))
        return F.transform(hit, lambda i: F.struct((i - 1).alias("pos"), F.array_join(F.slice(ws, i, K), " ").alias("gram")))

    return let(ws, of)


def coverage(diagonals: Column, template: int, grams: int) -> Column:
    """The largest share of a template's k-grams in one aligned span."""
    own = F.array_sort(F.filter(diagonals, lambda d: d["template"] == template))
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("best"), none.alias("covered"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, d: Column) -> Column:
        near = (d["diagonal"] - acc["last"] <= APART) & (d["diagonal"] - acc["first"] <= max(APART, int(DRIFT * grams)))
        first = F.when(F.coalesce(near, F.lit(False)), acc["first"])
        covered = F.array_union(F.when(first.isNull(), none).otherwise(acc["covered"]), d["places"])
        return let(
            covered,
            lambda covered: F.struct(
                F.greatest(acc["best"], F.size(covered)).alias("best"), covered.alias("covered"), F.coalesce(first, d["diagonal"]).alias("first"), d["diagonal"].alias("last")
            ),
        )

    return F.aggregate(own, zero, step)["best"] / grams


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    known = positions(docs.sparkSession)
    keys = sorted({r[0] for r in known.select("key").collect()})  # fixed by the templates
    ws = words(F.col("text"))
    # Every row brings a mark besides its hits, so that rows are counted and none is lost.
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("same"),
        let(ws, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.concat(mark, hit_places(ws, keys)).alias("hits"))).alias("x"),
    ).select("doc_id", "same", F.col("x.n").alias("n_words"), F.inline("x.hits"))
    votes = (
        rows.join(F.broadcast(known.drop("key")), "gram", "left")
        .where("pos < 0 or template is not null")
        .groupBy("doc_id", "same", "n_words", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        # At most as many places as a template has.
        .agg(F.count(F.lit(1)).alias("votes"), F.array_sort(F.collect_set("tpos")).alias("places"))
    )
    each = votes.groupBy("doc_id", "same", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("votes"))).alias("copies"),
        F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "votes", "places"))).alias("found"),
    )
    own = F.transform("found", lambda d: F.struct(d["template"].alias("template"), d["diagonal"].alias("diagonal"), (d["votes"] / F.col("copies")).alias("votes"), d["places"].alias("places")))
    all_ = templates()
    grams = {i: len(w) - K + 1 for i, _, w, _ in all_}
    phrase = [i for i, _, _, base in all_ if base]
    labels = F.array(*[F.lit(label) for _, label, _, _ in all_])
    need = F.array(*[F.lit(float(grams[i])) for i, *_ in all_])

    def result(found: Column) -> Column:
        stands = F.filter(found, lambda d: d["template"].isin(phrase) & (d["votes"] >= F.get(need, d["template"])))

        def with_base(stands: Column) -> Column:
            base = F.array_distinct(F.transform(stands, lambda d: F.get(labels, d["template"])))
            covers = F.array(*[F.struct(coverage(found, i, grams[i]).alias("share"), F.lit(label).alias("label")) for i, label, _, _ in all_])

            def whole(covers: Column) -> Column:
                more = F.transform(F.filter(covers, lambda c: c["share"] >= ENOUGH), lambda c: c["label"])
                return F.struct(
                    F.size(stands).cast("long").alias("n_base"),
                    F.array_min(F.transform(stands, lambda d: d["diagonal"])).cast("long").alias("first_word"),
                    F.array_max(F.transform(stands, lambda d: d["diagonal"])).cast("long").alias("last_word"),
                    F.array_join(F.array_sort(base), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
                    F.array_max(F.transform(covers, lambda c: c["share"])).alias("score"),
                )

            return let(covers, whole)

        return let(stands, with_base)

    return (
        each.withColumn("r", let(own, result))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "n_words", "r.*")
    )
