"""License scans by diagonal voting, in DataFrame functions only.

Every rolling pair of words of a text is joined by its hash, then its words, with the positions of the same pair in
license templates. A hit votes for the diagonal text position minus template position. A phrase or template stands
where all of its pairs vote for one diagonal; a changed template is found where neighbouring other diagonals, merged,
hold enough of its distinct pairs within a window of about its length, so that words may be changed, added or left out.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Null or empty text: no words, no labels,
score 0, null places. Rows equal in key and text get one result each; null keys take part. Only the key and the text
are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose every place is reported, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Wording of common license notices.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
        "mit",
    ),
    ("released under the mit license", "mit"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)

#: Pairs of two of these stand everywhere, and in templates they do not vote.
STOP = frozenset("a an and any are as at be by for from in is it of on or that the this to with you".split())
#: Diagonals this near are one match; a match needs this share of a template's pairs, within this many times its length.
GAP, COVERAGE, STRETCH = 4, 0.7, 1.5
#: Templates with so many pairs or fewer need all of them.
SHORT = 12
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text. The one non-ASCII character whose small letter is ASCII is kept from becoming it."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, _SEPARATORS), "")


def _tables(spark: SparkSession, phrases, templates) -> tuple[DataFrame, DataFrame]:
    """(template, position, a, b) of every voting pair; (template, label, phrase?, words, votes) of every template."""
    pairs, known = [], []
    for t, (text, label, is_phrase) in enumerate([*((p, b, True) for p, b in phrases), *((p, b, False) for p, b in templates)]):
        w = text.split()
        at = [i for i in range(len(w) - 1) if is_phrase or not (w[i] in STOP and w[i + 1] in STOP)]
        pairs += [(t, i, w[i], w[i + 1]) for i in at]
        known.append((t, label, is_phrase, len(w), len(at)))
    return (
        spark.createDataFrame(pairs, "template int, tpos int, ta string, tb string").withColumn("h", F.xxhash64("ta", "tb")),
        spark.createDataFrame(known, "template int, label string, phrase boolean, length int, pairs int"),
    )


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(key, th, label, phrase, start, stop, coverage): every place of a phrase and every match of a template; th is
    xxhash64 of the text, stop is exclusive, words count from 0."""
    pairs, known = _tables(docs.sparkSession, phrases, templates)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), words(F.col(text)).alias("w"))
    grams = rows.select("key", "th", "w", F.posexplode("w").alias("pos", "a")).select("key", "th", "pos", "a", F.get("w", F.col("pos") + 1).alias("b"))
    hits = grams.withColumn("h", F.xxhash64("a", "b")).join(F.broadcast(pairs), "h").where("a = ta and b = tb")
    votes = hits.select("key", "th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "pos")
    lines = votes.groupBy("key", "th", "template", "diagonal").agg(F.collect_set("pos").alias("at")).withColumn("votes", F.size("at"))
    lines = lines.join(F.broadcast(known), "template")

    whole = F.col("votes") == F.col("pairs")
    places = lines.where(whole).select("key", "th", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("stop"), F.lit(1.0).alias("coverage"))

    one = ("key", "th", "template")
    order = Window.partitionBy(*one).orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int")
    enough = lambda n: n / F.col("pairs") >= F.when(F.col("pairs") <= SHORT, 1.0).otherwise(COVERAGE)
    runs = lines.where(~F.col("phrase") & ~whole).withColumn("opens", F.coalesce(opens, F.lit(0))).withColumn("run", F.sum("opens").over(order))
    runs = runs.withColumn("all", F.sum("votes").over(Window.partitionBy(*one, "run"))).where(enough(F.col("all")))

    # a run is cut into tiles: a tile has the windows that start in its first half template, and all that they reach
    width, step = F.floor(F.col("length") * STRETCH + GAP), F.greatest(F.lit(1), F.floor(F.col("length") / 2))
    hits = runs.withColumn("pos", F.explode("at")).withColumn("width", width).withColumn("step", step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("step") - F.col("width")) / F.col("step")) + 1)
    hits = hits.withColumn("tile", F.explode(F.sequence(first, F.floor(F.col("pos") / F.col("step")))))
    tpos = lambda hs: F.array_distinct(F.transform(hs, lambda h: h["tpos"]))
    tiles = (
        hits.groupBy(*one, "run", "tile", "label", "phrase", "pairs", "width", "step")
        .agg(F.collect_list(F.struct("pos", (F.col("pos") - F.col("diagonal")).alias("tpos"))).alias("hits"))
        .where(enough(F.size(tpos(F.col("hits")))))
    )

    def window(start: Column) -> Column:
        inside = F.filter("hits", lambda h: (h["pos"] >= start) & (h["pos"] + 2 - start <= F.col("width")))
        stop = F.array_max(F.transform(inside, lambda h: h["pos"])) + 2
        return F.struct(F.size(tpos(inside)).alias("n"), (start - stop).alias("tight"), (-start).alias("before"))

    starts = F.filter(F.array_distinct(F.transform("hits", lambda h: h["pos"])), lambda p: p < (F.col("tile") + 1) * F.col("step"))
    best = tiles.withColumn("best", F.array_max(F.transform(starts, window))).where(enough(F.col("best.n")))
    spots = best.select(*one, "run", "label", "phrase", (-F.col("best.before")).alias("start"), (-F.col("best.before") - F.col("best.tight")).alias("stop"), (F.col("best.n") / F.col("pairs")).alias("coverage"))

    # of windows that overlap their neighbours in a run the better one stays
    near = Window.partitionBy(*one, "run").orderBy("start", "stop")
    rank = F.struct(F.col("coverage"), -F.col("start"))
    past, next_ = F.lag(F.struct("stop", rank.alias("rank"))).over(near), F.lead(F.struct("start", rank.alias("rank"))).over(near)
    found = spots.distinct().withColumn("past", past).withColumn("next", next_).withColumn("rank", rank)
    worse = ((F.col("past.stop") > F.col("start")) & (F.col("past.rank") > F.col("rank"))) | ((F.col("next.start") < F.col("stop")) & (F.col("next.rank") > F.col("rank")))
    found = found.where(~F.coalesce(worse, F.lit(False)))
    return places.unionByName(found.select(*places.columns))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word (of the phrases' places), base_labels, labels, score (the
    best coverage) and spans."""
    found = spans(docs, key, text, phrases, templates)
    base = F.col("phrase")
    per = found.groupBy("key", "th").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "stop", "label", "coverage"))).alias("spans"),
    )
    per = per.select(*(F.col(c).alias(f"_{c}") if c in ("key", "th") else F.col(c) for c in per.columns))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.size(words(F.col(text))).cast("bigint").alias("n_words"))
    return rows.join(per, F.col("key").eqNullSafe(F.col("_key")) & (F.col("th") == F.col("_th")), "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
