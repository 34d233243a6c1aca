"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the positions of license
templates. Each hit votes for the diagonal (document position minus template position)
it lies on, if the words behind the hashes are equal, too. A phrase that stands in the text word by word fills its diagonal; where words
were put in or left out, the votes lie on neighbouring diagonals, which are merged and
verified by the template's words they cover. Number words (versions) must be covered,
and the words that part a template from one without them (lesser, noncommercial).
Spans of several labels over the same words compete: each word goes to the best span
over it, and a label stays where a span of it keeps half of its words.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lower_ascii, table

K = 3
#: Diagonals up to this far apart are one span; a span longer than its template by more is not.
SLACK = 3
#: A merged span counts if it covers this share of the longer of template and span, and so many words.
MIN_SCORE, MIN_COVERED = 0.75, 6
#: More template k-grams than this are not broadcast.
BROADCAST_ROWS = 1_000_000
WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that are sought word by word.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Sentences, notices and headers of common licenses.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]

#: Headers that differ in the name and version of the license.
GNU_HEADER = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1} general public license as published by the free software foundation either version {2} of the license or at your option any later version"
GNU_REST = "this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1} general public license for more details"
GNU_SHORT = "licensed under the gnu {1} general public license version {2}"
GNU_NAMES = [("lgpl-2", "library", "lesser", "2 1"), ("lgpl-2", "library", "library", "2"), ("lgpl-3", "library", "lesser", "3"), ("agpl-3", "program", "affero", "3")]
CC_LONG = "this work is licensed under a creative commons attribution {0} {1} license"
CC_SHORT = "creative commons attribution {0} {1}"
CC_NAMES = [("cc-by", ""), ("cc-by-nc", "noncommercial"), ("cc-by-sa", "sharealike"), ("cc-by-nd", "noderivatives"), ("cc-by-nc-sa", "noncommercial sharealike"), ("cc-by-nc-nd", "noncommercial noderivatives")]
CC_VERSIONS = ["4 0 international", "3 0 unported"]
SPDX = "spdx license identifier {0}"
SPDX_NAMES = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2", "lgpl 2 0"), ("lgpl-2", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"),
    ("mpl-2", "mpl 2 0"), ("isc", "isc"), ("boost", "bsl 1 0"), ("zlib", "zlib"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"),
]

TEMPLATES += [(label, t.format(kind, name, version)) for label, kind, name, version in GNU_NAMES for t in (GNU_HEADER, f"{GNU_HEADER} {GNU_REST}", GNU_SHORT)]
TEMPLATES += [(label, " ".join(t.format(name, version).split())) for label, name in CC_NAMES for version in CC_VERSIONS for t in (CC_LONG, CC_SHORT)]
TEMPLATES += [(label, SPDX.format(name)) for label, name in SPDX_NAMES] + [(label, SPDX.format(f"{label.replace('-', ' ')} {v}")) for label, _ in CC_NAMES for v in ("3 0", "4 0")]


def distinguishing(label: str, words: list[str], others: list[tuple[str, list[str]]]) -> list[int]:
    """Positions of number words, and of up to two words that another label's template does without, being otherwise much the same."""
    out = {j for j, w in enumerate(words) if w.isdigit()}
    for name, other in others:
        if name != label and abs(len(other) - len(words)) <= 8:
            match = SequenceMatcher(None, words, other, autojunk=False)
            if match.real_quick_ratio() >= 0.8 and match.ratio() >= 0.8:
                out |= {j for tag, a, b, _, _ in match.get_opcodes() if tag == "delete" and b - a <= 2 for j in range(a, b)}
    return sorted(out)


def _words(text: Column) -> Column:
    return F.split(lower_ascii(text), WORDS)


def template_grams(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """gram, gram_words, template, j, n_template, label, exact, numbers (positions that must be covered): a row per k-gram of each template of at least ``K`` words."""
    split = [(label, phrase.split()) for label, phrase in [*base, *templates]]
    rows = [(t, label, " ".join(w), t < len(base), distinguishing(label, w, split)) for t, (label, w) in enumerate(split)]
    listed = spark.createDataFrame(rows, "template int, label string, phrase string, exact boolean, numbers array<int>")
    words = listed.withColumn("words", _words(F.col("phrase"))).withColumn("n_template", F.size("words"))
    each = words.select("*", F.explode(F.sequence(F.lit(0), F.col("n_template") - K)).alias("j"))
    return each.select(F.xxhash64(*[F.get("words", F.col("j") + k) for k in range(K)]).alias("gram"), F.slice("words", F.col("j") + 1, K).alias("gram_words"), "template", "j", "n_template", "label", "exact", "numbers")


def scan_licenses(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters (lower-cased) and digits and of other characters beyond
    ASCII. ``n_base`` counts all places of base phrases; ``spans`` lists (label, first word,
    words, score) of all spans found. Null and empty texts have no words, no labels and score
    0. Null and repeated ids are carried along, one result row per input row. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    edge = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
    end = F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    counted = rows.select("doc_id", "row", "words", edge.alias("edge"), (F.size("words") - edge - end).alias("n"))

    # position -1 stands for the document itself, and joins a row of its own
    each = counted.select("doc_id", "row", "words", "edge", "n", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n") - K, F.lit(-1)))).alias("i"))
    gram = F.xxhash64(*[F.get("words", F.col("i") + F.col("edge") + k) for k in range(K)])
    each = each.select("doc_id", "row", "words", "edge", F.col("n").cast("long").alias("n_words"), "i", F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(gram).alias("gram"), (F.col("i") < 0).alias("whole"))
    grams = template_grams(spark, base, templates).withColumn("whole", F.lit(False)).unionByName(
        spark.createDataFrame([(0, [], -1, 0, 0, None, False, [], True)], "gram bigint, gram_words array<string>, template int, j int, n_template int, label string, exact boolean, numbers array<int>, whole boolean"))
    if sum(len(p.split()) for _, p in [*base, *templates]) <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    # equal hashes are candidates; the words themselves decide
    same = reduce(Column.__and__, [F.get("words", F.col("i") + F.col("edge") + k) == F.get("gram_words", F.lit(k)) for k in range(K)])
    hits = each.join(grams, ["gram", "whole"]).where(F.col("whole") | same).select("doc_id", "row", "n_words", "i", "template", "j", "n_template", "label", "exact", "numbers")

    # one exchange by row; a row's hits are at most its words times the templates that share a k-gram
    votes = hits.repartition("row").groupBy("row", "doc_id", "n_words", "template", "n_template", "label", "exact", "numbers", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("i").alias("low"), F.max("i").alias("high"), F.collect_set("j").alias("js"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    full = (F.col("template") >= 0) & (F.col("votes") == F.col("n_template") - K + 1)
    marked = votes.withColumn("full", full).withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    # a chain may be too long as a whole and yet hold a clean diagonal, which is also judged alone
    marked = marked.withColumn("many", F.count("*").over(Window.partitionBy("row", "template", "span"))).withColumn("place", F.row_number().over(order))
    together = F.struct(F.col("span").cast("long").alias("span"), F.lit(False).alias("alone"))
    alone = F.struct((-F.col("place")).cast("long").alias("span"), F.lit(True).alias("alone"))
    ways = F.when((F.col("many") > 1) & (F.col("template") >= 0), F.array(together, alone)).otherwise(F.array(together))
    marked = marked.withColumn("s", F.explode(ways)).drop("span", "many", "place").select("*", "s.*").drop("s")

    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("js")), lambda j: F.sequence(j, j + (K - 1)))))
    spans = marked.groupBy("row", "doc_id", "n_words", "template", "n_template", "label", "exact", "numbers", "span", "alone").agg(
        covered.alias("js"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_if("full").alias("places"),
        F.min(F.when(F.col("full"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("full"), F.col("diagonal"))).alias("last"))
    length = F.col("high") - F.col("low") + K
    spans = spans.withColumn("covered", F.size("js")).withColumn("versioned", F.size(F.array_except("numbers", "js")) == 0)
    share = F.col("covered") / F.greatest(length, F.col("n_template"))
    score = F.when(F.col("places") > 0, 1.0).when(F.col("versioned") & (F.col("covered") >= MIN_COVERED) & (share >= MIN_SCORE) & (length <= F.col("n_template") + SLACK), share)
    based = F.col("exact") & (F.col("places") > 0) & ~F.col("alone")
    scored = spans.withColumn("length", length).withColumn("score", F.when(F.col("template") >= 0, score)).withColumn("based", based)
    # each word of a row goes to the best span over it
    best = F.max(F.struct("score", "covered", "label")).over(Window.partitionBy("row", "word"))
    found = scored.where(F.col("score").isNotNull() | (F.col("template") < 0)).withColumn("word", F.explode(F.when(F.col("template") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.col("low"), F.col("low") + F.col("length") - 1))))
    won = found.withColumn("best", best).withColumn("own", (F.col("best.label") == F.col("label")).cast("int"))
    kept = won.groupBy("row", "doc_id", "n_words", "template", "label", "span", "based", "places", "first", "last", "low", "length", "score").agg(F.avg("own").alias("own"))
    kept = kept.withColumn("stays", F.coalesce(F.col("own") >= 0.5, F.lit(False)) | F.col("based"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return kept.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(F.col("based"), F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("based"), F.col("first"))).cast("long").alias("first_word"), F.max(F.when(F.col("based"), F.col("last"))).cast("long").alias("last_word"),
        names(F.when(F.col("based"), F.col("label"))).alias("base_labels"), names(F.when(F.col("stays"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("stays"), F.col("score"))), F.lit(0.0)).alias("score"),
        F.collect_set(F.when(F.col("stays"), F.struct("label", F.col("low").alias("first_word"), F.col("length").alias("words"), "score"))).alias("spans"),
    ).drop("row")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
