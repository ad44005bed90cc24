"""License scans by diagonal voting, in DataFrame operations only.

Every text's words give rolling hashes of two and of three words, which are joined with the places of the same
hashes in the license templates. A hit at word p of a text and place q of a template votes for the diagonal p - q;
votes are gathered by (text, template, diagonal) as the set of places hit. Neighbouring diagonals (words put in or left
out) are merged into spans: all that lie from one diagonal up to ``drift`` above it, so no span is longer than the
template and ``drift`` words. A span is verified by its words, in order: going through the template's places, each
counts once, and only if its words (the hits are verified on the words themselves, not on hashes) stand after those of
the place counted before. It counts as a license if enough places are left. Phrases are templates whose one diagonal
must be hit at every place.

Texts are known by id and two hashes of the text; equal rows share their key, are scanned once each, and come out as
often as they came in. Only hits and one row per text are shuffled. The templates are a parameter with a checked
size, and broadcast.

Nulls and edges: a null text counts as empty: no words, null places, empty labels, score 0; a null id is an id like
any other. Overlapping places all count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: A word, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_TEMPLATE_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # lower-case words and spaces
    base: bool = False  # an exact phrase, at every place where its words stand


# License phrases, and sentences of common licenses and their notices.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("agpl", "licensed under the gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("boost-1.0", "distributed under the boost software license version 1 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
    Template("public-domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


@dataclass(frozen=True)
class LicenseSettings:
    drift: int = 6  # diagonals above its own that a span takes in
    coverage: float = 0.7  # of a template's places


def _grams(template: Template) -> list[str]:
    words = template.text.split()
    k = min(3, len(words))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def template_places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """hash, gram, template, place and the template's data, one row for each rolling gram."""
    rows = [(i, t.label, t.base, len(t.text.split()), len(_grams(t)), q, g) for i, t in enumerate(templates) for q, g in enumerate(_grams(t))]
    if sum(len(t.text.split()) for t in templates) > MOST_TEMPLATE_WORDS or any(len(t.text.split()) < 2 for t in templates):
        raise ValueError(f"templates need two words at least, and {MOST_TEMPLATE_WORDS} in all at most")
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, t_words int, t_grams int, place int, gram string")
    hashes = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    first, second, third = (F.get("hashes", F.lit(i)) for i in range(3))
    rolling = F.when(third.isNull(), F.xxhash64(first, second)).otherwise(F.xxhash64(first, second, third))
    return frame.withColumn("hashes", hashes).withColumn("hash", rolling).drop("hashes")


def _rolling(hashes: Column, k: int) -> Column:
    """Hashes of k neighbours at every place where k words follow."""
    most = F.greatest(F.size(hashes) - F.lit(k - 1), F.lit(0))
    return F.transform(F.slice(hashes, F.lit(1), most), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + F.lit(j)) for j in range(1, k)]))


def places_in_order(band: Column) -> Column:
    """How many distinct places of (diagonal, places) are hit in order: each at its first word, after that of the place counted before."""
    pairs = F.flatten(F.transform(band, lambda d: F.transform(d["places"], lambda q: F.struct(q.alias("place"), (d["diagonal"] + q).alias("p")))))
    start = F.struct(F.lit(-1).alias("place"), F.lit(-1).alias("p"), F.lit(0).alias("n"))

    def step(state: Column, pair: Column) -> Column:
        counts = (pair["place"] != state["place"]) & (pair["p"] > state["p"])
        return F.struct(pair["place"].alias("place"), F.when(counts, pair["p"]).otherwise(state["p"]).alias("p"), (state["n"] + counts.cast("int")).alias("n"))

    return F.aggregate(F.array_sort(pairs), start, step, lambda state: state["n"])


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, settings: LicenseSettings = LicenseSettings()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of (doc_id, text)."""
    places = F.broadcast(template_places(docs.sparkSession, templates))
    body = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", F.xxhash64(body).alias("key1"), F.xxhash64(F.lit(1), body).alias("key2"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"))
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    rolled = hashed.withColumn("pairs", _rolling(F.col("hashes"), 2)).withColumn("triples", _rolling(F.col("hashes"), 3))
    # place 0 stands for the text itself; then the pairs, then the triples
    every = rolled.select("doc_id", "key1", "key2", "words", F.size("words").alias("n_words"), F.size("pairs").alias("n_pairs"), F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.col("pairs"), F.col("triples"))).alias("at", "hash"))
    hits = every.join(places, "hash", "left").filter((F.col("at") == 0) | F.col("template").isNotNull())
    p = F.when(F.col("at") <= F.col("n_pairs"), F.col("at") - 1).otherwise(F.col("at") - 1 - F.col("n_pairs"))
    size = F.when(F.col("at") <= F.col("n_pairs"), 2).otherwise(3)
    here = F.translate(F.array_join(F.slice("words", F.col("p") + 1, F.col("size")), " "), UPPER, LOWER)
    hits = hits.withColumn("p", F.greatest(p, F.lit(0))).withColumn("size", size).withColumn("hit", F.coalesce((F.col("at") > 0) & (here == F.col("gram")), F.lit(False)))
    hits = hits.filter((F.col("at") == 0) | F.col("hit"))

    text = ["doc_id", "key1", "key2"]
    template = ["template", "label", "base", "t_words", "t_grams"]
    votes = hits.select(*text, "n_words", *[F.when(F.col("hit"), F.col(c)).alias(c) for c in template], F.when(F.col("hit"), F.col("p") - F.col("place")).alias("diagonal"), (F.col("at") == 0).cast("int").alias("row"), F.when(F.col("hit"), F.col("place")).alias("place"))
    # a set, so copies of a text vote once
    diagonals = votes.groupBy(*text, *template, "diagonal").agg(F.max("n_words").alias("n_words"), F.sum("row").alias("rows"), F.collect_set("place").alias("places"))
    band = W.partitionBy(*text, "template").orderBy("diagonal").rangeBetween(0, settings.drift)
    spans = diagonals.withColumns({"copies": F.sum("rows").over(W.partitionBy(*text)), "most": F.sum(F.size("places")).over(band), "band": F.collect_list(F.struct("diagonal", "places")).over(band)})
    needed = F.col("t_grams") * settings.coverage
    counted = F.when(F.col("base"), F.size("places")).when(F.col("most") >= needed, places_in_order(F.col("band"))).otherwise(0)
    share = counted / F.col("t_grams")
    found = spans.withColumn("share", share).withColumn("found", F.col("template").isNotNull() & F.when(F.col("base"), F.col("share") == 1.0).otherwise(counted >= needed))
    found = found.withColumn("low", F.col("diagonal"))  # a phrase begins where its diagonal does
    base = F.col("found") & F.col("base")

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    out = found.groupBy(*text, "copies").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    repeated = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan of every document."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle(settings: LicenseSettings = LicenseSettings()) -> str:
    rows = ", ".join(f"({i}, '{t.label}', {t.base}, {len(t.text.split())}, {len(_grams(t))}, {q}, {len(g.split())}, '{g}')" for i, t in enumerate(TEMPLATES) for q, g in enumerate(_grams(t)))
    return f"""
WITH t(template, label, base, t_words, t_grams, place, size, gram) AS (VALUES {rows}),
w AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), g AS (
  SELECT row_no, p, 2 AS size, words[p + 1] || ' ' || words[p + 2] AS gram FROM (SELECT row_no, words, unnest(range(len(words) - 1)) AS p FROM w)
  UNION ALL
  SELECT row_no, p, 3, words[p + 1] || ' ' || words[p + 2] || ' ' || words[p + 3] FROM (SELECT row_no, words, unnest(range(len(words) - 2)) AS p FROM w)
), d AS (
  SELECT DISTINCT row_no, template, label, base, t_grams, place, p, p - place AS diagonal FROM g JOIN t USING (gram, size)
), b AS (
  SELECT row_no, label, count(*)::DOUBLE / t_grams AS share, diagonal AS low FROM d WHERE base GROUP BY row_no, template, label, t_grams, diagonal
), n AS (
  SELECT a.row_no, a.template, a.label, a.t_grams, a.diagonal, d.place, min(d.p) AS p
  FROM (SELECT DISTINCT row_no, template, label, t_grams, diagonal FROM d WHERE NOT base) a
  JOIN d ON d.row_no = a.row_no AND d.template = a.template AND d.diagonal BETWEEN a.diagonal AND a.diagonal + {settings.drift}
  GROUP BY ALL
), o AS (
  SELECT *, p > coalesce(max(p) OVER (PARTITION BY row_no, template, diagonal ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS later FROM n
), f AS (
  SELECT row_no, label, true AS base, share, low FROM b WHERE share = 1
  UNION ALL
  SELECT row_no, label, false, count(*) FILTER (later)::DOUBLE / t_grams, diagonal FROM o GROUP BY row_no, template, label, t_grams, diagonal
  HAVING count(*) FILTER (later) >= t_grams * {settings.coverage}::DOUBLE
)
SELECT any_value(w.doc_id) AS doc_id, any_value(len(w.words))::BIGINT AS n_words, count(*) FILTER (f.base) AS n_base,
       min(f.low) FILTER (f.base)::BIGINT AS first_word, max(f.low) FILTER (f.base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels,
       coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels,
       coalesce(max(f.share), 0.0)::DOUBLE AS score
FROM w LEFT JOIN f USING (row_no) GROUP BY row_no
"""


ORACLE_OP3 = _oracle()
