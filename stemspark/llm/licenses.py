"""Operator 4: license scans by diagonal voting, in DataFrame operations only.

Every document's rolling word k-gram hashes join the positions of the same hashes in short templates. A hit votes for the diagonal
(place in the document less place in the template). Neighbouring diagonals of a template merge, which lets words be missing or added,
and the merged span is verified by the share of the template's grams that voted; each vote is verified by all words of its gram.
Phrases are templates of two-grams that must vote in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_documents, whole_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: This method's own templates and labels.
TEMPLATES = {
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-text",
}
K, SHIFT, LEAST = 4, 2, 0.6


def words_of(text):
    """Of lower-cased text; lower-casing beyond A-Z neither adds nor joins words, and phrases are ASCII."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _template_rows(texts: dict[str, str], k: int, kind: str) -> list[tuple]:
    """(the gram's words, its entries: kind, template, label, grams of the template, place). Grams that recur have several entries."""
    rows: dict[tuple, list] = {}
    for t, (text, label) in enumerate(texts.items()):
        words = text.split()
        for p in range(len(words) - k + 1):
            rows.setdefault(tuple(words[p : p + k]), []).append((kind, t, label, len(words) - k + 1, p))
    return [(list(words), entries) for words, entries in rows.items()]


ENTRIES = "array<struct<kind:string,t:int,label:string,n:int,place:int>>"


def _grams_table(spark, texts: dict[str, str], k: int, kind: str) -> DataFrame:
    """One row a distinct gram of the templates, whatever the corpus: its hash, words and entries."""
    rows = spark.createDataFrame(_template_rows(texts, k, kind), f"words array<string>, entries {ENTRIES}")
    return rows.select(F.xxhash64(*(F.col("words")[i] for i in range(k))).alias(f"{kind}_h"), F.col("words").alias(f"{kind}_words"), F.col("entries").alias(f"{kind}_entries"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row for each row of docs.

    Null text is empty: no words, no labels, score 0. Rows that repeat a doc_id and its text are scanned as one and returned as often
    as they occur; null doc_ids and rows that share a doc_id only are scanned apart.
    """
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    base, own = (F.broadcast(_grams_table(spark, texts, k, kind)) for texts, k, kind in ((phrases, 2, "base"), (templates, K, "own")))
    text = docs.select(F.col("doc_id").alias("_doc"), whole_text().alias("_text"))
    words = text.select("_doc", F.xxhash64("_text").alias("_sum"), words_of(F.col("_text")).alias("_w")).withColumn("_n", F.size("_w").cast("long"))
    rows = words.select("_doc", "_sum", "_n", "_w", F.posexplode_outer("_w").alias("_pos", "_word"))
    gram = lambda k: F.xxhash64("_word", *(F.get("_w", F.col("_pos") + i) for i in range(1, k)))
    same = lambda k, kind: (gram(k) == F.col(f"{kind}_h")) & (F.slice("_w", F.col("_pos") + 1, k) == F.col(f"{kind}_words"))
    hits = rows.join(base, same(2, "base"), "left").join(own, same(K, "own"), "left")
    begins = F.coalesce("_pos", F.lit(0)) == 0  # this row stands for its document even without a hit
    hits = hits.where(F.col("base_h").isNotNull() | F.col("own_h").isNotNull() | begins)
    none, itself = F.expr(f"cast(array() AS {ENTRIES})"), F.expr(f"cast(array(named_struct('kind', 'row', 't', null, 'label', null, 'n', null, 'place', 0)) AS {ENTRIES})")
    entries = F.concat(F.coalesce("base_entries", none), F.coalesce("own_entries", none), F.when(begins, itself).otherwise(none))
    votes = hits.select("_doc", "_sum", "_n", F.coalesce("_pos", F.lit(0)).alias("_pos"), F.explode(entries).alias("v")).select("_doc", "_sum", "_n", "v.*", (F.col("_pos") - F.col("v.place")).cast("long").alias("diagonal"))
    diagonals = votes.groupBy("_doc", "_sum", "_n", "kind", "t", "label", "n", "diagonal").agg(F.collect_set("place").alias("places"), F.count("*").alias("copies"))
    order = Window.partitionBy("_doc", "_sum", "kind", "t").orderBy("diagonal")
    near = (F.col("kind") == "own") & (F.col("diagonal") - F.lag("diagonal").over(order) <= SHIFT)
    runs = diagonals.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("_doc", "_sum", "_n", "kind", "t", "label", "n", "run").agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("grams"), F.max("copies").alias("copies"))
    spans = spans.withColumn("share", F.col("grams") / F.col("n")).withColumn("ok", F.when(F.col("kind") == "base", F.col("grams") == F.col("n")).when(F.col("kind") == "own", F.col("share") >= LEAST))
    is_base = F.coalesce(F.col("ok") & (F.col("kind") == "base"), F.lit(False))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans.groupBy("_doc", "_sum", "_n").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(F.coalesce("ok", F.lit(False))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.least("share", F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("kind") == "row", F.col("copies"))).alias("_copies"),
    )
    # two steps, so that no array is as long as the rows of one document are many
    found = found.withColumn("_part", F.explode(F.expr("sequence(0L, (_copies - 1) div 10000)"))).withColumn("_copy", F.explode(F.expr("sequence(1L, least(10000L, _copies - 10000 * _part))")))
    return found.select(F.col("_doc").alias("doc_id"), F.col("_n").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read_documents(spark, sf_dir))
