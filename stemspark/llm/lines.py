"""Operator 3: line deduplication, in DataFrame operations only.

Each line becomes (two 64-bit hashes of its key, document, position). These rows are range-partitioned and sorted by hash, document
and position, so a line found everywhere spreads over as many partitions as its rows need; every partition streams its first
occurrences by document, and what crosses partitions are counts. Documents get back only bitmaps of their dropped lines, in words
of 62 bits up to the last one that drops a line; documents that keep all lines get none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, guarded, read_documents, spread_join, whole_text

MIN_DOCS, MIN_CHARS, WORD = 10, 1, 62
SPACES = " \t\n\x0b\f\r"


def split_lines(text):
    return F.split(text, "\n", -1)


def key_of(line):
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _identified(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and text; rows that repeat both get the same bitmap and count as so many documents."""
    return docs.select(F.col("doc_id").alias("_doc"), whole_text().alias("_text")).withColumn("_sum", F.xxhash64("_text"))


def drop_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """_doc, _sum, _runs: by document with a dropped line, its bitmap: bit p % 62 of word p // 62 is set if line p goes.

    A run is (gap, bits): so many words of zeros, then a word. Lines are hashed once and written, since finding the ranges reads
    them as well. keep_first: the first occurrence (by doc_id, position) of each such line stays. Null doc_ids come first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = _identified(docs).select("_doc", "_sum", F.posexplode(split_lines(F.col("_text"))).alias("_pos", "_line")).withColumn("_key", key_of(F.col("_line"))).where(F.char_length("_key") >= max(min_chars, 1))
    rows = cut(lines.select(F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g"), "_doc", "_sum", "_pos"))
    rows = cut(rows.repartitionByRange(n, "_h", "_g", "_doc", "_sum").sortWithinPartitions("_h", "_g", "_doc", "_sum", "_pos"))
    # rows that repeat a document have a key at the same places, so the rows at one place are its copies
    by_place = rows.groupBy("_h", "_g", "_doc", "_sum", "_pos").agg(F.count("*").alias("_n"))
    by_document = by_place.groupBy("_h", "_g", "_doc", "_sum").agg(F.min("_pos").alias("_pos"), F.sum("_n").alias("_n"), F.max("_n").alias("_copies"))
    found = by_document.groupBy("_h", "_g").agg(F.sum("_copies").alias("_docs"), F.sum("_n").alias("_rows"), F.min(F.struct("_doc", "_sum", "_pos")).alias("_first")).where(F.col("_docs") >= min_docs)
    hits = spread_join(rows, cut(found if keep_first else found.drop("_first")), ["_h", "_g"], "_rows")
    if keep_first:
        hits = hits.where(~F.struct("_doc", "_sum", "_pos").eqNullSafe(F.col("_first")))
    words = hits.groupBy("_doc", "_sum", F.floor(F.col("_pos") / WORD).cast("int").alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, _pos % {WORD})")).alias("_bits"))
    by_doc = words.groupBy("_doc", "_sum").agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_set"))
    return by_doc.select("_doc", "_sum", F.expr("transform(_set, (w, i) -> named_struct('gap', w._word - if(i = 0, 0, _set[i - 1]._word + 1), 'bits', w._bits))").alias("_runs"))


def line_dedup(docs: DataFrame, **how) -> DataFrame:
    """All columns of docs, with _lines (their number before) and _kept (array of the lines that stay), for every row.

    Null or empty text is one empty line, which has no key and stays. Null doc_ids are documents like any; an empty table gives no rows. Further columns pass through, whatever their names but those
    of this module, which begin with an underscore.
    """
    bitmaps = drop_bitmaps(docs, **how).select(F.col("_doc").alias("_b_doc"), F.col("_sum").alias("_b_sum"), F.expr("flatten(transform(_runs, r -> concat(array_repeat(0L, r.gap), array(r.bits))))").alias("_words"))
    own = docs.withColumn("_whole", whole_text())
    joined = own.join(bitmaps, own["doc_id"].eqNullSafe(F.col("_b_doc")) & (F.xxhash64("_whole") == F.col("_b_sum")), "left").withColumn("_all", split_lines(F.col("_whole")))
    kept = F.expr(f"CASE WHEN _words IS NULL THEN _all ELSE filter(_all, (x, i) -> (shiftright(coalesce(get(_words, cast(i div {WORD} as int)), 0L), i % {WORD}) & 1L) = 0) END")
    return joined.select(*(joined[c] for c in docs.columns), F.size("_all").cast("long").alias("_lines"), kept.alias("_kept"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), (F.col("_lines") - F.size("_kept")).alias("n_dropped"), F.sha2(F.array_join("_kept", "\n").cast("binary"), 256).alias("kept_sha256"))


@guarded
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the lines that stay; n_chars follows. No document goes; null text stays null, repeated rows stay as they are many.

    The rule is op3's: a line of ten documents or more goes in all of them. A tie of hashes (128 bits) counts as an equal line.
    """
    text = F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n"))
    return line_dedup(docs).withColumn("_new", text).select(*(F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


OP3_SQL = """WITH l AS (SELECT rowid AS d, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT d) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY d, doc_id"""
