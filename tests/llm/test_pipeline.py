"""Each stage of the pipeline on its own input, against brute force."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from stemspark.llm import langid

from test_near import lines_by_hand, removed_by_hand, similar_by_hand, texts_of

SF = "/root/testdata/sf0.001"


def stage(spark, df, k):
    return corpus_pipeline.STAGES[k][1](spark, df, SF)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    current = docs
    for k in range(4):
        before = current
        stage(spark, before, k).write.parquet(str(tmp_path / str(k)))
        current = spark.read.parquet(str(tmp_path / str(k)))
        assert current.dtypes == docs.dtypes
        got = sorted(texts_of(current), key=str)
        if k == 0:
            assert got == sorted(texts_of(before), key=str)  # all are clean prose in a learned language
        elif k == 1:
            assert got == sorted(((r[0], r[3]) for r in lines_by_hand(texts_of(before), 10)), key=str)
        elif k == 2:
            stay = {d for d, least in similar_by_hand(texts_of(before)) if d == least}
            assert got == sorted((r for r in texts_of(before) if r[0] in stay), key=str)
        else:
            want = removed_by_hand([(d, t.encode()) for d, t in texts_of(before)])
            assert got == sorted(((w[0], w[4].decode("utf-8", "replace")) for w in want), key=str)
        assert all(r["n_chars"] == len(r["text"]) for r in current.collect())
    packed = stage(spark, current, 4).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in current.collect()}
    ran = corpus_pipeline.run(spark, SF).collect()
    digest = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert digest(ran) == digest(packed)


def test_unknown_languages_go(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog near the river bank", "en", "a", 1) for i in range(40)] + [(100, None, None, None, None), (101, "12 34 !!", "en", "a", 1), (102, "ыжщ эюя фцх шщъ ыэю ячс мит ьбю", None, "a", 1), (None, "the quick brown fox jumps over the lazy dog", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] for r in langid.stage(spark, df, SF).collect()), key=str) == sorted([None, *range(40)], key=str)


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_and_empty_tables(spark, odd, empty, k):
    assert stage(spark, odd, k).columns == odd.columns and stage(spark, odd, k).count() <= odd.count()
    assert stage(spark, empty, k).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_clashing_names_pass(spark, odd, k):
    names = ("lang_pred", "score", "rate", "n_grams", "dropped_id", "_doc", "_sum", "_text", "_whole", "_lines", "_new", "_null", "_0", "fp", "component_id", "bid", "kept", "n_removed")
    wide = odd.select("*", *(F.lit(c).alias(c) for c in names))
    got = stage(spark, wide, k)
    assert got.columns == wide.columns and all(r[c] == c for r in got.collect() for c in names)


@pytest.mark.parametrize("k", [1, 3])
def test_null_texts_and_shared_ids_stay_as_they_are(spark, k):
    """Rows are judged by their own text: those that share a doc_id, or have none, and those that repeat."""
    rows = [(1, None), (1, "first\nline"), (1, "first\nline"), (None, None), (None, "other"), (2, "")]
    df = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, df, k)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(rows, key=str)


def test_null_texts_pass_the_suffix_stage(spark, odd):
    got = {r["doc_id"]: r["text"] for r in stage(spark, odd, 3).collect()}
    assert got[1] is None and got[2] == "" and hashlib.sha256(got[5].encode()).digest()
