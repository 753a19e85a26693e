"""Every registered query of the corpus operators, with all its contract's columns, against brute force on the smallest tables."""

import glob
import hashlib
import os
import zlib

import __spark_entry__ as entry
import duckdb
import public_tokenizers
import pytest
from stemspark.llm.bpe import ids_bytes
from stemspark.llm.media import to_wav
from tokenizers import Tokenizer

from test_near import components_by_hand, fingerprint_by_hand, removed_by_hand, scan_by_hand, texts_of

SF = "/root/testdata/sf0.001"
OWN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
sha = lambda data: hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return sorted(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.fixture(scope="module")
def ids(texts):
    return {d: OWN.encode(t, add_special_tokens=False).ids for d, t in texts}


def run(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect())


def test_op1(spark, ids):
    rows = run(spark, "op1_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r[5], []).append((r[6], r[3]))
    for placed in by_sequence.values():
        ends = [0, *(o + n for o, n in sorted(placed))]
        assert [o for o, _ in sorted(placed)] == ends[:-1] and ends[-1] <= 2048
    for d, own in ids.items():
        data, pieces = ids_bytes([*own, 0]), [r for r in rows if r[0] == d]
        assert [r[1] for r in pieces] == list(range(len(pieces))) and sum(r[3] for r in pieces) == len(data) // 4
        assert len(pieces) == max(1, -(-len(data) // (4 * 2048))) and all(r[3] == 2048 for r in pieces[1:])
        assert all(r[2] == sum(p[3] for p in pieces[:k]) and r[4] == zlib.crc32(data[4 * r[2] : 4 * (r[2] + r[3])]) for k, r in enumerate(pieces))
    assert len(by_sequence) == -(-sum(len(x) + 1 for x in ids.values()) // 2048)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_line_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(entry.oracle_sql()[name])
    assert run(spark, name, *(c[0] for c in want.description)) == sorted(want.fetchall())


def test_op4(spark, texts):
    got = run(spark, "op4_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [(*r[:-1], round(r[-1], 9)) for r in got] == [(d, *scan_by_hand(t)) for d, t in texts]


def test_op5(spark, texts):
    want = []
    for d, t in texts:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(to_wav(payload)), sha(to_wav(payload)), f"wav:8bit:{len(payload)}:"))
    got = run(spark, "op5_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert got == want  # no text of these holds a medium


def test_op6(spark, texts):
    prints = [fingerprint_by_hand(t) for _, t in texts]
    roots = components_by_hand(prints)
    least: dict = {}
    for (d, _), r in zip(texts, roots, strict=True):
        least.setdefault(r, d)
    assert run(spark, "op6_simhash", "doc_id", "fingerprint", "component_id") == [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(texts, prints, roots, strict=True)]


def test_op7(spark, texts, ids):
    want = [(d, len(ids[d]), sha(ids_bytes(ids[d])), sha(OWN.decode(ids[d], skip_special_tokens=False).encode())) for d, _ in texts]
    assert run(spark, "op7_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op8(spark, ids):
    want, at = [], 0
    for d, own in sorted(ids.items()):
        want.append((d, at, len(own) + 1, zlib.crc32(ids_bytes([*own, 0]))))
        at += len(own) + 1
    assert run(spark, "op8_simple8b", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op9(spark, texts):
    rows = run(spark, "op9_language_id", "doc_id", "held_out", "lang_pred", "score")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert [(r[0], r[1]) for r in rows] == [(d, zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in texts]
    held = [r for r in rows if r[1] and lang[r[0]]]
    assert all(0 <= r[3] <= 1 and r[2] in {*lang.values(), "und"} for r in rows) and sum(r[2] == lang[r[0]] for r in held) >= 0.95 * len(held)


def test_op10(spark, texts):
    want = [(*r[:4], sha(r[4])) for r in removed_by_hand([(d, t.encode()) for d, t in texts])]
    assert run(spark, "op10_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)
