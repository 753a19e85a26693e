"""Texts of several megabytes through every operator."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from stemspark.llm import langid, licenses, lines, media, packing, simhash, simple8b, suffix
from stemspark.llm.bpe import ids_bytes
from stemspark.llm.encode import encode_documents
from stemspark.llm.exact import exact_dedup
from tokenizers import Tokenizer

from test_near import fingerprint_by_hand, lines_by_hand, scan_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    """Prose of 3 MB, its copy, the same in upper case, 2 MB without any space, and a short text."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), n)) for n in rng.integers(2, 11, 20_000)]
    prose = " ".join(words[i] + ("\n" if i % 19 == 0 else "") for i in rng.integers(0, len(words), 420_000))
    solid = "".join(rng.choice(list("abcdefghijklmnop0123456789"), 2_000_000))
    return [(1, prose + " mit license"), (2, prose + " mit license"), (3, prose.upper()), (4, solid), (5, "short")]


@pytest.fixture(scope="module")
def long(spark, texts):
    assert len(texts[0][1]) > 2_900_000
    return spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts], SCHEMA).repartition(2)


def test_tokens(spark, long, texts, tmp_path):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: ids_bytes(own.encode(t, add_special_tokens=False).ids) for d, t in texts}
    assert {r["doc_id"]: bytes(r["ids"]) for r in encode_documents(long).collect()} == want
    simple8b.write_blocks(long, str(tmp_path / "ids"))
    assert {r["doc_id"]: bytes(r["ids"]) for r in simple8b.read_blocks(spark, str(tmp_path / "ids")).collect()} == {d: x + bytes(4) for d, x in want.items()}
    rows = packing.pack(packing.pieces(long)).collect()
    assert {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in want} == {d: len(x) // 4 + 1 for d, x in want.items()}


def test_texts(spark, long, texts):
    low = {d: t.lower() for d, t in texts}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(long).collect()} == {d: (max(x for x in low if low[x] == low[d]), sum(low[x] == low[d] for x in low)) for d in low}
    got = sorted(((r["doc_id"], r["_lines"], r["_lines"] - len(r["_kept"]), "\n".join(r["_kept"])) for r in lines.line_dedup(long, min_docs=2).collect()), key=str)
    assert got == lines_by_hand(texts, 2) and got[0][2] > 20_000
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in licenses.scan(long).collect()} == {d: scan_by_hand(t) for d, t in texts}
    stored = media.sniff_media(media.store_media(long)).select("doc_id", F.sha2("payload", 256).alias("p")).collect()
    assert {r["doc_id"]: r["p"] for r in stored} == {d: hashlib.sha256(media.pad(t.encode())).hexdigest() for d, t in texts}


def test_near_copies_and_passages(spark, long, texts):
    prints = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(long).collect()}
    assert {d: p for d, (p, _) in prints.items()} == {d: fingerprint_by_hand(t) for d, t in texts} and prints[2][1] == prints[1][1] == 1
    assert sorted(r["doc_id"] for r in simhash.stage(spark, long, "").collect()) == [1, 4, 5]
    removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix.suffix_dedup(long).collect()}
    assert removed[1][1] == removed[3][1] == removed[4][1] == 0 and removed[2] == (len(texts[1][1]),) * 2
    assert langid.identify(long, langid.fit(long)).count() == 5
