import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stemspark.llm import exact, langid, media
from stemspark.llm.exact import CuckooIndex, exact_dedup

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=1500))
def test_cuckoo_index_acts_like_a_dict(steps):
    index, want = CuckooIndex(4), {}
    for add, n in steps:
        key = hashlib.sha256(str(n).encode()).digest()
        if add and key not in want:
            index.insert(key, n)
            want[key] = n
        elif not add:
            assert index.delete(key) == (want.pop(key, None) is not None)
    assert dict(index.items()) == want and index.live == len(want)


def test_cuckoo_index_tells_equal_tags_apart():
    a, b = bytes(32), bytes(20) + b"x" * 12
    index = CuckooIndex(1)
    index.insert(a, 1)
    assert index.get(b) is None and not index.delete(b) and index.get(a) == 1


def test_op2_on_odd_rows(odd, empty):
    assert exact_dedup(empty).count() == 0
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(odd).collect()]
    texts = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in odd.collect()]
    want = []
    for doc, text in texts:
        group = [d for d, t in texts if t == text]
        keep = max((d for d in group if d is not None), default=None)
        want.append((doc, keep, len(group), doc == keep))
    assert sorted(rows, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("flush", [1, 100_000])
def test_op2_verifies_texts(spark, monkeypatch, flush):
    """Equal digests of other texts are noticed, in a task's own index and between tasks."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "FLUSH", flush)
    rows = spark.createDataFrame([(k, bytes([k % 3]) * 32, str(k % 3).encode()) for k in range(60)], "doc_id long, digest binary, content binary").repartition(7)
    got = {bytes(r["digest"])[0]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(rows).collect()}
    assert got == {0: (57, 20), 1: (58, 20), 2: (59, 20)}
    for parts in (1, 7):
        wrong = rows.withColumn("content", F.when(F.col("doc_id") == 30, F.lit(b"x")).otherwise(F.col("content"))).repartition(parts)
        with pytest.raises(Exception, match="share the digest 0000"):
            exact.exact_groups(wrong).collect()


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_validators_confirm_and_carve():
    magics = media.automaton()
    wav = media.to_wav(media.pad(b"junk" + png() + b"RIFF not a file %PDF-"))
    kinds = [(x[0], wav[x[1] : x[2]]) for x in media.sniff(wav, magics)]
    assert kinds == [("wav", wav), ("png", png())]
    broken = bytearray(png())
    broken[-1] ^= 1
    assert media.sniff(bytes(broken), magics) == []
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + bytes(4) + struct.pack("<HHB", 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b";"
    assert [x[:3] for x in media.sniff(b"ab" + gif + b"cd", magics)] == [("gif", 2, 2 + len(gif))]


def ogg_page(first: bool, body: bytes) -> bytes:
    return b"OggS\0" + bytes([2 if first else 0]) + bytes(20) + bytes([1, len(body)]) + body


def zipped(comment: bytes = b"") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
        z.writestr("b.txt", "more")
        z.comment = comment
    return out.getvalue()


def pdf(shift: int = 0) -> bytes:
    head = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    return head + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF\n" % (len(head) + shift)


FLAC = b"fLaC\x00\x00\x00\x22" + bytes(34) + b"\x84\x00\x00\x02ab" + b"\xff\xf8 frames"


@pytest.mark.parametrize("kind,medium", [("ogg", ogg_page(True, b"ab") + ogg_page(False, b"cd")), ("zip", zipped()), ("zip", zipped(b"a comment")), ("pdf", pdf()[:-1])])
def test_structure_and_lengths_of_embedded_media(kind, medium):
    magics = media.automaton()
    assert [x[:3] for x in media.sniff(b"before " + medium + b" after", magics)] == [(kind, 7, 7 + len(medium))]
    twice = [(kind, 0, 2 * len(medium))] if kind == "ogg" else [(kind, 0, len(medium)), (kind, len(medium), 2 * len(medium))]  # streams may be chained
    assert [x[:3] for x in media.sniff(medium + medium, magics)] == twice
    assert all(x[2] < len(medium) for x in media.sniff(medium[:-1], magics))  # cut off: at most a shorter one


def test_wrong_structures_are_no_media():
    magics = media.automaton()
    assert [x[:3] for x in media.sniff(b"xx" + FLAC, magics)] == [("flac", 2, 2 + len(FLAC))] and media.sniff(FLAC.replace(b"\xff\xf8", b"no"), magics) == []
    assert media.sniff(pdf(5), magics) == [] and media.sniff(b"%PDF-1.4 and nothing %%EOF", magics) == []
    whole = zipped()
    assert media.sniff(whole.replace(b"PK\x01\x02", b"PKxx"), magics) == [] and media.sniff(b"PK\x03\x04 text PK\x05\x06" + bytes(18), magics) == []
    riff = bytearray(media.to_wav(media.pad(b"abc")))
    riff[40:44] = struct.pack("<I", 65)  # more samples than the file holds
    assert media.sniff(bytes(riff), magics) == []


@pytest.mark.parametrize("unit", [ogg_page(True, b""), b"GIF89a" + bytes(7) + b"!\xfe\x00", b"%PDF-", b"PK\x03\x04", b"RIFF\xff\xff\x00\x00WAVEjunk\x00\x00\x00\x00", b"fLaC\x00\x00\x00\x22", b"\x89PNG\r\n\x1a\n\0\0\0\0IHDR"])
def test_hostile_bytes_take_linear_time(unit):
    magics, data = media.automaton(), unit * (1_500_000 // len(unit))
    began = time.process_time()
    media.sniff(data, magics)
    assert time.process_time() - began < 10


def test_declared_types_are_corrected(spark):
    rows = spark.createDataFrame([(1, 0, png(), "gif"), (2, 0, b"text", "png"), (3, 0, b"text", "txt"), (4, 0, None, None)], "doc_id long, n_bytes long, media binary, said string")
    assert {r["doc_id"]: r["kind"] for r in media.sniff_media(rows, "said").collect()} == {1: "png", 2: None, 3: "txt", 4: None}


def test_op5_round_trip(spark, odd, empty):
    assert media.store_media(empty).count() == 0
    rows = media.sniff_media(media.store_media(odd)).collect()
    for r, t in zip(rows, [x["text"] or "" for x in odd.collect()], strict=True):
        raw = t.encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r["kind"] == "wav" and bytes(r["payload"]) == want and r["n_bytes"] == len(raw)


def test_op9_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"]]
    right = sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert len(found) == docs.count() and right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_op9_rates_by_hand(spark, monkeypatch):
    """Rates and scores against exact sets of n-grams: the filter may only differ by its false hits, whose mean is taken off."""
    learned: dict = {}

    made = langid.Filters
    monkeypatch.setattr(langid, "Filters", lambda grams: learned.update(grams) or made(grams))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters = langid.fit(docs)
    monkeypatch.undo()
    rows = langid.identify(docs, filters, ("doc_id", "text")).collect()
    exact = {k: set(map(int, v)) for k, v in learned.items()}
    assert len(exact) > 1
    for r in rows:
        grams = [int.from_bytes(langid.signs(r["text"])[i : i + 4], "little") for i in range(len(langid.signs(r["text"])) - 3)]
        shares = {k: sum(g in v for g in grams) / max(len(grams), 1) for k, v in exact.items()}
        best = max(shares.values())
        assert r["n_grams"] == len(grams) and abs(shares[r["lang_pred"]] - best) < 0.02
        assert abs(r["rate"] - shares[r["lang_pred"]]) < 0.02 and abs(r["score"] - shares[r["lang_pred"]] / max(sum(shares.values()), 1e-9)) < 0.03


def test_op9_never_learns_from_held_out_or_unnamed_documents(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2)
    free = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2][:4]
    rows = [(held, "zzzz yyyy zzzz yyyy", "z"), (None, "qqqq rrrr qqqq rrrr", "q"), (free[0], "aaaa bbbb aaaa bbbb", "a"), (free[0], "cccc aaaa cccc aaaa", "a"), (free[1], "dddd eeee dddd eeee", "d"), (free[2], None, "n"), (free[3], "ffff", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df).languages == ["a", "d"]
    assert {(r["doc_id"], r["held"]) for r in df.select("doc_id", langid.held_out().alias("held")).collect()} == {(r[0], r[0] == held) for r in rows}


def test_op9_on_odd_rows(odd, empty):
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    rows = langid.identify(odd, langid.fit(odd)).collect()
    assert len(rows) == odd.count()
    for r, t in zip(rows, odd.collect(), strict=True):
        if not t["text"] or t["text"] == "1234 !!":
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_bit_slices_have_no_false_negative():
    grams = {"a": langid.ngrams(b" the quick brown fox "), "b": langid.ngrams(b" der schnelle fuchs ")}
    filters = langid.Filters(grams)
    for k, name in enumerate(filters.languages):
        assert all(int(m) >> k & 1 for m in filters.containing(grams[name]))


@pytest.mark.parametrize("label", [None, "en"])
def test_labels_are_no_input(spark, odd, label):
    from pyspark.sql import functions as F

    filters = langid.fit(odd)
    one = langid.identify(odd, filters).collect()
    other = langid.identify(odd.withColumn("lang", F.lit(label)).withColumn("source", F.lit("z")), filters).collect()
    assert [r["lang_pred"] for r in one] == [r["lang_pred"] for r in other]


def test_more_than_64_languages_are_learned(spark):
    """70 languages, each with its own words; the rarest are learned and told apart, too."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, i: letters[k % 26] + letters[k // 26] + letters[i % 26] + letters[(7 * i + k) % 26] + letters[k % 26]
    rows = [(100 * k + i, " ".join(word(k, (i + j) % 26) for j in range(12)), f"l{k:02}") for k in range(70) for i in range(30 if k < 64 else 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(df)
    assert len(filters.languages) == 70
    label = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == label[r["doc_id"]] for r in langid.identify(df, filters).collect())
