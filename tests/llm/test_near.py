import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from stemspark.llm import licenses, lines, simhash, suffix
from stemspark.llm.common import text_sum

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# Lines


def lines_by_hand(texts, min_docs):
    """Every row is a document, repeated ones too."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    where: dict = {}
    for row, (_, text) in enumerate(texts):
        for line in text.split("\n"):
            where.setdefault(key(line), set()).add(row)
    out = []
    for doc, text in texts:
        split = text.split("\n")
        kept = [x for x in split if not key(x) or len(where[key(x)]) < min_docs]
        out.append((doc, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_by_engine(df, **how):
    return sorted(((r["doc_id"], r["_lines"], r["_lines"] - len(r["_kept"]), "\n".join(r["_kept"])) for r in lines.line_dedup(df, **how).collect()), key=str)


def test_op3_on_documents(docs):
    assert lines_by_engine(docs) == lines_by_hand(texts_of(docs), 10)
    assert sum(r[2] for r in lines_by_engine(docs, min_docs=3)) > 0


def test_op3_on_odd_rows(odd, empty):
    assert lines_by_engine(odd, min_docs=2) == lines_by_hand(texts_of(odd), 2) and lines_by_engine(empty) == []


def test_op3_counts_repeated_rows_as_its_sql_does(spark):
    rows = [(1, "one\ntwo\none")] * 6 + [(1, "two"), (2, "two"), (None, "Two "), (None, "two"), (3, "one"), (4, "a long\n" + "".join(f"line {i}\n" for i in range(200)) + "TWO")] + [(5, "nine")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines_by_engine(df) == lines_by_hand(texts_of(df), 10) and any(r[2] for r in lines_by_engine(df))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(((r[0], r[1], r[2], r[3]) for r in con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.OP3_SQL})").fetchall()), key=str)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert sorted(((d, n, k, digest(t)) for d, n, k, t in lines_by_engine(df)), key=str) == want


def test_first_occurrences_may_stay(spark):
    df = spark.createDataFrame([(2, "a\nb\na"), (1, "x\nA "), (3, "\n")], "doc_id long, text string")
    got = {r["doc_id"]: r["_kept"] for r in lines.line_dedup(df, min_docs=2, keep_first=True).collect()}
    assert got == {1: ["x", "A "], 2: ["b"], 3: ["", ""]}


# Licenses


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    at: dict = {}
    for k in (2, 3, 4):
        for i in range(len(words) - k + 1):
            at.setdefault(tuple(words[i : i + k]), []).append(i)
    hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in at.get(tuple(phrase.split()), [])]
    starts, base, labels, score = [i for i, _ in hits], {x for _, x in hits}, set(), 1.0 if hits else 0.0
    for template, label in licenses.TEMPLATES.items():
        wanted = template.split()
        n = len(wanted) - licenses.K + 1
        votes = sorted((i - p, p) for p in range(n) for i in at.get(tuple(wanted[p : p + licenses.K]), []))
        runs: list = []
        for diagonal, p in votes:
            if not runs or diagonal - runs[-1][0] > licenses.SHIFT:
                runs.append([diagonal, set()])
            runs[-1][0] = diagonal
            runs[-1][1].add(p)
        best = max((len(places) / n for _, places in runs), default=0)
        if best >= licenses.LEAST:
            labels.add(label)
            score = max(score, min(best, 1.0))
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9)


MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"


@pytest.mark.parametrize("which", ["docs", "odd", "empty", "own"])
def test_op4_by_hand(spark, which, request):
    """Every row of the input gives one, repeated ones too; labels and scores of the method's own are held against brute force."""
    if which == "own":
        texts = ["MIT License mit license, Apache-License!", "GNU General Public License GNU general", "cc by cc by", "CC-BY-SA é licensed", MIT.replace("associated", "its associated"), "mit", ""]
        texts += [MIT[:90], MIT[40:], f"{MIT} {MIT}", " x ".join(MIT.split()), MIT.replace("copy", "copy or two or three more of them"), "licensed under the apache license version 2 0 this program is free software you can redistribute it", "K KK licensed under CC BY NC 4.0"]
        df = spark.createDataFrame([*enumerate(texts), (4, texts[4]), (4, texts[4]), (4, "another text"), (None, texts[0]), (None, texts[0]), (None, None)], "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted(((d, *scan_by_hand(t)) for d, t in texts_of(df)), key=str)
    if which == "own":
        assert any("mit-text" in r[6] for r in got)


# Near duplicates


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_hand(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_op6_components(which, request):
    df = request.getfixturevalue(which)
    texts = texts_of(df)
    prints = [fingerprint_by_hand(t) for _, t in texts]
    roots = components_by_hand(prints)
    least: dict = {}
    for (doc, _), r in zip(texts, roots, strict=True):
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    want = sorted(((doc, p, least[r]) for (doc, _), p, r in zip(texts, prints, roots, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10**9), st.integers(1, 9))
def test_trie_links_connect_what_is_near(seed, spread):
    rng = np.random.default_rng(seed)
    values = []
    for base in rng.integers(0, 2**63, 4, dtype=np.uint64):
        for _ in range(25):
            x = int(base)
            for b in rng.integers(0, 64, spread):
                x ^= 1 << int(b)
            values.append(x)
    v = np.unique(np.array(values, np.uint64))
    bucket = np.zeros(len(v), np.int64)
    i, j = simhash.trie_links(bucket, v)
    parts = simhash.Parts(len(v))
    parts.join(i, j)
    assert len(i) < len(v) and all(int(v[a] ^ v[b]).bit_count() <= 64 for a, b in zip(i, j, strict=True))
    want = components_by_hand([int(x) for x in v])
    assert len({*zip(want, parts.label.tolist(), strict=True)}) == len(set(want)) == len(set(parts.label.tolist()))


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    rng = np.random.default_rng(5)
    v = sorted({int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in rng.integers(0, 2**62, 6) for a, b in rng.integers(0, 62, (25, 2))})
    df = spark.createDataFrame([(x,) for x in v], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = components_by_hand(v)
    assert len({(w, roots.get(x, x)) for w, x in zip(want, v, strict=True)}) == len(set(want))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 99), (5, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(df).collect()} == {(i, 0) for i in range(1, 31)} | {(100, 99)}


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """What the driver keeps grows with its jobs and their tasks; stars took dozens of jobs for any links."""
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (200, 150), (-3, 200), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {(i, 0) for i in range(1, 61)} | {(x, -3) for x in (100, 150, 200)}
    spark.sparkContext.setJobGroup("few", "few links")
    got = simhash.components(df).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("", "")
    assert {(r["node"], r["root"]) for r in got} == want and jobs <= 12
    monkeypatch.setattr(simhash, "UNITED", 0)
    assert {(r["node"], r["root"]) for r in simhash.components(df).collect()} == want
    assert simhash.components(df.where("a > b AND a < b")).count() == 0


def similar_by_hand(texts):
    """The smallest doc_id of each part of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)})
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and 10 * len(a & b) >= 8 * len(a | b):
                part = [part[j] if x == part[i] else x for x in part]
    least: dict = {}
    for (doc, _), p in zip(texts, part, strict=True):
        least[p] = min((x for x in (least.get(p), doc) if x is not None), default=None)
    return sorted(((doc, least[p]) for (doc, _), p in zip(texts, part, strict=True)), key=str)


def similar_by_engine(df):
    return sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar(df).collect()), key=str)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_similar_components(which, request):
    df = request.getfixturevalue(which)
    assert similar_by_engine(df) == similar_by_hand(texts_of(df))


@pytest.fixture(scope="module")
def near_copies(spark):
    """Texts of 120 words, each with copies of one to four replaced words: a similarity of about 0.75 to 0.92."""
    rng = np.random.default_rng(8)
    texts = []
    for base in range(12):
        words = [f"w{base}x{k}" for k in range(120)]
        texts.append(words)
        for n in (1, 2, 2, 3, 4):
            copy = list(words)
            for at in rng.choice(120, n, replace=False):
                copy[at] = f"other{rng.integers(10**9)}"
            texts.append(copy)
    return spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("part,members", [(2_000_000, 500), (300, 500), (2_000_000, 3)])
def test_the_stage_drops_copies_of_a_similarity_of_four_fifths(near_copies, monkeypatch, part, members):
    monkeypatch.setattr(simhash, "PART_HASHES", part)
    monkeypatch.setattr(simhash, "PART_MEMBERS", members)
    want = similar_by_hand(texts_of(near_copies))
    assert similar_by_engine(near_copies) == want
    kept = {r["doc_id"] for r in simhash.stage(near_copies.sparkSession, near_copies, SF).collect()}
    assert kept == {c for _, c in want}
    by_bits = {r["component_id"] for r in simhash.near_duplicates(near_copies).collect()}
    assert len(by_bits) > len(kept)  # the rule of the query alone leaves near copies


@pytest.mark.parametrize("leaves", [1, 8])
def test_tries_take_equal_values_and_checks(leaves):
    rng = np.random.default_rng(11)
    v = np.sort(rng.integers(0, 1 << 10, 400).astype(np.uint64))  # many repeat
    side = rng.integers(0, 3, 400)
    i, j = simhash.trie_links(np.zeros(400, int), v << np.uint64(40), 1, lambda x, y: side[x] == side[y], leaves)
    near = (np.bitwise_count(v[:, None] ^ v) <= 1) & (side[:, None] == side)
    want, got = simhash.Parts(400), simhash.Parts(400)
    want.join(*np.nonzero(near))
    got.join(i, j)
    assert (want.label == got.label).all() and len(i) == 400 - len(set(want.label))


def test_the_stage_takes_its_candidates_from_tries_of_simhash(near_copies):
    """No pair at 0.8 or more is without a chain of candidate links, and texts of other origin have none."""
    sets = {r["doc_id"]: simhash.shingles(r["text"]) for r in near_copies.collect()}
    rows = [(d, bytearray(simhash.wide_fingerprint(s).tobytes())) for d, s in sets.items()] + [(10**6, bytearray())]
    links = simhash.candidates(near_copies.sparkSession.createDataFrame(rows, "fp long, wide binary"))
    label = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    for a, x in sets.items():
        for b, y in sets.items():
            common = len(np.intersect1d(x, y))
            if common >= 0.8 * (len(x) + len(y) - common):
                assert label.get(a, a) == label.get(b, b)
            if a // 6 != b // 6:
                assert label.get(a, a) != label.get(b, b)


def test_the_stage_drops_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, c + " x"), (7, c), (None, c), (None, b), (8, a + " y"), (3, a), (9, None), (10, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(texts_of(simhash.stage(spark, df, SF)), key=str)
    least = min((7, c), (7, c + " x"), key=lambda r: df.where(F.col("text") == r[1]).select(text_sum()).first()[0])
    assert got == sorted([(3, a), (3, a), (5, b), least, (9, "")], key=str)


# Repeated passages


def removed_by_hand(texts):
    first: dict = {}
    key = lambda d: (d is None, d or 0)
    for doc, raw in texts:
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, key(doc)), key(doc))
    out = []
    for doc, raw in texts:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < key(doc):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept))
    return sorted(out, key=str)


def removed_by_engine(df, **how):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.suffix_dedup(df, **how).collect()), key=str)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_op10_removed_bytes(which, request):
    df = request.getfixturevalue(which)
    assert removed_by_engine(df, group_bytes=100_000) == removed_by_hand([(d, t.encode()) for d, t in texts_of(df)])


def test_op10_periodic_texts_and_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 128)
    rng = np.random.default_rng(2)
    rand = lambda n: "".join(rng.choice(list("abcd"), n))
    p, q = rand(60), rand(49)
    texts = ["a" * 300, "b" + "a" * 120, "ab" * 90, "xab" + "ab" * 40, rand(50) + p + rand(40), p + p, rand(10) + p[:50] + rand(5), p[5:], q + "1", q + "2", "é" * 40 + p[:51], "", "z" * 49, "z" * 50, "z" * 51, "a" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed_by_engine(df, group_bytes=200) == removed_by_hand([(d, t.encode()) for d, t in texts_of(df)])


@settings(deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=4, max_size=9), st.integers(0, 3)), min_size=1, max_size=12))
def test_previous_factor(rows):
    data, start, doc = b"", [], []
    for text, d in rows:
        start += [len(data) + p for p in range(len(text) - 3)]
        doc += [d] * (len(text) - 3)
        data += text.encode()
    data, words = np.frombuffer(data, np.uint8), [data[s : s + 4] for s in start]
    want = [max((len(os.path.commonprefix([w, v])) for v, e in zip(words, doc, strict=True) if e < d), default=0) for w, d in zip(words, doc, strict=True)]
    for least in (1, 3, 4):
        got = suffix.longest_previous_factors(data, np.array(start), np.array(doc), 4, least)
        assert got.tolist() == [w if w >= least else 0 for w in want]
    order, common = suffix.suffix_order(data, np.array(start), 4)
    assert [words[i] for i in order] == sorted(words)
    assert common.tolist() == [0] + [len(os.path.commonprefix([words[a], words[b]])) for a, b in zip(order, order[1:], strict=False)]


def test_op10_avoids_strings_that_are_everywhere(spark, monkeypatch):
    """One string in every text, each time in another context; which string stands for a window changes no result."""
    rng = np.random.default_rng(6)
    rand = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    often, p = "the string that everybody has", rand(80)
    texts = [rand(60) + often + rand(60) + often + rand(20) + (p if k % 9 == 0 else "") for k in range(120)] + [often * 6, often * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = removed_by_engine(df, group_bytes=2000)
    monkeypatch.setattr(suffix, "HOT_UNITS", 20)
    found, made = [], suffix.strings_to_avoid
    monkeypatch.setattr(suffix, "strings_to_avoid", lambda *a: found.append(made(*a)) or found[-1])
    assert removed_by_engine(df, group_bytes=2000) == plain == removed_by_hand([(d, t.encode()) for d, t in texts_of(df)])
    least = suffix._grams(np.frombuffer(often.encode(), np.uint8)) >> np.uint64(1) & suffix.CUT
    assert 0 < len(found[0]) < 40 and set(found[0].tolist()) & set(least.tolist())


def test_op10_shared_and_missing_ids(spark):
    """Rows that share a doc_id, or have none, don't remove from one another, wherever they are grouped."""
    rng = np.random.default_rng(4)
    p, q = ("".join(rng.choice(list("abcdefgh"), 70)) for _ in range(2))
    rows = [(None, f"x{p}y"), (None, f"z{p}{q}"), (None, None), (5, p + "1"), (5, "2" + p), (5, "3" + q), (3, q[:55]), (9, p + q), (9, p + q)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed_by_engine(df, group_bytes=60) == removed_by_hand([(d, t.encode()) for d, t in texts_of(df)])
