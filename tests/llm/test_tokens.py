import json
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stemspark.llm import simple8b
from stemspark.llm.bpe import Encoder, encoder, ids_bytes
from stemspark.llm.encode import encode_documents
from stemspark.llm.packing import Steps, best_fit, fillings, least_bins, pack, pack_sizes, pieces, places
from tokenizers import Tokenizer

OWN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Z'sltre\n\t\r  \x1c\x85,.!1é½à 二"), st.characters(codec="utf-8")), max_size=60), st.sampled_from(["", "<|endoftext|>", " <|endoftext|> x"]))
def test_forced_boundaries_change_no_id(text, special):
    text = text + special + text
    (ids,) = encoder().encode_batch([text])
    assert ids == ids_bytes(OWN.encode(text, add_special_tokens=False).ids)
    numbers = np.frombuffer(ids, "<u4").tolist()
    assert encoder().decode(numbers) == OWN.decode(numbers, skip_special_tokens=False)


def test_merging_by_ranks_is_used_and_exact():
    own = encoder()
    words = [own.bytes_of[i].decode("utf-8", "ignore") for i in range(0, 50_000, 3)]
    pieces = [x for a, b in zip(words, reversed(words), strict=True) for x in (a + b, " " + a.strip() + b.strip(), "\n" + a, "\n " + b.strip())]
    assert own.merge and sum(bool(own.whole(p)) for p in pieces) > 40_000
    assert own.encode_batch(pieces) == [ids_bytes(e.ids) for e in OWN.encode_batch_fast(pieces, add_special_tokens=False)]


def test_other_vocabularies_go_through_the_library(tmp_path):
    """One whose second merge shadows the first: ranks of bytes would merge what the pairs do not."""
    data = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    signs = sorted(k for k in data["model"]["vocab"] if len(k) == 1)
    vocab = {c: i for i, c in enumerate(signs)} | {"bc": 256, "ab": 257, "abc": 258}
    data["model"] |= {"vocab": vocab, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}
    data["added_tokens"] = []
    path = tmp_path / "v.json"
    path.write_text(json.dumps(data))
    own, want = Encoder(str(path)), Tokenizer.from_file(str(path))
    texts = [" abc", "abcab c", " cabbage abcabc"]
    assert own.merge is None and own.encode_batch(texts) == [ids_bytes(want.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF][::7]
    texts = [f"ab{c} x{c}'s!{c}\n {c}1 {c}{c} ,{c}  {c}é,{c}9" for c in points]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        assert encoder().encode_batch(part) == [ids_bytes(e.ids) for e in OWN.encode_batch_fast(part, add_special_tokens=False)]


def test_op7_on_odd_rows(odd, empty):
    rows = encode_documents(odd).collect()
    assert len(rows) == odd.count() and encode_documents(empty).count() == 0
    for r, t in zip(rows, [x["text"] or "" for x in odd.collect()], strict=True):
        assert bytes(r["ids"]) == ids_bytes(OWN.encode(t, add_special_tokens=False).ids) and r["decoded"] == t


@settings(deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(values), len(values)) == values).all()


def test_op8_files(spark, odd, empty, tmp_path):
    for docs, name in ((odd, "odd"), (empty, "empty")):
        simple8b.write_blocks(docs, str(tmp_path / name))
        got = sorted(simple8b.read_blocks(spark, str(tmp_path / name)).collect(), key=lambda r: r["start"])
        want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert [r["doc_id"] for r in got] == [w[0] for w in want]
        at = 0
        for r, (_, text) in zip(got, want, strict=True):
            ids = ids_bytes([*OWN.encode(text, add_special_tokens=False).ids, 0])
            assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids) // 4, ids)
            at += len(ids) // 4


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_bins_hold_everything_once(counts):
    found = pack_sizes(counts, 50)
    assert all(sum(items) <= 50 for _, items in found)
    held: dict[int, int] = {}
    for n, items in found:
        for s in items:
            held[s] = held.get(s, 0) + n
    assert held == counts


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            left = list(bins)
            left.remove(room)
            go(i + 1, [*left, room - sizes[i]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("sizes", [[6, 5, 5, 4, 4, 3, 3], [7, 6, 3, 3, 3, 2, 2, 2, 2], [9, 8, 2, 1], [4, 4, 4, 6, 6, 3, 3]])
def test_as_few_as_brute_force(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    assert sum(n for n, _ in pack_sizes(counts, 10)) == fewest(sizes, 10)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(4, 40), min_size=5, max_size=10))
def test_without_a_bound_of_steps_no_fewer_bins_exist(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    n = sum(n for n, _ in pack_sizes(counts, 50, None))
    assert least_bins(counts, 50) <= n == fewest(sizes, 50) <= sum(n for n, _ in best_fit(counts, 50))


def test_the_search_beats_best_fit():
    sizes = [8, 7, 9, 23, 14, 29, 15, 31, 12]
    counts = {s: sizes.count(s) for s in sizes}
    assert sum(n for n, _ in best_fit(counts, 50)) == 4 and sum(n for n, _ in pack_sizes(counts, 50)) == 3
    rng = np.random.default_rng(1)
    many = dict(Counter(rng.integers(400, 1300, 200).tolist()))
    assert least_bins(many, 2048) <= sum(n for n, _ in pack_sizes(many, 2048)) < sum(n for n, _ in best_fit(many, 2048))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7), st.integers(1, 20))
def test_fillings_are_the_undominated_ones(sizes, gap):
    """Against all subsets: one is dominated if another can be split into groups that each fit into one of its sizes."""
    counts = Counter(sizes)
    every = {tuple(sorted(c, reverse=True)) for k in range(len(sizes) + 1) for c in combinations(sizes, k) if sum(c) <= gap}

    def over(a, b):
        """a dominates b: the sizes of b fit into those of a (or into nothing more)."""
        rooms = {tuple(sorted(a))}
        for x in sorted(b, reverse=True):
            rooms = {tuple(sorted((*r[:k], r[k] - x, *r[k + 1 :]))) for r in rooms for k in range(len(r)) if r[k] >= x}
        return a != b and bool(rooms)

    got = list(fillings(gap, dict(counts), Steps(None)))
    assert len(got) == len(set(got)) and set(got) <= every
    # each filling is at most as good as one that is kept
    assert all(b in got or any(over(a, b) for a in got) for b in every)


def test_op1_on_odd_rows(odd, empty):
    assert pack(pieces(empty)).count() == 0
    rows = pack(pieces(odd)).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["start"], r["ids_crc32"]), []).append(r)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    for d in odd.collect():
        ids = ids_bytes([*OWN.encode(d["text"] or "", add_special_tokens=False).ids, 0])
        mine = {r["piece"]: r for r in rows if r["doc_id"] == d["doc_id"]}
        assert sum(r["length"] for r in mine.values()) == len(ids) // 4
        for r in mine.values():
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) and (r["piece"] == 0 or r["length"] == 2048)


def test_places_cover_every_rank():
    counts = {7: 5, 3: 9, 2: 4, 10: 2}
    table = places(pack_sizes(counts, 10))
    assert {s: sum(r[3] for r in table if r[0] == s) > 0 for s in counts} == dict.fromkeys(counts, True)
