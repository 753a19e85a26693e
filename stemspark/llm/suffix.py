"""Operator 10: removal of repeated passages by longest previous factors.

A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller doc_id. Ordering every suffix
of the corpus would move many times its size, so suffixes meet in buckets:

- the least hash among the 16-byte strings of a window of `length` bytes is the same wherever the window occurs; a run of windows
  with the same least hash is a unit. Equal units collapse, first within a group of documents, then within the bucket of the hash.
  Where a unit also occurs in a smaller document, all its windows are repeats;
- a 16-byte string that would be least in very many different units, found on a sample of groups, counts as larger than all others
  wherever it occurs. That only changes which string stands for a window, so a bucket stays small and no result depends on the sample;
- units of the same least hash but other bytes may still share windows (the ends of a passage). Only those send their bytes. The
  suffixes in a bucket are put in order with the common prefixes of neighbours; the previous and next smaller positions, by document,
  give each suffix its longest previous factor. A suffix whose factor reaches `length` is a repeat.

Documents are grouped by a hash of their doc_id and text and read three times from one shuffle of the texts; all else that moves is hashes,
index lists and the bytes of differing units.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, guarded, lean_cogroup, lean_group, prepare, read_documents, whole_text

LENGTH, GRAM, RUN = 50, 16, 48
#: Bytes of text a group of documents has, and the most that are hashed at once.
GROUP_BYTES, CHUNK = 8 << 20, 1 << 17
#: Into how many parts of its least hashes a bucket is split before bytes meet in it.
PARTS = 16
#: A string least in more distinct units than this, or than this share of all, is avoided; so many groups are looked at.
HOT_UNITS, HOT_SHARE, SAMPLED = 100_000, 1e-6, 8
#: Bytes of text a unit has on average, and the fewest sightings in the sample that count.
UNIT_BYTES, SIGHTINGS = 17, 3
#: Hashes are cut to 48 bits; a unit is known by two of them.
CUT = np.uint64((1 << 48) - 1)
NO_DOC = np.iinfo(np.int64).max
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
SCHEMA = "key int, bid int, bucket int, kind int, data binary"
UNITS, DONE, WANTED, BYTES, MASKS = range(5)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    h = left * _A
    h += right * _B
    h ^= h >> np.uint64(31)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of each run of 16 bytes, from the two words that begin at each byte."""
    words = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,)).astype(np.uint64) if len(data) >= GRAM else np.zeros(8, np.uint64)
    h = words[:-8] * _A
    h ^= h >> np.uint64(32)
    h += words[8:]
    h *= _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def _windows(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the `LENGTH` bytes at each place, from the strings that cover them."""
    return _mixed(_mixed(grams[at], grams[at + 16]), _mixed(grams[at + 32], grams[at + LENGTH - GRAM]))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


class Avoided:
    """The 48-bit hashes of strings to avoid; a small table of their last bits spares most lookups."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def demoted(self, order: np.ndarray) -> np.ndarray:
        """Hashes of 63 bits, of which the avoided ones come after all others."""
        at = np.flatnonzero(self.maybe[(order & np.uint64((1 << 20) - 1)).astype(np.int64)])
        cut = order[at] & CUT
        found = self.hashes[np.minimum(np.searchsorted(self.hashes, cut), len(self.hashes) - 1)] == cut
        order[at[found]] |= np.uint64(1 << 63)
        return order


def units_of(data: np.ndarray, ends: np.ndarray, avoided: Avoided | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, least hash, hash of the bytes) of each unit of texts that lie end to end, up to `ends`.

    No window crosses the end of a text. The bytes are hashed in parts that overlap, so no window is lost.
    """
    found = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        h = _grams(data[at : at + CHUNK + LENGTH - 1])
        order = h >> np.uint64(1)
        least = _least(order if avoided is None else avoided.demoted(order), LENGTH - GRAM + 1)
        n = len(least)
        near = ends[np.searchsorted(ends, at + 1) : np.searchsorted(ends, at + n + LENGTH)] - at
        crossing = np.zeros(n + 1, np.int32)
        np.add.at(crossing, np.clip(near - LENGTH + 1, 0, n), 1)
        np.add.at(crossing, np.clip(near, 0, n), -1)
        crossing = np.cumsum(crossing[:-1], dtype=np.int32) > 0
        start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (crossing[1:] != crossing[:-1])]))
        size = np.diff(np.concatenate([start, [n]]))
        inside = ~crossing[start]
        start, size = start[inside], size[inside]
        if (size > RUN).any():
            pieces = -(-size // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, size = np.repeat(start, pieces) + nth * RUN, np.minimum(RUN, np.repeat(size, pieces) - nth * RUN)
        # the windows at the start and at the end cover the whole unit
        whole = _mixed(_mixed(_windows(h, start), _windows(h, start + size - 1)), size.astype(np.uint64))
        found.append((start + at, size, least[start] & CUT, whole & CUT))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Group:
    """The documents of a group, smallest doc_id first, and their distinct units in order of first occurrence."""

    def __init__(self, table: pa.Table, buckets: int, avoided: Avoided | None = None):
        ids = np.array([NO_DOC if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        raw = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
        self.order, self.ids, raw = order, ids[order], [raw[i] for i in order]
        self.ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.start, self.size, least, whole = units_of(self.data, self.ends, avoided)
        self.doc = np.searchsorted(self.ends, self.start, "right")
        order = np.argsort(least ^ whole * _A, kind="stable")  # equal units are neighbours, in order of occurrence
        fresh = np.ones(len(order), bool)
        fresh[1:] = (least[order][1:] != least[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        first = order[fresh]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(fresh) - 1
        by_place = np.argsort(first)
        rank = np.empty(len(first), np.int64)
        rank[by_place] = np.arange(len(first))
        self.unit, self.first = rank[of], first[by_place]  # by occurrence, its distinct unit; by distinct unit, its first occurrence
        self.least, self.whole = least[self.first], whole[self.first]
        self.first_id = self.ids[self.doc[self.first]] if len(self.first) else np.zeros(0, np.int64)
        self.bucket = (self.least % np.uint64(buckets)).astype(np.int64)
        self.by_bucket = np.argsort(self.bucket, kind="stable")
        self.edges = np.searchsorted(self.bucket[self.by_bucket], np.arange(buckets + 1))

    def of_bucket(self, b: int) -> np.ndarray:
        """The distinct units of a bucket; lists that come back hold places in this one."""
        return self.by_bucket[self.edges[b] : self.edges[b + 1]]

    def parts_of(self, b: int, places: np.ndarray, buckets: int):
        """The places in a bucket's list, by part of the bucket."""
        part = (self.least[self.of_bucket(b)[places]] // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64)
        for k in np.unique(part).tolist():
            yield places[part == k], k


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "bid", "bucket", "kind", "data"])


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def count_units(table: pa.Table) -> pa.Table:
    """Of a sampled group, each least hash and how many distinct units have it."""
    least, n = np.unique(Group(table, 1).least, return_counts=True)
    return pa.table([pa.array(least.astype(np.int64)), pa.array(n.astype(np.int64))], names=["least", "n"])


def strings_to_avoid(own: DataFrame, groups: int, total: int) -> np.ndarray:
    """Hashes least in very many distinct units, by a sample of SAMPLED groups or a few more; no more than a third of the sample's units reach the driver."""
    most = max(HOT_UNITS, HOT_SHARE * total / UNIT_BYTES)
    if total / UNIT_BYTES <= most:
        return np.zeros(0, np.uint64)
    every = max(1, groups // SAMPLED)
    counts = own.where(F.col("bid") % every == 0).groupBy("bid").applyInArrow(lean_group(count_units), "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(SIGHTINGS, most * len(range(0, groups, every)) / groups)).select("least").toPandas()
    return found["least"].to_numpy(np.uint64)


def send_units(buckets: int, avoided: Callable[[], Avoided | None]):
    """Of each group, to each bucket: least hashes, hashes, and the smallest document of each distinct unit."""

    def run(table: pa.Table) -> pa.Table:
        own, bid, rows = Group(table, buckets, avoided()), table.column("bid")[0].as_py(), []
        for b in np.unique(own.bucket).tolist():
            u = own.of_bucket(b)
            steps = np.diff(own.first_id[u], prepend=0)  # ascending: long runs of nothing compress well
            rows.append((b, bid, b, UNITS, _pack(own.least[u]) + _pack(own.whole[u]) + steps.astype("<i8").tobytes()))
        return _rows(rows)

    return run


def meet_units(table: pa.Table) -> pa.Table:
    """In a bucket: which units' smallest document in a group isn't the smallest of all; and which must send their bytes."""
    sent = sorted(zip(table.column("bid").to_pylist(), table.column("data").to_pylist(), strict=True))
    bucket, sizes = table.column("bucket")[0].as_py(), [len(d) // 20 for _, d in sent]
    least = np.concatenate([_unpack(d[: 6 * n]) for (_, d), n in zip(sent, sizes, strict=True)])
    whole = np.concatenate([_unpack(d[6 * n : 12 * n]) for (_, d), n in zip(sent, sizes, strict=True)])
    doc = np.concatenate([np.cumsum(np.frombuffer(d[12 * n :], "<i8")) for (_, d), n in zip(sent, sizes, strict=True)])
    order = np.lexsort((doc, whole, least))
    l, w, d = least[order], whole[order], doc[order]
    new_least = np.concatenate([[True], l[1:] != l[:-1]])
    new_unit = new_least | np.concatenate([[True], w[1:] != w[:-1]])
    smallest = d[np.flatnonzero(new_unit)][np.cumsum(new_unit) - 1]
    kinds = np.add.reduceat(new_unit.astype(np.int64), np.flatnonzero(new_least))[np.cumsum(new_least) - 1]
    done, wanted = np.empty(len(order), bool), np.empty(len(order), bool)
    done[order] = d > smallest
    wanted[order] = new_unit & (kinds > 1)
    rows, at = [], 0
    for (bid, _), n in zip(sent, sizes, strict=True):
        for kind, mark in ((DONE, done), (WANTED, wanted)):
            places = np.flatnonzero(mark[at : at + n])
            if len(places):
                rows.append((bid, bid, bucket, kind, places.astype("<u4").tobytes()))
        at += n
    return _rows(rows)


def send_bytes(buckets: int, avoided: Callable[[], Avoided | None]):
    """Of each group: the bytes of the wanted units, to their buckets; what is known already goes on beside them."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        rows = [(buckets * PARTS + r["bid"], r["bid"], r["bucket"], DONE, r["data"]) for r in found.to_pylist() if r["kind"] == DONE]
        wanted = [r for r in found.to_pylist() if r["kind"] == WANTED]
        if wanted:
            own = Group(texts, buckets, avoided())
            for r, places, part in ((r, places, part) for r in wanted for places, part in own.parts_of(r["bucket"], np.frombuffer(r["data"], "<u4"), buckets)):
                u = own.of_bucket(r["bucket"])[places]
                first = own.first[u]
                sizes = own.size[first] + LENGTH - 1
                nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                head = np.array([len(u)], "<i8").tobytes() + own.first_id[u].astype("<i8").tobytes() + sizes.astype("<u4").tobytes()
                rows.append((r["bucket"] * PARTS + part, r["bid"], r["bucket"], BYTES, head + own.data[np.repeat(own.start[first], sizes) + nth].tobytes() + places.astype("<u4").tobytes()))
        return _rows(rows)

    return run


def suffix_order(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `start` in order, by `length` bytes each, and the common prefix of each with the one before (0 for the first)."""
    words = np.zeros((len(start), -(-length // 8) * 8), np.uint8)
    words[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[start]
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    common, equal = np.zeros(len(start), np.int64), np.ones(len(start) - 1, bool)
    for k in range(words.shape[1]):
        differ = words[1:, k] ^ words[:-1, k]
        here = np.flatnonzero(equal & (differ > 0))
        equal[here] = False
        common[here + 1] = 8 * k + sum((differ[here] >> np.uint64(s) == 0).astype(np.int64) for s in range(8, 64, 8))
        if not equal.any():
            break
    common[np.flatnonzero(equal) + 1] = length
    return order, common


def common_with_smaller(rank: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """By place in suffix order, the common prefix with the previous smaller position: the nearest place before of a smaller rank.

    common: of each place with the one before. All places look at once; one whose candidate isn't smaller goes on to that one's own
    candidate, so that distances double. Common prefixes under `least` are given up and returned as 0.
    """
    to, common = np.arange(len(rank)) - 1, common.copy()
    open_ = np.flatnonzero(common >= least)
    open_ = open_[rank[to[open_]] >= rank[open_]]
    while len(open_):
        at = to[open_]
        further, shared = to[at], np.minimum(common[open_], common[at])
        to[open_], common[open_] = further, shared
        open_ = open_[shared >= least]
        open_ = open_[rank[to[open_]] >= rank[open_]]
    common[common < least] = 0
    return common


def longest_previous_factors(data: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int = LENGTH, least: int | None = None) -> np.ndarray:
    """How many bytes, up to `length`, the suffix at each start shares with one of a smaller document; fewer than `least` count as 0.

    The longest such prefix is shared with the nearest suffix of a smaller document, before or after in suffix order.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    least = length if least is None else least
    order, common = suffix_order(data, start, length)
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)[order]
    before = common_with_smaller(rank, common, least)
    after = common_with_smaller(rank[::-1], np.concatenate([[0], common[:0:-1]]), least)[::-1]
    out = np.empty(len(start), np.int64)
    out[order] = np.maximum(before, after)
    return out


def meet_bytes(table: pa.Table) -> pa.Table:
    """In a bucket: which windows of the units sent also occur in a unit of a smaller document. Rows of what is known pass."""
    rows = table.to_pylist()
    if rows[0]["kind"] != BYTES:
        return _rows([(r["bid"], r["bid"], r["bucket"], r["kind"], r["data"]) for r in rows])
    rows.sort(key=lambda r: r["bid"])
    data, size, doc, places, counts = [], [], [], [], []
    for r in rows:
        n = int(np.frombuffer(r["data"], "<i8", 1)[0])
        doc.append(np.frombuffer(r["data"], "<i8", n, 8))
        size.append(np.frombuffer(r["data"], "<u4", n, 8 + 8 * n).astype(np.int64))
        data.append(r["data"][8 + 12 * n : len(r["data"]) - 4 * n])
        places.append(r["data"][len(r["data"]) - 4 * n :])
        counts.append(n)
    size, doc = np.concatenate(size), np.concatenate(doc)
    windows, begin = size - LENGTH + 1, np.cumsum(size) - size
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    data, at, of = np.frombuffer(b"".join(data), np.uint8), np.repeat(begin, windows) + nth, np.repeat(doc, windows)
    # a window whose hash no other has shares no `LENGTH` bytes with any; the others are put in order
    h = _windows(_grams(data), at)
    order = np.argsort(h)
    again = h[order][1:] == h[order][:-1]
    met = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]
    hit = np.zeros(len(at), bool)
    hit[met] = longest_previous_factors(data, at[met], of[met]) >= LENGTH
    masks = np.add.reduceat(hit.astype(np.uint64) << nth.astype(np.uint64), np.cumsum(windows) - windows)
    out, at = [], 0
    for r, place, n in zip(rows, places, counts, strict=True):
        out.append((r["bid"], r["bid"], r["bucket"], MASKS, place + masks[at : at + n].astype("<u8").tobytes()))
        at += n
    return _rows(out)


def removed_runs(buckets: int, more: int, avoided: Callable[[], Avoided | None]):
    """doc_id, bytes, removed bytes and runs, what is kept, and the further columns, of each document of a group."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        own = Group(texts, buckets, avoided())
        done, masks = np.zeros(len(own.first), bool), np.zeros(len(own.first), np.uint64)
        for r in found.to_pylist():
            u = own.of_bucket(r["bucket"])
            if r["kind"] == DONE:
                done[u[np.frombuffer(r["data"], "<u4")]] = True
            else:
                n = len(r["data"]) // 12
                masks[u[np.frombuffer(r["data"], "<u4", n)]] = np.frombuffer(r["data"], "<u8", n, 4 * n)
        whole = done[own.unit] | (own.ids[own.doc] > own.first_id[own.unit]) if len(own.unit) else np.zeros(0, bool)
        n, begins = len(own.data), np.concatenate([[0], own.ends])[:-1]
        cover = np.zeros(n + 1, np.int8)  # a window starts at a place once, and fewer than a hundred cover a byte
        np.add.at(cover, own.start[whole], 1)
        np.add.at(cover, (own.start + own.size - 1 + LENGTH)[whole], -1)
        part = np.flatnonzero(~whole & (masks[own.unit] > 0)) if len(own.unit) else np.zeros(0, np.int64)
        bits = masks[own.unit[part]]
        for j in range(RUN if len(part) else 0):
            at = own.start[part[bits >> np.uint64(j) & np.uint64(1) > 0]] + j
            np.add.at(cover, at, 1)
            np.add.at(cover, at + LENGTH, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int16) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[begins[begins < n]] = gone[begins[begins < n]]  # a run ends with its text
        lengths = own.ends - begins

        def total(marks: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lengths), np.int64)
            out[lengths > 0] = np.add.reduceat(marks, begins[lengths > 0], dtype=np.int64) if n else 0
            return out

        removed = total(gone)
        made = [pa.array([None if x == NO_DOC else x for x in own.ids.tolist()], pa.int64()), pa.array(lengths), pa.array(removed), pa.array(total(opens)), byte_rows(own.data[~gone], np.cumsum(lengths - removed))]
        passed = texts.select([f"_{k}" for k in range(more)]).take(pa.array(own.order, pa.int64()))
        return pa.table([*made, *passed.columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *passed.column_names])

    return run


def suffix_dedup(docs: DataFrame, group_bytes: int = GROUP_BYTES, pass_on: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row, and the columns passed on, as _0, _1 and so on.

    Null text is empty; a null doc_id is larger than any, and rows with the same doc_id don't remove from one another. Of a tie
    nothing goes: only a strictly smaller doc_id removes. An empty table gives no rows. Rows without a doc_id, or that share one, are
    grouped by their texts; only rows that repeat both, and the parts of one text, must meet in a task.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(pass_on)))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes))
    own = texts.withColumn("bid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "bid")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(f", _{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(pass_on))
    hashes = strings_to_avoid(own, n, total)
    shared = spark.sparkContext.broadcast(Avoided(hashes)) if len(hashes) else None  # bounded by the sample
    avoided = lambda: shared.value if shared else None
    units = own.groupBy("bid").applyInArrow(lean_group(send_units(n, avoided)), SCHEMA)
    met = units.repartition(n, "key").groupBy("key").applyInArrow(lean_group(meet_units), SCHEMA)
    sent = own.groupBy("bid").cogroup(met.repartition(n, "bid").groupBy("bid")).applyInArrow(lean_cogroup(send_bytes(n, avoided)), SCHEMA)
    found = sent.repartition(n, "key").groupBy("key").applyInArrow(lean_group(meet_bytes), SCHEMA)
    return own.groupBy("bid").cogroup(found.repartition(n, "bid").groupBy("bid")).applyInArrow(lean_cogroup(removed_runs(n, len(pass_on), avoided)), schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@guarded
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated passages; a cut sign of UTF-8 becomes U+FFFD. n_chars follows. No document goes."""
    named = docs.withColumn("_null", F.col("text").isNull())
    passed = tuple(c for c in named.columns if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup(named, pass_on=passed)
    text = F.when(~F.col(f"_{passed.index('_null')}"), F.expr("make_valid_utf8(cast(kept AS string))"))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"_{k}") for k, c in enumerate(passed)}
    return found.select(*(made[c].alias(c) for c in docs.columns))
