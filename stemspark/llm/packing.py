"""Operator 1: best-fit packing by bin completion.

Pieces are at most `capacity` tokens long, so the instance is a histogram of at most `capacity` sizes however many
documents there are. The driver packs that histogram: around the largest size left it enumerates, one at a time, all
undominated fillings of the gap, prunes branches whose waste rules out fewer bins than the incumbent, and starts from
best-fit decreasing. A filling is applied as often as its sizes last, and once. One budget of steps bounds the search, or
none, which finds the fewest bins there can be. Executors then give every piece its rank among those of its length, and the
rank its place.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import DEFAULT, encoder
from .common import cut, lean, prepare, read_documents

CAPACITY = 2048
#: Steps of the driver's search (states and choices within fillings), which only affect how close to the fewest bins it comes.
SEARCH_STEPS = 200_000
#: So many fillings of a gap are put in order, the fullest first, before the next ones are enumerated.
ORDERED = 500


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and the end id, cut if longer than the capacity; then the first piece is the short one.

    Null text is empty: the end id alone. Rows are taken as they come, with null or repeated doc_ids; each gives its own pieces.
    """
    prepare(docs.sparkSession)

    def run(batches):
        own, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode_batch([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Steps:
    """What the search may still do; None: no bound."""

    def __init__(self, n: int | None):
        self.left = n

    def take(self) -> bool:
        if self.left is None:
            return True
        self.left -= 1
        return self.left >= 0


def spread_bits(bits: int, n: int) -> int:
    """The bits moved up by 1, by 2 and so on to n, together."""
    out, span = (bits << 1 if n else 0), 1
    while span < n:
        step = min(span, n - span)
        out |= out << step
        span += step
    return out


def dominated(chosen: tuple[int, ...], room: int, left_out: int) -> bool:
    """Whether a size left out (a bit each) fits the room, or could take the place of chosen ones for a larger sum, or of several for the same sum."""
    one, several = 0, 0  # sums of one chosen size, and of two or more
    for size in chosen:
        several |= (several | one) << size
        one |= 1 << size
    return bool((spread_bits(1 | one | several, room) | several) & left_out)


def fillings(gap: int, counts: dict[int, int], steps: Steps):
    """The undominated fillings of a gap by some of the sizes, larger sizes first."""
    sizes = sorted(s for s, n in counts.items() if n and s <= gap)
    stack = [(len(sizes) - 1, gap, ())]
    while stack and steps.take():
        i, room, chosen = stack.pop()
        i = min(i, bisect_right(sizes, room) - 1)
        if i < 0:
            left_out = sum(1 << s for s in sizes if counts[s] > chosen.count(s))
            if not dominated(chosen, room, left_out):
                yield chosen
            continue
        stack.append((i - 1, room, chosen))  # without more of this size
        if counts[sizes[i]] > chosen.count(sizes[i]):
            stack.append((i, room - sizes[i], (*chosen, sizes[i])))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: of the sizes of at least a, those over half need a bin each, and the smaller ones the room beside them or more."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for a in {0, *(s for s in sizes.tolist() if 2 * s <= capacity)}:
        alone, large, small = sizes > capacity - a, (2 * sizes > capacity) & (sizes <= capacity - a), (sizes >= a) & (2 * sizes <= capacity)
        beside = int((n[large] * (capacity - sizes[large])).sum())
        more = -(-max(0, int((n[small] * sizes[small]).sum()) - beside) // capacity)
        best = max(best, int(n[alone].sum() + n[large].sum()) + more)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram: (times, sizes of one bin)."""
    bins: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, groups in bins.items() if r >= size and groups), default=None)
            if room is None:
                each = capacity // size
                if left >= each:
                    bins.setdefault(capacity - each * size, []).append([left // each, (size,) * each])
                if left % each:
                    bins.setdefault(capacity - left % each * size, []).append([1, (size,) * (left % each)])
                break
            times, items = group = bins[room][-1]
            used = min(left, times)
            left -= used
            group[0] -= used
            if not group[0]:
                bins[room].pop()
            bins.setdefault(room - size, []).append([used, (*items, size)])
    return [(n, items) for groups in bins.values() for n, items in groups]


def pack_sizes(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = SEARCH_STEPS) -> list[tuple[int, tuple[int, ...]]]:
    """Bin completion: as few bins as the search finds within its steps, as (times, sizes of one bin). steps None: as few as there can be."""
    counts = {s: n for s, n in counts.items() if n}
    total, least, budget = sum(s * n for s, n in counts.items()), least_bins(counts, capacity) if counts else 0, Steps(steps)
    best = best_fit(counts, capacity)
    fewest, seen = sum(n for n, _ in best), {}

    def branches(have: dict[int, int]):
        """(times, bin): each filling around the largest size as often as it goes, and once."""
        top = max(have)
        rest = have | {top: have[top] - 1}
        found = fillings(capacity - top, rest, budget)
        while some := sorted(islice(found, ORDERED), key=sum, reverse=True):
            for fill in some:
                uses = Counter((top, *fill))
                times = min(have[s] // k for s, k in uses.items())
                yield times, (top, *fill), uses
                if times > 1:
                    yield 1, (top, *fill), uses

    stack = [(counts, branches(counts), 0, 0, None)] if fewest > least else []
    while stack and fewest > least:
        have, rest, n_bins, waste, path = stack[-1]
        step = next(rest, None)
        if step is None or not budget.take():
            stack.pop()
            continue
        times, items, uses = step
        now, bins = waste + times * (capacity - sum(items)), n_bins + times
        if total + now > (fewest - 1) * capacity:  # cannot end with fewer bins
            continue
        left = {s: n - times * uses.get(s, 0) for s, n in have.items() if n > times * uses.get(s, 0)}
        made = (path, (times, items))
        if not left:
            if bins < fewest:
                fewest, best = bins, []
                while made:
                    made, one = made
                    best.append(one)
            continue
        key = hashlib.blake2b(repr(sorted(left.items())).encode(), digest_size=16).digest()
        if seen.get(key, fewest) > bins:  # not reached before with as few bins
            seen[key] = bins
            stack.append((left, branches(left), bins, now, made))
    return best


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (size, first rank, first sequence, copies a sequence, offset), by size and rank: where the pieces of each size go."""
    rows, sequence, taken = [], 0, Counter()
    for times, items in patterns:
        at = 0
        for size, copies in sorted(Counter(items).items(), reverse=True):
            rows.append((size, taken[size], sequence, copies, at))
            taken[size] += times * copies
            at += copies * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. No piece is dropped; an empty table gives no rows, repeated rows are packed as often as they occur.

    Pieces of one length are interchangeable: which of them goes where follows doc_id (null first), piece and checksum.
    The pieces are written once to the shared folder, since the histogram and the ranks must see the same rows.
    """
    spark = found.sparkSession
    found = cut(found)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = places(pack_sizes(counts, capacity))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a length may be that of a third of all pieces, so ranks are taken within salted parts and shifted by the parts before
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    shift = parts.withColumn("shift", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("shift", F.lit(0)).alias("shift"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(shift, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("shift")).alias("rank"))

    def run(batches):
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(key, (size << 44) + rank, "right") - 1]
            within = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + within // np.maximum(row[:, 3], 1)), pa.array(row[:, 4] + within % np.maximum(row[:, 3], 1) * size)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(read_documents(spark, sf_dir)))
