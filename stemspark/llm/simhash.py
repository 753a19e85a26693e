"""Operator 6: SimHash near-duplicates by a binary trie self-join.

Equal fingerprints collapse first. Two fingerprints that differ in at most `budget` bits agree in one of budget + 1 blocks of
their bits, so fingerprints meet in the buckets of their blocks; a bucket that is too large for a task is split again by blocks
of the bits it does not share, until it fits or few free bits bound it. Within buckets, node pairs of the binary trie over the
free bits are traversed together: differing bits accumulate over path-compressed nodes, and a pair is dropped once they exceed
the budget, or when all leaves below it are known to hang together. Only links that join two parts are returned, so a group of
any size gives fewer links than it has members.

The stage of the pipeline links by similarity: Jaccard 0.8 or more of the sets of five-word shingles. At 0.8 one fingerprint bit in
6.6 differs, so that a set has a fingerprint of 896 bits; each of its 37 parts of 24 bits is joined as above, with a budget of 2,
and a pair is a candidate if two whole words of the fingerprint are near, too. Candidates are verified by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, cut, guarded, lean, lean_group, prepare, read_documents, spread_join, text_sum

BITS, BUDGET, WORDS, SEED = 64, 4, 4, 42
#: A bucket of more fingerprints is split further; and the rows a task joins at once, the node pairs it expands at once.
BUCKET, ROWS, PAIRS = 20_000, 20_000, 200_000
#: So many links, 32 MB, are united by one task; more by stars in rounds.
UNITED = 2_000_000
#: So few free bits bound a bucket by themselves.
FREE_BITS = 16
#: The stage: words a shingle, least Jaccard similarity; words of a fingerprint.
STAGE_WORDS, SIMILARITY, WIDE = 5, 0.8, 14
#: Tables, each of three bytes of the fingerprint, and the bits that may differ in one: leaves out (1 - 0.273) ** 37 = 8e-6 of the pairs at 0.8, fewer above.
TABLES, TABLE_BUDGET = 37, 2
#: Leaves of a node that are compared one by one.
LEAVES = 8
#: The first words of the fingerprint and their bits that may differ (of a pair at 0.8: 19, deviation 4); the same of all words (135, deviation 11).
HEAD, HEAD_BUDGET, WIDE_BUDGET = 2, 40, 224
#: A set in a table: its three bytes, key and first words; sets that are dealt to tables at once.
ENTRY, DEALT = np.dtype([("value", "<u4"), ("fp", "<i8"), ("head", "<u8", (HEAD,))]), 8192
#: Hashes, and members, that a task of the stage compares at once.
PART_HASHES, PART_MEMBERS = 500_000, 10_000
_FACTORS, _ADDENDS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, WIDE), np.uint64)
_FACTORS |= np.uint64(1)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The majority of each bit over the hashes of all shingles, repeats included; no words: zero."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (signed). Null text: as empty."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t or "", words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, fp long")


def blocks_of(mask: int, parts: int) -> list[int]:
    """The mask with one of its free bits' contiguous blocks added, by block."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Parts:
    """Labels of connected parts; the smallest member labels a part."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins the pairs; returns those links (pairs of former labels) that joined something."""
        made = []
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            first = np.concatenate([[True], high[order][1:] != high[order][:-1]])
            keep = order[first]  # one link a label that gives way, to the smallest
            made.append(np.stack([low[keep], high[keep]]))
            to = np.arange(len(self.label))
            to[high[keep]] = low[keep]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]
        return tuple(np.concatenate(made, axis=1)) if made else (np.zeros(0, int), np.zeros(0, int))


def trie_links(bucket: np.ndarray, value: np.ndarray, budget: int = BUDGET, check=None, leaves: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) that connect whatever differs in at most `budget` bits within a bucket, and passes check(i, j). Sorted by bucket, value.

    A node is a run of sorted leaves; its depth is the number of leading bits all of them share. Runs of equal values are halved.
    Pairs of nodes of at most `leaves` leaves, if that is over one, are compared leaf by leaf.
    """
    n = len(value)
    parts, links = Parts(n), []
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.concatenate([starts[1:], [n]]) - 1

    def depth(a, z):
        x = value[a] ^ value[z]
        upper = x >> np.uint64(32)
        high = np.frexp(np.where(upper > 0, upper, x).astype(np.float64))[1] - 1 + 32 * (upper > 0)  # halves are exact as doubles
        return np.where(a == z, BITS + 1, np.where(x == 0, BITS, BITS - 1 - high))

    def split(a, z, d):
        """The first leaf of the right child: the first with bit d set; of equal values the middle one."""
        even = d >= BITS
        low, high = np.where(even, (a + z + 1) // 2, a), np.where(even, (a + z + 1) // 2, z)
        bit = np.uint64(1) << np.maximum(BITS - 1 - d, 0).astype(np.uint64)
        while (low < high).any():
            mid = (low + high) // 2
            right = value[mid] & bit > 0
            high, low = np.where(right, mid, high), np.where(right, low, np.minimum(mid + 1, high))
        return low

    def prefix_errors(a, c, d):
        """Differing bits among the first d."""
        x = np.where(d > 0, (value[a] ^ value[c]) >> (BITS - np.clip(d, 1, BITS)).astype(np.uint64), np.uint64(0))
        return np.bitwise_count(x)

    def join(x, y):
        if check:
            passed = check(x, y)
            x, y = x[passed], y[passed]
        links.append(np.stack(parts.join(x, y)))

    many = ends > starts
    stack = [(starts[many], ends[many], starts[many], ends[many])]
    while stack:
        a, b, c, d = stack.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            stack += [(a[half:], b[half:], c[half:], d[half:])]
            a, b, c, d = a[:half], b[:half], c[:half], d[:half]
            stack.append((a, b, c, d))
            continue
        # below a pair whose leaves all hang together there is nothing to learn
        runs = np.cumsum(np.concatenate([[0], parts.label[1:] != parts.label[:-1]]))
        open_ = (runs[a] != runs[b]) | (runs[c] != runs[d]) | (parts.label[a] != parts.label[c])
        a, b, c, d = a[open_], b[open_], c[open_], d[open_]
        same = a == c
        depth_1, depth_2 = depth(a, b), depth(c, d)
        near = same | (prefix_errors(a, c, np.minimum(depth_1, depth_2)) <= budget)
        a, b, c, d, same, depth_1, depth_2 = (v[near] for v in (a, b, c, d, same, depth_1, depth_2))
        if leaves > 1:
            few = (b - a < leaves) & (d - c < leaves)
            ones = [np.minimum(a[few] + k, b[few]) for k in range(leaves)]  # shorter nodes repeat their last leaf
            others = [np.minimum(c[few] + k, d[few]) for k in range(leaves)]
            value_1, value_2, met = [value[x] for x in ones], [value[x] for x in others], []
            for i in range(leaves):
                for k in range(leaves):
                    at = np.flatnonzero(np.bitwise_count(value_1[i] ^ value_2[k]) <= budget)
                    x, y = ones[i][at], others[k][at]
                    apart = parts.label[x] != parts.label[y]
                    met.append(np.stack([x[apart], y[apart]]))
            join(*np.concatenate(met, axis=1))
            a, b, c, d, same, depth_1, depth_2 = (v[~few] for v in (a, b, c, d, same, depth_1, depth_2))
        leaf = ~same & (a == b) & (c == d)
        if leaf.any():
            join(a[leaf], c[leaf])
        inner = same & (a < b)
        new = []
        if inner.any():
            low, high = a[inner], b[inner]
            m = split(low, high, depth_1[inner])
            new.append((low, m - 1, m, high))
            for x, y in ((low, m - 1), (m, high)):
                more = x < y
                new.append((x[more], y[more], x[more], y[more]))
        first = ~same & ~leaf & (depth_1 <= depth_2)  # the shallower node is opened
        second = ~same & ~leaf & ~(depth_1 <= depth_2)
        if first.any():
            low, high, x, y = a[first], b[first], c[first], d[first]
            m = split(low, high, depth_1[first])
            new += [(low, m - 1, x, y), (m, high, x, y)]
        if second.any():
            low, high, x, y = c[second], d[second], a[second], b[second]
            m = split(low, high, depth_2[second])
            new += [(x, y, low, m - 1), (x, y, m, high)]
        if new:
            stack.append(tuple(np.concatenate(v) for v in zip(*new, strict=True)))
    return tuple(np.concatenate(links, axis=1)) if links else (np.zeros(0, int), np.zeros(0, int))


def _join_buckets(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket (mask, key) and fp; whole buckets are joined, many at a time."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray):
        bucket = np.cumsum(np.concatenate([[0], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
        value = rows[:, 2].view(np.uint64) if rows[:, 2].flags.c_contiguous else np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        order = np.lexsort((value, bucket))
        i, j = trie_links(bucket[order], value[order], budget)
        out = np.ascontiguousarray(rows[order, 2])
        return pa.RecordBatch.from_arrays([pa.array(out[i]), pa.array(out[j])], ["a", "b"])

    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")], 1).astype(np.int64))
        size += batch.num_rows
        if size >= ROWS:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            edge = last[-1] + 1 if len(last) else 0
            if edge:
                yield links(rows[:edge])
            held, size = [rows[edge:]], len(rows) - edge
    if size:
        yield links(np.concatenate(held))


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that differ in at most `budget` bits."""
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    current = distinct.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("key"), "fp")
    masks, found = [0], []
    while True:
        wider = [(signed(m), signed(w)) for m in masks for w in blocks_of(m, budget + 1)]
        table = {}
        for m, w in wider:
            table.setdefault(m, []).append(w)
        arrays = F.create_map(*(F.lit(x) if k == 0 else F.array(*(F.lit(w) for w in x)) for m, ws in table.items() for k, x in enumerate((m, ws))))
        current = cut(current.select("fp", F.explode(arrays[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct())
        masks = sorted({w % (1 << 64) for _, w in wider})
        free = BITS - min(bin(m).count("1") for m in masks)
        crowded = current.groupBy("mask", "key").count().where(F.col("count") > BUCKET) if free > FREE_BITS else None
        crowded = cut(crowded.select("mask", "key")) if crowded is not None else None
        large = crowded is not None and crowded.count() > 0
        small = current.join(crowded, ["mask", "key"], "left_anti") if large else current
        rows = small.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp")
        found.append(rows.mapInArrow(lean(lambda batches: _join_buckets(batches, budget)), "a long, b long"))
        if not large:
            break
        current = current.join(crowded, ["mask", "key"], "left_semi")
        masks = sorted({r["mask"] % (1 << 64) for r in crowded.select("mask").distinct().collect()})  # a few a level
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links at once."""
    held = [np.stack([batch.column(c).to_numpy() for c in ("low", "high")]) for batch in batches if batch.num_rows]
    if held:
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        parts, at = Parts(len(nodes)), at.reshape(2, -1)
        parts.join(at[0], at[1])
        below = np.flatnonzero(parts.label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[parts.label[below]])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with a link: the smallest node reachable. Up to UNITED links one task unites them, so that the driver plans
    few jobs; more by alternating large and small stars until only stars are left."""
    current = cut(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    if current.count() <= UNITED:
        return cut(current.coalesce(1).mapInArrow(lean(_unite), "node long, root long"))
    while True:
        # large star: larger neighbours go to the smallest of a node and its neighbours
        both = current.union(current.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = cut(both.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("m"), F.count("*").alias("n")))
        large = cut(spread_join(both, least, ["low"], "n").where(F.col("high") > F.col("low")).select(F.col("m").alias("low"), "high").where("low <> high").distinct())
        # small star: smaller neighbours and the node itself go to its smallest
        least = cut(large.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, least, ["high"], "n").select(F.col("m").alias("low"), F.when(F.col("low") == F.col("m"), F.col("high")).otherwise(F.col("low")).alias("high"))
        current = cut(small.where("low <> high").distinct())
        # stars: no node hangs on two, and none on one that hangs itself
        ends = current.select(F.col("high").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(current.select("low", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1 AND below > 0").isEmpty():
            return current.select(F.col("high").alias("node"), F.col("low").alias("root"))


def _named(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """The columns of rows, which have fp, with least: the smallest `first` that edges between fps reach. distinct: fp, first, n."""
    roots = components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    least = cut(named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("size")))
    named = cut(spread_join(named, least, ["root"], "size").select("fp", "n", "least"))
    return spread_join(rows, named, ["fp"], "n").select(*rows.columns, "least")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most `budget` bits reach.

    Null text is empty; rows without words have fingerprint zero and link like any other. A null doc_id counts as larger than any;
    a component without a doc_id has a null component_id.
    """
    rows = cut(fingerprints(docs, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    return _named(rows, distinct, links(distinct.select("fp"), budget)).select("doc_id", "fp", F.col("least").alias("component_id"))


# The stage of the pipeline: Jaccard similarity of word shingles


def shingles(text: str, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in each), np.uint64))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """The majority of each bit over the hashes of a set, each spread to WIDE words; sets without shingles have none."""
    if not len(found):
        return np.zeros(0, np.uint64)
    ones = np.zeros(BITS * WIDE, np.int64)
    for at in range(0, len(found), 255):
        mixed = found[at : at + 255, None] ^ _ADDENDS
        mixed *= _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)  # 255 rows at most
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket (a byte of the fingerprint and its value), entries of the sets that have it."""

    def entries(fp: np.ndarray, wide: np.ndarray):
        raw = wide.view(np.uint8)
        for at in range(3 * TABLES):
            table = at // 3 * 3
            order = np.argsort(raw[:, at], kind="stable")
            own = raw[order, table : table + 3].astype(np.uint32)
            out = np.empty(len(order), ENTRY)
            out["value"], out["fp"], out["head"] = own[:, 0] << 16 | own[:, 1] << 8 | own[:, 2], fp[order], wide[order, :HEAD]
            keys = raw[order, at]
            last = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]]))
            yield pa.RecordBatch.from_arrays([pa.array(at * 256 + keys[last].astype(np.int64)), byte_rows(out, last + 1)], ["bucket", "entries"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("fp").to_numpy(), np.frombuffer(b"".join(batch.column("wide").to_pylist()), "<u8").reshape(-1, WIDE)))
            size += batch.num_rows
        if size >= DEALT:
            yield from entries(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield from entries(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _join_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are joined by tries, many at a time."""

    def links(bucket: np.ndarray, rows: np.ndarray):
        order = np.lexsort((rows["value"], bucket))
        bucket, rows = bucket[order], rows[order]
        head = np.ascontiguousarray(rows["head"])
        near = lambda x, y: np.bitwise_count(head[x] ^ head[y]).sum(1) <= HEAD_BUDGET
        i, j = trie_links(bucket, rows["value"].astype(np.uint64) << np.uint64(BITS - 24), TABLE_BUDGET, near, LEAVES)
        return pa.RecordBatch.from_arrays([pa.array(rows["fp"][i]), pa.array(rows["fp"][j])], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        raw = batch.column("entries").to_pylist()
        held.append((np.repeat(batch.column("bucket").to_numpy(), [len(r) // ENTRY.itemsize for r in raw]), np.frombuffer(b"".join(raw), ENTRY)))
        size += len(held[-1][0])
        if size >= ROWS:
            bucket, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.searchsorted(bucket, bucket[-1])
            if edge:
                yield links(bucket[:edge], rows[:edge])
            held, size = [(bucket[edge:], rows[edge:])], len(bucket) - edge
    if size:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def candidates(distinct: DataFrame) -> DataFrame:
    """a, b: links between sets (fp, and their wide fingerprints) that connect all that are within the budgets in some table."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = distinct.where(F.length("wide") > 0).select("fp", "wide").mapInArrow(lean(_deal), "bucket long, entries binary")
    return buckets.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_join_tables), "a long, b long")


def set_key(found: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)) if len(found) else 0


def verified_links(sets: list[np.ndarray], wide: np.ndarray, label: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (indices) that connect all sets with near fingerprints and a Jaccard similarity of `least` or more. label: parts known before."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    local = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, label, links = np.zeros(len(local), bool), np.unique(label, return_inverse=True)[1], []
    for y in range(1, len(sets)):
        low, high = np.minimum(sizes[:y], sizes[y]), np.maximum(sizes[:y], sizes[y])
        rest = np.flatnonzero((label[:y] != label[y]) & (low >= least * high))
        rest = rest[np.bitwise_count(wide[rest] ^ wide[y]).sum(1, dtype=np.int64) <= WIDE_BUDGET]
        own, take = local[ends[y] - sizes[y] : ends[y]], 1
        mark[own] = True
        while len(rest):  # a dense part is met at the first of its members
            some, rest = rest[:take], rest[take:]
            common = np.array([np.count_nonzero(mark[local[ends[x] - sizes[x] : ends[x]]]) for x in some])
            for x in some[common >= least * (sizes[some] + sizes[y] - common)]:
                if label[x] != label[y]:
                    links.append((int(x), int(y)))
                    label[label == label[x]] = label[y]
            rest, take = rest[label[rest] != label[y]], min(4 * take, 1024)
        mark[own] = False
    return links


def _verify(table: pa.Table) -> pa.Table:
    """Links a, b within the members of one group."""
    first = {k: at for at, k in enumerate(table.column("fp").to_pylist())}  # rows that repeat a document are one member
    keys, at = list(first), list(first.values())
    sets = [np.frombuffer(table.column("hashes")[i].as_buffer(), "<u8") for i in at]
    wide = np.stack([np.frombuffer(table.column("wide")[i].as_buffer(), "<u8") for i in at])
    found = verified_links(sets, wide, table.column("label").to_numpy()[at])
    return pa.table([pa.array([keys[x] for x, _ in found], pa.int64()), pa.array([keys[y] for _, y in found], pa.int64())], names=["a", "b"])


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, sum (of the text), fp (of the shingle set), component_id (the smallest doc_id that links of SIMILARITY or more reach), kept.

    Equal sets collapse first. Sets whose wide fingerprints the trie joins find near are candidates; those that hang together meet in one task,
    which verifies by the sets themselves. What is too large for a task is dealt into parts: first each part, then, as long as that joins
    half of them, one member of each component found so, then, unless all members of the group hang together by now, each pair of its parts.
    Null texts, rows without words and null doc_ids are as in near_duplicates. Of each component the document with the smallest
    (doc_id, sum) is kept, null doc_ids last; rows that share a doc_id only are several documents, rows that repeat both are one.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), "text", text_sum().alias("sum"))

    def keys(batches):
        for batch in batches:
            found = [shingles(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sum"), pa.array([set_key(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([wide_fingerprint(x).tobytes() for x in found], pa.binary())],
                ["doc_id", "sum", "fp", "size", "wide"],
            )

    def contents(batches):
        for batch in batches:
            hashes = [shingles(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "part", "parts", "fp")), pa.array(hashes, pa.binary()), batch.column("wide")], ["root", "part", "parts", "fp", "hashes", "wide"])

    rows = cut(own.mapInArrow(lean(keys), "doc_id long, sum long, fp long, size long, wide binary"))
    distinct = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sum")).alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("wide").alias("wide")))
    edges = cut(candidates(distinct))
    roots = components(edges)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = cut(distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "first", "size", "wide", "root"))
    dealt = lambda hashes: F.greatest(F.ceil(F.sum(hashes + WIDE) / PART_HASHES), F.ceil(F.count("*") / PART_MEMBERS))
    weights = members.groupBy("root").agg(dealt(F.col("size")).alias("parts"))
    members = members.join(weights, "root").select("fp", "first", "wide", "root", "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
    sent = cut(own.join(members, F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sum") == F.col("first.sum"))).select("root", "part", "parts", "fp", "wide", "text").mapInArrow(lean(contents), "root long, part long, parts long, fp long, hashes binary, wide binary"))
    found = cut(sent.withColumn("label", F.col("fp")).groupBy("root", "part").applyInArrow(lean_group(_verify), "a long, b long"))
    large = sent.where("parts > 1")
    if not large.isEmpty():
        # one member of each component found so far meets others, as long as that joins half of them: a dense group hangs together before its parts meet
        labelled = lambda known: large.join(known, large["fp"] == known["node"], "left").select(large["root"], "part", "parts", "fp", "hashes", "wide", F.coalesce(known["root"], "fp").alias("label"))
        left, tries = None, 0
        while True:
            first = cut(labelled(components(found)).where("fp = label"))
            weights = cut(first.groupBy("root").agg(dealt(F.length("hashes") / 8).alias("few"), F.count("*").alias("n")))
            n, most = weights.agg(F.sum("n"), F.max("few")).first()
            if left and 2 * n > left:  # too few were joined for another round to pay
                break
            left, tries = n, tries + 1
            first = first.join(weights, "root").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(tries)), F.col("few"))).select("root", "part", "parts", "fp", "hashes", "wide", "label")
            found = cut(found.union(first.groupBy("root", "part").applyInArrow(lean_group(_verify), "a long, b long")))
            if most <= 1:
                break
        loose = labelled(components(found))
        open_ = loose.groupBy("root").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("root")
        pairs = loose.join(open_, "root", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("other <> part")
        pairs = pairs.groupBy("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        found = found.union(cut(pairs.applyInArrow(lean_group(_verify), "a long, b long")))
    named = _named(rows.select("doc_id", "sum", "fp"), distinct.select("fp", "first", "n"), found)
    return named.select("doc_id", "sum", "fp", F.col("least.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("sum") == F.col("least.sum"))).alias("kept"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@guarded
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays: the one with the smallest doc_id, null doc_ids last.

    Documents are rows told apart by doc_id and text: a row that shares its doc_id with a dropped one but has another text is judged
    by its own text, and rows that repeat both stay or go together. Null text is as empty; all texts without words are one component.
    """
    dropped = similar(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped_id"), F.col("sum").alias("_dropped_sum")).distinct()
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("_dropped_id")) & (text_sum() == F.col("_dropped_sum")), "left_anti").select(*docs.columns)
