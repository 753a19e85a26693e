"""Operator 8: token ids in Simple-8b words.

A word's top four bits select how many values of which width its other sixty hold; values of over sixty bits follow an
escape word as they are. Blocks hold whole documents, with the documents' id counts and the block's place in its file, so
a block is decoded without the ones before it, all words of a selector at once.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT, encoder
from .common import byte_rows, lean, prepare, read_documents, remove, shared_dir

#: Values a word and bits each, by selector; the last selector marks an escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
ESCAPE = 15
#: Bits of each 16-bit number, one at least.
BITS_OF = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.int8)
BLOCK_IDS = 1 << 16
#: Fragments the encoder may cache: more than elsewhere, since nothing else is held beside it.
CACHED = 600_000


def encode(values: np.ndarray) -> bytes:
    """Greedy: each word takes as many values as fit."""
    n = len(values)
    wide = BITS_OF[values] if values.dtype == np.uint16 else np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.int8)
    values = values.astype(np.uint64)
    selector = np.full(n, len(COUNTS) - 1, np.int8)
    selector[wide > 60] = ESCAPE
    most, span = wide, 1
    for s in range(len(COUNTS) - 2, -1, -1):  # the widest value among the next COUNTS[s], past the end none
        while span < COUNTS[s]:
            step = min(span, COUNTS[s] - span)
            most = np.maximum(most, np.concatenate([most[step:], np.zeros(min(step, n), np.int8)])[:n])
            span += step
        fits = most <= WIDTHS[s]
        if not fits.any():
            break
        selector[fits] = s
    jump = np.array([*COUNTS, 1, 1])[selector].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += jump[i]
    at = np.array(at, np.int64)
    chosen = selector[at].astype(np.int64)
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]]).astype(np.int64)[: len(at)]
    words = np.zeros(len(at) + int((chosen == ESCAPE).sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for s in np.unique(chosen).tolist():
        rows = chosen == s
        if s == ESCAPE:
            words[place[rows]] = np.uint64(ESCAPE << 60)
            words[place[rows] + 1] = values[at[rows]]
            continue
        word = np.full(int(rows.sum()), s << 60, np.uint64)
        for k in range(COUNTS[s]):
            word |= padded[at[rows] + k] << np.uint64(k * WIDTHS[s])
        words[place[rows]] = word
    return words.astype("<u8").tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    """The first n values."""
    words = np.frombuffer(data, "<u8")
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():  # escapes are rare; what follows one is no word of its own
        if not raw[i]:
            raw[i + 1] = True
    selector[raw] = -1
    held = np.array([*COUNTS, 0, 0, 1])[selector]  # an escape holds none, what follows it one
    start = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        rows = selector == s
        if s == -1:
            out[start[rows]] = words[rows]
        elif s != ESCAPE:
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for k in range(COUNTS[s]):
                out[start[rows] + k] = words[rows] >> np.uint64(k * WIDTHS[s]) & mask
    return out[:n]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, end to end, and where rows begin and end."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def packed_ids(docs: DataFrame, end_id: int = 0, vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, sum, place, n, ids of every row: ids as 16-bit numbers if the vocabulary's fit, else 32-bit ones; null text is empty.

    sum (of the ids) and place (of the row in its task) order rows that share a doc_id, so that many of them need not meet in one task.
    """
    prepare(docs.sparkSession)

    def run(batches):
        own, end, at = encoder(vocabulary, CACHED), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        kind = np.dtype("<u2" if max(own.size, end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            ids = own.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            sums = [zlib.crc32(end, zlib.crc32(i)) for i in ids]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + 1
            data = np.frombuffer(end.join([*ids, b""]), "<u4").astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums, pa.int64()), pa.array(at + np.arange(len(ids))), pa.array(sizes), byte_rows(data, np.cumsum(sizes))], ["doc_id", "sum", "place", "n", "ids"])
            at += len(ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, sum long, place long, n long, ids binary")


def write_blocks(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str = DEFAULT) -> None:
    """Writes the ids of all documents in ascending doc_id order (null first, then by the ids' checksum): one file part a range of doc_ids.

    Texts are encoded where they are read; only packed ids are written, ranged and sorted. An empty table gives an empty file set;
    rows that repeat a doc_id are written as often as they occur.
    """
    spark = docs.sparkSession
    held = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"  # so that finding the ranges does not encode again
    packed_ids(docs, end_id, vocabulary).write.option("compression", "zstd").parquet(held)

    def run(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            counts, (raw, offsets) = batch.column("n").to_numpy(), raw_bytes(batch.column("ids"))
            names, rows, at = batch.column("doc_id").to_pylist(), [], 0
            ends = np.cumsum(counts)
            while at < len(counts):
                start = int(ends[at] - counts[at])
                stop = max(at + 1, int(np.searchsorted(ends, start + BLOCK_IDS)) + 1)
                own, data = counts[at:stop], raw[offsets[at] : offsets[min(stop, len(counts))]]
                rows.append((part, block, before, names[at:stop], own.tolist(), encode(data.view(f"<u{len(data) // int(own.sum())}"))))
                block, before, at = block + 1, before + int(own.sum()), stop
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["part", "block", "before", "doc_ids", "counts", "words"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("doc_id", "sum", "place")
    ordered = spark.read.schema("doc_id long, sum long, place long, n long, ids binary").parquet(held).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n", "ids").mapInArrow(lean(run), "part int, block int, before long, doc_ids array<long>, counts array<long>, words binary").write.option("compression", "zstd").parquet(path)
    remove(spark, held)


def read_blocks(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, from the files."""
    blocks = spark.read.schema("part int, block int, before long, doc_ids array<long>, counts array<long>, words binary").parquet(path)
    sizes = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    starts, at = {}, 0
    for r in sorted(sizes.collect(), key=lambda r: r["part"]):  # one row a file part
        starts[r["part"]] = at
        at += r["n"]

    def run(batches):
        for batch in batches:
            names, counts = batch.column("doc_ids"), batch.column("counts")
            for k, (part, before, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "before", "words")), strict=True)):
                own = counts[k].values.to_numpy()
                ends = np.cumsum(own)
                ids = byte_rows(decode(words, int(own.sum())).astype("<u4"), ends)
                yield pa.RecordBatch.from_arrays([names[k].values, pa.array(ends - own + (starts[part] + before)), counts[k].values, ids], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def op8_simple8b(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/simple8b-{uuid.uuid4().hex}"
    write_blocks(read_documents(spark, sf_dir), path)
    return read_blocks(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
