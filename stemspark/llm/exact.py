"""Operator 2: exact deduplication over a cuckoo-filter index of live digests."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, lean, prepare, read_documents, spread_join, whole_text

SLOTS, KICKS = 4, 200
#: Live digests, and bytes of their texts, at which a task hands its index on and starts another.
FLUSH, FLUSH_BYTES = 100_000, 24 << 20


class CuckooIndex:
    """A cuckoo filter whose slots point to stored keys: membership is asked of 16-bit tags, and a hit is verified against the whole key
    (and by the caller against the stored value).

    Keys are digests (bytes of at least 12); each live one has a value. When an insertion finds no slot, the table is doubled and
    filled again from the stored keys, so nothing is lost.
    """

    def __init__(self, buckets: int = 256):
        self.kick = random.Random(0)
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask, self.live = buckets - 1, 0
        self.table: list[list[tuple[int, bytes, object]]] = [[] for _ in range(buckets)]

    def _tag(self, key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[:8], "little") & self.mask

    def _other(self, at: int, tag: int) -> int:
        return (at ^ (tag * 0x5BD1E995)) & self.mask

    def _find(self, key: bytes):
        tag, at = self._tag(key), self._home(key)
        for b in (at, self._other(at, tag)):
            for k, entry in enumerate(self.table[b]):
                if entry[0] == tag and entry[1] == key:  # the tag only says maybe
                    return b, k
        return None

    def get(self, key: bytes, default=None):
        found = self._find(key)
        return default if found is None else self.table[found[0]][found[1]][2]

    def insert(self, key: bytes, value) -> None:
        entry, at = (self._tag(key), key, value), self._home(key)
        self.live += 1
        other = self._other(at, entry[0])
        for b in (at, other):
            if len(self.table[b]) < SLOTS:
                self.table[b].append(entry)
                return
        b = self.kick.choice((at, other))
        for _ in range(KICKS):
            k = self.kick.randrange(SLOTS)
            entry, self.table[b][k] = self.table[b][k], entry
            b = self._other(b, entry[0])
            if len(self.table[b]) < SLOTS:
                self.table[b].append(entry)
                return
        self._grow(entry)

    def _grow(self, extra) -> None:
        kept = [*self.items(), (extra[1], extra[2])]
        self._clear(2 * (self.mask + 1))
        for key, value in kept:
            self.insert(key, value)

    def delete(self, key: bytes) -> bool:
        found = self._find(key)
        if found is None:
            return False
        self.table[found[0]].pop(found[1])
        self.live -= 1
        return True

    def items(self):
        return [(key, value) for bucket in self.table for _, key, value in bucket]


def _merge(first, second):
    """The live row is the one with the larger doc_id; null is smaller than any."""
    ids = [x for x in (first[0], second[0]) if x is not None]
    return max(ids, default=None), first[1] + second[1]


def _indexed(rows: DataFrame, whole_buckets: bool) -> DataFrame:
    """One row a live digest and index, of rows (digest, keep_id, group_size, content). A hit is verified against the stored text; then the
    row that a larger doc_id supersedes is deleted and the other inserted.

    whole_buckets: rows come sorted by digest, so an index may only be handed on between two digests, and the texts end here.
    """

    def run(batches):
        index, last, held = CuckooIndex(), None, 0

        def out():
            found = index.items()
            columns = [pa.array([k for k, _ in found], pa.binary()), pa.array([v[0] for _, v in found], pa.int64()), pa.array([v[1] for _, v in found], pa.int64())]
            return pa.RecordBatch.from_arrays(columns if whole_buckets else [*columns, pa.array([v[2] for _, v in found], pa.binary())], names)

        for batch in batches:
            for key, doc, n, content in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size", "content")), strict=True):
                if (index.live >= FLUSH or held >= FLUSH_BYTES) and (key != last or not whole_buckets):
                    yield out()
                    index, held = CuckooIndex(), 0
                last, live = key, index.get(key)
                if live is None:
                    index.insert(key, (doc, n, content))
                    held += len(content)
                elif live[2] != content:
                    raise ValueError(f"two texts share the digest {key.hex()}")
                else:
                    index.delete(key)
                    index.insert(key, (*_merge(live, (doc, n)), content))
        yield out()

    schema = "digest binary, keep_id long, group_size long" + ("" if whole_buckets else ", content binary")
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(lean(run), schema)


def exact_groups(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of rows (doc_id, digest, content).

    Each map task indexes its own rows first, so a digest shared by a third of all rows, and its text, reaches its bucket as a row a task.
    """
    own = _indexed(rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "content"), False)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _indexed(own.repartition(n, "digest").sortWithinPartitions("digest"), True)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text with A-Z lower-cased, null as empty), keep_id, group_size, kept of every row.

    Hits of the index are verified against the text itself; should two texts ever share a digest, the job fails and names it. Rows that
    repeat a doc_id with an equal text count in group_size and are kept or dropped alike. In a group without any doc_id keep_id is null
    and all rows stay.
    """
    prepare(docs.sparkSession)
    content = ascii_lower(whole_text()).cast("binary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    rows = cut(keyed.select("doc_id", "digest"))
    return spread_join(rows, cut(exact_groups(keyed)), ["digest"], "group_size").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), "digest")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
