"""Operator 5: media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; a format's validator then confirms structure and
lengths, which corrects the declared type and carves media embedded in other bytes.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, read_documents

UNIT, RATE = 64, 8000
#: The formats' magic bytes.
MAGIC = {b"RIFF": "wav", b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"%PDF-": "pdf", b"PK\x03\x04": "zip", b"fLaC": "flac", b"OggS": "ogg"}
KINDS = frozenset(MAGIC.values())


def pad(payload: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of the unit."""
    return payload + bytes(-len(payload) % UNIT or (UNIT if not payload else 0))


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples, a byte each."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


class Sniffer:
    """The media in some bytes. Every block boundary is stepped over once, however many magic bytes lead to it, so that time is linear in the bytes."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def _walk(self, kind: str, pos: int, step):
        """The outcome of stepping from block to block: step gives (next block, None) or (None, outcome)."""
        passed = []
        while (kind, pos) not in self.known:
            following, outcome = step(pos)
            passed.append(pos)
            if following is None:
                break
            pos = following
        else:
            outcome = self.known[kind, pos]
        for p in passed:
            self.known[kind, p] = outcome
        return outcome

    def _number(self, layout: str, at: int) -> int:
        return struct.unpack_from(layout, self.data, at)[0]

    def wav(self, at: int):
        """(end, start of samples, their bytes) of a WAVE file with a format before its samples, whose stored length holds both."""
        data = self.data
        if data[at + 8 : at + 12] != b"WAVE" or (end := at + 8 + self._number("<I", at + 4)) > len(data):
            return None

        def chunk(wanted: bytes):
            def step(pos: int):
                if pos + 8 > len(data):
                    return None, None
                size = self._number("<I", pos + 4)
                return (None, (pos + 8, size)) if data[pos : pos + 4] == wanted else (pos + 8 + size + size % 2, None)

            return step

        made, body = self._walk("fmt", at + 12, chunk(b"fmt ")), self._walk("data", at + 12, chunk(b"data"))
        fits = made and body and made[1] >= 16 and made[0] < body[0] and body[0] + body[1] <= end
        return (end, *body) if fits else None

    def png(self, at: int):
        """Chunks with right checksums, from IHDR to IEND."""
        data = self.data

        def step(pos: int):
            if pos + 12 > len(data):
                return None, None
            size = self._number(">I", pos)
            if pos + 12 + size > len(data) or zlib.crc32(data[pos + 4 : pos + 8 + size]) != self._number(">I", pos + 8 + size):
                return None, None
            return (None, pos + 12 + size) if data[pos + 4 : pos + 8] == b"IEND" else (pos + 12 + size, None)

        return self._whole(at, self._walk("png", at + 8, step)) if data[at + 12 : at + 16] == b"IHDR" else None

    def gif(self, at: int):
        """Blocks to the trailer."""
        data = self.data
        table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

        def sub_blocks(pos: int):
            if pos >= len(data):
                return None, None
            return (pos + 1 + data[pos], None) if data[pos] else (None, pos + 1)

        def step(pos: int):
            kind = data[pos] if pos < len(data) else 0
            if kind == 0x3B:
                return None, pos + 1
            if kind == 0x2C and pos + 10 < len(data):
                pos += 11 + table(data[pos + 9])
            elif kind == 0x21:
                pos += 2
            else:
                return None, None
            return self._walk("gif blocks", pos, sub_blocks), None

        return self._whole(at, self._walk("gif", at + 13 + table(data[at + 10]), step)) if len(data) >= at + 13 else None

    def ogg(self, at: int):
        """Whole pages, from one that begins a stream to the last that follows."""
        data = self.data

        def step(pos: int):
            if data[pos : pos + 5] != b"OggS\0" or pos + 27 > len(data) or pos + 27 + data[pos + 26] > len(data):
                return None, pos
            size = 27 + data[pos + 26] + sum(data[pos + 27 : pos + 27 + data[pos + 26]])
            return (pos + size, None) if pos + size <= len(data) else (None, pos)

        end = self._walk("ogg", at, step) if data[at + 5 : at + 6] and data[at + 5] & 2 else at
        return self._whole(at, end if end > at else None)

    def flac(self, at: int):
        """A STREAMINFO block, further blocks to the last, then a frame; the stream stores no length and runs to the end of the bytes."""
        data = self.data

        def step(pos: int):
            if pos + 4 > len(data):
                return None, None
            following = pos + 4 + int.from_bytes(data[pos + 1 : pos + 4])
            return (None, following) if data[pos] & 0x80 else (following, None)

        frames = self._walk("flac", at + 4, step) if data[at + 4 : at + 8] in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") else None
        return self._whole(at, len(data)) if frames and data[frames : frames + 2] in (b"\xff\xf8", b"\xff\xf9") else None

    def zip(self, at: int):
        """An archive whose end record gives a directory that stands right before it and begins its offsets here."""
        return self._whole(at, self._archives.get(at))

    @functools.cached_property
    def _archives(self) -> dict[int, int]:
        found = {}
        for m in re.finditer(rb"PK\x05\x06", self.data):
            if m.start() + 22 > len(self.data):
                break
            entries, size, offset, comment = struct.unpack_from("<HIIH", self.data, m.start() + 10)
            directory, end = m.start() - size, m.start() + 22 + comment
            if entries and directory >= offset and end <= len(self.data) and self.data[directory : directory + 4] == b"PK\x01\x02":
                found[directory - offset] = end
        return found

    def pdf(self, at: int):
        """To the last end mark before another header whose startxref leads to a cross-reference table or stream."""
        data, k = self.data, bisect.bisect_right(self._headers, at)
        stop = self._headers[k] if k < len(self._headers) else len(data)
        first, last = bisect.bisect_left(self._ends, (at,)), bisect.bisect_left(self._ends, (stop,))
        for pos, offset in reversed(self._ends[first:last]):
            target = at + offset
            if target < pos and (data.startswith(b"xref", target) or re.match(rb"\d+\s+\d+\s+obj", data[target : target + 40])):
                return self._whole(at, pos + 5)
        return None

    @functools.cached_property
    def _headers(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-", self.data)]

    @functools.cached_property
    def _ends(self) -> list[tuple[int, int]]:
        return [(m.end() - 5, int(m[1])) for m in re.finditer(rb"startxref\s{1,4}(\d{1,15})\s{1,4}%%EOF", self.data)]

    @staticmethod
    def _whole(at: int, end: int | None):
        return None if end is None else (end, at, end - at)


#: Formats whose own parts begin with the magic bytes again: those are no further media.
PARTS = ("ogg", "zip")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes, magics: ahocorasick.Automaton) -> list[tuple[str, int, int, int, int]]:
    """(type, start, end, start of the body, its bytes) of each confirmed medium, outermost first; media inside one are listed too."""
    found, own, ends = [], Sniffer(data), dict.fromkeys(PARTS, 0)
    for last, (n, kind) in magics.iter(data.decode("latin-1")):
        at = last - n + 1
        span = getattr(own, kind)(at) if at >= ends.get(kind, 0) else None
        if span:
            found.append((kind, at, *span))
            if kind in ends:
                ends[kind] = span[0]
    return sorted(found, key=lambda x: (x[1], -x[2]))


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 (null: empty), padded, as a WAVE file of 8-bit samples.

    Every row gives one, repeated rows and null doc_ids too; an empty table gives none.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            payloads = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([to_wav(pad(p)) for p in payloads], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def sniff_media(media: DataFrame, declared: str | None = None) -> DataFrame:
    """doc_id, n_bytes, media, kind (confirmed type at byte 0, else the declared one if nothing contradicts it), payload (its body), embedded (structs of type, start, end).

    declared: the name of a column of declared types. Null or unknown bytes: null kind, empty payload, no embedded media. Of media that
    start at byte 0 the longest is the whole. Every row gives one; time is linear in the bytes, whatever magic bytes they hold.
    """
    kind = F.col(declared) if declared else F.lit(None).cast("string")

    def run(batches):
        magics = automaton()
        for batch in batches:
            rows = []
            for data, said in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                found = sniff(data or b"", magics)
                whole = next((x for x in found if x[1] == 0), None)
                known = whole[0] if whole else None if said in KINDS else said
                rows.append((known, data[whole[3] : whole[3] + whole[4]] if whole else b"", [{"kind": x[0], "start": x[1], "end": x[2]} for x in found if x is not whole]))
            kinds, payloads, embedded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kinds, pa.string()), pa.array(payloads, pa.binary()), pa.array(embedded, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "media", "kind", "payload", "embedded"])

    return media.select("doc_id", "n_bytes", "media", kind.alias("declared")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary, kind string, payload binary, embedded array<struct<kind:string,start:long,end:long>>")


def op5_media(spark, sf_dir: str) -> DataFrame:
    found = sniff_media(store_media(read_documents(spark, sf_dir)))
    size = F.length("payload").cast("long")
    return found.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "kind", F.lit("8bit"), size.cast("string"), F.concat_ws(",", F.transform("embedded", lambda e: F.concat(e["kind"], F.lit("@"), e["start"].cast("string"))))).alias("feature"),
    )
