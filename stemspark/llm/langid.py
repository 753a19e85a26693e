"""Operator 9: language identification by language-bitmask n-gram filters.

All languages share one Bloom filter whose slots hold a bit a language (bit-sliced, in as many 64-bit words as needed): the AND of an n-gram's slots has the bits
of all languages that contain it. A text's hits by language, less what the language's filter would hit by chance, decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, guarded, lean, prepare, read_documents

#: The classifier's parameters. Bound of the fitting sample: documents a language, as an expectation. Slots of the filter.
SAMPLE, SLOTS, HASHES, NGRAM = 1500, 1 << 20, 3, 4
#: An n-gram belongs to a language if this share of its sampled n-grams or more are it.
LEAST_SHARE = 5e-6
#: A text with LONG n-grams or more, of which fewer than LEAST_RATE are its language's, isn't in a learned language; shorter ones can't tell.
LEAST_RATE, LONG = 0.15, 50
#: Bits of a word; a slot has as many words as the languages need.
WORD = 64
#: Texts whose n-grams are in memory at once.
SLICE = 64
LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def signs(text: str) -> bytes:
    """What n-grams are taken of: lower-cased words, each between single spaces; digits and punctuation go."""
    return (" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode()


def ngrams(data: bytes) -> np.ndarray:
    """Every run of four bytes, as a number."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24 if len(b) >= NGRAM else np.zeros(0, np.uint32)


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return [(grams.astype(np.uint64) * np.uint64(m)) >> shift for m in _MULTIPLIERS[:HASHES]]


class Filters:
    """The learned languages, their bit-sliced filter, and each language's chance of a false hit."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.languages = sorted(grams)
        self.slots = np.zeros((-(-len(self.languages) // WORD), SLOTS), np.uint64)
        for k, language in enumerate(self.languages):
            for at in slots_of(grams[language]):
                self.slots[k // WORD][at] |= np.uint64(1 << k % WORD)
        self.chance = np.array([np.count_nonzero(self.slots[k // WORD] >> np.uint64(k % WORD) & np.uint64(1)) / SLOTS for k in range(len(self.languages))]) ** HASHES

    def containing(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """The bitmask of languages that contain each n-gram, of the 64 languages of a word."""
        found, slots = None, self.slots[word]
        for at in slots_of(grams):
            found = slots[at] if found is None else found & slots[at]
        return found

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language, the share of n-grams that are the language's, corrected for false hits; and each text's n-grams."""
        each = [ngrams(signs(t)) for t in texts]
        sizes = np.array([len(g) for g in each])
        grams, hits = np.concatenate(each), []
        owner = np.repeat(np.arange(len(texts)), sizes)
        for word in range(len(self.slots)):
            masks = self.containing(grams, word)
            hits += [np.bincount(owner[(masks >> np.uint64(k) & np.uint64(1)).astype(bool)], minlength=len(texts)) for k in range(min(WORD, len(self.languages) - word * WORD))]
        hits = np.stack(hits, 1)
        share = hits / np.maximum(sizes, 1)[:, None]
        return np.clip((share - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1), sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """(language or und, score, rate of its n-grams, n-grams)."""
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        found = [("und", 0.0, 0.0, 0)] * len(texts)
        if known and self.languages:
            rates, sizes = self.rates([texts[i] for i in known])
            top = rates.argmax(1)
            for i, k, row, n in zip(known, top.tolist(), rates, sizes.tolist(), strict=True):
                total = row.sum()
                found[i] = (self.languages[k], float(row[k] / total) if total else 1 / len(row), float(row[k]), n)
        return found


def held_out(column="doc_id"):
    """The documents kept for testing; a null doc_id is none of them, but is not learned from either."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Learns from labelled documents with a doc_id that aren't held out: of each language those whose hash of doc_id and text falls under its share.

    Null and empty texts add nothing; rows that repeat a doc_id and its text are learned from together or not at all; an empty table teaches no language.
    The sample is the only bounded input; its n-grams are counted by executors and only the lasting ones reach the driver.
    """
    prepare(docs.sparkSession)
    train = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = train.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row a language
    if not counts:
        return Filters({})
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["n"]))))[F.col("lang")]
    chosen = train.where((F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)) < share).select("lang", "text")

    def run(batches):
        for batch in batches:
            by_language: dict[str, list[np.ndarray]] = {}
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_language.setdefault(language, []).append(ngrams(signs(text or "")))
            for language, grams in by_language.items():
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = cut(chosen.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    lasting = grams.join(F.broadcast(totals), "lang").where((F.col("n") >= F.col("total") * LEAST_SHARE) & (F.col("n") > 1)).select("lang", "gram").toPandas()  # at most 1 / LEAST_SHARE a language
    return Filters({language: rows["gram"].to_numpy(np.uint64) for language, rows in lasting.groupby("lang")})


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with lang_pred, score (the language's part of all rates), rate and n_grams. und: null text, or no letter, or nothing learned.

    Of equal rates the first language by name is predicted; a text of which no n-gram is known has equal rates.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(filters)  # of fixed size: SLOTS words for each 64 languages
    kept = docs.select(*keep, *([] if "text" in keep else ["text"]))
    names = list(keep)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [f for at in range(0, len(texts), SLICE) for f in own.predict(texts[at : at + SLICE])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())], [*names, "lang_pred", "score", "rate", "n_grams"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names)
    return kept.mapInArrow(lean(run), schema + ", lang_pred string, score double, rate double, n_grams long")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@guarded
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a learned language: those with a prediction (null texts and texts without letters have none) of which LEAST_RATE of the n-grams are known.

    Texts of fewer than LONG n-grams are kept with any rate: so few can miss by chance what a longer text of the language would contain.
    Every row is judged by its own text, so repeated rows stay or go together.
    """
    names = docs.columns
    return identify(docs, fit(docs), tuple(names)).where((F.col("lang_pred") != "und") & ((F.col("rate") >= LEAST_RATE) | (F.col("n_grams") < LONG))).select(*names)
