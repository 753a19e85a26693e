"""Operator 7: byte-pair encoding and decoding of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT, encoder
from .common import lean, prepare, read_documents


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded. Null text: as empty, no ids; every input row gives one row.

    Rows are taken as they come, so repeated or null doc_ids and further columns change nothing.
    """
    prepare(docs.sparkSession)

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            ids = own.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            decoded = [own.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, ids binary, n_tokens long, decoded string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    found = encode_documents(read_documents(spark, sf_dir))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
