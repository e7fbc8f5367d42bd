"""Operator 6: packing by power-of-two decomposition.

Each document's ids, with the end id behind them, are cut into pieces whose lengths are powers of
two: as many of the longest as fit, then the binary digits of the rest from high to low. A piece is
a sequence of its own, so that no sequence crosses documents and none needs padding; pieces of the
same length form a bucket from which batches are drawn: `bucket` is the power, and `write_buckets` lays
the sequences out in a folder for each (the pipeline does so; op6 gives the pieces' digests and buckets).

One map over the scan, without a shuffle: what a document gives depends on it alone.

Cases: a null text counts as the empty one, whose only id is the end id (one piece of length 1).
Repeated rows give repeated pieces with sequences of their own. An empty table gives no rows. A null id
stays. Other columns are left out, whatever their names. A very long text gives as many pieces as it
needs; its ids are in memory at once, four bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.tables import by_size, read, special_tokens, whole_texts

#: The longest sequence, a power of two.
MAX_LENGTH = 2048
#: The id behind each document.
END_ID = 1


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """The lengths that n ids are cut into, in text order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, ranks_path: str, tokenizer_json: str, longest: int = MAX_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), sequence_id, offset, bucket.

    sequence_id numbers the sequences within the input's partitions, so it is unique and comes out
    the same when a task is run again over the same files.
    """
    if longest & longest - 1:
        raise ValueError("the longest sequence must be a power of two")
    rows = whole_texts(docs, id_col, text_col)
    special = special_tokens(tokenizer_json)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def cut(batches):
        table, end = bpe.table(bpe.IdTable, ranks_path), np.array([end_id], "<u4")
        for part, texts in by_size(batches):
            data, row, start, length, total = [], [], [], [], []
            for i, text in enumerate(texts):
                ids = np.append(bpe.token_ids(text, table, special), end)
                data.append(ids)
                lengths = piece_lengths(len(ids), longest)
                row += [i] * len(lengths)
                length += lengths
                total += [len(ids)] * len(lengths)
                at = 0
                for n in lengths:
                    start.append(at)
                    at += n
            ends = np.cumsum([0, *length], dtype=np.int32) * np.int32(4)
            blob = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(data).astype("<u4"))])
            longs = [pa.array(x, pa.int64()) for x in (start, length, total)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int32())), *longs, blob], names)

    pieces = rows.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")
    power = F.round(F.log2("length")).cast("int")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": power})


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Writes the sequences with a folder for each bucket, and gives them read again; a condition on `bucket` reads only its folders."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path).select(*pieces.columns)


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", *more)


def default_pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(default_pack(read(spark, sf_dir, "documents")))
