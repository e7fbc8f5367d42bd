"""Operator 10: media columns in FLAC.

`encode_media` stores a binary column as one FLAC stream per row (8-bit mono, blocks of 576 samples);
`decode_media` reads stored streams back: it decodes Rice residuals and linear predictors, verifies
each frame's two checksums and the stream's MD5, and returns the PCM with the sample offset and the
place in the stream of every block; `pcm_blocks` turns that into a row per block. `flac.read_samples`
decodes only the frames that a range of samples needs.

Both are maps over Arrow batches, sliced to a bounded number of frames; nothing is shuffled.

Cases: a null payload counts as the empty one; empty and other payloads are filled up with bytes 255
to a positive multiple of 576. Equal payloads give equal streams. Repeated rows and null ids stay, an
empty table gives no rows. Columns named like the results are replaced, others stay. A damaged stream
stops the job; so does a payload above 536 MB, whose seek table FLAC can't hold. A long payload is
handled in slices of frames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidemark.llm import flac
from tidemark.llm.tables import by_size, read, whole_texts

FILL = b"\xff"


def filled(payload: bytes | None) -> bytes:
    payload = payload or b""
    return payload + FILL * (-len(payload) % flac.BLOCK if payload else flac.BLOCK)


def encode_media(rows: DataFrame, payload_col: str = "payload") -> DataFrame:
    """rows without the payload, and `media`, its stream, in place of a column of this name."""
    rows = rows if payload_col == "media" else rows.drop("media")

    def run(batches):
        for part, payloads in by_size(batches, payload_col):
            streams = flac.encode([filled(p) for p in payloads])
            keep = [i for i, n in enumerate(part.schema.names) if n != payload_col]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(streams, pa.binary())], [*(part.schema.names[i] for i in keep), "media"])

    kept = [f for f in rows.schema.fields if f.name != payload_col]
    return rows.mapInArrow(run, StructType(kept).add("media", "binary"))


def features(samples: bytes) -> str:
    """Level, peaks, sign changes and the spread of the blocks' energy, from whole numbers alone."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    energy = (x * x).reshape(-1, flac.BLOCK).sum(1)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};energy={int(energy.sum())};loudest={int(energy.max())};quietest={int(energy.min())};low={int(x.min())};high={int(x.max())};crossings={crossings}"


def decode_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with `pcm` (unsigned 8-bit), `points` (array of sample_offset and media_offset by block) and `feature`, in place of columns of these names."""
    rows = rows.drop("pcm", "points", "feature")

    def run(batches):
        for part, streams in by_size(batches, media_col):
            decoded = flac.decode(streams)
            counts = np.cumsum([0, *(len(p) for _, p in decoded)], dtype=np.int32)
            longs = [pa.array(np.concatenate([p[c] for _, p in decoded]).astype(np.int64)) for c in ("sample", "offset")]
            points = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(longs, ["sample_offset", "media_offset"]))
            pcm = pa.array([d for d, _ in decoded], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, pcm, points, pa.array([features(d) for d, _ in decoded])], [*part.schema.names, "pcm", "points", "feature"])

    point = StructType().add("sample_offset", "long").add("media_offset", "long")
    schema = StructType(list(rows.schema.fields)).add("pcm", "binary").add("points", ArrayType(point)).add("feature", "string")
    return rows.mapInArrow(run, schema)


def pcm_blocks(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per block: id, sample_offset, media_offset and the block's PCM."""
    rows = decoded.select(id_col, "pcm", F.explode("points").alias("p"))
    return rows.select(id_col, "p.sample_offset", "p.media_offset", F.substring("pcm", F.col("p.sample_offset").cast("int") + 1, F.lit(flac.BLOCK)).alias("pcm"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: points, the sample offset and the place in the stream of each block."""
    raw = F.col("text").cast("binary")
    texts = whole_texts(read(spark, sf_dir, "documents"))
    stored = encode_media(texts.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("payload")))
    back = decode_media(stored)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "points",
    )
