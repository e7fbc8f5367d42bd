"""Operator 7: SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits, each the majority over the hashes of its word shingles. Two
fingerprints link if they differ in at most four bits; the links' components are the classes.

Candidates: a fingerprint is cut into segments A and B of 23 bits and C of 18. Words of 23 bits with at
most two errors between them share a Golay key (`golay.keys`). Of four errors, either A and B have at
most two each; or one of them has three or more, and then the other and C have at most one together:
either C has none, or C has one, so one of its halves has none, and the other segment has none. So a
link's ends share one of the keys

    (key of A, key of B), (key of A, C), (A, half of C), (key of B, C), (B, half of C).

That is the STRICT scheme. The WIDE one, for near copies at a likeness of 0.8, has 92 bits over shingles of
five words, in four segments, and links at 13 or fewer differing bits, what two texts with that share of
common shingles are expected to have: the bits' part that differs is acos(2J / (1 + J)) / pi. Of four
segments with at most eight errors two have at most two each, so a key is the pair of any two segments' keys;
links of 9 to 13 errors are found if two segments share a key all the same, which most do (README).

Fingerprints with the same key are compared exactly. Where a key has many of them, only the links of
a spanning forest are made, by a search that leaves out what it has reached, so that a dense group
doesn't give all its pairs. A key with more than BUCKET_ROWS fingerprints is dealt out: its
fingerprints are split into blocks, and each pair of blocks is compared in a task of its own.

Copies are one fingerprint from the start (pre-aggregated; a WIDE one by all of its columns). Links, components and fingerprints stay in
Spark's tables; steps that later ones use twice are checkpointed in the cluster's shared folder.

Cases: null and blank texts have fingerprint zero and link like any other. Repeated rows stay. A null
doc_id never names a component unless it is alone. An empty table gives no rows. Other columns are left
out, whatever their names. A very long text's shingles are hashed one by one and counted in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm.components import components
from tidemark.llm.tables import by_size, read, whole_texts, written

SEED = 42
#: Fingerprints of one key that one task compares.
BUCKET_ROWS = 20_000
#: Rows that a task gathers before it compares, beyond those of one key.
GATHER_ROWS = 200_000
#: Up to so many fingerprints of one key, all its pairs are compared at once.
SMALL = 24


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which of them link."""

    words: int  # of a shingle
    bits: int  # 64, or 92 in the columns fp and fq
    most_bits: int  # that linked fingerprints differ in

    @property
    def columns(self) -> list[str]:
        return ["fp"] if self.bits == 64 else ["fp", "fq"]

    @property
    def others(self) -> list[str]:
        """The columns of the fingerprint that another one links with."""
        return [f"{c}_b" for c in self.columns]


STRICT = Scheme(4, 64, 4)
WIDE = Scheme(5, 92, 13)


def shingles(text: str, words: int) -> Iterator[bytes]:
    """A text's shingles of lower-cased (A-Z) words, repeats included; all of a shorter text."""
    own = text.encode().lower().split()  # on bytes these are the ASCII rules
    joined = b" ".join(own)
    ends = list(accumulate((len(w) + 1 for w in own)))
    return (joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :] or ends[-1:]))


def fingerprint(text: str, scheme: Scheme = STRICT) -> list[int]:
    """The SimHash of a text's shingles, as one unsigned number per column; zero without words."""
    wide = scheme.bits > 64
    hashed = (xxhash.xxh3_128_digest(x, SEED) if wide else xxhash.xxh64_digest(x, SEED) for x in shingles(text, scheme.words))
    digests = np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 16 if wide else 8)
    counts = np.zeros(8 * digests.shape[1], np.int64)
    for i in range(0, len(digests), 1 << 16):
        counts += np.unpackbits(digests[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    found = np.packbits(2 * counts > len(digests)).view(">u8")
    return [int(found[0]), int(found[1]) >> (128 - scheme.bits)] if wide else [int(found[0])]


def fingerprints(docs: DataFrame, scheme: Scheme = STRICT) -> DataFrame:
    """doc_id and the scheme's columns (fp, the first 64 bits as a long; fq, the others) of all rows."""
    rows = whole_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in by_size(batches):
            found = np.array([fingerprint(x, scheme) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in found.T)], ["doc_id", *scheme.columns])

    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in scheme.columns)]))


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of fingerprints (rows of one or two columns), and for each key the row that it belongs to."""
    made = _wide_keys(fps) if fps.shape[1] == 2 else _strict_keys(fps[:, 0])
    flat = np.concatenate([m.reshape(len(fps), -1) for m in made], 1)
    rows, columns = np.nonzero(flat >= 0)
    return flat[rows, columns], rows


def _pairs(n: int, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    return np.where((left < 0) | (right < 0), -1, n << 48 | left << width | right)


def _strict_keys(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    a, b, c = bits >> 41, bits >> 18 & 0x7FFFFF, bits & 0x3FFFF
    of_a, of_b = golay.keys(a), golay.keys(b)
    c, halves = c.astype(np.int64)[:, None], np.stack([c >> 9, c & 0x1FF], 1).astype(np.int64)
    made = [_pairs(0, of_a[:, :, None], of_b[:, None, :], 12)]
    for n, (codes, words) in enumerate(((of_a, a), (of_b, b))):
        made.append(_pairs(1 + n, codes, c, 18))
        made += [_pairs(3 + 2 * n + h, words.astype(np.int64)[:, None], halves[:, h : h + 1], 9) for h in (0, 1)]
    return made


def _wide_keys(fps: np.ndarray) -> list[np.ndarray]:
    p, q = fps[:, 0].view(np.uint64), fps[:, 1].astype(np.uint64)
    segments = [p >> 41, p >> 18 & 0x7FFFFF, (p & 0x3FFFF) << 5 | q >> 23, q & 0x7FFFFF]
    codes = [golay.keys(x) for x in segments]
    return [_pairs(n, codes[i][:, :, None], codes[j][:, None, :], 12) for n, (i, j) in enumerate(combinations(range(4), 2))]


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows of x and y differ."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(-1)


def forest(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links, as pairs of rows, that join the fingerprints' components, found by a search among those not yet reached."""
    links, rest, numbers = [], fps, np.arange(len(fps))
    while len(rest) > 1:
        front, rest, numbers = [(int(numbers[0]), rest[0])], rest[1:], numbers[1:]
        while front and len(rest):
            i, x = front.pop()
            near = differ(rest, x) <= most_bits
            if near.any():
                links += [(i, int(j)) for j in numbers[near]]
                front += list(zip(map(int, numbers[near]), rest[near]))
                rest, numbers = rest[~near], numbers[~near]
    return links


def bucket_links(key: np.ndarray, fps: np.ndarray, most_bits: int) -> np.ndarray:
    """Links among rows sorted by key, as two columns of rows."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(first, len(key)))
    found = []
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    k, f = key[small], fps[small]
    for lag in range(1, min(SMALL, len(k))):
        same = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(same):
            break
        near = same[differ(f[same + lag], f[same]) <= most_bits]
        found.append(np.stack([small[near], small[near + lag]], 1))
    for i in np.flatnonzero(sizes > SMALL):
        own = forest(fps[first[i] : first[i] + sizes[i]], most_bits)
        found.append(first[i] + np.array(own, np.int64).reshape(-1, 2))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows sorted by key in portions that end with a key; a key with more than `most` rows comes in portions of its own, marked."""
    key, fps, over = np.zeros(0, np.int64), np.zeros((0, len(names)), np.int64), None
    for batch in batches:
        key = np.append(key, batch.column("key").to_numpy(zero_copy_only=False))
        fps = np.concatenate([fps, _columns(batch, names)])
        if over is not None and len(key):
            n = int(np.searchsorted(key, over, "right"))
            if n:
                yield key[:n], fps[:n], True
                key, fps = key[n:], fps[n:]
            if len(key):
                over = None
        if len(key) and over is None:
            n = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if n and (n >= GATHER_ROWS or len(key) - n > most):
                yield key[:n], fps[:n], False
                key, fps = key[n:], fps[n:]
            if len(key) > most and key[0] == key[-1]:
                yield key, fps, True
                over, key, fps = int(key[-1]), key[:0], fps[:0]
    if len(key):
        yield key, fps, over is not None and key[0] == over


def _compare(rows: DataFrame, scheme: Scheme, most: int) -> DataFrame:
    """key, the scheme's columns and its others: the links of keys with up to `most` rows (key null), and the rows of other keys (others null)."""
    names = scheme.columns

    def run(batches):
        for key, fps, over in _runs(batches, names, most):
            # Keys of more than `most` rows can end inside a portion as well.
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(first, len(key)))
            large = np.repeat(sizes > most, sizes) | over
            own, rest = fps[~large], fps[large]
            links = bucket_links(key[~large], own, scheme.most_bits) if len(own) else np.zeros((0, 2), np.int64)
            n, m = len(links), len(rest)
            columns = [
                pa.array(np.append(np.zeros(n, np.int64), key[large]), mask=np.arange(n + m) < n),
                *(pa.array(np.append(x, y)) for x, y in zip(own[links[:, 0]].T, rest.T)),
                *(pa.array(np.append(x, np.zeros(m, np.int64)), mask=np.arange(n + m) >= n) for x in own[links[:, 1]].T),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", *names, *scheme.others])

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("key", *names, *scheme.others)))


def _node(columns: list[str]) -> Column:
    """A fingerprint as one value."""
    return F.struct(*(F.col(c).alias(n) for c, n in zip(columns, ("fp", "fq")))) if len(columns) > 1 else F.col(columns[0])


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS, scheme: Scheme = STRICT) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in the scheme's columns, enough to give all components."""
    names = scheme.columns

    def deal(batches):
        for batch in batches:
            every = _columns(batch, names)
            for i in range(0, len(every), 4_000):
                own = every[i : i + 4_000]
                key, row = keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c) for c in own[row].T)], ["key", *names])

    # A fingerprint becomes many rows, so the few bytes before that are spread over all tasks.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select(*names).repartition(tasks, "fp").mapInArrow(deal, ", ".join(f"{c} bigint" for c in ("key", *names)))
    found = written(_compare(keyed.repartition("key").sortWithinPartitions("key", "fp"), scheme, bucket_rows))
    ends = [_node(names).alias("a"), _node(scheme.others).alias("b")]
    pairs = found.where("fp_b is not null").select(*ends)
    rest = found.where("fp_b is null").select("key", *names)
    if rest.isEmpty():
        return pairs
    blocks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 3 / bucket_rows).alias("blocks"))
    own = rest.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = own.select("key", *names, "block", other)
    dealt = dealt.select(*names, F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"))
    more = _compare(dealt.repartition("key").sortWithinPartitions("key", "fp"), scheme, 1 << 40)
    return pairs.union(more.select(*ends))


def classes(prints: DataFrame, scheme: Scheme = STRICT) -> DataFrame:
    """The scheme's columns and component_id (the smallest doc_id of the class) of all fingerprints in doc_id and these columns."""
    names = scheme.columns
    nodes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("first")))
    found = written(components(links(nodes, scheme=scheme)))
    own = nodes.withColumn("own", _node(names))
    rooted = written(own.join(found, own["own"] == found["node"], "left").select(*names, "first", F.coalesce("root", "own").alias("root")))
    lowest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return written(rooted.join(lowest, "root").select(*names, "component_id"))


def representatives(docs: DataFrame, scheme: Scheme = STRICT) -> DataFrame:
    """The smallest doc_id of each class, a row per class."""
    return classes(written(fingerprints(docs, scheme)), scheme).select(F.col("component_id").alias("doc_id")).distinct()


def near_duplicates(docs: DataFrame, scheme: Scheme = STRICT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the class) of all rows."""
    prints = written(fingerprints(docs, scheme))
    named = classes(prints, scheme)
    return prints.join(named, scheme.columns).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
