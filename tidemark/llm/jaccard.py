"""Operator 11: a join of documents by the Jaccard likeness of their word n-grams, with token-combination prefixes.

A text's set holds its distinct five-word shingles, as 64-bit hashes. Two sets link when
100 * |common| >= 80 * |union|; documents with equal sets are one node from the start.

Prefixes. All tokens have one order: those of the counted part of the hash space (the first COUNTED_SHARE)
before the others; there by class of frequency and hash, elsewhere by hash. A set of n tokens that links
with another lacks at most e = n // 5 of its own tokens in it. Of a linked pair take the set whose prefix ends
first: what its prefix shares with the other set is in the other's prefix too. Tokens of class k are
indexed in combinations of k. They are dealt into groups by hash, and a group of m tokens of class k in a prefix
keeps a common combination until m - k + 1 of them are lost. So a prefix is extended until these sums reach
e + 1; then the pair has a combination in common. Class 1 are tokens in up to RARE documents (one that is in a
single document is counted but needs no row), class 2 those in up to FREQUENT, class 3 the rest. The groups' number
goes by the set's size, so that few tokens lie in one: a set with hundreds of frequent tokens doesn't give
all their pairs. Sizes lie in bands, linked sets in the same or in neighbouring ones; a set has the combinations
of its own band's grouping and of the next one's, and a pair meets in the higher band's. Tokens outside of the
counted part are class 1, and only as many are taken as a set needs that has too few others. Sets of up to three
tokens link with equal ones only.

Candidates have a combination in common, sizes within the bound, and bitmaps of 256 parities that differ in no
more bits than a linked pair's sets differ in tokens. They are verified exactly on the token arrays. First each
combination's smallest node is compared with all others, twice, leaving out what is connected already; then
all pairs of a combination that are still in different components. So dense groups don't give all their
pairs, no cap is set, and the components are those of all links. A combination that more than MOST_COMPARED nodes have comes from
a passage of many texts; its nodes, which are few, are indexed again by all of their tokens, the rarest among them first, so
that only texts that consist of such passages meet by them, and more parities tell long ones apart. Combinations that the very same nodes have give the same
pairs, so one of them is kept.

Hot keys: counts are pre-aggregated; the tokens' rows, combinations and pairs are joined between written tables or
plain shuffles, which Spark splits where a key is frequent. Nothing but rows of a pair meets in a task.

Cases: a null or blank text has no set and links with nothing, not with its like. A shorter text's words are
one shingle. Repeated rows are copies. A null doc_id never names a component unless it is alone. An empty table gives no
rows. Other columns are left out, whatever their names. Hashes of 64 bits count as their shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import by_size, read, release, whole_texts, written

WORDS = 5
#: A link's likeness, in hundredths.
LEAST = 80
#: Documents with a token, up to which it is of class 1 and of class 2.
RARE, FREQUENT = 16, 1024
#: Tokens of a class that a group is meant to have in a prefix.
GROUP_TOKENS = 4
#: The part of the hash space whose tokens are counted.
COUNTED_SHARE = 0.3
_BOUND = int(COUNTED_SHARE * 2**64)
#: Sizes of linked sets differ by a quarter at most; a band is a little wider.
BAND = 1.2501
#: Words whose shingles are hashed at once.
PORTION = 1 << 16
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: What a byte stands for in a hash; capitals A-Z stand for small letters, each white space for a space.
LETTERS = np.array([xxhash.xxh64_intdigest(b" " if SPACES[b] else bytes([b]).lower()) for b in range(256)], np.uint64)
#: The base of the rolling hash, odd, with its inverse modulo 2^64, and the factor of the last mixing.
BASE = np.uint64(xxhash.xxh64_intdigest(b"base") | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
MIX = np.uint64(0xFF51AFD7ED558CCD)
STAR_ROUNDS = 2
BITS = ["b0", "b1", "b2", "b3"]
#: Nodes of a combination that are all compared with each other; those of larger ones are indexed again by all of their tokens.
MOST_COMPARED = 4
#: The parities that are held against each other there.
WIDE_PARITIES = 2048
WIDE = [f"w{i}" for i in range(WIDE_PARITIES // 64)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base)), dtype=np.uint64)


def token_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A shingle is a stretch of the text with single spaces; its hash follows from a rolling hash's values at both ends.
    """
    every = [t.encode() for t in texts]
    raw = np.frombuffer(b" ".join([*every, b""]), np.uint8)
    inside = ~SPACES[raw]
    after = np.append(False, inside[:-1])
    kept = np.flatnonzero(inside | after)  # words, and one space behind each
    begins, ends = np.flatnonzero(inside[kept] & ~after[kept]), np.flatnonzero(~inside[kept])
    letters = raw[kept]
    own = np.searchsorted(kept[begins], np.cumsum([0, *(len(x) + 1 for x in every)]))  # each text's first word
    sizes = np.diff(own)
    # Shingles begin at each word but a text's last four; a shorter text's begins at its first.
    spans = np.minimum(sizes, WORDS)
    counts = np.where(sizes > 0, sizes - spans + 1, 0)
    first = np.repeat(own[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    last = first + np.repeat(spans, counts) - 1
    made = np.zeros(len(first), np.uint64)
    for i in range(0, len(first), PORTION):
        f, t = begins[first[i : i + PORTION]], ends[last[i : i + PORTION]]
        low, high = f[0], t[-1]
        n = int(high - low)
        rolled = np.append(np.uint64(0), np.cumsum(LETTERS[letters[low:high]] * _powers(BASE, n)[:n], dtype=np.uint64))
        found = (rolled[t - low] - rolled[f - low]) * _powers(INVERSE, n)[f - low]
        found ^= found >> np.uint64(32)
        found *= MIX
        made[i : i + PORTION] = found ^ found >> np.uint64(29)
    out = []
    for x in np.split(made, np.cumsum(counts)[:-1]):
        x.sort()
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
    return out


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _node(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _code(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, node (of equal sets the same 16 bytes; null for an empty set), code (its first 8 bytes), n, counted (tokens in the counted part) and b0 to b3, the parities."""
    rows = whole_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in by_size(batches):
            every = token_sets(texts)
            parities = _parities(every, 64 * len(BITS))
            nodes = [_node(x) if len(x) else None for x in every]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(nodes, pa.binary()), pa.array([_code(x or bytes(8)) for x in nodes], pa.int64()), pa.array([len(x) for x in every], pa.int64()),
                    pa.array([int(np.searchsorted(x, np.uint64(_BOUND))) for x in every], pa.int64()), *(pa.array(c) for c in parities),
                ],
                ["doc_id", "node", "code", "n", "counted", *BITS],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, node binary, code bigint, n bigint, counted bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint")


def groups(band: int) -> int:
    """Groups of a class among sets of a band."""
    return max(1, int(BAND**band / 5) // GROUP_TOKENS)


def band_of(n: int) -> int:
    return int(np.log(n) / np.log(BAND))


def _uncounted(n: int, counted: int) -> int:
    """How many of its other tokens a set may need, since its counted ones may fall short by what classes 2 and 3 lose."""
    lost = 3 * groups(band_of(n) + 1)
    return max(0, n // 5 + 1 + lost - counted)


def occurrences(docs: DataFrame, with_code: bool) -> DataFrame:
    """The tokens h of all texts that can be in a prefix, and with_code their nodes' codes; rows are as narrow as can be, since they are many."""
    rows = whole_texts(docs).select("text")

    def run(batches):
        for _, texts in by_size(batches):
            h, codes = [], []
            for found in token_sets(texts):
                if len(found) < 4:
                    continue
                counted = int(np.searchsorted(found, np.uint64(_BOUND)))
                h.append(found[: counted + _uncounted(len(found), counted)])
                codes.append(_code(_node(found)) if with_code else 0)
            if h:
                columns = [_long(np.concatenate(h)), pa.array(np.repeat(np.array(codes, np.int64), [len(x) for x in h]))]
                yield pa.RecordBatch.from_arrays(columns[: 1 + with_code], ["h", "code"][: 1 + with_code])

    return rows.mapInArrow(run, "h bigint, code bigint" if with_code else "h bigint")


def prefix_keys(n: int, alone: int, kinds: list[int], hashes: list[int], more: list[int]) -> set[int]:
    """The keys of a set of n tokens.

    alone: how many of its counted tokens no other set has, which come first. kinds, hashes: the classes of the other
    counted ones, and they themselves, in their order. more: those outside of the counted part that others have too, as many as can be needed.
    """
    keys, errors = set(), n // 5
    for band in (band_of(n), band_of(n) + 1):
        many, reached, members = groups(band), alone, {}
        for kind, h in zip(kinds, hashes):
            if reached > errors:
                break
            if kind == 1:
                keys.add(h)
                reached += 1
            else:
                own = members.setdefault((kind, h % many), [])
                for others in combinations(own, kind - 1):
                    keys.add(xxhash.xxh64_intdigest(np.array([band, *others, h], np.int64).tobytes()) - 2**63)
                reached += len(own) >= kind - 1
                own.append(h)
        if reached <= errors:
            keys.update(more)
    return keys


def _keys(shared: DataFrame) -> DataFrame:
    """key and id: the combinations of all sets. shared: id, n, counted and found."""
    counted = lambda x: (x["h"] >= 0) & (x["h"] < _BOUND)
    own = F.array_sort(F.filter("found", counted))
    rows = shared.select("id", "n", (F.col("counted") - F.size(own)).alias("alone"), own.alias("own"), F.filter("found", lambda x: ~counted(x)).alias("more"))
    # Where enough tokens are in no other set, there is nothing to index.
    rows = rows.where("alone <= n div 5").select("id", "n", "alone", F.col("own.kind").alias("kinds"), F.col("own.h").alias("hashes"), F.col("more.h").alias("more"))

    def run(batches):
        for batch in batches:
            rows, keys = [], []
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "alone", "kinds", "hashes", "more")))):
                own = prefix_keys(*values)
                rows += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("id").take(pa.array(rows, pa.int64()))], ["key", "id"])

    return rows.mapInArrow(run, "key bigint, id bigint")


def _once_per_group(keys: DataFrame) -> DataFrame:
    """key: of the combinations that the very same nodes have, one; those of a single node are left out.

    A passage's tokens stand in the same texts, and so do all of their combinations, which would give each pair once more.
    Groups are known by two hashes of 64 bits over their nodes, and their size.
    """
    code = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "id"))
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), code(1).alias("x"), code(2).alias("y")).where("nodes > 1")
    return groups.groupBy("nodes", "x", "y").agg(F.min("key").alias("key")).select("key")


def combinations_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The combinations (key, id) that more than one node has, one for each group of nodes; nodes: as of `sets`, a row per node, with an id."""
    counts = written(occurrences(docs, False).groupBy("h").count().where("count > 1"))
    release(docs.sparkSession)
    counted = F.col("h").between(0, _BOUND - 1)
    # A token outside of the counted part is class 1: its count holds only the sets that need it.
    kind = F.when((F.col("count") <= RARE) | ~counted, 1).when(F.col("count") <= FREQUENT, 2).otherwise(3)
    # Copies of a text give the same rows, which meet in one set as early as in the joining tasks.
    found = occurrences(docs, True).join(counts, "h").groupBy("code").agg(F.collect_set(F.struct(kind.alias("kind"), "h")).alias("found"))
    keys = written(_keys(nodes.join(found, "code").select("id", "n", "counted", "found")))
    release(docs.sparkSession)
    keys = keys.join(written(_once_per_group(keys)), "key")
    # Sets that happen to have the same code (by the birthday bound a few of 10^10) have each other's tokens here. They are
    # compared with all sets of like size instead, by keys of their own.
    twins = nodes.groupBy("code").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").join(nodes, "code")
    band = lambda side: F.floor(F.log(BAND, F.col("n"))) + side
    own = twins.select(F.explode(F.array(*(F.xxhash64(band(i), F.lit("band")) for i in (-1, 0, 1)))).alias("key"), "id")
    every = nodes.select(F.xxhash64(band(0), F.lit("band")).alias("key"), "id")
    every = every.join(own.select("key").distinct(), "key", "left_semi")
    return written(keys.union(own).union(every).distinct() if not twins.isEmpty() else keys)


def _parities(every: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each 64 of n classes of tokens a column that says for each set which classes it has an odd number of."""
    last = np.uint64(n - 1)
    return list(np.array([np.packbits(np.bincount((x & last).astype(np.int64), minlength=n) & 1) for x in every], np.uint8).view(np.int64).T)


def _may_link(a: str, b: str, parities: tuple[list[str], ...] = (BITS,)) -> str:
    """SQL: sizes and parities of a and b allow for a link; of their n tokens together at most a ninth is in one set only."""
    sizes = f"100 * least({a}.n, {b}.n) >= {LEAST} * greatest({a}.n, {b}.n)"
    differ = (" + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in columns) for columns in parities)
    return " and ".join([sizes, *(f"{100 + LEAST} * ({x}) <= {100 - LEAST} * ({a}.n + {b}.n)" for x in differ)])


def arrays(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and tokens of the nodes, from the texts of their `first` documents."""
    wanted = whole_texts(docs).join(nodes.select(F.col("first").alias("wanted")), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    def run(batches):
        for _, texts in by_size(batches):
            every = token_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in every], pa.binary()), pa.array([x.view(np.int64) for x in every], pa.list_(pa.int64()))], ["node", "tokens"])

    return wanted.mapInArrow(run, "node binary, tokens array<bigint>").join(nodes.select("node", "id"), "node").dropDuplicates(["id"]).select("id", "tokens")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, label) of nodes' ids that link."""
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("tokens").alias("of_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("tokens").alias("of_a")), "a")
    common = both.select("a", "b", "label", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("common"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return common.where(f"100 * common >= {LEAST} * (sizes - common)").select("a", "b", "label")


def _by_rare_tokens(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """key and id: the tokens of the nodes' prefixes (id), all tokens taken in the order of how many of the nodes have them.

    Of linked sets the first common token is among the first n // 5 + 1 of both.
    """
    own = written(nodes.select("id").join(texts, "id"))
    each = own.select("id", F.explode("tokens").alias("token"))
    shared = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"))
    found = each.join(shared, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("found"))
    alone = F.col("n") - F.size("found")
    wanted = F.expr("n div 5 + 1") - alone
    rows = own.select("id", F.size("tokens").cast("long").alias("n")).join(found, "id").select("id", "found", wanted.cast("int").alias("wanted")).where("wanted > 0")
    keys = written(rows.select(F.explode(F.slice("found", F.lit(1), F.col("wanted"))).alias("t"), "id").select(F.col("t.token").alias("key"), "id"))
    return keys.join(written(_once_per_group(keys)), "key")


def _wide(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """id and the wide parities of the nodes (id)."""

    def run(batches):
        for batch in batches:
            every = [x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in batch.column("tokens")]
            if every:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in _parities(every, WIDE_PARITIES))], ["id", *WIDE])

    return nodes.select("id").join(texts, "id").select("id", "tokens").mapInArrow(run, ", ".join(f"{c} bigint" for c in ["id", *WIDE]))


def _pairs(rows: DataFrame, parities: tuple[list[str], ...]) -> DataFrame:
    """a, b and b's label of all nodes of one key that may link and have other labels. rows: key, id, label, n and the parities."""
    met = rows.alias("x").join(rows.alias("y"), F.expr(f"x.key = y.key and x.id < y.id and x.label <> y.label and {_may_link('x', 'y', parities)}"))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("y.label").alias("label"))


def links(keys: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of ids enough to give all components. keys: as of `combinations_of`; nodes: id, n and parities; texts: id and tokens.

    After a comparison with middles, a node's label is the least of the middles' that it links with, else its own: a node is
    connected with the one that its label names, so no pair of the same label needs to be compared. Before the last
    comparison, of all pairs, labels become the components' roots.
    """
    known = nodes.select("id", "n", *BITS)
    now, found = keys.withColumn("label", F.col("id")), None
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            # Another node of each combination each time, and mostly the same one in all combinations of a group of copies.
            own = F.struct(F.xxhash64(F.lit(turn), "id").alias("rank"), F.col("id").alias("b"), F.col("label").alias("theirs"))
            middle = written(now.groupBy("key").agg(F.min(own).alias("m")).select("key", "m.b", "m.theirs"))
            met = now.join(middle, "key").where("label <> theirs").select(F.col("id").alias("a"), "b", F.col("theirs").alias("label")).distinct()
            met = met.join(known.withColumnRenamed("id", "a").alias("x"), "a").join(known.withColumnRenamed("id", "b").alias("y"), "b").where(_may_link("x", "y"))
        else:
            large = written(now.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where(f"nodes > {MOST_COMPARED}").select("key"))
            met = _pairs(written(now.join(large, "key", "left_anti").join(known, "id")), (BITS,))
            inside = written(now.join(large, "key").select("id", "label").distinct())
            if not inside.isEmpty():
                rows = _by_rare_tokens(inside, texts).join(inside, "id").join(known, "id").join(written(_wide(inside, texts)), "id")
                met = met.union(_pairs(written(rows), (BITS, WIDE)))
            met = met.distinct()
        more = written(verified(written(met.select("a", "b", "label")), texts))
        found = more if found is None else found.union(more)
        if turn < STAR_ROUNDS:
            linked = written(more.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("met")))
            if turn == STAR_ROUNDS - 1:  # labels of one component that differ would give all pairs between them
                linked = written(components(found.select("a", "b"))).select(F.col("node").alias("id"), F.col("root").alias("met"))
            named = written(now.join(linked, "id", "left").withColumn("label", F.coalesce("met", "label")).drop("met"))
            open_ = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            now = written(named.join(written(open_.select("key")), "key"))
            release(keys.sparkSession)
    return found.select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of all rows."""
    every = written(sets(docs))
    nodes = every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("code", "n", "counted", *BITS)))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    keys = combinations_of(docs, nodes)
    texts = written(arrays(docs, nodes.join(keys.select("id").distinct(), "id", "left_semi")))
    release(docs.sparkSession)
    roots = written(components(links(keys, nodes, texts)))
    rooted = written(nodes.join(roots, nodes["id"] == roots["node"], "left").select(nodes["node"], "first", F.coalesce("root", "id").alias("root")))
    lowest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = written(rooted.join(lowest, "root").select("node", "component_id"))
    out = every.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as materialized (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words
), sizes as materialized (
    select doc_id, count(*) as n from sets group by 1
), links as materialized (
    select a.doc_id as a, b.doc_id as b from sets a join sets b using (s) join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach as (
    select doc_id as a, doc_id as b from documents
    union
    select r.a, l.b from reach r join links l on l.a = r.b
)
select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id
from documents d left join sizes using (doc_id) join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id
"""
