"""Operator 12: a Merkle manifest of a dataset, by strings of concatenated digests.

Each row is a leaf. The leaves of a group, in order, lie in aligned blocks of BLOCK. A block keeps each of
its levels as one string of hexadecimal digests: the next level's string is made by hashing substrings of
two digests' width, and a leaf's sibling on a level is the substring beside its own (empty where its run
has no other). The blocks' tops are the leaves of the next round, with the same aligned blocks, until a
group has one block; so a run never crosses blocks, and a last, shorter block is folded as often as the others. A
leaf's proof is its segment of siblings in its block, then its block's segment in the next round, and so on.
The groups' tops (subroots) are the leaves of one more such tree, whose top is the root.

No task sees more than a block, whatever a group's size: places come from ranges (`placed`), and rounds are
as many as a group's size has digits to the base of BLOCK. Segments go back to the leaves by block, not by leaf.

Cases: null values are marked in the leaf, apart from empty ones. Leaves with the same group and order follow by
their digests, so repeated rows stay and give the same tree in any order. A null group comes first, a null id
first in its group. An empty table gives no rows. Other columns don't matter, whatever their names. Very long
texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.places import placed
from tidemark.llm.tables import read, sql_crc32, written

#: Leaves of a block, a power of two.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Characters of a digest.
WIDTH = 64


def digest(*parts: Column) -> Column:
    """The SHA-256, in hexadecimal digits, of the parts one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def said(value: Column) -> Column:
    """A value with its length in bytes, or the mark of a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*(said(v) for v in values))


def _at(level: Column, i: Column, digests: int = 1) -> Column:
    """Digests of a level from the i-th on; fewer or none past its end. A level is ASCII; as bytes its substrings need no search."""
    return F.substring(level, (i * (digests * WIDTH) + 1).cast("int"), F.lit(digests * WIDTH))


def _above(level: Column) -> Column:
    """The level above: each run of two digests, or a last one alone, is hashed."""
    runs = F.ceil(F.octet_length(level) / (2 * WIDTH)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(_at(level, i, 2), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """A row per block of nodes (tree, place, total, digest, load): its members, its levels' strings, `folds` of them to hash, and its top."""
    member = F.struct("place", "load", "digest")
    blocks = nodes.groupBy("tree", "total", F.shiftright("place", LEVELS).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    # A tree of one block is folded until one node is left, the others through all levels.
    halvings = sum((F.when(F.col("total") > 1 << i, 1).otherwise(0) for i in range(LEVELS)), F.lit(0))
    blocks = blocks.withColumn("folds", halvings)
    blocks = blocks.withColumn("level0", F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary"))
    for i in range(LEVELS):
        blocks = blocks.withColumn(f"level{i + 1}", F.when(F.col("folds") > i, _above(F.col(f"level{i}"))).otherwise(F.col(f"level{i}")))
    return blocks


def _turned(blocks: DataFrame, i: Column) -> Column:
    """What the i-th member of a block meets on its way up: an array of (right, sibling), `right` where it stands right of its sibling."""
    steps = []
    for n in range(LEVELS):
        own = F.shiftright(i, n)
        sibling = _at(F.col(f"level{n}"), own.bitwiseXOR(F.lit(1))).cast("string")
        steps.append(F.when(F.col("folds") > n, F.struct((own % 2 == 1).alias("right"), sibling.alias("sibling"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def prove(nodes: DataFrame) -> DataFrame:
    """load, tree, top (its tree's) and steps (an array of (right, sibling) from the leaf up) of all nodes.

    nodes: tree (not null), place from 0 and total in the tree, digest, and load, what is handed through.
    """
    blocks = written(_blocks(nodes))
    most = blocks.agg(F.max("block")).first()[0]
    top = F.col(f"level{LEVELS}").cast("string")
    if most:
        above = blocks.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), top.alias("digest"), F.col("block").alias("load"))
        above = prove(above).select("tree", F.col("load").alias("block"), "top", F.col("steps").alias("further"))
        blocks = blocks.join(written(above), ["tree", "block"])
    else:
        blocks = blocks.withColumn("top", top).withColumn("further", F.array().cast("array<struct<right:boolean,sibling:string>>"))
    rows = blocks.select("*", F.posexplode("members").alias("i", "member"))
    return rows.select("tree", "member.load", "top", F.concat(_turned(rows, F.col("i")), F.col("further")).alias("steps"))


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, start, lambda own, s: F.sha2(F.when(s["right"], F.concat(s["sibling"], own)).otherwise(F.concat(own, s["sibling"])).cast("binary"), 256))


def manifest(leaves: DataFrame) -> DataFrame:
    """load, leaf, subroot, root and steps of all leaves.

    leaves: group, order (of any kinds that can be ordered), leaf (a digest) and load, what is handed through.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col("group").cast("string")), F.lit(""))  # the null group is the first
    rows = leaves.select(tree.alias("tree"), "order", "leaf", F.struct("leaf", "load").alias("load"))
    rows = placed(rows, "tree", [F.col("order"), F.col("leaf")])
    own = written(prove(rows.select("tree", "place", "total", F.col("leaf").alias("digest"), "load")))
    tops = own.groupBy("tree").agg(F.first("top").alias("digest"))
    tops = placed(tops.select(F.lit("").alias("all"), "tree", "digest"), "all", [F.col("tree")])
    roots = prove(tops.select(F.lit("").alias("tree"), "place", "total", "digest", F.struct("tree", F.col("digest").alias("subroot")).alias("load")))
    roots = written(roots.select("load.tree", "load.subroot", F.col("top").alias("root"), F.col("steps").alias("last")))
    # A few rows by group on the right, which Spark may broadcast; a frequent group is split otherwise.
    found = own.join(roots, "tree")
    return found.select("load.load", "load.leaf", "subroot", "root", F.concat("steps", "last").alias("steps"))


def op12_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: tampered (whether the row was), and n_siblings."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    values = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    now = F.when(tampered & F.col("n_chars").isNotNull(), leaf(*values(F.col("n_chars") + 1)))
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("order"), leaf(*values(F.col("n_chars"))).alias("leaf"), F.struct("doc_id", now.alias("now"), tampered.alias("tampered")).alias("load"))
    found = manifest(leaves).withColumn("folded_root", fold(F.coalesce("load.now", "leaf"), F.col("steps")))
    proof = digest(F.array_join(F.transform("steps", lambda s: s["sibling"]), ""))
    return found.select(
        "load.doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
        F.col("load.tampered").alias("tampered"), F.size(F.filter("steps", lambda s: s["sibling"] != "")).cast("long").alias("n_siblings"),
    )



def _sql_leaf(n_chars: str) -> str:
    said = "coalesce(concat(octet_length(encode(cast({0} as varchar))), ':', cast({0} as varchar)), '-')"
    return f"sha256(concat({', '.join(said.format(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))}))"


OP12_SQL = f"""
with recursive leaves as (
    select doc_id, coalesce('+' || lang, '') as tree, {_sql_leaf('n_chars')} as leaf, {_sql_leaf('n_chars + 1')} as changed,
        {sql_crc32("cast(doc_id as varchar)")} % 7 = 0 as tampered
    from documents
), own as (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n from leaves
), levels as (
    select tree, 0 as lvl, place, leaf as h, n from own
    union all
    select tree, lvl + 1, place // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
    from (select *, lead(h) over (partition by tree order by place) as nxt from levels where n > 1) where place % 2 = 0
), subroots as (
    select tree, h as subroot, row_number() over (order by encode(tree)) - 1 as place, count(*) over () as n from levels where n = 1
), tops as (
    select 0 as lvl, place, subroot as h, n from subroots
    union all
    select lvl + 1, place // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
    from (select *, lead(h) over (order by place) as nxt from tops where n > 1) where place % 2 = 0
), walk as (
    select doc_id, leaf, tampered, tree, 0 as lvl, place, n, '' as proof, 0 as met, case when tampered then coalesce(changed, leaf) else leaf end as folded from own
    union all
    select w.doc_id, w.leaf, w.tampered, w.tree, w.lvl + 1, w.place // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''), w.met + (s.h is not null)::int,
        sha256(case when w.place % 2 = 1 then s.h || w.folded else w.folded || coalesce(s.h, '') end)
    from walk w left join levels s on s.tree = w.tree and s.lvl = w.lvl and s.place = xor(w.place, 1) where w.n > 1
), climb as (
    select w.doc_id, w.leaf, w.tampered, r.subroot, 0 as lvl, r.place, r.n, w.proof, w.met, w.folded from walk w join subroots r using (tree) where w.n = 1
    union all
    select w.doc_id, w.leaf, w.tampered, w.subroot, w.lvl + 1, w.place // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''), w.met + (s.h is not null)::int,
        sha256(case when w.place % 2 = 1 then s.h || w.folded else w.folded || coalesce(s.h, '') end)
    from climb w left join tops s on s.lvl = w.lvl and s.place = xor(w.place, 1) where w.n > 1
)
select doc_id, leaf, subroot, t.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = t.h as verified, tampered, met::bigint as n_siblings
from climb c cross join (select h from tops where n = 1) t where c.n = 1
"""
