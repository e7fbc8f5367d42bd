"""Operator 13: repair of conversations' structure by dynamic programming over a grammar.

A row's fault (blank, duplicate, truncated) and its role make a symbol. A conversation's symbols, in order, lie
in chunks of CHUNK. Chunks with the same symbols are worked out once, whatever their conversations.

Grammar (Re-Pair): pairs of neighbouring symbols are counted over all different chunks, the most frequent become
rules, and their occurrences are replaced by the rules' symbols, ROUND_RULES rules a round, until no pair is there twice
or ROUNDS are over. What stays longer than one symbol stays a sequence.

DP: the roles' pattern (s?(ua)+)? has four states. Each symbol has a 4 by 4 min-plus matrix, from a state before
its rows to one behind them: the least cost of edits, and of equally cheap ones the ASCII-least audit. A rule's matrix is the product of its
two parts' matrices, worked out bottom-up, once. The audit is a rope: each entry keeps the state in the
middle. Audits aren't compared as strings: all audits of the same rows have equally many edits of rows and
end with one, so none is the beginning of another; entries of one start state keep their order, and a product's
order follows from its left part's, then its right part's. Chunks' matrices are multiplied along their
sequences, conversations' along their chunks.

Texts stay rows: they are placed by ranges (`placed`), joined with their edits by place, and a conversation's
repaired rows are hashed as they stream by, so no conversation is ever in memory. What a task holds of one
conversation are its symbols and its audit, which are columns of the result.

Cases: null texts, roles, ids and turns are one blank each where they are text; a null conv_id is a conversation, a null
turn stands first. Rows with the same turn are ordered by role, then by their texts' hash; repeated rows are duplicates. Roles
other than by the three initials can be replaced or deleted only. A conversation that loses all rows has zeros. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.places import placed
from tidemark.llm.tables import read, sql_crc32, written

#: Rows of a chunk.
CHUNK = 4096
ROUNDS, ROUND_RULES = 8, 16
#: The symbols of rules begin here.
FIRST_RULE = 0x4E00
STATES = range(4)
#: Where a user's, an assistant's and a system row lead from the states start, after system, after user, after assistant.
NEXT = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
ENDS = {0, 3}
NAMES = {"u": "user", "a": "assistant"}
#: Costs of the edits; of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
GONE = "x"  # the symbol of a row that has to go
BLANK = r"[\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults planted by a checksum of id and turn; nulls are one blank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """The rows with place, initial, and fault: blank, duplicate, truncated or null; symbol says what the repair needs of it."""
    last = F.substring(F.regexp_replace("text", f"{BLANK}+$", ""), -1, 1)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    own = placed(rows.withColumns({"last": last, "said": said}), "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]).drop("total")
    own = written(own)
    again = own.where("last <> ''").groupBy(F.col("conv_id").alias("of"), F.col("said").alias("what")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times"))
    again = written(again.where("times > 1").drop("times"))
    own = own.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what")), "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault") == "truncated", F.upper(symbol)).when(F.col("fault").isNotNull(), GONE).otherwise(symbol)
    return own.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "place", "fault", initial.alias("initial"), symbol.alias("symbol"))


class Matrix:
    """What a run of rows costs from each state to each, and of its cheapest audits the order and the states in the middle."""

    def __init__(self, found: dict[tuple[int, int], tuple]):
        """found: by (from, to) the cost, a key that orders one start state's audits, and the audit or the state in the middle."""
        self.cost = {k: v[0] for k, v in found.items()}
        self.how = {k: v[2] for k, v in found.items()}
        self.order = {}
        for p in STATES:
            for rank, k in enumerate(sorted((k for k in found if k[0] == p), key=lambda k: found[k][1])):
                self.order[k] = rank

    def then(self, other: Matrix) -> Matrix:
        found: dict = {}
        for (p, m), cost in self.cost.items():
            for q in STATES:
                if (m, q) in other.cost:
                    now = (cost + other.cost[m, q], (self.order[p, m], other.order[m, q]), m)
                    if (p, q) not in found or now[:2] < found[p, q][:2]:
                        found[p, q] = now
        return Matrix(found)


def symbol_matrix(symbol: str) -> Matrix:
    """Of one row, with rows inserted before it. Its entries keep the audits themselves."""
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    found: dict = {}
    for start in STATES:
        state, inserted = start, ""
        for _ in STATES:
            ways = [(state, DELETE, "D")]
            if symbol != GONE:
                ways += [(NEXT[x][state], RENAME + extra, "R") for x in "ua" if state in NEXT[x]]
                if state in NEXT.get(role, ()):
                    ways.append((NEXT[role][state], extra, "K"))
            for to, cost, edit in ways:
                audit = inserted + edit
                now = (INSERT * len(inserted) + cost, audit, audit)
                if (start, to) not in found or now < found[start, to]:
                    found[start, to] = now
            state, inserted = 3 if state == 2 else 2, inserted + "I"
    return Matrix(found)


class Grammar:
    """Rules as (symbol, left, right) in the order they were made, and what follows from them."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules

    @cached_property
    def parts(self) -> dict[str, tuple[str, str]]:
        return {x: (left, right) for x, left, right in self.rules}

    @cached_property
    def matrices(self) -> dict[str, Matrix]:
        known = {x: symbol_matrix(x) for x in "suaoSUAO" + GONE}
        for x, left, right in self.rules:  # bottom-up: a rule's parts come before it
            known[x] = known[left].then(known[right])
        return known

    def audit(self, symbol: str, start: int, end: int) -> str:
        """The rope of a symbol's entry, unwound."""
        out, todo = [], [(symbol, start, end)]
        while todo:
            x, p, q = todo.pop()
            how = self.matrices[x].how[p, q]
            if x in self.parts:
                left, right = self.parts[x]
                todo += [(right, how, q), (left, p, how)]
            else:
                out.append(how)
        return "".join(out)

    def chunk(self, symbols: str) -> tuple[Matrix, list[Matrix]]:
        """The product along a sequence and those of its beginnings."""
        products = [self.matrices[symbols[0]]]
        for x in symbols[1:]:
            products.append(products[-1].then(self.matrices[x]))
        return products[-1], products

    def audits(self, symbols: str) -> tuple[Matrix, dict[tuple[int, int], str]]:
        """The product along a sequence, and its entries' audits."""
        whole, products = self.chunk(symbols)
        out = {}
        for p, q in whole.cost:
            made, at = [], q
            for i in range(len(symbols) - 1, 0, -1):
                before = products[i].how[p, at]
                made.append(self.audit(symbols[i], before, at))
                at = before
            made.append(self.audit(symbols[0], p, at))
            out[p, q] = "".join(reversed(made))
        return whole, out


def replaced(sequence: Column, rules: list[tuple[str, str, str]]) -> Column:
    for x, left, right in rules:
        sequence = F.replace(sequence, F.lit(left + right), F.lit(x))
    return sequence


def learn_grammar(pieces: DataFrame) -> Grammar:
    """Re-Pair over the column `symbols` of pieces; only each round's ROUND_RULES pairs come to the driver."""
    rules: list[tuple[str, str, str]] = []
    for _ in range(ROUNDS):
        now = pieces.select(replaced(F.col("symbols"), rules).alias("x")).where(F.length("x") > 1)
        pairs = now.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substring(F.col("x"), i, F.lit(2)))).alias("pair"))
        top = pairs.groupBy("pair").count().where("count > 1").orderBy(F.desc("count"), "pair").limit(ROUND_RULES).collect()
        if not top:
            break
        rules += [(chr(FIRST_RULE + len(rules) + i), *row["pair"]) for i, row in enumerate(top)]
    return Grammar(rules)


def worked_out(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """symbols and entries (start, end, cost, rank, audit) of all pieces, by their compressed sequences."""
    short = pieces.select("symbols", replaced(F.col("symbols"), grammar.rules).alias("sequence"))

    def run(batches):
        for batch in batches:
            made = []
            for x in batch.column("sequence").to_pylist():
                whole, audits = grammar.audits(x)
                made.append([{"start": p, "end": q, "cost": whole.cost[p, q], "rank": whole.order[p, q], "audit": audits[p, q]} for p, q in whole.cost])
            entry = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column("symbols"), pa.array(made, pa.list_(entry))], ["symbols", "entries"])

    return short.mapInArrow(run, "symbols string, entries array<struct<start:int,end:int,cost:bigint,rank:int,audit:string>>")


def best(chunks: list[list[dict]]) -> tuple[int, str]:
    """The least cost and its audit for a conversation, from its chunks' entries."""
    matrices = [Matrix({(e["start"], e["end"]): (e["cost"], e["rank"], e["audit"]) for e in entries}) for entries in chunks]
    products = matrices[:1]
    for m in matrices[1:]:
        products.append(products[-1].then(m))
    whole = products[-1]
    ends = {q: {0: 0, 3: 0, 2: 1, 1: 2}[q] for p, q in whole.cost if p == 0}  # rows to insert behind the last
    cost, _, at = min((whole.cost[0, q] + INSERT * n, whole.order[0, q], q) for q, n in ends.items())
    audit = ["I" * ends[at]]
    for i in range(len(matrices) - 1, -1, -1):
        before = products[i].how[0, at] if i else 0
        audit.append(matrices[i].how[before, at])
        at = before
    return cost, "".join(reversed(audit))


def edits(audit: str, symbols: str) -> list[tuple[str | None, str, str | None]]:
    """For each row, and for the end, what the audit says: the inserted lines before it, its edit, and its new role."""
    out, state, before = [], 0, []
    rows = iter(symbols)
    for edit in audit:
        role = next((x for x in "ua" if state in NEXT[x]), "")
        if edit == "I":
            before.append(NAMES[role] + ":")
            state = NEXT[role][state]
            continue
        own = next(rows).lower()
        if edit == "R":
            state = NEXT[role][state]
        elif edit == "K":
            state = NEXT[own][state]
        out.append(("\n".join(before) if before else None, edit, NAMES[role] if edit == "R" else None))
        before = []
    return [*out, ("\n".join(before) if before else None, "", None)]


def audits(chunks: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal and edits (by place) of all conversations; chunks: conv_id, chunk, symbols, initials, entries."""
    rows = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "symbols", "initials", "entries"))).alias("chunks"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    edit = pa.struct([("before", pa.string()), ("edit", pa.string()), ("role", pa.string())])

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                costs, made, illegal, every = [], [], [], []
                for own in part.column("chunks").to_pylist():
                    cost, audit = best([x["entries"] for x in own])
                    initials = [y for x in own for y in x["initials"]]
                    costs.append(cost)
                    made.append(audit)
                    illegal.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))
                    every.append([dict(zip(("before", "edit", "role"), e)) for e in edits(audit, "".join(x["symbols"] for x in own))])
                columns = [part.column("conv_id"), pa.array(costs, pa.int64()), pa.array(made, pa.string()), pa.array(illegal, pa.int64()), pa.array(every, pa.list_(edit))]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "cost", "audit", "illegal", "edits"])

    return rows.mapInArrow(run, f"conv_id {kind}, cost bigint, audit string, illegal bigint, edits array<struct<before:string,edit:string,role:string>>")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place and lines: the repaired rows, each with the rows inserted before it; one more place for those behind the last row."""
    each = found.select(F.col("conv_id").alias("of"), F.posexplode("edits").alias("at", "e"))
    met = each.join(rows, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")), "left")
    own = F.when(F.col("e.edit").isin("K", "R"), F.concat(F.coalesce("e.role", "role"), F.lit(":"), F.col("text")))
    lines = F.array_compact(F.array(F.col("e.before"), own))
    return met.where(F.size(lines) > 0).select(F.col("of").alias("conv_id"), F.col("at").alias("place"), F.array_join(lines, "\n").alias("lines"))


def hashed(lines: DataFrame) -> DataFrame:
    """conv_id and sha256 of its lines, joined by newlines, read in order and never gathered."""
    kind = lines.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for conv, group in groupby(zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()), key=lambda x: x[0]):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                    _, line = next(group)
                    state.update(line.encode())
                for _, line in group:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], batch.schema.field("conv_id").type), pa.array([x for _, x in out], pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field("conv_id").type), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, f"conv_id {kind}, sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of rows (conv_id, turn, role, text, none null but ids and turns) with its faults, cost, audit and its repaired rows' hash."""
    own = written(faults(rows))
    chunk = F.floor(F.col("place") / CHUNK)
    members = F.array_sort(F.collect_list(F.struct("place", "symbol", "initial")))
    chunks = own.groupBy("conv_id", chunk.alias("chunk")).agg(members.alias("m"))
    chunks = written(chunks.select("conv_id", "chunk", F.array_join("m.symbol", "").alias("symbols"), F.col("m.initial").alias("initials")))
    pieces = written(chunks.select("symbols").distinct())
    made = written(worked_out(pieces, learn_grammar(pieces)))
    found = written(audits(chunks.join(made, "symbols")))
    digests = hashed(repaired(own, found))
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = own.groupBy("conv_id").agg(gaps.alias("gaps"), *(count(x) for x in ("blank", "duplicate", "truncated")))
    same = lambda a, b, how="inner": a.join(b.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), how).drop("of")
    return same(same(counts, found.drop("edits")), digests, "left")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: inserted, renamed and deleted, the audit's edits."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "of")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    audit = F.coalesce("audit", F.lit(""))
    edit = lambda x, name: F.length(F.regexp_replace(audit, f"[^{x}]", "")).cast("long").alias(name)
    return every.select(
        "conv_id", *(long(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), audit.alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"), edit("I", "inserted"), edit("R", "renamed"), edit("D", "deleted"),
    )


OP13_SQL = rf"""
with recursive raw as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {sql_crc32("concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' '))")} % 20 as f from conversations
), broken as (
    select conv_id, turn, case when f = 4 then 'user' else role end as role,
        case when f = 1 then '' when f = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when f = 3 then 2 else 1 end)) as copy
    from raw where f <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from broken
), ordered as (
    select *, row_number() over (partition by conv_id, role, text order by i) as seen, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) as last from placed
), marked as materialized (
    select conv_id, turn, role, text, i, left(role, 1) as r, case when last = '' then 'blank' when seen > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault,
        lag(left(role, 1)) over (partition by conv_id order by i) as prev from ordered
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (prev is not null and prev || r not in ('su', 'ua', 'au')) as illegal, count(*) as n
    from marked group by conv_id
), inserts(p, k, m, ins) as (
    values (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (0, 3, 2, ['user:', 'assistant:', 'user:']),
        (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:', 'user:']),
        (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (2, 3, 3, ['assistant:', 'user:', 'assistant:']),
        (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:']), (3, 3, 2, ['user:', 'assistant:', 'user:'])
), ways(m, e, initial, q, name) as (
    values (0, 'R', null, 2, 'user'), (1, 'R', null, 2, 'user'), (2, 'R', null, 3, 'assistant'), (3, 'R', null, 2, 'user'),
        (0, 'K', 's', 1, null), (0, 'K', 'u', 2, null), (1, 'K', 'u', 2, null), (2, 'K', 'a', 3, null), (3, 'K', 'u', 2, null),
        (0, 'D', null, 0, null), (1, 'D', null, 1, null), (2, 'D', null, 2, null), (3, 'D', null, 3, null)
), dp as (
    select conv_id, 0::bigint as i, 0 as state, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as best from counts
    union all
    select d.conv_id, d.i + 1, w.q, min({{
        'cost': d.best.cost + 5 * n.k + case e when 'D' then 2 when 'R' then 1 else 0 end + case when e <> 'D' and fault is not null then 5 else 0 end,
        'audit': d.best.audit || repeat('I', n.k) || e,
        'lines': d.best.lines || n.ins || case when e = 'D' then [] else [coalesce(name, role) || ':' || text] end}})
    from dp d join marked t on t.conv_id is not distinct from d.conv_id and t.i = d.i + 1 join inserts n on n.p = d.state join ways w on w.m = n.m
    where (initial is null or initial = r) and (e = 'D' or fault is null or fault = 'truncated') group by d.conv_id, d.i, w.q
), done as (
    select d.conv_id, min({{'cost': best.cost + 5 * k, 'audit': best.audit || repeat('I', k), 'lines': best.lines || ins}}) as best
    from dp d join counts c on c.conv_id is not distinct from d.conv_id and d.i = c.n join inserts n on n.p = d.state and n.m in (0, 3) group by d.conv_id
)
select x.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256,
    length(regexp_replace(coalesce(best.audit, ''), '[^I]', '', 'g')) as inserted, length(regexp_replace(coalesce(best.audit, ''), '[^R]', '', 'g')) as renamed,
    length(regexp_replace(coalesce(best.audit, ''), '[^D]', '', 'g')) as deleted
from (select distinct conv_id from conversations) x left join counts c on c.conv_id is not distinct from x.conv_id left join done d on d.conv_id is not distinct from x.conv_id
"""
