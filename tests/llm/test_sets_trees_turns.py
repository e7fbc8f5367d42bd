"""Operators 11 to 13, and the later cases of 7 and 8, against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.llm import html_text, jaccard, manifest, registry, repair, simhash, tables


def rows_of(df):
    df = df[sorted(df.columns)]
    said = lambda v: "NULL" if v is None or v != v else str(v)
    return list(df.columns), sorted(tuple(map(said, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert rows_of(registry.queries()[name](spark, DATA).toPandas()) == rows_of(duck.sql(registry.oracle_sql()[name]).df())


def test_shuffles_of_a_written_table_go_while_it_is_in_use(spark):
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, setting = files(), spark.conf.get(tables.SHUFFLES_GO, "false")
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    done = tables.written(df)
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert sorted(done.collect()) == sorted(df.collect()) and spark.conf.get(tables.SHUFFLES_GO) == setting


# -- 11 --
def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(rows):
    """component_id by row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and near(sets[i], sets[j]):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    lowest = lambda c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None)
    return [(r[0], len(s), lowest(c)) for r, s, c in zip(rows, sets, label)]


def copies(rng, base, n, most):
    """Texts made of the base by replacing up to `most` of its words."""
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_op11_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", 2)  # so that pairs and triples are indexed
    monkeypatch.setattr(jaccard, "FREQUENT", 6)
    rng = random.Random(11)
    say = lambda n, many=10**6: " ".join(f"w{rng.randrange(many)}" for _ in range(n))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e", "A  b\tc\nd e", "a b c d e f", "É é", "é é", "x" * 5000, "tail " * 300]
    for size in (6, 8, 12, 40, 41, 50, 120, 900):
        texts += copies(rng, say(size), 12, max(1, size // 40))
    passages = [say(20) for _ in range(3)]  # that many texts share
    texts += [" ".join([say(rng.randint(2, 30)), rng.choice(passages), say(rng.randint(2, 9)), rng.choice(passages)]) for _ in range(60)]
    texts += [say(30, 2) for _ in range(20)]
    texts += rng.sample(texts, 20)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c d e"), (None, "alone with no id at all"), (3, "one"), (7, "another text of id seven")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(5)
    found = [tuple(r) for r in jaccard.jaccard_components(df).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(found, key=key) == sorted(classes(rows), key=key)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_linked_sets_have_a_key_in_common():
    """Whatever the classes, also where tokens are of class 2 and 3 only."""
    rng = random.Random(5)
    for turn in range(300):
        n = rng.choice([4, 5, 6, 9, 10, 25, 60, 200])
        universe = [rng.getrandbits(64) for _ in range(n + n // 4 + 1)]
        kind = {h: rng.choice([1, 2, 3] if turn % 2 else [2, 3]) for h in universe}
        a = set(universe[:n])
        b = set(a)
        for h in universe[n:]:
            if rng.random() < 0.6 and 100 * len(a & (b | {h})) >= 80 * len(a | b | {h}):
                b.add(h)
        for h in sorted(a):
            if rng.random() < 0.5 and 100 * len(a & (b - {h})) >= 80 * len(a | (b - {h})):
                b.discard(h)
        found = []
        for own in (a, b):
            counted = [h for h in own if h < jaccard._BOUND]
            others = sorted(h for h in own if h >= jaccard._BOUND)[: jaccard._uncounted(len(own), len(counted))]
            ordered = sorted((kind[h], h) for h in counted)
            found.append(jaccard.prefix_keys(len(own), 0, [k for k, _ in ordered], [h for _, h in ordered], [h - 2**64 if h >= 2**63 else h for h in others]))
        assert a == b or found[0] & found[1], (turn, n)


def test_sets_with_one_code_are_still_linked(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "z y x w v u t s r q p")], "doc_id long, text string")
    every = jaccard.sets(df)
    nodes = every.groupBy("node").agg(F.min("doc_id").alias("first"), F.lit(7).cast("long").alias("code"), *(F.first(c).alias(c) for c in ("n", "counted", *jaccard.BITS))).withColumn("id", F.monotonically_increasing_id()).checkpoint()
    keys = jaccard.combinations_of(df, nodes)
    assert jaccard.links(keys, nodes, jaccard.arrays(df, nodes).checkpoint()).count() == 1


# -- 12 --
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The top and each leaf's (right, sibling) steps."""
    steps, now, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(now) > 1:
        for i, p in enumerate(at):
            steps[i].append((p % 2 == 1, now[p ^ 1] if p ^ 1 < len(now) else ""))
        now, at = [sha(*now[i : i + 2]) for i in range(0, len(now), 2)], [p // 2 for p in at]
    return now[0], steps


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 256, 257), (1, 1, 1, 1), (513, 700)])
def test_op12_trees_of_all_sizes(spark, sizes):
    rows = [(g if i else None, n, sha(str((i, n)))) for i, (g, size) in enumerate(zip("bacd", sizes)) for n in range(size)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "group string, order long, leaf string, load string")
    found = {r.load: r for r in manifest.manifest(df).withColumn("folded", manifest.fold(F.col("leaf"), F.col("steps"))).collect()}
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, g or ""))
    own = {g: sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) for g in groups}
    tops = {g: tree([r[2] for r in own[g]]) for g in groups}
    root, last = tree([tops[g][0] for g in groups])
    assert len(found) == len(rows)
    for g, more in zip(groups, last):
        for r, steps in zip(own[g], tops[g][1]):
            got = found[r[2]]
            assert (got.subroot, got.root, got.folded, [tuple(s) for s in got.steps]) == (tops[g][0], root, root, steps + more)


def test_op12_null_values_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, None, "en", 5, "a"), (1, None, "en", 5, "a"), (None, "s", None, None, None), (2, "", "é", None, ""), (3, "-", "en", 3, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("tree", F.lit("clash")).withColumn("place", F.lit(1)).write.parquet(f"{tmp_path}/a/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    found = manifest.op12_dataset_manifest(spark, f"{tmp_path}/a").collect()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(r.leaf for r in found) == sorted(sha(*map(said, r)) for r in rows)
    for r in found:
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and any(x[0] == r.doc_id and x[3] is not None for x in rows)
        assert r.verified == (not tampered)
    assert manifest.op12_dataset_manifest(spark, f"{tmp_path}/b").count() == 0


# -- 13 --
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, lines) by trying all edits of (role, text, fault)."""
    best = None
    inserts = [()] + [c for n in (1, 2) for c in itertools.product("ua", repeat=n)]

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if best and cost > best[0] or not re.match(r"s?(ua)*u?\Z", roles):
            return
        for ins in inserts:
            now = (cost + 5 * len(ins), audit + "I" * len(ins), roles + "".join(ins), lines + [{"u": "user:", "a": "assistant:"}[x] for x in ins])
            if i == len(rows):
                if PATTERN.match(now[2]) and (best is None or now[:2] < best[:2]):
                    best = (now[0], now[1], now[3])
                continue
            role, text, fault = rows[i]
            go(i + 1, now[0] + 2, now[1] + "D", now[2], now[3])
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            go(i + 1, now[0] + more, now[1] + "K", now[2] + (role[:1] if role[:1] in "sua" and role else "?"), now[3] + [f"{role}:{text}"])
            for name in ("user", "assistant"):
                go(i + 1, now[0] + 1 + more, now[1] + "R", now[2] + name[0], now[3] + [f"{name}:{text}"])

    go(0, 0, "", "", [])
    return best


def restated(rows):
    """All columns of a conversation's damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, lines = cheapest(marked)
    count = lambda f: sum(m[2] == f for m in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


def test_op13_against_all_edits(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 3)  # so that conversations have several chunks
    rng = random.Random(13)
    conversations = {}
    for c in range(60):
        conversations[c if c else None] = [
            (rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Assistant"]), rng.choice(["ok.", f"text {rng.random()}!", "cut", "", " \n", "ok.", "why? "]))
            for _ in range(rng.randint(1, 6))
        ]
        # Ties are ordered by role and hash; here by unique roles, or by the same text.
        own = conversations[c if c else None]
        conversations[c if c else None] = [r for i, r in enumerate(own) if not any(r[:2] == x[:2] and r[2] != x[2] for x in own[:i])]
    rows = [(c, *r) for c, own in conversations.items() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"]
    empty = hashlib.sha256().hexdigest()
    found = {r.conv_id: tuple(empty if r[n] is None else r[n] for n in names) for r in repair.repair(df).collect()}
    assert found == {c: restated(own) for c, own in conversations.items()}


def test_op13_long_conversations_and_grammar(spark):
    """Rules give what the rows one by one give, and a long conversation comes back in chunks."""
    rng = random.Random(3)
    text = "".join(rng.choice("uaUAsox") for _ in range(300))
    plain, rules = repair.Grammar([]), [(chr(repair.FIRST_RULE), "u", "a"), (chr(repair.FIRST_RULE + 1), chr(repair.FIRST_RULE), chr(repair.FIRST_RULE))]
    short = text
    for x, left, right in rules:
        short = short.replace(left + right, x)
    one, two = plain.audits(text), repair.Grammar(rules).audits(short)
    assert one[1] == two[1] and one[0].cost == two[0].cost and one[0].order == two[0].order and len(short) < len(text)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"row {i}.") for i in range(9001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = repair.repair(df).first()
    assert (r.cost, r.audit) == (2, "K" * 9000 + "D")
    assert repair.repair(df.limit(0)).count() == 0


def test_op13_nulls_and_dropped_conversations(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone."), (None, None, None, None), (None, 1, "user", "hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    r = found[dropped]
    assert len(found) == 2 and (r.gaps, r.blank, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, "", hashlib.sha256().hexdigest())


# -- 7 --
def test_wide_fingerprints_with_equal_first_columns_stay_apart(spark):
    far = spark.createDataFrame([(1, 5, 0), (2, 5, (1 << 28) - 1), (3, 5, 1)], "doc_id long, fp long, fq long")
    found = {(r.fp, r.fq): r.component_id for r in simhash.classes(far, simhash.WIDE).collect()}
    assert found == {(5, 0): 1, (5, (1 << 28) - 1): 2, (5, 1): 1}


# -- 8 --
SHORT = "<html><body><article><p>A short article of one line.</p></article>"


@pytest.mark.parametrize(
    "rest",
    [
        '<section id="comments">' + "<p>a comment that is quite long enough</p>" * 40 + "</section>",
        '<div class="cookie-notice"><p>' + "We use cookies on this site. " * 60 + "</p></div>",
        '<div class="user-comments"><p>' + "I have read it. " * 60 + "</p></div>",
        '<ol class="commentlist"><li>' + "I have read it. " * 60 + "</li></ol>",
        '<div class="legal"><p>All rights reserved by the owner.</p></div>',
    ],
)
def test_op8_boilerplate_longer_than_the_article_goes(rest):
    page = SHORT + rest + "</body></html>"
    assert html_text.extract(page, html_text.vote(page)[0]) == "A short article of one line."


def test_op8_counts_text_behind_many_dashes():
    page = '<body><div class="a"><p>' + "-" * 120 + " and sixty characters of the article's only paragraph here.</p></div></body>"
    assert html_text.vote(page)[0] == ">body>div.a"


def test_op8_nested_suspects_take_linear_time():
    import time

    page = lambda n: '<div class="ad">' * n + "all the text there is" + "</div>" * n
    began = time.time()
    assert html_text.extract(page(20_000), None) == "all the text there is"
    assert time.time() - began < 10


def test_jaccard_pairs_of_large_groups_meet_once_or_so(spark, monkeypatch):
    """Texts that share a passage, but don't link, give few pairs; links among them and all components are found."""
    import random

    from tidemark.llm import jaccard

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(400)]
    texts = [passage[: 330 + i] + [word() for _ in range(160)] for i in range(40)]  # about half in common
    texts += [x[:-10] + [word() for _ in range(10)] for x in texts[:10]]  # each links with one of them
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    made, pairs = [], jaccard._pairs

    def counted(*args):
        out = pairs(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_pairs", counted)
    monkeypatch.setattr(jaccard, "RARE", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    found = {x.doc_id: x.component_id for x in jaccard.jaccard_components(docs).collect()}
    assert found == dict(enumerate(root))
    assert sum(made) < 400
