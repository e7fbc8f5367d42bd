"""What many titles and names begin with makes no pairs of them."""

from tidemark.operators import locate


def most_rows(spark, act):
    """The most rows that a step of act() made, and what it returns."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    out = act()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs, most = store.executionsList(), 0
    for i in range(before, runs.size()):
        said, metrics = store.executionMetrics(runs.apply(i).executionId()), runs.apply(i).metrics()
        for k in range(metrics.size()):
            value = said.get(metrics.apply(k).accumulatorId())
            if metrics.apply(k).name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return most, out


def test_a_common_beginning_makes_no_pairs(spark):
    common = "alpha beta gamma delta epsilon"
    names = [(i, f"{common} name{i}") for i in range(400)] + [(900, "alpha beta"), (901, f"{common} title7 more"), (902, "beta title9")]
    titles = [(i, f"{common} title{i}") for i in range(200)] + [(300, f"{common} name5 two"), (301, f"other words {common}"), (302, "alpha"), (303, f"{common} name5")]
    most, found = most_rows(spark, lambda: locate.by_title(spark.createDataFrame(titles, "citation_id long, title string"), spark.createDataFrame(names, "doc_id long, name string")).collect())
    found = {r.citation_id: (r.doc_id, r.overlap, r.method) for r in found}
    # A name that lies in the title goes before those that share the beginning only; title7 stands whole in one.
    assert found[0] == (900, 1.0, "title_strict") and found[7] == (901, 1.0, "title_strict") and found[303] == (5, 1.0, "title_strict")
    assert found[9] == (900, 1.0, "title_strict") and found[301] == (900, 1.0, "title_strict") and 302 not in found
    assert most < 20_000, "titles by names"
