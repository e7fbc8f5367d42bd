"""Each registered query of the engine's own operators against its SQL in DuckDB."""

import pytest

from conftest import DATA
from tidemark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]
    said = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(said, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    # Parsing and an index that isn't exact, tested on fixtures.
    assert set(QUERIES) - set(SQL) <= {"page_sections", "markdown_paragraphs", "vector_index_recall"}


def test_sql_states_its_own_values():
    """The SQL takes no words, phrases or weights from the engine."""
    import ast
    from pathlib import Path

    for path in Path(registry.__file__).parent.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            assert not (isinstance(node, ast.ImportFrom) and node.module == "tidemark.functions.constants"), path


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["query_id", "doc_id", "paragraph_index", "origin", "score", "label", "position"]
    assert found.count() > 0
