"""Every query of the library against DuckDB on the smallest tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomfeed.plans.catalog import ORACLE_SQL, QUERIES

from .parity import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLE_SQL:
        assert difference(df, duck, ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["q_page_identity", "q_page_title"])
def test_character_references_of_titles(spark, tmp_path, name):
    """Named references are read without their semicolon too, as in titles that were cut; quotes and doubly coded ones are."""
    titles = ["a&amp;&amp;b c&amp", "two &quot;words&quot; &lt;b&gt; &am", "x&ampThe &#39;q&#x27; &AMP; y", "one &amp;lt; two &amp;amp; three"]
    rows = [(i, "u", f"<html><title>{t}</title><body><h1>{t}</h1></body></html>") for i, t in enumerate(titles * 2, 1)]
    pq.write_table(pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*rows, strict=True)), strict=True))), f"{tmp_path}/pages.parquet")
    sf_dir = str(tmp_path)
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == ""


def test_cases_of_odd_documents(spark, tmp_path):
    """Empty fields have their lines; a case of which a part is null has no text, as in the SQL."""
    docs = [(0, "a", "en", "s"), (1, "b", "en", "s"), (2, "c", "en", "s"), (5, "", "en", "s"), (10, None, "en", "s"), (6, "x", "", "s"), (11, "x", None, "s"), (7, "x", "en", ""), (12, "x", "en", None), (3, None, None, None), (None, "x", "en", "s"), (0, " \n", "en", "s")]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    table = pa.table([list(x) for x in zip(*docs, strict=True)], schema=schema).append_column("n_chars", pa.array([len(x[1] or "") for x in docs]))
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [0, 5], "quality": [1, 0], "toxic": [0, 1]}), f"{tmp_path}/labels.parquet")
    sf_dir = str(tmp_path)
    assert difference(QUERIES["q_markdown_cases"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["q_markdown_cases"]) == ""


def test_entry_lists_the_same_keys():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_reads_only_what_a_query_needs(spark):
    plan = QUERIES["q_sales_history"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "PushedFilters" in plan
