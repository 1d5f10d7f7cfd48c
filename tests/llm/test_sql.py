"""Queries against their SQL."""

import re

import duckdb
import pytest

from corpusloom.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, DIR)
    assert sorted(found.columns) == sorted(columns)
    assert plain(tuple(r) for r in found.select(*columns).collect()) == plain(want.fetchall())


def test_url_filter_agrees_with_its_sql_where_the_floor_counts(spark, tmp_path):
    """Fifty distrusted seeds; distrust that three levels of linking hosts thin out to both sides of the floor."""
    link = lambda host: f'<a href="http://{host}/x">x</a>'
    pages = [(f"bad{k}.net", "/es/a", "") for k in range(50)]
    pages += [(f"near{k}.org", "/a", link("bad0.net")) for k in range(100)]
    pages += [(f"far{k}.org", "/a", link("near0.org")) for k in range(100)]
    pages += [(f"away{k}.org", "/a", link("far0.org")) for k in range(100)]
    rows = [(k, f"http://{host}{path}", html) for k, (host, path, html) in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(SQL["op8_url_filter"])
    columns = [c[0] for c in want.description]
    found = [tuple(r) for r in QUERIES["op8_url_filter"](spark, str(tmp_path)).select(*columns).collect()]
    assert plain(found) == plain(want.fetchall())
    verdicts = {(re.sub(r"\d.*", "", r[columns.index("host")]), r[columns.index("verdict")]) for r in found}
    assert {("far", "block"), ("away", "allow")} <= verdicts and ("far", "allow") not in verdicts
