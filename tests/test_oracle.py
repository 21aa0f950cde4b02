"""Every named query of the engine against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

from emberline.plans import catalog


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted("|".join(map(norm, r)) for r in df.select(*columns).collect())
    if name not in catalog.SQL:
        assert rows
        return
    got = duck.execute(catalog.SQL[name])
    order = [[c[0] for c in got.description].index(c) for c in columns]
    assert len(order) == len(got.description)
    assert rows == sorted("|".join(norm(r[i]) for i in order) for r in got.fetchall())


def test_html_clean_on_odd_pages(spark, tmp_path):
    html = ["<title>R&amp</title> &am &quo &amp;amp; &amp;copy;", None, "", "\u00a0 a\u000bb\u0085 c\u2003\n", "&lt;b&gt; &copy &#65; &nbsp;", "a<>b<c\nd>e\f\r\tf", "\u2028<p>x</p>\u2028 ", "<p>&quot;&middot;&copy;", "a < b > c <", "\u3000\u00a0"]
    spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {tuple(r) for r in catalog.QUERIES["html_clean"](spark, str(tmp_path)).collect()} == set(con.execute(catalog.SQL["html_clean"]).fetchall())
