"""page_gaps against its SQL on pages without html, and on texts that hold twelve hex digits of their own."""

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")


def test_pages_without_html_and_digits_in_texts(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT CAST(i AS BIGINT) AS p_partkey, CASE WHEN i % 40 <> 7 THEN concat('Brand#', i % 25 + 1) END AS p_brand FROM range(300) t(i)")
    con.execute("CREATE TABLE pages AS SELECT CAST(i AS BIGINT) AS page_id, CASE WHEN i % 3 = 0 THEN NULL WHEN i % 3 = 1 THEN '<p>key é0badc0ffee12ü</p>' ELSE '<p>x <i id=\"0badc0ffee34\"></p>' END AS html FROM range(200) t(i)")
    for t in ("part", "pages"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = con.execute(__spark_entry__.oracle_sql()["page_gaps"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["page_gaps"](spark, str(tmp_path)).collect()]
    assert {r[2] for r in want} == {"absent from the page", "unknown to the data"}
    assert sorted(got, key=str) == sorted(want, key=str)
