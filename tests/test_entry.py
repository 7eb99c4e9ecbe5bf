"""The driver contract, with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from gridloom import plans

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_imports_without_the_text_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0


duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", ["exact_value_leaks", "concept_collapse", "family_states", "reachability", "roadmap_bands", "utility_resolution", "ranked_moves", "trend_diff", "voice_lint"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(plans.ORACLE[name])
    names = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted([tuple(r[k] for k in at) for r in want.fetchall()], key=str)
    got = plans.QUERIES[name](spark, sf)
    assert sorted(got.columns) == names
    assert sorted([tuple(r) for r in got.select(names).collect()], key=str) == rows
