"""Work on spellings: each is normalised and classified once, however often it occurs."""

from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.operators import leaks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_literals_are_counted_before_they_are_normalised(spark):
    own = spark.createDataFrame([("r", x, p, "color") for x in ("#FFF", "#ffffff", " #fff") for p in ("plugins/a/x.css", "plugins/a/x.css", "src/y.css")], "repo_id string, literal string, path string, property string")
    rows = leaks.literal_groups(own)
    assert [tuple(r) for r in rows.collect()] == [("r", "#ffffff", 9, 2, 2, ["color"])]
    lines = plan(rows).splitlines()
    assert max(k for k, x in enumerate(lines) if "Aggregate" in x) >= max(k for k, x in enumerate(lines) if "regexp_replace" in x)


def test_near_colors_are_sought_among_spellings(spark):
    own = spark.createDataFrame([("r", x) for x in ("#ff0001", "#FF0001", "#00ff00", "#F00", "red")] * 20, "repo_id string, literal string")
    toks = spark.createDataFrame([("r", "b", "#F00"), ("r", "a", "#ff0000"), ("r", "c", "1px")] * 20, "repo_id string, token string, value string")
    rows = leaks.near_miss_color(own, toks)
    assert [(r["literal"], r["token"], r["value"]) for r in rows.collect()] == [("#ff0001", "a", "#ff0000")]
    assert "regexp_replace" not in plan(rows)


def test_near_colors_across_repositories(spark):
    own = spark.createDataFrame([("a", "#ff0001"), ("b", "#ff0001"), ("b", "#0000FF"), ("c", "#ff0000")], "repo_id string, literal string")
    toks = spark.createDataFrame([("a", "x", "#ff0000"), ("b", "y", "#0000fe"), ("c", "z", "#FF0000")], "repo_id string, token string, value string")
    rows = leaks.near_miss_color(own, toks)
    assert {(r["repo_id"], r["literal"], r["token"]) for r in rows.collect()} == {("a", "#ff0001", "x"), ("b", "#0000ff", "y")}
    # Colors are worked out of a table that was written, not of declarations.
    assert plan(rows).count("Aggregate") <= 2 and "lower(" not in plan(rows)


def test_family_key_is_worked_out_once(spark):
    rows = spark.createDataFrame([("--colorPrimary", "1px", "color"), ("$z-index", "3", None), ("--a", "#fff", "color"), ("font-x", None, None), ("type", "x", "typography"), (None, "#fff", "color")], "name string, value string, want string")
    out = rows.select("want", s.family_for(F.col("name"), F.col("value")).alias("got"))
    assert all(r["got"] == r["want"] or r["want"] is None and r["got"] for r in out.collect())
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 3


def test_brand_colors_classify_spellings_once(spark):
    from gridloom.operators import tokens

    decls = spark.createDataFrame([("r", "a.css", k, "--brand-red", "#F00", None) for k in range(30)] + [("r", "b.css", 1, "--brand-red", "#f00", "Visual identity")], "repo_id string, path string, line int, name string, value string, label string")
    rows = tokens.brand_colors(decls, spark.createDataFrame([("r", "acme")], "repo_id string, namespace string"))
    assert [(r["token"], r["state"], r["sites"], r["confidence"]) for r in rows.collect()] == [("brand-red", "verified", 31, "explicit-brand-name-and-source-section")]
    own = []
    keep = tokens.foreign_tokens
    try:
        tokens.foreign_tokens = lambda names, subjects: own.append(plan(names)) or keep(names, subjects)
        tokens.brand_colors(decls, spark.createDataFrame([("r", "acme")], "repo_id string, namespace string"))
    finally:
        tokens.foreign_tokens = keep
    assert "oklch" not in own[0]


def test_identity_drift_reads_staged_spellings(spark):
    from gridloom.operators import rederive, tokens

    schema = "repo_id string, path string, line int, name string, value string, label string"
    decls = spark.createDataFrame([("r", "a.css", k, "--brand-red", "#F00", None) for k in range(9)], schema)
    subjects = spark.createDataFrame([("r", "acme")], "repo_id string, namespace string")
    recorded = tokens.brand_colors(decls, subjects).select("repo_id", "token", "state", "color", "sites").withColumn("sites", F.lit(8).cast("long"))
    rows = rederive.identity_drift(recorded, decls, subjects)
    assert [tuple(r) for r in rows.collect()] == [("r", "brand-red", "sites", "8", "9")]
    assert "oklch" not in plan(rows)


def test_only_fenced_texts_are_sorted_by_line(spark):
    from gridloom.operators import text

    docs = spark.createDataFrame([(1, "colour\nutilize <b>x</b>`simply`"), (2, "grey\n```\ngrey\n```\nin<i>order to"), (3, "a\n``` x\nin order to"), (4, None)], "doc_id int, text string")
    assert sorted(map(tuple, text.fenced(docs).collect())) == sorted(map(tuple, text.fences(text.lines_of(docs)).collect()))
    got = {(r["doc_id"], r["line_no"], r["rule"], r["detail"]) for r in text.voice_lint(docs).collect()}
    assert got == {(1, 1, "us-english", "colour"), (1, 2, "banned-phrase", "utilize"), (2, 1, "us-english", "grey"), (2, 5, "banned-phrase", "in order to"), (3, 2, "unbalanced-fence", "open"), (3, 3, "banned-phrase", "in order to")}
