"""Operators against small tables with known answers, and each on an empty input."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators import extract, graphs, grades, integrity, leaks, runs, text, tokens, usage


def value(spark, column, **row):
    names = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], names or "x string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("name", "literal", "family"), [
    ("--focus-ring", "2px", "focus"), ("--brand", "#fff", "color"), ("fontFamily", "Inter", "typography"), ("--space_4", "4px", "spacing"), ("$z-index-modal", "10", "layer"), ("--type-body", "16px", "typography"),
    ("--icon-size", "16px", "icon"), ("--border-color", "#000", "border"), ("--thing", "3", "unclassified"), ("--max-width", "3px", "sizing"), ("--bg", "var(--x)", "color"),
])
def test_family(spark, name, literal, family):
    assert value(spark, s.family_for(F.col("n"), F.col("x")), n=name, x=literal) == family


def test_names_values_and_ids(spark):
    assert value(spark, s.normalize(F.col("n")), n="--Font_Size") == "font-size"
    assert value(spark, s.family_key(F.col("n")), n="fontSizeLg.x") == "font-size-lg-x"
    assert [value(spark, s.value_shape(F.col("n")), n=x) for x in ("var(--a)", "$b-c", "#fff")] == ["alias", "alias", "literal"]
    assert [value(spark, s.alias_target(F.col("n")), n=x) for x in ("calc(var( --A_b ) * 2)", "$x", "4px")] == ["a-b", "x", None]
    assert [value(spark, s.normalize_literal(F.col("n")), n=x) for x in ("#FaB", " rgb( 255 , 0,0 ) ", "#abcd")] == ["#ffaabb", "rgb(255,0,0)", "#abcd"]
    got = value(spark, s.finding_id(F.lit("redundant"), F.lit("color"), F.col("n"), F.lit(None)), n="#FFF")
    assert got == hashlib.sha1(b"redundant|color|#ffffff|").hexdigest()[:12]


@pytest.mark.parametrize(("literal", "ok"), [
    ("#abc", True), ("#abcde", False), ("rgb(1, 2, 3)", True), ("rgba(1,2,3)", False), ("rgb(1 2 3 / 50%)", True), ("hsl(120deg 50% 20%)", True), ("hsl(120, 50, 20)", False), ("oklch(60% .2 40)", True),
    ("color(display-p3 1 0 0)", True), ("color(foo 1 0 0)", False), ("rgb(var(--x))", False), ("lab(50% 20 30)", True), ("red", False),
])
def test_concrete_color(spark, literal, ok):
    assert (value(spark, s.concrete_color_value(F.col("n")), n=literal) is not None) is ok


def test_fonts_components_and_utilities(spark):
    assert [value(spark, s.concrete_font_family(F.col("n")), n=x) for x in ('"DM Sans", serif', "['Inter', 'x']", "serif", "var(--f)", "Arial")] == ["DM Sans", "Inter", None, None, "Arial"]
    identity = lambda p: tuple(value(spark, s.component_identity(F.col("n")), n=p))
    assert identity("packages/ui/components/button/button.module.css") == ("ui::button", "ui / button", "component")
    assert identity("app/components/mobile/card/index.tsx") == ("core::card", "core / card", "component")
    assert identity("plugins/chat/stylesheets/desktop/_list-mobile.scss") == ("chat::list", "chat / list", "style-surface")
    assert identity("plugins/p1/f3.css") == ("p1::f3", "p1 / f3", "surface")
    assert [value(spark, s.peel(F.col("n")), n=x) for x in ("md:hover:!-m-4", "supports-[display:grid]:bg-muted/50", "bg-[url(a:b/c)]")] == ["m-4", "bg-muted", "bg-[url(a:b/c)]"]


def test_priority_effort_and_contrast(spark):
    row = spark.range(1).select(s.priority(F.lit(4), F.lit(3), F.lit(2), F.lit("exact static match")).alias("p"), s.contrast(F.lit("#000000"), F.lit("#ffffff")).alias("c"), s.effort(F.lit("redundant"), F.lit("exact static match"), F.lit(9), F.lit(True)).alias("e")).first()
    assert row["p"]["score"] == 15.2 and round(row["c"], 3) == 21.0 and row["e"] == "S"


#: Published test pairs of the CIEDE2000 formula.
@pytest.mark.parametrize(("p", "q", "want"), [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0000), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082),
])
def test_delta_e(spark, p, q, want):
    df = spark.createDataFrame([(p, q)], "p struct<l:double,a:double,b:double>, q struct<l:double,a:double,b:double>")
    assert abs(s.with_delta_e(df, "p", "q", "de").first()["de"] - want) < 1e-4


DECL = "repo_id string, path string, ord int, line int, name string, value string, representation string, alias_of string"


def test_concepts_tiers_conflicts_and_states(spark):
    rows = [
        ("r", "a.css", 0, 1, "--blue", "#00f", "css-custom-property", None), ("r", "a.css", 1, 2, "--link", "var(--blue)", "css-custom-property", "blue"), ("r", "b.css", 0, 1, "--Link", "#123456", "css-custom-property", None),
        ("r", "b.css", 1, 2, "--lost", "var(--gone)", "css-custom-property", "gone"), ("r", "b.css", 2, 3, "--semantic-x", "4px", "css-custom-property", None),
    ]
    c = tokens.tiers(tokens.resolve_aliases(tokens.collapse_concepts(spark.createDataFrame(rows, DECL))))
    got = {r["id"]: r for r in c.collect()}
    assert {k: r["tier"] for k, r in got.items()} == {"blue": "primitive", "link": "untraced", "lost": "semantic", "semantic-x": "semantic"}
    assert got["link"]["names"] == ["--link", "--Link"] and got["link"]["sites"] == ["a.css:2", "b.css:1"] and got["link"]["alias_resolved"] and got["lost"]["alias_resolved"] is False
    assert [(r["token"], r["kind"]) for r in tokens.conflicts(c).collect()] == [("link", "literal beside alias")]
    hidden = spark.createDataFrame([("r", "motion"), ("r", "color")], "repo_id string, family string")
    states = {r["family"]: (r["state"], r["count"]) for r in tokens.family_states(c, hidden).collect()}
    assert len(states) == 19 and states["color"] == ("counted", 2) and states["motion"] == ("not-visible", None) and states["blur"] == ("none-used", 0)
    assert integrity.family_rules(tokens.family_states(c, hidden)).collect() == []
    assert tokens.family_states(c.limit(0), hidden.limit(0)).collect() == []


def test_roles_and_siblings(spark):
    rows = [("r", "src/tokens/colors.ts", "canonical", "canonical"), ("r", "src/tokens/blur.ts", "candidate", "canonical"), ("r", "src/lib/x.ts", "candidate", "canonical"), ("r", "src/tokens/deep/y.ts", "candidate", "canonical")]
    got = {r["path"]: r["final_role"] for r in tokens.admit_siblings(spark.createDataFrame(rows, "repo_id string, path string, role string, role_if_admitted string")).collect()}
    assert got == {"src/tokens/colors.ts": "canonical", "src/tokens/blur.ts": "canonical", "src/lib/x.ts": "candidate", "src/tokens/deep/y.ts": "candidate"}


def test_near_misses(spark):
    steps = spark.createDataFrame([("r", "spacing", float(x)) for x in (4, 8, 16, 17)], "repo_id string, family string, px double")
    lits = spark.createDataFrame([("r", f"{x}px", float(x)) for x in (4, 5, 6, 9, 15, 30)], "repo_id string, literal string, px double")
    got = {r["literal"]: (r["distance"], r["step"]) for r in leaks.near_miss_dimension(lits, steps).collect()}
    assert got == {"5px": (1.0, 4.0), "6px": (2.0, 4.0), "9px": (1.0, 8.0)}
    colors = leaks.near_miss_color(spark.createDataFrame([("r", x) for x in ("#ff0001", "#FF0000", "#00ff00")], "repo_id string, literal string"), spark.createDataFrame([("r", "red", "#f00")], "repo_id string, token string, value string"))
    assert [(r["literal"], r["token"]) for r in colors.collect()] == [("#ff0001", "red")]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "y")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    got = {r["node"]: (r["depth"], r["via"]) for r in graphs.reachable(edges, seed).collect()}
    assert got == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "d": (1, ["a", "d"]), "c": (2, ["a", "b", "c"])}
    stop = graphs.reachable(edges, seed, terminal=spark.createDataFrame([("b",), ("d",)], "node string"))
    assert {r["node"] for r in stop.collect()} == {"a", "b", "d"}
    c = spark.createDataFrame([("p", "primitive", None), ("s", "semantic", "p"), ("t", "semantic", "s"), ("l1", "semantic", "l2"), ("l2", "semantic", "l1"), ("m", "semantic", "gone")], "token string, tier string, alias_of string")
    chains = {r["token"]: r for r in graphs.alias_chains(c).collect()}
    assert chains["t"]["hops"] == ["t", "s", "p"] and chains["t"]["complete"] and not chains["l1"]["complete"] and chains["l1"]["note"] == "cycle" and chains["m"]["stops_at"] == "gone"
    uses = spark.createDataFrame([("t", "button"), ("p", "own"), ("s", "card")], "token string, component string")
    radius = {r["token"]: (r["dependents"], r["component_count"]) for r in graphs.blast_radius(c, uses).collect()}
    assert radius == {"p": (2, 2), "s": (1, 1), "t": (0, 0), "l1": (1, 0), "l2": (1, 0), "m": (0, 0)}
    scope = graphs.orphan_scope(spark.createDataFrame([("a/b/c.css",), ("z.css",)], "path string"), spark.createDataFrame([("a/b",)], "prefix string"))
    assert {r["path"]: r["scope"] for r in scope.collect()} == {"a/b/c.css": "owned", "z.css": "outside"}


def test_usage_and_utilities(spark):
    own = spark.createDataFrame([("r", f"c{k}", n, 1) for k, n in enumerate((50, 30, 15, 5))], "repo_id string, component string, references long, distinct_tokens long")
    got = [(r["band"], r["share"], r["cumulative_share"]) for r in usage.roadmap_bands(usage.rank_components(own)).orderBy("rank").collect()]
    assert got == [("assess-first", 50.0, 50.0), ("plan-next", 30.0, 80.0), ("focused-follow-up", 15.0, 95.0), ("focused-follow-up", 5.0, 100.0)]
    theme = spark.createDataFrame([("color", "brand", "#fff"), ("text", "brand", "1rem"), ("spacing", "", "4px"), ("font-weight", "bold", "700")], "namespace string, key string, value string")
    names = ["bg-brand", "hover:text-brand", "p-4", "p-x", "font-bold", "bg-[#fff]", "unknown"]
    classes = spark.createDataFrame([(x,) for x in names], "class string")
    res = {r["class"]: (r["state"], r["concept"], r["derived"]) for r in usage.resolve_utilities(classes, usage.prefix_table(spark), theme).collect()}
    assert [res[x] for x in names] == [("resolved", "color-brand", False), ("ambiguous", None, False), ("resolved", "spacing", True), ("unresolved", None, False), ("resolved", "font-weight-bold", False), ("unresolved", None, False), ("unresolved", None, False)]
    arb = {r["class"]: (r["kind"], r["value"]) for r in usage.arbitrary_values(spark.createDataFrame([("bg-[#fff]",), ("bg-[--x]",), ("bg-[var(--x)]",), ("bg-(--x)",)], "class string")).collect()}
    assert arb == {"bg-[#fff]": ("literal", "#fff"), "bg-[--x]": ("redundant", "--x")}


def test_grades(spark):
    def grade(column):
        return spark.range(1).select(column.alias("g")).first()["g"]

    n = F.lit
    assert [grade(grades.grade_leakage(x)) for x in (n(0), n(10), n(11), n(None).cast("int"))] == ["healthy", "watch", "needs-work", "not-visible"]
    assert [grade(grades.grade_orphans(n(x), n(100))) for x in (1, 2, 10, 11)] == ["healthy", "watch", "watch", "needs-work"]
    assert [grade(grades.grade_enforcement(n(x))) for x in (2, 1, 0)] == ["healthy", "watch", "not-visible"]
    assert grade(grades.with_evidence(n("watch"), F.array().cast("array<string>"))) == "not-visible"
    rows = spark.createDataFrame([(1, 0, "healthy"), (1, 1, "needs-work"), (2, 7, "odd")], "repo_id long, check_id int, grade string")
    counts = {r["repo_id"]: tuple(r)[1:] for r in grades.grade_counts(rows).collect()}
    assert counts == {1: (1, 0, 1, 6, 0), 2: (0, 0, 0, 8, 0)}
    assert {r["repo_id"]: r["stage"] for r in grades.maturity_stage(rows).collect()} == {1: "scattered", 2: "scattered"}


def test_runs(spark):
    a, b = (spark.createDataFrame(x, "id string, occurrences long") for x in ([("a", 1), ("b", 5), ("c", 2)], [("b", 6), ("c", 1), ("d", 1)]))
    diff = runs.trend_diff(a, b)
    assert {r["id"]: r["change"] for r in diff.collect()} == {"a": "resolved", "b": "grew", "c": "shrank", "d": "new"}
    assert {(r["id"], r["why"]) for r in runs.regressions(diff, spark.createDataFrame([("d",)], "id string")).collect()} == {("b", "grew"), ("d", "returned")}
    run = "repo_id long, intent string, paths array<string>"
    gate = runs.compat_gate(spark.createDataFrame([(1, None, ["b", "a"])], run), spark.createDataFrame([(1, "x", ["a", "b"])], run), ["intent"], ["paths"])
    assert [tuple(r) for r in gate.collect()] == [(1, "intent", None, "x")]
    commits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (3, "d", 1)], "repo_id long, sha string, seq int")
    fresh = runs.freshness(commits, spark.createDataFrame([(1, "a"), (2, "c"), (3, "zz")], "repo_id long, sha string"), spark.createDataFrame([], "repo_id long"))
    assert {r["repo_id"]: (r["state"], r["behind"]) for r in fresh.collect()} == {1: ("stale", 1), 2: ("fresh", 0), 3: ("unknown", None)}


FILES = [
    ("r", "src/app.tsx", "import './styles/main.scss'\nimport { B } from \"ui/button\"\n// import './not.css'\nconst t = `import './x'`\nconst c = import(name)\nconst q = require('./util')\n"),
    ("r", "src/styles/main.scss", "@use 'tokens';\n$gap: 4px !default;\n/* --no: 1; */\n.a { color: var(--Brand_x); margin: $gap; background: #FFF }\n"),
    ("r", "src/styles/_tokens.scss", ":root {\n  --brand-x: #00f;\n  --shadow: 0 0 1px rgba(0,0,0,.2),\n    0 1px 2px #000;\n}\n$map: (\n  'sm': (\n    a: 1px,\n  ),\n  b: 2px,\n)\n"),
    ("r", "src/util.ts", "export const theme = {\n  color: {\n    brand: '#123456',\n    '--x': '1px',\n  },\n  n: other,\n}\n"),
    ("r", "tokens.json", '{"a": {"$value": "1px", "b": {"$value": "2"}}, "c": {"d": {"value": 3}}, "$meta": {"value": "no"}}'),
    ("r", "packages/ui/src/button.tsx", "export default 1"), ("r", "node_modules/p/x.css", ":root{--z:1}"), ("r", "src/target/t.css", ""), ("r", "target/t.css", ""),
    ("r", "index.html", '<link rel="stylesheet" href="a.css"><link rel="icon" href="i.png"><script src="m.js"></script>'),
]


def test_extraction_and_resolution(spark):
    files = extract.scan_corpus(spark.createDataFrame(FILES, "repo_id string, path string, content string"))
    assert {r["path"] for r in files.collect()} == {f[1] for f in FILES} - {"node_modules/p/x.css", "target/t.css"}
    decls = {(r["name"], r["value"], r["representation"], r["line"]) for r in extract.declarations(files).collect()}
    assert decls >= {("--brand-x", "#00f", "css-custom-property", 2), ("--shadow", "0 0 1px rgba(0,0,0,.2), 0 1px 2px #000", "css-custom-property", 3), ("$gap", "4px", "scss-variable", 2), ("$map.sm.a", "1px", "scss-map-entry", 8), ("$map.b", "2px", "scss-map-entry", 10)}
    assert {("theme.color.brand", "#123456", "js-theme-object", 3), ("--x", "1px", "js-theme-object", 4)} <= decls and not any(d[0] in ("--no", "--z", "theme.n") for d in decls)
    assert {d[:2] for d in decls if d[2].endswith("json")} == {("a", "1px"), ("c.d", "3")}
    refs = {(r["path"], r["line"], r["token"], r["syntax"]) for r in extract.references(files).collect()}
    assert {("src/styles/main.scss", 4, "brand-x", "css-custom-property"), ("src/styles/main.scss", 4, "gap", "scss-variable")} <= refs and not any(r[1] == 2 and r[2] == "gap" for r in refs)
    assert {(r["literal"], r["property"]) for r in extract.hex_literals(files).where("path like '%main.scss'").collect()} == {("#FFF", "background")}
    records = extract.imports(files)
    specs = {(r["path"], r["spec"]) for r in records.collect()}
    assert {s for p, s in specs if p == "src/app.tsx"} == {"./styles/main.scss", "ui/button", "<dynamic:name>", "./util"}
    assert {s for p, s in specs if p == "index.html"} == {"a.css", "m.js"}
    packages = spark.createDataFrame([("r", "ui", "packages/ui")], "repo_id string, name string, dir string")
    edges, lost = extract.resolve_imports(records, files, packages)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("src/app.tsx", "src/styles/main.scss"), ("src/app.tsx", "packages/ui/src/button.tsx"), ("src/app.tsx", "src/util.ts"), ("src/styles/main.scss", "src/styles/_tokens.scss")}
    assert {(r["spec"], r["reason"]) for r in lost.collect()} == {("<dynamic:name>", "dynamic runtime import"), ("a.css", "external package"), ("m.js", "external package")}
    assert extract.declarations(files.limit(0)).collect() == [] and extract.imports(files.limit(0)).collect() == []
    tree = extract.expand_tree(spark.createDataFrame([("r", "x.js", "src/styles")], "repo_id string, path string, dir string"), files)
    assert {r["dst"] for r in tree.collect()} == {"src/styles/main.scss", "src/styles/_tokens.scss"}


def test_tree_of_one_large_directory(spark):
    own = spark.range(500).selectExpr("'r' as repo_id", "concat('a/b/f', id) as path").union(spark.createDataFrame([("r", "top"), ("r", "a/x")], "repo_id string, path string"))
    rows = extract.expand_tree(spark.createDataFrame([("r", "s", "a"), ("r", "s", "a/b"), ("r", "s", "a"), ("r", "t", "a/b"), ("r", "a/x", "a"), ("r", "u", "top")], "repo_id string, path string, dir string"), own.union(own))
    got = [(r["src"], r["dst"]) for r in rows.collect()]
    under = [f"a/b/f{k}" for k in range(500)]
    assert sorted(got) == sorted([("s", x) for x in [*under, "a/x"]] + [("t", x) for x in under] + [("a/x", x) for x in under] + [("u", "top")])
    # One directory is many tasks, and no shuffle follows the join.
    assert len({r["p"] for r in rows.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 8


def test_tree_meets_in_blocks(spark, monkeypatch):
    for name, n in (("TREE_PARTS", 2), ("TREE_TASKS", 3), ("TREE_FILES", 8), ("TREE_SOURCES", 3)):
        monkeypatch.setattr(extract, name, n, raising=False)
    paths = [("r", f"a/f{k}") for k in range(45)] + [("r", f"a/b/g{k}") for k in range(20)] + [("r:1", "a/x"), ("r", "1:a/x"), (None, "a/y"), ("r", "c/z"), ("r", "")]
    asked = [("r", f"s{k}", "a") for k in range(10)] + [("r", "a/f3", "a"), ("r", "t", "a/b"), ("r:1", "s", "a"), ("r", "s", "1:a"), (None, "s", "a"), ("r", "n", None), ("r", None, "a"), ("q", "s", "a")]
    rows = extract.expand_tree(spark.createDataFrame(asked * 2, "repo_id string, path string, dir string"), spark.createDataFrame(paths * 3, "repo_id string, path string"))
    want = {(r, s, p) for r, s, d in asked for q, p in paths if None not in (r, s, d) and r == q and p.startswith(d + "/") and s != p}
    got = [tuple(r) for r in rows.collect()]
    assert len(want) == 10 * 65 + 64 + 20 + 1 + 1 and len(got) == len(want) and set(got) == want


def test_tree_takes_little_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(extract, "TREE_PARTS", 1)
    asked = spark.range(2001).selectExpr("'r' as repo_id", "concat('public/p', id * 13, '.html') as path", "'packages' as dir")
    files = spark.range(999).selectExpr("'r' as repo_id", "concat('packages/w', id * 7, '/package.json') as path")
    extract.expand_tree(asked, files).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2001 * 999
    # In the order of a join 0.46 bytes a pair, in blocks 0.17.
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.25 * 2001 * 999


def test_themes_and_fonts(spark):
    css = "@theme {\n  --color-brand: #fff;\n  --font-weight-bold: 700;\n  --spacing: 4px;\n}\n@font-face { font-family: 'DM Sans'; src: url('a.woff2') format('woff2'), url(b.ttf) }"
    files = spark.createDataFrame([("r", "t.css", css)], "repo_id string, path string, content string")
    assert {tuple(r) for r in extract.theme_declarations(files, v.UTILITY_NAMESPACES).collect()} == {("color", "brand", "#fff"), ("font-weight", "bold", "700"), ("spacing", "", "4px")}
    assert {(r["family"], r["url"]) for r in extract.font_faces(files).collect()} == {("DM Sans", "a.woff2"), ("DM Sans", "b.ttf")}
    fonts = extract.font_assets(spark.createDataFrame([("a", bytearray(b"wOF2x")), ("b", bytearray(b"nope"))], "path string, content binary"))
    assert [(r["path"], r["format"]) for r in fonts.collect()] == [("a", "woff2")]


def test_text(spark):
    body = "The colour is simply a `colour` code.\n```\ncolour\n```\nIt is not a duck. <b title='grey'>x</b>\n```\nopen"
    docs = spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string")
    got = {(r["line_no"], r["rule"], r["detail"]) for r in text.voice_lint(docs).collect()}
    assert got == {(1, "us-english", "colour"), (1, "banned-phrase", "simply"), (5, "negative-parallelism", "negative"), (6, "unbalanced-fence", "open")}
    pages = spark.createDataFrame([(1, "<script>bad()</script><p onclick=\"x\">a &amp;lt; b</p><!-- c -->"), (2, None)], "page_id long, html string")
    assert {r["page_id"]: r["text"].split() for r in text.visible_text(pages).collect()} == {1: ["a", "&lt;", "b"], 2: []}
    assert [tuple(r) for r in text.markup_scan(pages).collect()] == [(1, 2)]


def test_discovery(spark, tmp_path):
    from gridloom.operators import discovery as d
    from gridloom.sources import artefacts as a

    paths = spark.createDataFrame([("apps/web/src/x.css",), ("packages/ui/y.css",), ("z.css",)], "path string")
    rules = spark.createDataFrame([(d.glob_regex("apps/*"),), (d.glob_regex("packages/**"),)], "regex string")
    assert {r["path"]: r["ownership"] for r in d.ownership(paths, rules).collect()} == {"apps/web/src/x.css": "owned", "packages/ui/y.css": "owned", "z.css": "outside"}
    roots = spark.createDataFrame([("apps", "path-inferred"), ("apps/web", "import-graph verified")], "prefix string, confidence string")
    assert {r["path"]: r["confidence"] for r in d.strongest_root(paths, roots).collect()} == {"apps/web/src/x.css": "import-graph verified", "packages/ui/y.css": None, "z.css": None}
    assert [tuple(r) for r in d.nearest_context(paths, spark.createDataFrame([("apps", "a"), ("apps/web", "b")], "prefix string, context string")).collect()] == [("apps/web/src/x.css", "apps/web", "b")]
    specs = spark.createDataFrame([("@/lib/x",), ("@/x",), ("y",)], "spec string")
    aliases = spark.createDataFrame([("@/*", "src/*"), ("@/lib/*", "lib/*")], "pattern string, target string")
    assert {r["spec"]: r["rewritten"] for r in d.rewrite_aliases(specs, aliases).collect()} == {"@/lib/x": "lib/x", "@/x": "src/x", "y": "y"}
    both = d.rewrite_profiles(specs, spark.createDataFrame([("@/", "a/"), ("@/lib", "b")], "prefix string, target string"))
    assert {r["spec"]: (r["rewritten"], r["ambiguous"]) for r in both.collect()} == {"@/lib/x": (None, True), "@/x": ("a/x", False)}
    apps = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "c")], "repo_id string, dir string")
    assert {tuple(r) for r in d.applications(apps).collect()} == {("r", "not-visible", None), ("q", "selected", "c")}
    one, two = (spark.createDataFrame(x, "id string, priority int, needle string") for x in ([("a", 1, "x"), ("b", 5, "y")], [("a", 9, "z")]))
    assert [tuple(r) for r in a.rule_registry(one, two).collect()] == [("a", 9, "z"), ("b", 5, "y")]
    files = spark.createDataFrame([("r", "u", "a.css", "x"), ("r", "v", "b.css", "y")], "repo_id string, run_id string, path string, content string")
    a.write_run(files, f"{tmp_path}/f")
    a.write_run(files.where("run_id = 'v'").withColumn("content", F.lit("new")), f"{tmp_path}/f")
    assert {(r["run_id"], r["content"]) for r in a.read_run(spark, f"{tmp_path}/f", "r").collect()} == {("u", "x"), ("v", "new")}
    want = "\n".join(f"{p}:{hashlib.sha256(c.encode()).hexdigest()}" for p, c in (("a.css", "x"), ("b.css", "y")))
    assert a.corpus_digest(files).first()["digest"] == hashlib.sha256(want.encode()).hexdigest()


def test_configuration_and_headings(spark):
    rows = [
        ("r", "packages/ui/package.json", '{"name": "ui", "devDependencies": {"tailwindcss": "^4.2.1"}}'), ("r", "package.json", '{"name": "root"}'),
        ("r", "tsconfig.json", '{ // a comment\n "compilerOptions": {"paths": {"@/*": ["src/*", "lib//*"],},},}'),
        ("r", "a.css", "/* Brand\n * colors */\n\n:root {\n  --a: 1;\n  .x { --b: 2; }\n}\n// layout\n.y { --c: 3 }\n"), ("r", "b.tsx", "<p className=\"bg-muted p-4\" title='x'>not these</p>"), ("r", "vite.config.ts", "entry: 'src/main.ts', entry: '../out'"),
    ]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    assert [tuple(r) for r in extract.workspace_packages(files).collect()] == [("r", "ui", "packages/ui")]
    assert [(r["pattern"], r["ord"], r["target"]) for r in extract.path_aliases(files).orderBy("ord").collect()] == [("@/*", 0, "src/*"), ("@/*", 1, "lib//*")]
    assert [(r["path"], r["version"]) for r in extract.framework_versions(files, "tailwindcss").collect()] == [("packages/ui/package.json", "4.2.1")]
    assert [(r["path"], r["root_properties"]) for r in extract.root_properties(files).collect()] == [("a.css", 2)]
    assert {r["class"] for r in extract.class_words(files.where("path = 'b.tsx'")).collect()} == {"bg-muted", "p-4", "x"}
    heads = {r["line"]: (r["heading"], r["is_brand"]) for r in extract.identity_headings(files.where("path = 'a.css'")).collect()}
    assert heads[5] == ("Brand colors", True) and heads[9] == ("layout", False)
    rules = spark.createDataFrame([("vite", r"(^|/)vite\.config\.ts$", r"entry:\s*'([^']+)'")], "profile string, glob string, regex string")
    assert [(r["spec"], r["profile"]) for r in extract.registered_roots(files, rules).collect()] == [("src/main.ts", "vite")]


def test_graph_loops_have_no_bound_of_hops(spark):
    n = 70
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "src long, dst long")
    reached = graphs.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    files = spark.range(n + 1).withColumnRenamed("id", "node")
    assert {r["node"]: r["depth"] for r in reached.collect()} == {k: k for k in range(n + 1)}
    assert graphs.orphan_files(files, reached).count() == 0
    c = spark.createDataFrame([(k, "semantic" if k else "primitive", k - 1 if k else None) for k in range(n + 1)], "token long, tier string, alias_of long")
    assert {r["token"]: (r["length"], r["complete"]) for r in graphs.alias_chains(c).collect()} == {k: (k + 1, True) for k in range(n + 1)}
    uses = spark.createDataFrame([(n, "a"), (n - 1, "b")], "token long, component string")
    radius = {r["token"]: (r["dependents"], r["component_count"]) for r in graphs.blast_radius(c, uses).collect()}
    assert radius == {k: (n - k, min(2, n - k)) for k in range(n + 1)}


def test_patterns_cross_slashes_as_shell_patterns_do(spark):
    import fnmatch
    import re

    from gridloom.operators import discovery as d

    paths = ["apps/a.css", "apps/web/src/x.css", "apps/web/[x]/y.ts", "packages/ui", "packages/ui/y.css", "packages/ui2/y.css", "p?x/a", "abc/d", "a.css/b"]
    for pattern in ("apps/*.css", "*", "apps/*", "packages/ui?/*", "[ab]*", "[!ab]*", "apps/web/[[]x]/*", "a.css", "packages/ui"):
        for path in paths:
            want = fnmatch.fnmatchcase(path, pattern) or path.startswith(pattern.rstrip("/") + "/")
            assert bool(re.search(d.glob_regex(pattern), path)) == want, (pattern, path)
    for path in paths:
        assert bool(re.search(d.glob_regex("packages/ui/**"), path)) == (path == "packages/ui" or path.startswith("packages/ui/"))
        assert bool(re.search(d.glob_regex("p?x/**"), path)) == (path == "p?x/a")
    seen = spark.createDataFrame([(p,) for p in paths], "path string")
    assert d.matching(seen, spark.createDataFrame([(d.glob_regex("apps/*.css"),)], "regex string")).count() == 2


def test_path_leaks_of_either_kind(spark):
    from gridloom.operators import text

    pages = spark.createDataFrame([(1, r"at C:\Users\bob\x"), (2, "in /home/ann/y"), (3, "/Users/x"), (4, r"C:\Windows"), (5, None)], "page_id long, html string")
    assert sorted(r["page_id"] for r in text.path_leaks(pages).collect()) == [1, 2, 3]


def test_every_spacing_side_resolves(spark):
    from gridloom.operators import usage

    classes = spark.createDataFrame([(c,) for c in ("px-4", "mt-2", "w-4", "space-x-8", "max-w-lg", "p-3", "zz-4")], "class string")
    theme = spark.createDataFrame([("spacing", "", "0.25rem", "default"), ("container", "lg", "32rem", "default")], "namespace string, key string, value string, origin string")
    states = {r["class"]: r["state"] for r in usage.resolve_utilities(classes, usage.prefix_table(spark), theme).collect()}
    assert states == {"px-4": "resolved", "mt-2": "resolved", "w-4": "resolved", "space-x-8": "resolved", "max-w-lg": "resolved", "p-3": "resolved", "zz-4": "unresolved"}
