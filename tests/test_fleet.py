"""Operators over several repositories: theme scope, fonts, brand, walks, chains, ranks, guardrails, pages, rules, re-derivation."""

import hashlib
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators import evidence, extract, fonts, graphs, leaks, profiles, ranks, rederive, runs, tokens
from gridloom.operators import grades as g


def sheet(selector, names):
    return f"{selector} {{\n" + "".join(f"  --{n}: {x};\n" for n, x in names.items()) + "}\n"


#: A project of 21 tokens: names that repeat in a scheme, an override of a framework's name, variables with a projection, local state, injected and unscoped properties.
BASE = {
    "blue-500": "#2563eb", "blue-600": "#1d4ed8", "gray-100": "#f1f3f5", "gray-900": "#15161c", "space-1": "4px", "space-2": "8px", "space-4": "16px", "radius-md": "6px", "font-size-sm": "14px", "font-size-base": "16px", "line-height-base": "1.5",
    "duration-fast": "120ms", "unused-legacy-accent": "#ff00ff",
}
ALIASES = {"brand": "var(--blue-500)", "brand-strong": "var(--blue-600)", "surface": "var(--gray-100)", "text": "var(--gray-900)", "text-sm": "var(--font-size-sm)"}
PROJECT = {
    "app/globals.css": '@import "./theme.css";\n' + sheet("@theme", {"spacing": "0.25rem"}) + sheet(":root", BASE) + sheet(".theme-compact", {"spacing": "0.125rem"}) + sheet(".dark", {k: "#000000" for k in list(BASE)[:4]}) + "/* :root { --ghost: 1px; } */\n",
    "app/theme.css": sheet(":root", ALIASES) + sheet(".dark", ALIASES),
    "app/components.css": sheet(".panel", {"panel-gap": "12px"}) + '.badge::before { content: "} :root { --fake: 1"; }\n' + sheet(":root", {"radix-x": "1px"}),
    "styles/_primitives.scss": "$accent: #7c3aed;\n$accent-soft: #ede9fe;\n\n:root {\n  --accent: #{$accent};\n  --accent-soft: #{$accent-soft};\n}\n",
}


def test_a_project_of_21_tokens(spark):
    files = spark.createDataFrame([("a", p, c) for p, c in PROJECT.items()] + [("b", "x.css", ":root { --only: 1px }"), ("b", "y.css", None)], "repo_id string, path string, content string")
    decls = extract.scoped_declarations(files)
    found = {(r["repo_id"], r["token"]): r for r in tokens.theme_tokens(decls).collect()}
    assert len([k for k in found if k[0] == "a"]) == 21 and ("b", "only") in found
    assert found["a", "spacing"]["declarations"] == 2 and found["a", "accent"]["declarations"] == 2 and found["a", "brand"]["files"] == 1
    assert found["a", "blue-500"]["first_site"] == "app/globals.css:6"
    assert {(r["repo_id"], r["token"]) for r in tokens.scoped_properties(decls).collect()} == {("a", "panel-gap"), ("a", "radix-x")}


@pytest.mark.parametrize("scopes,inside", [
    ([":root"], True), (["html, .dark"], True), (['[data-theme="x"]'], True), ([":root.dark[data-theme=a]"], True), (["@theme inline"], True), (["@media (prefers-color-scheme: dark)"], True), (["@media (prefers-color-scheme: dark)", ":root"], True),
    (["@layer base", ":root"], True), (["@media (min-width: 40em)", ":root"], True), ([], False), ([".card"], False), ([":root .card"], False), ([":root", ".card"], False), ([".card", ":root"], False), (["@utility pad"], False), (["@property --x"], False),
    (["@media (min-width: 40em)"], False), ([".darkness"], False), (["html5"], False),
])
def test_theme_roots(spark, scopes, inside):
    (row,) = spark.createDataFrame([(scopes,)], "s array<string>").select(tokens.in_theme_root(F.col("s"))).collect()
    assert row[0] is inside


def test_enclosing_blocks():
    text = 'a { x: 1; } @media q { b { --p: "}{"; c: #{d}; --q: 1 } } --r: 2;'
    at = [text.index(n) for n in ("--p", "--q", "--r")]
    assert extract.enclosing_selectors(text, at) == [["@media q", "b"], ["@media q", "b"], []]


def test_font_files(spark):
    path = lambda p: spark.createDataFrame([(p,)], "p string").select(fonts.normal_path(F.col("p"))).first()[0]
    assert [path(p) for p in ("a/./b//c", "a/../b", "../x", "a/../../x", "a/b/../..")] == ["a/b/c", "b", "../x", "../x", ""]
    css = "/* @font-face { font-family: No; src: url(n.woff2) } */\n" + "\n".join(f"@font-face {{\n font-family: {f};\n src: url('{u}');\n}}" for f, u in [
        ('"Fixture Sans"', "./a.woff2?v=1"), ("Escape", "../../../../etc/b.woff2"), ("Remote", "https://x/y.woff2"), ("Data", "data:font/woff2;base64,xx"), ("serif", "./a.woff2"), ("Wrong", "/fonts/c.otf"), ("Gone", "./gone.ttf"), ("Big", "./big.ttf"), ("Empty", "./empty.woff"),
        ("Plug", "/plugins/p/d.woff"), ("fixture sans", "/e.woff2"), ("Two", "./f1.ttf"), ("Two", "./f2.ttf"), ("Odd", "./g.svg"),
    ])
    files = spark.createDataFrame([("a", "src/css/x.css", css), ("b", "src/css/x.css", css), ("b", "none.css", None)], "repo_id string, path string, content string")
    stored = {
        "src/css/a.woff2": b"wOF2aa", "public/a.woff2": b"wOF2other", "public/fonts/c.otf": b"%PDF", "src/css/big.ttf": b"true" + bytes(5 << 20), "src/css/empty.woff": b"", "plugins/p/assets/d.woff": b"wOFFd", "public/e.woff2": b"wOF2aa",
        "src/css/f1.ttf": b"\0\1\0\0one", "src/css/f2.ttf": b"truetwo", "src/css/g.svg": b"<svg",
    }
    assets = spark.createDataFrame([("a", p, bytearray(c)) for p, c in stored.items()], "repo_id string, path string, content binary")
    faces = fonts.face_blocks(files)
    rows = fonts.font_evidence(faces, assets).collect()
    got = {(r["repo_id"], r["family"], r["url"]): (r["state"], r["asset"], r["sha256"]) for r in rows}
    sha = lambda p: hashlib.sha256(stored[p]).hexdigest()
    assert got["a", "Fixture Sans", "./a.woff2?v=1"] == ("verified", "src/css/a.woff2", sha("src/css/a.woff2"))
    assert got["a", "Plug", "/plugins/p/d.woff"] == ("verified", "plugins/p/assets/d.woff", sha("plugins/p/assets/d.woff"))
    for family, url in (("Escape", "../../../../etc/b.woff2"), ("Remote", "https://x/y.woff2"), ("Gone", "./gone.ttf")):
        assert got["a", family, url] == ("not-visible", None, None)
    bad = {r["family"] for r in rows if r["reason"] is not None and r["repo_id"] == "a"}
    assert bad == {"Wrong", "Big", "Empty", "Odd"} and not any(f == "serif" or f == "No" for _, f, _ in got)
    assert {s[0] for k, s in got.items() if k[0] == "b"} == {"not-visible"}
    assert min(r["line"] for r in rows) == 2
    wanted = spark.createDataFrame([("a", f) for f in ("FIXTURE SANS", "Two", "Gone")], "repo_id string, family string")
    show = {r["family"]: (r["state"], r["asset"], r["assets"]) for r in fonts.font_specimens(wanted, fonts.font_evidence(faces, assets)).collect()}
    assert show == {"FIXTURE SANS": ("verified", "public/e.woff2", 1), "Two": ("not-visible", None, 2), "Gone": ("not-visible", None, 0)}


def test_brand_palette(spark):
    rows = [
        ("a", "--brand-acme", "#111111", None), ("a", "--brand-primary", "#222222", "Visual identity"), ("a", "--acme-logo", "#333333", "Acme brand"), ("a", "--acme-text", "#444444", "The brand"), ("a", "--github-brand", "#555555", None),
        ("a", "--brand-zeta", "#666666", None), ("a", "--brand-warm", "#777777", None), ("a", "--brand-warm", "#787878", None), ("a", "--brand-cool", "#abc", None), ("a", "--brand-cool", "#AABBCC", None), ("a", "--brand-data", "var(--x)", None),
        ("a", "--brand-space", "4px", None), ("b", "--brand-zeta", "#666666", None), ("b", "--brand-acme", "#111111", None), ("c", "--slack-brand", "#999999", None),
    ]
    decls = spark.createDataFrame([(r, "x.css", k, n, x, h) for k, (r, n, x, h) in enumerate(rows)], "repo_id string, path string, line int, name string, value string, label string")
    subjects = spark.createDataFrame([("a", "acme-hq"), ("b", "zeta"), ("c", "slack")], "repo_id string, namespace string")
    got = {(r["repo_id"], r["token"]): (r["state"], r["color"], r["confidence"].replace("explicit-brand-", ""), r["rank"]) for r in tokens.brand_colors(decls, subjects).collect()}
    assert got == {
        ("a", "brand-acme"): ("verified", "#111111", "token-name", 1), ("a", "brand-cool"): ("verified", "#AABBCC", "token-name", 2), ("a", "brand-primary"): ("verified", "#222222", "name-and-source-section", 3),
        ("a", "brand-warm"): ("conflict", None, "token-name", 4), ("a", "acme-logo"): ("verified", "#333333", "source-section", 5), ("b", "brand-zeta"): ("verified", "#666666", "token-name", 1), ("c", "slack-brand"): ("verified", "#999999", "token-name", 1),
    }


def bfs(edges, seeds, closed=()):
    depth, todo = {s: 0 for s in seeds}, deque(seeds)
    while todo:
        a = todo.popleft()
        for b in edges.get(a, ()) if a not in closed else ():
            if b not in depth:
                depth[b] = depth[a] + 1
                todo.append(b)
    return depth


def test_two_walks_in_one(spark):
    rng = random.Random(6)
    edges = [(r, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for r in "ab" for _ in range(45)] + [("b", "n0", "n0"), ("a", "n29", "n29")]
    strong, static = v.ROOT_RANK[2:], "static candidate"
    roots = [(r, f"n{k}", k % 11 != 0, "product" if k % 7 else "demo", static if k % 3 else rng.choice(strong), "owned" if rng.random() < 0.6 else "shared") for r in "ab" for k in rng.sample(range(30), 9)]
    closed = {(r, f"n{k}") for r in "ab" for k in (3, 8)}
    got = graphs.two_walks(
        spark.createDataFrame(edges, "repo_id string, src string, dst string"), spark.createDataFrame(roots, "repo_id string, path string, exists boolean, scope string, confidence string, ownership string"),
        spark.createDataFrame(sorted(closed), "repo_id string, node string"),
    )
    want = set()
    for r in "ab":
        out = defaultdict(set)
        for q, a, b in edges:
            if q == r:
                out[a].add(b)
        shut = {n for q, n in closed if q == r}
        own = [x for x in roots if x[0] == r and x[2] and x[3] == "product"]
        first = bfs(out, [x[1] for x in own if x[4] in strong], shut)
        second = bfs(out, [x[1] for x in own if x[5] == "owned" and (x[4] in strong or x[1] in first)], shut)
        want |= {(r, n, first.get(n), second.get(n)) for n in {*first, *second}}
    assert {tuple(x) for x in got.select("repo_id", "node", "product_depth", "owned_depth").collect()} == want
    surfaces = spark.createDataFrame([("a", "n1"), ("b", "n1"), ("a", "zz")], "repo_id string, path string")
    reached = {(r, n) for r, n, p, _ in want if p is not None}
    assert {tuple(x) for x in graphs.supplemental_surfaces(surfaces, got).collect()} == {("a", "n1"), ("b", "n1"), ("a", "zz")} - reached


def test_repositories_with_equal_paths_stay_apart(spark):
    edges = spark.createDataFrame([("a", "x", "y"), ("b", "y", "z")], "repo_id string, src string, dst string")
    seeds = spark.createDataFrame([("a", "x"), ("b", "x")], "repo_id string, node string")
    assert {(r["repo_id"], r["node"], r["depth"]) for r in graphs.reachable(edges, seeds).collect()} == {("a", "x", 0), ("a", "y", 1), ("b", "x", 0)}
    files = spark.createDataFrame([("a", "y"), ("b", "y")], "repo_id string, node string")
    assert [tuple(r) for r in graphs.orphan_files(files, graphs.reachable(edges, seeds)).collect()] == [("b", "y")]
    assert [(r["repo_id"], r["node"]) for r in graphs.missing_entries(seeds, files.union(spark.createDataFrame([("a", "x")], files.schema))).collect()] == [("b", "x")]
    orphans, prefixes = spark.createDataFrame([("a", "p/q.css"), ("a", "r.css"), ("b", "p/q.css")], "repo_id string, path string"), spark.createDataFrame([("a", "p")], "repo_id string, prefix string")
    assert {tuple(r) for r in graphs.orphan_scope(orphans, prefixes).collect()} == {("a", "p/q.css", "owned"), ("a", "r.css", "outside"), ("b", "p/q.css", "owned")}
    c = spark.createDataFrame([("a", "t", "semantic", "u"), ("a", "u", "primitive", None), ("b", "t", "semantic", "u")], "repo_id string, token string, tier string, alias_of string")
    assert {(r["repo_id"], r["token"]): (r["length"], r["complete"], r["note"]) for r in graphs.alias_chains(c).collect()} == {("a", "t"): (2, True, None), ("a", "u"): (1, True, None), ("b", "t"): (1, False, "not found")}
    roots = spark.createDataFrame([("a", "y", "static candidate"), ("b", "y", "static candidate")], "repo_id string, path string, confidence string")
    assert {r["repo_id"]: r["confidence"] for r in runs.promote_roots(roots, spark.createDataFrame([("a", "y")], "repo_id string, path string")).collect()} == {"a": "import-graph verified", "b": "static candidate"}


def walk(concepts, start):
    hops, at = [start], concepts[start][1]
    while at is not None and at not in hops and at in concepts:
        hops.append(at)
        at = concepts[at][1]
    note = None if at is None else "cycle" if at in hops else "not found"
    return hops, note is None and concepts[hops[-1]][0] == "primitive", at, note


def test_chains_double_their_pointers(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graphs, "staged", lambda df, real=graphs.staged: rounds.append(1) or real(df))
    line = {k: ("semantic" if k else "primitive", k - 1 if k else None) for k in range(1000)}
    df = lambda cs: spark.createDataFrame([(k, t, a) for k, (t, a) in cs.items()], "token long, tier string, alias_of long")
    assert {r["token"]: (r["length"], r["complete"]) for r in graphs.alias_chains(df(line)).collect()} == {k: (k + 1, True) for k in line}
    assert len(rounds) <= 12
    rng = random.Random(2)
    for _ in range(3):
        cs = {k: (rng.choice(["primitive", "semantic"]), rng.choice([None, *range(45)])) for k in range(40)} | {40: ("semantic", 40)}
        got = {r["token"]: (r["hops"], r["complete"], r["stops_at"], r["note"]) for r in graphs.alias_chains(df(cs)).collect()}
        assert got == {k: walk(cs, k) for k in cs}
        uses = [(rng.randrange(41), f"c{rng.randrange(6)}") for _ in range(60)]
        radius = {r["token"]: (r["dependents"], r["component_count"]) for r in graphs.blast_radius(df(cs), spark.createDataFrame(uses, "token long, component string")).collect()}
        below = {t: {k for k in cs if k != t and t in walk(cs, k)[0]} for t in cs}
        assert radius == {t: (len(b), len({c for u, c in uses if u in b})) for t, b in below.items()}


def test_places_without_a_window_of_everything(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(40), rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "repo_id string, id int, score int, n int").repartition(7)
    out = ranks.ranked(df, [F.desc("score"), "id"], running="n")
    got = {(r["repo_id"], r["id"]): (r["rank"], r["_before"], r["_total"]) for r in out.collect()}
    for repo in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == repo), key=lambda r: (-r[2], r[1]))
        for k, r in enumerate(own):
            assert got[repo, r[1]] == (k + 1, sum(x[3] for x in own[:k]), sum(x[3] for x in own))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    first = {(r["repo_id"], r["id"]): r["rank"] for r in ranks.first_ranks(df, [F.desc("score"), "id"], 5).collect()}
    assert first == {k: x[0] for k, x in got.items() if x[0] <= 5}
    assert ranks.ranked(df.drop("repo_id"), ["id"]).where("rank <> id + 1").count() == 0 and ranks.ranked(df.limit(0), ["id"]).count() == 0


def test_many_texts_in_one_pass(spark):
    rng = random.Random(7)
    needles = sorted({"".join(rng.choice("ab.$") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"Declaration-Strict", "declaration-strict-value", "a b", "x(y|z)*"})
    files = [(r, f"p{k}", "\n".join("".join(rng.choice("ab.$ A") for _ in range(14)) for _ in range(3)) + "\nuse DECLARATION-strict-values x(y|z)*") for k in range(12) for r in "pq"] + [("p", "none", None)]
    hits = evidence.needle_hits(spark.createDataFrame(files, "repo_id string, path string, content string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = {(r, p, k + 1, n.lower()) for r, p, c in files for k, line in enumerate((c or "").lower().split("\n")) for n in needles if n.lower() in line}
    rows = [tuple(r) for r in hits.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_enforcement(spark):
    files = spark.createDataFrame([("a", ".stylelintrc.json", "x\n'color-no-hex': true"), ("a", "pkg/package.json", "lint:tokens"), ("b", ".github/workflows/ci.yml", "run lint:tokens"), ("c", "readme.md", "color-no-hex"), ("c", "eslint.config.js", "semi")], "repo_id string, path string, content string")
    rules = spark.createDataFrame([("no-hex", "color-no-hex"), ("lint", "lint:tokens")], "rule string, needle string")
    found = evidence.enforcement_rules(files, rules)
    assert {(r["repo_id"], r["rule"]): r["evidence"] for r in found.collect()} == {("a", "no-hex"): ".stylelintrc.json:2", ("a", "lint"): "pkg/package.json:1", ("b", "lint"): ".github/workflows/ci.yml:1"}
    assert {r["repo_id"]: (r["rules"], r["grade"]) for r in evidence.enforcement(files.select("repo_id"), found).collect()} == {"a": (2, "healthy"), "b": (1, "watch"), "c": (0, "not-visible")}


def test_findings_and_pages(spark):
    a, b, c, d = (hashlib.sha1(x.encode()).hexdigest()[:12] for x in "abcd")
    findings = spark.createDataFrame([("r", a), ("r", b), ("r", "semver-2.0.0"), ("s", a)], "repo_id string, id string")
    pages = spark.createDataFrame([("r", f"<i id='{a}'> 0x{c}ff{d}0 {c}"), ("r", None), ("s", f"ff{a}ee 123456789012")], "repo_id string, html string")
    assert {tuple(r) for r in evidence.page_gaps(findings, pages).collect()} == {("r", b, "absent from the page"), ("r", c, "unknown to the data")}


def test_component_units(spark):
    files = [
        "src/components/card/index.tsx", "src/components/card/card.scss", "src/components/solo.tsx", "src/views/home.tsx", "src/views/home.scss", "src/views/about.tsx", "lib/u.ts", "lib/v.ts", "kit/x.ts", "kit2/x.ts",
    ]
    roots = [("lib", "runtime verified", "owned"), ("lib/v.ts", "framework-registered", "owned"), ("kit", "import-graph verified", "shared"), ("src/components/solo.tsx", "framework-registered", "owned"), ("src", "path-inferred", "owned"), ("kit2", "import-graph verified", "owned")]
    out = evidence.component_units(spark.createDataFrame([("a", f) for f in files] + [("b", "lib/u.ts")], "repo_id string, path string"), spark.createDataFrame([("a", *r) for r in roots], "repo_id string, prefix string, confidence string, ownership string"))
    got = {(r["repo_id"], r["key"]): (r["kind"], r["confidence"]) for r in out.collect()}
    assert got == {
        ("a", "src::card"): ("component", "co-named-source"), ("a", "src::solo"): ("component", "framework-registered"), ("a", "src::views/home"): ("component", "co-named-source"), ("a", "src::views/about"): ("surface", "path-inferred"),
        ("a", "lib::u"): ("component", "runtime verified"), ("a", "lib::v"): ("component", "runtime verified"), ("a", "kit::x"): ("surface", "path-inferred"), ("a", "kit2::x"): ("component", "import-graph verified"), ("b", "lib::u"): ("surface", "path-inferred"),
    }
    assert {c for _, c in got.values()} == set(v.COMPONENT_RANK)


def clean_tables():
    steps = [("r", k, c, "verified" if k < 6 else "not-visible", ["web"], "next", None if k < 6 else "no build") for k, c in enumerate(v.CAPABILITIES)]
    return {
        "profiles": ([("r", "web", "active", 0, "ad", "framework", "registered", "detected", ["p.json"]), ("r", "sass", "active", 1, "ad", "style", "registered", "user-selected", []), ("r", "vue", "candidate", 0, None, None, None, None, None)],
                     "repo_id string, profile string, part string, ord int, adapter string, kind string, confidence string, activation string, evidence array<string>"),
        "steps": (steps, "repo_id string, ord int, capability string, state string, contributors array<string>, next_step string, limitation string"),
        "capabilities": ([(s[0], s[2], s[3]) for s in steps], "repo_id string, capability string, state string"),
        "roots": ([("r", "a.ts", "product", "common", "owned", "framework-registered", "a.ts:1", ["web"], True, "product"), ("r", "b.ts", "candidate", "common", "owned", "static candidate", "b.ts:1", ["convention"], True, "product"),
                   ("r", "c.ts", "missing", "common", "owned", None, None, [], False, "product"), ("r", "lib", "component", None, "owned", "framework-registered", "x", ["web"], True, "product"), ("r", "d.ts", "surface", None, None, None, None, ["sass"], True, "demo")],
                  "repo_id string, path string, part string, root_type string, ownership string, confidence string, evidence string, profiles array<string>, exists boolean, scope string"),
        "reached": ([("r", "a.ts")], "repo_id string, node string"), "selection": ([("r", "selected")], "repo_id string, state string"),
        "states": ([("r", "color", "counted", 2), ("r", "motion", "none-used", 0)], "repo_id string, family string, state string, count long"), "concepts": ([("r", "x", "color"), ("r", "y", "color")], "repo_id string, token string, family string"),
        "runs": ([("r", 2)], "repo_id string, token_count long"),
    }


#: A change of one table and the rules that it breaks.
PLANTED = [
    ("profiles", lambda t: t + [(*t[0][:3], 2, *t[0][4:])], {"duplicated-active-profile"}), ("profiles", lambda t: t + [("r", "web", "candidate", 1, None, None, None, None, None)], {"active-and-candidate"}),
    ("profiles", lambda t: [t[0], (*t[1][:3], 4, *t[1][4:]), t[2]], {"profiles-out-of-order"}), ("profiles", lambda t: [(*t[0][:4], " ", *t[0][5:]), *t[1:]], {"profile-without-adapter-kind-or-confidence"}),
    ("profiles", lambda t: [(*t[0][:8], []), *t[1:]], {"detected-profile-without-evidence"}), ("steps", lambda t: [(t[0][0], 1, *t[0][2:]), (t[1][0], 0, *t[1][2:]), *t[2:]], {"ladder-out-of-order"}), ("steps", lambda t: t[:-1], {"ladder-steps-missing-or-duplicated"}),
    ("steps", lambda t: [(*t[0][:3], "not-visible", ["web"], "next", "why"), *t[1:]], {"ladder-state-disagrees"}), ("steps", lambda t: [(*t[0][:4], [], *t[0][5:]), *t[1:]], {"step-without-contributor"}), ("steps", lambda t: [(*t[0][:5], "", None), *t[1:]], {"step-without-next-step"}),
    ("steps", lambda t: [*t[:-1], (*t[-1][:6], None)], {"incomplete-step-without-limitation"}), ("roots", lambda t: [(*t[0][:7], ["other"], *t[0][8:]), *t[1:]], {"invalid-contributors"}), ("roots", lambda t: [(*t[0][:4], None, *t[0][5:]), *t[1:]], {"root-lacks-a-field"}),
    ("roots", lambda t: [(*t[0][:5], "sure", *t[0][6:]), *t[1:]], {"unknown-confidence"}), ("roots", lambda t: [t[0], (*t[1][:5], "runtime verified", *t[1][6:]), *t[2:]], {"candidate-is-no-static-candidate"}), ("reached", lambda t: t + [("r", "b.ts")], {"reachable-root-among-candidates"}),
    ("roots", lambda t: [*t[:2], (*t[2][:8], True, t[2][9]), *t[3:]], {"missing-root-exists"}), ("roots", lambda t: [*t[:3], (*t[3][:4], "unknown", *t[3][5:]), t[4]], {"component-root-not-owned"}), ("roots", lambda t: [*t[:4], (*t[4][:9], "product")], {"surface-out-of-scope"}),
    ("reached", lambda t: t + [("r", "d.ts")], {"surface-promoted-to-product"}), ("selection", lambda t: [("r", "maybe")], {"invalid-selection-state"}), ("selection", lambda t: [("r", "not-visible")], {"ambiguous-selection-did-not-block-roots", "ambiguous-selection-with-product-roots"}),
    ("concepts", lambda t: t + [t[0]], {"duplicate-concept", "family-count-disagrees", "token-count-disagrees"}), ("states", lambda t: [(*t[0][:3], 3), t[1]], {"family-count-disagrees"}), ("runs", lambda t: [("r", 5)], {"token-count-disagrees"}),
]


def test_each_profile_rule_breaks_on_its_planted_row(spark):
    """All changes at once, each in a repository of its own beside an untouched one."""
    base = clean_tables()
    rows = {name: list(t) for name, (t, _) in base.items()}
    for k, (name, change, _) in enumerate(PLANTED):
        for other, (t, _) in base.items():
            rows[other] += [(f"r{k}", *x[1:]) for x in (change(t) if other == name else t)]
    out = profiles.engine_rules(*[spark.createDataFrame(rows[n], base[n][1]) for n in ("profiles", "steps", "capabilities", "roots", "reached", "selection", "states", "concepts", "runs")])
    got = defaultdict(set)
    for r in out.collect():
        got[r["repo_id"]].add(r["rule"])
    assert dict(got) == {f"r{k}": rules for k, (_, _, rules) in enumerate(PLANTED)}


def test_discovery_mode_and_root_rules(spark):
    of = lambda df: {(r["repo_id"], r["rule"]) for r in df.collect()}
    run_rows = spark.createDataFrame([("a", None), ("b", "x"), ("c", None), ("d", None), ("e", None)], "repo_id string, detected_by string")
    sources, roots = spark.createDataFrame([("b", "1"), ("c", "1"), ("c", "2"), ("d", "1"), ("d", "2"), ("e", "1")], "repo_id string, path string"), spark.createDataFrame([("d", "r"), ("e", "r")], "repo_id string, path string")
    assert of(profiles.discovery_rules(run_rows, sources, roots)) == {("a", "no-token-source"), ("b", "one-source-without-roots"), ("c", "neither-detector-nor-roots")}
    graded = spark.createDataFrame([("a", "healthy"), ("b", "watch"), ("c", "not-visible"), ("d", "needs-work")], "repo_id string, grade string")
    audited, done = spark.createDataFrame([("a", "x", "dark"), ("a", "x", "light"), ("b", "x", "dark"), ("c", "x", "dark")], "repo_id string, bundle string, mode string"), spark.createDataFrame([("a", "x", "dark"), ("a", "x", "light")], "repo_id string, bundle string, mode string")
    assert of(profiles.mode_rules(graded, audited, done)) == {("b", "graded-without-output"), ("d", "graded-without-audited-pairs")}
    bad = spark.createDataFrame([("a", "p", "common", "p:1", "runtime verified", "owned"), ("b", "p", None, " ", "sure", None)], "repo_id string, path string, root_type string, evidence string, confidence string, ownership string")
    assert of(profiles.root_evidence_rules(bad)) == {("b", f"root-without-{x}") for x in ("type", "evidence", "ownership")} | {("b", "unknown-confidence")}


def test_nested_values_compare_by_path(spark):
    kind = "repo_id string, k int, s struct<a:int,b:array<struct<c:string,d:double>>>, m map<string,array<int>>, t string"
    row = lambda k, a=1, b=(("x", 1.5), ("y", None)), m=None, t="t": ("r", k, (a, None if b is None else list(b)), {"p": [1, 2]} if m is None else m, t)
    same = [row(0), row(1)]
    df = lambda rows: spark.createDataFrame(rows, kind)
    assert rederive.compare_nested(df(same), df(same), ["repo_id", "k"]).count() == 0
    recorded = [*same, row(2), row(3, a=7), row(4, b=(("x", 1.5), ("z", None))), row(5, b=()), row(6, m={"p": [1], "q": []}), row(7, t=None)]
    derived = [*same, row(3), row(4), row(5, b=None), row(6), row(7), row(8)]
    got = {(r["k"], r["path"], r["recorded"], r["derived"]) for r in rederive.compare_nested(df(recorded), df(derived), ["repo_id", "k"]).collect()}
    assert got == {
        (2, "", "row", None), (3, "s.a", "7", "1"), (4, "s.b[1].c", "z", "y"), (5, "s.b.size", "0", None), (6, "m.size", "2", "1"), (6, "m[p].size", "1", "2"), (6, "m[p][1]", None, "2"), (6, "m[q].size", "0", None), (7, "t", None, "t"), (8, "", None, "row"),
    }


def test_confidence_wins_moves_and_counters(spark):
    grades = spark.createDataFrame([("a", 0, "healthy"), ("a", 1, "needs-work"), ("a", 2, "not-needed"), ("a", 3, "not-needed"), ("a", 4, "watch"), ("a", 5, "needs-work"), ("a", 6, "not-visible")], "repo_id string, check_id int, grade string")
    caps = spark.createDataFrame([("a", 0, "not-visible"), ("a", 1, "verified"), ("a", 2, "verified"), ("a", 2, "not-visible"), ("a", 3, "verified")], "repo_id string, capability int, state string")
    notes = spark.createDataFrame([("a", 2, "no framework"), ("a", 0, "ignored")], "repo_id string, check_id int, note string")
    conf = g.check_confidence(grades, caps, notes)
    got = {r["check"]: (r["state"], r["blocked_by"], r["rationale"], r["decision_owed"]) for r in conf.collect()}
    assert len(got) == 8 and got["coverage"] == ("not-needed", "", "no framework", False) and got["mode-completeness"] == ("not-needed", "", None, True)
    assert got["orphans"] == ("not-visible", "import_resolution,ownership", None, False) and got["enforcement"] == ("not-visible", "detection", None, False) and got["tier-integrity"] == ("healthy", "", None, False)
    seen = spark.createDataFrame([("a", 1, "app.tsx"), ("a", 1, "b.tsx"), ("a", 3, None), ("a", 0, "x")], "repo_id string, capability int, evidence string")
    assert [tuple(r) for r in g.wins(caps, seen, conf).orderBy("ord").collect()] == [("a", 1, "Production roots verified", "app.tsx, b.tsx"), ("a", 6 + sorted(v.CHECKS).index("coverage") + 1, "coverage: not needed here", "no framework")]
    findings, roots = spark.createDataFrame([("a", "exact-value candidate"), ("a", "uncovered")], "repo_id string, tier string"), spark.createDataFrame([("a", "owned"), ("b", "unknown")], "repo_id string, ownership string")
    held = spark.createDataFrame([("a", "x.css"), ("a", "x.css"), ("a", "y.css")], "repo_id string, path string")
    moves = g.report_moves(grades, g.unlock_path(grades, caps), findings, roots, held, conf)
    order = [(r["kind"], r["what"], r["count"]) for r in evidence.move_order(moves).orderBy("rank").collect()]
    assert order == [("fix", "leakage", 1), ("fix", "single-source", 1), ("decide", "matching-colors", 1), ("decide", "held-out-sources", 2), ("decide", "reasons-owed", 1), ("unlock", "detection", 1), ("unlock", "import_resolution", 1)]
    assert [tuple(r) for r in g.counters(grades, moves).collect()] == [("a", 2, 3, 2)]


def test_small_summaries(spark):
    rows = lambda df: {tuple(r) for r in df.collect()}
    where = spark.createDataFrame([("a", "f", x) for x in ("p/q.css:3:7", "p/q.css:2", "p/q.css:20", "C:\\x", "r.css:1")], "repo_id string, id string, location string")
    assert rows(evidence.locations_by_file(where)) == {("a", "f", "p/q.css", 3, "p/q.css:2"), ("a", "f", None, 1, "C:\\x"), ("a", "f", "r.css", 1, "r.css:1")}
    cells = spark.createDataFrame([("a", "counted"), ("a", "odd"), ("a", None), ("b", "not-needed")], "repo_id string, state string")
    assert rows(evidence.state_counts(cells)) == {("a", 1, 2, 0), ("b", 0, 0, 1)}
    pairs = spark.createDataFrame([("a", "x", "dark"), ("a", "x", "light"), ("b", "x", "dark")], "repo_id string, bundle string, mode string")
    assert rows(evidence.pair_counts(pairs, pairs.where("mode = 'dark' and repo_id = 'a'"))) == {("a", 2, 1), ("b", 1, 0)}
    usage = spark.createDataFrame([("a", "c1", 6, 1), ("a", "c2", 3, 2), ("a", "c3", 1, 3), ("b", "c1", 4, 1)], "repo_id string, component string, references long, rank int")
    assert rows(evidence.top_share(usage, spark.createDataFrame([("a", 30), ("b", None)], "repo_id string, references long"), 2)) == {("a", 2, 9, 30, "all", 30.0), ("b", 1, 4, 4, "shown", 100.0)}
    kinds = spark.createDataFrame([("src/Mobile/x", None), ("src/x", "route"), ("admin/x", "strange"), ("x", None)], "p string, d string")
    assert [r[0] for r in kinds.select(evidence.root_type(F.col("p"), F.col("d"))).collect()] == ["mobile", "route", "admin", "common"]
    prose = lambda names: spark.createDataFrame(list(enumerate(names)), "ord int, family string")
    assert rows(evidence.taxonomy_drift(prose(["a", "c", "x"]), ["a", "b", "c"])) == {("b", "only in code"), ("x", "only in prose")}
    assert rows(evidence.taxonomy_drift(prose(["b", "a", "c"]), ["a", "b", "c"])) == {("a", "order differs"), ("b", "order differs")} and rows(evidence.taxonomy_drift(prose(v.FAMILIES))) == set()
    reached, sources = spark.createDataFrame([("a", "x.css"), ("a", "y.scss"), ("a", "z.ts"), ("b", "x.css")], "repo_id string, path string"), spark.createDataFrame([("a", "x.css", "canonical"), ("a", "y.scss", "candidate")], "repo_id string, path string, role string")
    assert rows(leaks.leak_scope(reached, sources)) == {("a", "y.scss"), ("b", "x.css")}
    decls = spark.createDataFrame([("a", "y.scss", "--radius-x", "1px"), ("a", "y.scss", "--radius-y", "1px"), ("a", "x.css", "--color-x", "#fff")], "repo_id string, path string, name string, value string")
    assert rows(tokens.held_out_families(decls, sources)) == {("a", "radius", 1)}
    js = "export const t = {\n  colorBrand: palette.blue[500],\n  radius: base(4),\n  gap: '4px', // space: x\n  on: true,\n  /* shadow: y, */\n}\n"
    files = spark.createDataFrame([("a", "t.ts", js), ("a", "t.css", js), ("a", "u.ts", None)], "repo_id string, path string, content string")
    assert {(r["path"], r["name"], r["family"]) for r in extract.unreadable_names(files).collect()} == {("t.ts", "colorBrand", "color"), ("t.ts", "radius", "radius")}
    order = spark.createDataFrame([("a", "dimension", "1px", 9), ("a", "other", "x", 99), ("a", "color", "#2", 1), ("a", "color", "#1", 1), ("a", "motion", "1s", 5)], "repo_id string, category string, literal string, files int")
    assert [r["literal"] for r in leaks.consequence_order(order).orderBy("rank").collect()] == ["#1", "#2", "1s", "1px", "x"]
    out = g.success_metrics(reached, pairs, usage.where("repo_id = 'a'"), spark.createDataFrame([("a", 0), ("b", None)], "repo_id string, redundant long"), spark.createDataFrame([("a", "verified", "not-visible")], "repo_id string, typography string, brand string"))
    assert {(r["repo_id"], r["metric"]): r["baseline"] for r in out.collect()} == {
        ("a", "source-consolidation"): "3", ("b", "source-consolidation"): "1", ("a", "mode-proof"): "2", ("b", "mode-proof"): "1", ("a", "component-adoption"): "3", ("b", "component-adoption"): "not-visible",
        ("a", "verified-leakage"): "0", ("b", "verified-leakage"): "not-visible", ("a", "identity-integrity"): "verified / not-visible", ("b", "identity-integrity"): "not-visible / not-visible",
    }
    assert Counter(r["reason"] for r in graphs.missing_entries(spark.createDataFrame([("gone",)], "node string"), spark.createDataFrame([("x",)], "node string")).collect()) == {v.UNRESOLVED_REASONS[0]: 1}


def test_near_colors_are_found_within_few_candidates(spark):
    """Against all pairs: random colors, and neighbours of saturated blues, grays and others; candidates are a tenth of those in cells of lightness."""
    from gridloom.functions import scalars as s

    rng = random.Random(9)
    hexed = lambda r, g, b: f"#{r:02x}{g:02x}{b:02x}"
    some = lambda: tuple(rng.randrange(256) for _ in range(3))
    tokens_ = [some() for _ in range(150)] + [(rng.randrange(60), rng.randrange(60), rng.randrange(180, 256)) for _ in range(60)] + [(g, g, g) for g in range(0, 256, 17)]
    lits = [some() for _ in range(150)] + [tuple(min(255, max(0, c + rng.randint(-14, 14))) for c in rng.choice(tokens_)) for _ in range(500)]
    df = lambda rows, c: s.with_lab(spark.createDataFrame(sorted({(hexed(*x),) for x in rows}), f"{c} string"), c, "_lab")
    left, right = df(lits, "literal").withColumn("repo_id", F.lit("a")), df(tokens_, "value").withColumnRenamed("_lab", "_q").withColumn("repo_id", F.lit("a"))
    whole = s.with_delta_e(left.drop("repo_id").crossJoin(right), "_lab", "_q", "de").where("de < 3").select("literal", "value")
    met = leaks.color_candidates(left, right, 3.0).select("literal", "value")
    want, got = {tuple(r) for r in whole.collect()}, [tuple(r) for r in met.collect()]
    assert len(want) > 300 and want <= set(got) and len(got) == len(set(got))
    even = lambda rows: df([some() for _ in range(rows)], "x")
    a, b = even(400).withColumnRenamed("x", "literal").withColumn("repo_id", F.lit("a")), even(400).withColumnRenamed("x", "value").withColumnRenamed("_lab", "_q").withColumn("repo_id", F.lit("a"))
    by_lightness = a.select(F.floor(F.col("_lab.l") / 5.25).alias("k")).join(b.select(F.explode(F.array(*[F.floor(F.col("_q.l") / 5.25) + d for d in (-1, 0, 1)])).alias("k")), "k").count()
    assert leaks.color_candidates(a, b, 3.0).count() < by_lightness / 10


def test_keys_in_usage_grades_and_runs(spark):
    from gridloom.operators import usage

    rows = lambda df: {tuple(r) for r in df.collect()}
    refs = spark.createDataFrame([("a", "x.css", "t", "css"), ("b", "x.css", "t", "css"), ("b", "d.css", "t", "css")], "repo_id string, path string, token string, syntax string")
    concepts, definitions = spark.createDataFrame([("a", "t", "color"), ("b", "t", "motion")], "repo_id string, token string, family string"), spark.createDataFrame([("b", "d.css"), ("a", "other.css")], "repo_id string, path string")
    assert {(r["repo_id"], r["family"]) for r in usage.known_refs(refs, concepts, definitions).collect()} == {("a", "color"), ("b", "motion")}
    theme = lambda xs: spark.createDataFrame(xs, "repo_id string, namespace string, key string, value string")
    merged = usage.merge_theme(theme([("a", "color", "red", "1"), ("b", "color", "red", "1")]), theme([("b", "color", "red", "2"), ("b", "spacing", "", "4px")]))
    assert rows(merged) == {("a", "color", "red", "1", "default"), ("b", "color", "red", "2", "project"), ("b", "spacing", "", "4px", "project")}
    classes = spark.createDataFrame([("a", "p-4"), ("b", "p-4"), ("a", "bg-red")], "repo_id string, class string")
    assert {(r["repo_id"], r["class"], r["state"]) for r in usage.resolve_utilities(classes, usage.prefix_table(spark), merged).collect()} == {("a", "p-4", "unresolved"), ("b", "p-4", "resolved"), ("a", "bg-red", "resolved")}
    modes = spark.createDataFrame([("a", "t", "color", "dark"), ("a", "u", "color", "light"), ("b", "t", "color", "dark")], "repo_id string, token string, family string, mode string")
    assert rows(g.mode_gaps(modes)) == {("a", "t", "color", "light"), ("a", "u", "color", "dark")}
    pairs = spark.createDataFrame([("a", "x", "dark"), ("b", "y", "light")], "repo_id string, bundle string, mode string")
    families, cells = spark.createDataFrame([("color",)], "family string"), spark.createDataFrame([("a", "x", "dark", "color", "counted")], "repo_id string, bundle string, mode string, family string, state string")
    assert rows(g.coverage_matrix(pairs, pairs, families, cells)) == {("a", "x", "dark", "color", "counted"), ("b", "y", "light", "color", "not-visible")}
    assert rows(g.unresolved_pairs(pairs, pairs.where("repo_id = 'a'"))) == {("b", "y", "light")}
    found = lambda xs: spark.createDataFrame(xs, "repo_id string, id string, occurrences int")
    diff = runs.trend_diff(found([("a", "f", 1), ("b", "f", 5)]), found([("a", "f", 3), ("c", "f", 1)]))
    assert rows(diff) == {("a", "f", "grew", 1, 3), ("b", "f", "resolved", 5, None), ("c", "f", "new", None, 1)}
    assert rows(runs.regressions(diff, found([("c", "f", 0)]))) == {("a", "f", "grew"), ("c", "f", "returned")}
    one, two = (spark.createDataFrame([("a", k, x) for k, x in enumerate(xs)], "repo_id string, check_id int, grade string") for xs in (["healthy"] * 8, ["healthy"] * 6))
    assert rows(runs.grades_agreed(one, two)) == {("a", 6, 8)}
    signals = spark.createDataFrame([("vite", 0, "VITE", True, 1), ("vite", 1, "react", False, 1), ("next", 0, "next", True, 9), ("next", 1, "none", False, 9)], "profile string, signal int, needle string, required boolean, priority int")
    files = spark.createDataFrame([("a", "p.json", "vite react"), ("b", "p.json", "next"), ("b", "q.json", "Vite")], "repo_id string, path string, content string")
    scored = runs.score_profiles(runs.match_signals(files, signals), signals)
    assert {(r["repo_id"], r["profile"], r["score"], r["active"], r["rank"]) for r in scored.collect()} == {("a", "vite", 1.0, True, 1), ("a", "next", 0.0, False, 2), ("b", "next", 0.5, False, 1), ("b", "vite", 0.5, False, 2)}


def test_capabilities_and_paths_that_count(spark):
    from gridloom.operators import discovery

    repo = lambda *xs: spark.createDataFrame([(x,) for x in xs], "repo_id string")
    roots = spark.createDataFrame([("a", True, "product", "framework-registered", "owned"), ("b", True, "product", "runtime verified", "shared"), ("b", False, "product", "framework-registered", "owned"), ("c", True, "product", "static candidate", "owned")], "repo_id string, exists boolean, scope string, confidence string, ownership string")
    out = discovery.capability_states(repo("a", "b", "c"), repo("a").withColumn("part", F.lit("active")), roots, repo("a", "b"), repo("b").withColumn("reason", F.lit("dynamic runtime import")).union(repo("a").withColumn("reason", F.lit("external package"))))
    proven = defaultdict(set)
    for r in out.collect():
        proven[r["repo_id"]] |= {r["capability"]} if r["state"] == "verified" else set()
    assert dict(proven) == {"a": {"detection", "production_roots", "import_resolution", "ownership"}, "b": set(), "c": set()} and out.count() == 21
    paths = spark.createDataFrame([(p,) for p in ("src/a.css", "src/__fixtures__/b.css", "lib/generated/c.css", "lib/d.css", "tests/e.css")], "path string")
    assert {r["path"] for r in discovery.orphan_candidates(paths).collect()} == {"src/a.css", "lib/d.css"}
    assert {r["path"] for r in discovery.orphan_candidates(paths, spark.createDataFrame([(discovery.glob_regex("src/**"),)], "regex string")).collect()} == {"src/a.css"}
    kept = lambda parts: {r["path"] for r in paths.where(extract.not_excluded(F.col("path"), parts)).collect()}
    assert kept(extract.EXCLUDED) == {"src/a.css", "src/__fixtures__/b.css", "lib/generated/c.css", "lib/d.css"} and kept(extract.ORPHAN_EXCLUDED) == {"src/a.css", "lib/d.css"}
    many = spark.range(10_050).selectExpr("concat('^dir', id, '(?:/.*)?$') as regex").union(spark.createDataFrame([(discovery.glob_regex("src/**"),)], "regex string"))
    assert sorted(r["path"] for r in discovery.matching(paths, many).select("path").collect()) == ["src/__fixtures__/b.css", "src/a.css"]
    assert "Cartesian" not in discovery.matching(paths, many)._jdf.queryExecution().executedPlan().toString()


duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [
    "theme_tokens", "font_evidence", "font_specimens", "brand_colors", "identity_drift", "two_walks", "enforcement_rules", "page_gaps", "component_units", "profile_rules", "check_confidence", "report_moves", "alias_chains", "contrast_pairs",
    "import_edges", "unresolved_imports", "declared_tokens", "hex_literals", "spec_rewrites", "sibling_sources", "mode_rules", "leak_ranks", "measured_grades",
])
def test_against_sql(spark, base, name):
    from gridloom import plans

    want = base.execute(plans.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(r) for r in got.select(columns).collect()), key=str)
    assert rows and rows == sorted(want.fetchall(), key=str)


def test_measures_of_the_checks(spark):
    from gridloom.operators import measures as m

    one = lambda df: {r["repo_id"]: (r["grade"], r["measure"], r["evidence"]) for r in df.collect()}
    repos = spark.createDataFrame([(x,) for x in "abc"], "repo_id string")
    styles = spark.createDataFrame([("a", f"s{k}.css") for k in range(40)] + [("b", "s.css"), ("c", "s.css")], "repo_id string, path string")
    concepts = spark.createDataFrame([("a", "blue-500", "primitive", None, "#00F"), ("a", "brand", "semantic", "blue-500", "var(--blue-500)"), ("a", "gray", "primitive", None, "#888888"), ("b", "blue-500", "primitive", None, "#0000ff"), ("b", "brand", "semantic", "blue-500", "")], "repo_id string, token string, tier string, alias_of string, value string")
    refs = spark.createDataFrame([("a", "s1.css", 9, "blue-500"), ("a", "s1.css", 3, "blue-500"), ("a", "s2.css", 1, "gray"), ("a", "lib.ts", 1, "blue-500"), ("c", "s.css", 1, "blue-500")], "repo_id string, path string, line int, token string")
    raw = spark.createDataFrame([("a", "s0.css", 4, "#0000FF"), ("b", "s.css", 7, "#00f")], "repo_id string, path string, line int, literal string")
    assert one(m.tier_integrity(styles, refs, raw, concepts)) == {"a": ("watch", 2, "s0.css:4"), "b": ("needs-work", 1, "s.css:7"), "c": ("healthy", 0, None)}
    found = spark.createDataFrame([("a", "redundant", "8px", "space-2", "x.css", 2), ("a", "redundant", "8px", "space-2", "x.css", 1), ("a", "uncovered", "9px", None, "x.css", 1), ("c", "redundant", "1", "t", "x.css", 1)], "repo_id string, tier string, literal string, token string, path string, line int")
    assert one(m.leakage(repos, found, repos.where("repo_id <> 'c'"))) == {"a": ("watch", 1, "x.css:1"), "b": ("healthy", 0, None), "c": ("not-visible", None, None)}
    declared = spark.createDataFrame([("a", f) for f in m.CATEGORIES[:9]] + [("a", "focus"), ("b", "color"), ("c", "color")], "repo_id string, family string")
    default = spark.createDataFrame([("a", "opacity", "4.1"), ("a", "color", "4.1"), ("b", "opacity", None)], "repo_id string, family string, version string")
    gaps = spark.createDataFrame([("a", "breakpoint", "q.css", 5), ("a", "color", "a.css", 1), ("b", "motion", "q.css", 1)], "repo_id string, family string, path string, line int")
    assert one(m.coverage(repos, declared, default, gaps)) == {"a": ("watch", 10, "q.css:5"), "b": ("not-visible", None, None), "c": ("not-visible", 1, None)}
    modes = spark.createDataFrame([("a", "dark"), ("b", "dark")], "repo_id string, mode string")
    lacking, pairs = spark.createDataFrame([("a", "t", "dark", "t.css", 2)], "repo_id string, token string, mode string, path string, line int"), spark.createDataFrame([("b", "main", "dark")], "repo_id string, bundle string, mode string")
    assert one(m.mode_completeness(repos, modes, lacking, pairs, pairs.limit(0))) == {"a": ("needs-work", 1, "t.css:2"), "b": ("not-visible", None, None), "c": ("not-needed", None, None)}
    decls = spark.createDataFrame([("a", "x.css", 1, "--t", "1"), ("a", "y.css", 2, "--t", "2"), ("a", "x.css", 3, "--u", "1"), ("a", "w.css", 4, "--u", "1"), ("b", "x.css", 1, "--t", "1"), ("b", "y.css", 1, "--t", "1"), ("c", "x.css", 1, "--t", "1")], "repo_id string, path string, line int, name string, value string")
    assert one(m.single_source(decls)) == {"a": ("needs-work", 2, "x.css:1"), "b": ("watch", 1, "x.css:1"), "c": ("healthy", 0, None)}
    names = tokens.naming_grammars(spark.createDataFrame([("a", "css", "a-b", "p", 1), ("a", "css", "a_b", "p", 2), ("a", "scss", "aB", "p", 3), ("b", "css", "ab", "p", 1), ("b", "scss", "aB", "q", 1)], "repo_id string, representation string, name string, path string, line int"))
    assert {k: x[:2] for k, x in one(m.naming_coherence(names)).items()} == {"a": ("watch", 2), "b": ("healthy", 1)}
    own = spark.createDataFrame([("a", f"t{k}", "t.css", k) for k in range(100)] + [("b", "t1", "t.css", 1)], "repo_id string, token string, path string, line int")
    used = own.where("token <> 't7'").select("repo_id", "token").union(spark.createDataFrame([("b", "t7")], "repo_id string, token string"))
    assert one(m.orphans(own, used)) == {"a": ("healthy", 1, "t.css:7"), "b": ("healthy", 0, None)}
    rows = m.all_grades(single_source=m.single_source(decls), orphans=m.orphans(own, used)).collect()
    assert {(r["check"], r["check_id"]) for r in rows} == {("single-source", 5), ("orphans", 6)} and len(rows) == 5
