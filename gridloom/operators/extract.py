"""File text to rows: declarations, references, imports, fonts, themes. Each is one distributed job over files (repo_id, path, content)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as s

STYLE = [".css", ".scss", ".sass", ".less"]
MODULE = [".js", ".jsx", ".ts", ".tsx", ".gjs", ".gts", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".html", ".htm", ".hbs", ".erb"]
#: Files that end a chain of imports and are named in full.
ASSET = [
    ".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".ico", ".bmp", ".mp4", ".webm", ".mov", ".m4v", ".ogv", ".mp3", ".wav", ".ogg", ".m4a", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".pdf", ".txt", ".md", ".wasm",
]
#: Extensions that a script import may leave out, in the order in which they are tried.
TRIED = [".ts", ".tsx", ".js", ".jsx", ".gjs", ".gts", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".css", ".scss", ".sass", ".less", ".json"]
#: Directories that are no source at any depth, and those that are none at the root only.
IGNORED = [
    "node_modules", ".git", "dist", "build", ".next", "out", "coverage", "tmp", ".turbo", ".cache", ".worktrees", "test-results", "playwright-report", "storybook-static", ".svelte-kit", ".nuxt", ".output",
    ".astro", ".vercel", ".netlify", ".parcel-cache", ".yarn", "__pycache__", ".venv", "venv",
]
ROOT_IGNORED = ["vendor", "third_party", "worktrees", "target"]
#: Parts of paths whose files are not analysed, whose style sheets are no orphans, and in which no profile is sought.
EXCLUDED = [".git", "node_modules", "vendor", "dist", "build", "coverage", "tmp", "test", "tests", "spec", "specs", "fixtures", "snapshots"]
ORPHAN_EXCLUDED = ["test", "tests", "spec", "specs", "fixtures", "snapshots", "__fixtures__", "generated"]
PROFILE_EXCLUDED = [".git", ".next", ".nuxt", ".svelte-kit", "node_modules", "vendor", "dist", "build", "out", "coverage", "tmp", ".turbo", ".cache", "test", "tests", "spec", "specs", "fixtures", "snapshots"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def scan_corpus(files: DataFrame) -> DataFrame:
    """files without ignored directories; only path is looked at, so content is read for what stays."""
    dirs = F.expr("slice(split(path, '/'), 1, size(split(path, '/')) - 1)")
    bad = F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in IGNORED])) | F.coalesce(F.get(dirs, F.lit(0)).isin(*ROOT_IGNORED), F.lit(False))
    return files.where(~bad)


def file_class(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*STYLE), "style").when(ext.isin(*MODULE), "module").when(ext == ".json", "source").otherwise("asset")


def not_excluded(path: Column, parts: list[str] = EXCLUDED) -> Column:
    """Whether no part of a path is one of parts."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in parts]))


def line_of(content: Column, offset: Column) -> Column:
    return F.length(F.regexp_replace(F.substring(content, F.lit(1), offset), "[^\n]", "")) + 1


def blank_comments(text: str) -> str:
    """Comments as spaces with their line breaks; quotes shield, and // after a colon is an address."""
    out, i, quote = [], 0, ""
    while i < len(text):
        two = text[i : i + 2]
        if quote:
            out.append(text[i])
            if text[i] == "\\":
                out.append(text[i + 1 : i + 2])
                i += 1
            elif text[i] == quote:
                quote = ""
            i += 1
            continue
        end = None
        if two == "/*":
            end = text.find("*/", i + 2) + 2
        elif text.startswith("<!--", i):
            end = text.find("-->", i + 4) + 3
        elif two == "//" and text[i - 1 : i] != ":":
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
        if end is not None:
            end = len(text) if end < i + 2 else end
            out.append(re.sub(r"[^\n]", " ", text[i:end]))
            i = end
            continue
        if text[i] in "\"'`":
            quote = text[i]
        out.append(text[i])
        i += 1
    return "".join(out)


_CSS = re.compile(r"(?m)(?:^|[;{])[ \t]*(--[a-zA-Z0-9_-]+)\s*:\s*")
_SCSS = re.compile(r"(?m)^\s*(\$[a-zA-Z0-9_-]+)\s*:\s*([^;\n(]+?)(?:\s*!default)?\s*;")
_MAP, _BRANCH, _LEAF = re.compile(r"^\s*\$([a-zA-Z0-9_-]+)\s*:\s*\(\s*$"), re.compile(r"^\s*['\"]?([a-zA-Z0-9_-]+)['\"]?\s*:\s*\(\s*$"), re.compile(r"^\s*['\"]?([a-zA-Z0-9_-]+)['\"]?\s*:\s*([^,()]+),?\s*$")

Row = tuple[str, str, str, int]


def css_declarations(text: str) -> Iterator[Row]:
    """Custom properties; a value ends at ; or } outside of brackets and quotes, on whatever line."""
    for m in _CSS.finditer(text):
        depth, quote, i = 0, "", m.end()
        while i < len(text):
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]" or c == "}" and depth:
                depth -= 1
            elif c in ";}" and depth <= 0:
                break
            i += 1
        if value := " ".join(text[m.end() : i].split()):
            yield m[1], value, "css-custom-property", m.start(1)


_BRACES = re.compile(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\#\{[^}]*\}|[{};]""")


def enclosing_selectors(text: str, offsets: list[int]) -> list[list[str] | None]:
    """For each of ascending offsets, the selectors and at-rules whose blocks hold it, outermost first; None within quotes or #{}.

    One pass with a stack of open blocks; braces in quotes and #{} make none. text is without comments.
    """
    out: list[list[str] | None] = []
    stack: list[str] = []
    start, k = 0, 0
    for m in _BRACES.finditer(text):
        while k < len(offsets) and offsets[k] < m.start():
            out.append(list(stack))
            k += 1
        while k < len(offsets) and offsets[k] < m.end():
            out.append(None)
            k += 1
        if m[0] == "{":
            stack.append(" ".join(text[start : m.start()].split()))
        elif m[0] == "}" and stack:
            stack.pop()
        if m[0] in "{};":
            start = m.end()
    return out + [list(stack) for _ in offsets[k:]]


def scss_declarations(text: str) -> Iterator[Row]:
    for m in _SCSS.finditer(text):
        yield m[1], m[2].strip(), "scss-variable", m.start(1)
    stack, at = [], 0
    for line in text.split("\n"):
        if m := _MAP.match(line):
            stack = [m[1]]
        elif stack and (m := _BRANCH.match(line)):
            stack.append(m[1])
        elif stack and (m := _LEAF.match(line)):
            yield "$" + ".".join([*stack, m[1]]), m[2].strip(), "scss-map-entry", at + m.start(1)
        elif stack and line.strip().startswith(")"):
            stack.pop()
        at += len(line) + 1


def json_declarations(text: str) -> Iterator[Row]:
    """Leaves with $value or value, joined by dots; nothing below a leaf."""
    try:
        tree = json.loads(text)
    except ValueError:
        return
    todo = [((), tree)]
    while todo:
        path, node = todo.pop()
        if not isinstance(node, dict):
            continue
        for key, kind in (("$value", "dtcg-json"), ("value", "style-dictionary-json")):
            if key in node and not isinstance(node[key], dict) and path:
                yield ".".join(path), node[key] if isinstance(node[key], str) else json.dumps(node[key]), kind, 0
                break
        else:
            todo += [((*path, k), child) for k, child in reversed(node.items()) if not k.startswith("$")]


_OPEN = re.compile(r"^(\s*)(?:export\s+)?(?:const\s+|let\s+|var\s+)?['\"]?([\w$-]+)['\"]?\s*(?::[^=]*?)?[:=]\s*(?:[\w.]+\()?\{\s*$")
_ENTRY = re.compile(r"^(\s*)['\"]?([\w$-]+)['\"]?\s*:\s*(['\"]?)([^'\"{}]+?)\3\s*,?\s*$")


def js_declarations(text: str) -> Iterator[Row]:
    """Entries of object literals by indentation; --x keys stay global."""
    stack: list[tuple[int, str]] = []
    at = 0
    for line in text.split("\n"):
        if m := _OPEN.match(line):
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2])]
        elif m := _ENTRY.match(line):
            path = [x[1] for x in stack if x[0] < len(m[1])]
            if path and (m[3] or re.match(r"-?[\d.]", m[4])):
                yield m[2] if m[2].startswith("--") else ".".join([*path, m[2]]), m[4].strip(), "js-theme-object", at + m.start(2)
        at += len(line) + 1


def declarations_in(path: str, text: str) -> list[dict]:
    ext = "." + path.rsplit(".", 1)[-1].lower()
    if ext == ".json":
        rows = json_declarations(text)
    elif ext in STYLE or ext in (".vue", ".svelte", ".html"):
        clean = blank_comments(text)
        rows = [*css_declarations(clean), *scss_declarations(clean)]
    elif ext in MODULE:
        rows = js_declarations(blank_comments(text))
    else:
        rows = []
    return [{"name": n, "value": v, "representation": r, "offset": o, "line": text.count("\n", 0, o) + 1} for n, v, r, o in rows]


def _scanned(files: DataFrame, scanner: Callable[[str, str], list[dict]], fields: str) -> DataFrame:
    """One Arrow UDF a job: a file row in, its rows out, exploded with their order."""

    @F.pandas_udf(f"array<struct<{fields}>>")
    def scan(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([scanner(p, c or "") for p, c in zip(path, content, strict=True)])

    return files.select("repo_id", "path", F.posexplode(scan("path", "content")).alias("ord", "r")).select("repo_id", "path", "ord", "r.*")


def declarations(files: DataFrame) -> DataFrame:
    """(repo_id, path, ord, name, value, representation, offset, line), in the reading order of each file."""
    return _scanned(files, declarations_in, "name:string,value:string,representation:string,offset:int,line:int")


def scoped_in(path: str, text: str) -> list[dict]:
    """Style declarations of a file with the blocks that they stand in."""
    if not path.lower().endswith((*STYLE, ".vue", ".svelte", ".html")):
        return []
    clean = blank_comments(text)
    rows = sorted([*css_declarations(clean), *scss_declarations(clean)], key=lambda r: r[3])
    scopes = enclosing_selectors(clean, [r[3] for r in rows])
    return [{"name": n, "value": v, "representation": r, "line": clean.count("\n", 0, o) + 1, "scopes": at} for (n, v, r, o), at in zip(rows, scopes, strict=True) if at is not None]


def scoped_declarations(files: DataFrame) -> DataFrame:
    """(repo_id, path, ord, name, value, representation, line, scopes) of style files; scopes are the enclosing blocks, outermost first."""
    return _scanned(files, scoped_in, "name:string,value:string,representation:string,line:int,scopes:array<string>")


_JS = re.compile(r"""(?m)^\s*(?:import|export)\s+(?:[^\n\r'";]*?\s+from\s+)?(['"])([^'"]+)\1""")
_CALL = re.compile(r"""\b(import|require)\s*\(\s*(?:(['"])([^'"]+)\2\s*\)|([^)'"][^)]*)\))""")


def imports_in(path: str, text: str) -> list[dict]:
    """Import records of a file, each (spec, kind) once in first-seen order; import(expression) is <dynamic:expression>."""
    ext, clean, out = "." + path.rsplit(".", 1)[-1].lower(), blank_comments(text), []
    if ext in STYLE or ext in (".vue", ".svelte"):
        out += [(m[2] or m[4], "style") for m in re.finditer(r"""(?m)^\s*@(?:import|use|forward)\s+(?:(['"])([^'"]+)\1|url\(\s*(['"]?)([^'")]+)\3\s*\))""", clean)]
    if ext in MODULE:
        out += [(m[2], "module") for m in _JS.finditer(clean)]
        out += [(m[3] or f"<dynamic:{m[4].strip()}>", "call") for m in _CALL.finditer(clean) if m[3] or m[1] == "import"]
        out += [(q, "style") for m in re.finditer(r"""\bstyleUrls?\s*:\s*(\[[^\]]*\]|['"][^'"]+['"])""", clean) for q in re.findall(r"""['"]([^'"]+)['"]""", m[1])]
    if ext in (".html", ".vue", ".svelte"):
        out += [(m[2], "script") for m in re.finditer(r"""(?i)<(?:script|style)\b[^>]*?src\s*=\s*(['"])([^'"]+)\1""", text)]
        for m in re.finditer(r"(?i)<link\b([^>]*)>", text):
            attrs = {a.lower(): v for a, _, v in re.findall(r"""([a-zA-Z:-]+)\s*=\s*(['"])([^'"]+)\2""", m[1])}
            if "href" in attrs and ("stylesheet" in attrs.get("rel", "") or attrs.get("as") == "style" or attrs.get("type") == "text/css" or attrs["href"].split("?")[0].endswith(tuple(STYLE))):
                out.append((attrs["href"], "link"))
    out += [(m[2], "tree" if m[1].endswith(("tree", "directory")) else "module") for m in re.finditer(r"(?m)^\s*(?://|/?\*+)?\s*=\s*(require_tree|require|link_tree|link_directory|link)\s+([^\s*]+)", text)]
    return [{"spec": a, "kind": b} for a, b in dict.fromkeys(out) if a]


def imports(files: DataFrame) -> DataFrame:
    return _scanned(files, imports_in, "spec:string,kind:string")


def references(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, token, syntax): var(--x) and $x, without the left side of a declaration."""
    blank = F.pandas_udf(lambda c: c.map(lambda t: blank_comments(t or "")), "string")
    lines = files.select("repo_id", "path", F.posexplode(F.split(blank("content"), "\n", -1)).alias("k", "text"))
    use = F.regexp_replace("text", r"^\s*\$[a-zA-Z0-9_-]+\s*:", " ")
    found = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(r"var\(\s*--([a-zA-Z0-9_-]+)"), 1), lambda x: F.struct(s.normalize(x).alias("token"), F.lit("css-custom-property").alias("syntax"))),
        F.transform(F.regexp_extract_all(use, F.lit(r"(?<![\w-])\$([a-zA-Z0-9_-]+)"), 1), lambda x: F.struct(s.normalize(x).alias("token"), F.lit("scss-variable").alias("syntax"))),
    )
    return lines.select("repo_id", "path", (F.col("k") + 1).alias("line"), F.explode(found).alias("r")).select("repo_id", "path", "line", "r.token", "r.syntax")


def hex_literals(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, literal, property): hex colors with the nearest property name before them on the line; comments are blanked."""
    blank = F.pandas_udf(lambda c: c.map(lambda t: blank_comments(t or "")), "string")
    lines = files.select("repo_id", "path", F.posexplode(F.split(blank("content"), "\n", -1)).alias("k", "text"))
    # Each piece ends with one color, so the name before it is looked for in that piece alone; a color without one takes that of the last.
    hits = lines.select("repo_id", "path", (F.col("k") + 1).alias("line"), F.col("text"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).*?#[0-9a-fA-F]{3,8}\b"), 0)).alias("n", "piece"))
    before = F.regexp_extract("piece", r"(?s)^.*?([\w-]+)\s*:[^:;{]*#[0-9a-fA-F]{3,8}$", 1)
    own = hits.select("repo_id", "path", "line", "n", F.regexp_extract("piece", r"#[0-9a-fA-F]{3,8}$", 0).alias("literal"), F.nullif(before, F.lit("")).alias("own"))
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("repo_id", "path", "line").orderBy("n"))
    return own.select("repo_id", "path", "line", "literal", last.alias("property"))


def theme_declarations(files: DataFrame, namespaces: list[str], sites: bool = False) -> DataFrame:
    """(namespace, key, value) of @theme blocks, by the longest known namespace; with sites, after the keys of the run and the path."""
    keys = [c for c in ("repo_id", "run_id") if c in files.columns]
    blocks = files.select(*keys, "path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)@theme[^{]*\{(.*?)\n\}"), 1)).alias("b"))
    decl = blocks.select(*keys, "path", F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^\s*--([a-z0-9-]+\s*:\s*[^;]+);"), 1)).alias("d"))
    decl = decl.select(*keys, "path", F.trim(F.split_part("d", F.lit(":"), F.lit(1))).alias("name"), F.trim(F.regexp_extract("d", r"(?s)^[^:]*:(.*)$", 1)).alias("value"))
    ordered = sorted(namespaces, key=len, reverse=True)
    space = F.coalesce(*[F.when((F.col("name") == n) | F.col("name").startswith(n + "-"), F.lit(n)) for n in ordered])
    own = decl.withColumn("namespace", space).where("namespace is not null")
    return own.select(*([*keys, "path"] if sites else []), "namespace", F.regexp_replace(F.expr("substring(name, length(namespace) + 1)"), "^-", "").alias("key"), "value")


def font_faces(files: DataFrame) -> DataFrame:
    """(repo_id, path, family, url) of @font-face blocks."""
    blocks = files.select("repo_id", "path", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)@font-face\s*\{(.*?)\}"), 1)).alias("b"))
    family = F.regexp_replace(F.trim(F.regexp_extract("b", r"(?i)font-family\s*:\s*([^;]+)", 1)), r"""^["']|["']$""", "")
    return blocks.select("repo_id", "path", family.alias("family"), F.explode(F.regexp_extract_all("b", F.lit(r"""(?i)url\(\s*['"]?([^)'"]+)['"]?\s*\)"""), 1)).alias("url"))


def font_assets(assets: DataFrame, most: int = 5 << 20) -> DataFrame:
    """assets (path, content binary) of a known font format and bounded size, with their digest."""
    magic = F.hex(F.substring("content", 1, 4))
    kind = F.when(magic == "774F4632", "woff2").when(magic == "774F4646", "woff").when(magic.isin("00010000", "74727565"), "ttf").when(magic == "4F54544F", "otf")
    return assets.where(F.octet_length("content") <= most).select("path", kind.alias("format"), F.sha2("content", 256).alias("sha256")).where("format is not null")


def candidate_paths(spec: str, importer: str, packages: dict[str, str] | None = None, load_paths: list[str] | None = None) -> list[str]:
    """Every repository path that a spec may mean, in order: bases, Sass partials, extensions, index files."""
    import posixpath

    spec = spec.split("?")[0].split("#")[0].strip().removeprefix("~")
    if not spec or re.match(r"(?:https?:)?//|data:", spec):
        return []
    here, style = posixpath.dirname(importer), importer.lower().endswith(tuple(STYLE))
    if spec.startswith("/"):
        bases = [spec.lstrip("/")]
    elif spec.startswith("."):
        bases = [posixpath.join(here, spec)]
    else:
        m = re.match(r"(@[^/]+/[^/]+|[^/]+)(?:/(.*))?$", spec)
        home = (packages or {}).get(m[1])
        bases = [posixpath.join(home, sub, m[2] or "index") for sub in ("", "src", "styles", "css")] if home is not None else []
        bases += [posixpath.join(here, spec), *(posixpath.join(p, spec) for p in (load_paths or []) if style)]
    exts = [".scss", ".css", ".sass", ".less"] if style else TRIED
    out = []
    for base in map(posixpath.normpath, bases):
        head, tail = posixpath.split(base)
        for stem in [tail] + ["_" + tail] * (style and not tail.startswith("_")):
            if posixpath.splitext(stem)[1].lower() in {*STYLE, *MODULE, ".json", *ASSET}:
                out.append(posixpath.join(head, stem))
            else:
                out += [posixpath.join(head, stem + e) for e in exts] + [posixpath.join(head, stem, "index" + e) for e in exts] + [posixpath.join(head, stem, "_index.scss")] * style
    return list(dict.fromkeys(out))


def resolve_imports(records: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges (repo_id, src, dst), unresolved (repo_id, src, spec, reason)) of import records (repo_id, path, spec).

    The first candidate that exists wins. Candidates meet the table of paths alone. packages: repo_id, name, dir.
    """
    own = records.select("repo_id", "path", "spec").distinct()
    if packages is None:
        own = own.withColumn("home", F.lit(None).cast("string"))
    else:
        name = s.split_package_spec(F.regexp_replace("spec", "^~", ""))["package"]
        own = own.withColumn("name", name).join(packages.select("repo_id", "name", F.col("dir").alias("home")), ["repo_id", "name"], "left").drop("name")

    @F.pandas_udf("array<string>")
    def expand(spec: pd.Series, path: pd.Series, home: pd.Series) -> pd.Series:
        return pd.Series([candidate_paths(a, b, {re.match(r"~?(@[^/]+/[^/]+|[^/]+)", a)[1]: c} if isinstance(c, str) else None) for a, b, c in zip(spec, path, home, strict=True)])

    wanted = own.select("*", F.posexplode_outer(expand("spec", "path", "home")).alias("k", "candidate"))
    there = files.select("repo_id", F.col("path").alias("candidate"), F.lit(True).alias("_there")).distinct()
    best = wanted.join(there, ["repo_id", "candidate"], "left").groupBy("repo_id", "path", "spec").agg(F.min(F.when(F.col("_there"), F.struct("k", "candidate"))).alias("m"), F.bool_or(F.col("home").isNotNull()).alias("is_package"))
    edges = best.where("m is not null").select("repo_id", F.col("path").alias("src"), F.col("m.candidate").alias("dst")).distinct()
    lost = best.where("m is null").select("repo_id", F.col("path").alias("src"), "spec", s.unresolved_reason(F.col("spec"), F.col("is_package")).alias("reason"))
    return edges, lost


#: Parts into which the files of a directory are dealt where they meet directives, and tasks over which all parts are spread.
TREE_PARTS, TREE_TASKS = 64, 192
#: Files and directives of a part that meet at once. Parquet packs eight values at a time, so that repeats of a multiple of eight files are equal in bytes.
TREE_FILES, TREE_SOURCES = 256, 64


def expand_tree(directives: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, src, dst) of tree directives (repo_id, path, dir): files meet the directories as their own ancestors.

    A directive that lies below another one of its file adds nothing and goes, so that a file meets one directive of a src at
    most, and the result needs no distinct. Files of a directory are dealt into TREE_PARTS by their path and meet a copy of
    the directives each, so that one large directory spreads over many tasks.

    The result has a row for each directive and file below it, far more than both tables. So blocks of directives meet blocks
    of files, and their pairs are laid out after the join: each src of a block with the same few files in the same order.
    Written, such short repeats take a small part of the disk that rows in any other order take.
    """
    above = lambda c, least: F.transform(F.sequence(F.lit(1), least), lambda n: F.array_join(F.slice(F.split(c, "/"), F.lit(1), n), "/"))
    depth = lambda c: F.size(F.split(c, "/"))
    own = directives.select("repo_id", F.col("path").alias("src"), "dir").distinct()
    nested = own.where(depth("dir") > 1).select("repo_id", "src", F.col("dir").alias("_low"), F.explode(above("dir", depth("dir") - 1)).alias("dir")).join(own, ["repo_id", "src", "dir"], "left_semi")
    top = own.join(nested.select("repo_id", "src", F.col("_low").alias("dir")), ["repo_id", "src", "dir"], "left_anti")
    copies = top.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(TREE_PARTS - 1))))
    held = files.select("repo_id", F.col("path").alias("dst"), F.pmod(F.hash("path"), F.lit(TREE_PARTS)).alias("_part"), F.explode(above("path", F.greatest(depth("path") - 1, F.lit(1)))).alias("dir"))
    # Files of directories without a directive go before the shuffle.
    held = held.join(top.select("repo_id", "dir").distinct(), ["repo_id", "dir"], "left_semi")

    def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
        """(_key, repo_id, name): the distinct names of a part, size of them a row. The one key serves all steps and the join, so that they share a shuffle."""
        key = F.concat("_part", F.lit(":"), F.length("repo_id"), F.lit(":"), "repo_id", F.lit(":"), "dir")
        dealt = rows.select(key.alias("_key"), "repo_id", name).repartition(TREE_TASKS, "_key")
        place = F.dense_rank().over(Window.partitionBy("_key").orderBy(name))
        return dealt.withColumn("_block", F.floor((place - 1) / size)).groupBy("_key", "_block").agg(F.any_value("repo_id").alias("repo_id"), F.collect_set(name).alias(name)).drop("_block")

    # Spark can't tell the size of the arrays, so that neither side is to be broadcast.
    met = blocks(copies, "src", TREE_SOURCES).hint("merge").join(blocks(held, "dst", TREE_FILES).drop("repo_id"), "_key")
    # The coalesce moves no row: it ends the step of the join, so that a task holds the rows of one pair of blocks at a time and not those of a part.
    rows = met.coalesce(TREE_TASKS).select("repo_id", F.explode("src").alias("src"), "dst").select("repo_id", "src", F.explode("dst").alias("dst"))
    return rows.where("src <> dst")


def unresolved_summary(unresolved: DataFrame, actionable: list[str]) -> DataFrame:
    """Misses by reason, with the reasons that a person can act on."""
    return unresolved.groupBy("reason").agg(F.count("*").alias("misses"), F.countDistinct("spec").alias("specs")).withColumn("actionable", F.col("reason").isin(*actionable))


def root_property_count(text: str) -> int:
    """Custom properties inside :root blocks, those of nested blocks included."""
    clean, total = blank_comments(text), 0
    for m in re.finditer(r":root\b[^{]*\{", clean):
        depth, i = 1, m.end()
        while i < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[i], 0)
            i += 1
        total += len(_CSS.findall(clean[m.end() : i - 1]))
    return total


def root_properties(files: DataFrame) -> DataFrame:
    """(repo_id, path, root_properties) of style files."""
    count = F.pandas_udf(lambda c: c.map(lambda t: root_property_count(t or "")), "int")
    return files.where(extension(F.col("path")).isin(*STYLE)).select("repo_id", "path", count("content").alias("root_properties"))


def class_words(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, class): words of quoted strings on one line, which may be utilities; text between tags is not quoted."""
    lines = files.select("repo_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("k", "text"))
    quoted = F.regexp_extract_all("text", F.lit(r"""("[^"\n]*"|'[^'\n]*')"""), 1)
    words = F.explode(F.flatten(F.transform(quoted, lambda q: F.split(F.trim(F.substring(q, F.lit(2), F.length(q) - 2)), r"\s+"))))
    return lines.select("repo_id", "path", (F.col("k") + 1).alias("line"), words.alias("class")).where("class <> ''")


def identity_headings(files: DataFrame, reach: int = 80) -> DataFrame:
    """(repo_id, path, line, heading, is_brand): for every code line the nearest comment of at most reach lines above it.

    Lines of one block comment make one label; empty labels are passed over.
    """
    lines = files.select("repo_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1).withColumn("text", F.trim("text"))
    file = Window.partitionBy("repo_id", "path")
    opened, closed = F.regexp_count("text", F.lit(r"/\*")), F.regexp_count("text", F.lit(r"\*/"))
    own = lines.withColumn("_open", F.sum(opened).over(file.orderBy("line"))).withColumn("_shut", F.coalesce(F.sum(closed).over(file.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_block = F.col("_open") > F.col("_shut")
    own = own.withColumn("_comment", in_block | F.col("text").rlike("^(?://|#)")).withColumn("_block", F.when(in_block, F.col("_open")).otherwise(-F.col("line")))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"^(?:/\*+|//+|#+|\*+(?!/))\s*|\s*\*+/\s*$", ""), r"^[\s-]+|[\s-]+$", ""))
    labels = own.where("_comment").groupBy("repo_id", "path", "_block").agg(F.max("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", plain.alias("t")))), lambda x: x["t"]), " ").alias("label"))
    labels = labels.withColumn("label", F.nullif(F.trim("label"), F.lit(""))).select("repo_id", "path", "line", "label")
    above = F.last("label", ignorenulls=True).over(file.orderBy("line").rowsBetween(-reach, -1))
    out = own.join(labels, ["repo_id", "path", "line"], "left").withColumn("heading", above)
    return out.where("not _comment and text <> ''").select("repo_id", "path", "line", "heading", F.coalesce(F.col("heading").rlike(r"(?i)\b(?:brand|visual[ -]identity)\b"), F.lit(False)).alias("is_brand"))


def clean_json(content: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; strings that hold // or /* keep them."""
    string = r'("(?:[^"\\]|\\.)*")'
    return F.regexp_replace(F.regexp_replace(content, string + r"|/\*(?s:.*?)\*/|//[^\n]*", "$1"), string + r"|,(?=\s*[}\]])", "$1")


def workspace_packages(files: DataFrame) -> DataFrame:
    """(repo_id, name, dir) of the manifests of a corpus."""
    found = files.where(F.col("path").rlike(r"(?:^|/)package\.json$")).select("repo_id", F.get_json_object("content", "$.name").alias("name"), F.regexp_replace("path", r"/?package\.json$", "").alias("dir"))
    return found.where("name is not null and dir <> ''").groupBy("repo_id", "name").agg(F.min("dir").alias("dir"))


def path_aliases(files: DataFrame) -> DataFrame:
    """(repo_id, path, pattern, target) that script configurations declare, targets in their order."""
    found = files.where(F.col("path").rlike(r"(?:^|/)[tj]sconfig[^/]*\.json$")).select("repo_id", "path", F.get_json_object(clean_json(F.col("content")), "$.compilerOptions.paths").alias("p"))
    pairs = found.select("repo_id", "path", F.explode(F.from_json("p", "map<string,array<string>>")).alias("pattern", "targets"))
    return pairs.select("repo_id", "path", "pattern", F.posexplode("targets").alias("ord", "target"))


def framework_versions(files: DataFrame, package: str) -> DataFrame:
    """(repo_id, path, version) of a package in the manifests that name it; null if the version is no number."""
    field = lambda kind: F.get_json_object("content", f"$.{kind}['{package}']")
    declared = F.coalesce(field("dependencies"), field("devDependencies"))
    return files.where(F.col("path").rlike(r"(?:^|/)package\.json$")).where(declared.isNotNull()).select("repo_id", "path", F.nullif(F.regexp_extract(declared, r"(\d+(?:\.\d+)*)", 1), F.lit("")).alias("version"))


def registered_roots(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path, spec, profile) by extractor rules (profile, glob, regex), whose first group is a root's path.

    Rules are rows that a user adds; files meet them by name before any content is searched.
    """
    from gridloom.operators.discovery import join_rules

    met = join_rules(files, rules, F.regexp_like("path", F.col("glob")))
    return met.select("repo_id", "path", "profile", F.explode(F.regexp_extract_all("content", F.col("regex"), F.lit(1))).alias("spec")).where(s.safe_relative(F.col("spec"))).distinct()


_REFERENCE = r"""(?m)^[ \t]*['"]?([a-zA-Z0-9_-]+)['"]?[ \t]*:[ \t]*[A-Za-z_$][\w$]*(?:\.[\w$]+|\[[^\]\n]*\]|\([^)\n]*\))*[ \t]*,?[ \t]*$"""


def unreadable_names(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, family): properties of script objects whose value is a reference that can't be read.

    What they name is not visible; it is not absent. true, false, null and undefined are values.
    """
    blank = F.pandas_udf(lambda c: c.map(lambda t: blank_comments(t or "")), "string")
    own = files.where(extension(F.col("path")).isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")).select("repo_id", "path", blank("content").alias("c"))
    lines = own.select("repo_id", "path", F.explode(F.regexp_extract_all("c", F.lit(_REFERENCE), 0)).alias("x")).where(~F.col("x").rlike(r":\s*(?:true|false|null|undefined)\s*,?\s*$"))
    name = F.regexp_extract("x", _REFERENCE, 1)
    return lines.select("repo_id", "path", name.alias("name"), s.family_for(name, F.lit("")).alias("family")).distinct()
