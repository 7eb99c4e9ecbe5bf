"""Font faces of style sheets, the stored files that they name, and the faces that a chosen font family can be shown with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.operators.extract import blank_comments
from gridloom.operators.ranks import run_keys
from gridloom.sources.staged import staged

#: First bytes of the formats, in hex; and the most bytes that a font may have.
MAGIC = {"woff2": ["774F4632"], "woff": ["774F4646"], "ttf": ["00010000", "74727565"], "otf": ["4F54544F"]}
MOST_BYTES = 5 << 20


def normal_path(path: Column) -> Column:
    """A relative path without empty parts, `.` and `..`; what climbs above the repository keeps its leading `..`."""

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.get(done, F.size(done) - 1) != "..")
        return F.when(part.isin("", "."), done).when((part == "..") & up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def font_candidates(style: Column, url: Column) -> Column:
    """The repository paths that a url in a style sheet may mean, in order; none for addresses and embedded data."""
    clean = F.element_at(F.split(url, "[?#]"), 1)
    relative = F.regexp_replace(clean, "^/+", "")
    parts = F.split(relative, "/")
    tail = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "/")
    of_plugin = F.when((F.get(parts, F.lit(0)) == "plugins") & (F.size(parts) >= 3), F.array(*[F.concat(F.lit("plugins/"), F.get(parts, F.lit(1)), F.lit(f"/{d}/"), tail) for d in ("public", "assets")]))
    absolute = F.concat(F.array(relative), F.coalesce(of_plugin, F.array().cast("array<string>")), F.array(F.concat(F.lit("public/"), relative)))
    here = F.array(F.concat(F.regexp_extract(style, "^(.*/)?[^/]*$", 1), clean), F.concat(F.lit("public/"), clean))
    made = F.transform(F.when(clean.startswith("/"), absolute).otherwise(here), normal_path)
    none = F.coalesce(url, F.lit("")).rlike("(?i)^(?:$|data:|https?:|//)")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.filter(made, lambda p: ~p.rlike(r"^\.\.(?:/|$)") & (p != "")))


def face_blocks(files: DataFrame) -> DataFrame:
    """(keys, path, line, family, url) of @font-face blocks that name a concrete family and a file; the first url counts. Comments are blanked first."""
    keys = run_keys(files)
    blank = F.pandas_udf(lambda c: c.map(lambda t: blank_comments(t or "")), "string")
    clean = files.where(F.contains(F.lower("content"), F.lit("@font-face"))).select(*keys, "path", blank("content").alias("c"))
    # Text before each block, up to the next: a piece holds one block, and the newlines before it give its line.
    pieces = clean.select(*keys, "path", F.split("c", r"(?i)(?=@font-face\s*\{)", -1).alias("p")).select(*keys, "path", F.posexplode("p").alias("k", "b"), "p").where(F.col("b").rlike(r"(?i)^@font-face\s*\{"))
    line = F.aggregate(F.slice("p", F.lit(1), F.col("k")), F.lit(1), lambda n, x: n + F.regexp_count(x, F.lit("\n")))
    body = F.regexp_extract("b", r"(?is)^@font-face\s*\{(.*?)\}", 1)
    family = s.concrete_font_family(F.regexp_extract(body, r"(?i)font-family\s*:\s*([^;}]+)", 1))
    url = F.trim(F.regexp_extract(body, r"""(?i)url\(\s*['"]?([^)'"]+)['"]?\s*\)""", 1))
    return pieces.select(*keys, "path", line.alias("line"), family.alias("family"), url.alias("url")).where("family is not null and url <> ''")


def font_evidence(faces: DataFrame, assets: DataFrame) -> DataFrame:
    """(keys, path, line, family, url, asset, format, state, sha256, size_bytes, reason): each face with the first stored file among its candidates.

    faces: those of face_blocks; assets: path, content (binary). Candidates meet the paths of assets by equality. A face is
    verified if its file begins as the url's extension says and has 1 to MOST_BYTES bytes; a file that doesn't gives a reason,
    and a face without a file is not visible. Files outside of the repository are never candidates.
    """
    keys = run_keys(faces)
    # Faces are read twice. Both sides of a join are dealt out and sorted: both grow with the input, and a broadcast would hold one of them whole in every task.
    faces = staged(faces)
    stored = assets.select(*keys, F.col("path").alias("asset"), F.hex(F.substring("content", 1, 4)).alias("_magic"), F.octet_length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"))
    wanted = faces.select(*keys, "path", "line", "url", F.posexplode(font_candidates(F.col("path"), F.col("url"))).alias("_k", "asset"))
    best = wanted.join(stored.hint("merge"), [*keys, "asset"]).groupBy(*keys, "path", "line", "url").agg(F.min(F.struct("_k", "asset", "_magic", "_size", "_sha")).alias("m"))
    kind = F.lower(F.regexp_extract(F.element_at(F.split("url", r"\?"), 1), r"\.([^./]+)$", 1))
    known = F.when(F.lit(False), False)
    for name, starts in MAGIC.items():
        known = known.when(kind == name, F.col("m._magic").isin(*starts))
    ok = known.otherwise(False) & F.col("m._size").between(1, MOST_BYTES)
    own = faces.join(best.hint("merge"), [*keys, "path", "line", "url"], "left").withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return own.select(
        *keys, "path", "line", "family", "url", F.col("m.asset").alias("asset"), kind.alias("format"), F.when(F.col("_ok"), "verified").otherwise("not-visible").alias("state"), F.when(F.col("_ok"), F.col("m._sha")).alias("sha256"),
        F.when(F.col("_ok"), F.col("m._size")).alias("size_bytes"), F.when(~F.col("_ok") & F.col("m.asset").isNotNull(), "unsupported, oversized, or invalid font asset").alias("reason"),
    )


def font_specimens(families: DataFrame, evidence: DataFrame) -> DataFrame:
    """(keys, family, state, asset, assets, note): the file that a chosen family can be shown with, if its verified faces have one content.

    families: family; evidence: rows of font_evidence. Several contents leave the choice to a person.
    """
    keys = run_keys(families)
    faces = evidence.where("state = 'verified'").groupBy(*keys, F.lower("family").alias("_f")).agg(F.countDistinct("sha256").alias("n"), F.min("asset").alias("a"))
    own = families.select(*keys, "family").distinct().withColumn("_f", F.lower("family")).join(faces, [*keys, "_f"], "left")
    note = F.when(F.col("n") == 1, "The font file of the repository can be shown.").when(F.col("n") > 1, "Several different files declare the family.").otherwise("No verified face declares the family.")
    return own.select(*keys, "family", F.when(F.col("n") == 1, "verified").otherwise("not-visible").alias("state"), F.when(F.col("n") == 1, F.col("a")).alias("asset"), F.coalesce("n", F.lit(0)).alias("assets"), note.alias("note"))
