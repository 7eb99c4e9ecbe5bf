"""Text jobs over documents and pages: prose rules, fences, markup, visible text, placeholders, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in order: British spellings and their American ones; of a line the first that it holds is reported.
SPELLING = [
    ("Colours", "Colors"), ("colours", "colors"), ("Colour", "Color"), ("colour", "color"), ("untokenised", "untokenized"), ("tokenised", "tokenized"), ("summarised", "summarized"), ("normalised", "normalized"), ("organised", "organized"),
    ("recognised", "recognized"), ("prioritised", "prioritized"), ("standardised", "standardized"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("catalogue", "catalog"), ("cancelled", "canceled"), ("labelled", "labeled"),
    ("behaviour", "behavior"), ("centre", "center"), ("grey", "gray"), ("whilst", "while"), ("amongst", "among"), ("learnt", "learned"),
]
#: Fixed values, in order: phrases that prose does without.
BANNED = ["simply", "utilize", "utilise", "leverage", "in order to", "seamlessly", "effortlessly", "robust"]
#: Words retired from pages.
RETIRED = ["unmeasured", "not-visible", "needs-work", "check(s)", "vital(s)", "blast radius"]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), numbered from 1."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "line")).select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


def fences(lines: DataFrame) -> DataFrame:
    """lines with skip (a fence, or between two of a pair) and unbalanced (the last fence, where nothing closes it)."""
    is_fence = F.ltrim("line").startswith("```").cast("int")
    w = Window.partitionBy("doc_id")
    seen = F.sum("_f").over(w.orderBy("line_no"))
    own = lines.withColumn("_f", is_fence).withColumn("_seen", seen).withColumn("_all", F.sum("_f").over(w))
    last = (F.col("_f") == 1) & (F.col("_seen") == F.col("_all")) & (F.col("_all") % 2 == 1)
    inside = (F.col("_seen") % 2 == 1) & (F.col("_seen") < F.col("_all"))
    return own.select("doc_id", "line_no", "line", ((F.col("_f") == 1) | inside).alias("skip"), last.alias("unbalanced"))


def fenced(docs: DataFrame) -> DataFrame:
    """The rows of fences over the lines of docs; only texts that hold a fence mark are sorted by line, no line of others is in a fence."""
    marked = F.contains(F.coalesce("text", F.lit("")), F.lit("```"))
    plain = lines_of(docs.where(~marked)).select("doc_id", "line_no", "line", F.lit(False).alias("skip"), F.lit(False).alias("unbalanced"))
    return plain.unionByName(fences(lines_of(docs.where(marked))))


def voice_lint(docs: DataFrame, spelling: list[tuple[str, str]] = SPELLING, banned: list[str] = BANNED) -> DataFrame:
    """(doc_id, line_no, rule, detail): the first spelling and the first phrase of each line's prose, negative parallels, open fences.

    Fenced blocks are left out, and inline code and tags are blanked. A line is first asked for any of the phrases at once.
    """
    own = fenced(docs)
    clean = F.regexp_replace(F.regexp_replace("line", "`+[^`]*`+", " "), "<[^>]*>", " ")
    prose = F.replace(F.when(F.contains("line", F.lit("`")) | F.contains("line", F.lit("<")), clean).otherwise(F.col("line")), F.lit("aria-labelledby"), F.lit(" "))
    own = own.withColumn("prose", prose)
    hit = lambda pairs, test: F.coalesce(*[F.when(test(x), F.lit(x)) for x in pairs]) if pairs else F.lit(None)
    spelled = lambda x: "".join(c if c.isalnum() or c == " " else "\\" + c for c in x)
    held = lambda form: F.lower("prose").rlike(f"(^|[^a-z0-9_])(?:{form})($|[^a-z0-9_])")
    british = hit([old for old, _ in spelling], lambda x: F.col("prose").contains(x))
    phrase = F.when(held("|".join(spelled(x) for x in banned)), hit(banned, lambda x: held(spelled(x)))) if banned else F.lit(None)
    negative = F.when(F.col("prose").rlike(r"(?i)\b(?:is|are|was|were)\s+not\s+(?:a|an|the)\b"), F.lit("negative"))
    live = ~F.col("skip")
    found = F.array(
        F.struct(F.lit("unbalanced-fence").alias("rule"), F.when(F.col("unbalanced"), F.lit("open")).alias("detail")), F.struct(F.lit("us-english").alias("rule"), F.when(live, british).alias("detail")),
        F.struct(F.lit("banned-phrase").alias("rule"), F.when(live, phrase).alias("detail")), F.struct(F.lit("negative-parallelism").alias("rule"), F.when(live, negative).alias("detail")),
    )
    return own.select("doc_id", "line_no", F.explode(found).alias("f")).select("doc_id", "line_no", "f.rule", "f.detail").where("detail is not null")


def markup_scan(pages: DataFrame) -> DataFrame:
    """(page_id, hits): pages that hold executable markup, and how often."""
    hits = F.regexp_count("html", F.lit(r"(?i)<script\b|<iframe\b|\son(?:error|load|mouseover|click|focus)\s*=|javascript:"))
    return pages.select("page_id", hits.cast("long").alias("hits")).where("hits > 0")


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): without scripts, styles, comments and tags; the common entities as characters, &amp; last."""
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return pages.select("page_id", F.coalesce(text, F.lit("")).alias("text"))


def retired_words(pages: DataFrame, words: list[str] = RETIRED) -> DataFrame:
    """(page_id, word) of retired words that a reader sees."""
    seen = visible_text(pages).withColumn("low", F.lower("text"))
    return seen.select("page_id", F.explode(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("low"), w))).alias("word"))


def placeholders(pages: DataFrame, marks: list[str]) -> DataFrame:
    """(page_id, mark) of sample content left in a page."""
    return pages.select("page_id", F.explode(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.col("html"), m))).alias("mark"))


def path_leaks(pages: DataFrame) -> DataFrame:
    """Pages that show an absolute path of somebody's machine."""
    return pages.where(F.col("html").rlike(r"(?:/Users/|/home/|[A-Z]:\\Users\\)[A-Za-z0-9._-]+")).select("page_id")
