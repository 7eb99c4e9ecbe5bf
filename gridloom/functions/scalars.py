"""Column expressions of the audit: names, families, literals, ids, priorities, colors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v


def normalize(name: Column) -> Column:
    """A concept's id: without leading - and $, _ as -, lower case."""
    return F.lower(F.translate(F.regexp_replace(name, r"^[-$]+", ""), "_", "-"))


def family_key(name: Column) -> Column:
    """Camel case is split first, so that it is not the same as normalize."""
    split = F.regexp_replace(F.regexp_replace(name, r"^[-$]+", ""), r"(?<=[a-z0-9])(?=[A-Z])", "-")
    return F.lower(F.regexp_replace(split, r"[_.\s]+", "-"))


def has_signal(key: Column, *signals: str) -> Column:
    """Whether any signal is a run of whole hyphen segments of key."""
    return F.concat(F.lit("-"), key, F.lit("-")).rlike("-(?:" + "|".join(signals) + ")-")


def family_for(name: Column, value: Column) -> Column:
    """The first family that name or value speaks for; the order matters. The key is worked out once a row, not once a test."""
    colored = value.rlike(r"(?i)(?:#[0-9a-f]{3,8}\b|(?:rgb|hsl|oklch|lab|color)\()")

    def family(key: Column) -> Column:
        out = None
        for structural in v.STRUCTURAL:
            test = has_signal(key, *v.FAMILY_NAMES[structural])
            out = F.when(test, structural) if out is None else out.when(test, structural)
        out = out.when(colored | has_signal(key, *v.COLOR_NAMES), "color")
        out = out.when(has_signal(key, *v.FAMILY_NAMES["icon"]), "icon")
        out = out.when(has_signal(key, *v.FAMILY_NAMES["typography"]) | (key == "type") | key.startswith("type-"), "typography")
        for measure in ("spacing", "sizing", "opacity"):
            out = out.when(has_signal(key, *v.FAMILY_NAMES[measure]), measure)
        return out.otherwise("unclassified")

    return F.get(F.transform(F.array(family_key(name)), family), F.lit(0))


def value_shape(value: Column) -> Column:
    return F.when(value.contains("var(") | value.rlike(r"^\$[\w-]+"), "alias").otherwise("literal")


def alias_target(value: Column) -> Column:
    """The first var(--x) or $x of a value, normalised; null if there is none."""
    a, b = F.regexp_extract(value, r"var\(\s*--([\w-]+)\s*\)|\$([\w-]+)", 1), F.regexp_extract(value, r"var\(\s*--([\w-]+)\s*\)|\$([\w-]+)", 2)
    return F.nullif(normalize(F.concat(a, b)), F.lit(""))


def declared_tier(names: Column) -> Column:
    """The layer that the first name with a marker states; names is an array in first-seen order."""

    def tier(name: Column) -> Column:
        key, out = family_key(name), None
        for label, markers in v.TIER_MARKERS:
            test = has_signal(key, *markers)
            out = F.when(test, label) if out is None else out.when(test, label)
        return out

    return F.get(F.filter(F.transform(names, tier), lambda x: x.isNotNull()), F.lit(0))


def concrete_font_family(value: Column) -> Column:
    """The first name of a font stack, or null if it is generic, a reference or no plain name."""
    text = F.trim(value)
    bad = (text == "") | text.contains("var(") | text.contains("#{")
    unwrapped = F.when(text.rlike(r"(?s)^\[.*\]$"), F.trim(F.regexp_extract(text, r"(?s)^\[([^,]*?)(?:,.*)?\]$", 1))).otherwise(text)
    first = F.trim(F.regexp_replace(F.regexp_extract(unwrapped, r"""^\s*("(?:[^"\\]|\\.)+"|'(?:[^'\\]|\\.)+'|[^,]+)""", 1), r"""^(["'])(.*)\1$""", "$2"))
    ok = first.rlike(r"^[a-zA-Z][a-zA-Z0-9 _-]*$") & ~F.lower(first).isin(*v.GENERIC_FONTS)
    return F.when(~bad & ok, first)


_NUMBER = r"[+\-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+\-]?\d+)?"
_PCT, _ANGLE = f"{_NUMBER}%?", f"{_NUMBER}(?:deg|grad|rad|turn)?"


def concrete_color_value(value: Column) -> Column:
    """A self-contained color or null: hex of 3, 4, 6 or 8 digits, or a color function whose channels have legal units."""
    text = F.trim(value)
    alpha, comma = rf"(?:\s*/\s*{_PCT})?", r"\s*,\s*"
    profile = r"(?:srgb|srgb-linear|display-p3|a98-rgb|prophoto-rgb|rec2020|xyz|xyz-d50|xyz-d65)"
    forms = [
        r"#(?:[0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})",
        rf"rgba?\(\s*{_PCT}\s+{_PCT}\s+{_PCT}{alpha}\s*\)", rf"hsla?\(\s*{_ANGLE}\s+{_NUMBER}%\s+{_NUMBER}%{alpha}\s*\)",
        rf"rgb\(\s*{_PCT}(?:{comma}{_PCT}){{2,3}}\s*\)", rf"rgba\(\s*{_PCT}(?:{comma}{_PCT}){{3}}\s*\)",
        rf"hsl\(\s*{_ANGLE}(?:{comma}{_NUMBER}%){{2}}(?:{comma}{_PCT})?\s*\)", rf"hsla\(\s*{_ANGLE}(?:{comma}{_NUMBER}%){{2}}{comma}{_PCT}\s*\)",
        rf"oklch\(\s*{_PCT}\s+{_NUMBER}\s+{_ANGLE}{alpha}\s*\)", rf"lab\(\s*{_PCT}\s+{_PCT}\s+{_PCT}{alpha}\s*\)", rf"color\(\s*{profile}\s+{_PCT}\s+{_PCT}\s+{_PCT}{alpha}\s*\)",
    ]
    return F.when(text.rlike("(?i)^(?:" + "|".join(forms) + ")$"), text)


def normalize_literal(literal: Column) -> Column:
    """One spelling of a value: trimmed, spaces folded and dropped beside ( ) and commas, lower case, 3-digit hex doubled."""
    text = F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.coalesce(literal, F.lit(""))), r"\s+", " ")), r"\s*([(),])\s*", "$1")
    return F.regexp_replace(text, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")


def finding_id(tier: Column, family: Column, literal: Column, token: Column) -> Column:
    """12 hex digits that don't depend on where the finding is."""
    none = F.lit("")
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(tier, none), F.coalesce(family, none), normalize_literal(literal), F.coalesce(token, none)).cast("binary")), 1, 12)


def stable_id(key: Column) -> Column:
    return F.substring(F.sha1(key.cast("binary")), 1, 12)


def confidence_weight(confidence: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, weight in v.FIX_WEIGHTS.items():
        out = out.when(confidence == name, weight)
    return out.otherwise(v.FIX_WEIGHTS["manual review"])


def score(occurrences: Column, files: Column, breadth: Column, confidence: Column) -> Column:
    """(n + 2f + 3b) x c, to two places."""
    return F.round((occurrences + 2 * files + 3 * breadth) * confidence_weight(confidence), 2)


def priority(occurrences: Column, files: Column, breadth: Column, confidence: Column) -> Column:
    """The score with everything that made it."""
    return F.struct(occurrences.alias("occurrences"), files.alias("files"), breadth.alias("breadth"), confidence.alias("confidence"), confidence_weight(confidence).alias("confidence_weight"), F.lit("(n + 2f + 3b) x c").alias("formula"), score(occurrences, files, breadth, confidence).alias("score"))


def is_automatable(tier: Column, confidence: Column, proven: Column) -> Column:
    return (tier == "redundant") & F.coalesce(proven, F.lit(False)) & (confidence != "manual review")


def effort(tier: Column, confidence: Column, files: Column, proven: Column) -> Column:
    auto = is_automatable(tier, confidence, proven)
    return F.when(auto & (files < 10), "S").when(auto | (files <= 1), "M").otherwise("L")


def owner_for(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin("plugins", "packages", "apps"), F.get(parts, F.lit(1))).when(F.get(parts, F.lit(0)) == "app", "core").otherwise(F.get(parts, F.lit(0)))


def component_identity(path: Column) -> Column:
    """struct(key, name, kind): one ownership unit of the interface, told from the path alone."""
    device = ["common", "desktop", "mobile", "admin", "styles", "style"]
    parts = F.split(F.translate(path, "\\", "/"), "/")
    owner, last = owner_for(F.array_join(parts, "/")), F.element_at(parts, -1)
    raw = F.regexp_replace(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), r"^_+", "")
    is_index = F.lower(raw) == "index"
    stem = F.when(is_index & (F.size(parts) > 1), F.get(parts, F.size(parts) - 2)).otherwise(raw)
    stem = F.regexp_replace(F.regexp_replace(stem, r"(?i)\.(?:module|component|styles?|style)$", ""), r"(?i)[-_](?:mobile|desktop)$", "")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    firsts = [F.array_position(dirs, m) for m in ("components", "component")]
    marker = F.least(*[F.when(x > 0, x) for x in firsts])
    sheet = F.array_position(dirs, "stylesheets")
    keep = lambda xs: F.filter(xs, lambda x: ~x.isin(*device))
    after = lambda at: keep(F.slice(dirs, F.greatest(F.coalesce(at, F.lit(0)).cast("int") + 1, F.lit(1)), F.size(dirs)))

    def folded(xs: Column) -> Column:
        n = F.size(xs)
        same = (n > 1) & (normalize(F.get(xs, n - 2)) == normalize(F.get(xs, n - 1)))
        return F.when(same, F.slice(xs, F.lit(1), n - 1)).otherwise(xs)

    in_component = folded(F.when(is_index, after(marker)).otherwise(F.concat(after(marker), F.array(stem))))
    in_sheet = F.concat(after(sheet), F.array(stem))
    tail = F.filter(keep(dirs), lambda x: ~x.isin("plugins", "packages", "apps") & (x != owner))
    tail = F.slice(tail, F.greatest(F.size(tail) - 1, F.lit(1)), F.lit(2))
    elsewhere = folded(F.when(is_index, tail).otherwise(F.concat(tail, F.array(stem))))
    slug = F.array_join(F.when(marker.isNotNull(), in_component).when(sheet > 0, in_sheet).otherwise(elsewhere), "/")
    slug = F.regexp_replace(slug, "^/+|/+$", "")
    slug = F.when(slug == "", stem).otherwise(slug)
    kind = F.when(marker.isNotNull(), "component").when(sheet > 0, "style-surface").otherwise("surface")
    return F.struct(F.concat(F.lower(owner), F.lit("::"), F.lower(slug)).alias("key"), F.concat(owner, F.lit(" / "), slug).alias("name"), kind.alias("kind"))


def rounded_percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, 1))


def unresolved_reason(spec: Column, is_package: Column) -> Column:
    """Why an import names no file of the corpus."""
    local = spec.rlike(r"^[./]") | is_package
    return F.when(spec.rlike("^(?:https?:)?//|^data:"), "remote dependency").when(spec.startswith("sass:"), "framework built-in").when(spec.startswith("<dynamic:"), "dynamic runtime import").when(local, "missing local source").otherwise("external package")


def split_package_spec(spec: Column) -> Column:
    pattern = r"^(@[^/]+/[^/]+|[^/]+)(?:/(.*))?$"
    return F.struct(F.regexp_extract(spec, pattern, 1).alias("package"), F.regexp_extract(spec, pattern, 2).alias("subpath"))


def safe_relative(path: Column) -> Column:
    """A path inside the repository: no URL, no escape, no interpolation."""
    return ~path.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^/|^\\|^~|\$\{|\{\{|<|\*|(?:^|/)\.\.(?:/|$)") & (F.trim(path) != "")


def peel(name: Column) -> Column:
    """A utility class without variants, importance, modifier and sign; brackets shield colons and slashes."""
    base = F.regexp_replace(F.trim(name), r"^(?:(?:[^\[\](): ]|\[[^\]]*\]|\([^)]*\))*:)+", "")
    base = F.regexp_replace(F.regexp_replace(base, r"^!+|!+$", ""), r"^((?:[^\[\]()/]|\[[^\]]*\]|\([^)]*\))*)/.*$", "$1")
    return F.regexp_replace(base, "^-", "")


def luminance(color: Column) -> Column:
    """Relative luminance of #rrggbb."""

    def linear(at: int) -> Column:
        c = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(2) + 0.7152 * linear(4) + 0.0722 * linear(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def with_lab(df: DataFrame, color: str, name: str) -> DataFrame:
    """df with struct(l, a, b) of #rrggbb as a column: sRGB by D65 to CIELAB, step by step as with_delta_e."""
    kept = df.columns
    part = lambda at: F.conv(F.substring(F.col(color), at, 2), 16, 10).cast("double") / 255
    c = lambda x: F.col(f"_{x}")
    linear = lambda x: F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    f = lambda t: F.when(t > 216.0 / 24389, F.cbrt(t)).otherwise((24389.0 / 27 * t + 16) / 116)
    out = df.withColumns({"_r": part(2), "_g": part(4), "_u": part(6)}).withColumns({"_lr": linear(c("r")), "_lg": linear(c("g")), "_lb": linear(c("u"))})
    out = out.withColumns({"_x": (0.4124564 * c("lr") + 0.3575761 * c("lg") + 0.1804375 * c("lb")) / 0.95047, "_y": 0.2126729 * c("lr") + 0.7151522 * c("lg") + 0.0721750 * c("lb"), "_z": (0.0193339 * c("lr") + 0.1191920 * c("lg") + 0.9503041 * c("lb")) / 1.08883})
    out = out.withColumns({"_fx": f(c("x")), "_fy": f(c("y")), "_fz": f(c("z"))})
    return out.select(*kept, F.struct((116 * c("fy") - 16).alias("l"), (500 * (c("fx") - c("fy"))).alias("a"), (200 * (c("fy") - c("fz"))).alias("b")).alias(name))


def with_delta_e(df: DataFrame, p: str, q: str, name: str) -> DataFrame:
    """df with the CIEDE2000 of two lab structs as a column, worked out step by step, so that no step is repeated in the plan."""
    deg, kept = math.pi / 180, df.columns
    c = lambda x: F.col(f"_{x}")
    p_, q_ = F.col(p), F.col(q)
    out = df.withColumn("_c7", F.pow((F.hypot(p_["a"], p_["b"]) + F.hypot(q_["a"], q_["b"])) / 2, F.lit(7.0)))
    out = out.withColumn("_g", 1 + 0.5 * (1 - F.sqrt(c("c7") / (c("c7") + 25.0**7))))
    out = out.withColumns({"_a1": c("g") * p_["a"], "_a2": c("g") * q_["a"]})
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.atan2(b, a) / deg, F.lit(360.0)))
    out = out.withColumns({"_d1": F.hypot(c("a1"), p_["b"]), "_d2": F.hypot(c("a2"), q_["b"]), "_h1": hue(c("a1"), p_["b"]), "_h2": hue(c("a2"), q_["b"])})
    out = out.withColumns({"_grey": c("d1") * c("d2") == 0, "_gap": c("h2") - c("h1"), "_sum": c("h1") + c("h2")})
    turn = F.when(c("grey"), 0.0).when(F.abs(c("gap")) <= 180, c("gap")).when(c("gap") > 180, c("gap") - 360).otherwise(c("gap") + 360)
    mean = F.when(c("grey"), c("sum")).when(F.abs(c("gap")) <= 180, c("sum") / 2).when(c("sum") < 360, (c("sum") + 360) / 2).otherwise((c("sum") - 360) / 2)
    out = out.withColumns({"_dh": turn, "_mh": mean, "_l2": F.pow((p_["l"] + q_["l"]) / 2 - 50, F.lit(2.0)), "_md": (c("d1") + c("d2")) / 2})
    t = 1 - 0.17 * F.cos((c("mh") - 30) * deg) + 0.24 * F.cos(2 * c("mh") * deg) + 0.32 * F.cos((3 * c("mh") + 6) * deg) - 0.20 * F.cos((4 * c("mh") - 63) * deg)
    out = out.withColumns({"_t": t, "_m7": F.pow(c("md"), F.lit(7.0))})
    rotation = -F.sin(60 * F.exp(-F.pow((c("mh") - 275) / 25, F.lit(2.0))) * deg) * 2 * F.sqrt(c("m7") / (c("m7") + 25.0**7))
    out = out.withColumns({
        "_r": rotation, "_x": (q_["l"] - p_["l"]) / (1 + 0.015 * c("l2") / F.sqrt(20 + c("l2"))), "_y": (c("d2") - c("d1")) / (1 + 0.045 * c("md")),
        "_z": 2 * F.sqrt(c("d1") * c("d2")) * F.sin(c("dh") * deg / 2) / (1 + 0.015 * c("md") * c("t")),
    })
    return out.select(*kept, F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z") + c("r") * c("y") * c("z")).alias(name))
