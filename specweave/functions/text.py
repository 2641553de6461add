"""Text and vector columns. Patterns are safe for RE2, so that SQL can check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case words of at least ``least`` characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{%d,}" % least), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """Tokens of a prompt without a tokeniser: a quarter of the characters or the words, whichever is more; 0 if empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    estimate = F.greatest(F.lit(1), F.bround(F.length(t) / F.lit(4.0)).cast("long"), F.size(words(t)).cast("long"))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(estimate).cast("long")


def fixed(x: Column, digits: int = 2) -> Column:
    """Half-even decimal text without separators."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def file_size(size: Column) -> Column:
    """Bytes as text with the largest unit below 1024."""
    out = F.concat(fixed(size / F.lit(float(1 << 40))), F.lit(" TB"))
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(size < (1 << (power + 10)), F.concat(fixed(size / F.lit(float(1 << power))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(fixed(size.cast("double")), F.lit(" B"))).otherwise(out)


def duration(seconds: Column) -> Column:
    """Seconds as text: seconds, minutes, hours or days."""
    out = F.concat(fixed(seconds / 86400.0), F.lit(" days"))
    for most, per, unit in ((86400, 3600.0, "hours"), (3600, 60.0, "mins"), (60, 1.0, "secs")):
        out = F.when(seconds < most, F.concat(fixed(seconds / per), F.lit(f" {unit}"))).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def found(df: DataFrame, text: str, pattern: str, groups: dict[str, int], at: str = "pos") -> DataFrame:
    """A row for each match of ``pattern`` in a text column: its groups as columns, and its number from 0."""
    rows = df.select("*", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias(at, "_match"))
    return rows.withColumns({n: F.regexp_extract("_match", pattern, g) for n, g in groups.items()}).drop("_match")


def number_in(name: Column) -> Column:
    """The last number of a file name's stem, for numeric order; null without one."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.try_element_at(F.regexp_extract_all(stem, F.lit(r"\d+"), F.lit(0)), F.lit(-1)).cast("long")


def natural_order(name: Column) -> Column:
    """Sort key: numbers padded, so that x2 comes before x10."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(F.lower(p))))
