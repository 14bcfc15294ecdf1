"""Text columns.  A missing value gives a missing result throughout.

Patterns are Java regular expressions; they agree with Python's for character
classes, groups and quantifiers, and differ in named groups and some escapes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.ordered import Line

# Typographic quotes and the plain one.
CURLY_QUOTES = "[‘’]"
NOT_ASCII = "[^\\x00-\\x7F]+"
CAPITALS = "([A-Z]+)"


def cat(a: Column, b: Column, sep: str = "") -> Column:
    """``a + sep + b``; missing when either is."""
    return F.concat(a, F.lit(sep), b)


def cat_list(df: DataFrame, column: str, order: Sequence[str], words: Sequence[str], sep: str = "", out: str = "joined") -> DataFrame:
    """Word by row position; rows beyond the list get null."""
    line = Line.of(df, (), tuple(order)).with_position("__at")
    at = F.least(F.col("__at"), F.lit(len(words))).cast("int")  # compared before the cast: positions may pass 2^31
    word = F.get(F.array(*[F.lit(w) for w in words]), at)
    return line.result().withColumn(out, F.concat(F.col(column), F.lit(sep), word)).drop("__at")


def replace_regex(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def replace_literal(c: Column, what: str, by: str) -> Column:
    return F.replace(c, F.lit(what), F.lit(by))


def plain_quotes(c: Column) -> Column:
    return replace_regex(c, CURLY_QUOTES, "'")


def extract(c: Column, pattern: str) -> Column:
    """First group of the first match; null without a match."""
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def isdigit(c: Column) -> Column:
    """Only decimal digits, and at least one."""
    return F.rlike(c, F.lit(r"\A\p{Nd}+\z"))


def isalnum(c: Column) -> Column:
    """Only letters and numbers, and at least one."""
    return F.rlike(c, F.lit(r"\A[\p{L}\p{N}]+\z"))


def find(c: Column, what: str) -> Column:
    """0-based place of the first occurrence, -1 without one."""
    return F.locate(what, c) - 1


def has(c: Column, what: str) -> Column:
    return F.contains(c, F.lit(what))


def split_get(c: Column, sep: str, at: int, limit: int = -1) -> Column:
    """Part ``at`` of the text split at a literal separator; null when there is none."""
    quoted = "\\Q" + sep + "\\E"
    return F.get(F.split(c, quoted, limit), F.lit(at))


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def measure(c: Column) -> Column:
    """Number in front of a bracket, as in ``21.0 (69.8)``; a minus sign of any script counts as one."""
    head = split_get(c, "(", 0)
    return strip(replace_regex(head, NOT_ASCII, "-")).try_cast("double")


def decode_messages(lines: DataFrame, message: str, line_no: str, text: str) -> DataFrame:
    """Hidden message of numbered words: those numbered 1, 3, 6, 10, … up to the first gap.

    A line is ``number word``; of lines with the same number the last counts.
    Only triangular numbers survive the first filter, so what is gathered per
    message grows with the square root of its lines.
    """
    line = strip(F.col(text))
    number = split_get(line, " ", 0, 2).try_cast("bigint")
    word = split_get(line, " ", 1, 2)
    rank = F.floor((F.sqrt(8.0 * F.col("number") + 1) - 1) / 2).cast("bigint")
    named = (
        lines.select(message, line_no, number.alias("number"), word.alias("word"))
        .withColumn("rank", rank)
        .filter((F.col("number") > 0) & (F.col("rank") * (F.col("rank") + 1) / 2 == F.col("number")))
    )
    words = named.groupBy(message, "rank").agg(F.max_by("word", line_no).alias("word"))
    gathered = words.groupBy(message).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))
    run = F.filter("w", lambda x, i: x["rank"] == i + 1)
    decoded = F.array_join(F.transform(run, lambda x: x["word"]), " ")
    everyone = lines.select(message).distinct()
    return everyone.join(gathered.select(message, decoded.alias("decoded")), message, "left").withColumn(
        "decoded", F.coalesce("decoded", F.lit(""))
    )
