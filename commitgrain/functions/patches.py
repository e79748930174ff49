"""Scalars over patch text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitgrain.functions.text import once

#: Fixed value: the line ends that count, a pair of carriage return and line feed as one.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
#: Tokens that are counted, and the pattern of a hunk header.
TOKENS = ("todo", "fixme", "try", "except", "raise")
HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def added_lines(patch: Column) -> Column:
    return occurrences(patch, "\n+") - occurrences(patch, "\n+++")


def deleted_lines(patch: Column) -> Column:
    return occurrences(patch, "\n-") - occurrences(patch, "\n---")


def hunk_marks(patch: Column) -> Column:
    """Marks of hunk headers; each hunk has two."""
    return occurrences(patch, "@@")


def hunks(patch: Column) -> Column:
    return hunk_marks(patch) / 2


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def added_text(patch: Column) -> Column:
    """Lower-cased added lines, joined by newlines."""
    keep = F.filter(lines(patch), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.lower(F.array_join(keep, "\n"))


def token_counts(patch: Column) -> dict[str, Column]:
    """Each token as a substring of the added lines."""
    return {t: occurrences(added_text(patch), t) for t in TOKENS}


def changed_lines(patch: Column) -> Column:
    """New-side line numbers that the hunk headers name; a missing count is 1,
    a count of 0 names none."""
    start, count = F.regexp_extract_all(patch, F.lit(HUNK), F.lit(1)), F.regexp_extract_all(patch, F.lit(HUNK), F.lit(2))
    size = lambda c: F.when(c == "", 1).otherwise(F.try_to_number(F.coalesce(F.nullif(c, F.lit("")), F.lit("1")), F.lit("999999999")).cast("long"))
    pairs = F.zip_with(start, count, lambda s, c: F.struct(s.cast("long").alias("s"), size(c).cast("long").alias("n")))
    return F.flatten(F.transform(pairs, lambda p: F.when(p["n"] > 0, F.sequence(p["s"], p["s"] + p["n"] - 1)).otherwise(F.array().cast("array<long>"))))


def definition_delta(patch: Column) -> Column:
    """Added minus removed lines that begin a function or a class."""
    net = lambda word: occurrences(patch, f"\n+{word} ") - occurrences(patch, f"\n-{word} ")
    return net("def") + net("class")


def longest_changed_line(patch: Column) -> Column:
    changed = F.filter(F.split(patch, "\n"), lambda x: x.startswith("+") | x.startswith("-"))
    return F.coalesce(F.array_max(F.transform(changed, lambda x: F.length(x))), F.lit(0))


def line_contexts(patch: Column, reach: int = 3) -> Column:
    """For each added line, itself with `reach` lines either side, newline-joined."""
    def contexts(all_: Column) -> Column:
        added = lambda i: F.get(all_, i - 1).startswith("+") & ~F.get(all_, i - 1).startswith("+++")
        from_ = lambda i: F.greatest(i - reach, F.lit(1))
        return F.transform(F.filter(F.sequence(F.lit(1), F.size(all_)), added), lambda i: F.array_join(F.slice(all_, from_(i), i + reach - from_(i) + 1), "\n"))

    return once(F.split(patch, "\n"), contexts)
