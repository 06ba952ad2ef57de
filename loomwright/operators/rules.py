"""Ordered rules, overrides and checks, as column expressions and checked small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.ranges import checked_rules


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that is found in the text."""
    chain = reduce(lambda x, r: F.when(text.rlike(r[0]), r[1]) if x is None else x.when(text.rlike(r[0]), r[1]), rules, None)
    return F.lit(default) if chain is None else chain.otherwise(default)


def relabel(value: Column, labels: dict, default: str) -> Column:
    """value -> label, `default` for values without one."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in the order given; a check that is null doesn't."""
    return F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda x: x.isNotNull())


def outcome(ok: Column, benign: Column) -> Column:
    """ok, benign (a failure that is expected) or failed."""
    return F.when(ok, "ok").when(benign, "benign").otherwise("failed")


def override(rows: DataFrame, overrides: DataFrame, keys: list[str], value: str, corrected: str) -> DataFrame:
    """rows with value replaced where overrides (keys, corrected; a checked small table, one row a key) hold one, and `overridden`."""
    x = rows.join(checked_rules(overrides.select(*keys, F.col(corrected).alias("__new"), F.lit(True).alias("__hit"))), keys, "left")
    x = x.withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value)))
    return x.withColumn("overridden", F.coalesce("__hit", F.lit(False))).drop("__new", "__hit")


def outside(rows: DataFrame, value: str, excluded: list[str]) -> DataFrame:
    """rows whose value holds none of the substrings; null values stay."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.col(value), F.lit(x)) for x in excluded], F.lit(False))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def names_after(text: Column, titles: list[str]) -> Column:
    """The different capitalised words that follow one of the titles, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(titles)}) ([A-Z][a-z]+)"), 1))


def features(text: Column) -> dict[str, Column]:
    """Measures of a text: words, lines, lines that aren't blank, and how many of those repeat another."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return {
        "n_words": F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda x: x != "")).cast("long"),
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
        "n_full": F.size(lines).cast("long"),
        "n_repeats": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def cut_tail(text: Column, formula: str) -> Column:
    """The text before the first line that holds the closing formula; the whole text without one."""
    return F.regexp_extract(text, rf"(?s)\A(.*?)(?:(?:(?<=\n)|\A)[^\n]*{formula}|\z)", 1)
