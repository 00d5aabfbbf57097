"""Reconciliation: stored figures against their components, as problems with a level.

`error` hides a tab, `warn` is told, `flag` annotates the sections that print the cells. A rule is one scan: it counts what it checked and
what failed, and names the first cells only, in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import MAX_CELLS, bad_cell, near, ratio, truthy

PROBLEM = "tab string, level string, rule_id string, text string, sections array<string>, cells array<string>, more_cells int, emit_ord int"


def first_of(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, name: str, most: int = MAX_CELLS) -> DataFrame:
    """(by, name): the first texts of each group in order. Spark ranks inside each task and lets `most` rows of a group through before it shuffles, so no group's rows meet."""
    w = W.partitionBy(*by).orderBy(*order)
    few = rows.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= most)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", text))).alias("__few")).select(*by, F.transform("__few", lambda x: x[text]).alias(name))


@dataclass(frozen=True)
class Identity:
    """stored = numerator / denominator within max(floor, relative * |expected|)."""

    rule_id: str
    stored: str
    numerator: str
    denominator: str
    label: str
    means: str
    floor: float = 0.02
    relative: float = 1e-6
    #: a null numerator skips the row; else it counts as 0
    needs_numerator: bool = True
    #: a null stored value skips the row; else it fails
    needs_stored: bool = False


def checked(rows: DataFrame, rule: Identity) -> DataFrame:
    """Adds expected and bad for the rows that the identity applies to."""
    applies = truthy(rule.denominator)
    if rule.needs_numerator:
        applies = applies & F.col(rule.numerator).isNotNull()
    if rule.needs_stored:
        applies = applies & F.col(rule.stored).isNotNull()
    want = ratio(rule.numerator, rule.denominator)
    out = rows.where(applies).withColumn("expected", want)
    bound = F.greatest(F.lit(rule.floor), F.abs("expected") * rule.relative)
    return out.withColumn("bad", ~near(rule.stored, "expected", bound))


def identity(rows: DataFrame, rule: Identity, by: Sequence[str] = (), order: Sequence[str] = ("row",), cell: str | None = None) -> DataFrame:
    """Counts and the first failing cells, for each group."""
    c = checked(rows, rule)
    keys = list(by)
    if not keys:
        keys, c = ["__all"], c.withColumn("__all", F.lit(0))
    told = c.withColumn("__text", bad_cell(F.col(cell) if cell else F.lit(None).cast("string"), rule.stored, "expected"))
    n = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_checked"), F.count_if("bad").alias("n_bad"))
    if not by:  # no row to check is a row of zeros
        n = c.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if("bad").alias("n_bad")).withColumn("__all", F.lit(0))
    both = n.join(first_of(told.where("bad"), keys, order, "__text", "cells"), keys, "left")
    none = F.array().cast("array<string>")
    return both.select(*by, "n_checked", "n_bad", F.coalesce("cells", none).alias("cells"), F.greatest(F.lit(0), F.col("n_bad") - MAX_CELLS).cast("int").alias("more_cells"))


def children_vs_total(children: DataFrame, parents: DataFrame, key: str, value: str, total: str, tolerance: float = 0.05, cents: bool = True) -> DataFrame:
    """Parents with the sum of their children; `bad` where both exist and differ, `missing` where there are no children.

    cents: values are exact cents, so that sums do not depend on their order; a sheet's numbers need not be.
    """
    own = F.sum(F.col(value).cast("decimal(18,2)")).cast("double") if cents else F.sum(value)
    sums = children.groupBy(key).agg(own.alias("child_sum"), F.count(F.lit(1)).alias("n_children"))
    both = parents.join(sums, key, "left")
    missing = F.col("n_children").isNull()
    return both.withColumn("missing", missing).withColumn("bad", ~missing & ~near(total, F.coalesce("child_sum", F.lit(0.0)), tolerance))


def problems_by_level(problems: DataFrame, by: Sequence[str] = ("tab",)) -> DataFrame:
    counts = [F.count_if(F.col("level") == level).alias(f"n_{level}") for level in ("error", "warn", "flag")]
    return problems.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("n_problems"))


def publishable(tabs: DataFrame, problems: DataFrame) -> DataFrame:
    """Tabs without an error; warnings and flags do not hide one."""
    return tabs.join(problems.where("level = 'error'").select("tab").distinct(), "tab", "left_anti")
