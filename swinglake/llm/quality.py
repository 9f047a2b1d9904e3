"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose measure is above a cutoff. For every stratum (a language) and rule, cutoffs are tested
from the loosest on against the labelled holdout: a cutoff holds if, were its true rate of false rejections alpha, the
exact binomial chance of as few rejected good texts as were seen is at most delta. Testing ends at the first cutoff that
fails, so all that passed hold together (fixed sequence). Each rule has its share of alpha and of delta, and delta is
divided by the number of strata as well (weighted Bonferroni): with probability 1 - delta, in every stratum no rule
rejects more than its share of alpha of the good texts, so all rules together at most alpha. Of the cutoffs that hold, the one that rejects the most bad texts,
less ``cost`` for each share of good ones, is taken. A stratum with too few labels has no cutoff and rejects nothing.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a stratum of its own; null
qualities are no labels, several labels of an id count as the largest; rows that repeat an id are measured each for
itself; an empty table gives an empty result; without labels only the base rule rejects; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import table, written

SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*BASE, "n_lines", "n_marks", "n_upper"]
MARKS = re.compile(r"[!?]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")

#: Rules by name: SQL of a measure that is larger for worse texts, the top of the grid (0, top] on which cutoffs are
#: tested, and the rule's share of alpha and of delta (they sum to 1).
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 2.0, 0.4),
    "marks": ("n_marks / greatest(n_words, 1)", 2.0, 0.3),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 1.0, 0.1),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1.0, 0.1),
    "capitals": ("n_upper / greatest(word_chars, 1)", 1.0, 0.1),
}
GRID = 40


def measures(text: str | None) -> tuple[int, ...]:
    """MEASURES of a whole text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\f\r"))
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()] if "\n" in text else ([text] if n else [])
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            twice = np.fromiter((counts[w] > 1 for w in windows), bool, n - 2)
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= twice
            repeated = int(inside.sum())
    return (
        n,
        len(text) - spaces,
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(MARKS.findall(text)),
        len(UPPER.findall(text)),
    )


def measured(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of every row with MEASURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([measures(t.as_py()) for t in b.column(len(columns))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *(pa.array(values[:, k]) for k in range(len(MEASURES)))], [*columns, *MEASURES])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in columns], *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    return rows.mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial of n trials with chance p."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    x = np.arange(k + 1)
    logs = lgamma(n + 1) - np.array([lgamma(i + 1) + lgamma(n - i + 1) for i in x]) + x * np.log(p) + (n - x) * np.log1p(-p)
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound on a rate of which k of n were seen, at confidence 1 - delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def select_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, cost: float) -> int:
    """Of the histograms of good and bad texts over grid cells, the cell above which texts are rejected; the last rejects none."""
    n, m = int(good.sum()), int(bad.sum())
    if not n or not m:
        return len(good) - 1
    over_good, over_bad = n - np.cumsum(good), m - np.cumsum(bad)
    best, best_gain = len(good) - 1, 0.0
    for cell in range(len(good) - 1, -1, -1):
        if binomial_tail(int(over_good[cell]), n, alpha) > delta:
            break
        gain = over_bad[cell] / m - cost * over_good[cell] / n
        if gain > best_gain + 1e-12:
            best, best_gain = cell, gain
    return best


def _cell(rule: str) -> Column:
    """The grid cell of a measure: cell c holds (c - 1, c] grid steps, and the last all that is above."""
    sql, top, _ = RULES[rule]
    return F.least(F.ceil(F.expr(sql) * (GRID / top)), F.lit(GRID)).cast("int")


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str, stratum: str, alpha: float = 0.05, delta: float = 0.05, cost: float = 10.0) -> DataFrame:
    """(s, rule, cell, n_good, false_rate_bound) of each stratum with labels. ``rows``: id, s, MEASURES, base_failed."""
    known = labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("__q")).where("__id IS NOT NULL AND __q IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("__q").alias("__q"))
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), _cell(r).alias("cell")) for r in RULES])
    held = rows.where("NOT base_failed").join(known, F.col(id_col) == F.col("__id")).select(F.col(stratum).alias("s"), "__q", F.explode(cells).alias("c"))
    counts = (
        held.groupBy("s", "c.rule", "c.cell")
        .agg(F.count_if(F.col("__q") > 0).alias("good"), F.count_if(F.col("__q") <= 0).alias("bad"))
    )
    counts = written(counts, "quality-counts")
    strata = max(1, counts.select("s").distinct().count())

    def select(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(GRID + 1, int), np.zeros(GRID + 1, int)
        np.add.at(good, group["cell"].to_numpy(), group["good"].to_numpy())
        np.add.at(bad, group["cell"].to_numpy(), group["bad"].to_numpy())
        share = RULES[group["rule"].iloc[0]][2]
        chance = delta * share / strata
        cell = select_cutoff(good, bad, alpha * share, chance, cost)
        n = int(good.sum())
        bound = upper_bound(n - int(good[: cell + 1].sum()), n, chance) if n else 1.0
        return pd.DataFrame({"s": [group["s"].iloc[0]], "rule": [group["rule"].iloc[0]], "cell": [cell], "n_good": [n], "false_rate_bound": [bound]})

    # a group has at most GRID + 1 rows
    return counts.groupBy("s", "rule").applyInPandas(select, "s string, rule string, cell int, n_good long, false_rate_bound double")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **control) -> DataFrame:
    """One row per document: id, MEASURES, base_failed, failed (names of rules), kept."""
    source = docs.withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("n")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(measured(source, [id_col, "__s"], text_col).withColumn("base_failed", failed), "quality-measures")
    found = cutoffs(rows, labels, id_col, "__s", **control)
    wide = written(found.groupBy(F.col("s").alias("__s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cell"))).alias("__cut")), "quality-cutoffs")
    over = [F.when(_cell(r) > F.coalesce(F.try_element_at("__cut", F.lit(r)), F.lit(GRID)), F.lit(r)) for r in RULES]
    return (
        rows.join(wide, "__s", "left")
        .withColumn("failed", F.array_compact(F.array(*over)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .select(id_col, *MEASURES, "base_failed", "failed", "kept")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))
