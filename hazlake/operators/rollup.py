"""Operational rollups of scored reports.

Each rollup is one aggregation: tier, severity and precursor counters are plain conditional sums,
combined before the shuffle, so a location holding a third of all rows is no harder than a small
one. The most frequent precursors are then picked inside the result row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.functions.lookups import LEVELS, TIERS
from hazlake.functions.numbers import percent, round_even, round_half_up
from hazlake.functions.taxonomy import TAXONOMY, Precursor
from hazlake.functions.text import year_month


def _counters(taxonomy: Sequence[Precursor], order_col: str) -> list[Column]:
    cols = []
    for pos, entry in enumerate(taxonomy, 1):
        has = F.array_contains("factors", entry.factor)
        cols.append(F.count_if(has).alias(f"_n{pos}"))
        cols.append(F.min(F.when(has, F.col(order_col))).alias(f"_first{pos}"))
    return cols


def _ranked(taxonomy: Sequence[Precursor]) -> Column:
    """Precursors seen in the group: most frequent first, ties by first appearance."""
    seen = F.array(
        *[
            F.struct(
                (-F.col(f"_n{pos}")).alias("rank"),
                F.col(f"_first{pos}").alias("first"),
                F.lit(pos).alias("position"),
                F.lit(entry.label).alias("precursor"),
                F.col(f"_n{pos}").alias("n"),
            )
            for pos, entry in enumerate(taxonomy, 1)
        ]
    )
    return F.array_sort(F.filter(seen, lambda s: s["n"] > 0))


def _group_key(name: str, default: str) -> Column:
    text = F.trim(F.col(name))
    return F.when(text.isNull() | (text == ""), default).otherwise(text)


def group_rollup(
    scored: DataFrame,
    key: str,
    default: str = "Unknown",
    order_col: str = "row_index",
    taxonomy: Sequence[Precursor] = TAXONOMY,
    top: int = 4,
) -> DataFrame:
    """Totals, high and critical shares, mean score, severity counts and top precursors per key."""
    level = F.upper(F.trim("severity_level"))
    known = F.when(level.isin(*LEVELS), level).otherwise("I")
    grouped = scored.groupBy(_group_key(key, default).alias(key)).agg(
        F.count("*").alias("total_reports"),
        F.count_if(F.col("score") >= 50).alias("high_risk_reports"),
        F.count_if(F.col("score") >= 75).alias("critical_risk_reports"),
        F.sum("score").alias("_score"),
        *[F.count_if(known == lvl).alias(f"severity_{lvl.lower()}") for lvl in LEVELS],
        *_counters(taxonomy, order_col),
    )
    total = F.col("total_reports")
    return grouped.select(
        key,
        "total_reports",
        "high_risk_reports",
        "critical_risk_reports",
        percent(F.col("high_risk_reports"), total).alias("high_risk_percentage"),
        percent(F.col("critical_risk_reports"), total).alias("critical_risk_percentage"),
        round_even(F.col("_score") / total, 1).alias("average_risk_score"),
        *[f"severity_{lvl.lower()}" for lvl in LEVELS],
        F.transform(
            F.slice(_ranked(taxonomy), 1, top),
            lambda s: F.struct(s["precursor"].alias("precursor"), s["n"].alias("count")),
        ).alias("top_precursors"),
    )


def location_rollup(scored: DataFrame, **options) -> DataFrame:
    return group_rollup(scored, "location", "Unknown", **options)


def department_rollup(scored: DataFrame, **options) -> DataFrame:
    rolled = group_rollup(scored, "industry_sector", "General Industrial", **options)
    return rolled.withColumn("department", F.col("industry_sector"))


def largest_first(rolled: DataFrame, key: str) -> DataFrame:
    return rolled.orderBy(F.desc("total_reports"), key)


def trend_summary(
    scored: DataFrame, order_col: str = "row_index", taxonomy: Sequence[Precursor] = TAXONOMY
) -> DataFrame:
    """One row of counters per month, from which the trend is read; rows of two sets of reports can be merged."""
    dated = scored.withColumn("period", year_month(F.trim("date_logged"))).filter("period IS NOT NULL")
    return dated.groupBy("period").agg(
        F.count("*").alias("total_reports"),
        F.count_if(F.col("score") >= 50).alias("high_risk_count"),
        F.count_if(F.col("score") >= 75).alias("critical_risk_count"),
        F.sum("score").alias("_score"),
        *_counters(taxonomy, order_col),
    )


def merge_trends(summaries: DataFrame) -> DataFrame:
    """Summaries of several sets of reports as one row per month: counters add up, first places are the smallest."""
    return summaries.groupBy("period").agg(
        *[(F.min if c.startswith("_first") else F.sum)(c).alias(c) for c in summaries.columns if c != "period"]
    )


def read_trend(summary: DataFrame, taxonomy: Sequence[Precursor] = TAXONOMY) -> DataFrame:
    return summary.select(
        "period",
        "total_reports",
        "high_risk_count",
        "critical_risk_count",
        round_even(F.col("_score") / F.col("total_reports"), 1).alias("average_risk_score"),
        F.coalesce(F.try_element_at(_ranked(taxonomy), F.lit(1))["precursor"], F.lit("None")).alias("top_precursor"),
    )


def monthly_trend(
    scored: DataFrame, order_col: str = "row_index", taxonomy: Sequence[Precursor] = TAXONOMY
) -> DataFrame:
    return read_trend(trend_summary(scored, order_col, taxonomy), taxonomy)


def global_distributions(
    scored: DataFrame, reports: DataFrame | None = None, taxonomy: Sequence[Precursor] = TAXONOMY
) -> DataFrame:
    """Long form ``(dimension, key, n)``. Fixed dimensions show zeros; sectors are those present.

    Reports are counted once, by sector; the few rows of that table give all dimensions.
    ``reports`` are the rows before scoring, so that counting texts does not score them again.
    """
    level = F.upper(F.trim("severity_level"))
    known = F.when(level.isin(*LEVELS), level).otherwise("I")
    by_sector = scored.groupBy(_group_key("industry_sector", "General Industrial").alias("sector")).agg(
        F.count("*").alias("total"),
        *[F.count_if(known == lvl).alias(f"s{i}") for i, lvl in enumerate(LEVELS)],
        *[F.count_if(F.col("tier") == t).alias(f"t{i}") for i, t in enumerate(TIERS)],
        *[F.count_if(F.array_contains("factors", e.factor)).alias(f"p{i}") for i, e in enumerate(taxonomy)],
    )
    cells = (
        [("reports", F.lit("total"), "total"), ("sector", F.col("sector"), "total")]
        + [("severity", F.lit(lvl), f"s{i}") for i, lvl in enumerate(LEVELS)]
        + [("tier", F.lit(t), f"t{i}") for i, t in enumerate(TIERS)]
        + [("precursor", F.lit(e.label), f"p{i}") for i, e in enumerate(taxonomy)]
    )
    rows = F.array(
        *[F.struct(F.lit(d).alias("dimension"), k.alias("key"), F.col(c).alias("n")) for d, k, c in cells]
    )
    counted = by_sector.select(F.inline(rows)).groupBy("dimension", "key").agg(F.sum("n").alias("n"))
    # a digest stands for the text, so that the distinct count does not shuffle whole texts
    source = scored if reports is None else reports
    texts = source.agg(F.count_distinct(F.unhex(F.sha2("cleaned_text", 256))).alias("n"))
    return counted.unionByName(
        texts.select(F.lit("reports").alias("dimension"), F.lit("distinct_texts").alias("key"), "n")
    )


def with_shares(rolled: DataFrame, count_col: str = "total_reports") -> DataFrame:
    """Share of the corpus and ratio to the largest group, in whole percent.

    ``rolled`` is read three times; pass a table that is written already.
    """
    total = rolled.agg(F.sum(count_col)).scalar()
    largest = rolled.agg(F.max(count_col)).scalar()
    count = F.col(count_col)
    return rolled.withColumn("corpus_percent", round_half_up(count / total * 100)).withColumn(
        "bar_percent", round_half_up(count / F.greatest(largest, F.lit(1)) * 100)
    )


def with_display_ratios(distributions: DataFrame) -> DataFrame:
    """Whole percents of the long distributions: of all reports, for precursors of the most frequent one.

    The few rows of ``distributions`` are read twice; pass a table that is written already. Without reports all are 0.
    """
    total = F.max(F.when((F.col("dimension") == "reports") & (F.col("key") == "total"), F.col("n")))
    largest = F.max(F.when(F.col("dimension") == "precursor", F.col("n")))
    basis = distributions.agg(
        F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)).alias("_total"),
        F.greatest(F.coalesce(largest, F.lit(0)), F.lit(1)).alias("_largest"),
    ).select(F.struct("*"))
    of = F.when(F.col("dimension") == "precursor", F.col("_basis._largest")).otherwise(F.col("_basis._total"))
    shares = distributions.withColumn("_basis", basis.scalar())
    return shares.withColumn("percent", round_half_up(F.col("n") / of * 100)).drop("_basis")


def with_high_share(trend: DataFrame) -> DataFrame:
    share = F.col("high_risk_count") / F.col("total_reports") * 100
    return trend.withColumn("high_risk_percent", round_half_up(share))
