"""Profiles of a corpus: counts, shares, moments, quantiles and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.plans.dims import sized
from siftstone.plans.scratch import materialise

#: Ranges into which a group's values are cut to find quantiles.
QUANTILE_RANGES = 64
METRICS = ("nloc", "complexity", "token_count", "top_nesting_level")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n_rows), nulls not counted."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))


def top_values(df: DataFrame, column: str, k: int, total: Column | None = None) -> DataFrame:
    """The ``k`` most frequent values, ties by value, with their percentage of ``total`` (all counted rows)."""
    counts = value_counts(df, column).withColumn("__total", F.sum("n_rows").over(Window.partitionBy()) if total is None else total)
    return counts.withColumn("pct", F.round(100 * F.col("n_rows") / F.col("__total"), 6)).drop("__total").orderBy(F.desc("n_rows"), column).limit(k)


def with_domain(counts: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts for each value of ``domain``, 0 where there is none."""
    known = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    held = counts.where(F.col(column).isin(list(domain)))  # no more rows than the domain
    return known.join(F.broadcast(held), column, "left").select(column, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def present(df: DataFrame, metrics: Sequence[str]) -> list[str]:
    """Those of ``metrics`` that ``df`` has as columns, in the order given."""
    return [m for m in metrics if m in df.columns]


def long_form(df: DataFrame, ids: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """(ids, metric, value): one row per row and metric, nulls kept; metrics that ``df`` lacks are left out."""
    metrics = present(df, metrics)
    if not metrics:
        return df.select(*ids, F.lit("").alias("metric"), F.lit(0.0).alias("value")).limit(0)
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(ids), list(metrics), "metric", "value")


def numeric_summary(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per metric that ``df`` has: sum, sum of squares, least, most, mean over all rows and mean over rows with a value."""
    parts, metrics = [], present(df, metrics)
    if not metrics:
        return df.sparkSession.createDataFrame([], "metric string, total bigint, total_sq bigint, least bigint, most bigint, mean_all double, mean_known double")
    for m in metrics:
        x = F.col(m).cast("bigint")
        parts.append(
            F.struct(
                F.lit(m).alias("metric"), F.sum(x).alias("total"), F.sum(x * x).alias("total_sq"), F.min(x).alias("least"), F.max(x).alias("most"),
                F.round(F.try_divide(F.sum(x).cast("double"), F.count("*")), 6).alias("mean_all"), F.round(F.avg(x), 6).alias("mean_known"),
            )
        )
    return df.agg(*[p.alias(f"__{i}") for i, p in enumerate(parts)]).select(F.explode(F.array(*[f"__{i}" for i in range(len(parts))])).alias("s")).select("s.*")


def exact_quantiles(rows: DataFrame, groups: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(groups, n_values, q0, q1, ...): quantiles of ``value`` by linear interpolation, nulls not counted.

    Equal values are counted first. A sketch then cuts each group's values into ranges, their counts tell in which ranges the
    wanted ranks lie, and only these are sorted, each on its own: no task holds a group, and the result is exact wherever the
    sketch cuts. A group without values has no row.
    """
    keys = list(groups)
    counted = materialise(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c")), "counted")
    cuts = F.percentile_approx("__v", [k / QUANTILE_RANGES for k in range(1, QUANTILE_RANGES)], 10 * QUANTILE_RANGES)
    edges = materialise(counted.groupBy(*keys).agg(F.array_distinct(cuts).alias("__edges"), F.sum("__c").alias("n_values")), "edges")  # one row a group
    known = [F.col(k) for k in keys]

    def beside(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, *more])], *[c for c in right.columns if c not in (*keys, *more)])
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, *more])])
        return left.join(sized(named), on).drop(*[f"__k{i}" for i in range(len(keys) + len(more))])

    ranged = beside(counted, edges).withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")
    ranks = [(F.lit(p) * (F.col("n_values") - 1)) for p in fractions]
    wanted = [f(r).cast("bigint") for r in ranks for f in (F.floor, F.ceil)]
    starts = ranged.groupBy(*keys, "__b").agg(F.sum("__c").alias("__held"), F.max("n_values").alias("n_values"))
    starts = starts.withColumn("__start", F.sum("__held").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__held"))
    hit = reduce(or_, [(w >= F.col("__start")) & (w < F.col("__start") + F.col("__held")) for w in wanted])
    picked = materialise(starts.where(hit).select(*keys, "__b", "__start"), "starts")
    upto = F.col("__start") + F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__v"))
    placed = beside(ranged, picked, "__b").withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__c"))
    at = placed.groupBy(*known, "n_values").agg(*[F.max(F.when((w >= F.col("__from")) & (w < F.col("__to")), F.col("__v"))).alias(f"__w{i}") for i, w in enumerate(wanted)])
    part = [r - F.floor(r) for r in ranks]
    return at.select(*keys, "n_values", *[((1 - f) * F.col(f"__w{2 * i}") + f * F.col(f"__w{2 * i + 1}")).alias(f"q{i}") for i, f in enumerate(part)])


def box_statistics(rows: DataFrame, group: str, metric: str = "metric", value: str = "value", iqr: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation) and whiskers (the most extreme values within ``iqr`` quartile ranges)."""
    known = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull() & F.col(metric).isNotNull())
    q = exact_quantiles(known, [group, metric], value, (0.25, 0.5, 0.75))
    q = q.select(group, metric, "n_values", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    fenced = known.join(sized(materialise(q, "quartiles")), [group, metric])  # one row a class and metric
    spread = F.lit(iqr) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - spread) & (F.col(value) <= F.col("q3") + spread)
    return fenced.where(inside).groupBy(group, metric, "n_values", "q1", "median", "q3").agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))


def correlations(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(metric_a, metric_b, r): Pearson's r of each pair of metrics that ``df`` has, over rows where both are known."""
    pairs = list(combinations(present(df, metrics), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "metric_a string, metric_b string, r double")
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.round(f"__{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def printed(df: DataFrame, widths: dict[str, int], digits: int = 2) -> DataFrame:
    """``df`` with ``line``: its columns as fixed-width text, as a console report shows them.

    Whole numbers get thousands separators, other numbers ``digits`` decimals as well, columns named ``pct`` a percent sign; text stands
    left, numbers right. Null shows as a dash; longer text is cut to its width.
    """
    cells = []
    for name, width in widths.items():
        kind = df.schema[name].dataType.simpleString()
        whole, number = kind in ("tinyint", "smallint", "int", "bigint"), kind in ("float", "double") or kind.startswith("decimal")
        text = F.format_number(name, 0 if whole else digits) if whole or number else F.col(name).cast("string")
        if name == "pct":
            text = F.concat(text, F.lit("%"))
        cells.append((F.lpad if whole or number else F.rpad)(F.coalesce(text, F.lit("-")), width, " "))
    return df.withColumn("line", F.concat_ws(" ", *cells))
