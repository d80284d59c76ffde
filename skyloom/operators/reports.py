"""Request logs: exact percentiles that scale, and the rollup of a load run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.storage import stage

SUMMARY_ROWS = ("Aggregated", "Total")


def exact_percentiles(df: DataFrame, group: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per group, one column each.

    ``percentile`` would gather every distinct value of a group in one task. Here the counts
    per value are laid out in ranges of (group, value); sums per range tell in which of them
    a rank lies, and only those ranges are numbered. A task holds one range, whatever the
    size of a group. The ranges are stored with their number, so a task that is run again
    cannot draw them anew.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    counts = rows.groupBy(*group, "v").agg(F.count("*").alias("n"))
    ranges = counts.repartitionByRange(*group, "v").withColumn("range", F.spark_partition_id())
    ranges = stage(ranges, "value-ranges")

    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*group, "range").agg(F.sum("n").alias("held"))
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    sums = sums.withColumn("total", F.sum("held").over(Window.partitionBy(*group)))
    asked = F.array(*[F.struct(F.lit(n).alias("which"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()])
    exact = F.col("p") * (F.col("total") - 1)
    wanted = (
        sums.select("*", F.inline(asked))
        .withColumn("first_rank", F.floor(exact))
        .withColumn("last_rank", F.ceil(exact))
        .withColumn("part", exact - F.floor(exact))
        .filter((F.col("start") <= F.col("last_rank")) & (F.col("first_rank") < F.col("start") + F.col("held")))
        .drop("p", "total", "held")
    )
    inside = ranges.join(wanted, [*group, "range"])
    before = Window.partitionBy(*group, "range", "which").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0)))

    def at(rank: str) -> Column:
        here = (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("start") + F.col("n"))
        return F.max(F.when(here, F.col("v")))

    found = inside.groupBy(*group, "which").agg(
        at("first_rank").alias("a"), at("last_rank").alias("b"), F.first("part").alias("t")
    )
    value_at = F.col("a") + (F.col("b") - F.col("a")) * F.col("t")
    return found.groupBy(*group).agg(
        *[F.max(F.when(F.col("which") == name, value_at)).alias(name) for name in probabilities]
    )


# Upper limits (exclusive) of the report's labels, and the limits of its hints.
FAILURE_LABELS = ((1, "EXCELLENT"), (5, "ACCEPTABLE"))
RESPONSE_LABELS = ((200, "EXCELLENT"), (500, "ACCEPTABLE"))
WORST_LABEL = "POOR"
SLOW_QUERY_MS, MANY_FAILURES_PCT = 300, 2


def labelled(column: str, limits) -> Column:
    """The label of the first limit above the value; the worst one without."""
    fitting = [F.when(F.col(column) < limit, F.lit(label)) for limit, label in limits]
    return F.coalesce(*fitting, F.lit(WORST_LABEL))


def request_rollup(log: DataFrame) -> DataFrame:
    """Per task name: requests, failures and rate, mean, p95, p99, requests per second.

    ``log`` has name, response_ms, failed, at. Rows of an embedded summary are dropped.
    """
    log = log.filter(~F.col("name").isin(*SUMMARY_ROWS))
    span = log.agg(F.timestamp_diff("SECOND", F.min("at"), F.max("at")).alias("seconds"))
    base = log.groupBy("name").agg(
        F.count("*").alias("requests"),
        F.count_if("failed").alias("failures"),
        F.try_divide(
            F.sum(F.round(F.col("response_ms") * 100).cast("bigint")) / 100, F.count("response_ms")
        ).alias("mean_ms"),
    )
    tails = exact_percentiles(log, ["name"], "response_ms", {"p95_ms": 0.95, "p99_ms": 0.99})
    return (
        base.join(tails, "name", "left")
        .join(F.broadcast(span))
        .withColumn("failure_pct", F.col("failures") / F.col("requests") * 100)
        .withColumn("requests_per_s", F.when(F.col("seconds") > 0, F.col("requests") / F.col("seconds")))
        .drop("seconds")
    )


def run_summary(rollup: DataFrame) -> DataFrame:
    """One row for the run: totals, graded failure rate and mean response, slowest task.

    The mean response is the mean over tasks, as the per-task report states it.
    """
    out = rollup.agg(
        F.sum("requests").alias("requests"),
        F.sum("failures").alias("failures"),
        F.avg("mean_ms").alias("mean_ms"),
        F.sum("requests_per_s").alias("requests_per_s"),
        F.max_by("name", F.struct("mean_ms", "name")).alias("slowest"),
    ).withColumn("failure_pct", F.when(F.col("requests") > 0, F.col("failures") / F.col("requests") * 100))
    return (
        out.withColumn("failure_grade", labelled("failure_pct", FAILURE_LABELS))
        .withColumn("response_grade", labelled("mean_ms", RESPONSE_LABELS))
        .withColumn("check_queries", F.col("mean_ms") > SLOW_QUERY_MS)
        .withColumn("check_errors", F.col("failure_pct") > MANY_FAILURES_PCT)
    )


def latency_percentiles(log: DataFrame, config: list[str], budget_ms: float = 200) -> DataFrame:
    """p50, p95 and requests over budget per configuration."""
    over = log.groupBy(*config).agg(
        F.count("*").alias("samples"), F.count_if(F.col("response_ms") > budget_ms).alias("over_budget")
    )
    return over.join(exact_percentiles(log, config, "response_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), config)
