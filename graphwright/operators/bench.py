"""Statistics of benchmark results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.sources.scratch import stored

Z = 1.96


def agent_metrics(results: DataFrame, keys: tuple[str, ...] = ("agent", "bench")) -> DataFrame:
    """Means of a group's results (reward, latency, input_tokens, output_tokens); n_tasks counts all rows, nulls are left out of means."""
    names = [c for c in ("reward", "latency", "input_tokens", "output_tokens", "tool_calls", "turns") if c in results.columns]
    return results.groupBy(*keys).agg(F.count("*").alias("n_tasks"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in names])


def compare(metrics: DataFrame, base: str, other: str, value: str, agent: str = "agent", bench: str = "bench") -> DataFrame:
    """Per benchmark of either agent: both means, their difference and the change in percent (null on a base of zero)."""
    a = metrics.where(F.col(agent) == base).select(bench, F.col(value).alias("base_value"))
    b = metrics.where(F.col(agent) == other).select(bench, F.col(value).alias("other_value"))
    out = a.join(b, bench, "full")
    return out.withColumn("delta", F.col("other_value") - F.col("base_value")).withColumn("change_pct", F.try_divide(F.col("delta") * 100.0, F.col("base_value")))


def score(results: DataFrame, *keys: str, reward: str = "reward") -> DataFrame:
    """Passed (reward 1 or more), partial, failed, pass rate and mean reward."""
    r = F.coalesce(F.col(reward).cast("double"), F.lit(0.0))
    out = results.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(r >= 1).alias("passed"), F.count_if((r > 0) & (r < 1)).alias("partial"), F.count_if(r <= 0).alias("failed"), F.avg(r).alias("avg_reward"))
    return out.withColumn("pass_rate", F.col("passed") / F.col("n"))


def wilson(passed: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson interval of a share, within 0 and 1, to 4 places; 0 and 0 for no trials."""
    p, z2 = passed / n, Z * Z
    centre, half = p + z2 / (2 * n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    low, high = (F.least(F.greatest((centre + s * half) / (1 + z2 / n), F.lit(0.0)), F.lit(1.0)) for s in (-1, 1))
    return tuple(F.when(n > 0, F.round(x, 4)).otherwise(0.0) for x in (low, high))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The two-sided p-value of a 2 by 2 table of counts: the sum over tables with the same margins that are no likelier."""

    def p_value(a: int, b: int, c: int, d: int) -> float:
        n, row, column = a + b + c + d, a + b, a + c
        whole = sum(map(math.lgamma, (row + 1, n - row + 1, column + 1, n - column + 1))) - math.lgamma(n + 1)
        log = lambda x: whole - sum(math.lgamma(k + 1) for k in (x, row - x, column - x, n - row - column + x))
        seen = log(a)
        return min(1.0, sum(math.exp(v) for x in range(max(0, row + column - n), min(row, column) + 1) if (v := log(x)) <= seen + 1e-7))

    def batches(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for table in columns:
            yield pd.Series([p_value(*map(int, row)) for row in zip(*table, strict=True)], dtype=float)

    batches.__annotations__ = {"columns": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "double")(a, b, c, d)


def chi_square(passed_a: Column, n_a: Column, passed_b: Column, n_b: Column) -> Column:
    """The approximate chi-square of two shares, to 4 places: how far the first's passes are from those expected, less a half, squared, by
    those expected but at least 0.01; null without trials."""
    n = n_a + n_b
    expected = F.try_divide(n_a * (passed_a + passed_b), n)
    gap = F.abs(passed_a - expected) - 0.5
    return F.round(gap * gap / F.greatest(expected, F.lit(0.01)), 4)


def merge_first(results: DataFrame, key: str = "task_id", source: str = "dir_ord", tie: str | None = None) -> DataFrame:
    """One row for each task: that of the first source. An aggregation, so that a task with very many rows is reduced before its rows meet."""
    others = [c for c in results.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(source, *([tie] if tie else [])))
    return results.groupBy(key).agg(first.alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in results.columns])


def attempts(rows: DataFrame, task: str = "task_id", attempt: str = "attempt", reward: str = "reward", counted: str = "counted") -> DataFrame:
    """Best counted reward, the attempt that got it first, and the number of the next attempt."""
    best = F.max(F.when(F.col(counted), F.col(reward)))
    first = F.max_by(F.when(F.col(counted), F.col(attempt)), F.when(F.col(counted), F.struct(F.col(reward), -F.col(attempt))))
    return rows.groupBy(task).agg(best.alias("best_reward"), first.alias("best_attempt"), (F.max(attempt) + 1).alias("next_attempt"))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, price_in_high: Column | None = None, price_out_high: Column | None = None, tier: int = 200_000) -> Column:
    """Price of tokens at rates for a million; beyond `tier` tokens of input the high rates, where given, hold for all."""
    high = tokens_in > tier
    a = F.when(high, F.coalesce(price_in_high, price_in)).otherwise(price_in) if price_in_high is not None else price_in
    b = F.when(high, F.coalesce(price_out_high, price_out)).otherwise(price_out) if price_out_high is not None else price_out
    return (tokens_in * a + tokens_out * b) / 1_000_000


#: Accuracy of the sketches, and how far around a rank a bracket reaches, in hundredths of the rows.
SKETCH, AROUND = 800, 2
#: Distinct values of a bracket that are put in order.
BRACKET = 5_000


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, extremes and nearest-rank percentiles: the value at places n*50 div 100 and n*99 div 100, from 0. Nulls don't count.

    A quantile sketch for each key, merged from those of the tasks, brackets the value of a place. An exact count of the rows below and inside says whether the bracket holds it, and a
    bracket with more than BRACKET distinct values is sketched again and narrowed; one that misses the place is widened. Only the distinct values of the last brackets, at most BRACKET for a place, are ever put in
    order, however many rows a key has.
    """
    v = F.col(value)
    held = rows.where(v.isNotNull()).select(*keys, value)
    number = F.when(~F.isnan(v.cast("double")), v.cast("double"))
    totals = held.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(v.cast("double")) / F.count("*")).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(number).alias("_m"), F.kll_sketch_agg_double(number, F.lit(SKETCH)).alias("_sketch"))
    totals = stored(totals)
    at = F.explode(F.array(F.lit(50), F.lit(99)))

    def bracket(place: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """The ends of a bracket around a place among n rows that a sketch has seen; the given ends where it would reach beyond them, or where values that aren't numbers would be cut off."""
        grid = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / 100) for i in range(101)]))
        i, j = (F.floor(place * 100 / n) - AROUND).cast("int"), (F.ceil(place * 100 / n) + AROUND).cast("int")
        known = F.col("_m") > 0
        return F.when(known & (i > 0), grid[F.greatest(i, F.lit(0))]).otherwise(low), F.when(known & (F.col("_m") == n) & (j < 100), grid[F.least(j, F.lit(100))]).otherwise(high)

    open_ = totals.select(*keys, "n", "min", "max", "_m", "_sketch", at.alias("_p")).withColumn("_place", F.floor(F.col("n") * F.col("_p") / 100))
    # an end that is null is open
    none = F.lit(None).cast("double")
    low, high = bracket(F.col("_place"), F.col("n"), none, none)
    open_ = stored(open_.select(*keys, "_p", "_place", low.alias("_low"), high.alias("_high")))
    found = []
    while True:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"r.{k}"))
        d = F.col(f"r.{value}").cast("double")
        joined = held.alias("r").join(open_.alias("b"), same).select(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("_p"), F.col("_place"), F.col("_low"), F.col("_high"), F.col(f"r.{value}").alias(value), (F.col("_low").isNotNull() & (d < F.col("_low"))).alias("_below"))
        joined = joined.withColumn("_inside", ~F.col("_below") & (F.col("_high").isNull() | (F.col(value).cast("double") <= F.col("_high"))))
        group = [*keys, "_p", "_place", "_low", "_high"]
        inner = F.when(F.col("_inside") & ~F.isnan(v.cast("double")), v.cast("double"))
        sums = stored(joined.groupBy(*group).agg(F.count_if("_below").alias("_b"), F.count_if("_inside").alias("_i"), F.count(inner).alias("_m"), F.approx_count_distinct(F.when(F.col("_inside"), v)).alias("_d"), F.kll_sketch_agg_double(inner, F.lit(SKETCH)).alias("_sketch")))
        hit = (F.col("_b") <= F.col("_place")) & (F.col("_place") < F.col("_b") + F.col("_i"))
        # a bracket of one value is as narrow as it gets, and so is one that didn't narrow
        next_low, next_high = bracket(F.col("_place") - F.col("_b"), F.col("_i"), F.col("_low"), F.col("_high"))
        told = stored(sums.select(*group, "_b", "_d", hit.alias("_hit"), F.when(hit & (F.col("_d") > BRACKET), next_low).otherwise(F.col("_low")).alias("_to_low"), F.when(hit & (F.col("_d") > BRACKET), next_high).otherwise(F.col("_high")).alias("_to_high")))
        still = F.col("_to_low").eqNullSafe(F.col("_low")) & F.col("_to_high").eqNullSafe(F.col("_high"))
        ready = told.where(F.col("_hit") & ((F.col("_d") <= BRACKET) | still))
        same = F.lit(True)
        for k in (*keys, "_p"):
            same = same & F.col(f"j.{k}").eqNullSafe(F.col(f"t.{k}"))
        counted = joined.where("_inside").groupBy(*keys, "_p", "_place", value).agg(F.count("*").alias("_c"))
        picked = counted.alias("j").join(ready.alias("t"), same).groupBy(*[F.col(f"j.{k}").alias(k) for k in (*keys, "_p")], F.col("j._place").alias("_place"), F.col("t._b").alias("_b")).agg(F.array_sort(F.collect_list(F.struct(F.col(f"j.{value}").alias("v"), F.col("j._c").alias("c")))).alias("_values"))
        kind = held.schema[value].dataType
        fold = F.aggregate("_values", F.struct(F.col("_b").alias("up"), F.lit(None).cast(kind).alias("v")), lambda s, x: F.struct((s["up"] + x["c"]).alias("up"), F.when(s["v"].isNull() & (s["up"] + x["c"] > F.col("_place")), x["v"]).otherwise(s["v"]).alias("v")))
        found.append(stored(picked.select(*keys, "_p", fold["v"].alias("_v"))))
        left = told.where(~(F.col("_hit") & ((F.col("_d") <= BRACKET) | still)))
        open_ = stored(left.select(*keys, "_p", "_place", F.when(F.col("_hit"), F.col("_to_low")).otherwise(none).alias("_low"), F.when(F.col("_hit"), F.col("_to_high")).otherwise(none).alias("_high")))
        if open_.isEmpty():
            break
    values = reduce(DataFrame.union, found).groupBy(*keys).agg(F.max(F.when(F.col("_p") == 50, F.col("_v"))).alias("p50"), F.max(F.when(F.col("_p") == 99, F.col("_v"))).alias("p99"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return totals.alias("a").join(values.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.n", "a.avg", "a.min", "a.max", "b.p50", "b.p99")


def rate_limited(message: Column) -> Column:
    """Whether an error is one of rate limits, to be tried again."""
    low = F.lower(message)
    return F.contains(low, F.lit("rate limit")) | F.contains(low, F.lit("429")) | F.contains(low, F.lit("ratelimiterror")) | F.contains(low, F.lit("too many requests"))


def knowledge_yield(nodes: DataFrame, dimensions: DataFrame, skills: int) -> DataFrame:
    """Nodes of each dimension, zero where there are none, and how many that is for a skill."""
    counts = nodes.groupBy("dimension").agg(F.count("*").alias("n"))
    return dimensions.join(counts, "dimension", "left").select("dimension", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / max(skills, 1)).alias("density"))


def compare_agents(metrics: DataFrame, base: str, other: str, agent: str = "agent", bench: str = "bench") -> DataFrame:
    """Per benchmark of either agent: difference of accuracy, percent fewer tokens, percent change of latency; null where an agent lacks the benchmark or the base is zero.

    metrics: (agent, bench, accuracy, avg_total_tokens, avg_latency_ms).
    """
    side = lambda name, x: metrics.where(F.col(agent) == name).select(bench, *[F.col(c).cast("double").alias(f"{x}_{c}") for c in ("accuracy", "avg_total_tokens", "avg_latency_ms")])
    rows = side(base, "a").join(side(other, "b"), bench, "full")
    tokens = F.try_divide((F.col("a_avg_total_tokens") - F.col("b_avg_total_tokens")) * 100, F.col("a_avg_total_tokens"))
    latency = F.try_divide((F.col("b_avg_latency_ms") - F.col("a_avg_latency_ms")) * 100, F.col("a_avg_latency_ms"))
    return rows.select(bench, (F.col("b_accuracy") - F.col("a_accuracy")).alias("accuracy_delta"), tokens.alias("token_reduction_pct"), latency.alias("latency_delta_pct"))


def overall(comparison: DataFrame) -> DataFrame:
    """The plain means over benchmarks of `compare_agents`."""
    return comparison.agg(F.avg("accuracy_delta").alias("accuracy_delta"), F.avg("token_reduction_pct").alias("token_reduction_pct"))


def tool_counts(results: DataFrame, bench: str = "bench", tools: str = "tool_names") -> DataFrame:
    """(bench, tool, n): how often each tool was used."""
    return results.select(bench, F.explode(tools).alias("tool")).groupBy(bench, "tool").agg(F.count("*").alias("n"))


def pair_tasks(a: DataFrame, b: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, reward and passed of both, class): tasks of either agent. A task in which both have no reward at all failed for want of
    infrastructure; the rest tells of skill."""
    side = lambda df, x: df.select(task, F.col("reward").cast("double").alias(f"{x}_reward"), F.col("passed").alias(f"{x}_passed"))
    rows = side(a, "a").join(side(b, "b"), task, "full")
    rows = rows.withColumns({f"{x}_{c}": F.coalesce(f"{x}_{c}", F.lit(none)) for x in "ab" for c, none in (("reward", 0.0), ("passed", False))})
    return rows.withColumn("class", F.when((F.col("a_reward") == 0) & (F.col("b_reward") == 0), "infrastructure_failure").otherwise("skill_knowledge"))


def chart_statistics(pairs: DataFrame) -> DataFrame:
    """(scope, n, passed, rate and interval of both): over all tasks, and over those that tell of skill."""
    rows = pairs.select(F.explode(F.when(F.col("class") == "skill_knowledge", F.array(F.lit("all"), F.lit("skill_only"))).otherwise(F.array(F.lit("all")))).alias("scope"), "a_passed", "b_passed")
    out = rows.groupBy("scope").agg(F.count("*").alias("n"), F.count_if("a_passed").alias("a_n"), F.count_if("b_passed").alias("b_n"))
    for x in "ab":
        low, high = wilson(F.col(f"{x}_n"), F.col("n"))
        out = out.withColumns({f"{x}_rate": F.round(F.col(f"{x}_n") / F.col("n"), 4), f"{x}_low": low, f"{x}_high": high})
    return out


def token_efficiency(base_tokens: Column, other_tokens: Column) -> Column:
    """Percent fewer input tokens; null on a base of zero."""
    return F.when(base_tokens > 0, (base_tokens - other_tokens) / base_tokens * 100)


def case_summary(results: DataFrame, case: str = "case") -> DataFrame:
    """(case, total, passed, avg_reward) by case: the best reward, else the reward, else none; sorted."""
    reward = F.coalesce(*[F.col(c).cast("double") for c in ("best_reward", "reward") if c in results.columns], F.lit(0.0))
    return results.groupBy(case).agg(F.count("*").alias("total"), F.count_if(reward >= 1).alias("passed"), F.avg(reward).alias("avg_reward")).orderBy(case)


def coverage_summary(shares: DataFrame, target: float = 95.0) -> DataFrame:
    """(n, avg, below, reached) of coverage shares (doc_id, share), each to one place: how many, their mean, how many are below the target, and whether the mean reaches it."""
    share = F.round("share", 1)
    return shares.agg(F.count("*").alias("n"), F.coalesce(F.avg(share), F.lit(0.0)).alias("avg"), F.count_if(share < target).alias("below")).withColumn("reached", F.col("avg") >= target)


def report(comparison: DataFrame, tools: DataFrame | None = None) -> str:
    """A comparison as Markdown; benchmarks are few, so their rows go to the driver."""
    number = lambda v: "n/a" if v is None else f"{v:.2f}"
    rows = comparison.orderBy("bench").collect()
    lines = ["# Comparison", "", "| Benchmark | Accuracy delta | Token reduction % | Latency delta % |", "|---|---|---|---|"]
    lines += [f"| {r.bench} | {number(r.accuracy_delta)} | {number(r.token_reduction_pct)} | {number(r.latency_delta_pct)} |" for r in rows]
    mean = overall(comparison).first()
    lines += ["", "## Overall", "", f"- Accuracy delta: {number(mean.accuracy_delta)}", f"- Token reduction: {number(mean.token_reduction_pct)} %"]
    if tools is not None:
        lines += ["", "## Tools", "", *(f"- {r.bench}: {r.tool} {r.n}" for r in tools.orderBy("bench", F.desc("n"), "tool").collect())]
    return "\n".join(lines) + "\n"


# Seconds to wait after each of some rate-limit errors in a row, and how many in a row end a run.
BACKOFF, MOST_IN_A_ROW = (5, 10, 20, 60, 120), 5


def backoff(errors: int) -> int | None:
    """Seconds to wait after so many rate-limit errors in a row; None if the run is to end."""
    return None if errors >= MOST_IN_A_ROW else BACKOFF[min(max(errors, 1), len(BACKOFF)) - 1]
