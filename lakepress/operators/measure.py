"""Run logs and what is told about them: totals, caches, rings, rotation, costs, recall, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepress.functions.text import format_count, format_savings, recalled, savings_percent

RING = 50


def newest(runs: DataFrame, n: int = RING, order: str = "seq") -> DataFrame:
    """The newest n runs: a top-k, which keeps n rows of each task."""
    return runs.orderBy(F.desc(order)).limit(n)


def session_totals(runs: DataFrame, last_n: int | None = RING, order: str = "seq") -> DataFrame:
    """Requests, accepted, tokens over accepted, savings, the last run's reason; over a ring or (None) over all."""
    rows = newest(runs, last_n, order) if last_n else runs
    hit = F.col("accepted")
    out = rows.agg(
        F.count("*").alias("requests"),
        F.count_if(hit).alias("accepted_runs"),
        F.coalesce(F.sum(F.when(hit, F.col("original_tokens"))), F.lit(0)).alias("original_tokens"),
        F.coalesce(F.sum(F.when(hit, F.col("compressed_tokens"))), F.lit(0)).alias("compressed_tokens"),
        F.max_by(F.coalesce("fallback_reason", F.lit("accepted")), order).alias("last_outcome"),
    )
    return out.withColumns({"saved_tokens": F.col("original_tokens") - F.col("compressed_tokens"), "savings_percent": savings_percent(F.col("original_tokens"), F.col("compressed_tokens"))})


def usage_totals(usage: DataFrame) -> DataFrame:
    """Sums of input, output, cache_read and cache_write (missing counts as 0), and the share of input read from cache."""
    names = ("input", "output", "cache_read", "cache_write")
    sums = usage.agg(*[F.coalesce(F.sum(F.coalesce(F.col(n), F.lit(0))), F.lit(0)).alias(n) for n in names])
    return sums.withColumn("cache_hit_percent", hit_percent(F.col("cache_read"), F.col("input")))


def hit_percent(hits: Column, others: Column) -> Column:
    return F.when(hits + others > 0, F.floor(hits / (hits + others) * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def memo_hit_percent(decisions: DataFrame) -> DataFrame:
    """How often the handler's memo knew a text, over all decisions."""
    sums = decisions.agg(F.coalesce(F.sum("memo_hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("memo_misses"), F.lit(0)).alias("misses"))
    return sums.withColumn("memo_hit_percent", hit_percent(F.col("hits"), F.col("misses")))


def status_line(totals: DataFrame) -> DataFrame:
    return totals.select(F.concat(F.lit("req "), F.col("requests").cast("string"), F.lit(" · accepted "), F.col("accepted_runs").cast("string"), F.lit(" · "), format_savings(F.col("savings_percent")), F.lit(" · saved "), format_count(F.col("saved_tokens")), F.lit(" tok")).alias("status"))


_RANGE = "__range"


def _ranges(rows: DataFrame, order: str, ranges: int = 64) -> Column:
    """The range of a number, by approximate quantiles of its column: a window over a whole table would be one task."""
    bounds = sorted(set(rows.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.005)))
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= F.col(order))) if bounds else F.lit(0)


def _before(rows: DataFrame, value: str, order: str, group: str | None, newest_first: bool, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` (and `out`_n, the number) over all rows before each in the order; without a group range by range of the order."""
    by = F.desc(order) if newest_first else F.asc(order)
    if group:
        over = Window.partitionBy(group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({out: F.coalesce(F.sum(value).over(over), F.lit(0)), f"{out}_n": F.count(value).over(over)})
    ranged = rows.withColumn(_RANGE, _ranges(rows, order))
    sums = ranged.groupBy(_RANGE).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))  # a row for each range
    across = Window.orderBy(F.desc(_RANGE) if newest_first else F.asc(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(_RANGE, F.coalesce(F.sum("__s").over(across), F.lit(0)).alias("__s"), F.coalesce(F.sum("__c").over(across), F.lit(0)).alias("__c"))
    over = Window.partitionBy(_RANGE).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(sums), _RANGE)
    return joined.withColumns({out: F.col("__s") + F.coalesce(F.sum(value).over(over), F.lit(0)), f"{out}_n": F.col("__c") + F.count(value).over(over)}).drop(_RANGE, "__s", "__c")


def kept_after_rotation(lines: DataFrame, max_bytes: int, keep_bytes: int, order: str = "n", line: str = "line", group: str | None = None) -> DataFrame:
    """If a log has more than `max_bytes`, its newest whole lines of `keep_bytes` in sum, one at least; else all."""
    parts = [group] if group else []
    sized = lines.withColumn("__size", (F.octet_length(line) + 1).cast("long"))
    total = sized.groupBy(*parts).agg(F.sum("__size").alias("__total"))
    joined = sized.join(total, parts) if parts else sized.crossJoin(F.broadcast(total))  # one row on the other side
    over = joined.where(F.col("__total") > max_bytes)
    held = _before(over, "__size", order, group, True, "__newer").where((F.col("__newer") + F.col("__size") <= keep_bytes) | (F.col("__newer_n") == 0))
    return joined.where(F.col("__total") <= max_bytes).select(*lines.columns).unionByName(held.select(*lines.columns))


def with_cost_cap(calls: DataFrame, cap: float, price_in: float, price_out: float, order: str = "seq", group: str | None = None, free: Column | None = None) -> DataFrame:
    """usd, capped: calls in order until the costs so far reach the cap; later ones are skipped and cost nothing, `free` ones always go."""
    cost = F.col("input") / F.lit(1e6) * F.lit(price_in) + F.col("output") / F.lit(1e6) * F.lit(price_out)
    cost = F.when(free, F.lit(0.0)).otherwise(cost) if free is not None else cost
    rows = _before(calls.withColumn("__usd", cost), "__usd", order, group, False, "__before")
    over = F.col("__before") >= cap
    over = over & ~free if free is not None else over
    return rows.withColumns({"capped": over, "usd": F.when(over, F.lit(0.0)).otherwise(F.col("__usd"))}).drop("__usd", "__before", "__before_n")


def with_recall(pairs: DataFrame, answer: str = "answer", needles: str = "needles") -> DataFrame:
    """recall_percent and the first five needles that an answer lacks; 100 without needles."""
    lost = F.filter(needles, lambda n: ~recalled(F.col(answer), n))
    rows = pairs.withColumn("__lost", lost)
    n = F.size(needles)
    recall = F.when(n == 0, F.lit(100.0)).otherwise(F.floor((n - F.size("__lost")) / n * 1000 + 0.5) / 10)
    return rows.withColumns({"recall_percent": recall, "missed": F.slice("__lost", 1, 5)}).drop("__lost")


def ranked_lanes(solo: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lanes of each text by savings, then by tokens (more first), then in the order of the lanes."""
    order = Window.partitionBy(key).orderBy(F.desc("savings_percent"), F.desc("compressed_tokens"), "lane_no")
    return solo.withColumn("place", F.row_number().over(order))


def _worth() -> Column:
    return ~F.col("rejected") & (F.col("output") != F.col("input"))


def comparable(solo: DataFrame) -> DataFrame:
    """Steps worth judging: not rejected, and with a changed output."""
    return solo.where(_worth())


def with_verdicts(rows: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(verdicts, key, "left")


def savings_report(steps: DataFrame) -> DataFrame:
    """Steps, rejects, steps worth judging, and tokens by engine and over all."""
    return steps.rollup("engine").agg(
        F.count("*").alias("steps"),
        F.count_if("rejected").alias("rejected"),
        F.count_if(_worth()).alias("comparable"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("compressed_tokens").alias("compressed_tokens"),
    )
