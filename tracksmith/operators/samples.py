"""Tables over several samples: matches, efficiency chains, comparisons, yields, statistics by selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.components import counted
from tracksmith.session import broadcast_if_small, written


def match_events(sets: dict[str, DataFrame], index: str) -> DataFrame:
    """event_id and for each set the index of the event's last row (greatest index), -1 where absent: full outer joins on event_id."""
    parts = [df.groupBy("event_id").agg(F.max(index).cast("long").alias(name)) for name, df in sets.items()]
    joined = reduce(lambda a, b: a.join(b, "event_id", "full_outer"), parts)
    return joined.select("event_id", *[F.coalesce(n, F.lit(-1)).alias(n) for n in sets])


def efficiency_chain(samples: DataFrame, group: list[str], generated: str, stages: list[str]) -> DataFrame:
    """Per group, subtotal and total (nulls, level > 0): summed counts, step efficiencies and the product, from summed counts."""
    sums = samples.rollup(*group).agg(F.grouping_id().alias("level"), F.sum(generated).alias(generated), *[F.sum(s).alias(s) for s in stages])
    last = generated
    for s in stages:
        sums = sums.withColumn(f"eff_{s}", F.when(F.col(last) > 0, F.col(s) / F.col(last)))
        last = s
    return sums.withColumn("eff_total", F.when(F.col(generated) > 0, F.col(stages[-1]) / F.col(generated)))


def pivot_ratio(df: DataFrame, group: list[str], column: str, values: list, measure: Column) -> DataFrame:
    """Group rows with one column per value, and the ratio of the first to the second value's measure."""
    p = df.groupBy(*group).pivot(column, values).agg(measure)
    a, b = (F.col(f"`{v}`") for v in values[:2])
    return p.withColumn("ratio", F.when(b != 0, a / b))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    out = df.groupBy(*(by or [])).agg(F.sum(F.col(value) * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    return out.select(*(by or []), F.when(F.col("w") != 0, F.col("s") / F.col("w")).alias("mean"), F.col("w").alias("weight"))


def comparison(summaries: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """The chosen columns of all summaries, numbers rounded."""
    kinds = dict(summaries.dtypes)
    return summaries.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def signal_background(df: DataFrame, sample: str, value: str, signal: str) -> DataFrame:
    """Ratio of the signal's value to each other sample's, and the rejection 1 / value; infinite where the value is 0.

    The signal is one row; it is joined by a constant key.
    """
    one = df.where(F.col(sample) == signal).agg(F.max(value).alias("__s"))
    rest = df.where(F.col(sample) != signal).join(F.broadcast(one), F.lit(True))  # one row, being an aggregate of all
    inf = F.lit(float("inf"))
    return rest.select(sample, value, F.when(F.col(value) == 0, inf).otherwise(F.col("__s") / F.col(value)).alias("ratio"), F.when(F.col(value) == 0, inf).otherwise(1 / F.col(value)).alias("rejection"))


def activities(df: DataFrame, part: str, activity: str, names: DataFrame) -> DataFrame:
    """Activities by mapped name; parts with one name (left and right) are added. names: part, name; others keep their own."""
    return df.join(names, part, "left").groupBy(F.coalesce("name", part).alias("name")).agg(F.sum(activity).alias("activity"))


def yearly(activity: DataFrame, efficiency: DataFrame, key: str = "name", seconds: float = 31_557_600.0) -> DataFrame:
    """Events produced and selected in a year by name, absent efficiencies 0, with a TOTAL row."""
    rows = activity.join(efficiency, key, "left").select(key, (F.col("activity") * seconds).alias("produced"), (F.col("activity") * seconds * F.coalesce("efficiency", F.lit(0.0))).alias("selected"))
    total = rows.agg(F.lit("TOTAL").alias(key), F.sum("produced").alias("produced"), F.sum("selected").alias("selected"))
    return rows.unionByName(total)


#: Parts of an interval that one pass of exact_median() counts, and the rows from which an interval is sorted instead.
PARTS, FEW_ROWS = 64, 4096


def exact_median(df: DataFrame, x: str, by: list[str], few: int = FEW_ROWS) -> DataFrame:
    """by, median: the mean of the two middle values of each group, exact; null values don't count.

    The interval that holds a middle rank is narrowed: a pass counts its rows in PARTS even parts and goes on with the extent of the
    values in the part that holds the rank, until these are one value or few rows. A group of any size is partial counts of PARTS
    rows, never sorted or gathered whole; values that repeat cost no further pass.
    """
    own, by = by, [f"k{i}" for i in range(len(by))]  # own names, so that none clashes
    rows = written(df.select(*[F.col(c).alias(k) for c, k in zip(own, by, strict=True)], F.col(x).cast("double").alias("x")).where("x is not null"), "values")
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rank = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))
    state = ends.select(*by, rank.alias("rank"), "n", "lo", "hi").distinct().withColumn("wanted", F.col("rank"))
    cols = [*by, "wanted", "rank", "n", "lo", "hi"]
    wide = F.col("open")
    state, n = counted(state.select(*cols, ((F.col("lo") < F.col("hi")) & (F.col("n") > few)).alias("open")), "intervals", "open")
    settled = [state.where(~wide)]
    part = F.least(F.lit(PARTS - 1), F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS))
    while n:
        inside = rows.join(broadcast_if_small(state.where(wide).select(*cols), 100_000), by).where("x >= lo and x <= hi")
        parts = inside.groupBy(*by, "wanted", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "wanted").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = parts.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).withColumn("rank", F.col("rank") - F.col("before"))
        state, n = counted(hit.select(*cols, ((F.col("lo") < F.col("hi")) & (F.col("n") > few)).alias("open")), "intervals", "open")
        settled.append(state.where(~wide))
    last = reduce(DataFrame.unionByName, settled)
    one = last.where("lo = hi").select(*by, "wanted", F.col("lo").alias("x"))
    inside = rows.join(broadcast_if_small(last.where("lo < hi").select(*cols), 100_000), by).where("x >= lo and x <= hi")
    nth = F.row_number().over(Window.partitionBy(*by, "wanted").orderBy("x")) - 1
    few_rows = inside.withColumn("nth", nth).where(F.col("nth") == F.col("rank")).select(*by, "wanted", "x")
    return one.unionByName(few_rows).groupBy(*by).agg(F.avg("x").alias("median")).select(*[F.col(k).alias(c) for c, k in zip(own, by, strict=True)], "median")


def selection_statistics(df: DataFrame, selected: str, columns: list[str]) -> DataFrame:
    """For selected, rest and all rows, by column: n, mean, std, least, greatest, median; missing values are dropped."""
    long = df.unpivot([selected], [F.col(c).cast("double").alias(c) for c in columns], "variable", "value").where("value is not null and not isnan(value)")
    part = F.explode(F.array(F.lit("all"), F.when(F.col(selected), "selected").otherwise("rest")))
    long = long.select("variable", part.alias("part"), "value")
    numbers = long.groupBy("variable", "part").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return numbers.join(exact_median(long, "value", ["variable", "part"]), ["variable", "part"]).select("variable", "part", "n", "mean", "std", "min", "max", "median")


def scan_statistics(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Mean and std of each variable by scan value, NaN and null dropped."""
    long = df.unpivot([by], [F.col(c).cast("double").alias(c) for c in columns], "variable", "value").where("value is not null and not isnan(value)")
    return long.groupBy(by, "variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def analysis_summary(df: DataFrame, columns: list[str], peaks: str) -> DataFrame:
    """By number of peaks: rows and mean, std, least and greatest of each column."""
    cols = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.groupBy(peaks).agg(F.count("*").alias("n"), *cols)
