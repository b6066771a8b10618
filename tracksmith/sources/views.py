"""Event tables as pure expressions over the star-schema tables, and their SQL twins for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksmith.session import together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per energy deposit: many small events. hit_id numbers an event's hits over all its columns."""
    # in queries that deal their tables by event, hits are dealt the same way from the start
    li = together(table(spark, sf_dir, "lineitem").withColumn("event_id", F.col("l_orderkey")))
    order = Window.partitionBy("event_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return li.select(
        "event_id",
        (F.col("l_quantity") - 25.5).alias("x"),
        (F.col("l_partkey") % 50 - 24.5).alias("y"),
        (F.col("l_suppkey") % 50 - 24.5).alias("z"),
        (F.col("l_extendedprice") / 1e5).alias("energy"),
        F.unix_timestamp("l_shipdate").cast("double").alias("time"),
        F.col("l_returnflag").alias("label"),
        (F.col("l_linenumber") % 2 + 1).alias("particle_id"),
        F.row_number().over(order).alias("hit_id"),
    )


HITS = """hits as (
  select l_orderkey as event_id, l_quantity - 25.5 as x, l_partkey % 50 - 24.5::double as y, l_suppkey % 50 - 24.5::double as z,
         l_extendedprice / 1e5 as energy, epoch(l_shipdate)::double as time, l_returnflag as label, l_linenumber % 2 + 1 as particle_id,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as hit_id
  from lineitem)"""


def hits_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few events of many hits each."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("event_id"), F.col("l_quantity").alias("x"), F.rint(F.col("l_discount") * 500).alias("y"), F.rint(F.col("l_tax") * 500).alias("z"), (F.col("l_extendedprice") / 1e5).alias("energy"))


HITS_DENSE = "hits as (select l_suppkey as event_id, l_quantity as x, round_even(l_discount * 500, 0) as y, round_even(l_tax * 500, 0) as z, l_extendedprice / 1e5 as energy from lineitem)"


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("event_id"),
        F.when(F.col("l_returnflag") == "A", "alpha").otherwise("electron").alias("particle_name"),
        (F.col("l_linenumber") - 1).alias("mother_id"),
        (F.col("l_extendedprice") / 1e5).alias("kin_energy"),
        (F.col("l_quantity") - 25.5).alias("initial_x"),
        (F.col("l_partkey") % 50 - 24.5).alias("initial_y"),
        (F.col("l_suppkey") % 50 - 24.5).alias("initial_z"),
        F.col("l_linestatus").alias("final_volume"),
    )


PARTICLES = """particles as (
  select l_orderkey as event_id, case when l_returnflag = 'A' then 'alpha' else 'electron' end as particle_name, l_linenumber - 1 as mother_id,
         l_extendedprice / 1e5 as kin_energy, l_quantity - 25.5 as initial_x, l_partkey % 50 - 24.5::double as initial_y, l_suppkey % 50 - 24.5::double as initial_z,
         l_linestatus as final_volume
  from lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with truth: text length against the quality label."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("signal"))


SCORES = "scores as (select d.doc_id, d.n_chars::double as score, l.quality = 1 as signal from documents d join labels l using (doc_id))"


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("sensor"), F.col("value").alias("charge"))


SENSORS = "sensors as (select event_id, user_id as sensor, value as charge from events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation counts by isotope and zone: orders stand in for files."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("isotope"), F.col("o_orderpriority").alias("zone"), (F.col("o_orderkey") % 1000 + 1000).alias("generated"), (F.col("o_orderkey") % 97 + 10).alias("saved"), (F.col("o_custkey") % 7 + 1).alias("single"))


SAMPLES = "samples as (select o_orderstatus as isotope, o_orderpriority as zone, o_orderkey % 1000 + 1000 as generated, o_orderkey % 97 + 10 as saved, o_custkey % 7 + 1 as single from orders)"
