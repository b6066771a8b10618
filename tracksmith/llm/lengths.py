"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer questions for every context limit."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.session import bounded_batches, written

#: Lengths in one window task.
RANGE = 1024


@lru_cache(2)
def encoding(ranks_file: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_length(docs: DataFrame, ranks_file: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text; null and empty texts have 0."""
    bounded_batches(docs.sparkSession, 512)

    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        encode = encoding(ranks_file).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, length(F.col(text)))


def length_histogram(lengths: DataFrame, length: str = "n_tokens", by: list[str] | None = None) -> DataFrame:
    """Rows by length (and the columns of by): by, n_tokens, n_docs. A null length counts as 0. Empty: empty."""
    return lengths.groupBy(*(by or []), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each length that occurs, what holds for every limit from limit_from to n_tokens (limits between two lengths included).

    docs_at_least, tokens_at_least: of documents of this length or longer. docs_below, tokens_below: of the shorter ones.
    truncated_total: tokens left if documents are cut at n_tokens; for a limit c in the interval it is
    tokens_below + c * docs_at_least. Sums run within ranges of RANGE lengths, and over one row per range.
    """
    by = by or []
    h = histogram.select(*by, "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / RANGE).alias("range"))
    h = written(h, "histogram")
    ranges = h.groupBy(*by, "range").agg(F.sum("n_docs").alias("docs_r"), F.sum("tokens").alias("tokens_r"), F.max("n_tokens").alias("last_r"))
    low = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = ranges.select(*by, "range", zero(F.sum("docs_r").over(low)).alias("docs_0"), zero(F.sum("tokens_r").over(low)).alias("tokens_0"), F.max("last_r").over(low).alias("last_0"), F.sum("docs_r").over(every).alias("docs_all"), F.sum("tokens_r").over(every).alias("tokens_all"))
    inside = Window.partitionBy(*by, "range").orderBy("n_tokens")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for c in [*by, "range"]:
        same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"r.{c}"))
    own = h.select("*", zero(F.sum("n_docs").over(before)).alias("docs_i"), zero(F.sum("tokens").over(before)).alias("tokens_i"), F.lag("n_tokens").over(inside).alias("last_i"))
    j = own.alias("h").join(ranges.alias("r"), same)
    docs_below, tokens_below = F.col("docs_0") + F.col("docs_i"), F.col("tokens_0") + F.col("tokens_i")
    return j.select(
        *[F.col(f"h.{c}").alias(c) for c in by],
        "n_tokens",
        "n_docs",
        (F.coalesce("last_i", "last_0", F.lit(-1)) + 1).alias("limit_from"),
        docs_below.alias("docs_below"),
        tokens_below.alias("tokens_below"),
        (F.col("docs_all") - docs_below).alias("docs_at_least"),
        (F.col("tokens_all") - tokens_below).alias("tokens_at_least"),
        (tokens_below + F.col("n_tokens") * (F.col("docs_all") - docs_below)).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_cut (longer than the limit), truncated_total for any limits, without reading documents again."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(c),) for c in limits], "limit long")
    hit = wanted.join(sums, F.col("limit").between(F.col("limit_from"), F.col("n_tokens")), "left")
    whole = sums.agg(F.max(F.struct("n_tokens", (F.col("tokens_below") + F.col("tokens_at_least")).alias("all")))["all"]).first()[0] or 0
    beyond = F.col("n_tokens").isNull()
    cut = F.col("docs_at_least") - F.when(F.col("limit") == F.col("n_tokens"), F.col("n_docs")).otherwise(0)
    return hit.select("limit", F.when(beyond, 0).otherwise(cut).alias("docs_cut"), F.when(beyond, F.lit(whole)).otherwise(F.col("tokens_below") + F.col("limit") * F.col("docs_at_least")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of the documents does not exceed (exact)."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(float(q),) for q in shares], "share double")
    ranked = sums.withColumn("up_to", F.col("docs_below") + F.col("n_docs")).withColumn("all", F.col("docs_below") + F.col("docs_at_least"))
    need = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("all")))
    return wanted.join(ranked, (F.col("docs_below") < need) & (F.col("up_to") >= need)).select("share", "n_tokens")
