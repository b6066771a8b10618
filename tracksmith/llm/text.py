"""Small text helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it; bytes.split() splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is the empty text."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo parts: the documented split of labelled rows."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % parts


def n_words(text: str | Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null and blank texts have 0."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def own_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one that no column of df has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, {}
    for n in names:
        free = f"_{n}"
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out[n] = free
    return out
