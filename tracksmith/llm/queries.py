"""The registered queries of this package: each applies one operator to its whole table and returns contract columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import centroids, kdtree_shards, lengths, media, mixing, packing, pieces, prefix_trie, quality_knn, rans, robust, simhash, toxicity
from tracksmith.llm.text import documents, fold, labels

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's quality; labels of held-out rows are never seen."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    known = labels(spark, sf_dir).where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality_knn.score(docs, quality_knn.fit(docs, known))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among pictures of all pages; the tables hold no pictures, so the pages are drawn."""
    found = media.image_copies(media.page_images(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select(F.col("id").alias("page_id"), "class_id", "n_links", "n_points")


def op3_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    placed = kdtree_shards.kdtree_shards(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; the digest columns are derived from ids and decoded text."""
    coded = pieces.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), PIECES)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return coded.select("doc_id", "n_pieces", F.crc32(ids.cast("binary")).alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "exact")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's toxicity; labels of held-out rows are never seen."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    known = labels(spark, sf_dir).where(fold("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, known))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as blocks, read the blocks back, and digest what was read."""
    return rans.round_trip(documents(spark, sf_dir), WORD_BPE, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.quality_rules(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    return lengths.suffix_sums(lengths.length_histogram(lengths.with_length(documents(spark, sf_dir).select("text"), BYTE_BPE)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE_JSON, BYTE_BPE, 1024, with_ids=False)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = r"""
with d as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as key
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as rank from d group by source),
w as (select *, case (rank - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, (3 * source_size)::double as cap from s),
l as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level
  from w),
c as (select min_by(level, (cap / weight, rank)) as common from l where level * weight <= cap),
t as (select source, source_size, case when common is null then cap else least(cap, common * weight) end as target from l, c),
p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size, d.text rows between unbounded preceding and 1 preceding), 0)::bigint as starts_at
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when source_size = 0 then 0 else budget // source_size * size
             + least(size, greatest(0, budget - budget // source_size * source_size - starts_at)) end)::bigint as taken
from p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_knn": op1_quality_knn,
        "op2_media_copies": op2_media_copies,
        "op3_kdtree_shards": op3_kdtree_shards,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_toxicity": op5_toxicity,
        "op6_rans": op6_rans,
        "op7_simhash": op7_simhash,
        "op8_quality_rules": op8_quality_rules,
        "op9_mixing": op9_mixing,
        "op10_token_counts": op10_token_counts,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_packing": op12_packing,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL, "op13_centroids": centroids.oracle_sql()}
