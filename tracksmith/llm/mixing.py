"""Mixing sources to target weights by cutting hash-random orders at exact word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.llm.text import n_words, own_names
from tracksmith.session import written

#: Weights of the sources in order of their names, repeated as often as needed (fixed values).
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its own words.
MAX_EPOCHS = 3
#: Rows of one source in a range of keys: what one window task sorts.
RANGE_ROWS = 20_000


def random_key(doc_id: str | Column, seed: str = "mix") -> Column:
    """The id's hash-random key, 32 hex digits; a null id hashes as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(col.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) with each source's weight and target.

    Targets share the sum of all sizes by weight; none exceeds max_epochs times its source's size, the excess is shared
    again by weight until none does. In the order of max_epochs * size / weight the capped sources come first, so one running
    sum finds the level: level k holds if the k-th source still stands above it. One row per source, so the table is small.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    cap = (max_epochs * F.col("source_size")).cast("double")
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(max_epochs * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    level = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= cap)
    level = level.withColumn("common", F.min(F.when(F.col("fits"), F.struct((cap / F.col("weight")).alias("at"), "rank", "level"))).over(every)["level"])
    return level.select("source", "source_size", "weight", F.when(F.col("common").isNull(), cap).otherwise(F.least(cap, F.col("common") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", range_rows: int = RANGE_ROWS, extra: list[str] | None = None) -> DataFrame:
    """How much of every row the mix takes: doc_id, source, size, source_size, target, starts_at, epochs, part_words, taken.

    Rows of a source stand in the order of a hash-random key. starts_at is the number of words before a row in its source.
    A source gives whole epochs of all its rows, then one more up to its exact budget: part_words of the row at the cut, so a
    source's taken words are its target rounded down. taken = epochs * size + part_words.

    Null text: size 0, nothing taken. Null source: a source of its own, the last. Null and repeated ids share a key; ties
    are broken by size and text. Empty: empty. A corpus without words has targets 0.

    The order is cut into ranges of the key (all ranges are equally likely, so a hot source spreads over as many ranges as it
    has multiples of range_rows); a range is sorted in one task, and the ranges' sums are added up in a table of one row
    per range.
    """
    extra = extra or []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), random_key(F.col(doc_id), seed).alias("key"), *extra)
    rows = written(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n_ranges = F.ceil(F.col("n") / F.lit(range_rows)).cast("long")
    targets = source_targets(sources.select("source", "source_size"), weights, max_epochs)
    facts = written(sources.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.source_size", "target", n_ranges.alias("ranges")), "sources")
    in_source = F.col("r.source").eqNullSafe(F.col("f.source"))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32))).cast("long").alias("range")
    ranged = rows.alias("r").join(facts.alias("f"), in_source).select("r.*", "source_size", "target", at)
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # windows treat null as a value; joins need a name
    ranged = ranged.withColumn("s", named)
    sums = ranged.groupBy("s", "range").agg(F.sum("size").alias("range_size"))
    offsets = sums.select("s", "range", (F.sum("range_size").over(Window.partitionBy("s").orderBy("range")) - F.col("range_size")).alias("offset"))
    order = Window.partitionBy("s", "range").orderBy("key", "doc_id", "size", "tie", *extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("inside", F.sum("size").over(order) - F.col("size")).join(offsets, ["s", "range"]).withColumn("starts_at", F.col("offset") + F.col("inside"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), budget - F.col("epochs") * F.col("source_size") - F.col("starts_at")))
    taken = F.col("epochs") * F.col("size") + F.col("part_words")
    return placed.withColumn("epochs", epochs).withColumn("part_words", part).withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "starts_at", "epochs", "part_words", "taken", *extra)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows with docs' own columns, which may have any names: each row as often as its epochs say.

    The row at a source's cut is repeated once more with its first part_words words (one such row per source at most);
    a column n_chars, if docs have it, follows the cut text. Rows of which nothing is taken go. Rows alike in every column
    (but maps) are one to the plan: their copies are added up and made from one of them, dealt out over all tasks.
    """
    n = own_names(docs, "name", "copies", "part", "copy")
    own = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    plain += [c.isNull() for c in plain]
    name = F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit("name"), *plain).alias("b"))
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"), name.alias("name"))
    plan = mix(given, extra=["name"], **options).where("taken > 0")
    whole = (F.col("part_words") > 0) & (F.col("part_words") == F.col("size"))
    cut = F.when((F.col("part_words") > 0) & ~whole, F.col("part_words"))
    plan = plan.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("epochs") + whole.cast("long")).alias("copies"), F.max(cut).alias("part"))
    plan = written(plan.select(F.col("name").alias(n["name"]), "n", F.col("copies").alias(n["copies"]), F.col("part").alias(n["part"])), "plan")

    def copied(plan: DataFrame, alike: bool) -> DataFrame:
        rows = docs.join(plan.drop("n"), name == F.col(n["name"]))
        if alike:
            many = F.sequence(F.lit(0).cast("long"), F.floor(F.col(n["copies"]) / 1000))
            rows = rows.dropDuplicates([n["name"]]).withColumn(n["copy"], F.explode(many)).hint("rebalance")
            rows = rows.withColumn(n["part"], F.when(F.col(n["copy"]) == 0, F.col(n["part"]))).withColumn(n["copies"], F.least(F.lit(1000).cast("long"), F.col(n["copies"]) - 1000 * F.col(n["copy"])))
        copy = F.concat(F.array_repeat(F.lit(False), F.col(n["copies"]).cast("int")), F.when(F.col(n["part"]).isNotNull(), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
        return rows.select(*own, F.col(n["part"]), F.explode(copy).alias(n["copy"]))

    rows = copied(plan.where("n = 1"), False)
    if not (repeated := plan.where("n > 1")).isEmpty():
        rows = rows.unionByName(copied(repeated, True))
    here = f"`{text}`"
    words = F.expr(f"regexp_extract_all({here}, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    begun = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(n["part"]).cast("int"), F.lit(1))), "")
    is_cut = F.col(n["copy"])
    out = {text: F.when(is_cut, begun).otherwise(F.col(here))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(is_cut, F.length(begun).cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
