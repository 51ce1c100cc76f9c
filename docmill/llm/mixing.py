"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Every source gets a target number of words. Each source also has a weight schedule over training time
``t`` in [0, 1]: ``w(t) = 1 + slope * (2t - 1)``, scaled to its target. Its integral is the source's
cumulative demand ``D(t) = target * (t + slope * (t^2 - t))``. The words of the source are laid out in a
fixed pseudo-random document order; a document that begins at word ``u`` of this layout is trained at
``t = D^-1(u)``, which has a closed form, and documents are range-sorted by that position.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words. A
target stops at twice its source's size; the excess is shared again by weight. That fixed point is
``min(2 * size, weight * level)``, and the level is found in one sorted pass over the sources.

Prefix sums do not meet in one task: documents are dealt to 4096 buckets of the order by the first hex
digits of the key's digest, buckets are summed before they are shuffled, and only the bucket sums of a
source (4096 at most) are scanned together.

Defined cases: null text has size 0; a source of size 0 has target 0; a null source is the last source; an
empty table gives no rows; repeated rows are separate documents and are equal in the order; very long texts
are counted whole; further columns are kept by :func:`mix_documents` and ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.shared import save

WEIGHTS = (3, 1, 2)
#: How each source's weight moves through training: up, down, level, repeating.
SLOPES = (0.5, -0.5, 0.0)
SHARE, MOST = 1.5, 2
#: Hex digits of the order key that name a bucket.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def _nth(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, slope from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit_level"), F.col("source").asc_nulls_last())
    ranked = (
        sources.select("*", (F.row_number().over(order) - 1).alias("nth"))
        .select(
            "source",
            "source_size",
            _nth(WEIGHTS, F.col("nth")).cast("long").alias("weight"),
            _nth(SLOPES, F.col("nth")).cast("double").alias("slope"),
        )
        .withColumn("limit_level", MOST * F.col("source_size") / F.col("weight").cast("double"))
    )
    below = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        (
            (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(MOST * F.col("source_size")).over(below), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))).cast("double")
        ).alias("level_here"),
        F.row_number().over(by_limit).alias("limit_rank"),
    )
    # Sources in order of their limit: the first whose limit isn't below the level left for it and the rest sets the level.
    level = F.min_by(
        F.when(F.col("level_here") <= F.col("limit_level"), F.col("level_here")),
        F.when(F.col("level_here") <= F.col("limit_level"), F.col("limit_rank")),
    ).over(everything)
    return levels.withColumn("level", level).select(
        "source",
        "source_size",
        "slope",
        F.round(
            F.least((MOST * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * F.col("level"), (MOST * F.col("source_size")).cast("double"))), 6
        ).alias("target"),
    )


def _sized(doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [
        doc_id.alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).alias("order_key"),
    ]


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and the order key; one pass over the texts, then only narrow rows."""
    return documents.select(*_sized(F.col("doc_id"), F.col("source"), F.col("text")))


def _place() -> list[Column]:
    """What a document's place in the order is dealt by: its source, never null, and its bucket."""
    return [F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("source_key"), F.left("order_key", F.lit(BUCKET_DIGITS)).alias("bucket")]


def _plan(sizes: DataFrame) -> DataFrame:
    """Of each source and bucket: its source's target and where the bucket's words begin."""
    targets = save(source_targets(sizes), "mix-targets")
    by_source = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        sizes.select("source", "size", *_place())
        .groupBy("source", "source_key", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .select(F.col("source").alias("own_source"), "source_key", "bucket", F.coalesce(F.sum("bucket_size").over(by_source), F.lit(0)).alias("start"))
    )
    return sums.join(targets, F.col("own_source").eqNullSafe(F.col("source"))).drop("source", "own_source")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, order_key and any others) with what the mix takes of each.

    The join and the window have the same keys, so that rows are shuffled once for both.
    """
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    return (
        rows.select("*", *_place())
        .join(plan, ["source_key", "bucket"])
        .withColumn("begins", F.col("start") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .withColumn("passes", passes)
        .withColumn("taken", F.col("passes") * F.col("size") + F.least(F.greatest(rest - F.col("begins"), F.lit(0)), F.col("size")))
        .withColumn("position", F.when((F.col("passes") > 0) | (rest > F.col("begins")), training_time(F.col("begins"))))
    )


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position of the first pass; a row per document, unsorted."""
    rows = save(sized(documents), "mix-sizes")
    return _taken(rows, _plan(rows)).select("doc_id", "source", "size", "source_size", "target", "taken", "position")


def mix_documents(documents: DataFrame) -> DataFrame:
    """Whole documents, all columns, as often as the mix passes over them, range-sorted by training position.

    A pass that takes less than half of a document, one at most in each source, is left out.
    """
    own = {c: f"own_{i}" for i, c in enumerate(documents.columns)}
    wide = documents.withColumnsRenamed(own).select("*", *_sized(F.col(own["doc_id"]), F.col(own["source"]), F.col(own["text"])))
    plan = save(_plan(save(sized(documents), "mix-sizes")), "mix-plan")
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    visits = (
        _taken(wide, plan).filter(F.col("taken") > 0)
        .select(*own.values(), "doc_id", "size", "taken", "begins", "source_size", "target", "slope", F.explode(F.sequence(F.lit(0), passes - 1)).alias("nth"))
        .filter(2 * (F.col("taken") - F.col("nth") * F.col("size")) >= F.col("size"))
        .withColumn("position", training_time(F.col("begins") + F.col("nth") * F.col("source_size")))
    )
    order = ["position", "doc_id", "nth"]
    return visits.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(x).alias(c) for c, x in own.items()])


def training_time(begins: Column) -> Column:
    """When the source's cumulative demand reaches word ``begins``: the inverse of t + slope * (t^2 - t)."""
    part, left = F.least(begins / F.col("target"), F.lit(1.0)), 1 - F.col("slope")
    return F.try_divide(2 * part, left + F.sqrt(left * left + 4 * F.col("slope") * part))


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents the mix leaves out come last."""
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
