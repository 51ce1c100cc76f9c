"""Extendible hashing: documents to shards by prefixes of a key's hash, in DataFrame operations only.

The directory is indexed by leading bits of the hash. A bucket whose documents exceed the byte limit is
split on one more bit, and only such buckets are. A bucket is final when its bytes fit or when all its rows
share one key, which no bit can part; rows of such a key are dealt to overflow pages instead, so that only
a single document larger than the limit can exceed it.

Bytes are summed by a cell of the finest depth looked at, with partial sums before the shuffle, then by
all ancestors of the cells; the buckets that fit and whose parent doesn't are spelt out as the cells below
them, which are the directory. Cells that don't fit at
that depth are looked at again, eight bits deeper. No step gathers documents: only cells, at most some
hundreds for each shard, are joined to narrow rows.

Defined cases: null text has 0 bytes; a null doc_id is keyed as the empty string; an empty table gives no
rows; repeated rows share a key and so a shard or its pages; further columns are kept by
:func:`shard_documents` and ignored by :func:`assign_shards`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.shared import save

LIMIT_BYTES = 1 << 20
HASH_BITS = 60
#: Bits that cells have beyond the depth that an even spread would need, and the step when that isn't enough.
SPARE_BITS, STEP_BITS = 4, 8
#: Cells up to which the directory is broadcast, at some 50 bytes each; a larger one is joined by shuffling.
BROADCAST_CELLS = 200_000


def hash_key(key: Column) -> Column:
    """The first 60 bits of the key's digest, as a long."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.left(digest, F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, HASH_BITS - depth)


def _fitting(rows: DataFrame, start: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The cells of ``depth`` below buckets that fit (cell, bucket_depth, bucket, bucket_bytes, bucket_docs), and those
    that don't fit at any depth from ``start`` (open_cell).

    A bucket is final if it fits and the one above, the sum of its halves, doesn't; nothing is joined to the latter.
    """
    cells = rows.groupBy(_prefix(F.col("key_hash"), depth).alias("cell")).agg(
        F.sum("n_bytes").alias("n_bytes"),
        F.count(F.lit(1)).alias("n_docs"),
        F.min("key_hash").alias("least"),
        F.max("key_hash").alias("most"),
    )
    above = lambda bits: F.call_function("shiftright", F.col("cell"), bits.cast("int"))
    up = cells.select("*", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("bucket_depth")).withColumn("bucket", above(F.lit(depth) - F.col("bucket_depth")))
    sums = up.groupBy("bucket_depth", "bucket").agg(
        F.sum("n_bytes").alias("bucket_bytes"), F.sum("n_docs").alias("bucket_docs"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    fits = lambda size, least, most: (size <= limit) | (least == most)
    half = F.struct("bucket_depth", "bucket", "bucket_bytes", "bucket_docs", fits(F.col("bucket_bytes"), F.col("least"), F.col("most")).alias("fits"))
    whole = sums.groupBy("bucket_depth", F.shiftright("bucket", 1).alias("parent")).agg(
        F.collect_list(half).alias("halves"),  # two at most
        fits(F.sum("bucket_bytes"), F.min("least"), F.max("most")).alias("parent_fits"),
    )
    found = whole.filter((F.col("bucket_depth") == start) | ~F.col("parent_fits")).select(F.explode("halves").alias("x")).select("x.*")
    first = F.call_function("shiftleft", F.col("bucket"), (F.lit(depth) - F.col("bucket_depth")).cast("int"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("bucket_depth")).cast("int"))
    final = found.filter("fits").select(
        F.explode(F.sequence(first, first + size - 1)).alias("cell"), F.col("bucket_depth"), "bucket", "bucket_bytes", "bucket_docs"
    )
    return final, found.filter((F.col("bucket_depth") == depth) & ~F.col("fits")).select(F.col("bucket").alias("open_cell"))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> list[tuple[int, DataFrame]]:
    """The directory of rows (key_hash, n_bytes): for each depth looked at, its cells and their buckets."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    start, levels = 0, []
    while True:
        final, left = _fitting(rows, start, depth, limit)
        levels.append((depth, save(final, "shard-directory")))
        left = save(left, "shard-open")
        if depth == HASH_BITS or not left.take(1):
            return levels
        rows = rows.join(left, _prefix(F.col("key_hash"), depth) == F.col("open_cell"), "left_semi")
        start, depth = depth + 1, min(HASH_BITS, depth + STEP_BITS)


def _look_up(rows: DataFrame, levels: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """Rows with bucket_depth, bucket, bucket_bytes, bucket_docs and page."""
    names = ["bucket_depth", "bucket", "bucket_bytes", "bucket_docs"]
    unsplit = False
    for nth, (depth, cells) in enumerate(levels):
        n_cells, oversized = cells.agg(F.count(F.lit(1)), F.max((F.col("bucket_bytes") > limit) & (F.col("bucket_docs") > 1))).first()
        unsplit = unsplit or bool(oversized)
        own = cells.select(F.col("cell").alias(f"cell_{nth}"), *[F.col(c).alias(f"{c}_{nth}") for c in names])
        own = F.broadcast(own) if n_cells <= BROADCAST_CELLS else own.hint("merge")
        rows = rows.join(own, _prefix(F.col("key_hash"), depth) == F.col(f"cell_{nth}"), "left")
    found = [F.coalesce(*[F.col(f"{c}_{nth}") for nth in range(len(levels))]).alias(c) for c in names]
    gone = [f"{c}_{nth}" for nth in range(len(levels)) for c in ["cell", *names]]
    rows = rows.select("*", *found).drop(*gone)
    return _paged(rows, limit) if unsplit else rows.withColumn("page", F.lit(0).cast("long"))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for the rows of a bucket that no bit can split; all other rows are on page 0."""
    within = Window.partitionBy("bucket_depth", "bucket").orderBy("doc_id", "n_bytes")
    whole = rows.filter(F.col("bucket_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    split = rows.filter(F.col("bucket_bytes") > limit)
    # A page takes floor(limit / largest row) rows, so that it fits whatever the order of rows.
    paged = (
        split.withColumn("largest", F.max("n_bytes").over(Window.partitionBy("bucket_depth", "bucket")))
        .withColumn("per_page", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("largest"))))
        .withColumn("page", F.floor((F.row_number().over(within) - 1) / F.col("per_page")).cast("long"))
        .drop("largest", "per_page")
    )
    return whole.unionByName(paged)


def assign_shards(documents: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (prefix bits, with a page behind a dot where needed), depth, shard_bytes, shard_docs.

    shard_bytes and shard_docs are those of the bucket, over all its pages.
    """
    rows = save(
        documents.select(
            "doc_id", hash_key(F.col("doc_id")).alias("key_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
        ),
        "shard-rows",
    )
    found = _look_up(rows, directory(rows, limit), limit)
    return found.select("doc_id", "n_bytes", _shard_name().alias("shard"), *_shard_facts())


def _shard_name() -> Column:
    bits = F.when(F.col("bucket_depth") > 0, F.lpad(F.bin("bucket"), F.col("bucket_depth").cast("int"), F.lit("0"))).otherwise(F.lit(""))
    return F.concat(F.lit("s"), bits, F.when(F.col("page") > 0, F.concat(F.lit("."), F.col("page"))).otherwise(F.lit("")))


def _shard_facts() -> list[Column]:
    return [
        F.col("bucket_depth").cast("int").alias("depth"),
        F.col("bucket_bytes").cast("long").alias("shard_bytes"),
        F.col("bucket_docs").cast("long").alias("shard_docs"),
    ]


def shard_documents(documents: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Whole documents with their shard, each shard's rows together and in doc_id order.

    Added columns: shard, shard_depth, shard_bytes, shard_docs.
    """
    own = documents.columns
    names = {"key_hash", "n_bytes", "bucket_depth", "bucket", "bucket_bytes", "bucket_docs", "page"}
    safe = {c: f"own_{i}" if c in names else c for i, c in enumerate(own)}
    wide = documents.withColumnsRenamed(safe).select(
        "*", hash_key(F.col("doc_id")).alias("key_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    levels = directory(save(wide.select("key_hash", "n_bytes"), "shard-rows"), limit)
    found = _look_up(wide, levels, limit).withColumn("shard", _shard_name())
    return (
        found.repartition("shard")
        .sortWithinPartitions("shard", "doc_id")
        .select(*[F.col(safe[c]).alias(c) for c in own], "shard", *[x.alias(n) for x, n in zip(_shard_facts(), ("shard_depth", "shard_bytes", "shard_docs"))])
    )
