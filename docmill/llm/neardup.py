"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct shingles of ``n`` words (A-Z lower-cased); two documents are linked when
their sets' Jaccard similarity reaches the threshold. Links are confirmed on full sets, and components of
the link graph are returned, without expanding copies or groups into all their pairs:

1. Documents with equal sets share a fingerprint; the smallest doc_id stands for all of them from here on.
2. Signatures of 160 minima are cut into 32 bands of 5; equal bands share a bucket. A pair at a similarity of
   0.8 shares no bucket with a probability of 3e-6.
3. Each bucket's pivot is the member that shares the most buckets with others, near the middle of its group;
   all members are paired with it, which is linear in the bucket.
4. A pair's signatures are compared in batches. With ``m`` of ``n`` minima equal and a flat prior, the
   posterior probability that the similarity reaches the threshold ``t`` is P(Binomial(n + 1, t) <= m); a
   pair goes when that falls below ``MISS``. What survives is verified on full sets.
5. What a pivot's star leaves open are pairs of a bucket in different components. Members outside the
   bucket's main component are compared with all others, in blocks of bounded weight, by the same batches
   and on full sets where these leave a pair. A block returns links that join its components, not all its
   pairs; the components are then computed again.

Defined cases: a null or wordless text has an empty set and is linked with nothing; fewer words than a
shingle form one shingle; repeated rows of one doc_id are one document, and where their texts differ, the one that is
last by code point is compared and kept, while each row has its own n_shingles; rows
without doc_id are linked with nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.graphs import components
from docmill.llm.shared import discard, release, save, trimmed
from docmill.llm.textvec import SPACED, hash_runs, hash_words, slices, words

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
#: Minima compared before the next look at the posterior, and the posterior below which a pair goes.
BATCH, MISS = 32, 1e-9
#: Weight of a bucket's members on either side of a block of comparisons: one each, and one for so many shingles.
BLOCK, HEAVY = 1024, 2000
#: Columns of an incidence matrix.
WIDE = 4096

_random = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    for s in slices(texts):
        starts, ends, rows = words(s, SPACED)
        h = hash_words(s.data, starts, ends)
        runs = hash_runs(h, n)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= n:
                found = np.sort(runs[a : b - n + 1])
                keep = np.ones(len(found), dtype=bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                yield hash_runs(h[a:b], b - a)
            else:
                yield runs[:0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set, which may not be empty: a row of ``MINIMA`` per set."""
    out = np.empty((len(sets), MINIMA), dtype=np.uint32)
    if not sets:
        return out
    low = np.concatenate(sets).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    hashed = np.empty_like(low)
    for k in range(MINIMA):
        np.multiply(low, _FACTORS[k], out=hashed)
        np.add(hashed, _ADDENDS[k], out=hashed)
        out[:, k] = np.minimum.reduceat(hashed, at)
    return out


FEATURES = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("print", T.BinaryType()),
    T.StructField("minima", T.BinaryType()),
]


def features(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set) and minima; the last two null for an empty set."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, minima, waiting, held = [], [], [], [], 0

            def flush():
                minima.extend(x.tobytes() for x in signatures(waiting))
                waiting.clear()

            for x in shingle_sets(batch.column(1), n):
                sizes.append(len(x))
                prints.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                if len(x):
                    waiting.append(x)
                    held += len(x)
                    if held > 1 << 19:
                        flush()
                        held = 0
            flush()
            full = iter(minima)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array([next(full) if x else None for x in sizes], pa.binary()),
                ],
                ["doc_id", "n_shingles", "print", "minima"],
            )

    return documents.select("doc_id", "text").mapInArrow(trimmed(found), T.StructType([documents.schema["doc_id"], *FEATURES]))


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of minima compared, a batch at a time: how many must be equal for the pair to stay."""
    out = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survives(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """For pairs of signature rows (broadcast against each other): True if no batch ends the pair."""
    shape = np.broadcast_shapes(a.shape, b.shape)[:-1]
    equal, alive = np.zeros(shape, dtype=np.int16), np.ones(shape, dtype=bool)
    for k, most in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal += (a[..., part] == b[..., part]).sum(axis=-1, dtype=np.int16)
        alive &= equal >= most
        if not alive.any():
            break
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), MINIMA)


def _similar_sizes(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9


def _prune(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    least = least_matches(threshold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good = survives(_matrix(batch.column("a_minima")), _matrix(batch.column("b_minima")), least)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    found = found.join(ids, "rep", "left_semi")
    side = lambda s: found.select(*[F.col(c).alias(f"{s}{d}") for c, d in (("rep", ""), ("n_shingles", "_n"), ("minima", "_minima"))])
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    fits = F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-9
    kind = found.schema["rep"].dataType
    return (
        joined.filter(fits)
        .select("a", "b", "a_minima", "b_minima")
        .mapInArrow(trimmed(keep), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    )


def _candidate_texts(documents: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id and text of the documents that share a bucket: the one time that texts are shuffled as a whole.

    The ids are never broadcast, as they grow with the data.
    """
    ids = members.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash")
    return documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict = {}
            for key, text in (("a", "a_text"), ("b", "b_text")):
                ids = batch.column(key).to_pylist()
                new = {x: i for i, x in enumerate(ids) if x not in sets}
                if new:
                    sets.update(zip(new, shingle_sets(batch.column(text).take(pa.array(new.values(), pa.int64())), n)))
            good = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = sets[a], sets[b]
                shared = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"{s}_text"))
    kind = texts.schema["doc_id"].dataType
    return (
        pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text")
        .mapInArrow(trimmed(linked), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    )


def _intersections(left: list[np.ndarray], home: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all wanted pairs; zero or more elsewhere."""
    out = np.zeros(wanted.shape, dtype=np.float32)
    x, y = np.nonzero(wanted)
    sizes = np.array([len(s) for s in (*left, *home)])
    each, nth = np.unique(np.concatenate([*left, *home]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(nth, minlength=len(each)) > 1
    column = np.cumsum(often)[nth] - 1
    row, column = row[often[nth]], column[often[nth]]
    width = int(often.sum())
    if len(x) * (2e-5 + 1e-7 * sizes.mean()) < 1e-10 * len(left) * len(home) * width:
        for i, j in zip(x, y):
            out[i, j] = len(left[i]) + len(home[j]) - len(np.union1d(left[i], home[j]))
        return out
    # Shingles of one document only are gone; a product of the others' incidences counts what two have in common.
    for first in range(0, width, WIDE):
        dense = np.zeros((len(sizes), min(WIDE, width - first)), dtype=np.float32)
        here = (column >= first) & (column < first + WIDE)
        dense[row[here], column[here] - first] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _spanning(left: np.ndarray, home: np.ndarray, parts: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between left and home documents, as many as join all the parts that they join."""
    found, n = [], len(left)
    parts = parts.copy()
    for i in np.flatnonzero(linked.any(axis=1)):
        others = np.flatnonzero(linked[i])
        met, at = np.unique(parts[n + others], return_index=True)
        at = at[met != parts[i]]
        if len(at):
            found += [(int(min(left[i], home[j])), int(max(left[i], home[j]))) for j in others[at]]
            parts[np.isin(parts, met)] = parts[i]
    return found


def _open_links(members: DataFrame, labels: DataFrame, found: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that join components within a bucket, beside those of its pivot.

    ``members``: bucket, rep, pivot. The rows of a bucket are compared in blocks of bounded weight, on full
    sets where the signatures leave a pair; a block returns no more links than join its components.
    """
    threshold, least = percent / 100, least_matches(percent / 100)
    labelled = (
        members.filter(F.col("rep") != F.col("pivot")).select("bucket", "rep")
        .join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(found.select("rep", "n_shingles"), "rep")
        .select("bucket", "rep", F.coalesce("component", "rep").alias("component"), (1 + F.col("n_shingles") / HEAVY).alias("weight"))
    )
    mixed = (
        labelled.groupBy("bucket", "component").agg(F.sum("weight").alias("w"))
        .groupBy("bucket")
        .agg(F.sum("w").alias("w"), F.max(F.struct("w", "component")).alias("main"), F.count(F.lit(1)).alias("n_components"))
        .filter(F.col("n_components") > 1)
        .select("bucket", "w", F.col("main.component").alias("main"), (F.col("w") - F.col("main.w")).alias("w_left"))
    )
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(F.col(w) / F.lit(BLOCK))).cast("int")
    rows = labelled.join(mixed, "bucket").withColumn("is_left", F.col("component") != F.col("main"))
    dealt = lambda w: F.pmod(F.xxhash64("rep"), blocks(w)).cast("int")
    every = lambda w: F.explode(F.sequence(F.lit(0), blocks(w) - 1))
    home = rows.select("bucket", "rep", "component", F.lit(False).alias("asks"), dealt("w").alias("home"), every("w_left").alias("left"))
    asking = rows.filter("is_left").select("bucket", "rep", "component", F.lit(True).alias("asks"), every("w").alias("home"), dealt("w_left").alias("left"))
    dealt_out = save(home.unionByName(asking), "neardup-blocks")
    def compare(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), dtype=bool)
        order = np.r_[np.flatnonzero(asks), np.flatnonzero(~asks)]
        n_left = int(asks.sum())
        found_links: list[tuple[int, int]] = []
        if 0 < n_left < len(order):
            group = group.take(pa.array(order))
            ids, parts = group.column("rep").to_numpy(), group.column("component").to_numpy()
            sets = list(shingle_sets(group.column("text"), n))
            minima, size = signatures(sets), np.array([len(x) for x in sets])
            open_ = np.zeros((n_left, len(ids) - n_left), dtype=bool)
            for i in range(n_left):
                good = (parts[i] != parts[n_left:]) & _similar_sizes(size[i], size[n_left:], threshold)
                y = np.flatnonzero(good)
                open_[i, y] = survives(minima[i], minima[n_left + y], least)
            if open_.any():
                shared = _intersections(sets[:n_left], sets[n_left:], open_).astype(np.int64)
                linked = open_ & (100 * shared >= percent * (size[:n_left, None] + size[None, n_left:] - shared))
                found_links = _spanning(ids[:n_left], ids[n_left:], parts, linked)
        release()
        return pa.table({"a": [a for a, _ in found_links], "b": [b for _, b in found_links]}, schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return dealt_out.join(texts.withColumnRenamed("doc_id", "rep"), "rep").groupBy("bucket", "home", "left").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document. doc_id must be a long."""
    threshold = percent / 100
    full = save(features(documents, n), "neardup-features")
    every = full.select("doc_id", "n_shingles", "print")
    sets = every.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    found = save(
        sets.groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), "neardup-sets"
    )
    minima = full.filter(F.col("minima").isNotNull()).select(F.col("doc_id").alias("rep"), "minima")
    signed = found.select("rep", "n_shingles").join(minima.groupBy("rep").agg(F.max("minima").alias("minima")), "rep")
    band = lambda i: F.xxhash64(i, F.substr("minima", i * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    buckets = signed.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    buckets = save(buckets, "neardup-bands")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared_buckets = members = save(buckets.join(shared, "bucket"), "neardup-buckets")
    central = members.groupBy("rep").agg(F.sum("n").alias("meets"))
    pivots = members.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("meets", "rep"))["rep"].alias("pivot"))
    members = save(members.join(pivots, "bucket").select("bucket", "rep", "pivot"), "neardup-members")
    texts = save(_candidate_texts(documents, members), "neardup-texts")
    pairs = members.filter(F.col("rep") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = save(pairs, "neardup-stars")
    tried = save(_prune(stars, signed, threshold), "neardup-pairs")
    links = save(_verify(tried, texts, n, percent), "neardup-links")
    labels = save(components(links), "neardup-labels")
    more = save(_open_links(members, labels, found, texts, n, percent), "neardup-links")
    if more.take(1):
        labels = save(components(links.unionByName(more)), "neardup-labels")
    discard(buckets, shared_buckets, members, texts, stars, tried, links, more)
    named = found.select("print", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return (
        every.select("doc_id", "n_shingles", "print").join(named, "print", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one of each group of near-duplicates."""
    kept = near_duplicates(documents, n, percent).filter("kept").select("doc_id").distinct()
    named = documents.join(kept.filter(F.col("doc_id").isNotNull()).hint("shuffle_hash"), "doc_id", "left_semi")
    # Of rows that share a doc_id, the text that is last by code point.
    one = named.groupBy("doc_id").agg(F.max_by(F.struct(*documents.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return one.unionByName(documents.filter(F.col("doc_id").isNull()))
