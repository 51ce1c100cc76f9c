"""Exact top-k inner products over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; the keys of a pivot are cut into annuli.
For a vector ``x`` of an annulus, the triangle inequality bounds its distance from a query ``q`` from below by
the gap between ``d(q, pivot)`` and the annulus, and so its inner product from above by
``(|q|^2 + |x|^2 - gap^2) / 2``. A query first searches its own annulus, which gives a k-th best score to beat.
It then expands over the other annuli in the order of their bounds, in ``STEPS`` of growing size, and the
k-th score rises between them; it stops where the bound falls below that score. Within a cell,
vectors are sorted by distance and narrower annuli are taken in order of their gap, with the same stop.

Pivots are fitted on a bounded sample (``SAMPLE`` vectors by digest of the id); every vector is indexed and
the answer doesn't depend on the pivots. Annuli of more than ``CELL`` vectors, as of many copies of one, are
dealt to several cells, and a cell's queries to blocks of ``CELL``: no group grows with the data.

Components are floor(scale * x), x as double. Defined cases: vectors that are null or hold null or non-finite
components, and rows without id, take no part; shorter vectors are filled up with zeros; rows repeated in id
and vector count once; a query never meets rows of its own id; ties go to the smaller id; an empty table
gives no rows; further columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.shared import discard, save

SAMPLE, PIVOTS, ROUNDS = 4096, 64, 8
#: Vectors for which a pivot gets one more annulus, the most annuli of a pivot, and the most vectors or queries of a cell.
ANNULUS, ANNULI, CELL = 1024, 64, 65_536
#: Vectors in an annulus within a cell, and queries worked on together.
INNER, TOGETHER = 2048, 64
#: Annuli that a query goes to, in order, until it looks at its k-th score again; the last step takes all that are left.
STEPS = (8, 56)


def quantized(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, parts (array<bigint>), n_parts, most (largest absolute component)."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * scale)).alias("parts"))
        .distinct()
        .withColumn("most", F.coalesce(F.array_max(F.transform("parts", F.abs)), F.lit(0)))
    )


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def fit_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a few rounds of k-means."""
    x = np.unique(sample.astype(np.float64), axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(axis=1)
        for c in np.unique(nearest):
            centres[c] = x[nearest == c].mean(axis=0)
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def _bound(q_norm, q_dist, low, high, norm) -> np.ndarray:
    """The most that an inner product can be, with room for rounding."""
    gap = np.maximum(np.maximum(low - q_dist, q_dist - high), 0) * (1 - 1e-9)
    most = np.minimum((q_norm + norm - gap * gap) / 2, np.sqrt(q_norm * norm))
    return most + 1e-6 * (1 + np.abs(most))


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < k]


def search_cell(ids, x, dist, q_ids, q, q_dist, least, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, vector id and score of each query's k best in a cell that reach ``least``."""
    # Products of integers below 2^53 are exact in doubles, and much faster.
    exact = np.float64 if len(x) == 0 or len(q) == 0 or np.abs(x).max(initial=0) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**53 else np.int64
    order = np.argsort(dist, kind="stable")
    ids, x, dist = ids[order], x[order].astype(exact), dist[order]
    q = q.astype(exact)
    norm, q_norm = (x.astype(np.float64) ** 2).sum(axis=1), (q.astype(np.float64) ** 2).sum(axis=1)
    out = ([], [], [])
    for a in range(0, len(q_ids), TOGETHER):
        part = slice(a, a + TOGETHER)
        beat = least[part].astype(np.float64).copy()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, exact)]
        blocks = [slice(b, min(b + INNER, len(ids))) for b in range(0, len(ids), INNER)]
        middle = float(np.median(q_dist[part]))
        blocks.sort(key=lambda s: max(dist[s][0] - middle, middle - dist[s][-1], 0))
        for s in blocks:
            open_ = np.flatnonzero(_bound(q_norm[part], q_dist[part], dist[s][0], dist[s][-1], norm[s].max()) >= beat)
            if not len(open_):
                continue
            score = q[part][open_] @ x[s].T
            good = (score >= beat[open_, None]) & (q_ids[part][open_, None] != ids[s][None, :])
            i, j = np.nonzero(good)
            found = [np.r_[found[0], open_[i]], np.r_[found[1], ids[s][j]], np.r_[found[2], score[i, j]]]
            keep = _best(*found, k)
            found = [f[keep] for f in found]
            n, last = np.bincount(found[0], minlength=len(beat)), np.full(len(beat), np.inf)
            np.minimum.at(last, found[0], found[2].astype(np.float64))
            beat = np.where(n >= k, np.maximum(beat, last), beat)
        out[0].append(q_ids[part][found[0]])
        out[1].append(found[1])
        out[2].append(found[2].astype(np.int64))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def top_k(embeddings: DataFrame, k: int = 20, scale: int = 64, asks: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``asks`` marks (ids divisible by 20) against all rows."""
    spark = embeddings.sparkSession
    asks = F.col("vec_id") % 20 == 0 if asks is None else asks
    result = "query_id long, vec_id long, score long"
    rows = save(quantized(embeddings, scale), "topk-vectors")
    width, most = rows.agg(F.max(F.size("parts")), F.max("most")).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = next(t for t in ("int8", "int16", "int32", "int64") if most <= np.iinfo(t).max or t == "int64")
    digest = F.md5(F.col("vec_id").cast("string").cast("binary"))
    drawn = [r[0] for r in rows.orderBy(digest).select("parts").limit(SAMPLE).collect()]
    pivots = spark.sparkContext.broadcast(fit_pivots(np.array([list(p) + [0] * (width - len(p)) for p in drawn], dtype=np.float64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("parts")
            x = np.zeros((len(column), width), dtype=kind)
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            x[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            d = _distances(x.astype(np.float64), pivots.value)
            nearest = d.argmin(axis=1)
            norm = (x.astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(d[np.arange(len(d)), nearest]),
                    pa.array(norm),
                ],
                ["vec_id", "vec", "pivot", "dist", "norm"],
            )

    placed = save(rows.mapInArrow(place, "vec_id long, vec binary, pivot int, dist double, norm double"), "topk-placed")

    # Annuli: distances of a pivot cut at quantiles, one annulus for every ANNULUS vectors.
    cuts = placed.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", [(i + 1) / ANNULI for i in range(ANNULI - 1)], 1000).alias("cuts")
    )
    wanted = F.least(F.ceil(F.col("n") / ANNULUS), F.lit(ANNULI))
    cuts = cuts.select(
        "pivot",
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(wanted, F.lit(2)) - 1), lambda i: F.get("cuts", F.least((i * ANNULI / wanted).cast("int"), F.lit(ANNULI - 1)) - 1))).alias("cuts"),
    )
    ringed = placed.join(F.broadcast(cuts), "pivot").select(  # one row per pivot
        *placed.columns, F.size(F.filter("cuts", lambda c: c < F.col("dist"))).alias("annulus")
    )
    ringed = save(ringed, "topk-annuli")
    annuli = ringed.groupBy("pivot", "annulus").agg(
        F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")
    ).orderBy("pivot", "annulus").collect()  # at most PIVOTS * ANNULI rows
    parts = spark.createDataFrame([(r["pivot"], r["annulus"], i, -(-r["n"] // CELL)) for i, r in enumerate(annuli)], "pivot int, annulus int, ring int, parts int")
    cells = ringed.join(F.broadcast(parts), ["pivot", "annulus"]).select(
        "vec_id", "vec", "dist", "ring", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    )

    def search(group: pa.Table) -> pa.Table:
        is_query = np.array(group.column("query").to_pylist(), dtype=bool)
        here, asked = group.filter(pa.array(~is_query)), group.filter(pa.array(is_query))
        number = lambda t, c: t.column(c).to_numpy()
        found = search_cell(
            number(here, "vec_id"), _matrix(here.column("vec"), kind, width), number(here, "dist"),
            number(asked, "vec_id"), _matrix(asked.column("vec"), kind, width), number(asked, "dist"), number(asked, "least"), k,
        )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    as_rows = lambda df, query, least: df.select(
        "ring", "part", "vec_id", "vec", "dist", F.lit(query).alias("query"), least.cast("double").alias("least")
    )
    low = F.lit(float("-inf"))
    own = as_rows(cells, False, low).unionByName(as_rows(cells.filter(asks), True, low))
    found = save(own.groupBy("ring", "part").applyInArrow(search, result), "topk-first")
    asking = save(cells.filter(asks).select("vec_id", "vec", "ring", "part"), "topk-queries")
    shape = {c: np.array([r[c] for r in annuli], dtype=np.float64) for c in ("low", "high", "norm")}
    of_pivot, n_parts = np.array([r["pivot"] for r in annuli]), np.array([-(-r["n"] // CELL) for r in annuli])

    def route(first: int, last: int):
        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), 256):
                    some = batch.slice(a, 256)
                    q = _matrix(some.column("vec"), kind, width).astype(np.float64)
                    d = _distances(q, pivots.value)[:, of_pivot]
                    bound = _bound((q**2).sum(axis=1)[:, None], d, shape["low"], shape["high"], shape["norm"])
                    nearest = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    i, j = np.nonzero(np.take_along_axis(bound, nearest, axis=1) >= some.column("least").to_numpy()[:, None])
                    ring = nearest[i, j]
                    many = n_parts[ring]
                    i, ring = np.repeat(i, many), np.repeat(ring, many)
                    part = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                    new = (ring != some.column("ring").to_numpy()[i]) | (part != some.column("part").to_numpy()[i])
                    i, ring, part = i[new], ring[new], part[new]
                    took = some.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ring.astype(np.int32)), pa.array(part.astype(np.int32)), took.column("vec_id"), took.column("vec"), pa.array(d[i, ring]), took.column("least")],
                        ["ring", "part", "vec_id", "vec", "dist", "least"],
                    )

        return routed

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    at = [0, *np.cumsum(STEPS).tolist(), len(annuli)]
    for first, last in zip(at, at[1:]):
        if first >= len(annuli):
            break
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        queries = asking.join(kth, F.col("vec_id") == F.col("query_id"), "left").select(
            "vec_id", "vec", "ring", "part", F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(low).alias("least")
        )
        visits = save(queries.mapInArrow(route(first, last), "ring int, part int, vec_id long, vec binary, dist double, least double"), "topk-visits")
        # One row for each cell that is visited.
        blocks = visits.groupBy("ring", "part").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))
        asked = as_rows(visits, True, F.col("least")).join(blocks, ["ring", "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        homes = as_rows(cells, False, low).join(blocks, ["ring", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        later = asked.unionByName(homes).drop("blocks").groupBy("ring", "part", "block").applyInArrow(search, result)
        before, found = found, save(best(found.unionByName(later)).select("query_id", "vec_id", "score"), "topk-found")
        discard(before, visits)
    discard(rows, placed, ringed, asking)
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
