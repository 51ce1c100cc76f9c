"""Katz backoff language model: Good-Turing discounted counts with exactly normalised backoff weights.

    P(w | v) = d(c(v, w)) c(v, w) / c(v)      if the pair was seen
             = a(v) P(w)                      if not
    P(w)     = d(c(w)) c(w) / N               if the word was seen
             = what that leaves               for the unknown word

``d`` is Katz's discount from Good-Turing counts of counts up to ``K``, 1 beyond; ``a(v)`` gives the unseen
words exactly what the seen ones leave. Where nothing is left, as all counts exceed ``K``, the seen estimates
are scaled by ``c / (c + 1)``. Every text is followed by one end token, which is also the context of the
first word, so that a context's count is its word's count. A word is known by 64 bits of its hash, and in
pairs by its number in the vocabulary, which the word counts give it.

Counting and scoring move sorted arrays of distinct words and word pairs instead of tokens. Documents are
tokenised once, in chunks of some million tokens, into a table bucketed by chunk. Each chunk sends its
distinct words, and then its distinct pairs, once each to the part of the model that their (first) word
belongs to, however frequent they are; a part merges what it gets, keeps its counts as rows of the model
tables, and answers each chunk with arrays in the order it was asked. Pairs of a frequent first word are dealt to all parts
by their second, and the sums of such contexts (a million at most) travel to the scoring tasks. Everything that a task holds is bounded by a
chunk or a part, and all of it grows with the corpus.

Defined cases: a null or empty text has the end token alone; rows without doc_id train; repeated rows count
as often as they occur; without training rows every probability is 1; words are whole, however long; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.shared import delete, discard, new_path, release, save, trimmed
from docmill.llm.textvec import SPACED, hash_words, slices, words

#: Counts that are discounted.
K = 5
#: Tokens of a chunk, and of a part of the model.
CHUNK_TOKENS, PART_TOKENS = 600_000, 1_000_000
#: Text of a bucket of the chunk table, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 100_000
#: A context that is seen this often, and one in so many tokens, has its pairs dealt to all parts by their second word.
HOT_COUNT, HOT_SHARE = 500_000, 1_000_000
END = np.uint64(0xE0D0C0B0A0908071)
BASE = 0.1

_STATS = [f"n{r}" for r in range(1, K + 2)]
ANSWERS = "part int, chunk long, counts binary, deep binary, covered binary, keys binary, sizes binary, words long, hot_key long, hot_covered double, seen long, total long, " + ", ".join(
    f"{n} long" for n in _STATS
)
_ANSWER_NAMES = [c.split()[0] for c in ANSWERS.split(", ")]
_ANSWER_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * (2 + len(_STATS))]


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart, compressed; high planes of zeros take next to nothing."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def expand(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1)


def squeeze_runs(x: np.ndarray, starts: np.ndarray) -> bytes:
    """Numbers that ascend within each run, by their differences."""
    d = np.diff(x, prepend=0)
    d[starts] = x[starts]
    return squeeze(d)


def expand_runs(b: bytes, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(expand(b))
    starts = np.cumsum(sizes) - sizes
    return total - np.repeat(np.r_[0, total][starts], sizes)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


# -- discounts ---------------------------------------------------------------------------------------------


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d[r] for r up to K (d[0] unused), from n_1 .. n_{K+1}; half a count less where Good-Turing gives none."""
    n = [0, *counts_of_counts]
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    d = np.array([1.0, *[(r - 0.5) / r for r in range(1, K + 1)]])
    for r in range(1, K + 1):
        if n[r] and common < 1:
            turing = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if 0 < turing < 1:
                d[r] = turing
    return d


def kept_mass(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts after their discount."""
    return counts * np.where(counts <= K, d[np.minimum(counts, K)], 1.0)


class Unigrams:
    """P(w) by count, and the unknown word's."""

    def __init__(self, total: int, n: list[int], seen: int, sizes: dict[int, int] | None = None):
        """``sizes``: the words of each part, from which they are numbered."""
        self.offsets = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1))]) if sizes else np.zeros(1, np.int64)
        self.total, self.seen, self.d = total, seen, discounts(n)
        self.hot = max(HOT_COUNT, total // HOT_SHARE)
        left = sum(n[r - 1] * r * (1 - self.d[r]) for r in range(1, K + 1))
        self.scale = 1.0 if left > 0 else total / (total + 1)
        self.unknown = left / total if left > 0 else 1 - self.scale if total else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.scale * kept_mass(self.d, counts) / self.total, self.unknown)


# -- chunks ------------------------------------------------------------------------------------------------


def _chunk(ids: list, train: list[bool], texts: list[tuple[np.ndarray, np.ndarray]], number: int) -> tuple:
    """A row of the chunk table. ``texts``: word hashes and where each document's begin, slice by slice."""
    parts, lengths = [], []
    for h, rows in texts:
        n = np.diff(rows)
        with_end = np.full(len(h) + len(n), END, dtype=np.uint64)
        with_end[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        parts.append(with_end)
        lengths.append(n + 1)
    tokens, length = np.concatenate(parts), np.concatenate(lengths)
    vocabulary, local = np.unique(tokens, return_inverse=True)
    counts = np.bincount(local[np.repeat(np.array(train, dtype=bool), length)], minlength=len(vocabulary))
    # Frequent words get small numbers, so that most high bytes are zero.
    order = np.argsort(-np.bincount(local, minlength=len(vocabulary)), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return number, ids, train, squeeze(length), vocabulary.tobytes(), squeeze(counts), squeeze(rank[local]), squeeze(order), len(tokens)


CHUNKS = "chunk long, ids array<long>, train array<boolean>, lengths binary, vocabulary binary, counts binary, tokens binary, ranks binary, n_tokens long"


def chunked(documents: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """The documents tokenised, as the table ``name`` at ``path``, bucketed by chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5, pa.int64()]
        number, ids, train, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def full():
            row = _chunk(ids, train, texts, number)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            for s in slices(batch.column("text")):
                starts, ends, rows = words(s, SPACED)
                ids += batch.column("doc_id")[s.first : s.last].to_pylist()
                train += batch.column("train")[s.first : s.last].to_pylist()
                texts.append((hash_words(s.data, starts, ends), rows))
                held += len(starts) + s.last - s.first
                if held >= CHUNK_TOKENS:
                    yield full()
                    release()
                    number, ids, train, texts, held = number + 1, [], [], [], 0
        if ids:
            yield full()

    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out(F.col("doc_id"))).alias("train"))
    (
        rows.mapInArrow(cut, CHUNKS).write.bucketBy(buckets, "chunk").sortBy("chunk")
        .option("path", path).mode("overwrite").saveAsTable(name)
    )
    return spark.table(name)


def _borders(parts: int) -> np.ndarray:
    """Where the parts of the hash range begin, but for the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)


def _dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """By ``key`` into ``n`` partitions if that is more than shuffles have, so that what a task reads doesn't grow with the corpus."""
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One at a time, as each is large."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]
        release()


def _answer(part: int, chunk: int | None, **columns) -> tuple:
    return tuple({"part": part, "chunk": chunk, **columns}.get(n) for n in _ANSWER_NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), _ANSWER_KINDS)], names=_ANSWER_NAMES)


def _count_stats(counts: np.ndarray) -> dict:
    r = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)
    return {"seen": int((counts > 0).sum()), "total": int(counts.sum()), **{n: int(r[i + 1]) for i, n in enumerate(_STATS)}}


def count_words(chunks: DataFrame, parts: int) -> DataFrame:
    """Answers to each chunk (counts of its words and their places in the part), and for each part its words, counts and statistics."""
    begins = _borders(parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                vocabulary, counts = np.frombuffer(row["vocabulary"], dtype=np.uint64), expand(row["counts"])
                cuts = np.r_[0, np.searchsorted(vocabulary, begins), len(vocabulary)]
                rows = [(p, row["chunk"], vocabulary[a:b].tobytes(), squeeze(counts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "chunk", "keys", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]
        every, nth = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(nth, weights=np.concatenate([expand(r["counts"]) for r in rows]), minlength=len(every)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, keys)])
        out = [
            _answer(r["part"], r["chunk"], counts=squeeze(counts[nth[a:b]]), keys=squeeze_runs(nth[a:b], np.array([0])))
            for r, a, b in zip(rows, cuts[:-1], cuts[1:])
        ]
        model = _answer(rows[0]["part"], None, keys=every.tobytes(), counts=squeeze(counts), words=len(every), **_count_stats(counts))
        release()
        return _table([*out, model])

    asked = chunks.select("chunk", "vocabulary", "counts").mapInArrow(trimmed(ask), "part int, chunk long, keys binary, counts binary")
    return save(_dealt(asked, parts, "part").groupBy("part").applyInArrow(merge, ANSWERS), "katz-words")


class Pairs:
    """A chunk's documents as word pairs; local words are in hash order."""

    def __init__(self, row: dict):
        self.vocabulary = np.frombuffer(row["vocabulary"], dtype=np.uint64)
        self.length = expand(row["lengths"])
        order = expand(row["ranks"])
        self.tokens = order[expand(row["tokens"])]
        self.train = np.repeat(np.array(row["train"], dtype=bool), self.length)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        end = int(np.searchsorted(self.vocabulary, END))
        before[np.cumsum(np.r_[0, self.length[:-1]])] = end
        self.before = before
        codes, self.nth = np.unique(before * len(self.vocabulary) + self.tokens, return_inverse=True)
        self.first, self.second = codes // len(self.vocabulary), codes % len(self.vocabulary)
        self.counts = np.bincount(self.nth[self.train], minlength=len(codes))

    def dealt(self, known: np.ndarray, begins: np.ndarray, hot: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By part: its number, its pairs, its contexts (local words), and where their pairs begin, with the total behind."""
        home = np.searchsorted(begins, self.vocabulary, "right")
        part = np.where(known[self.first] >= hot, home[self.second], home[self.first])
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            first = self.first[own]
            starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            out.append((int(part[own[0]]), own, first[starts], np.r_[starts, len(own)]))
        return out


def _joined(row: dict, field: str) -> np.ndarray:
    return np.concatenate([expand(x[field]) for x in sorted(row, key=lambda x: x["part"])])


def _numbers(row: dict, offsets: np.ndarray) -> np.ndarray:
    """The vocabulary's numbers of a chunk's words."""
    parts = sorted(row, key=lambda x: x["part"])
    places = [expand(x["keys"]) for x in parts]
    return np.concatenate([offsets[x["part"]] + np.cumsum(p) for x, p in zip(parts, places)])


def _by_chunk(answers: DataFrame, buckets: int, *fields: str) -> DataFrame:
    """The answers to a chunk together: as much as the chunk asked for; dealt as the chunks are."""
    return _dealt(answers.filter(F.col("chunk").isNotNull()), buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", *fields)).alias("answers"))


def _codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each pair, in the order of the pairs."""
    if max(first.max(), second.max()) >> 31:
        first, second = (np.unique(x, return_inverse=True)[1] for x in (first, second))
    return (first << 31) | second


def count_pairs(chunks: DataFrame, words_: DataFrame, unigrams: Unigrams, parts: int, buckets: int) -> DataFrame:
    """As count_words, for word pairs; ``deep`` and ``covered`` tell of each context how many continuations it
    has of each count up to K and how much of P(w) these and all others take. Rows with a ``hot_key`` hold
    a part's share of that for a frequent context."""
    begins, hot, offsets = _borders(parts), unigrams.hot, unigrams.offsets

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "chunk", "keys", "sizes", "seconds", "counts", "known"]
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        for batch in batches:
            for row in _rows(batch):
                pairs, known, number = Pairs(row), _joined(row["answers"], "counts"), _numbers(row["answers"], offsets)
                for part, own, context, starts in pairs.dealt(known, begins, hot):
                    second = pairs.second[own]
                    sizes = 2 * np.diff(starts) + (known[context] >= hot)
                    answer = (part, row["chunk"], squeeze_runs(number[context], np.array([0])), squeeze(sizes), squeeze_runs(number[second], starts[:-1]),
                              squeeze(pairs.counts[own]), squeeze(known[second]))
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(answer, kinds)], names)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        marked = [expand(r["sizes"]) for r in rows]
        sizes = [m >> 1 for m in marked]
        keys = [np.cumsum(expand(r["keys"])) for r in rows]
        first = np.repeat(np.concatenate(keys), np.concatenate(sizes))
        second = np.concatenate([expand_runs(r["seconds"], n) for r, n in zip(rows, sizes)])
        _, at, nth = np.unique(_codes(first, second), return_index=True, return_inverse=True)
        counts = np.bincount(nth, weights=np.concatenate([expand(r["counts"]) for r in rows])).astype(np.int64)
        first, second = first[at], second[at]
        known = np.concatenate([expand(r["known"]) for r in rows])[at]
        begins = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        contexts = first[begins]
        deep = np.stack([np.add.reduceat((counts == r).astype(np.int64), begins) for r in range(1, K + 1)], axis=1)
        covered = np.add.reduceat(np.where(counts > 0, unigrams.p(known), 0.0), begins)
        cuts, out = np.cumsum([0, *(s.sum() for s in sizes)]), []
        is_hot = np.zeros(len(contexts), dtype=bool)
        for r, own, m, x, y in zip(rows, keys, marked, cuts[:-1], cuts[1:]):
            at = np.searchsorted(contexts, own)
            is_hot[at[m & 1 == 1]] = True
            out.append(_answer(r["part"], r["chunk"], counts=squeeze(counts[nth[x:y]]), deep=squeeze(deep[at].T.reshape(-1)), covered=covered[at].tobytes()))
        for i in np.flatnonzero(is_hot):
            share = {f"n{r + 1}": int(x) for r, x in enumerate(deep[i])}
            out.append(_answer(None, None, hot_key=int(contexts[i]), hot_covered=float(covered[i]), **share))
        seen = counts > 0
        degree = np.add.reduceat(seen.astype(np.int64), begins)
        contexts, degree = contexts[degree > 0], degree[degree > 0]
        model = _answer(rows[0]["part"], None, keys=squeeze_runs(contexts, np.zeros(min(1, len(contexts)), dtype=np.int64)), sizes=squeeze(degree), counts=squeeze(counts[seen]),
                        deep=squeeze_runs(second[seen], np.cumsum(degree) - degree), **_count_stats(counts))
        release()
        return _table([*out, model])

    asked = (
        chunks.join(_by_chunk(words_, buckets, "counts", "keys").hint("shuffle_hash"), "chunk")
        .select("chunk", "train", "lengths", "vocabulary", "tokens", "ranks", "answers")
        .mapInArrow(trimmed(ask), "part int, chunk long, keys binary, sizes binary, seconds binary, counts binary, known binary")
    )
    return save(_dealt(asked, parts, "part").groupBy("part").applyInArrow(merge, ANSWERS), "katz-pairs")


def backoff_weights(d: np.ndarray, total: np.ndarray, deep: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts with counts ``total``: the scale of the seen estimates, and the weight of the unseen."""
    left = (deep * np.arange(1, K + 1) * (1 - d[1:])).sum(axis=1)
    some = left > 0
    scale = np.where(some, 1.0, total / (total + 1.0))
    mass = np.where(some, left / np.maximum(total, 1), 1 - scale)
    return scale, mass / (1 - covered)


class HotContexts:
    """Sums of the frequent contexts over all parts, by their numbers."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["hot_key"])
        self.keys = np.array([r["hot_key"] for r in rows], dtype=np.int64)
        self.deep = np.array([[r[n] for n in _STATS[:K]] for r in rows], dtype=np.int64).reshape(-1, K)
        self.covered = np.array([r["hot_covered"] for r in rows], dtype=np.float64)


def pair_probability(row: dict, unigrams: Unigrams, d: np.ndarray, begins: np.ndarray, hot: HotContexts) -> tuple[Pairs, np.ndarray, np.ndarray]:
    """A chunk's pairs, the count of each local word, and each pair's probability."""
    pairs, known = Pairs(row), _joined(row["answers"], "counts")
    answers = {x["part"]: x for x in row["pair_answers"]}
    counts = np.empty(len(pairs.first), dtype=np.int64)
    deep, covered = np.zeros((len(known), K), dtype=np.int64), np.zeros(len(known))
    for part, own, context, _ in pairs.dealt(known, begins, unigrams.hot):
        answer = answers[part]
        counts[own] = expand(answer["counts"])
        deep[context] = expand(answer["deep"]).reshape(K, -1).T
        covered[context] = np.frombuffer(answer["covered"])
    frequent = np.flatnonzero(known >= unigrams.hot)
    at = np.searchsorted(hot.keys, _numbers(row["answers"], unigrams.offsets)[frequent])
    deep[frequent], covered[frequent] = hot.deep[at], hot.covered[at]
    scale, weight = backoff_weights(d, known, deep, covered)
    total = known[pairs.first]
    single = unigrams.p(known)[pairs.second]
    seen = scale[pairs.first] * kept_mass(d, counts) / np.maximum(total, 1)
    return pairs, known, np.where(total == 0, single, np.where(counts > 0, seen, weight[pairs.first] * single))


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    spark = documents.sparkSession
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES), MOST_BUCKETS)
    name, path = f"docmill_chunks_{uuid.uuid4().hex}", new_path(spark, "katz-chunks")
    chunks = chunked(documents, name, path, buckets)
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-tokens // PART_TOKENS))
    stats = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "total", *_STATS)]
    words_ = count_words(chunks, parts)
    s = words_.agg(*stats).first()
    sizes = {r["part"]: r["words"] for r in words_.filter(F.col("words").isNotNull()).select("part", "words").collect()}
    unigrams = Unigrams(s["total"], [s[n] for n in _STATS], s["seen"], sizes)
    pairs_ = count_pairs(chunks, words_, unigrams, parts, buckets)
    s = pairs_.filter(F.col("hot_key").isNull()).agg(*stats).first()
    d = discounts([s[n] for n in _STATS])
    total, distinct, begins = unigrams.total, unigrams.seen, _borders(parts)
    sums = [F.sum(c).alias(c) for c in ("hot_covered", *_STATS[:K])]
    # Each has one in HOT_SHARE tokens at least, so there are no more than HOT_SHARE.
    hot = spark.sparkContext.broadcast(HotContexts(pairs_.filter(F.col("hot_key").isNotNull()).groupBy("hot_key").agg(*sums).collect()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                pairs, known, p = pair_probability(row, unigrams, d, begins, hot.value)
                base = np.log10((known + BASE) / (total + BASE * (distinct + 1)))[pairs.tokens]
                at = np.cumsum(np.r_[0, pairs.length[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(pairs.length),
                        pa.array(np.add.reduceat((known > 0)[pairs.tokens].astype(np.int64), at)),
                        pa.array(np.add.reduceat(base, at)),
                        pa.array(np.add.reduceat(np.log10(p)[pairs.nth], at)),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    whole = (
        chunks.join(_by_chunk(words_, buckets, "counts", "keys").hint("shuffle_hash"), "chunk")
        .join(_by_chunk(pairs_, buckets, "counts", "deep", "covered").withColumnRenamed("answers", "pair_answers").hint("shuffle_hash"), "chunk")
        .select("ids", "train", "lengths", "vocabulary", "tokens", "ranks", "answers", "pair_answers")
    )
    scored = save(whole.mapInArrow(trimmed(score), "doc_id long, n_tokens long, n_known long, base_score double, score double"), "katz-scores")
    spark.sql(f"DROP TABLE {name}")
    delete(spark, path)
    discard(words_, pairs_)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
