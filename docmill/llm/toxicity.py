"""Toxicity by compression distance: window lengths under an ordinary and a toxic zstandard dictionary.

A window is one word of the running text (A-Z lower-cased), as a code of ``CODE`` bytes made from its hash, so that
each word weighs alike, however it is spelt, and no part of one word matches another. A document gives training each
of its windows once. Both dictionaries are trained
by zstandard's own trainer (COVER), each on text of its own: the ordinary one on ordinary documents, the toxic one on
toxic documents. A window is toxic if its compressed length under the ordinary dictionary exceeds that under the
toxic one by ``GAIN`` bytes.

Training takes a bounded sample of labelled documents of any length: by digest, until a class has its number of
documents or of bytes. Three quarters of it train the dictionaries, in two steps. First, a pair of dictionaries is
trained on either half of these documents and tells toxic windows in the other half. Then the toxic dictionary is
trained on the toxic documents' toxic windows alone, and the ordinary one on the ordinary text with the windows
that looked toxic in it once more. The last quarter calibrates: how often ordinary windows exceed the gain, and
which excess of a document's toxic windows over that stands for which share of toxic documents.

Scoring reads whole texts, in one pass without a shuffle; a window is compressed once for each slice.

Defined cases: a null or wordless text scores as a document without toxic windows; without labels of both
classes every document gets the share of toxic labels, 0 if there are none; repeated rows score alike, and train
once: of texts that share a doc_id, the longest, of equals the last by code point;
doc_id null is not held out; a text that alone has
more bytes than the sample of its class is scored but can't train; labels that differ for one doc_id count as toxic; further columns are kept by
:func:`drop_toxic`; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.shared import release, save, trimmed
from docmill.llm.textvec import ALNUM, hash_words, mix64, slices, words

#: Labelled documents of each class that training takes at most, and the bytes of text that it takes of either class.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 3000, 5000, 16 << 20
#: Bytes of a window, the saved bytes that make it toxic, the compression level, and tables in which a dictionary's places hardly collide.
CODE, GAIN, LEVEL, TABLE_BITS = 16, 7, 3, 21
#: Bytes of either dictionary at most. The toxic one holds the more frequent words alone, most of which the ordinary one holds too.
ORDINARY_BYTES, TOXIC_BYTES = 1 << 20, 64 << 10
#: COVER's pieces, their hashed parts and the bits of the hash, and windows that make room for a header.
PIECE, PART, PART_BITS, FILLER = CODE, 8, 22, 32
#: Rows of the overall share that smooth a step of the calibration.
PRIOR = 1.0
THRESHOLD = 0.7
#: Windows remembered by a worker.
REMEMBERED = 400_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice: the hash of each word, and where rows begin."""
    for s in slices(texts):
        starts, ends, rows = words(s, ALNUM)
        yield hash_words(s.data, starts, ends), rows


def codes(hashes: np.ndarray) -> bytes:
    """The windows of words, one after the other."""
    return np.stack([hashes, mix64(hashes + np.uint64(CODE))], axis=1).astype("<u8").tobytes()


def train_dictionary(hashes: np.ndarray, most: int) -> bytes:
    """Dictionary of the windows of words; of fewer than the trainer takes, the windows themselves.

    Each window is a sample of its own, and they are shuffled, as the trainer takes one piece from each stretch in
    turn and stops after some that add nothing, such as copies. What it takes first it puts last, where it then cuts
    off as much as its header needs if the dictionary is full; ``FILLER`` windows, more frequent than any word, are
    there to be cut.
    """
    distinct, times = np.unique(hashes, return_counts=True)
    full = (len(distinct) + FILLER) * CODE > most
    filler = np.repeat(mix64(np.arange(1, FILLER + 1, dtype=np.uint64)), int(times.max(initial=0)) * 3 // 2 + 16 if full else 0)
    every = np.random.default_rng(len(hashes)).permutation(np.concatenate([hashes, filler]))
    windows = codes(every)
    samples = [windows[i : i + CODE] for i in range(0, len(windows), CODE)]
    try:
        return zstandard.train_dictionary(most, samples, k=PIECE, d=PART, f=PART_BITS, accel=1).as_bytes()
    except zstandard.ZstdError:
        return codes(hashes)[-most:]


class Gains:
    """Toxic windows, by two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, hash_log=TABLE_BITS, chain_log=TABLE_BITS, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        self.known: dict[int, bool] = {}
        self.compress = []
        for content in (ordinary, toxic):  # as content alone: entropy tables of either text would blur the lengths
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            self.compress.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress)

    def toxic(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each word's window is toxic."""
        distinct, nth = np.unique(hashes, return_inverse=True)
        raw, known, out = codes(distinct), self.known, np.zeros(len(distinct), dtype=bool)
        if len(known) > REMEMBERED:
            known.clear()
        ordinary, toxic = self.compress
        for i, key in enumerate(distinct.tolist()):
            found = known.get(key)
            if found is None:
                window = raw[i * CODE : (i + 1) * CODE]
                found = known[key] = len(ordinary(window)) - len(toxic(window)) >= GAIN
            out[i] = found
        return out[nth]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Toxic windows and all windows of each text."""
        out = []
        for hashes, rows in _word_hashes(texts):
            so_far = np.r_[0, np.cumsum(self.toxic(hashes))]
            out.append(np.stack([so_far[rows[1:]] - so_far[rows[:-1]], np.diff(rows)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def build_dictionaries(texts: pa.Array, toxic: np.ndarray) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    place = np.zeros(len(toxic), dtype=np.int64)
    for c in (0, 1):
        place[toxic == c] = np.arange((toxic == c).sum())
    found: dict[tuple[int, int], list[np.ndarray]] = {(c, h): [] for c in (0, 1) for h in (0, 1)}
    done = 0
    for hashes, rows in _word_hashes(texts):
        for i in range(len(rows) - 1):
            found[int(toxic[done]), int(place[done]) % 2].append(np.unique(hashes[rows[i] : rows[i + 1]]))
            done += 1
    text = {key: np.concatenate([np.zeros(0, np.uint64), *parts]) for key, parts in found.items()}
    del found
    halves = [Gains(train_dictionary(text[0, h], ORDINARY_BYTES), train_dictionary(text[1, h], TOXIC_BYTES)) for h in (0, 1)]
    told = {(c, h): text[c, h][halves[1 - h].toxic(text[c, h])] for c, h in text}
    ordinary = np.concatenate([text[0, 0], text[0, 1], told[0, 0], told[0, 1]])
    harmful = np.concatenate([told[1, 0], told[1, 1]])
    if not len(harmful):  # nothing toxic that documents share
        harmful = np.concatenate([text[1, 0], text[1, 1]])
    del text, told, halves
    return train_dictionary(ordinary, ORDINARY_BYTES), train_dictionary(harmful, TOXIC_BYTES)


def excess(counts: np.ndarray, rate: float) -> np.ndarray:
    """How far toxic windows exceed those that the rate of ordinary text lets expect."""
    expected = rate * counts[:, 1]
    return np.maximum(counts[:, 0] - expected, 0) / np.sqrt(expected + 1)


def calibrate(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of x and the share of toxic weight from each on, which never falls: pooled adjacent violators.

    A step counts ``PRIOR`` rows more, of the overall share.
    """
    share = float((weight * toxic).sum() / weight.sum())
    at, nth = np.unique(x, return_inverse=True)
    steps: list[list[float]] = []
    for lowest, every, bad in zip(at, np.bincount(nth, weight), np.bincount(nth, weight * toxic)):
        steps.append([lowest, every, bad])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, more, worse = steps.pop()
            steps[-1] = [steps[-1][0], steps[-1][1] + more, steps[-1][2] + worse]
    lowest, every, bad = np.array(steps).T
    return lowest, np.maximum.accumulate((bad + PRIOR * share) / (every + PRIOR))


class Model:
    """Dictionaries, the rate of toxic windows in ordinary text and thresholds with their scores; ``prior`` alone where there was nothing to learn."""

    def __init__(self, prior: float, contents: tuple[bytes, bytes] | None = None, rate: float = 0.0, steps: tuple[np.ndarray, np.ndarray] | None = None):
        self.prior, self.contents, self.rate, self.steps = prior, contents, rate, steps
        self.gains: Gains | None = None

    def __getstate__(self):
        return (self.prior, self.contents, self.rate, self.steps)

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.contents is None or self.steps is None:
            return np.full(len(texts), self.prior)
        if self.gains is None:
            self.gains = Gains(*self.contents)
        thresholds, shares = self.steps
        x = excess(self.gains.counts(texts), self.rate)
        return shares[np.maximum(np.searchsorted(thresholds, x, "right") - 1, 0)]


def train(texts: pa.Array, toxic: np.ndarray, calibrates: np.ndarray, odds: float | None = None) -> Model:
    """From a sample; rows that ``calibrates`` marks set the scores, all others the dictionaries.

    ``odds``: toxic labels for each ordinary one among all labels, where the sample's are others.
    """
    prior = float(toxic.mean()) if odds is None and len(toxic) else odds / (1 + odds) if odds else 0.0
    parts = [toxic[~calibrates], toxic[calibrates]]
    if any(len(y) == 0 or y.min() == y.max() for y in parts):
        return Model(prior)
    contents = build_dictionaries(texts.filter(pa.array(~calibrates)), parts[0])
    counts = Gains(*contents).counts(texts.filter(pa.array(calibrates)))
    ordinary = counts[parts[1] == 0]
    rate = (ordinary[:, 0].sum() + 1) / (ordinary[:, 1].sum() + 1)
    sampled = parts[1].mean() / (1 - parts[1].mean())
    weight = np.where(parts[1] == 1, (odds or sampled) / sampled, 1.0)
    return Model(prior, contents, float(rate), calibrate(excess(counts, rate), parts[1], weight))


def calibration_rows(toxic: np.ndarray) -> np.ndarray:
    """Every fourth row of each class, by place: the digests that rows are drawn by are the smallest of many labels, so their digits say nothing."""
    late = np.zeros(len(toxic), dtype=bool)
    for c in (0, 1):
        late[np.flatnonzero(toxic == c)[1::4]] = True
    return late


def train_on(documents: DataFrame, labels: DataFrame) -> Model:
    """From labelled documents that aren't held out: a sample bounded by the constants above, by doc_id digest."""
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("digest", digest)
    )
    # Labels meet their documents before the draw, so that it is as large as it may be.
    there = documents.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    labelled = save(known.join(there, "doc_id").filter(F.col("size") <= SAMPLE_BYTES).select("doc_id", "digest", "size", "toxic"), "labelled")
    many = {r["toxic"]: r["count"] for r in labelled.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    drawn = [
        labelled.filter(F.col("toxic") == c).orderBy("digest").limit(most)
        for c, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))
    ]
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    sample = drawn[0].unionByName(drawn[1]).withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES)
    sample = F.broadcast(sample.drop("so_far"))  # at most SAMPLE_TOXIC + SAMPLE_ORDINARY rows
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(sample, "doc_id")
    one = texts.filter(F.octet_length("text") == F.col("size")).groupBy("doc_id", "toxic", "size", "digest").agg(F.max("text").alias("text"))
    odds = many[True] / many[False] if len(many) == 2 else None

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("toxic", pa.int32())]))
        toxic = rows.column("toxic").to_numpy().astype(np.int64)
        texts = rows.column("text").combine_chunks() if len(rows) else pa.array([], pa.string())
        model = train(texts, toxic, calibration_rows(toxic), odds)
        del rows, texts
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # One task, as the sample is bounded. By length, so that the calibration rows are of all lengths.
    rows = one.select("text", "toxic", "size", "digest").repartition(1).sortWithinPartitions(F.desc("size"), "digest").select("text", "toxic")
    found = rows.mapInArrow(fitted, "model binary").collect()  # one row; none without a labelled text
    return pickle.loads(found[0]["model"]) if found else Model(0.0)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = documents.sparkSession.sparkContext.broadcast(train_on(documents, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    schema = T.StructType(
        [documents.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    found = documents.select("doc_id", "text").mapInArrow(trimmed(scored), schema)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    model = documents.sparkSession.sparkContext.broadcast(train_on(documents, labels))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch.column(batch.schema.names.index("text")))
            yield batch.filter(pc.less(pa.array(score), THRESHOLD))

    return documents.mapInArrow(trimmed(clean), documents.schema)
