"""Benchmark decontamination by Wu-Manber search over words.

A text is a sequence of words and a pattern a window of 10 consecutive words of a benchmark item, or all
words of a shorter item. Patterns of one length share a search. Its shift table holds, for each block of
two words, how far a window's end can move when the block is read there: 0 if some pattern ends with it,
9 words if no pattern of 10 has it. Positions skipped are never hashed or compared. Where the shift is 0,
the block's hash picks the bucket of patterns that end with it, and these are compared word by word, then
byte by byte. Documents are cut by window ends into stretches that are walked side by side; a window may
reach back over a stretch's start, so none is lost.

Only pattern tables travel to the documents, in blocks of ``BLOCK_BYTES`` of benchmark text, however large the
benchmark is; texts are not shuffled, and one pass over them applies every block in turn.

Defined cases: null or wordless documents have no words and are clean; wordless items have no window; items
without an id are searched for but not named or counted; repeated items count once; repeated documents and
further columns are kept; an empty benchmark leaves everything clean; texts are searched whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.shared import trimmed
from docmill.llm.textvec import ALNUM, hash_runs, hash_words, slices, words

WINDOW = 10
BLOCK_WORDS = 2
#: Benchmark text in one block of patterns.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 20
STRETCH = 256

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


@dataclass
class Search:
    """The tables for all patterns of one length."""

    length: int
    block: int
    shift: np.ndarray
    suffixes: np.ndarray
    hashes: np.ndarray
    texts: list[bytes]
    items: list[list]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def build_searches(items: list[tuple]) -> list[Search]:
    """From (item_id, text) rows."""
    found: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    for item_id, text in items:
        for s in slices(pa.array([text], pa.string())):
            starts, ends, _ = words(s, ALNUM)
            if not len(starts):
                continue
            h = hash_words(s.data, starts, ends)
            parts = [s.data[a:b].tobytes() for a, b in zip(starts, ends)]
            length = min(WINDOW, len(parts))
            for i in range(len(parts) - length + 1):
                entry = found.setdefault(length, {}).setdefault(b" ".join(parts[i : i + length]), (h[i : i + length], set()))
                if item_id is not None:
                    entry[1].add(item_id)
    out = []
    for length, patterns in found.items():
        hashes = np.array([h for h, _ in patterns.values()], dtype=np.uint64)
        block = min(BLOCK_WORDS, length)
        shift = np.full(1 << TABLE_BITS, length - block + 1, dtype=np.uint8)
        for j in range(length - block + 1):  # later blocks have smaller shifts and overwrite
            ends_here = _run_hash(hashes[:, j : j + block])
            shift[_cell(ends_here)] = length - block - j
        suffixes = _run_hash(hashes[:, length - block :])
        order = np.argsort(suffixes, kind="stable")
        texts, ids = list(patterns), [sorted(x, key=str) for _, x in patterns.values()]
        out.append(Search(length, block, shift, suffixes[order], hashes[order], [texts[i] for i in order], [ids[i] for i in order]))
    return out


def _run_hash(columns: np.ndarray) -> np.ndarray:
    """As hash_runs has it, for a matrix whose rows are runs."""
    n = columns.shape[1]
    flat = np.ascontiguousarray(columns).reshape(-1)
    return hash_runs(flat, n)[::n]


def occurrences(search: Search, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of the words ``h`` have a pattern's word hashes: window ends, and the patterns.

    ``rows``: where each document's words begin, with the total behind.
    """
    first = rows[:-1] + search.length - 1
    spare = np.maximum(rows[1:] - first, 0)
    pieces = -(-spare // STRETCH)
    if not pieces.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[doc] + nth * STRETCH
    until = np.minimum(at + STRETCH, rows[1:][doc])
    ends, patterns = [], []
    while at.size:
        block = np.stack([h[at - search.block + 1 + i] for i in range(search.block)], axis=1)
        key = _run_hash(block)
        step = search.shift[_cell(key)].astype(np.int64)
        stop = np.flatnonzero(step == 0)
        if stop.size:
            low = np.searchsorted(search.suffixes, key[stop], "left")
            many = np.searchsorted(search.suffixes, key[stop], "right") - low
            where = np.repeat(at[stop], many)
            pattern = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            for i in range(search.length):
                same = h[where - i] == search.hashes[pattern, search.length - 1 - i]
                where, pattern = where[same], pattern[same]
            ends.append(where)
            patterns.append(pattern)
        at = at + np.maximum(step, 1)
        more = at < until
        at, until = at[more], until[more]
    return (np.concatenate(ends), np.concatenate(patterns)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scan(texts: pa.Array, blocks) -> list[pa.Array]:
    """The columns of ``FOUND`` for each text. ``blocks``: a callable that yields lists of searches."""
    columns: list[list] = [[], [], [], [], []]
    for s in slices(texts):
        starts, ends, rows = words(s, ALNUM)
        h = hash_words(s.data, starts, ends)
        cover = np.zeros(len(starts) + 1, dtype=np.int64)
        named: dict[int, set] = {}
        for searches in blocks():
            for search in searches:
                at, pattern = occurrences(search, h, rows)
                doc = np.searchsorted(rows, at, "right") - 1
                for e, p, d in zip(at.tolist(), pattern.tolist(), doc.tolist()):
                    b = e - search.length + 1
                    if b" ".join(s.data[starts[i] : ends[i]].tobytes() for i in range(b, e + 1)) == search.texts[p]:
                        cover[b] += 1
                        cover[e + 1] -= 1
                        named.setdefault(d, set()).update(search.items[p])
        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
        n_hit = hit[rows[1:]] - hit[rows[:-1]]
        ids = [sorted(map(str, named.get(d, ()))) for d in range(s.last - s.first)]
        columns[0].append(np.diff(rows))
        columns[1].append(n_hit)
        columns[2] += [len(x) for x in ids]
        columns[3] += [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
        columns[4].append(n_hit > 0)
    whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return [
        whole(columns[0], pa.int64()),
        whole(columns[1], pa.int64()),
        pa.array(columns[2], pa.int64()),
        pa.array(columns[3], pa.string()),
        whole(columns[4], pa.bool_()),
    ]


def _blocks(benchmark: DataFrame, most: int) -> list[Broadcast]:
    """The benchmark's patterns, a bounded block at a time: no block of items above ``most`` bytes is gathered."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most)
    context = benchmark.sparkSession.sparkContext
    return [
        context.broadcast(pickle.dumps(build_searches([(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])))
        for k in range(n)
    ]


def _loader(blocks: list[Broadcast]):
    """Yields each block's searches; a single block stays loaded, of several only one is held at a time."""
    kept = pickle.loads(blocks[0].value) if len(blocks) == 1 else None

    def load():
        if kept is not None:
            yield kept
            return
        for b in blocks:
            yield pickle.loads(b.value)

    return load


def find_contamination(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and the columns of ``FOUND`` for each document."""
    blocks = _blocks(benchmark, most)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _loader(blocks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *scan(batch.column(1), load)], ["doc_id", *FOUND.names])

    schema = T.StructType([documents.schema["doc_id"], *FOUND])
    return documents.select("doc_id", "text").mapInArrow(trimmed(found), schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, without those that hold a window of the benchmark."""
    blocks = _blocks(benchmark, most)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _loader(blocks)
        for batch in batches:
            hit = scan(batch.column(batch.schema.names.index("text")), load)[4]
            yield batch.filter(pc.invert(hit))

    return documents.mapInArrow(trimmed(clean), documents.schema)
