"""Chunk plans for documents: greedy packing, outlines and overlapping windows, each in one Arrow pass.

An outline is cut by prefix sums over its pieces, so that a plan stays linear in the document.

Defined cases: a null or blank body has no chunk; every row is planned by itself, so that rows of one key or of
none don't meet; a body whose headings all lead navigation has no chunk; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import bound
from docmill.operators.batches import map_batches
from docmill.operators.lines import NAVIGATION

TARGET, MOST, LEAST, CAP = 24_000, 32_000, 1_500, 40
#: How often a plan with too many chunks is made again with a larger target.
RETRIES = 5


def bin_starts(weights: Column, target: int) -> Column:
    """The places, from 0, at which a bin begins: where the next weight doesn't fit any more."""
    start = F.struct(F.lit(0).alias("nth"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("starts"))

    def step(acc, w):
        new = (acc["nth"] == 0) | (acc["held"] + w > target)
        return F.struct(
            (acc["nth"] + 1).alias("nth"), F.when(new, w).otherwise(acc["held"] + w).cast("long").alias("held"),
            F.when(new, F.concat(acc["starts"], F.array(acc["nth"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(weights, start, step, lambda acc: acc["starts"])


def slices(items: Column, starts: Column) -> Column:
    """The items of each bin."""
    cut = lambda own, at: F.transform(at, lambda first, nth: F.slice(own, first + 1, F.coalesce(F.get(at, nth + 1), F.size(own)) - first))
    return bound(items, lambda own: bound(starts, lambda at: cut(own, at)))


# -- one document ---------------------------------------------------------------------------------------------


class Chunk(NamedTuple):
    path: list[str]
    text: str
    tokens: int


_BLANK = r"[^\S\n]*"
#: A fence, table or figure with the lines that it begins and ends on, or a heading outside them.
_PART = re.compile(
    rf"^{_BLANK}(?:(?:```|~~~).*?(?:\n{_BLANK}(?:```|~~~)[^\n]*|\Z)|<table.*?(?:</table>[^\n]*|\Z)|<figure.*?(?:</figure>[^\n]*|\Z))"
    r"|^(?P<marks>#{1,4})[^\S\n]+(?P<title>[^\n]+)$",
    re.M | re.S | re.I,
)
_PARAGRAPHS = re.compile(r"\n\n+")


def packed(text: str, target: int) -> Iterator[tuple[str, int]]:
    """Paragraphs up to the target together, and the sum of their tokens."""
    parts = [p for p in _PARAGRAPHS.split(text) if p.strip()]
    sizes = [len(p) // 4 for p in parts]
    for a, b in filled(sizes, target):
        yield "\n\n".join(parts[a:b]), sum(sizes[a:b])


class Outline:
    """A document's headings as columns, in document order behind a root, with the sizes of all that stands between.

    A document is a row of pieces: of heading k, its line is piece 2k and its own text piece 2k + 1. As pieces are
    joined alike on all levels, a subtree is a span of pieces, and its length a difference of prefix sums.
    """

    def __init__(self, body: str):
        heads = [m for m in _PART.finditer(body) if m["marks"]]
        self.titles = ["", *(m["title"].strip() for m in heads)]
        edges = [0, *(m.end() for m in heads)], [*(m.start() for m in heads), len(body)]
        self.own = [body[a:b].strip() for a, b in zip(*edges)]
        # A heading stands one level below what is open, or higher up if its marks say so.
        nth = np.arange(len(self.titles))
        marks = np.array([0, *(len(m["marks"]) for m in heads)])
        self.depth = nth + np.minimum.accumulate(marks - nth)
        self.stop = np.full(len(nth), len(nth))
        self.parent = np.zeros(len(nth), dtype=np.int64)
        for level in range(1, 5):
            here = np.flatnonzero(self.depth == level)
            closing, above = np.append(np.flatnonzero(self.depth <= level), len(nth)), np.flatnonzero(self.depth == level - 1)
            self.stop[here] = closing[np.searchsorted(closing, here, "right")]
            self.parent[here] = above[np.searchsorted(above, here) - 1]
        gone = np.zeros(len(nth) + 1, dtype=np.int64)
        for k in nth[1:]:
            if self.titles[k].strip("*_`:#").strip().lower() in NAVIGATION:
                gone[k] += 1
                gone[self.stop[k]] -= 1
        self.kept = np.cumsum(gone[:-1]) == 0
        self.kept_before = np.r_[0, np.cumsum(self.kept)]
        sizes = np.zeros(2 * len(nth), dtype=np.int64)
        sizes[0::2] = np.where(self.kept & (nth > 0), self.depth + 1 + np.array([len(t) for t in self.titles]) + 2, 0)
        sizes[1::2] = [len(t) + 2 if t and keep else 0 for t, keep in zip(self.own, self.kept)]
        self.sizes, self.before = sizes, np.r_[0, np.cumsum(sizes)]

    @property
    def headings(self) -> int:
        return len(self.titles) - 1

    def text(self, pieces: list[int]) -> str:
        return "\n\n".join(self.own[p // 2] if p % 2 else f"{'#' * self.depth[p // 2]} {self.titles[p // 2]}" for p in pieces if self.sizes[p])

    def path(self, k: int) -> list[str]:
        found = []
        while k:
            found.append(self.titles[k])
            k = int(self.parent[k])
        return found[::-1] or ["Document"]

    def cut(self, target: int) -> list[tuple[int, list[int], int]]:
        """(heading, pieces, tokens) of the spans that fit: a heading too large gives way to those below it.

        The own text of one that gave way goes before the first span below it.
        """
        spans, k, ahead = [], 0, []
        while k < len(self.titles):
            stop = int(self.stop[k])
            if not self.kept[k]:
                k = stop
                continue
            first = 2 * k + 1
            tokens = max(int(self.sizes[ahead].sum() + self.before[2 * stop] - self.before[first]) - 2, 0) // 4
            if tokens > target and self.kept_before[stop] > self.kept_before[k + 1]:
                ahead, k = [*ahead, first], k + 1
                continue
            pieces = [*ahead, *range(first, 2 * stop)]
            if self.sizes[pieces].any():
                spans.append((k, pieces, tokens))
            ahead, k = [], stop
        return spans

    def chunks(self, target: int, most: int) -> list[Chunk]:
        out = []
        for k, pieces, tokens in self.cut(target):
            path, text = self.path(k), self.text(pieces)
            if tokens <= most:
                out.append(Chunk(path, text, tokens))
                continue
            out += [Chunk([*path[:-1], f"{path[-1]} (part {n})"], part, size) for n, (part, size) in enumerate(packed(text, target), 1)]
        return out


def filled(sizes: list[int], target: int, repeats: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of sizes up to the target, or of a single one; the last ``repeats`` of a span begin the next one too."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and held + size > target:
            yield first, k
            first = k - repeats
            held = sum(sizes[first:k])
        held += size
    if sizes:
        yield first, len(sizes)


def windows(body: str, target: int) -> list[Chunk]:
    """Windows of paragraphs, which end at blank lines and page rules outside fences, tables and figures.

    Each repeats the last paragraph of the one before; windows are named by their pages if there is a rule, else by
    their number.
    """
    masked = [m.span() for m in _PART.finditer(body) if not m["marks"]]
    found: list[tuple[str, int]] = []
    at, page, region, lines = 0, 1, 0, []

    def close():
        if text := "\n".join(lines).strip():
            found.append((text, page))
        lines.clear()

    while at <= len(body):
        if region < len(masked) and masked[region][0] == at:
            stop = masked[region][1]
            region += 1
            lines.append(body[at:stop])
        else:
            stop = body.find("\n", at)
            stop = len(body) if stop < 0 else stop
            line = body[at:stop].strip()
            if line in ("", "---"):
                close()
                page += line != ""
            else:
                lines.append(body[at:stop])
        at = stop + 1
    close()
    out = []
    for n, (a, b) in enumerate(filled([len(t) // 4 for t, _ in found], target, repeats=1), 1):
        text = "\n\n".join(t for t, _ in found[a:b])
        name = f"Pages ~{found[a][1]}–{found[b - 1][1]}" if page > 1 else f"Section {n}"
        out.append(Chunk([name], text, len(text) // 4))
    return out


def small_joined(tokens: list[int], least: int) -> list[int]:
    """Where the groups begin if a chunk joins those before it while they stay below ``least`` together."""
    starts, held = [], 0
    for k, size in enumerate(tokens):
        if not starts or held + size >= least:
            starts.append(k)
            held = 0
        held += size
    return starts


def cap_joined(sums: list[int], cap: int) -> list[int]:
    """Where the groups begin that are left when the lightest neighbours join, the first of equals, until ``cap`` are."""
    sums, after, before = list(sums), list(range(1, len(sums) + 1)), list(range(-1, len(sums) - 1))
    alive, left = [True] * len(sums), len(sums)
    heap = [(a + b, k, k + 1) for k, (a, b) in enumerate(zip(sums, sums[1:]))]
    heapq.heapify(heap)
    while left > max(cap, 1):
        total, a, b = heapq.heappop(heap)
        if not (alive[a] and after[a] == b and b < len(sums) and alive[b] and sums[a] + sums[b] == total):
            continue  # one of them has joined another since
        alive[b], sums[a], after[a] = False, total, after[b]
        left -= 1
        if after[b] < len(sums):
            before[after[b]] = a
            heapq.heappush(heap, (total + sums[after[b]], a, after[b]))
        if before[a] >= 0:
            heapq.heappush(heap, (sums[before[a]] + total, before[a], a))
    return [k for k, there in enumerate(alive) if there]


def grouped(chunks: list[Chunk], starts: list[int]) -> list[Chunk]:
    out = []
    for a, b in zip(starts, [*starts[1:], len(chunks)]):
        some = chunks[a:b]
        name = " + ".join(c.path[-1] for c in some)
        out.append(Chunk([*some[0].path[:-1], name], "\n\n".join(c.text for c in some), sum(c.tokens for c in some)))
    return out


def plan(body: str, target: int = TARGET, most: int = MOST, least: int = LEAST, cap: int | None = CAP, flat: bool = False) -> list[Chunk]:
    """The chunks of one document: by its headings where it has three, else (or if ``flat``) in overlapping windows."""
    outline = None if flat else Outline(body)
    for more in range(RETRIES + 1):
        if outline is None or outline.headings < 3:
            chunks = windows(body, target)
        else:
            chunks = outline.chunks(target, most)
            chunks = grouped(chunks, small_joined([c.tokens for c in chunks], least))
        if cap is None or len(chunks) <= cap:
            return chunks
        target = max(target + 1, -(-max(sum(c.tokens for c in chunks), 1) // cap))
        most = max(most, target * 4 // 3)
    return grouped(chunks, cap_joined([c.tokens for c in chunks], cap))


# -- all documents --------------------------------------------------------------------------------------------


def _each(documents: DataFrame, body: str, key: str, make: Callable[[str], list[Chunk]]) -> DataFrame:
    """doc_id, idx, heading_path, text, tokens, in one pass without a shuffle."""
    kind = documents.schema[key].dataType.simpleString()

    def planned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, nth, places, chunks = batch.column(0), [], [], []
        for k, text in enumerate(batch.column(1)):
            some = make(text.as_py() or "")
            nth += [k] * len(some)
            places += range(len(some))
            chunks += some
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(nth, pa.int64())), pa.array(places, pa.int32()), pa.array([c.path for c in chunks], pa.list_(pa.string())), pa.array([c.text for c in chunks], pa.string()), pa.array([c.tokens for c in chunks], pa.int64())],
            [key, "idx", "heading_path", "text", "tokens"],
        )

    return map_batches(documents.select(key, body), planned, f"`{key}` {kind}, idx int, heading_path array<string>, text string, tokens long")


def plan_chunks(documents: DataFrame, body: str = "body", key: str = "doc_id", **limits) -> DataFrame:
    """doc_id, idx, heading_path, text, tokens: :func:`plan` of every document."""
    return _each(documents, body, key, lambda text: plan(text, **limits))


def plan_totals(body: Column, **limits) -> Column:
    """How many chunks the plan of a body has and their tokens, as a struct; null without a chunk."""

    @F.pandas_udf("chunks long, tokens long")
    def totals(texts: pd.Series) -> pd.DataFrame:
        plans = [plan(t or "", **limits) for t in texts]
        return pd.DataFrame({"chunks": [len(p) for p in plans], "tokens": [sum(c.tokens for c in p) for p in plans]})

    found = totals(body)
    return F.when(found["chunks"] > 0, found)


def pack(documents: DataFrame, target: int = TARGET, body: str = "body", key: str = "doc_id") -> DataFrame:
    """doc_id, idx, text, tokens: paragraphs packed up to the target; tokens are the paragraphs' sum."""
    return _each(documents, body, key, lambda text: [Chunk([], *p) for p in packed(text, target)]).drop("heading_path")


def overlapping(documents: DataFrame, target: int = TARGET, body: str = "body", key: str = "doc_id") -> DataFrame:
    """doc_id, idx, heading_path, text, tokens: every document in overlapping windows, however many."""
    return plan_chunks(documents, body, key, target=target, cap=None, flat=True)
