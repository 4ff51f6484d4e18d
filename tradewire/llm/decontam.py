"""Benchmark decontamination by greedy string tiling.

Items and documents are cut into words. Seeds, runs of ``min_match`` words that an item shares
with a document, are joined first; then, over what the seeds cover, the longest unmarked common
runs are marked again and again by running Karp-Rabin (the search length falls by halves to
``min_match``, and rises again when a longer match turns up). The share of an item's words under
tiles is its coverage; tiles may lie in any order, so reordered passages count in full. Items
shorter than ``min_match`` must occur as one run.

The benchmark is read in blocks of at most ``block_bytes`` of text; each block meets all
documents, one after another, so nothing unbounded is broadcast and no item is left out.

Defined cases: null or empty documents match nothing; null or wordless items are ignored;
repeated documents and items are judged each; an empty benchmark gives no matches; extra columns
do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradewire.llm.common import STEP, blocks, discard, mix64, scratch, small_batches, texts, words

def tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the greedy tiling. Negative words in ``doc`` match nothing."""
    least = max(1, min(least, len(item)))
    mine, theirs = [False] * len(item), [False] * len(doc)
    out: list[tuple[int, int, int]] = []
    size = min(len(item), len(doc))
    while size >= least:
        table: dict[int, list[int]] = defaultdict(list)
        for at, h in _rolling(item, mine, size):
            table[h].append(at)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for q, h in _rolling(doc, theirs, size):
            for p in table.get(h, ()):
                k = 0
                while p + k < len(item) and q + k < len(doc) and item[p + k] == doc[q + k] and not mine[p + k] and not theirs[q + k]:
                    k += 1
                if k >= size:  # else the hashes only seemed equal
                    found.append((k, p, q))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k, p, q in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not any(mine[p : p + k]) and not any(theirs[q : q + k]):
                mine[p : p + k] = theirs[q : q + k] = [True] * k
                out.append((p, q, k))
        if size == least and not found:  # a pass that marks may leave the head of a match it cut: look again
            break
        size = max(least, size // 2)
    return out


def _rolling(seq: list[int], marked: list[bool], size: int, base: int = 1_000_003, mod: int = (1 << 61) - 1) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of ``size`` unmarked words."""
    top = pow(base, size - 1, mod)
    h = run = 0
    for i, w in enumerate(seq):
        if marked[i] or w < 0:
            h = run = 0
            continue
        if run >= size:
            h = (h - seq[i - size] * top) % mod
        h = (h * base + w) % mod
        run += 1
        if run >= size:
            yield i - size + 1, h


def _codes_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that start at ``at``."""
    out = np.zeros(at.size, np.uint64)
    for k in range(n):
        out = mix64(out + STEP + ids[at + k].astype(np.uint64))
    return out


class Items:
    """A bounded block of benchmark items, indexed by seed."""

    def __init__(self, rows: list[tuple[object, str]], least: int):
        self.least, self.ids, self.items, self.vocabulary = least, [], [], {}
        self.by_length: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            item = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if item:
                n = min(least, len(item))
                for code in set(_codes_at(np.array(item), np.arange(len(item) - n + 1), n).tolist()):
                    self.by_length[n][code].append(len(self.items))
                self.ids.append(item_id)
                self.items.append(item)
        self.by_length = {n: dict(v) for n, v in self.by_length.items()}
        self.seeds = {n: np.array(sorted(v), np.uint64) for n, v in self.by_length.items()}

    def matches(self, text: str, threshold: float) -> list[tuple[object, float, int, int, int, int]]:
        """(item, coverage, words matched, words, tiles, longest tile) of each item with coverage from ``threshold``."""
        w = words(text)
        ids = np.fromiter(map(self.vocabulary.get, w, [0] * len(w)), np.int64, len(w))
        out = []
        for n, seeds in self.seeds.items():
            if ids.size < n:
                continue
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            whole = np.flatnonzero(known[n:] - known[:-n] == n)
            if not whole.size:
                continue
            codes = _codes_at(ids, whole, n)
            hit = seeds[np.minimum(np.searchsorted(seeds, codes), seeds.size - 1)] == codes
            places: dict[int, list[int]] = defaultdict(list)
            for at, code in zip(whole[hit].tolist(), codes[hit].tolist(), strict=True):
                for item in self.by_length[n][code]:
                    places[item].append(at)
            for item, ats in sorted(places.items()):
                part: list[int] = []
                end = -1
                for at in ats:  # the words under seeds; a gap becomes one word that matches nothing
                    if at > end and part:
                        part.append(-1)
                    part.extend(ids[max(at, end) : at + n].tolist())
                    end = at + n
                found = tiles(self.items[item], part, n)
                total, size = sum(k for *_, k in found), len(self.items[item])
                if total >= threshold * size:
                    out.append((self.ids[item], total / size, total, size, len(found), max(k for *_, k in found)))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, least: int, block_bytes: int) -> Iterator[Items]:
    rows: list[tuple[object, str]] = []
    held = 0
    for r in benchmark.select(F.col(item_id), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1])
        if held >= block_bytes:
            yield Items(rows, least)
            rows, held = [], 0
    if rows:
        yield Items(rows, least)


def _hits(df: DataFrame, items: Items, schema: T.StructType, threshold: float) -> tuple[DataFrame, Broadcast]:
    """(doc_id, …) of ``df`` (doc_id, text) with one block of items, and the block as it was sent out."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(items)  # at most block_bytes of text
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = [(i, *m) for i, t in enumerate(texts(block, "text")) for m in shared.value.matches(t, threshold)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            ids = block.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns[1:], list(arrow)[1:], strict=True)]], schema=arrow)

    return df.mapInArrow(run, schema), shared


def matches(df: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5, block_bytes: int = 8_000_000) -> DataFrame:
    """A row for each (document, item) whose coverage reaches ``threshold``; ids keep their types.

    A benchmark of one block is a map over the documents. Of more, one block at a time is sent out, and
    its matches are written before the next is read.
    """
    longs = ("n_matched", "n_words", "n_tiles", "longest")
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("coverage", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in longs]])
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done: DataFrame | None = None
    last = None
    for items in item_blocks(benchmark, item_id, item_text, min_match, block_bytes):
        if last is not None:
            done = _written(done, *_hits(docs, last, schema, threshold))
        last = items
    if last is None:
        return df.sparkSession.createDataFrame([], schema)
    if done is None:
        return _hits(docs, last, schema, threshold)[0]
    return _written(done, *_hits(docs, last, schema, threshold))


def _written(done: DataFrame | None, hits: DataFrame, shared: Broadcast) -> DataFrame:
    part = scratch(hits)
    shared.destroy()
    return part if done is None else done.unionByName(part)


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5, block_bytes: int = 8_000_000) -> DataFrame:
    """The rows of ``df`` that reach ``threshold`` with no item; no shuffle, no join.

    Of a benchmark of several blocks, one at a time is sent out; the rows left are written before the next.
    """
    last = None
    for items in item_blocks(benchmark, item_id, item_text, min_match, block_bytes):
        if last is not None:
            part, shared = _clean(df, text, last, threshold)
            before, df = df, scratch(part)
            shared.destroy()
            discard(before)
        last = items
    return df if last is None else _clean(df, text, last, threshold)[0]


def _clean(df: DataFrame, text: str, items: Items, threshold: float) -> tuple[DataFrame, Broadcast]:
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(items)  # at most block_bytes of text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield block.filter(pa.array([not shared.value.matches(t, threshold) for t in texts(block, text)], pa.bool_()))

    return df.mapInArrow(run, df.schema), shared


def op8(spark, sf_dir: str) -> DataFrame:
    """(document, benchmark item) pairs with half of the item's words or more under tiles."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
