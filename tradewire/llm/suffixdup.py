"""Removal of byte strings of ``least`` bytes or more that occur more than once in the corpus.

1. Every window of ``least`` bytes owns the ``GRAM``-byte string of least hash in it; equal
   windows own equal strings. Hashes met more than once are marked in a bitmap of bounded size.
2. Each marked place gives a span: the bytes of the windows that own it. Equal spans become one;
   a span met twice repeats as a whole.
3. Spans of one hash meet in one cell. A cell too large for a task is split by the windows'
   offsets from the owned string: windows of offsets lo to hi share all bytes from lo to
   ``least`` - hi, so they are dealt out by those bytes; at lo = hi equal spans are all that is
   left.
4. In a cell, a Burrows-Wheeler transform is built and its intervals are extended backward,
   breadth first, so that common prefixes come out by increasing length; the expansion stops at
   ``least``. Neighbours in the suffix order that are undecided by then share ``least`` bytes.
5. The repeated windows of a text are joined to it and what they cover is removed.

Equal texts stand for each other by a 128-bit hash, so a text that occurs twice goes as a whole if
it has ``least`` bytes. Matches never cross documents and are judged on the input.

Defined cases: a null text is the empty text; texts shorter than ``least`` stay; repeated rows
count as occurrences of each other; null ids pass through; an empty table gives an empty
result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewire.llm.common import MIX1, STEP, Bitmap, blocks, discard, mix64, parted, scratch

GRAM = 96  # 64 + 32
PIECE = 4_000_000


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).to_pylist()]


def owners(raw: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the owned string, first window start) of the runs of windows with one owner, in order."""
    n = len(raw) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + STEP
    power, size, half = int(MIX1), 1, None
    while size < 64:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
        if size == 32:
            half, half_power = h, np.uint64(power)
    h = h[: len(raw) - GRAM + 1] * half_power + half[64 : 64 + len(raw) - GRAM + 1]
    h = mix64(h)
    width = least - GRAM + 1
    low, size = h, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])  # the least hash of each window
    at = np.flatnonzero(h[: n + width - 1] <= _around(low, width, len(h[: n + width - 1])))
    # the last place of the least hash in each window
    last = at[np.searchsorted(at, np.arange(n) + width, side="left") - 1]
    wrong = np.flatnonzero(h[last] != low)
    while wrong.size:
        last[wrong] = at[np.searchsorted(at, last[wrong], side="left") - 1]
        wrong = wrong[h[last[wrong]] != low[wrong]]
    first = np.concatenate(([0], np.flatnonzero(last[1:] != last[:-1]) + 1))
    return mix64(h[last[first]] + STEP), last[first], first  # least hashes are small; mixed again they spread


def _around(low: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each place the largest of the minima of the windows that hold it."""
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    size = 1
    while size * 2 <= width:
        padded = np.maximum(padded[:-size], padded[size:])
        size *= 2
    return np.maximum(padded[:n], padded[width - size : width - size + n])


def pieces(raw: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Bounded parts of a long text; each window lies in exactly one."""
    for at in range(0, max(1, len(raw) - least + 1), PIECE):
        yield at, raw[at : at + PIECE + least - 1]


def shared_windows(spans: list[bytes], least: int) -> list[np.ndarray]:
    """For each span the starts of its windows of ``least`` bytes that also start elsewhere in the spans."""
    ends = np.cumsum([len(s) + 1 for s in spans])
    n = int(ends[-1])
    text = np.zeros(n, np.int64)
    text[:] = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8)
    text += len(spans)
    text[ends - 1] = np.arange(len(spans))  # each end is a symbol of its own
    # Suffix order by prefix doubling from as many symbols as a key holds, up to ``least`` symbols or until all differ.
    base, size = len(spans) + 257, 1
    while size < 4 and base ** (2 * size) < 1 << 62:
        size *= 2
    padded = np.append(text + 1, np.zeros(size, np.int64))
    key = padded[:n].copy()
    for k in range(1, size):
        key = key * base + padded[k : n + k]
    order, rank = _ranks(key)
    while size < least and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:-size] += rank[size:] + 1
        order, rank = _ranks(key)
        size *= 2
    bwt = text[order - 1]
    first = np.searchsorted(np.sort(text), np.arange(len(spans) + 256))  # C: where each symbol's suffixes begin
    last_first = np.empty(n, np.int64)
    last_first[np.argsort(bwt, kind="stable")] = np.arange(n)  # LF: the suffix one symbol longer
    undecided = np.ones(n + 1, bool)  # common prefix with the suffix before; place n closes the last interval
    undecided[0] = False
    # Intervals [lo, hi) of the strings of one symbol, then of ever longer ones, with a new boundary at hi.
    bounds = np.append(first, n)
    lo, hi = bounds[:-1], bounds[1:]
    some = lo < hi
    lo, hi = lo[some], hi[some]
    undecided[hi] = False
    for _ in range(1, least):
        if not lo.size:
            break
        width = hi - lo
        each = np.repeat(np.arange(lo.size), width)
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(each.size)
        # Suffixes of an interval with the same symbol before them are neighbours again one symbol longer.
        key = each * (len(spans) + 256) + bwt[at]
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1])))
        to = last_first[at[by]]
        new_lo = to[starts]
        new_hi = new_lo + np.diff(np.append(starts, by.size))
        fresh = undecided[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        undecided[hi] = False
    same = undecided[:n]  # shares ``least`` bytes with the suffix before
    met = same.copy()
    met[:-1] |= same[1:]
    found = np.sort(order[met])
    which = np.searchsorted(ends, found, side="right")
    cuts = np.searchsorted(which, np.arange(len(spans) + 1))
    begin = np.concatenate(([0], ends[:-1]))
    return [found[cuts[i] : cuts[i + 1]] - begin[i] for i in range(len(spans))]


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)  # equal keys have equal ranks, in whatever order
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return order, rank


def _digests(spans: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(xxhash.xxh128_digest(s) for s in spans), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


SPAN = "key long, s1 long, s2 long, lo int, hi int, owned int, bytes binary"


def _split(rows: DataFrame, least: int) -> DataFrame:
    """The two halves, by window offset, of each span of a cell: (p1, p2, shift) of the parent and the new span."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            spans: list[bytes] = []
            for r in batch.to_pylist():
                windows = len(r["bytes"]) - least + 1
                mid = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    a, b = max(0, r["owned"] - hi), min(windows - 1, r["owned"] - lo)  # window starts of these offsets
                    if a <= b:
                        common = r["bytes"][r["owned"] - lo : r["owned"] - hi + least]
                        spans.append(r["bytes"][a : b + least])
                        key = xxhash.xxh64_intdigest(common, seed=lo * 256 + hi)
                        out.append((r["s1"], r["s2"], a, key - (1 << 64) if key >> 63 else key, lo, hi, r["owned"] - a))
            p1, p2, shift, key, lo, hi, owned = zip(*out, strict=True) if out else [()] * 7
            s1, s2 = _digests(spans)
            i32, i64 = pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(p1, i64), pa.array(p2, i64), pa.array(shift, i32), pa.array(key, i64), s1, s2, pa.array(lo, i32), pa.array(hi, i32), pa.array(owned, i32), pa.array(spans, pa.binary())],
                names=["p1", "p2", "shift", "key", "s1", "s2", "lo", "hi", "owned", "bytes"],
            )

    return rows.select("key", "s1", "s2", "lo", "hi", "owned", "bytes").mapInArrow(run, "p1 long, p2 long, shift int, " + SPAN)


def _in_cells(rows: DataFrame, least: int, most: int = 200_000) -> DataFrame:
    """(s1, s2, runs) for the spans that share windows; rows come with all spans of a key in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names, found = [], []
            for (_, s1, s2, _), w in zip(held, shared_windows([x[3] for x in held], least), strict=True):
                if w.size:
                    names.append((s1, s2))
                    found.append(_runs(w))
            held.clear()
            return _run_batch(names, found)

        for batch in batches:
            for key, s1, s2, b in zip(*[batch.column(c).to_pylist() for c in ("key", "s1", "s2", "bytes")], strict=True):
                if size > most and held[-1][0] != key:
                    yield flush()
                    size = 0
                held.append((key, s1, s2, b))
                size += len(b)
        if held:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").select("key", "s1", "s2", "bytes").mapInArrow(run, "s1 long, s2 long, runs array<struct<a: int, b: int>>")


def _runs(starts: np.ndarray) -> list[dict[str, int]]:
    """Runs [a, b] of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1]), strict=True)]


def _run_batch(names: list[tuple[int, int]], found: list) -> pa.RecordBatch:
    s1, s2 = zip(*names, strict=True) if names else ((), ())
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(found, kind)], names=["s1", "s2", "runs"])


def _decide(spans: DataFrame, least: int, cell: int) -> DataFrame:
    """(s1, s2, runs): the repeated window starts of the distinct ``spans`` (SPAN and n, the times each occurs)."""
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("bytes") - least).cast("int").alias("b")))
    out = spans.where("n > 1").select("s1", "s2", whole.alias("runs"))
    counts = spans.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = scratch(spans.join(counts, "key"))
    out = out.unionByName(_in_cells(rows.where((F.col("members") <= cell) & (F.col("lo") < F.col("hi"))), least))
    large = rows.where((F.col("members") > cell) & (F.col("lo") < F.col("hi")))
    if not large.isEmpty():
        halves = scratch(_split(large, least))
        parts = halves.join(large.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), "n"), ["p1", "p2"])
        parts = parts.groupBy("s1", "s2", "key", "lo", "hi").agg(F.min("owned").alias("owned"), F.first("bytes").alias("bytes"), F.sum("n").alias("n"))
        found = _decide(scratch(parts), least, cell)
        back = halves.select("p1", "p2", "shift", "s1", "s2").join(found, ["s1", "s2"])
        moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
        out = out.unionByName(back.select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), moved.alias("runs")))
    return out


def repeats(df: DataFrame, *, text: str = "text", least: int = 200, bits: int = 28, cell: int = 1000) -> DataFrame:
    """(t1, t2, runs): for each distinct text with repeats, by its hash, the repeated window starts in bytes.

    ``bits``: the bitmap of hashes met twice has 2**bits places at most; more hashes
    make it fuller, which costs work but changes no result.
    """
    spark = df.sparkSession
    body = df.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")).where(F.octet_length("raw") >= least)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "raw", 1_000_000):
            h = [owners(p, least)[0] for raw in _raw(block, "raw") for _, p in pieces(raw, least)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    twice = scratch(body.mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    shared = spark.sparkContext.broadcast(Bitmap(twice, "h", bits))
    discard(twice)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for block in blocks(batches, "raw", 1_000_000):
            rows: list[tuple] = []
            spans: list[bytes | None] = []
            digest: list[bytes] = []
            for raw in _raw(block, "raw"):
                t1, t2 = np.frombuffer(xxhash.xxh128_digest(raw), np.int64).tolist()
                for base, part in pieces(raw, least):
                    h, at, first = owners(part, least)
                    end = np.append(first[1:], len(part) - least + 1)
                    for i in np.flatnonzero(shared.value.holds(h)).tolist():
                        a = int(first[i])
                        span = part[a : int(end[i]) - 1 + least]
                        d = xxhash.xxh128_digest(span)
                        digest.append(d)
                        spans.append(None if d in seen else span)  # the bytes once a task are enough
                        seen.add(d)
                        rows.append((t1, t2, base + a, int(h[i].view(np.int64)), int(at[i]) - a))
                if len(seen) > 300_000:
                    seen.clear()
            t1, t2, start, key, owned = zip(*rows, strict=True) if rows else [()] * 5
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(start, pa.int64()), pa.array(key, pa.int64()), pa.array(owned, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(spans, pa.binary())],
                names=["t1", "t2", "start", "key", "owned", "s1", "s2", "bytes"],
            )

    places = scratch(body.mapInArrow(cut, "t1 long, t2 long, start long, key long, owned int, s1 long, s2 long, bytes binary"))
    # Equal spans own equal strings, so the key follows from the span and one aggregation does.
    spans = places.groupBy("s1", "s2").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.min("owned").alias("owned"), F.max("bytes").alias("bytes"))
    spans = scratch(spans.withColumns({"lo": F.lit(0), "hi": F.lit(least - GRAM)}))
    found = _decide(spans, least, cell)
    found = places.select("t1", "t2", "start", "s1", "s2").distinct().join(found, ["s1", "s2"])
    runs = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    return found.select("t1", "t2", F.explode(runs).alias("run")).groupBy("t1", "t2").agg(F.sort_array(F.collect_list("run")).alias("runs"))


def dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 200, bits: int = 28, cell: int = 1000) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of each row; removed: array of (start, end) in bytes, kept: the bytes left."""
    found = scratch(repeats(df, text=text, least=least, bits=bits, cell=cell))
    kind = dict(df.dtypes)[doc_id]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "raw"):
            raw = _raw(batch, "raw")
            t1, t2 = _digests(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns, t1, t2], names=["doc_id", "raw", "t1", "t2"])

    # Only texts whose hash is marked meet their runs; the others hold no repeat and are not moved.
    some, rest = parted(rows.mapInArrow(named, f"doc_id {kind}, raw binary, t1 long, t2 long"), "t1", Bitmap(found, "t1"), "raw")
    some = some.join(found, ["t1", "t2"], "left").select("doc_id", "raw", "runs")
    rest = rest.select("doc_id", "raw", F.lit(None).cast("array<struct<a: bigint, b: bigint>>").alias("runs"))

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for block in blocks(batches, "raw"):
            spans, kept, size = [], [], []
            for raw, runs in zip(_raw(block, "raw"), block.column("runs").to_pylist(), strict=True):
                mine: list[list[int]] = []
                for r in runs or ():
                    if mine and r["a"] <= mine[-1][1]:
                        mine[-1][1] = max(mine[-1][1], r["b"] + least)
                    else:
                        mine.append([r["a"], r["b"] + least])
                at, left = 0, []
                for a, b in mine:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                spans.append([{"start": a, "end": b} for a, b in mine])
                kept.append(b"".join(left))
                size.append(len(raw))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    schema = f"doc_id {kind}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
    return some.mapInArrow(remove, schema).unionByName(rest.mapInArrow(remove, schema))


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur twice."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
