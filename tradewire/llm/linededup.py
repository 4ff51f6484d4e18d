"""Substring dedup by line or paragraph hashing.

Texts are cut into units (lines, paragraphs between blank lines, or the sentences of lines); a unit's
normal form (lower case, runs of blanks as one) is hashed to 128 bits. Digests are grouped over the
whole corpus; the occurrence that comes first by (document id, text, place) stays, all others are repeats.
Repeats go in passages: neighbouring repeats of one document, blank units between them not counted,
that reach ``least_words`` words together. A repeated unit that is long by itself is a passage; a short one
alone (a licence line, a common phrase) stays. With ``least_words=1`` every repeat goes. In scripts
without spaces, and in runs without blanks such as base64, each ``WORD`` characters count as a word. Offsets are
code points of the original text.

A passage that begins and ends within sentences holds too few whole ones. So the unit ``passage``, the default, has
two kinds of units: the sentences, and running paragraphs of ``least_words`` words that begin at places which the words
themselves choose: the least hash among each ``GAP`` neighbouring places. Any ``least_words + GAP - 1`` words
that stand in two texts begin one of these paragraphs at the same word in both. Repeats that touch or overlap are one passage.

A 64-bit hash of every unit is counted. A bitmap of the hashes that occur twice spares the other units the 128-bit
digest and the second shuffle, and only texts that lose a passage are moved.

Defined cases: a null text is the empty text; of repeated rows the first keeps its units and the
others lose them, as any two documents with equal ids; null ids rank first; an empty table gives
an empty result; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewire.llm.common import STEP, Bitmap, blocks, discard, mix64, parted, scratch, texts

_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r\f\v]*\n\s*"), "sentence": re.compile(r"\n|(?<=[.!?。！？])[ \t]+|(?<=[。！？])")}
_BREAK["passage"] = _BREAK["sentence"]
_BLANKS = re.compile(r"[ \t\r\f\v\n]+")
_UNEVEN = re.compile(r"[\t\r\f\v\n]|  ")  # any blanks but single spaces
#: So many characters without a blank count as a word more.
WORD = 10
#: Among so many neighbouring places one begins a running paragraph.
GAP = 12
PLACE = "at int, words int, start int, end int"
_BLANK, _END, _WIDE = 1, 2, 4
_KIND = np.array([_BLANK * chr(c).isspace() + _END * (chr(c) in ".!?。！？") + _WIDE * (chr(c) in "。！？") for c in range(0xFF21)], np.uint8)
_BASE = 0xD1342543DE82EF95


def units(text: str, unit: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normal form) of each unit, without its separator."""
    at = 0
    for m in _BREAK[unit].finditer(text):
        start, end = m.span()
        yield at, start, normal(text[at:start])
        at = end
    yield at, len(text), normal(text[at:])


def normal(text: str) -> str:
    """Lower case, runs of blanks as one and none at the ends."""
    return (_BLANKS.sub(" ", text) if _UNEVEN.search(text) else text).strip(" ").lower()


def n_units(text: str, unit: str) -> int:
    """How many units are not blank; this needs no normal form."""
    return sum(1 for x in _BREAK[unit].split(text) if x.strip(" \t\r\f\v\n"))


def n_words(norm: str) -> int:
    """Words between blanks; long ones count by their characters."""
    return max(norm.count(" ") + 1, sum(1 + (len(w) - 1) // WORD for w in norm.split(" ")) if len(norm) > 2 * WORD * (norm.count(" ") + 1) else 0)


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size < n:
            run = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, base, np.uint64))), dtype=np.uint64)
            self.up, self.down = run(_BASE), run(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_powers = _Powers()
#: Factors of a word's characters by their place.
_FACTORS = mix64(np.arange(1, 4097, dtype=np.uint64) * STEP) | np.uint64(1)


def lowered(text: str) -> str:
    """Lower case of the same length."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


def _pieces(points: np.ndarray, kind: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with long ones cut into pieces, at places which two neighbouring characters choose and after wide full stops: (starts, sizes, weights)."""
    inner = np.flatnonzero(kind & _BLANK == 0)  # the characters of words, in order
    pair = mix64(points[np.maximum(inner, 1) - 1].astype(np.uint64) * STEP + points[inner].astype(np.uint64))
    last = (kind[inner] & _WIDE > 0) | (np.repeat(sizes > 2 * WORD, sizes) & (pair & np.uint64(7) == 0))
    last[np.cumsum(sizes) - 1] = True
    a, b = inner[np.concatenate(([True], last[:-1]))], inner[last] + 1
    long_ = (sizes > 2 * WORD)[np.searchsorted(starts, a, side="right") - 1]
    return a, b - a, np.where(long_, b - a, WORD)


def _chosen(keys: np.ndarray) -> np.ndarray:
    """Places whose key is the least of some ``GAP`` neighbours (of all, where there are fewer)."""
    if keys.size <= GAP:
        return np.flatnonzero(keys == keys.min()) if keys.size else np.zeros(0, np.int64)

    def over(x: np.ndarray, take: np.ufunc) -> np.ndarray:
        size = 1
        while size < GAP:
            by = min(size, GAP - size)
            x, size = take(x[:-by], x[by:]), size + by
        return x

    edge = np.zeros(GAP - 1, np.uint64)
    return np.flatnonzero(over(np.concatenate((edge, over(keys, np.minimum), edge)), np.maximum) == keys)


def spread(lower: str, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit hashes) of the sentences and running paragraphs of a text in lower case.

    A place is (at, to, start, end), where at and to are the text's size before and after the unit in tenths of words.
    """
    points = np.frombuffer(lower.encode("latin-1"), np.uint8) if lower.isascii() else np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[points if lower.isascii() else np.where(points < _KIND.size, points, 0x61)]
    edge = np.concatenate(([1], kind & _BLANK, [1])).astype(np.int8)
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    if not starts.size:
        return np.zeros((0, 4), np.int32), np.zeros(0, np.uint64)
    if sizes.max() > 2 * WORD or (not lower.isascii() and (kind & _WIDE).any()):
        starts, sizes, weight = _pieces(points, kind, starts, sizes)
        size = np.concatenate(([0], np.cumsum(weight)))
    else:
        size = np.arange(starts.size + 1) * WORD
    n, ends = starts.size, starts + sizes

    # Words by their characters, then units by their words.
    before = np.cumsum(sizes) - sizes
    letters = points[kind & _BLANK == 0].astype(np.uint64)
    letters *= _FACTORS[(np.arange(letters.size) - np.repeat(before, sizes)) & 4095]
    own = mix64(np.add.reduceat(letters, before) + sizes.astype(np.uint64))
    up, down = _powers.to(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * up[:n], dtype=np.uint64)))

    breaks = kind[ends[:-1] - 1] & _END > 0
    after = np.searchsorted(starts, np.flatnonzero(points == 10))
    breaks[after[(after > 0) & (after < n)] - 1] = True
    edges = np.concatenate(([0], np.flatnonzero(breaks) + 1, [n]))

    to = np.searchsorted(size, size[:-1] + least_words * WORD)
    to = to[: np.searchsorted(to, n, side="right")]  # paragraphs that fit
    at = _chosen(mix64(own[: to.size] + STEP * np.append(own[1:], np.uint64(0))[: to.size]))
    ranges = np.concatenate((np.stack((edges[:-1], edges[1:]), 1), np.stack((at, to[at]), 1)))
    a, b = ranges[:, 0], ranges[:, 1]
    hashes = mix64((sums[b] - sums[a]) * down[a] + STEP * (b - a).astype(np.uint64))
    return np.stack((size[a], size[b], starts[a], ends[b - 1]), 1).astype(np.int32), hashes


def cut(text: str, spans: list[tuple[int, int]], unit: str) -> str:
    """The text without the spans, each with the separator after it (before it, at the end)."""
    out, at = [], 0
    for a, b in spans:
        m = _BREAK[unit].match(text, b) or _BLANKS.match(text, b)
        out.append(text[at:a])
        at = m.end() if m else b
        if not m and b == len(text):  # the last unit takes the separator before it
            kept = "".join(out)
            tail = [x for x in _BREAK[unit].finditer(kept) if x.end() == len(kept)]
            out = [kept[: tail[-1].start()] if tail else kept]
    out.append(text[at:])
    return "".join(out)


def passages(found: list[dict], least_words: int) -> list[tuple[int, int]]:
    """The spans of the repeated units, given by place, whose neighbours make a passage of ``least_words``."""
    out: list[tuple[int, int]] = []
    run: list[dict] = []
    for x in [*sorted(found, key=lambda x: x["at"]), None]:
        if run and (x is None or x["at"] != run[-1]["at"] + 1):
            if sum(y["words"] for y in run) >= least_words:
                out += [(y["start"], y["end"]) for y in run]
            run = []
        if x is not None:
            run.append(x)
    return out


def joined(row: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of ``spread``: their order by row and place, where each run that touches or overlaps begins in it, and the runs' sizes."""
    base = row.astype(np.int64) << 32
    order = np.argsort(base + at, kind="stable")
    a, b = (base + at)[order], np.maximum.accumulate((base + to)[order])
    first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1]))) if a.size else np.zeros(0, np.int64)
    return order, first, b[np.append(first[1:], a.size) - 1] - a[first] if a.size else first


def _digest(norm: str) -> bytes:
    return xxhash.xxh128_digest(norm.encode("utf-8", "surrogatepass"))


def dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "passage", least_words: int = 40) -> DataFrame:
    """(doc_id, kept_text, n_units, removed) of each row; n_units: the units (of ``passage`` the sentences) that are not blank; removed: array of (start, end)."""
    docs = scratch(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"uid": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text")}))
    kind = dict(docs.dtypes)["doc_id"]

    def places(t: str) -> tuple[np.ndarray, np.ndarray, list[bytes] | None]:
        """(place, 64-bit hash) of each unit, and its digests where they are at hand."""
        if unit == "passage":
            return *spread(t, least_words), None
        rows, digest = [], []
        for a, b, norm in units(t, unit):
            if norm:
                rows.append((len(rows), n_words(norm), a, b))
                digest.append(_digest(norm))
        return np.array(rows, np.int32).reshape(-1, 4), np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)[:, 0], digest

    def bodies(block: pa.RecordBatch) -> list[str]:
        return [lowered(t) for t in texts(block, "text")] if unit == "passage" else texts(block, "text")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            each = np.concatenate([places(t)[1] for t in bodies(block)])
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64))], names=["h"])

    twice = scratch(docs.select("text").mapInArrow(hashed, "h long").groupBy("h").count().where("count > 1").select("h"))
    marks = docs.sparkSession.sparkContext.broadcast(Bitmap(twice, "h"))  # 32 MB at most
    discard(twice)

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            n, at, digest = [], [], []
            for t in bodies(block):
                place, hashes, full = places(t)
                hit = np.flatnonzero(marks.value.holds(hashes)) if hashes.size else np.zeros(0, np.int64)
                n.append(hit.size)
                at.append(place[hit])
                if full is not None:
                    digest += [full[i] for i in hit.tolist()]
                else:
                    digest += [_digest(" ".join(t[a:b].split())) for a, b in place[hit, 2:].tolist()]
            both, where, row = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2), np.concatenate(at), np.repeat(np.arange(len(n)), n)
            enough = np.ones(row.size, bool)
            if unit == "passage":
                order, begin, size = joined(row, where[:, 0], where[:, 1])
                enough[order] = np.repeat(size >= least_words * WORD, np.diff(np.append(begin, row.size)))
            columns = [block.column("doc_id").take(pa.array(row)), block.column("uid").take(pa.array(row)), pa.array(both[:, 0]), pa.array(both[:, 1]), *[pa.array(where[:, k]) for k in range(4)], pa.array(enough)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "h1", "h2", *[x.split()[0] for x in PLACE.split(", ")], "enough"])

    found = scratch(docs.select("doc_id", "uid", "text").mapInArrow(again, f"doc_id {kind}, uid long, h1 long, h2 long, {PLACE}, enough boolean"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "uid", "at", "words")).alias("first")
    firsts = scratch(found.groupBy("h1", "h2").agg(first, F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.col("first.uid").alias("first_uid"), F.col("first.at").alias("first_at"), F.col("first.words").alias("first_to")))
    # A running paragraph that overlaps its own first occurrence is no repeat.
    other = F.col("at") >= F.col("first_to") if unit == "passage" else F.col("at") != F.col("first_at")
    # Units that make no passage with all their neighbours that may be repeats are only wanted as first occurrences.
    # Both sides are plain exchanges, so that Spark can split the partition of a hot digest.
    later = found.where("enough").drop("doc_id", "enough").join(firsts, ["h1", "h2"]).where((F.col("uid") != F.col("first_uid")) | other)
    mine = later.groupBy("uid").agg(F.collect_list(F.struct("at", "words", "start", "end")).alias("repeats"))
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if unit == "passage":
                lists = batch.column("repeats")
                flat = lists.flatten()
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                at, to, start, end = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("at", "words", "start", "end"))
                order, begin, size = joined(row, at, to)
                keep = size >= least_words * WORD
                ends = np.maximum.reduceat(end[order], begin) if begin.size else end
                counts = np.bincount(row[order][begin][keep], minlength=batch.num_rows)
                pairs = pa.StructArray.from_arrays([pa.array(start[order][begin][keep]), pa.array(ends[keep])], names=["start", "end"])
                removed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([batch.column("uid"), removed], names=["uid", "removed"])
                continue
            spans = [passages(x, least_words) for x in batch.column("repeats").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pair)], names=["uid", "removed"])

    spans = "removed array<struct<start: int, end: int>>"
    losses = scratch(mine.mapInArrow(chosen, f"uid long, {spans}").where(F.size("removed") > 0).withColumn("mark", F.xxhash64("uid")))
    discard(found, firsts)
    some, rest = parted(docs.select("uid", "doc_id", "text", F.xxhash64("uid").alias("mark")), "mark", Bitmap(losses, "mark"), "text")
    some = some.join(losses.drop("mark"), "uid", "left").select("doc_id", "text", "removed")
    rest = rest.select("doc_id", "text", F.lit(None).cast("array<struct<start: int, end: int>>").alias("removed"))

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            body = texts(block, "text")
            spans = [[(s["start"], s["end"]) for s in x or ()] for x in block.column("removed").to_pylist()]
            out = [cut(t, s, unit) if s else t for t, s in zip(body, spans, strict=True)]
            n = [n_units(t, unit) for t in body]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pair)], names=["doc_id", "kept_text", "n_units", "removed"])

    schema = f"doc_id {kind}, kept_text string, n_units long, {spans}"
    return some.mapInArrow(kept, schema).unionByName(rest.mapInArrow(kept, schema))


def op5(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 40 words or more, removed from all documents but the first that holds them."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
