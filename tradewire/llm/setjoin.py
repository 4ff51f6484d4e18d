"""N-gram Jaccard join by chosen paths.

Each document is the set of its word shingles. Documents with equal sets are one class from the
start. A class is embedded by ``SKETCH`` minimum hashes; (position, value) pairs are the tokens
that paths sample. In each run a class enters the nodes of the tokens sampled for it at rate
1 / (threshold * SKETCH); a node of more than ``bucket`` classes is split again on tokens
sampled anew until it is small, and small nodes are compared outright. Near copies by the thousand
share nearly all tokens, so that no sampling parts them: what is still large after ``depth`` levels is
compared in blocks. Runs repeat until a pair at the threshold is met within two levels with
probability ``recall``; deeper levels only hold pairs all of whose nodes are large, at six levels with
0.94 a pair, and links of a group are found from any path between its texts. Pairs whose sketches agree
well enough join two classes into one candidate group; within each group all pairs of sets are
then compared exactly, so a link is lost only if no path of sampled pairs leads from one text to
the other.

Nodes and groups of any size are dealt out as pairs of blocks of at most ``bucket`` (``group``)
classes, so no task holds more than two blocks, and nothing is capped. Tasks return sums of links and spanning
trees, never all pairs of a group.

Defined cases: a null, empty or wordless text links with nothing; a text of fewer words than
``n`` is one shingle; repeated rows and equal texts link with each other; null ids are allowed (the
class of only such rows has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewire.llm.cells import cells, dealt, labels, paired
from tradewire.llm.common import STEP, Bitmap, WordHashes, blocks, discard, mix64, parted, scratch, shingles, texts, word_hashes, words
from tradewire.llm.components import components

SKETCH = 64
_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_PLACE = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * STEP)


def _sets(batch: pa.RecordBatch, text: str, n: int, memory: WordHashes) -> list[np.ndarray]:
    return [shingles(word_hashes(words(t), memory), n) for t in texts(batch, text)]


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, SKETCH) minimum hashes; rows without shingles get zeros."""
    out = np.zeros((len(sets), SKETCH), np.uint32)
    full = [i for i, s in enumerate(sets) if s.size]
    if full:
        h = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *[sets[i].size for i in full[:-1]]])
        for j in range(SKETCH):
            out[full, j] = np.minimum.reduceat(((h * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signatures(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(uid, doc_id, text_hash, size, k1, k2, sketch) of each row."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"text_hash": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for block in blocks(batches, "text"):
            sets = _sets(block, "text", n, memory)
            sketch = _sketches(sets)
            with np.errstate(over="ignore"):
                k1 = np.array([int((s * STEP).sum(dtype=np.uint64)) for s in sets], np.uint64)
                k2 = np.array([int(mix64(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [block.column("uid"), block.column("doc_id"), block.column("text_hash"), pa.array([s.size for s in sets], pa.int32()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([r.tobytes() for r in sketch], pa.binary())],
                names=["uid", "doc_id", "text_hash", "size", "k1", "k2", "sketch"],
            )

    return scratch(rows.mapInArrow(run, f"uid long, doc_id {kind}, text_hash long, size int, k1 long, k2 long, sketch binary"))


def _children(rows: DataFrame, rate: float, runs: int, level: int) -> DataFrame:
    """(node, rep): the nodes that each row's sampled tokens lead to. Roots have a column for no node."""
    bar = np.uint64(min(rate, 1.0) * (2**64 - 2048))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
            rep = batch.column("rep").to_numpy()
            token = mix64(sketch.astype(np.uint64) + _PLACE)
            for r in range(runs if level == 1 else 1):
                parent = np.full(rep.size, r + 1, np.uint64) * STEP if level == 1 else batch.column("node").to_numpy().view(np.uint64)
                chance = mix64(token ^ mix64(parent + np.uint64(level))[:, None])
                i, j = np.nonzero(chance < bar)
                yield pa.RecordBatch.from_arrays([pa.array(mix64(chance[i, j] + STEP).view(np.int64)), pa.array(rep[i])], names=["node", "rep"])

    return rows.select(*([] if level == 1 else ["node"]), "rep", "sketch").mapInArrow(run, "node long, rep long")


def _sketch_edges(rows: DataFrame, agree: float) -> DataFrame:
    """(a, b): spanning trees of the pairs in each cell whose sketches agree in ``agree`` of their places."""
    least = math.ceil(agree * SKETCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for cell in cells(batches, "node"):
            if cell.num_rows > 1:
                sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
                rep = cell.column("rep").to_numpy()
                same = np.zeros((len(rep), len(rep)), np.uint8)
                for j in range(SKETCH):
                    same += sketch[:, j, None] == sketch[None, :, j]
                label = labels(same >= least)
                moved = np.flatnonzero(label != np.arange(len(rep)))
                out_a.append(rep[moved])
                out_b.append(rep[label[moved]])
            if sum(map(len, out_a)) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return dealt(rows, "node").mapInArrow(run, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Shingles with the same holders count as one weighted column."""
    m = len(sets)
    if m == 2:
        k = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[sets[0].size, k], [k, sets[1].size]])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(m), [s.size for s in sets])
    held = np.bincount(at, minlength=every.size)
    tag = mix64(np.arange(1, m + 1, dtype=np.uint64) * STEP)
    order = np.argsort(at, kind="stable")
    pattern = np.add.reduceat(tag[holder[order]], np.concatenate(([0], np.cumsum(held)[:-1])))
    shared = held > 1
    _, first, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    out = np.zeros((m, m))
    starts = np.concatenate(([0], np.cumsum(held)))
    column = np.flatnonzero(shared)[first]
    for a in range(0, column.size, 2048):
        some = column[a : a + 2048]
        grid = np.zeros((m, some.size), np.float32)
        for c, s in enumerate(some.tolist()):
            grid[holder[order[starts[s] : starts[s + 1]]], c] = 1
        out += (grid * weight[a : a + 2048].astype(np.float32)) @ grid.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, [s.size for s in sets])
    return out


def _exact(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): for each row of a cell, a tree edge to ``b`` and the linked documents counted there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, "grp"):
            rep, keep = np.unique(cell.column("rep").to_numpy(), return_index=True)
            if rep.size < 2:
                continue
            raw = cell.column("shingles").to_pylist()
            sets = [np.frombuffer(raw[i], np.uint64) for i in keep]
            side, copies = cell.column("side").to_numpy()[keep], cell.column("copies").to_numpy()[keep]
            common = _overlaps(sets)
            size = np.diag(common)
            union = size[:, None] + size[None, :] - common
            near = common >= threshold * union - 1e-9
            np.fill_diagonal(near, False)
            if cell.column("low")[0].as_py() != cell.column("high")[0].as_py():
                near &= side[:, None] != side[None, :]  # pairs of one block are met in that block's own cell
            links = near @ copies
            label = labels(near)
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[label[some]]), pa.array(links[some].astype(np.int64))], names=["a", "b", "links"])

    return dealt(rows, "grp").mapInArrow(run, "a long, b long, links long")


def join(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 6, bucket: int = 512, group: int = 192) -> DataFrame:
    """(uid, doc_id, text_hash, class_id, n_links, n_copies, kept) of each row of ``df``.

    class_id: the least id that links lead to; n_links: the other rows at ``threshold`` or more;
    n_copies: the other rows with the same set; kept: one row of each class (equal rows with equal
    ids stand together).
    """
    rows = signatures(df, doc_id, text, n)
    reps = scratch(rows.where("size > 0").groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")))

    rate = 1 / (threshold * SKETCH)
    met = 1.0
    for _ in range(2):  # the chance that a pair at the threshold still shares a node after two levels
        met = 1 - math.exp(-met)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - met))

    edges, used = None, []
    nodes = _children(reps, rate, runs, 1)
    for level in range(1, depth + 1):
        nodes = scratch(nodes)
        counts = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        shared = scratch(nodes.join(counts, "node").join(reps.select("rep", "sketch"), "rep"))
        discard(nodes)
        used.append(shared)
        small = shared.where(F.col("n") <= bucket) if level < depth else shared
        some = _sketch_edges(paired(small, "n", bucket), threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH))
        edges = some if edges is None else edges.unionByName(some)
        large = shared.where(F.col("n") > bucket)
        if level == depth or large.isEmpty():
            break
        nodes = _children(large, rate, runs, level + 1)
    groups = components(edges).withColumnsRenamed({"node": "rep", "component": "grp"})
    discard(*used)

    # The shingles of the candidates only: their texts are found again by id and hash.
    wanted = groups.join(reps.select("rep", "copies"), "rep").join(rows.select(F.col("uid").alias("rep"), F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"), "size"), "rep")
    candidates = scratch(wanted)
    # A block of a group is bounded in classes and, on average, in shingles.
    weight = candidates.groupBy("grp").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") / 10_000)).alias("n"))
    wanted = scratch(candidates.join(weight, "grp"))
    discard(candidates)
    source = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    source, _ = parted(source, "text_hash", Bitmap(wanted, "its_hash"), "text")
    source = source.join(wanted, source["doc_id"].eqNullSafe(wanted["its_id"]) & (source["text_hash"] == wanted["its_hash"])).select("rep", "grp", "n", "copies", "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in ("rep", "grp", "n", "copies")], pa.array([s.tobytes() for s in _sets(block, "text", n, memory)], pa.binary())], names=["rep", "grp", "n", "copies", "shingles"])

    sets = scratch(source.mapInArrow(cut, "rep long, grp long, n long, copies long, shingles binary"))
    found = scratch(_exact(paired(sets, "n", group), threshold))
    discard(wanted, sets)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(found.select("a", "b")).withColumnsRenamed({"node": "rep", "component": "top"})

    # The right sides of both joins are tables, so that Spark can split the partition of a hot set or class.
    known = scratch(reps.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left").withColumn("top", F.coalesce("top", "rep")))
    discard(reps, found)
    out = rows.drop("sketch").join(known, ["k1", "k2"], "left").withColumn("top", F.coalesce("top", "uid"))
    out = scratch(out.select("uid", "doc_id", "text_hash", "top", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies")))
    discard(rows, known)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    first = scratch(out.groupBy("top").agg(least.alias("least")).select("top", F.col("least.doc_id").alias("class_id"), F.col("least.text_hash").alias("its_hash")))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("its_hash"))
    return out.join(first, "top").select("uid", "doc_id", "text_hash", "class_id", "n_links", "n_copies", kept.alias("kept"))


def keep_one(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each class of linked texts. Only rows whose text some lost row has are moved."""
    found = scratch(join(df, doc_id=doc_id, text=text, **options).groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")))
    doubtful = found.where("not kept or n > 1")  # a class keeps a row of each (id, text) of its own or none
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(doc_id).alias("its_id"), F.xxhash64(body).alias("its_hash"), F.octet_length(body).alias("size"))
    some, rest = parted(rows, "its_hash", Bitmap(doubtful, "text_hash"), "size")
    kept = found.where("kept")
    some = some.join(kept, some["its_id"].eqNullSafe(kept["doc_id"]) & (some["its_hash"] == kept["text_hash"]), "left_semi")
    if not kept.where("n > 1").isEmpty():  # repeated rows: one of them stays
        some = some.dropDuplicates(["its_id", "its_hash"])
    return some.unionByName(rest).select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, five-word shingles, Jaccard of 0.8 or more."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies", "kept")
