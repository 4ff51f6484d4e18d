"""Near-duplicate embeddings by p-stable hashing.

Vectors are scaled to unit length; in each of ``tables`` tables a vector's bucket is the hash of
``projections`` quantised random projections floor((a.x + b) / width). For unit vectors the
Euclidean distance is a function of the cosine, so a pair at cosine 0.95 (distance 0.316) meets in
one table with probability 0.2 and in one of 28 with 0.998; closer pairs do better. All pairs of a
bucket get an exact cosine in double precision; a pair counts in the first table it meets in.
Equal vectors are one class from the start, and buckets of any size are dealt out as pairs of
blocks. Tasks return sums of links and spanning trees, not pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths do not link; repeated rows link with each other; an empty
table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewire.llm.cells import cells, dealt, labels, paired
from tradewire.llm.common import STEP, blocks, mix64, scratch
from tradewire.llm.components import components


@lru_cache(8)
def _family(size: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.standard_normal((size, tables * projections)), rng.uniform(0, width, tables * projections)


def codes(x: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """(rows, tables) 32-bit bucket codes of unit vectors."""
    a, b = _family(x.shape[1], tables, projections, width)
    q = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
    h = np.full((len(x), tables), x.shape[1], np.uint64)
    for j in range(projections):
        h = mix64(h * STEP + q[:, :, j])
    return (h >> np.uint64(32)).astype(np.uint32)


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, tables: int = 28, projections: int = 12, width: float = 2.0, bucket: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``df``."""
    kind = dict(df.dtypes)[vec_id]
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "vector"):
            raw, h1, h2 = [], [], []
            for v in batch.column("vector").to_pylist():
                x = np.array(v if v else [np.nan], float)  # a null component becomes a NaN
                ok = bool(np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0)
                raw.append(x.tobytes() if ok else None)
                d = xxhash.xxh128_intdigest(raw[-1]) if ok else 0
                h1.append(d >> 64)
                h2.append(d & (1 << 64) - 1)
            ints = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), pa.array(raw, pa.binary()), *ints], names=["uid", "vec_id", "raw", "h1", "h2"])

    rows = scratch(rows.mapInArrow(keyed, f"uid long, vec_id {kind}, raw binary, h1 long, h2 long"))
    reps = scratch(rows.where("raw is not null").groupBy("h1", "h2").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "raw"):
            raw = batch.column("raw").to_pylist()
            rep = batch.column("rep").to_numpy()
            size = np.array([len(r) for r in raw])
            for n in sorted(set(size.tolist())):
                at = np.flatnonzero(size == n)
                code = codes(_unit([raw[i] for i in at]), tables, projections, width)
                keys = (np.arange(tables, dtype=np.int64) << 32) | code.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(list(keys), pa.list_(pa.int64())), pa.array([c.tobytes() for c in code], pa.binary())], names=["rep", "keys", "codes"])

    coded = scratch(reps.select("rep", "raw").mapInArrow(hashed, "rep long, keys array<long>, codes binary"))
    met = coded.select("rep", F.explode("keys").alias("key"))
    counts = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(counts, "key").join(reps.select("rep", "copies", "raw").join(coded.select("rep", "codes"), "rep"), "rep")

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, "key"):
            if cell.num_rows < 2:
                continue
            raw = cell.column("raw").to_pylist()
            if len({len(r) for r in raw}) > 1:  # only a chance meeting of 32-bit codes brings these together
                continue
            x = _unit(raw)
            close = x @ x.T >= threshold
            np.fill_diagonal(close, False)
            if not close.any():
                continue
            rep, side, copies = (cell.column(c).to_numpy() for c in ("rep", "side", "copies"))
            label = labels(close)
            if cell.column("low")[0].as_py() != cell.column("high")[0].as_py():
                close &= side[:, None] != side[None, :]
            i, j = np.nonzero(close)
            code = np.frombuffer(b"".join(cell.column("codes").to_pylist()), np.uint32).reshape(len(raw), tables)
            table = int(cell.column("key")[0].as_py() >> 32)
            new = ~(code[i, :table] == code[j, :table]).any(axis=1)
            links = np.bincount(i[new], weights=copies[j[new]], minlength=len(raw)).astype(np.int64)
            some = np.flatnonzero((links > 0) | (label != np.arange(len(raw))))
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[label[some]]), pa.array(links[some])], names=["a", "b", "links"])

    found = scratch(dealt(paired(met, "n", bucket), "key").mapInArrow(compared, "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(found.select("a", "b")).withColumnsRenamed({"node": "rep", "component": "top"})
    known = reps.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left").withColumn("top", F.coalesce("top", "rep"))
    valid, void = rows.where("raw is not null").drop("raw"), rows.where("raw is null").drop("raw")
    out = valid.join(known, ["h1", "h2"]).select("vec_id", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = scratch(out.unionByName(void.select("vec_id", F.col("uid").alias("top"), F.lit(0).cast("long").alias("n_links"))))
    least = out.groupBy("top").agg(F.min("vec_id").alias("component_id"))
    return out.join(least, "top").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 or more among all embeddings."""
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
