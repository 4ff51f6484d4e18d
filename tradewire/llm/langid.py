"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader and elastic-net penalties, then
temperature calibration.

Text is folded (letters to lower case, every run of other characters to one space), hashed
n-grams of one to three characters are counted over the whole text, ``(1 + ln tf) * idf`` is
scaled to unit length. Document frequencies cover every labelled training row that has a letter;
the weights are fitted on a bounded sample (``max_train_docs``) of the distinct texts, taken evenly
over the labels: those of each label whose hashes are smallest, whatever the order of the rows.

Defined cases: a null text, an empty one or one without a letter gets ``und`` with score 0;
rows with a null label are not learned from; with no labelled row every text gets ``und``;
repeated rows get the same prediction; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewire.llm.common import blocks, crc_mod, small_batches, texts, with_fields

UNKNOWN = "und"
CHUNK = 1_000_000


@lru_cache(1)
def _fold() -> np.ndarray:
    """Lower-case letter or space for each code point of the basic plane."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


def _folded(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _fold()
    if code.size and code.max() > 0xFFFF:
        return np.array([table[c] if c < 0x10000 else (ord(chr(c).lower()[0]) if chr(c).isalpha() else 32) for c in code.tolist()], np.uint32)
    return table[code]


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, counts) of the hashed n-grams; none if the text has no letter."""
    total = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    found = False
    for at in range(0, len(text), CHUNK):
        c = _folded(text[max(0, at - 2) : at + CHUNK])
        space = c == 32
        found = found or not space.all()
        keep = np.ones(c.size, bool)
        keep[1:] = ~(space[1:] & space[:-1])
        c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)])).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:] * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
        for h in (one, two, three):
            total += np.bincount(((h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> shift, minlength=1 << bits)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = total.nonzero()[0]
    return at, total[at]


def _vector(text: str, bits: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = features(text, bits)
    return at, _scaled(at, n, idf)


def _scaled(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / (np.linalg.norm(x) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], d: int, k: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights (d, k) of the multinomial model by per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((d, k)), np.zeros((d, k))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / math.exp(t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    a, b, r = math.log(0.25), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


class LanguageModel:
    """A fitted model; ``transform`` adds the predicted label and its calibrated probability."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float, bits: int):
        self.labels, self.idf, self.weights, self.temperature, self.bits = labels, idf, weights, temperature, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = _vector(text or "", self.bits, self.idf)
        if not at.size or not self.labels:
            return UNKNOWN, 0.0
        p = _softmax(x @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])

    def transform(self, df: DataFrame, text: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
        """All rows and columns of ``df`` and the two new columns (an existing column of such a name is replaced)."""
        small_batches(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)  # d x k weights: bounded by bits and labels
        rest = df.drop(label_out, score_out)
        schema = with_fields(rest.schema, T.StructField(label_out, T.StringType()), T.StructField(score_out, T.DoubleType()))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in blocks(batches, text):
                found = [model.predict(x) for x in texts(batch, text)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*batch.schema.names, label_out, score_out])

        return rest.mapInArrow(run, schema)


def fit(df: DataFrame, text: str = "text", label: str = "lang", *, max_train_docs: int = 4000, bits: int = 15, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> LanguageModel:
    """Learn from the rows of ``df`` with a label. ``max_train_docs`` bounds the rows whose vectors reach the driver."""
    small_batches(df.sparkSession)
    rows = df.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    # Copies have one hash and count once in the sample, so that no large group of them fills it.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = rows.groupBy("label", "hash").agg(F.count("*").alias("n"))
    counts = {r["label"]: (r["n"], r["different"]) for r in keys.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()}  # one row a label
    labels, d, n_rows = sorted(counts), 1 << bits, sum(n for n, _ in counts.values())
    if not labels:
        return LanguageModel([], np.ones(d), np.zeros((d, 0)), 1.0, bits)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in blocks(batches, "text"):
            for x in texts(batch, "text"):
                total[features(x, bits)[0]] += 1
        at = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    df_counts = rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # at most 2**bits rows
    idf = np.full(d, math.log(1 + n_rows))
    idf[df_counts["feature"].to_numpy(int)] = np.log((1 + n_rows) / (1 + df_counts["n"].to_numpy(float))) + 1

    quota = max(1, max_train_docs // len(labels))

    def up_to(bounds: dict[str, int]) -> Column:
        """Whether the hash is at most the bound of the row's label."""
        most = F.lit(-(1 << 63))
        for name in labels:
            most = F.when(F.col("label") == name, F.lit(bounds[name])).otherwise(most)
        return F.col("hash") <= most

    # Twice the quota and 32 are expected below the first bounds, so fewer than the quota fall there only where a label has no more.
    first = {name: min((1 << 63) - 1, -(1 << 63) + (2 * quota + 32 << 64) // different) for name, (_, different) in counts.items()}
    lowest: dict[str, list[int]] = {name: [] for name in labels}
    for r in rows.where(up_to(first)).select("label", "hash").distinct().collect():  # about 2 * quota + 32 rows a label
        lowest[r["label"]].append(r["hash"])
    bounds = {name: sorted(x)[:quota][-1] for name, x in lowest.items()}

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = [features(x, bits) for x in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([a.astype(np.uint32).tobytes() for a, _ in found], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in found], pa.binary())], names=["label", "at", "n"])

    chosen = rows.where(up_to(bounds)).groupBy("label", "hash").agg(F.min("text").alias("text"))
    sample = chosen.mapInArrow(vectors, "label string, at binary, n binary").toPandas()  # at most quota rows a label
    examples = []
    for name, at, n in sorted(zip(sample["label"], sample["at"], sample["n"], strict=True)):
        at, n = np.frombuffer(at, np.uint32).astype(int), np.frombuffer(n, np.float32).astype(float)
        if at.size:
            examples.append((at, _scaled(at, n, idf), labels.index(name)))
    order = np.random.default_rng(1).permutation(len(examples))
    held = max(1, len(order) // 5) if len(order) > 10 else 0
    train, calibrate = [examples[i] for i in order[held:]], [examples[i] for i in order[:held]]
    weights = ftrl(train, d, len(labels), alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    logits = np.array([x @ weights[at] for at, x, _ in calibrate]).reshape(len(calibrate), len(labels))
    return LanguageModel(labels, idf, weights, temperature(logits, np.array([y for _, _, y in calibrate], int)), bits)


def op10(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod("doc_id", 5) != 0))
    return model.transform(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")).drop("text")
