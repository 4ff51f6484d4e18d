"""Document probability under a subword lattice.

The pieces of an existing subword vocabulary span a lattice over each word (white space cuts
words, as the vocabulary's own word mark does); characters it lacks are spelt in byte pieces. The
forward recursion in log space sums over all segmentations. The vocabulary's scores are ranks, so
they first become probabilities by Zipf's law and are then re-estimated for each label by an
expectation step over the distinct training words of the whole corpus.

A word seen in training is one more arc of the lattice: counts by label (language) back off to
counts over all labels, and these to the label's lattice, with as much mass as words met once.
A document's probability is the mixture over labels of the product over its words and its end;
the label of the document being scored is never read.

Word counts live in a table. The most frequent words (``broadcast_words`` at most) are sent to
all tasks; the others are looked up by a join, so the vocabulary may grow without bound.

Defined cases: a null text is the empty text, which is its end alone; repeated rows are scored
each; null labels are one label of their own; without training rows the lattice alone scores;
an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewire.llm.common import blocks, crc_mod, scratch, texts

MARK = "▁"
END = b""  # no word is empty
LOG10 = math.log(10)


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Pieces with natural-log probabilities for each of k labels; bytes spell what the pieces lack."""

    def __init__(self, pieces: dict[str, int], logs: np.ndarray):
        """logs: (pieces + 256, k); the last 256 rows are the bytes'."""
        self.pieces, self.logs, self.made = pieces, logs, None
        self.uniform = bool((logs == logs[:, :1]).all())

    @classmethod
    def from_vocabulary(cls, path: str, k: int = 1) -> Lattice:
        """Probabilities by Zipf's law from the file's own ranking of its pieces."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = [p for p, _ in sorted(names, key=lambda x: (-x[1], x[0]))]
        weight = np.concatenate((1.0 / (np.arange(len(ranked)) + 10), np.zeros(256)))
        weight[-256:] = 0.02 * weight.sum() / 256
        return cls({p: i for i, p in enumerate(ranked)}, np.repeat(np.log(weight / weight.sum())[:, None], k, axis=1))

    def batches(self, found: list[bytes], most: int = 400_000) -> Iterator[list[int]]:
        """Indices of the words, in groups whose tables of states stay small."""
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        group: list[int] = []
        for i in order:
            if group and (len(group) + 1) * (len(found[i]) + 2) > most:
                yield group
                group = []
            group.append(i)
        if group:
            yield group

    def _automaton(self):
        """Matcher of all pieces, and the basic plane's characters that are pieces; made once a process."""
        if self.made is None:
            import ahocorasick

            matcher = ahocorasick.Automaton()
            for p, i in self.pieces.items():
                matcher.add_word(p, i)
            matcher.make_automaton()
            single = np.zeros(0x110000, bool)
            single[[ord(p) for p in self.pieces if len(p) == 1]] = True
            single[32] = True  # stands between words
            sizes = np.zeros(len(self.pieces), np.int64)
            sizes[list(self.pieces.values())] = [len(p) for p in self.pieces]
            self.made = matcher, single, sizes
        return self.made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def arcs(self, found: list[bytes]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every arc, the words' sizes, and the characters that only bytes can spell (pieces from -1 down)."""
        matcher, single, sizes = self._automaton()
        texts = [raw.decode("utf-8", "surrogatepass") for raw in found]
        marked = [i for i, t in enumerate(texts) if MARK in t or " " in t]
        held = {i: texts[i] for i in marked}
        for i in marked:  # the mark within a word is an ordinary character, which no piece has
            texts[i] = texts[i].replace(MARK, "\0").replace(" ", "\1")
        line = MARK + (" " + MARK).join(texts)
        size = np.array([len(t) + 1 for t in texts])
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        flat = np.fromiter(chain.from_iterable(matcher.iter(line)), np.int64).reshape(-1, 2)
        last, piece = flat[:, 0], flat[:, 1]
        code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        lone = np.flatnonzero(~single[code])
        spelt: dict[str, int] = {}
        own = []
        for at in lone.tolist():
            c = line[at]
            if held and c in "\0\1":
                w = int(np.searchsorted(begin, at, side="right")) - 1
                c = held[w][at - int(begin[w]) - 1] if w in held else c
            own.append(-1 - spelt.setdefault(c, len(spelt)))
        end = np.concatenate((last, lone)) + 1
        start = np.concatenate((last + 1 - sizes[piece], lone))
        piece = np.concatenate((piece, np.array(own, np.int64)))
        word = np.searchsorted(begin, start, side="right") - 1
        return word, start - begin[word], end - begin[word], piece, size, list(spelt)

    def _values(self, piece: np.ndarray, spelt: list[str]) -> np.ndarray:
        out = self.logs[np.maximum(piece, 0)]
        if spelt:
            own = np.stack([self.logs[len(self.pieces) + np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8).astype(int)].sum(axis=0) for c in spelt])
            lacks = piece < 0
            out[lacks] = own[-1 - piece[lacks]]
        return out

    def _recur(self, word: np.ndarray, near: np.ndarray, far: np.ndarray, values: np.ndarray, state: np.ndarray, back: bool) -> None:
        """Fill ``state`` (words, positions, k) along the arcs: state[far] from state[near], by the log of sums."""
        order = np.argsort(far * (int(word.max()) + 1) + word, kind="stable")
        w, a, b = word[order], near[order], far[order]
        edges = np.flatnonzero(np.diff(b)) + 1
        spans = list(zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True))
        for x, y in reversed(spans) if back else spans:
            t = state[w[x:y], a[x:y]] + values[order[x:y]]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(w[x:y])) + 1))
            m = np.maximum.reduceat(t, starts)
            sizes = np.diff(np.append(starts, y - x))
            total = np.add.reduceat(np.exp(t - np.repeat(m, sizes, axis=0)), starts)
            state[w[x:y][starts], b[x]] = m + np.log(total)

    def score(self, found: list[bytes]) -> np.ndarray:
        """(words, k) natural-log probabilities, over all segmentations."""
        out = np.zeros((len(found), self.logs.shape[1]))
        for group in self.batches(found):
            word, start, end, piece, size, spelt = self.arcs([found[i] for i in group])
            state = np.zeros((len(group), int(size.max()) + 1, out.shape[1]))
            self._recur(word, start, end, self._values(piece, spelt), state, False)
            out[group] = state[np.arange(len(group)), size]
        return out

    def expect(self, found: list[bytes], weight: np.ndarray, counts: np.ndarray) -> None:
        """Add to ``counts`` (like logs) the expected pieces of the words' segmentations, weighted by ``weight`` (words, k)."""
        for group in self.batches(found):
            word, start, end, piece, size, spelt = self.arcs([found[i] for i in group])
            values = self._values(piece, spelt)
            if self.uniform:  # all labels alike: once is enough
                values = values[:, :1]
            ahead = np.zeros((len(group), int(size.max()) + 1, values.shape[1]))
            behind = np.zeros_like(ahead)
            self._recur(word, start, end, values, ahead, False)
            self._recur(word, end, start, values, behind, True)
            whole = ahead[np.arange(len(group)), size]
            g = np.exp(ahead[word, start] + values + behind[word, end] - whole[word]) * weight[group][word]
            for k in range(counts.shape[1]):
                counts[: len(self.pieces), k] += np.bincount(piece[piece >= 0], weights=g[piece >= 0, k], minlength=len(self.pieces))[: len(self.pieces)]
            for c, at in enumerate(spelt):
                mine = g[piece == -1 - c].sum(axis=0)
                for byte in at.encode("utf-8", "surrogatepass"):
                    counts[len(self.pieces) + byte] += mine


def _counts(df: DataFrame, labels: list[str], most: int = 250_000) -> DataFrame:
    """(word, c, n_all, by_label) over all rows; c and by_label count training rows only."""
    place = {name: i for i, name in enumerate(labels)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, counter in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.binary()), pa.array([k] * len(counter), pa.int32()), pa.array(counter.values(), pa.int64())], names=["word", "k", "n"])
            held.clear()

        for batch in blocks(batches, "text"):
            for text, label, train in zip(texts(batch, "text"), batch.column("label").to_pylist(), batch.column("train").to_pylist(), strict=True):
                c = held.setdefault(place.get(label, len(labels)) if train else -1, Counter())
                c.update(words(text))
                c[END] += 1
                if sum(map(len, held.values())) > most:
                    yield from flush()
        yield from flush()

    rows = df.select("text", "label", "train").mapInArrow(run, "word binary, k int, n long")
    known = F.col("k") >= 0
    by = [F.coalesce(F.sum(F.when(F.col("k") == i, F.col("n"))), F.lit(0)) for i in range(len(labels) + 1)]
    return scratch(rows.groupBy("word").agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("c"), F.sum("n").alias("n_all"), F.array(*by).alias("by_label")))


def _grid(column: pa.Array, k: int) -> np.ndarray:
    """The rows' lists of k numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)


def _lists(grid: np.ndarray) -> pa.Array:
    n, k = grid.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * k, k, dtype=np.int32), np.ascontiguousarray(grid).ravel())


def _reestimated(table: DataFrame, lattice: Lattice) -> Lattice:
    """Piece probabilities by label from one expectation over the distinct training words, smoothed by those of all labels."""
    k = lattice.logs.shape[1]
    shared = table.sparkSession.sparkContext.broadcast(lattice)  # as large as the vocabulary file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(shared.value.logs)
        for batch in batches:
            found = batch.column("word").to_pylist()
            if found:
                shared.value.expect(found, _grid(batch.column("by_label"), k) > 0, total)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, i]) for i in range(k)]], names=["piece", *[f"n{i}" for i in range(k)]])

    rows = table.where((F.col("c") > 0) & (F.length("word") > 0)).select("word", "by_label").mapInArrow(run, "piece int, " + ", ".join(f"n{i} double" for i in range(k)))
    found = rows.groupBy("piece").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]).toPandas()  # at most the vocabulary
    counts = np.zeros_like(lattice.logs)
    counts[found["piece"].to_numpy(int)] = found[[f"n{i}" for i in range(k)]].to_numpy(float)
    every = counts.sum(axis=1)
    every = (every + 500 * np.exp(lattice.logs[:, 0])) / (every.sum() + 500)
    return Lattice(lattice.pieces, np.log((counts + 500 * every[:, None]) / (counts.sum(axis=0) + 500)))


def score(df: DataFrame, vocabulary: str, train: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", broadcast_words: int = 200_000, most_labels: int = 32, rounds: int = 1) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of each row; learns from the rows where ``train`` holds.

    Each of the ``most_labels`` most frequent labels is a part of the mixture; rarer ones share one.
    ``rounds``: expectation steps from the vocabulary's own scores.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), F.coalesce(train, F.lit(False)).alias("train"))
    per_label = docs.where("train").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).collect()
    labels = [r["label"] for r in per_label]
    table = _counts(docs, labels)
    k = len(labels) + 1  # the last one holds all other labels
    sums = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count(F.when(F.col("c") > 0, 1)).alias("V"), *[F.coalesce(F.sum(F.col("by_label")[i]), F.lit(0)).alias(f"N{i}") for i in range(k)], F.count(F.when(F.col("c") == 1, 1)).alias("once"), *[F.count(F.when(F.col("by_label")[i] == 1, 1)).alias(f"once{i}") for i in range(k)]).first()
    N, V, once = sums["N"], sums["V"], sums["once"] + 1  # words met once tell how much mass the unmet ones need
    Nk, once_k = np.array([sums[f"N{i}"] for i in range(k)], float), np.array([sums[f"once{i}"] for i in range(k)], float) + 1
    ends = table.where(F.length("word") == 0).select("c", "by_label").first()
    n_docs, docs_k = (ends["c"], np.array(ends["by_label"], float)) if ends else (0, np.zeros(k))
    prior = np.log10((docs_k + 1) / (n_docs + k))
    end = math.log((n_docs + 1) / (N + 2))
    lattice = Lattice.from_vocabulary(vocabulary, k)
    for _ in range(rounds if V > 1 else 0):
        lattice = _reestimated(table, lattice)
    shared = spark.sparkContext.broadcast(lattice)

    def logs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = math.log(-math.expm1(end))
        for batch in batches:
            found = batch.column("word").to_pylist()
            c = batch.column("c").to_numpy().astype(float)
            by = _grid(batch.column("by_label"), k)
            sub = shared.value.score(found) + inside
            sub[[i for i, w in enumerate(found) if not w]] = end
            with np.errstate(divide="ignore"):
                backed = np.logaddexp(np.log(c)[:, None], math.log(once) + sub) - math.log(N + once)
                each = (np.logaddexp(np.log(by), np.log(once_k) + backed) - np.log(Nk + once_k)) / LOG10
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("n_all"), _lists(each)], names=["word", "c", "n_all", "logs"])

    table = scratch(table.mapInArrow(logs, "word binary, c long, n_all long, logs array<double>"))
    step = F.floor(F.log2("n_all") * 4)
    histogram = sorted(((r["step"], r["n"]) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a few hundred rows at most
    held, least = 0, None
    for at, n in histogram:
        if held + n > broadcast_words:
            break
        held, least = held + n, at
    frequent = table.where(step >= least).select("word", "c", "logs").toPandas() if least is not None else None
    everything = held == sum(n for _, n in histogram)
    values = np.zeros((held + 1, k + 2))  # c > 0, base, logs; the last row, for rarer words, adds nothing
    index: dict[bytes, int] = {}
    if frequent is not None and held:
        index = {bytes(w): i for i, w in enumerate(frequent["word"])}
        c = frequent["c"].to_numpy(float)
        values[:held, 0], values[:held, 1] = c > 0, np.log10((c + 1) / (N + V + 1))
        values[:held, 2:] = np.stack(frequent["logs"].to_list())
    known = spark.sparkContext.broadcast((index, values))  # at most broadcast_words words

    def lookup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values = known.value
        none = len(values) - 1
        for batch in blocks(batches, "text"):
            n_tokens, sums, rare = [], [], []
            for text in texts(batch, "text"):
                found = words(text)
                found.append(END)
                ids = np.fromiter(map(index.get, found, [none] * len(found)), np.int64, len(found))
                n_tokens.append(len(found))
                counts = np.bincount(ids) if ids.size > 4 * none else None
                sums.append(counts @ values[: counts.size] if counts is not None else values[ids].sum(axis=0))
                rare.append([] if everything else list(Counter([found[i] for i in np.flatnonzero(ids == none)]).items()))
            sums = np.array(sums).reshape(len(sums), k + 2)
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            rare_array = pa.array([[{"word": w, "n": n} for w, n in r] for r in rare], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), batch.column("train"), pa.array(n_tokens, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), _lists(sums[:, 2:]), rare_array],
                names=["uid", "doc_id", "train", "n_tokens", "n_known", "base", "logs", "rare"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    part = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "train", "text").mapInArrow(lookup, f"uid long, doc_id {kind}, train boolean, n_tokens long, n_known double, base double, logs array<double>, rare array<struct<word: binary, n: long>>")
    log_columns = [F.col("logs")[i] for i in range(k)]
    if not everything:
        part = scratch(part)
        rare = part.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
        rare = rare.join(table.where(step < least if least is not None else F.lit(True)).drop("n_all"), "word")
        n = F.col("n").cast("double")
        rare = rare.groupBy("uid").agg(
            F.sum(F.when(F.col("c") > 0, n).otherwise(0.0)).alias("r_known"),
            F.sum(n * F.log10((F.col("c") + 1) / F.lit(float(N + V + 1)))).alias("r_base"),
            *[F.sum(n * F.col("logs")[i]).alias(f"r_{i}") for i in range(k)],
        )
        part = part.drop("rare").join(rare, "uid", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        part = part.withColumns({"n_known": F.col("n_known") + zero("r_known"), "base": F.col("base") + zero("r_base")})
        log_columns = [x + zero(f"r_{i}") for i, x in enumerate(log_columns)]
    terms = F.array(*[x + F.lit(float(prior[i])) for i, x in enumerate(log_columns)])
    part = part.withColumn("terms", terms).withColumn("top", F.array_max("terms"))
    mixed = F.col("top") + F.log10(F.aggregate(F.transform("terms", lambda x: F.pow(F.lit(10.0), x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
    return part.select("doc_id", "train", "n_tokens", F.round("n_known").cast("long").alias("n_known"), F.lit(N).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), mixed.alias("score"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Probabilities of all documents, learned from those whose crc32(doc_id) mod 7 is not 2."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, public_tokenizers.path("piece_bpe_32k.model"), crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
