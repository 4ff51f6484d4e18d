"""Order-preserving packing of tokenized documents into training sequences.

The ids of the documents of a block are one stream. Dynamic programming picks the cuts: a cut at
a document's end is free, one at a sentence's end and one inside a sentence cost a penalty, and
a sequence costs its padding (none if its length is a power of two, else up to ``size``) and a
small fixed cost. The best start of a padded sequence comes from a monotone queue over the
window of ``size`` ids; the starts at a power of two are looked up. A block is at most
``block_tokens`` ids, or one document, so memory does not grow with the partition.

Nothing is shuffled: each input partition numbers its own sequences from ``partition << 32``.

Defined cases: a null or empty text is the end-of-document id alone; repeated rows are packed
each; null document ids stay null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewire.llm.common import blocks, distinct, small_batches, texts

END = 1
#: Fixed value: how byte-level vocabularies cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Byte-level BPE ids of whole texts, as ``tokenizers`` gives them.

    A file of the plain byte-level kind (no normaliser, no prefix space, merges in the order of
    their ids) is the same vocabulary as a table of ranks, which ``tiktoken`` encodes several times
    faster; any other file, and texts that hold an added token, go to ``tokenizers`` itself, which is
    loaded for the first of them. Nothing is remembered between texts.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file.get("added_tokens") or ()]
        ranks = _ranks(file, set(self.special))
        if ranks is None:
            self.fast = None
            tok = self._tokenizer()
            shown = {i: tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())}
        else:
            self.fast = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            shown = {t["id"]: t["content"] for t in file.get("added_tokens") or ()} | {i: b.decode("utf-8", "replace") for b, i in ranks.items()}
        size = max(shown) + 1
        self.closes, self.breaks, self.opens = (np.zeros(size, bool) for _ in range(3))
        for i, x in shown.items():
            self.closes[i] = x.rstrip()[-1:] in tuple(".!?。！？")
            self.breaks[i] = "\n" in x
            self.opens[i] = x[:1].isspace()

    def _tokenizer(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            ids = self._tokenizer().encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.frombuffer(array("I", ids), np.uint32)


def _ranks(file: dict, special: set[str]) -> dict[bytes, int] | None:
    """The file's vocabulary as ranks of byte strings, or None if it is of another kind."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    letters = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    if None in merged or merged != sorted(merged) or not all(c in letters for t in vocabulary for c in t):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}


def cuts(ends: np.ndarray, sentences: np.ndarray, size: int, sentence_cost: float, inside_cost: float, sequence_cost: float) -> list[int]:
    """The chosen cut positions, the last one included, of a stream whose documents end at ``ends``.

    ``sentences``: further positions between sentences. Where neither comes within ``size`` ids,
    positions inside a sentence are added.
    """
    total = int(ends[-1])
    at = distinct(np.concatenate(([0], sentences, ends)))
    wide = np.flatnonzero(np.diff(at) > size // 2)
    if wide.size:
        at = distinct(np.concatenate([at, *[np.arange(at[i] + size // 8, at[i + 1], size // 8) for i in wide]]))
    cost = np.full(at.size, inside_cost)
    cost[np.searchsorted(at, sentences)] = sentence_cost
    cost[np.searchsorted(at, ends)] = 0.0
    cost[0] = 0.0
    exact: dict[int, list[int]] = {}
    k = 1
    while k <= size:
        i = np.searchsorted(at, at - k)
        for j in np.flatnonzero((at >= k) & (at[np.minimum(i, at.size - 1)] == at - k)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        k *= 2
    pos, fixed = at.tolist(), (cost + sequence_cost).tolist()
    best, back = [0.0] * len(pos), [0] * len(pos)
    line: deque[int] = deque([0])  # starts in the window, by best + position
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[line[0]] < p - size:
            line.popleft()
        i = line[0]
        least, start = best[i] + pos[i] + size - p, i
        for i in exact.get(j, ()):
            if best[i] < least:
                least, start = best[i], i
        best[j], back[j] = least + fixed[j], start
        mine = best[j] + p
        while line and best[line[-1]] + pos[line[-1]] >= mine:
            line.pop()
        line.append(j)
    chosen, j = [], len(pos) - 1
    while j > 0:
        chosen.append(pos[j])
        j = back[j]
    assert total == pos[-1]
    return chosen[::-1]


def pack(
    df: DataFrame,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 2048,
    sentence_cost: float = 4.0,
    inside_cost: float = 32.0,
    sequence_cost: float = 4.0,
    block_tokens: int = 2_000_000,
    ids_too: bool = False,
) -> DataFrame:
    """A row for each piece of a document in a sequence; with ``ids_too`` also the piece's ids.

    ``tokenizer`` is the path of a byte-level BPE file that executors can read.
    """
    small_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
    if ids_too:
        schema = T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        encoder = _encoder(tokenizer)
        keys: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, tokens
            stream = np.concatenate(held)
            ends = np.cumsum([len(h) for h in held])
            sentence = np.flatnonzero(encoder.closes[stream[:-1]] & encoder.opens[stream[1:]] & ~encoder.breaks[stream[1:]] | encoder.breaks[stream[:-1]]) + 1
            chosen = np.array(cuts(ends, sentence, size, sentence_cost, inside_cost, sequence_cost))
            edges = distinct(np.concatenate(([0], chosen, ends)))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, a, side="right")
            seq = np.searchsorted(chosen, a, side="right")
            first = np.concatenate(([0], ends))[doc]
            begun = np.concatenate(([0], chosen))[seq]
            little = stream.astype("<u4", copy=False)
            crc = [zlib.crc32(little[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            lengths = np.array([len(h) for h in held])
            columns = [a - first, b - a, crc, lengths[doc], seq + number, a - begun]
            arrays = [keys_array().take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in columns]]
            if ids_too:
                arrays.append(pa.array([stream[x:y].astype(np.int32) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.list_(pa.int32())))
            number += len(chosen)
            keys.clear()
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def keys_array() -> pa.Array:
            return pa.concat_arrays(keys)

        for block in blocks(batches, "text"):
            for i, ids in enumerate(map(encoder.encode, texts(block, "text"))):
                if held and tokens + ids.size + 1 > block_tokens:
                    yield flush()
                keys.append(block.column(0).slice(i, 1))
                held.append(np.append(ids, np.uint32(END)))
                tokens += ids.size + 1
        if held:
            yield flush()

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
