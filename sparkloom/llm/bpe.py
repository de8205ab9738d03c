"""Encoding a corpus with a public byte-level BPE tokenizer.

Per batch the texts are cut into words by the tokenizer's published pattern; only words not met
before are merged, all of them at once: a *pair occurrence index* maps every adjacent pair of
symbols to its positions in the concatenation of those words, the pairs present are applied in
ascending rank, and each merge updates only the lists of the pairs it touches.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.llm.common import table

#: Where the vocabulary files of public tokenizers are; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"

#: Fixed values of the public tokenizer: its word pattern, and the same for texts that are all ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
)
#: Words kept with their ids by each Python worker; beyond that the memory of words starts afresh.
WORDS_KEPT = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Encoder:
    """Encodes words; holds the merge table and the words met so far."""

    def __init__(self, folder: str, name: str):
        model = json.loads(Path(folder, f"{name}.json").read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        import regex

        self.any_word = regex.compile(PATTERN)
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i]: where word i's ids end in flat; ends[0] = 0 is no word
        self.n = 0

    def words(self, text: str) -> list[str]:
        return ASCII_WORD.findall(text) if text.isascii() else self.any_word.findall(text)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by merging all words together over the pair occurrence index."""
        merges, byte_id = self.merges, self.byte_id
        sym: list[int] = []
        right: list[int] = []  # position of the next symbol of the same word, -1 at its end
        left: list[int] = []
        heads: list[int] = []
        for w in words:
            raw = w.encode("utf-8")
            p, n = len(sym), len(raw)
            heads.append(p)
            sym += [byte_id[b] for b in raw]
            right += range(p + 1, p + n)
            right.append(-1)
            left.append(-1)
            left += range(p, p + n - 1)
        index: dict[tuple[int, int], list[int]] = {}
        for p, q in enumerate(right):
            if q >= 0:
                pair = (sym[p], sym[q])
                if pair in index:
                    index[pair].append(p)
                elif pair in merges:
                    index[pair] = [p]
        active = [(*merges[pair], pair) for pair in index]
        heapq.heapify(active)
        while active:
            _, new, pair = heapq.heappop(active)
            a, b = pair
            for p in index.pop(pair):
                if sym[p] != a or (q := right[p]) < 0 or sym[q] != b:
                    continue  # changed by an earlier merge
                sym[p], sym[q] = new, -1
                right[p] = r = right[q]
                if r >= 0:
                    left[r] = p
                    self._note(index, active, (new, sym[r]), p)
                if (o := left[p]) >= 0:
                    self._note(index, active, (sym[o], new), o)
        out = []
        for p in heads:
            ids = []
            while p >= 0:
                ids.append(sym[p])
                p = right[p]
            out.append(ids)
        return out

    def _note(self, index: dict, active: list, pair: tuple[int, int], p: int) -> None:
        if pair in index:
            index[pair].append(p)
        elif pair in self.merges:
            index[pair] = [p]
            heapq.heappush(active, (*self.merges[pair], pair))

    def learn(self, words: list[str]) -> None:
        for w, ids in zip(words, self.merge(words)):
            self.n += 1
            start, end = self.ends[self.n - 1], self.ends[self.n - 1] + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.int32)])
            if self.n + 1 >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
            self.flat[start:end] = ids
            self.ends[self.n] = end
            self.known[w] = self.n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word lengths in ids, word starts in ``flat``, words up to each text's end)."""
        if self.n > WORDS_KEPT:
            self._fresh()
        words: list[str] = []
        upto = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += self.words(t)
            upto[i + 1] = len(words)
        new = set(words).difference(self.known)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        start = self.ends[at - 1]
        return self.ends[at] - start, start, upto


@cache
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


#: Texts encoded together: their words share one pair occurrence index.
CHUNK = 512


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            part = b.slice(i, CHUNK)
            yield part.column(0), part.column(1).to_pylist()


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row, without special tokens.

    Null and empty texts have an empty list. The strings of special tokens in a text are ordinary
    text. Texts of any length are encoded whole; repeated rows come out repeatedly; extra columns
    are not read. Only the map runs: no shuffle, one pass over two columns.
    """
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for keys, texts in _chunks(batches):
            sizes, starts, upto = e.encode(texts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = e.flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
            lists = pa.ListArray.from_arrays(pa.array(ends[upto].astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The columns ``keep`` and n_tokens BIGINT (0 for null and empty texts)."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                sizes, _, upto = e.encode(part.column(0).to_pylist())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(ends[upto]), pa.int64())], names=[*keep, "n_tokens"])

    return df.select(text, *keep).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
ORACLE: dict = {}
