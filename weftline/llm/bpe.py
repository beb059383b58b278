"""Byte-level BPE: unique words in length-bucketed padded matrices, one merge a row and round.

Texts are split by the vocabulary's pattern, each different word is encoded once (and kept in a bounded cache), and the
words that are new are packed by length into padded numpy matrices. In a round every row looks the ranks of its neighbour
pairs up in an open-addressing hash table, merges its leftmost pair of least rank, and closes the gap; rows without a pair
leave the matrix. Words over LONGEST bytes go through a heap of pairs instead, the same merges in the same order, as a
matrix would take a quadratic time.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LONGEST, CACHED, NONE = 256, 150_000, np.int32(2**31 - 1)


class Codec:
    def __init__(self, lines: bytes, pattern: str):
        """lines: a rank file's content, base64 token and rank on each line."""
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._hash(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.cache: dict[str, bytes] = {}

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] == 2**64 - 1]
            slots, who = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[free[who]], values[free[who]]
            left = np.setdiff1d(left, free[who], assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they don't merge; a negative id is padding."""
        out = np.full(left.shape, NONE, np.int32)
        where = np.nonzero(right >= 0)
        keys = left[where].astype(np.uint64) << np.uint64(32) | right[where].astype(np.uint64)
        at, got, todo = self._slot(keys), np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        for _ in range(self.probes + 1):
            if not len(todo):
                break
            here = self.keys[at[todo]]
            hit = here == keys[todo]
            got[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (here != 2**64 - 1)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        out[where] = got
        return out

    def matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of about one length."""
        n = np.array([len(w) for w in words])
        ids = np.full((len(words), int(n.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < n[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        done: list = [None] * len(words)
        rows = np.arange(len(words))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            for k in np.flatnonzero(best == NONE):
                done[rows[k]] = ids[k, : n[k]]
            go = best != NONE
            rows, ids, n, at, best, ranks = rows[go], ids[go], n[go] - 1, at[go], best[go], ranks[go]
            if not len(rows):
                break
            width = int(n.max())
            cols = np.arange(width)
            k = np.arange(len(rows))
            merged = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            merged[k, at] = best
            cols = np.arange(max(0, width - 1))
            moved = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), ranks.shape[1] - 1), axis=1) if width > 1 else ranks[:, :0]
            ids = merged
            for shift in (-1, 0):  # only the pairs beside a merge have new ranks
                near = np.flatnonzero((at + shift >= 0) & (at + shift < width - 1))
                moved[near, at[near] + shift] = self.rank(ids[near, at[near] + shift], ids[near, at[near] + shift + 1])
            ranks = moved
        return done

    def heap(self, word: bytes) -> np.ndarray:
        """Ids of one long word."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        look = self.pairs.get
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := look(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := look(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(queue, (r, i, rank, ids[after[i]]))
            if (p := before[i]) >= 0 and (r := look(ids[p] << 32 | rank)) is not None:
                heapq.heappush(queue, (r, p, ids[p], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of words into the cache."""
        buckets: dict[int, list] = {}
        for w in words:
            b = w.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.cache[w] = whole.to_bytes(4, "little")
            elif len(b) > LONGEST:
                self.cache[w] = self.heap(b).astype("<u4").tobytes()
            else:
                buckets.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append((w, b))
        for size, group in buckets.items():
            step = max(1, (1 << 19) // size)
            for k in range(0, len(group), step):
                for (w, _), ids in zip(group[k : k + step], self.matrix([b for _, b in group[k : k + step]]), strict=True):
                    self.cache[w] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        split = [self.find(t) for t in texts]
        self.encode_words(list(set().union(*split).difference(self.cache)))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return joined(self.tokens, ids)


def joined(tokens: list[bytes], ids: bytes) -> bytes:
    """The bytes of little-endian unsigned 32-bit ids."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def token_list(lines: bytes) -> list[bytes]:
    """A rank file's tokens by rank: all that decoding needs."""
    ranks = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines.splitlines())]
    out = [b""] * (max(r for r, _ in ranks) + 1)
    for rank, token in ranks:
        out[rank] = token
    return out


_codecs: dict[tuple, Codec] = {}


def codec(lines: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary, made once in a process."""
    key = (hash(lines), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(lines, pattern)
    return _codecs[key]


def vocabulary(path: str) -> bytes:
    """The rank file's content, read on the driver; executors get it by broadcast (its size is that of the vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, lines: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_tokens, ids (binary, little-endian unsigned 32-bit), and if asked for the ids decoded again.

    A null text counts as empty and gives no ids. Special tokens are ordinary text. Repeated rows and null ids come out
    as they came in; empty docs give no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((lines, pattern))
    more = [T.StructField("decoded", T.BinaryType())] if decoded else []
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *more])

    def run(batches):
        c = codec(*held.value)
        for batch in batches:
            texts, who = common.binary_texts(batch, "__text"), batch.column("__id")
            for first, end, _, _ in common.byte_blocks(texts):
                ids = c.encode(texts.slice(first, end - first).to_pylist())
                back = [pa.array([c.decode(x) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([who.slice(first, end - first), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *back], schema.names)
        c.cache.clear()  # an idle worker holds the vocabulary only

    return common.arrow_map(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), run, schema)


def decode(encoded: DataFrame, lines: bytes, ids_col: str = "ids") -> DataFrame:
    """The rows of encoded with the decoded bytes; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(lines)
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        tokens = token_list(held.value)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                out = [None if x is None else joined(tokens, x) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return common.arrow_map(encoded, run, schema)


def digests(docs: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    x = encode(docs, lines, pattern, decoded=True)
    return x.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def production() -> tuple[bytes, str]:
    import public_tokenizers

    return vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return digests(common.spread(common.table(spark, sf_dir, "documents")), *production())


SQL = None
