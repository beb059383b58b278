"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic transducers, one after the other, replace the tokenizer; no token is ever made.

The first cuts a text into words. It reads kinds of characters and has twelve states, and its transitions tell where words
begin. The texts of a block stand in a row, dealt into chunks of CHUNK characters; each chunk is run from all states at once,
which gives its state map, the maps are composed by a parallel prefix scan, and so each chunk's real first state is known and
all chunks are run once more, for the words.

The second reads a word's bytes, and its transitions carry counts of emitted tokens. A state holds, for each suffix of what was
read that can still become part of a token, the last token before the suffix and how many tokens that took, less the least such
number, which the transition has emitted already. A prefix has one last token: the one that may stand after the token before
it, which is so if merging the two tokens' bytes doesn't merge across their border. States and transitions are compiled when a
word first needs them, and are then the same table for all words.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNK, PIECE = 128, 1 << 20
#: Compiled states, words and pairs of tokens that a worker holds at most; beyond it compiling begins anew.
MOST_STATES, MOST_WORDS, MOST_PAIRS = 300_000, 600_000, 600_000

STATES = ("start", "letters", "digits", "signs", "quote", "quote r", "quote v", "quote l", "blank", "space", "blanks", "spaces")
KINDS = ("letter", "digit", "sign", "'", " ", "white", "stmd", "r", "v", "l", "e", "end")
_LETTERS = {"letter", "stmd", "r", "v", "l", "e"}


def step(state: str, kind: str) -> tuple[str, bool, bool]:
    """The next state, and whether a word begins at this character and at the one before.

    blank and space are white space of one character, blanks and spaces of more, by whether the last is U+0020, which goes
    with the word after it. A quote may begin a short form ('s 't 'm 'd 're 've 'll) where no blank or sign stands before it.
    """
    waiting = state.startswith("quote ")
    if kind == "end":
        return "start", True, waiting
    if kind in (" ", "white"):
        after = state in ("blank", "space", "blanks", "spaces")
        return ("blank" if kind == " " else "space") + "s" * after, not after, waiting
    run = "letters" if kind in _LETTERS else "digits" if kind == "digit" else "signs"
    if state in ("blank", "blanks"):
        return run, False, state == "blanks"
    if state == "quote" and run != "digits" and kind != "letter" and kind != "e":
        return ("signs", False, False) if run == "signs" else ("start" if kind == "stmd" else f"quote {kind}", False, False)
    if waiting:
        if state + kind in ("quote re", "quote ve", "quote ll"):
            return "start", False, False
        if run == "letters":
            return run, False, True
    elif run == state:
        return run, False, False
    return "quote" if kind == "'" else run, True, waiting or state == "spaces"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    to, marks = np.zeros((len(STATES), len(KINDS)), np.uint8), np.zeros((len(STATES), len(KINDS)), np.uint8)
    for i, s in enumerate(STATES):
        for j, k in enumerate(KINDS):
            after, here, back = step(s, k)
            to[i, j], marks[i, j] = STATES.index(after), here + 2 * back
    return to.ravel(), marks.ravel()


def kinds_of_characters() -> np.ndarray:
    """The kind of each code point, as the tokenizer library's own regular expressions see it."""
    from tokenizers import Regex, pre_tokenizers

    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, KINDS.index("sign"), np.uint8)
    for pattern, kind in ((r"\p{L}+", "letter"), (r"\p{N}+", "digit"), (r"\s+", "white")):
        hit = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            hit[a:b] = False
        out[points[hit]] = KINDS.index(kind)
    for letters, kind in (("stmd", "stmd"), ("r", "r"), ("v", "v"), ("l", "l"), ("e", "e"), ("'", "'"), (" ", " ")):
        out[list(map(ord, letters))] = KINDS.index(kind)
    return out


class Words:
    """The first transducer."""

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds
        self.to, self.marks = _tables()

    def maps(self, lanes: np.ndarray) -> np.ndarray:
        """The state map of each chunk (a column of lanes): the last state for each first state."""
        at = np.repeat(np.arange(len(STATES), dtype=np.uint8)[:, None], lanes.shape[1], axis=1)
        for kind in lanes:
            at = self.to[at.astype(np.int16) * len(KINDS) + kind]
        return at

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """The composed map of each chunk and all before it, in a logarithmic number of rounds."""
        maps, by = maps.copy(), 1
        while by < maps.shape[1]:
            maps[:, by:] = np.take_along_axis(maps[:, by:], maps[:, :-by].astype(np.intp), axis=0)
            by *= 2
        return maps

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """True where a word begins (an end counts as one) in a row of kinds that stands at a text's start and ends with an end."""
        n = -(-len(kinds) // CHUNK)
        lanes = np.full(n * CHUNK, KINDS.index("end"), np.uint8)
        lanes[: len(kinds)] = kinds
        lanes = np.ascontiguousarray(lanes.reshape(n, CHUNK).T)
        at = np.zeros(n, np.uint8)
        at[1:] = self.scan(self.maps(lanes))[0, :-1]
        seen = np.empty_like(lanes)
        for k, kind in enumerate(lanes):
            where = at.astype(np.int16) * len(KINDS) + kind
            seen[k], at = self.marks[where], self.to[where]
        seen = seen.T.ravel()[: len(kinds)]
        begin = (seen & 1).astype(bool)
        begin[:-1] |= seen[1:] >= 2
        return begin


class Counter:
    """The second transducer, over the bytes of a word."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        ids = {bytes([i]): i for i in range(256)}
        self.made, self.left, self.right, self.pairs = [-1] * 256, [-1] * 256, [-1] * 256, {}
        for rank, (a, b) in enumerate(merges):
            if a + b in ids:
                raise ValueError(f"two merges give {a + b!r}")
            token = ids[a + b] = len(ids)
            self.made.append(rank), self.left.append(ids[a]), self.right.append(ids[b])
            self.pairs[ids[a] << 20 | ids[b]] = token
        self.whole = [True] * 256
        for token in range(256, len(ids)):
            a, b = self.left[token], self.right[token]
            self.whole.append(self.whole[a] and self.whole[b] and self.apart(a, b, self.made[token]))
        self.child, self.token = {}, [-1]
        for text, token in ids.items():
            if self.whole[token]:
                node = 0
                for byte in text:
                    if (down := self.child.get(node << 8 | byte)) is None:
                        down = self.child[node << 8 | byte] = len(self.token)
                        self.token.append(-1)
                    node = down
                self.token[node] = token
        if max(map(len, ids)) > 200 or len(ids) >= 1 << 20:
            raise ValueError("too large a vocabulary, or too long a token, for the packed states")
        self.clear()

    def clear(self) -> None:
        self.ids, self.states, self.next, self.known = {(0,): 0}, [(0,)], {}, {}

    def apart(self, a: int, b: int, before: int = 1 << 30) -> bool:
        """Whether no merge with a rank under before crosses the border of the tokens a and b.

        Goes back in time: of the pieces at the border the one that was made last is taken apart, and each pair that met there
        would have merged if its rank came before either piece went into a larger one (at one rank the left place goes first).
        """
        made, pairs = self.made, self.pairs
        until_a = until_b = before
        while True:
            both = pairs.get(a << 20 | b)
            if both is not None and made[both] < until_a and made[both] <= until_b and made[both] < before:
                return False
            if made[a] > made[b]:
                until_a, a = made[a], self.right[a]
            elif made[b] >= 0:
                until_b, b = made[b], self.left[b]
            else:
                return True

    def _may(self, before: int, token: int) -> bool:
        """before: 0 at a word's start, else one more than the token."""
        if not before:
            return True
        key = before << 20 | token
        if (known := self.known.get(key)) is None:
            known = self.known[key] = self.apart(before - 1, token)
        return known

    def _last(self, state: int, byte: int) -> int:
        """The prefix's last token (plus one, from bit 8 on) and the tokens that it takes beside those emitted."""
        child, token = self.child, self.token
        for x in self.states[state]:
            down = child.get(x >> 28 << 8 | byte)
            if down is not None and token[down] >= 0 and self._may(x >> 8 & 0xFFFFF, token[down]):
                return token[down] + 1 << 8 | (x & 255) + 1
        raise AssertionError("a prefix without a last token")

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state: next state and emitted tokens (low byte).

        A state is a tuple of numbers, longest suffix first: node of the suffix (from bit 28 on), token before it plus one
        (from bit 8 on), tokens before it.
        """
        child = self.child
        out = [down << 28 | x & 0xFFFFFFF for x in self.states[state] if (down := child.get(x >> 28 << 8 | byte)) is not None]
        out.append(self._last(state, byte))
        emitted = min([x & 255 for x in out])
        after = tuple([x - emitted for x in out])
        if (k := self.ids.get(after)) is None:
            k = self.ids[after] = len(self.states)
            self.states.append(after)
        self.next[state << 8 | byte] = k << 8 | emitted
        return k << 8 | emitted

    def count(self, word: bytes) -> int:
        """Tokens of a word. Its last transition is compiled only when a longer word goes on from there."""
        if not word:
            return 0
        if len(self.states) > MOST_STATES or len(self.known) > MOST_PAIRS:
            self.clear()
        state, n, look = 0, 0, self.next.get
        for byte in word[:-1]:
            to = look(state << 8 | byte)
            if to is None:
                to = self._compile(state, byte)
            state, n = to >> 8, n + (to & 255)
        return n + (self._last(state, word[-1]) & 255)


def read_tokenizer(content: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges in order and added tokens of a byte-level BPE tokenizer file; raises for what the transducers don't express."""
    t = json.loads(content)
    model, pre = t["model"], t["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or t["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("not a plain byte-level BPE tokenizer")
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in t["added_tokens"]):
        raise ValueError("added tokens with conditions")
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    raw = lambda s: bytes(map(byte.__getitem__, s))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return [(raw(a), raw(b)) for a, b in merges], [a["content"] for a in t["added_tokens"]]


_CUT = re.compile("[A-Za-z](?= )")


def pieces(text: str, most: int | None = None):
    """text in pieces of at least PIECE characters, cut between a letter and a blank, where a word ends whatever stands around."""
    first, most = 0, most or PIECE
    while len(text) - first > most and (cut := _CUT.search(text, first + most)):
        yield text[first : cut.end()]
        first = cut.end()
    yield text[first:]


class Repeats:
    """Finds the repeated words of a row by a rolling hash modulo 2^64.

    Different words of under 1024 characters with one hash are a matter of chance, some 10^-10 a row; longer ones, of which
    such a hash can be fooled by design, are never taken as repeated.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the different words among the words, and for each word the place among these."""
        if len(self.up) < len(points):
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(len(points), np.uint64(x), np.uint64)]) for x in (self.BASE, inverse))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[: len(points)], out=total[1:])
        key = (total[end] - total[begin]) * self.down[begin]
        long = np.flatnonzero(end - begin >= 1024)
        if len(long):
            _, key = np.unique(key, return_inverse=True)
            key[long] = np.arange(len(long)) + len(key)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return first, which


class Machine:
    """Both transducers of a tokenizer, and the words counted so far."""

    def __init__(self, content: str, kinds: np.ndarray):
        merges, added = read_tokenizer(content)
        self.words, self.counter, self.repeats, self.cache = Words(kinds), Counter(merges), Repeats(), {}
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def _row(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part, each a text of its own."""
        row = "\0".join([*parts, ""])
        points = np.frombuffer(row.encode("utf-32-le"), np.uint32)
        kinds = self.words.kinds[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = KINDS.index("end")
        at = np.flatnonzero(self.words.begins(kinds))
        real = kinds[at[:-1]] != KINDS.index("end")
        begin, end = at[:-1][real], at[1:][real]
        first, which = self.repeats.first(points, begin, end)
        words = [row[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.cache) > MOST_WORDS:
            self.cache.clear()
        n = np.array([self._word(w) for w in words], np.float64)
        return np.bincount(np.searchsorted(ends, begin), n[which], len(parts)).astype(np.int64)

    def _word(self, word: str) -> int:
        if (n := self.cache.get(word)) is None:
            n = self.counter.count(word.encode())
            if len(word) <= 256:
                self.cache[word] = n
        return n

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an added token's string is one token, and the texts beside it are apart."""
        out, parts, whose = np.zeros(len(texts), np.int64), [], []
        for k, text in enumerate(texts):
            apart = self.added.split(text) if self.added else [text]
            out[k] = len(apart) - 1
            for part in apart:
                for piece in pieces(part):
                    parts.append(piece)
                    whose.append(k)
                    if len(piece) >= PIECE:  # a long piece goes alone, with what came before it
                        np.add.at(out, whose, self._row(parts))
                        parts, whose = [], []
        if parts:
            np.add.at(out, whose, self._row(parts))
        return out


_machines: dict[int, Machine] = {}


def token_counts(docs: DataFrame, content: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_bytes (UTF-8), n_tokens, over_limit, by the tokenizer file whose content is given.

    A null text counts as empty and has no tokens. Repeated rows and null ids come out as they came in; empty docs give no
    rows; other columns are not read. What is broadcast is the file and a byte for each code point. A text is read in pieces;
    only one without a blank after a letter within a million characters is held whole.
    """
    held = docs.sparkSession.sparkContext.broadcast((content, kinds_of_characters()))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        key = hash(held.value[0])
        if key not in _machines:
            _machines[key] = Machine(*held.value)
        m = _machines[key]
        for batch in batches:
            texts, who = common.binary_texts(batch, "__text"), batch.column("__id")
            n = [m.count(texts.slice(first, end - first).to_pylist()) for first, end, _, _ in common.byte_blocks(texts, PIECE)]
            yield pa.RecordBatch.from_arrays([who, pc.cast(pc.binary_length(texts), pa.int64()), pa.array(np.concatenate(n) if n else [], pa.int64())], schema.names)
        m.cache.clear()

    out = common.arrow_map(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def production() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(common.spread(common.table(spark, sf_dir, "documents")), production())


SQL = None
