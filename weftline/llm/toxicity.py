"""Toxicity of restored text: a noisy-channel decoder undoes leetspeak, spacing and repetition, then the words are scored.

The channel is a character lattice: each written sign can stand for itself, for the letters it imitates, for nothing (a
separator between spaced letters), or for one more copy of the letter before it. Viterbi search finds the reading that is
likeliest under a character 4-gram model, whose counts are taken over the whole corpus by a distributed sum into a table of
fixed size. Of letters written twice the counts of whole words decide, as far as the corpus has them often; known words stand. Only places that look written through the channel are decoded; all other words read as they are. Chunks of a word
are put together where the model finds the joined word far likelier than the two chunks, unless these are known words and the joined one isn't.

The scorer is a logistic regression over word and word-start features, learned from a bounded sample of labels.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, quality

#: The bounds of the sample that labels are learned from: documents a label, and bytes of one.
MAX_DOCS, MAX_BYTES = 4000, 32768
CUT = 0.5

# The letters that a sign imitates.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = " .-_*"
SIGNS = "".join(LEET)

SYMBOLS = 28  # 0 a boundary, 1 to 26 letters, 27 a byte of another letter
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27


def gram_counts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of the character 4-grams of some texts, each between boundaries."""
    n = len(starts) - 1
    s = np.zeros(len(raw) + n, np.int32)
    at = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(starts))
    s[at] = _SYMBOL[raw]
    s = np.concatenate([np.zeros(3, np.int32), s])
    live = (s[1:] != 0) | (s[:-1] != 0)  # a run of boundaries counts as one
    s = s[np.concatenate([[True], live])]
    s = np.concatenate([np.zeros(2, np.int32), s])
    if len(s) < 4:
        return np.zeros(SYMBOLS**4, np.int64)
    return np.bincount(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:], minlength=SYMBOLS**4)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A word is known if it is one in so many of the corpus, or commoner, and there three times: no more than so many words are.
MOST_WORDS, LEAST = 500_000, 3


def word_key(word: str) -> int:
    """The key that word_counts() gives a word in lower case."""
    h = 0
    for b in reversed(word.encode()):
        h = (h * int(quality._R) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h - (h >> 63 << 64)


def word_counts(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the words of some texts: runs of letters, a byte above ASCII among them, A-Z in lower case."""
    letter = _SYMBOL[raw] != 0
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    heads = starts[(starts > 0) & (starts < len(raw))]
    first[heads], last[heads - 1] = letter[heads], letter[heads - 1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = quality.powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return np.unique(((total[stop] - total[begin]) * down[begin]).view(np.int64), return_counts=True)


def word_blocks(raw: np.ndarray, starts: np.ndarray):
    """word_counts() of a block; of one very long text in pieces."""
    if len(starts) == 2 and len(raw) > common.PIECE:
        for first, end, _ in common.word_pieces(raw, lambda x: np.concatenate([[True], (_SYMBOL[x[1:]] != 0) & (_SYMBOL[x[:-1]] == 0)]), 0):
            yield word_counts(raw[first:end], np.array([0, end - first]))
    else:
        yield word_counts(raw, starts)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, added up."""
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


@dataclass
class Language:
    """Character 4-gram log-probabilities with interpolated lower orders, and the counts of the known words by key."""

    table: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total: int = 0

    @staticmethod
    def of(counts: np.ndarray, weight: float = 4.0, keys: np.ndarray | None = None, held: np.ndarray | None = None, total: int = 0) -> Language:
        c4 = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in (1, 2, 3, 4):
            c = c4.sum(axis=tuple(range(4 - order)))
            p = (c + weight * p) / (c.sum(axis=-1, keepdims=True) + weight)
        table = np.log(p).astype(np.float32).ravel()
        if keys is None:
            return Language(table)
        order = np.argsort(keys)
        return Language(table, keys[order], held[order], total)

    def __post_init__(self):
        self.rest = 1 + self.total - int(self.counts.sum())

    def count(self, word: str) -> int:
        """How often the corpus has a word, if that is known; 0 if not."""
        key = word_key(word)
        at = int(np.searchsorted(self.keys, key))
        return int(self.counts[at]) if at < len(self.keys) and self.keys[at] == key else 0

    def evidence(self, word: str, score: float) -> float:
        """The log-probability of a word whose letters have the log-probability score: what is left of the known words is shared out by letters."""
        n = self.count(word)
        return (math.log(n + self.rest * math.exp(score)) if n else math.log(self.rest) + score) - math.log(self.total + 1)


def language(docs: DataFrame, text_col: str = "text") -> Language:
    """The model of all texts of docs: sums of counts a task, added up by 4-gram (at most SYMBOLS to the 4th rows) and by word.

    The words stay in a table; the model holds those that are known, at most MOST_WORDS.
    """

    def emit(words, keys, ns):
        for k in range(0, len(keys), 50000):
            part = keys[k : k + 50000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), words)), pa.array(part.astype(np.int64)), pa.array(ns[k : k + 50000])], ["word", "key", "n"])

    def run(batches):
        total = np.zeros(SYMBOLS**4, np.int64)
        parts, size = [], 0
        for batch in batches:
            for _, _, raw, starts in common.byte_blocks(common.binary_texts(batch, "text")):
                total += gram_counts(raw, starts)
                for keys, ns in word_blocks(raw, starts):
                    parts.append((keys, ns))
                    size += len(keys)
                    if size > 500_000:
                        parts = [added(parts)]
                        size = len(parts[0][0])
                        if size > 250_000:
                            yield from emit(True, *parts.pop())
                            size = 0
        if parts:
            yield from emit(True, *added(parts))
        seen = np.flatnonzero(total)
        yield from emit(False, seen, total[seen])

    rows = common.arrow_map(docs.select(F.col(text_col).alias("text")), run, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))
    rows = common.written(rows, "letters-and-words")
    said = rows.filter("word").agg(F.sum("n")).first()[0] or 0
    got = rows.filter(~F.col("word") | (F.col("n") >= max(LEAST, -(-said // MOST_WORDS)))).toArrow()
    common.unwrite(rows)
    word, key, n = (got.column(c).to_numpy() for c in ("word", "key", "n"))
    counts = np.zeros(SYMBOLS**4, np.int64)
    counts[key[~word]] = n[~word]
    return Language.of(counts, keys=key[word], held=n[word], total=int(said))


PAIR, MORE = 3.0, 0.5  # what a letter's first further copy costs, and each copy after it


def decode(written: str, lm: Language, swap: float = 0.7, cut: float = 0.2, merge: float = MORE, odd: float = 1.5, pair: float = PAIR) -> str:
    """The likeliest reading of a written place in lower case: words of letters with single spaces between.

    Between single letters, the commonest run of separators is taken for a filler and any other for the end of a word, unless
    that costs more than odd. The first copy of a letter costs pair, as many plain words have two; more copies cost merge.
    """
    signs = _SIGNS.findall(written)
    between = [c for c in signs if c[0] in SEPARATORS]
    filler = max(sorted(set(between)), key=between.count, default="")
    table, b3 = memoryview(lm.table), SYMBOLS**3
    # state: the last three symbols, the last sign, whether that is a word alone so far; value: score, and the reading as linked letters
    states: dict = {(0, "", False): (0.0, None)}
    for sign, next_ in zip([*signs, " "], [*signs[1:], " ", " "], strict=True):
        closing = sign[0] in SEPARATORS or sign.isspace()
        itself = sign == "!" and (next_[0] in SEPARATORS or next_.isspace())  # a mark after a word, and no letter
        reads = ([(sign, 0.0)] if sign.isalpha() else []) + [(c, -swap) for c in LEET.get(sign, "")]
        after: dict = {}

        def offer(key, score, read, letter="", after=after):
            if key not in after or after[key][0] < score:
                after[key] = (score, (read, letter) if letter else read)

        for (context, last, single), (score, read) in states.items():
            if closing or itself or not reads:
                step = table[context * SYMBOLS] if context % SYMBOLS else 0.0
                split = odd if single and sign == filler else 0.0
                offer(((context * SYMBOLS) % b3 if context % SYMBOLS else context, "", False), score + step - split, read, " ")
                if closing and single:  # a separator between spaced letters
                    offer((context, "", False), score - cut - (0.0 if sign == filler else odd), read)
            for letter, cost in reads:
                symbol = ord(letter) - 96 if "a" <= letter <= "z" else 27
                if last[:1] == sign and read and read[1] == letter:
                    offer((context, sign + sign, False), score - (pair if last == sign else merge), read)
                offer(((context * SYMBOLS + symbol) % b3, sign, last == ""), score + cost + table[context * SYMBOLS + symbol], read, letter)
        states = after
    out, read = [], max(states.values(), key=lambda x: x[0])[1]
    while read:
        out.append(read[1])
        read = read[0]
    return " ".join("".join(reversed(out)).split())


def doubled(word: str) -> int:
    """Where the one letter stands that is written twice in a row, in a word of plain letters; -1 for any other word."""
    at = [k for k in range(1, len(word)) if word[k] == word[k - 1]]
    return at[0] if len(at) == 1 and word.isascii() and word.isalpha() and word.islower() else -1


def plain_score(word: str, table: memoryview) -> float:
    """The score that decode() gives a word that is read as it is written."""
    score, context = 0.0, 0
    for c in word:
        at = context * SYMBOLS + (ord(c) - 96 if "a" <= c <= "z" else 27)
        score += table[at]
        context = at % SYMBOLS**3
    return score + table[context * SYMBOLS]


_SIGNS = re.compile(r"[ .\-_*]+|.", re.S)
_HINT = re.compile(r"[a-z][0-9@$!|+(]|[0-9@$!|+(][a-z]|([a-z])\1")
_AFTER = re.compile(r"[\w@$!|+(]*")
_BEFORE = re.compile(r"[\w@$!|+(]")
_SPACED = re.compile(r"(?<![\w@$!|])[a-z0-9@$!|](?:[ .\-_*]{1,2}[a-z0-9@$!|]){2,}(?![\w@$|])")
_NOISE = re.compile(r"([@$!|+(&%*#])\1{2,}|!!+")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^ .\-_*])\1+")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_WORDY = _LETTER | _SIGN
_WORDY[128:] = True


_PART = np.zeros(256, bool)
_PART[[ord(c) for c in SEPARATORS]] = True
_LOUD = np.zeros(256, bool)
_LOUD[[ord(c) for c in "@$!|+(&%*#"]] = True
#: Characters of the longest place whose reading is kept for the next time.
REMEMBERED = 200
#: Bytes of the longest chunk that is looked up among the known words.
LONGEST = 64
_LAST, _NEXT = re.compile(rb"[a-z\x80-\xff]+\Z"), re.compile(rb"[a-z\x80-\xff]+")
JOIN, JOIN_SIGN = 6.0, 2.0  # how much likelier a joined word must be than its chunks, as a logarithm: across a blank, and across a sign


def chunk_ends(raw: np.ndarray, lm: Language) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last positions of the one or two separators between chunks that read as one word, and how much likelier that is."""
    s, part = np.concatenate([np.zeros(3, np.int32), _SYMBOL[raw], np.zeros(4, np.int32)]), np.concatenate([_PART[raw], [False, False]])
    at = np.flatnonzero(part[:-2])
    at = at[s[at + 2] != 0]  # a letter before
    end = at + part[at + 1]
    live = s[end + 4] != 0  # a letter after
    at, end = at[live], end[live]
    a1, a2, a3 = s[at], s[at + 1], s[at + 2]
    a1 = np.where(a2 == 0, 0, a1)
    b1, b2, b3 = s[end + 4], s[end + 5], s[end + 6]
    b3 = np.where(b2 == 0, 0, b3)
    p = lambda a, b, c, d: lm.table[((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d]
    # boundaries in a row count as one, so after a chunk of one letter nothing more is read
    tail = lambda t: np.where(b2 == 0, 0.0, t)
    apart = p(a1, a2, a3, 0) + p(a2, a3, 0, b1) + p(a3, 0, b1, b2) + tail(p(0, b1, b2, b3))
    joined = p(a1, a2, a3, b1) + p(a2, a3, b1, b2) + tail(p(a3, b1, b2, b3))
    gain = joined - apart
    one = gain > np.where((raw[at] == 32) | (raw[end] == 32), JOIN, JOIN_SIGN)
    return at[one], end[one], gain[one]


def suspects(texts: list[str], lm: Language) -> np.ndarray:
    """Which lower-cased texts a Restorer may change: all others read as they are."""
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
    letter, sign, wordy, part, loud = _LETTER[raw], _SIGN[raw], _WORDY[raw], _PART[raw], _LOUD[raw]
    flag = np.zeros(len(raw), bool)
    if len(raw) > 1:
        flag[1:] |= sign[1:] & letter[:-1]
        flag[1:] |= sign[:-1] & letter[1:]
        flag[1:] |= letter[1:] & (raw[1:] == raw[:-1])
        flag[1:] |= loud[1:] & (raw[1:] == raw[:-1])
        flag[1:-1] |= part[:-2] & wordy[1:-1] & part[2:]
        flag[chunk_ends(raw, lm)[0]] = True
    return common.sums(flag, starts) > 0


class Restorer:
    """Restores texts with a bounded memory of what it has decoded."""

    def __init__(self, lm: Language, most: int = 100_000):
        self.lm, self.most, self.known, self.table = lm, most, {}, memoryview(lm.table)

    def read(self, written: str) -> str:
        """The reading of a place, decoded as a whole however long it is; short ones are remembered."""
        if len(written) > REMEMBERED:
            return decode(written, self.lm)
        if written not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[written] = self.read_once(written)
        return self.known[written]

    def read_once(self, written: str) -> str:
        """decode(), with the known words' evidence on letters that are written twice.

        A plain word with one doubled letter has two readings only, which are compared outright. In any other reading a letter
        that was written more than once is doubled where that gives a known word that is likelier.
        """
        if (k := doubled(written)) < 0:
            read = decode(written, self.lm)
            runs = [m.group() for m in _RUN.finditer(written)] if self.lm.total else []
            return " ".join(self.redoubled(w, runs) for w in read.split()) if runs else read
        short = written[:k] + written[k + 1 :]
        return short if self.value(short) - PAIR > self.value(written) else written

    def value(self, word: str) -> float:
        return self.lm.evidence(word, plain_score(word, self.table))

    def redoubled(self, word: str, runs: list[str]) -> str:
        """The likelier of a word and the known words that it is with a letter doubled that one of the runs may stand for."""
        saved = {c: PAIR if len(r) == 2 else MORE for r in runs for c in (r[0] if r[0].isalpha() else LEET.get(r[0], ""))}
        more = {word[:k] + c + word[k:]: saved[c] for k, c in enumerate(word) if c in saved}
        known = [(self.value(w) + gain, w) for w, gain in more.items() if self.lm.count(w)]
        return max([(self.value(word), word), *known])[1]

    def __call__(self, text: str) -> str:
        """text, lower-cased, with the decoded readings in the places they belong to."""
        t = _NOISE.sub(" ", text.lower())
        t = _SPACED.sub(lambda m: " " + self.read(m.group()) + " ", t)
        out, end = [], 0
        for hint in _HINT.finditer(t):  # the word around each hint, once
            if hint.start() < end:
                continue
            first = hint.start()
            while first > end and _BEFORE.match(t[first - 1]):
                first -= 1
            out.append(t[end:first])
            end = _AFTER.match(t, hint.end()).end()
            out.append(" " + self.read(t[first:end]) + " ")
        return self.joined("".join([*out, t[end:]]) if out else t)

    def unknown(self, raw: np.ndarray, at: np.ndarray, end: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places without those between two known words that aren't a known word together."""
        if not self.lm.total:
            return at, end, gain
        text, keep = raw.tobytes(), np.ones(len(at), bool)
        for k, (a, b) in enumerate(zip(at.tolist(), end.tolist(), strict=True)):
            left, right = _LAST.search(text, max(0, a - LONGEST), a), _NEXT.match(text, b + 1)
            if left and right and right.end() - b <= LONGEST:
                one, two = left.group().decode("utf-8", "replace"), right.group().decode("utf-8", "replace")
                keep[k] = not (self.lm.count(one) and self.lm.count(two)) or self.lm.count(one + two) > 0
        return at[keep], end[keep], gain[keep]

    def joined(self, text: str) -> str:
        """text with the chunks of words put together, the likeliest of neighbours first, until no two read as one word."""
        raw = np.frombuffer(text.encode(), np.uint8)
        while len((found := chunk_ends(raw, self.lm))[0]):
            at, end, gain = self.unknown(raw, *found)
            if not len(at):
                break
            near = at[1:] - end[:-1] <= 32
            first = np.ones(len(at), bool)
            first[1:] &= ~near | (gain[1:] >= gain[:-1])
            first[:-1] &= ~near | (gain[:-1] >= gain[1:])
            keep = np.ones(len(raw), bool)
            keep[at[first]] = keep[end[first]] = False
            raw = raw[keep]
        return raw.tobytes().decode()


def words(text: str, heads=None) -> tuple[list[str], int]:
    """The distinct words of letters of a text, in lower case (with heads, only those that may start with one), and its number of words."""
    parts = text.split()
    out = []
    for w in set(parts):
        if heads is None or w[:3] in heads or not w.isalpha():
            if w.isalpha():
                out.append(w)
            else:
                out += _WORD.findall(w)
    return out, len(parts)


def word_features(word: str) -> list[str]:
    """A word and its starts of three letters and more."""
    return [word + "$", *[word[:k] for k in range(3, min(len(word), 10) + 1)]]


@dataclass
class Model:
    lm: Language
    weights: dict[str, float]
    bias: float
    length: float
    heads: frozenset = field(default_factory=frozenset)

    def __post_init__(self):
        self.heads = frozenset(f.rstrip("$")[:3] for f in self.weights)

    def score(self, text: str) -> float:
        """The probability that a restored, lower-cased text is toxic."""
        found, n = words(text, self.heads)
        get, z = self.weights.get, 0.0
        for w in set(found):
            if w[:3] in self.heads:
                z += sum(get(f, 0.0) for f in word_features(w))
        z = self.bias + z + self.length * math.log1p(n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(lm: Language, texts: list[str], labels: list[int], counts: dict | None = None, epochs: int = 30, seed: int = 3, restored: bool = False) -> Model:
    """Chooses the features that toxic texts hold far more often, then learns their weights; labels that were sampled count by their rate."""
    if not 0 < sum(labels) < len(labels):
        return Model(lm, {}, -3.0 if not sum(labels) else 3.0, 0.0)
    restore = (lambda t: t) if restored else Restorer(lm)
    bags = [(set(found), size) for found, size in (words(restore(t)) for t in texts)]
    n = np.bincount(labels, minlength=2)
    of = {w: word_features(w) for w in set().union(*[found for found, _ in bags])}  # of a bounded sample's words
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}
    for y, into in ((1, toxic), (0, clean)):
        for (found, _), label in zip(bags, labels, strict=True):
            if label == y:
                for f in {f for w in found for f in of[w] if y or f in toxic}:
                    into[f] = into.get(f, 0) + 1
        if y:
            toxic = {f: c for f, c in toxic.items() if c >= max(3, 0.002 * n[1])}
    clean = {f: clean.get(f, 0) for f in toxic}
    lift = {f: math.log(((c + 0.1) / n[1]) / ((clean[f] + 0.5) / n[0])) for f, c in toxic.items()}
    chosen = sorted(f for f, v in lift.items() if v > 1.6)
    place = {f: k for k, f in enumerate(chosen)}
    rows = []
    for found, size in bags:
        held: dict[int, float] = {}
        for w in sorted(found):
            for f in of[w]:
                if (k := place.get(f)) is not None:
                    held[k] = held.get(k, 0) + 1
        rows.append((list(held.items()), math.log1p(size)))
    total = counts or {0: int(n[0]), 1: int(n[1])}
    rate = {y: total.get(y, 0) / max(1, n[y]) for y in (0, 1)}
    mean = (rate[0] * n[0] + rate[1] * n[1]) / len(labels)
    worth = {y: min(3.0, float(rate[y] / mean)) for y in (0, 1)}
    # few features a text, so plain numbers are faster than arrays
    w, bias, length = [0.0] * len(chosen), -2.0, 0.0
    sq, sq_b, sq_l = [1e-6] * len(chosen), 1e-6, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            held_, long = rows[i]
            z = bias + length * long
            for k, x in held_:
                z += w[k] * x
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - labels[i]) * worth[labels[i]]
            if abs(g) < 1e-3:
                continue
            for k, x in held_:
                step = g * x + 2e-4 * w[k]
                sq[k] += step * step
                w[k] = max(0.0, w[k] - 0.3 * step / math.sqrt(sq[k]))
            sq_b += g * g
            bias -= 0.1 * g / math.sqrt(sq_b)
            sq_l += (g * long) ** 2
            length = min(0.0, length - 0.02 * g * long / math.sqrt(sq_l))
    return Model(lm, {f: float(w[k]) for f, k in place.items() if w[k] > 0.01}, bias, length)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """The model of the labels, of at most about max_docs documents a label; their texts are restored by the executors."""
    rows, counts = quality.labelled_rows(docs, labels, "toxic", max_docs, max_bytes, stratified=True)
    lm = language(docs)
    held = docs.sparkSession.sparkContext.broadcast(lm)

    def run(batches):
        restore = Restorer(held.value)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([restore(t) for t in part.column("text").to_pylist()], pa.string())], part.schema.names)

    spread = rows.repartition(4 * common.shuffle_partitions(docs.sparkSession))
    return fit(lm, *quality.sampled(common.arrow_map(spread, run, rows.schema)), counts, restored=True)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", restored: bool = False) -> DataFrame:
    """A row for each row of docs: id, held_out, score, predicted (score >= CUT), and with restored the restored text.

    Null and empty texts get the score of a text without words. Repeated rows and ids get equal scores, null ids stay
    null, empty docs give no rows; without toxic labels nothing is called toxic. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    more = [T.StructField("restored", T.StringType())] if restored else []
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), *more])

    def run(batches):
        m = held.value
        restore = Restorer(m.lm)
        for batch in batches:
            texts = common.binary_texts(batch, "__text")
            for first, end, _, _ in common.byte_blocks(texts):
                low = [t.lower() for t in texts.slice(first, end - first).to_pylist()]
                read = [restore(t) if flag else t for t, flag in zip(low, suspects(low, m.lm), strict=True)]
                out = [m.score(t) for t in read]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__held"), pa.array(out, pa.float64()), *([pa.array(read, pa.string())] if restored else [])], schema.names)

    rows = docs.select(F.col(id_col).alias("__id"), common.held_out(F.col(id_col)).alias("__held"), F.col(text_col).alias("__text"))
    return common.arrow_map(rows, run, schema).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


SQL = None
