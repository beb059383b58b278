"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the commonest.

No pair of words is ever made. Two words differ by one replaced letter just if they share a group (position, what is before it,
what is after it), and then one such group only; so a word's partners by replacement are the sizes of its groups less one, and
its best one is the group's first word, or the second where it is first itself. A word that comes from another by a deletion
meets it where the deletions of all words join the vocabulary; that group too gives each side its number and its best.

Groups and words go by a fingerprint of 124 bits (polynomials modulo four primes), which all places of a word share the work
for, so a word of any length takes time and rows in proportion to its length, and a row has a fixed size. Words go by their
place in the order of the vocabulary. A group holds at most a word for each letter of the alphabet and place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "A-Za-z\\u00C0-\\u00FF"
DAMAGED, SHORTEST, RAREST, FACTOR = 97, 5, 3, 2
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 134775813, 22695477, 69069)
WILD = 1  # the sign of a wildcard, no letter's code
OWN, SHORTER, WILDCARD = range(3)
#: Letters that numpy works on at a time, but for a longer word.
BLOCK = 1 << 19


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: each word of SHORTEST letters or more that occurs at least RAREST times over all texts.

    Words are the runs of letters with A-Z lower-cased, but where 97 divides the crc32 h of `id:run` the letter h modulo the
    run's length is taken out first. A null text has no words, a null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.split(F.col(text_col), f"[^{LETTERS}]+")).alias("run"))
    runs = runs.filter(F.length("run") >= SHORTEST).withColumn("run", common.ascii_lower(F.col("run")))
    runs = runs.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RAREST)


def ordered(words: DataFrame) -> DataFrame:
    """words with an id that grows with the word, in the order of code points; written, so that the ids stay."""
    held = common.written(words, "words")
    parts = common.shuffle_partitions(words.sparkSession)
    out = common.written(held.repartitionByRange(parts, "word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    common.unwrite(held)
    return out


class Fingerprints:
    """Of words as bytes: of each whole word, of the word with a wildcard at each place, and without the letter at each place."""

    def __init__(self):
        self.powers = [np.ones(1, np.int64) for _ in PRIMES]

    def _power(self, k: int, most: int) -> np.ndarray:
        have, p = self.powers[k], PRIMES[k]
        while len(have) <= most:
            have = np.concatenate([have, have * (int(have[-1]) * BASES[k] % p) % p])
        self.powers[k] = have
        return have

    def of(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (two columns of 62 bits) by word, by place, by place; first: where each word begins, and the end."""
        size = np.diff(first)
        left = np.repeat(first[1:], size) - np.arange(len(codes)) - 1  # letters after a place
        whole, wild, less = [], [], []
        for k, p in enumerate(PRIMES):
            power = self._power(k, int(size.max()))
            term = codes * power[left] % p
            short = np.where(left > 0, codes * power[np.maximum(left - 1, 0)] % p, 0)
            upto, upto_short = np.r_[0, np.cumsum(term)], np.r_[0, np.cumsum(short)]
            all_of = (upto[first[1:]] - upto[first[:-1]]) % p
            whole.append(all_of)
            wild.append((np.repeat(all_of, size) - term + WILD * power[left]) % p)
            after = np.repeat(upto[first[1:]], size) - upto[1:]
            less.append((upto_short[:-1] - np.repeat(upto_short[first[:-1]], size) + after) % p)
        return tuple(np.stack([h[0] << 31 | h[1], h[2] << 31 | h[3]], axis=1) for h in (whole, wild, less))


_KEYS = "k1 long, k2 long, kind int, less long, id long"


def keys(words: DataFrame) -> DataFrame:
    """A row for each word, each of its places, and each of its different deletions: fingerprint, kind, minus n, id."""

    def run(batches):
        prints = Fingerprints()
        for batch in batches:
            word, n, ids = (batch.column(c) for c in ("word", "n", "id"))
            n, ids = n.to_numpy().astype(np.int64), ids.to_numpy()
            for a, b, _, _ in common.byte_blocks(word, BLOCK):
                text = word.slice(a, b - a).to_pylist()
                first = np.r_[0, np.cumsum([len(w) for w in text])]
                codes = np.frombuffer("".join(text).encode("latin-1"), np.uint8).astype(np.int64)
                whole, wild, less = prints.of(codes, first)
                who = np.repeat(np.arange(a, b), np.diff(first))
                new = np.ones(len(codes), bool)  # a run of one letter has one deletion
                new[1:] = codes[1:] != codes[:-1]
                new[first[:-1]] = True
                key = np.concatenate([whole, wild, less[new]])
                who = np.concatenate([np.arange(a, b), who, who[new]])
                kind = np.repeat(np.array([OWN, WILDCARD, SHORTER], np.int32), [len(whole), len(wild), int(new.sum())])
                for k in range(0, len(key), BLOCK):
                    s = slice(k, k + BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[s, 0], key[s, 1], kind[s], -n[who[s]], ids[who[s]])], ["k1", "k2", "kind", "less", "id"])

    return common.arrow_map(words.select("word", "n", "id"), run, _KEYS)


def shares(rows: np.ndarray) -> list[np.ndarray]:
    """id, near, minus n and id of the best, for the members of whole groups; rows (k1, k2, kind, minus n, id) in order.

    The first member of a group has the second as its best, the others have the first. A word without the word itself in the
    vocabulary is no group of deletions.
    """
    k1, k2, kind, less, ids = rows
    new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])] if len(k1) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(k1)])
    use = (size > 1) & (kind[first] != SHORTER)
    first, size = first[use], size[use]
    at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
    head, many = np.repeat(first, size), np.repeat(size, size) - 1
    best = np.where(at == head, head + 1, head)
    near = np.where((kind[at] == SHORTER), 1, many)
    return [ids[at], near, less[best], ids[best]]


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, best (struct of minus n and id) of the words that have near ones."""
    parts = common.shuffle_partitions(words.sparkSession)
    order = ["k1", "k2", "kind", "less", "id"]

    def run(batches):
        held = [np.zeros(0, np.int64)] * 5
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in shares(rows)], ["id", "near", "less", "best"])
        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, order, strict=True)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            held = [r[cut:] for r in rows]
            yield out([r[:cut] for r in rows])
        yield out(held)

    dealt = keys(words).repartition(parts, "k1", "k2").sortWithinPartitions(*order)
    each = common.arrow_map(dealt, run, "id long, near long, less long, best long")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of the words that have a form; forms: id, form_id.

    Each round goes twice as far. A form occurs at least twice as often as its word, so a few rounds end it.
    """
    table = common.written(forms.select("id", F.col("form_id").alias("root"), F.lit(True).alias("more")), "roots")
    while table.filter("more").limit(1).count():
        up = table.select(F.col("id").alias("root"), F.col("root").alias("above"))
        after = table.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("more"))
        last, table = table, common.written(after, "roots")
        common.unwrite(last)
    return table.select("id", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word of the vocabulary: word, form, root, n, n_near, form_n.

    form is the near word that occurs most (of equal ones the first in code-point order), if that is at least FACTOR times as
    often as the word, else null. root follows forms to the last, and is the word itself where it has none. Repeated rows
    count as often as they occur. Empty docs, or docs without letters, give no rows; other columns are not read.
    """
    words = ordered(vocabulary(docs, id_col, text_col))
    near = neighbours(words)
    formed = F.when(-F.col("best.less") >= FACTOR * F.col("n"), F.col("best.best"))
    x = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), formed.alias("form_id"))
    x = common.written(x, "near")
    root = roots(x.filter("form_id is not null"))
    name = lambda i, w: words.select(F.col("id").alias(i), F.col("word").alias(w), F.col("n").alias(f"{w}_n"))
    x = x.join(root, "id", "left").join(name("form_id", "form"), "form_id", "left").join(name("root", "top"), "root", "left")
    return x.select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(common.spread(common.table(spark, sf_dir, "documents")))


SQL = """
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), d AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r WHERE length(run) >= 5 GROUP BY doc_id, run
), k AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, [CAST(strpos('0123456789ABCDEF', substr(x, CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1)) - 1 AS BIGINT) FOR i IN range(0, length(x))]),
    lambda c, v: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, v) & 15) + 1])), 4294967295) AS h FROM d
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM k)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), p AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS wild, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), l AS (
  SELECT DISTINCT p.word AS a, v.word AS b, p.n AS na, v.n AS nb FROM p JOIN v ON p.less = v.word
), e AS (
  SELECT x.word AS a, x.n AS na, y.word AS b, y.n AS nb FROM p x JOIN p y ON x.wild = y.wild AND x.word <> y.word
  UNION ALL SELECT a, na, b, nb FROM l UNION ALL SELECT b, nb, a, na FROM l
), m AS (
  SELECT a AS word, na AS n, b, nb, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY nb DESC, b) AS place FROM e
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 2 * v.n THEN b END AS form, CASE WHEN nb >= 2 * v.n THEN nb END AS form_n
  FROM v LEFT JOIN (SELECT * FROM m WHERE place = 1) m ON v.word = m.word
), t AS (
  SELECT word, word AS at, form AS up FROM f
  UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.up = f.word
)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON f.word = t.word AND t.up IS NULL
"""
