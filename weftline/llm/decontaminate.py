"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, met by every token window of the texts.

One pass over the texts, without Python: the words of a text are cut into blocks that overlap by a window, each position of a
block hashes its window and looks the hash up in the broadcast set, and a hit counts only if the words themselves agree. What
a position carries is its block, so the work grows with a text's length and not with its square. The only rows shuffled are
one for each text and one for each verified hit.

Where the windows are too large to be broadcast, each position sends its hash alone (with the text's id and hash); the hashes
that meet a window go back to the text, where the words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

N = 10
#: Bytes of the benchmark's windows that are broadcast at most; beyond it the windows are joined by a shuffle.
MAX_BROADCAST = 80 << 20
#: Positions of a block.
BLOCK = 128
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CASED_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Each distinct window of words of the test items: window, items (ids as strings), len."""
    w = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    spots = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    each = w.select("item", "w", F.explode(spots).alias("at")).select("item", F.slice("w", F.col("at"), n).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("window"))


def _covered(spans: Column) -> Column:
    """Words that the spans (start, length) cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    def add(acc, s):
        end = s["start"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))
    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", n: int = N, carry: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_words, n_hit, items (sorted strings), spans (start, len in words), and with carry the text."""
    grams = common.written(windows(bench, bench_id, bench_text, n), "windows")
    weight = 24 * (1 + F.size("window") + F.size("items")) + F.octet_length(F.concat_ws("", "window", "items"))
    sizes = {r[0]: r[1] for r in grams.groupBy("len").agg(F.sum(weight).alias("bytes")).collect()}  # n lengths at most
    lens = sorted(sizes) or [n]
    grams = grams.withColumn("key", F.xxhash64("window"))
    if sum(sizes.values()) > MAX_BROADCAST:
        return _shuffled(docs, grams, lens, id_col, text_col, carry)
    extra = ["__text"] if carry else []
    base = docs.select(F.col(id_col).alias("__id"), words(F.col(text_col)).alias("w"), *([F.col(text_col).alias("__text")] if carry else []))
    base = base.withColumn("__row", F.monotonically_increasing_id())
    # a text's blocks, and before them a part without words that stands for the text itself
    part = lambda at, block, *more: F.struct(at.alias("at"), block.alias("block"), *more)
    text = lambda c: [c.alias("__text")] if carry else []
    head = F.array(part(F.lit(-1), F.array().cast("array<string>"), *text(F.col("__text"))))
    parts = base.select("__row", "__id", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(head, blocks("w", lens[-1], lambda at, block: part(at, block, *text(F.lit(None).cast("string")))))).alias("part"))
    spots = parts.select("__row", "__id", "n_words", "part.*", F.explode_outer(positions("part.block")).alias("p"))
    spots = spots.withColumn("size", F.explode(F.array(*map(F.lit, lens))) if len(lens) > 1 else F.lit(lens[0]))
    here = F.slice("block", F.col("p") + 1, F.col("size"))
    spots = spots.withColumn("key", F.when(F.col("p") + F.col("size") <= F.size("block"), F.xxhash64(here)))
    met = spots.join(F.broadcast(grams), (spots["key"] == grams["key"]) & (F.slice(spots["block"], spots["p"] + 1, spots["size"]) == grams["window"]), "left")
    met = met.filter((F.col("at") < 0) & (F.col("size") == lens[0]) | F.col("items").isNotNull()).select(
        "__row", "__id", "n_words", "items", F.when(F.col("items").isNotNull(), F.struct((F.col("at") + F.col("p")).alias("start"), "len")).alias("span"), *extra,
    )
    out = met.groupBy("__row").agg(
        F.max("__id").alias("__id"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        *[F.max(c).alias(c) for c in extra],
    )
    return out.select(F.col("__id").alias(id_col), "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), "items", F.array_sort("spans").alias("spans"), *extra)


def blocks(w: str, longest: int, part) -> Column:
    """The words in runs of BLOCK, each with the longest - 1 words after it, so that every window lies in one; none for no words."""
    at = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: part(i, F.slice(w, i + 1, F.lit(BLOCK + longest - 1))))


def positions(block: str) -> Column:
    """0 to BLOCK - 1, as far as the block has words; null for none."""
    return F.when(F.size(block) > 0, F.sequence(F.lit(0), F.least(F.size(block), F.lit(BLOCK)) - 1))


def _shuffled(docs: DataFrame, grams: DataFrame, lens: list[int], id_col: str, text_col: str, carry: bool) -> DataFrame:
    """hits() by joins: positions go as hashes, and the words are compared where the text is."""
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("t"), words(F.col(text_col)).alias("w"), *([F.col(text_col).alias("__text")] if carry else []))
    parts = base.select("__id", "t", F.explode(blocks("w", lens[-1], lambda at, block: F.struct(at.alias("at"), block.alias("block")))).alias("part"))
    spots = parts.select("__id", "t", "part.*", F.explode(positions("part.block")).alias("p")).withColumn("size", F.explode(F.array(*map(F.lit, lens))))
    spots = spots.filter(F.col("p") + F.col("size") <= F.size("block")).select(
        F.col("__id").alias("i"), F.col("t").alias("u"), (F.col("at") + F.col("p")).alias("start"), F.xxhash64(F.slice("block", F.col("p") + 1, F.col("size"))).alias("key"))
    met = spots.join(grams, "key").groupBy("i", "u").agg(F.collect_set(F.struct("start", "len", "window", "items")).alias("met"))
    out = base.join(met, base["__id"].eqNullSafe(met["i"]) & (base["t"] == met["u"]), "left")
    true = F.filter(F.coalesce("met", F.array()), lambda m: F.slice(F.col("w"), m["start"] + 1, m["len"]) == m["window"])
    out = out.withColumn("true", true)
    spans = F.array_sort(F.array_distinct(F.transform("true", lambda m: F.struct(m["start"].alias("start"), m["len"].alias("len")))))
    out = out.withColumns({"spans": spans, "items": F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda m: m["items"]))))})
    return out.select(F.col("__id").alias(id_col), F.size("w").cast("long").alias("n_words"), _covered(F.col("spans")).cast("long").alias("n_hit"), "items", "spans", *(["__text"] if carry else []))


def report(docs: DataFrame, bench: DataFrame, **names) -> DataFrame:
    """A row for each row of docs: its id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. Each row is judged alone, so repeated rows and ids stay apart, and a
    null id stays null. An empty benchmark hits nothing; empty docs give no rows. Other columns are not read.
    """
    x = hits(docs, bench, **names)
    return x.select(
        names.get("id_col", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """docs without the ids of contaminated rows; all columns stay."""
    gone = hits(docs, bench, id_col=id_col, **names).filter("n_hit > 0").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """id and text without the hit words and the gaps before them; a null text stays null."""
    x = hits(docs, bench, id_col=id_col, text_col=text_col, carry=True, **names)
    raw = F.array_remove(F.split("__text", CASED_GAP), "")
    gaps = F.split("__text", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", -1)
    x = x.withColumn("raw", raw).withColumn("gaps", gaps)
    hit = lambda i: F.exists("spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["len"]))
    kept = F.transform("raw", lambda w, i: F.when(hit(i), F.lit("")).otherwise(F.concat(F.get("gaps", i), w)))
    text = F.when(F.col("n_hit") == 0, F.col("__text")).otherwise(F.concat(F.array_join(kept, ""), F.element_at("gaps", -1)))
    return x.select(id_col, text.alias(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (
    SELECT item_id, unnest([w[i:i + 9] FOR i IN range(1, greatest(len(w) - 8, 2))]) AS x FROM b WHERE len(w) > 0)
), s AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
), m AS (
  SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON s.x = g.x AND s.n = g.n
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
