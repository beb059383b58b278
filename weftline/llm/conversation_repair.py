"""Repair of conversation structure by a dynamic program over the turns that are retained.

A repaired conversation has the roles (s?(ua)+)?, at the least cost of keeping, reroling, deleting and inserting turns. Only
turns that stay are states of the program: the cost of turn j as role r, with what follows, is its own cost and that of the gap
up to the next retained turn. A gap costs the deletions in it, a difference of two prefix sums, and the inserts that the two
roles at its ends ask for; so the best gap from any place on is a running minimum for each role (`price`). Of the cheapest ways
the audit that is least in ASCII order comes from a walk from the front that takes the first edit in the order D, I, K, R which
loses nothing.

Turns in order are cut into segments of at most SEGMENT rows. A segment that may not be its conversation's only one carries its
own 4 by 4 table of least costs from the role before it to the role after it. These are made where the turns are, however long
the conversation, and combined from the last segment back; the walk then needs one segment in memory at a time. Since the digest
of a repaired conversation is sequential, its segments pass one task in order, as a stream; nothing gathers them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEGMENT, SEGMENT_BYTES = 256, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
#: Roles before a place: none yet, s, u, a; and by inserting, the next.
START, S, U, A = range(4)
ADDED, NAMES = (U, U, A, U), (None, None, "user", "assistant")
#: Inserts between a role and the next retained one (none, s, u, a), and up to the end.
BETWEEN = ((FAR, 0, 0, 1), (FAR, FAR, 0, 1), (FAR, FAR, 1, 0), (FAR, FAR, 0, 1))
AFTER = (0, 2, 1, 0)
END = tuple(INSERT * n for n in AFTER)
_GAP = tuple(tuple(n if n >= FAR else INSERT * n for n in row) for row in BETWEEN)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies (0 for a dropped row) after the damage that crc32 of `conv:turn` modulo 20 asks for.

    0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?`, 3 repeats it, 4 makes its role user. Nulls count as one
    space, in the text of the key too, but a null turn stays null.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled(conv), filled(turn)).cast("binary")) % 20
    x = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), kind.alias("kind"))
    return x.select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, fault: a row for each different turn with the number of its copies, and its first copy's fault.

    Further copies of a turn are blank or duplicates. Copies are counted before anything is sorted, so that one turn that is
    repeated very often is one row; the first place of a role and text comes from an aggregation and not from a window.
    """
    each = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    each = common.written(each.withColumn("said", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)), "said")
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = each.filter("copies > 0").groupBy(F.col("conv").alias("c"), F.col("said").alias("h")).agg(F.min(place).alias("first"))
    each = each.join(first, each["conv"].eqNullSafe(first["c"]) & (each["said"] == first["h"]), "left")
    body = F.rtrim("text", F.lit(WHITE))
    fault = F.when(body == "", BLANK).when(place != F.col("first"), DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return each.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def own(initial: str, copies: int, fault: int) -> tuple[int, ...]:
    """Costs of retaining a row's first copy as s, u or a, its other copies deleted; FAR where that isn't allowed."""
    if not copies or fault in (BLANK, DUPLICATE):
        return (FAR,) * 4
    rest = DELETE * (copies - 1) + (TRUNCATED if fault == CUT else 0)
    return (FAR, rest + KEEP if initial == "s" else FAR, rest + (KEEP if initial == "u" else REROLE), rest + (KEEP if initial == "a" else REROLE))


def price(owns: list[tuple[int, ...]], copies: list[int], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each place (and the end) the least cost of all from there on, by the last role before it; after: by the last role at the end."""
    deleted = [0]
    for n in copies:
        deleted.append(deleted[-1] + DELETE * n)
    best, out = [FAR] * 4, [after]
    for j in range(len(owns) - 1, -1, -1):
        ahead, retain = out[-1], owns[j]
        for r in (S, U, A):
            if (cost := deleted[j] + retain[r] + ahead[r]) < best[r]:
                best[r] = cost
        out.append(tuple(min(deleted[-1] + after[p], *(_GAP[p][r] + best[r] for r in (S, U, A))) - deleted[j] for p in range(4)))
    return out[::-1]


def table(owns: list[tuple[int, ...]], copies: list[int]) -> list[int]:
    """Least costs of a segment from each role before it (rows) to each last role at its end."""
    columns = [price(owns, copies, tuple(0 if p == q else FAR for p in range(4)))[0] for q in range(4)]
    return [min(FAR, columns[q][p]) for p in range(4) for q in range(4)]


def before(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(costs[4 * p + q] + after[q] for q in range(4)) for p in range(4))


class Walk:
    """One conversation's results, fed with its segments in order."""

    def __init__(self):
        self.role, self.last, self.audit, self.cost, self.digest = START, None, [], None, hashlib.sha256()
        self.counts, self.illegal, self.turns, self.low, self.high, self.lines = [0] * 4, 0, 0, None, None, 0

    def _line(self, role: str, text: str) -> None:
        self.digest.update(("\n" * (self.lines > 0) + role + ":" + text).encode("utf-8"))
        self.lines += 1

    def _count(self, turn: int | None, initial: str, copies: int, fault: int) -> None:
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # a role beside itself
        self.last = initial
        self.counts[fault] += 1
        self.counts[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def feed(self, rows: list[tuple], after: tuple[int, ...], last: bool) -> None:
        """rows: turn, role, text, copies, fault; after: least costs after them by role; last: nothing follows."""
        owns, copies = [own(role[:1], n, fault) for _, role, _, n, fault in rows], [n for *_, n, _ in rows]
        costs = price(owns, copies, after)
        if self.cost is None:
            self.cost = costs[0][START]
        for j, (turn, role, text, n, fault) in enumerate(rows):
            if not n:
                continue
            self._count(turn, role[:1], n, fault)
            while True:
                p, now, ahead = self.role, costs[j][self.role], costs[j + 1]
                if DELETE * n + ahead[p] == now:
                    self.audit.append("D" * n)
                    break
                if INSERT + costs[j][ADDED[p]] == now:
                    self._insert()
                    continue
                kept = {"s": S, "u": U, "a": A}.get(role[:1])
                if kept is not None and BETWEEN[p][kept] == 0 and owns[j][kept] + ahead[kept] == now:
                    self.role, edit = kept, "K"
                else:
                    self.role, edit, role = ADDED[p], "R", NAMES[ADDED[p]]
                self._line(role, text)
                self.audit.append(edit + "D" * (n - 1))
                break
        while last and AFTER[self.role]:
            self._insert()

    def _insert(self) -> None:
        self.role = ADDED[self.role]
        self._line(NAMES[self.role], "")
        self.audit.append("I")

    def result(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_ROWS = "turns array<long>, roles array<string>, texts array<string>, copies array<long>, faults array<int>"


def _segments(rows: DataFrame) -> DataFrame:
    """conv, part, seq, costs (null for a whole conversation) and the turns of each segment, over rows in order within ranges."""
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T._parse_datatype_string("part int, seq long, costs array<long>, " + _ROWS).fields])

    def run(batches):
        part, seq, held, size, head = TaskContext.get().partitionId(), 0, [], 0, True  # head: the conversation may have begun before
        shape = None

        def packed(whole: bool):
            conv, turns, roles, texts, copies, kinds = zip(*held, strict=True)
            costs = None if whole else table([own(r[:1], n, f) for r, n, f in zip(roles, copies, kinds, strict=True)], list(copies))
            cols = [conv[:1], [part], [seq], [costs], [turns], [roles], [texts], [copies], [kinds]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, shape, strict=True)], schema.names)

        for batch in batches:
            if shape is None:
                t = {n: batch.schema.field(n).type for n in batch.schema.names}
                shape = [t["conv"], pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.string())] * 2, pa.list_(pa.int64()), pa.list_(pa.int32())]
            for k in range(0, len(batch), 1024):
                for row in zip(*(batch.column(n).slice(k, 1024).to_pylist() for n in ("conv", "turn", "role", "text", "copies", "fault")), strict=True):
                    if held and (row[0] != held[0][0] or len(held) == SEGMENT or size > SEGMENT_BYTES):
                        new = row[0] != held[0][0]
                        yield packed(new and not head)
                        held, size, seq, head = [], 0, seq + 1, not new
                    held.append(row)
                    size += len(row[3])
        if held:
            yield packed(False)

    return common.arrow_map(rows, run, schema)


def _from_the_end(segments: DataFrame) -> DataFrame:
    """Adds after (least costs after a segment by role) and last, over segments from a conversation's last to its first."""
    schema = T.StructType([f for f in segments.schema.fields if f.name != "costs"] + T._parse_datatype_string("after array<long>, last boolean").fields)

    def run(batches):
        conv, costs, begun = None, END, False
        for batch in batches:
            after, last = [], []
            for c, own_costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                new = not begun or c != conv
                conv, begun = c, True
                costs = END if new else costs
                after.append(costs)
                last.append(new)
                costs = before(own_costs, costs) if own_costs else None
            kept = [batch.column(n) for n in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(after, pa.list_(pa.int64())), pa.array(last, pa.bool_())], schema.names)

    return common.arrow_map(segments, run, schema)


def _walked(segments: DataFrame, conv: str) -> DataFrame:
    schema = T.StructType([
        T.StructField(conv, segments.schema["conv"].dataType),
        *T._parse_datatype_string("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields,
    ])

    def run(batches):
        walk = None
        for batch in batches:
            out = []
            for k in range(len(batch)):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                walk = walk or Walk()
                walk.feed(list(zip(row["turns"], row["roles"], row["texts"], row["copies"], row["faults"], strict=True)), tuple(row["after"]), row["last"])
                if row["last"]:
                    out.append((row["conv"], *walk.result()))
                    walk = None
            if out:
                kinds = [batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    return common.arrow_map(segments, run, schema)


def repair(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for each conversation of rows (conv, turn, role, text, copies, as damaged() gives them): its faults and its repair.

    conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns are ordered by number (null first),
    then role, then text. A row with 0 copies is no turn, but its conversation comes out: with zeros, an empty audit and the
    digest of nothing if it has no others. A null conversation id is a conversation of its own. A role that begins otherwise
    than s, u or a can be reroled or deleted. An empty table gives no rows.
    """
    spark = rows.sparkSession
    each = faults(rows)
    order = ["conv", "turn", "role", "text"]
    dealt = each.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    cut = common.written(_segments(dealt), "segments")
    by = cut.repartition("conv")
    back = _from_the_end(by.sortWithinPartitions("conv", F.col("part").desc(), F.col("seq").desc()))
    return _walked(back.sortWithinPartitions("conv", "part", "seq"), conv)


def query(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(common.table(spark, sf_dir, "conversations")))


SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations
), k AS (
  SELECT * EXCLUDE x, xor(list_reduce(list_prepend(4294967295, [CAST(strpos('0123456789ABCDEF', substr(x, CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1)) - 1 AS BIGINT) FOR i IN range(0, length(x))]),
    lambda c, v: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, v) & 15) + 1])), 4294967295) % 20 AS d FROM t
), e AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE d <> 0
), o AS (
  SELECT *, left(role, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         count(*) OVER (PARTITION BY conv_id) AS n FROM e
), f AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o
), z AS (
  SELECT *, CASE WHEN fault IN (1, 2) THEN 100000000 WHEN fault = 3 THEN 3 ELSE 0 END AS h, CASE WHEN r = 's' THEN 0 ELSE 100000000 END AS hs,
         CASE WHEN r = 'u' THEN 0 ELSE 3 END AS hu, CASE WHEN r = 'a' THEN 0 ELSE 3 END AS ha FROM f
), g AS (
  SELECT DISTINCT conv_id, n + 1 AS i, [0, 6, 3, 0] AS g FROM z
  UNION ALL
  SELECT conv_id, i, [least(x[1], 3 + x[3], 6 + x[4]), least(x[2], 3 + x[3], 6 + x[4]), least(x[3], 3 + x[4]), least(x[4], 3 + x[3])] FROM (
    SELECT z.conv_id, z.i, [least(4 + g[1], h + hs + g[2], h + hu + g[3]), least(4 + g[2], h + hu + g[3]), least(4 + g[3], h + ha + g[4]), least(4 + g[4], h + hu + g[3])] AS x
    FROM g JOIN z ON z.conv_id IS NOT DISTINCT FROM g.conv_id AND z.i = g.i - 1)
), s AS (
  SELECT z.*, a.g AS g, b.g AS ahead FROM z JOIN g a ON z.conv_id IS NOT DISTINCT FROM a.conv_id AND z.i = a.i JOIN g b ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.i + 1 = b.i
), w AS (
  SELECT DISTINCT conv_id, CAST(1 AS BIGINT) AS i, n, 1 AS p, '' AS audit, CAST([] AS VARCHAR[]) AS out FROM z
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, n, CASE edit WHEN 'D' THEN p WHEN 'K' THEN kept ELSE added END, audit || edit,
         CASE edit WHEN 'D' THEN out WHEN 'K' THEN list_append(out, role || ':' || text) ELSE list_append(out, CASE WHEN added = 3 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.conv_id, w.i, w.n, w.p, w.audit, w.out, s.role, s.text, CASE s.r WHEN 's' THEN 2 WHEN 'u' THEN 3 WHEN 'a' THEN 4 ELSE 0 END AS kept, CASE WHEN p = 3 THEN 4 ELSE 3 END AS added,
      CASE WHEN w.i > w.n THEN 'I' WHEN 4 + ahead[p] = g[p] THEN 'D' WHEN 3 + g[CASE WHEN p = 3 THEN 4 ELSE 3 END] = g[p] THEN 'I'
           WHEN s.r = 's' AND p = 1 AND h + ahead[2] = g[p] OR s.r = 'u' AND p <> 3 AND h + ahead[3] = g[p] OR s.r = 'a' AND p = 3 AND h + ahead[4] = g[p] THEN 'K' ELSE 'R' END AS edit
    FROM w LEFT JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.i WHERE w.i <= w.n OR w.p IN (2, 3))
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(g[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT conv_id, g FROM g WHERE i = 1) b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN (SELECT conv_id, audit, out FROM w WHERE i > n AND p IN (1, 4)) r ON a.conv_id IS NOT DISTINCT FROM r.conv_id
"""
