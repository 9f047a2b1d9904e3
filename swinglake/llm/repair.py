"""Repair of conversations: the cheapest edits that bring the roles of the turns into order, by Dial's shortest paths.

A conversation is a graph of layers, one before each row and one behind the last, with a node for each state of the
role pattern ``(s?(ua)+)?``. Arcs keep, re-role or delete a row (to the next layer) or insert one (inside a layer);
their costs are small integers, so that a queue of buckets settles the nodes in order of distance from the end (Dial).
The walk from the start takes, of the arcs that lie on a cheapest path, the one with the least initial: a state admits one
row by keeping, one by re-roling and one by inserting, so that the walk is the ASCII-least audit among the cheapest.

Rows are dealt by ranges of (conversation, turn), so a conversation as large as a third of the table is sorted by many
tasks. A task streams its sorted rows, holds one block (``BLOCK_ROWS`` rows or ``BLOCK_CHARS`` characters) at a time and
solves a conversation that lies in one block at once. A longer one, or one at the edge of a task, becomes a row for each
block with the cheapest costs from each entry state to each exit state; a second pass over these sums (no texts) goes back
through the blocks and gives each the distances behind it, a third goes forward through the blocks with their texts,
carrying the state, the counts and the digest. That digest is of the whole repaired conversation, in order: it, and the
audit, are what one task must follow for one conversation, block by block.

Defined results: null role or text is one space, as null id or turn is in the damage's key; rows of one turn are in order of role
and text, null turns first; null conversation ids are one conversation; rows that are equal throughout are duplicates of
each other; a role is known by its first character; an empty table gives an empty result; further columns are not read.
Equality of role and text is that of a 128-bit hash where rows lie in different turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import table, written

BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 20
#: Costs of the edits.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States of the role pattern: nothing yet, after system, after user, after assistant; and where a role leads.
STATES = range(4)
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The states before a role, by role and state after it.
BEFORE = {(role, after): [s for s in STATES if STEP[s].get(role) == after] for role in "sua" for after in STATES}
#: The user or assistant turn that a state admits, and where it leads.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
FAR = 1 << 60
#: The distance behind a conversation's end: only the empty one and one that ends with the assistant are in order.
END = (0, FAR, FAR, 0)
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
SPACES = " \t\n\x0b\x0c\r"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLOCK = "part int, no long, turns array<long>, roles array<string>, texts array<string>, faults array<int>, costs array<long>"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the damage by the key's crc32 modulo 20. A dropped row stays as a mark without texts."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    return (
        rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("way"))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("way") == 4, "user").when(F.col("way") != 0, F.col("role")).alias("role"),
            F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("way") != 0, F.col("text")).alias("text"),
            (F.col("way") == 0).alias("gone"),
            F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """The rows with ``again``: 1 if an earlier turn of the conversation has the role and text, 2 if the same turn may have them."""
    one = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.md5(F.coalesce("role", F.lit(""))), F.coalesce("text", F.col("turn").cast("string")))
    keyed = rows.withColumn("key", F.unhex(F.md5(one)))
    turn = F.struct(F.col("turn").isNotNull().alias("late"), "turn")
    several = keyed.where("NOT gone").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("first")).where("n > 1").drop("n")
    same = F.col("first.late").eqNullSafe(F.col("turn").isNotNull()) & F.col("first.turn").eqNullSafe(F.col("turn"))
    return keyed.join(several, "key", "left").withColumn("again", F.when(F.col("first").isNull(), 0).when(same, 2).otherwise(1)).drop("key", "first")


def distances(roles: list[str], faults: list[int], behind: tuple[int, ...] | list[int]) -> list[int]:
    """The cost from each node (4 * layer + state) to the end, where ``behind`` holds the cost from the last layer's states.

    Dial: bucket d holds the nodes that may lie at distance d; buckets are emptied in order, so a node taken from one for
    the first time is settled.
    """
    n = len(roles)
    dist = [FAR] * (4 * n + 4)
    low = min(behind)
    if low >= FAR:
        return dist
    buckets: list[list[int]] = [[]]

    def reach(node: int, d: int) -> None:
        if d < dist[node]:
            dist[node] = d
            while len(buckets) <= d - low:
                buckets.append([])
            buckets[d - low].append(node)

    for s in STATES:
        if behind[s] < FAR:
            reach(4 * n + s, behind[s])
    at = 0
    while at < len(buckets):
        d = low + at
        for node in buckets[at]:  # arcs of cost 0 add to the bucket in hand
            if dist[node] != d:
                continue
            layer, s = divmod(node, 4)
            for role in "ua":
                for t in BEFORE[role, s]:
                    reach(4 * layer + t, d + INSERT)
            if layer:
                fault, back = faults[layer - 1], node - 4 - s
                reach(back + s, d + DELETE)
                if fault not in (BLANK, DUPLICATE):
                    more = d + (TRUNCATED if fault == CUT_OFF else 0)
                    for t in BEFORE.get((roles[layer - 1][:1], s), ()):
                        reach(back + t, more)
                    for role in "ua":
                        for t in BEFORE[role, s]:
                            reach(back + t, more + REROLE)
        buckets[at] = []
        at += 1
    return dist


def block_costs(roles: list[str], faults: list[int]) -> list[int]:
    """The cheapest cost from each entry state to each exit state, entry by entry."""
    to = [distances(roles, faults, [0 if s == x else FAR for s in STATES])[:4] for x in STATES]
    return [to[x][e] for e in STATES for x in STATES]


class Conversation:
    """What has been read of a conversation: its faults, and its repair so far. Holds no rows but the audit it returns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost = conv_id, 0, 0
        self.counts = [0, 0, 0, 0]
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None
        self.last_initial: str | None = None
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def read(self, turns: list[int | None], roles: list[str], texts: list[str], faults: list[int], behind: tuple[int, ...] | list[int], last: bool) -> None:
        """Go through the next block, with the costs ``behind`` it. The last one is followed to the pattern's end."""
        for turn, role, fault in zip(turns, roles, faults, strict=True):
            self.counts[fault] += 1
            if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_initial = role[:1]
            if turn is not None and turn != self.high:  # turns ascend
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
        dist, n, layer, s = distances(roles, faults, behind), len(roles), 0, self.state
        edits = []
        while layer < n or (last and dist[4 * layer + s]):
            d = dist[4 * layer + s]
            role, after = NEXT[s]
            if layer < n and dist[4 * layer + 4 + s] + DELETE == d:
                edits.append("D")
                self.cost += DELETE
                layer += 1
                continue
            if dist[4 * layer + after] + INSERT == d:
                edits.append("I")
                self.cost += INSERT
                self.add(role, "")
                s = after
                continue
            more = TRUNCATED if faults[layer] == CUT_OFF else 0
            kept = STEP[s].get(roles[layer][:1])
            if kept is not None and dist[4 * layer + 4 + kept] + more == d:
                edits.append("K")
                role, after = roles[layer], kept
            else:
                edits.append("R")
                more += REROLE
            self.cost += more
            self.add(role, texts[layer])
            layer, s = layer + 1, after
        self.state = s
        self.audit.append("".join(edits))

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of columns of the types that this module uses."""
    plain = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = plain | {f"array<{k}>": pa.list_(v) for k, v in plain.items()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _flushed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _solve_or_cut(block_rows: int, block_chars: int):
    """A task's sorted rows to results of the conversations that lie in one block, and blocks of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(f"{RESULT}, {BLOCK}")
        width, part = len(RESULT.split(",")), TaskContext.get().partitionId()
        out: list[tuple] = []
        block: list[tuple] = []
        conv, begun, first, cut, no, chars, before = None, False, True, False, 0, 0, None

        def close(whole: bool) -> None:
            nonlocal block, cut, no, chars
            turns, roles, texts, faults = (list(c) for c in zip(*block, strict=True)) if block else ([], [], [], [])
            if whole and not cut:
                solved = Conversation(conv)
                solved.read(turns, roles, texts, faults, END, True)
                out.append((*solved.result(), *[None] * 7))
            else:
                out.append((conv, *[None] * (width - 1), part, no, turns, roles, texts, faults, block_costs(roles, faults)))
                no += 1
            block, cut, chars = [], True, 0

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "again")]
            for conv_id, turn, role, text, gone, again in zip(*columns, strict=True):
                if not begun or conv_id != conv:
                    if begun:
                        close(not first)
                        first = False
                    conv, begun, cut, before = conv_id, True, False, None
                if gone:
                    continue
                stripped = text.rstrip(SPACES)
                if not stripped:
                    fault = BLANK
                elif again == 1 or again == 2 and before == (turn, role, text):
                    fault = DUPLICATE
                else:
                    fault = FINE if stripped[-1] in ".!?" else CUT_OFF
                if len(block) >= block_rows or chars + len(text) > block_chars and block:
                    close(False)
                before = (turn, role, text)
                block.append((turn, role, text, fault))
                chars += len(text)
            if len(out) >= 256:
                yield _flushed(out, schema)
                out = []
        if begun:
            close(False)  # the next task may go on with it
        yield _flushed(out, schema)

    return run


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks, the last of a conversation first, to the costs behind each."""
    schema = arrow_schema("part int, no long, behind array<long>, last boolean")
    begun, conv, behind = False, None, list(END)
    for batch in batches:
        out = []
        for conv_id, part, no, costs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            last = not begun or conv_id != conv
            if last:
                begun, conv, behind = True, conv_id, list(END)
            out.append((part, no, behind, last))
            behind = [min(FAR, *(costs[4 * e + x] + behind[x] for x in STATES)) for e in STATES]
        yield _flushed(out, schema)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, with the costs behind them, to results."""
    schema = arrow_schema(RESULT)
    read: Conversation | None = None
    for batch in batches:
        out = []
        for i in range(batch.num_rows):  # one block's texts at a time
            conv_id, turns, roles, texts, faults, behind, last = (batch.column(c)[i].as_py() for c in range(7))
            read = read or Conversation(conv_id)
            read.read(turns, roles, texts, faults, behind, last)
            if last:
                out.append(read.result())
                read = None
        yield _flushed(out, schema)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a conversation of damaged rows (conv_id, turn, role, text, gone): counts of faults, cost, audit, digest."""
    ready = with_repeats(rows).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = written(ready.mapInArrow(_solve_or_cut(block_rows, block_chars), f"{RESULT}, {BLOCK}"), "repair-blocks")
    blocks = cut.where("part IS NOT NULL")
    sums = blocks.select("conv_id", "part", "no", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no"))
    behind = sums.mapInArrow(_behind, "part int, no long, behind array<long>, last boolean")
    in_order = (
        blocks.join(behind, ["part", "no"])
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "no")
        .select("conv_id", "turns", "roles", "texts", "faults", "behind", "last")
    )
    whole = cut.where("part IS NULL").select(*[c.split()[0] for c in RESULT.split(", ")])
    return whole.unionByName(in_order.mapInArrow(_forward, RESULT))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: The damage's key, its crc32 bit by bit, the rows in order with their faults, then a row at a time: of all ways to each state the
#: cheapest, of those the ASCII-least. Two inserts running are the most that a cheapest path has between rows.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)) AS crc
    FROM conversations
), ways AS (
    SELECT conv_id, turn, role, text, xor(crc, 4294967295::BIGINT) % 20 AS way FROM keyed
), live AS (
    SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
           CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN way = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM ways WHERE way <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
    FROM live
), marked AS (
    SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b,
           CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2
                WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault
    FROM placed
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
), inserts(a, b, edits, cost, extra) AS (
    VALUES (0, 0, '', 0, ''), (0, 2, 'I', 5, chr(10) || 'user:'), (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
           (1, 1, '', 0, ''), (1, 2, 'I', 5, chr(10) || 'user:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
           (2, 2, '', 0, ''), (2, 3, 'I', 5, chr(10) || 'assistant:'), (3, 3, '', 0, ''), (3, 2, 'I', 5, chr(10) || 'user:')
), moves(a, c, b) AS (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), steps AS (
    SELECT m.conv_id, m.i, e.a, e.b, e.edit, e.cost + CASE WHEN fault = 3 AND edit <> 'D' THEN 5 ELSE 0 END AS cost,
           CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE e.b WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || text END AS extra
    FROM marked m JOIN (
        SELECT a, b, c, 'K' AS edit, 0 AS cost FROM moves
        UNION ALL SELECT a, b, NULL, 'R', 1 FROM moves WHERE c <> 's'
        UNION ALL SELECT a, a, NULL, 'D', 2 FROM range(4) t(a)
    ) e ON e.edit = 'D' OR fault NOT IN (1, 2) AND (e.c IS NULL OR e.c = m.c)
), ways_on AS (
    SELECT s.conv_id, s.i, n.a, s.b, n.edits || s.edit AS edits, n.cost + s.cost AS cost, n.extra || s.extra AS extra FROM steps s JOIN inserts n ON n.b = s.a
), best(conv_id, i, state, cost, audit, repaired) AS (
    SELECT conv_id, 0::BIGINT, 0, 0, '', '' FROM ids
    UNION ALL
    SELECT conv_id, i, state, best.cost, best.audit, best.repaired FROM (
        SELECT p.conv_id, w.i, w.b AS state, min({'cost': p.cost + w.cost, 'audit': p.audit || w.edits, 'repaired': p.repaired || w.extra}) AS best
        FROM best p JOIN ways_on w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 AND w.a = p.state
        GROUP BY p.conv_id, w.i, w.b
    )
), sums AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
           count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
), done AS (
    SELECT p.conv_id, min({'cost': p.cost + n.cost, 'audit': p.audit || n.edits, 'repaired': p.repaired || n.extra}) AS best
    FROM best p JOIN inserts n ON n.a = p.state AND n.b IN (0, 3) LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM p.conv_id
    WHERE p.i = coalesce(s.n, 0) GROUP BY p.conv_id
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(substr(best.repaired, 2)) AS repaired_sha256
FROM done d LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id
"""
