r"""Repair of conversation structure: the cheapest edits that make the roles fit the grammar.

The grammar of role initials is ``(s?(ua)+)?``.  Edits walk a lattice of
(turn index, grammar state) that is never built: Dijkstra's search keeps a heap
of open paths by (cost, audit) and ends at the first accepting end node that it
pops.  An audit is the string of edit initials, and two audits are compared by
the letter below their last common step, found by jump pointers, so a step
costs the logarithm of its depth and no audit is copied.

Edits: (K)eep 0, (R)erole to user or assistant 1, (D)elete 2, (I)nsert an empty
user or assistant turn 5.  Blank rows and repeats of an earlier row (role and
text) must be deleted; a truncated row that stays costs 5 more.

``plan_repairs`` reads roles, flags and digests only.  ``repaired_turns`` and
``repair_digests`` then stream the texts past the audits, a batch at a time.
Conversations are dealt by id; what a task holds of one are some 1,000 bytes a
turn, whatever its texts.  Its audit is one value and must fit in a row.

Rows sort by turn (null first), role, digest of the text.  Null texts and roles
count as one space.  Rows of null conv_id form one conversation.  Repeated rows
stay (and are duplicates).  Very long texts pass through in batches.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy_batches

BLANKS = "\t\n\x0b\x0c\r "
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: the role that may come next in each state, and the state after an initial
WANTED = ("user", "user", "assistant", "user")
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Step:
    """The last edit of an open or settled path, with its lattice node."""

    __slots__ = ("depth", "jump", "letter", "node", "parent")

    def __init__(self, parent: Step | None, letter: str, node: int):
        self.letter, self.node = letter, node
        if parent is None:
            self.parent = self.jump = self
            self.depth = 0
            return
        self.parent, self.depth = parent, parent.depth + 1
        far = parent.jump
        self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def above(self, depth: int) -> Step:
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.parent
        return at

    def __lt__(self, other: Step) -> bool:
        """Whether this audit comes first in ASCII order."""
        depth = min(self.depth, other.depth)
        a, b = self.above(depth), other.above(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.letter < b.letter


def cheapest_edits(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """turns: (role initial, must go, truncated).  The least (cost, audit) by Dijkstra's search."""
    last = 4 * len(turns)
    best: dict[int, int] = {}
    settled: set[int] = set()
    heap = [(0, Step(None, "", START))]
    while True:
        cost, step = heapq.heappop(heap)
        node = step.node
        if node in settled:
            continue
        settled.add(node)
        state = node & 3
        if node >= last and state in (START, ASSISTANT):
            letters = []
            while step.depth:
                letters.append(step.letter)
                step = step.parent
            return cost, "".join(reversed(letters))
        wanted = WANTED[state][0]
        edges = [(INSERT, "I", (node & ~3) + AFTER[wanted])]
        if node < last:
            initial, must_go, truncated = turns[node >> 2]
            after = (node & ~3) + 4
            edges.append((DELETE, "D", after + state))
            if not must_go:
                stays = TRUNCATED if truncated else 0
                if initial == wanted or (initial == "s" and state == START):
                    edges.append((KEEP + stays, "K", after + AFTER[initial]))
                if initial != wanted:
                    edges.append((REROLE + stays, "R", after + AFTER[wanted]))
        for price, letter, to in edges:
            total = cost + price
            if to not in settled and total <= best.get(to, total):
                best[to] = total
                heapq.heappush(heap, (total, Step(step, letter, to)))


def _plan(rows) -> tuple:
    """PLAN of one conversation from its ordered (turn, role, digest, blank, open_end)."""
    seen: set = set()
    turns, counts, illegal = [], [0, 0, 0], 0
    least = greatest = before = None
    distinct = 0
    for turn, role, digest, blank, open_end in rows:
        if turn is not None:
            distinct += turn != greatest
            least, greatest = turn if least is None else least, turn
        again = (role, digest) in seen
        seen.add((role, digest))
        if blank or again or open_end:
            counts[0 if blank else 1 if again else 2] += 1
        illegal += before is not None and before + role[:1] not in LEGAL
        before = role[:1]
        turns.append((before, blank or again, open_end))
    gaps = 0 if least is None else greatest - least + 1 - distinct
    return (gaps, *counts, illegal, *cheapest_edits(turns))


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _together(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _rows(batches):
    return chain.from_iterable(zip(*[c.to_pylist() for c in b.columns], strict=True) for b in batches)


def _in_batches(rows, schema, most: int = 4096, most_bytes: int = 8 << 20):
    """Record batches of ``most`` rows or some ``most_bytes`` of strings."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)}, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)}, schema=schema)


def _schema(turns: DataFrame, rest: str) -> T.StructType:
    found = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType)])
    for field in T._parse_datatype_string(rest):
        found.add(field)
    return found


def _mapped(rows: DataFrame, schema: T.StructType, function) -> DataFrame:
    """``rows`` through a generator of tuples, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    @tidy_batches
    def run(batches):
        yield from _in_batches(function(_rows(batches)), out)

    return rows.mapInArrow(run, schema)


def plan_repairs(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    compact = ordered(turns).select("conv_id", "turn", "role", "digest", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open_end"))

    def plans(rows):
        for conv, group in groupby(rows, key=lambda r: r[0]):
            yield (conv, *_plan(r[1:] for r in group))

    return _mapped(_together(compact, "turn", "role", "digest"), _schema(turns, PLAN), plans)


def _beside(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order: conv_id, turn, role, text, plan."""
    plan = F.struct(*[F.col(f.name) for f in T._parse_datatype_string(PLAN)])
    none = lambda kind: F.lit(None).cast(kind)
    first = plans.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("digest"), plan.alias("plan"))
    then = ordered(turns).withColumn("kind", F.lit(1)).withColumn("plan", F.lit(None).cast(first.schema["plan"].dataType))
    return _together(first.unionByName(then), "kind", "turn", "role", "digest").select("conv_id", "turn", "role", "text", "plan")


def _follow(audit: str, rows):
    """(edit, turn, role, text) of the turns that stay or are new, in order."""
    state = START
    for edit in audit:
        turn, role, text = (None, None, "") if edit == "I" else next(rows)[1:4]
        if edit == "D":
            continue
        role = role if edit == "K" else WANTED[state]
        state = AFTER[role[0]]
        yield edit, turn, role, text


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, place (from 0), edit, turn (of the row; null if inserted), role, text."""
    def follow(rows):
        for conv, group in groupby(rows, key=lambda r: r[0]):
            audit = next(group)[4]["audit"]
            yield from ((conv, place, *found) for place, found in enumerate(_follow(audit, group)))

    return _mapped(_beside(turns, plans), _schema(turns, "place long, edit string, turn long, role string, text string"), follow)


def repair_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with repaired_sha256: the digest of the repaired ``role:text``, joined by line ends."""
    names = [f.name for f in T._parse_datatype_string(PLAN)]

    def digest(rows):
        for conv, group in groupby(rows, key=lambda r: r[0]):
            plan = next(group)[4]
            sha, gap = hashlib.sha256(), ""
            for _, _, role, text in _follow(plan["audit"], group):
                sha.update(f"{gap}{role}:{text}".encode())
                gap = "\n"
            yield (conv, *[plan[n] for n in names], sha.hexdigest())

    return _mapped(_beside(turns, plans), _schema(turns, f"{PLAN}, repaired_sha256 string"), digest)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the faults that their key's crc32 names: conv_id, turn, role, text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    copies: Column = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_chat_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(turns)
    ids, plans = turns.select(F.col("conv_id").alias("id")).distinct(), plan_repairs(rows)
    numbers = [F.coalesce(F.col(f.name), F.lit("" if f.name == "audit" else 0).cast(f.dataType)).alias(f.name) for f in T._parse_datatype_string(PLAN)]
    return repair_digests(rows, ids.join(plans, ids["id"].eqNullSafe(plans["conv_id"]), "left").select(F.col("id").alias("conv_id"), *numbers))


SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS tab),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS fault
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE fault <> 0),
f AS (
  SELECT *, left(role, 1) AS r, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM d),
g AS (
  SELECT *, t = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, right(t, 1) NOT IN ('.', '!', '?') AS cut, lag(r) OVER (PARTITION BY conv_id ORDER BY place) AS prior FROM f),
h AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || r NOT IN ('su', 'ua', 'au')) AS illegal,
         list({'s': NULL::STRUCT(c BIGINT, a VARCHAR)[], 'r': r, 'go': blank OR again, 'x': CASE WHEN cut THEN 5 ELSE 0 END} ORDER BY place) AS steps,
         list({'role': role, 'text': text} ORDER BY place) AS rows
  FROM g GROUP BY conv_id),
e AS (
  SELECT *, list_reduce(steps, lambda p, q: {'r': '', 'go': false, 'x': 0, 's':
    list_transform([list_transform([
      {'c': p.s[1].c + 2, 'a': p.s[1].a || 'D'},
      list_min([{'c': p.s[2].c + 2, 'a': p.s[2].a || 'D'}, {'c': p.s[1].c + q.x + CASE WHEN q.go OR q.r <> 's' THEN 1000000 ELSE 0 END, 'a': p.s[1].a || 'K'}]),
      list_min([{'c': p.s[3].c + 2, 'a': p.s[3].a || 'D'},
                list_min(list_transform([p.s[1], p.s[2], p.s[4]], lambda z: {'c': z.c + q.x + CASE WHEN q.go THEN 1000000 WHEN q.r = 'u' THEN 0 ELSE 1 END, 'a': z.a || CASE WHEN q.r = 'u' THEN 'K' ELSE 'R' END}))]),
      list_min([{'c': p.s[4].c + 2, 'a': p.s[4].a || 'D'},
                {'c': p.s[3].c + q.x + CASE WHEN q.go THEN 1000000 WHEN q.r = 'a' THEN 0 ELSE 1 END, 'a': p.s[3].a || CASE WHEN q.r = 'a' THEN 'K' ELSE 'R' END}])], lambda z: z)],
    lambda n: list_transform([list_min([n[3], list_min(list_transform([n[1], n[2], n[4]], lambda z: {'c': z.c + 5, 'a': z.a || 'I'}))])],
      lambda u: [n[1], n[2], u, list_min([n[4], {'c': u.c + 5, 'a': u.a || 'I'}])])[1])[1]},
    {'s': [{'c': 0::BIGINT, 'a': ''}, {'c': 1000000::BIGINT, 'a': ''}, {'c': 5::BIGINT, 'a': 'I'}, {'c': 10::BIGINT, 'a': 'II'}], 'r': '', 'go': false, 'x': 0}).s AS ends
  FROM h),
b AS (SELECT *, list_min([ends[1], ends[4]]) AS z FROM e),
m AS (
  SELECT *, list_reduce(list_transform(string_split(z.a, ''), lambda c: {'e': c, 'i': 0::BIGINT, 'u': false, 'o': NULL::VARCHAR}),
    lambda p, q: {'e': '', 'i': p.i + CASE WHEN q.e = 'I' THEN 0 ELSE 1 END,
      'u': CASE WHEN q.e = 'D' THEN p.u WHEN q.e = 'K' THEN left(rows[p.i + 1].role, 1) = 'u' ELSE NOT p.u END,
      'o': CASE WHEN q.e = 'D' THEN p.o ELSE coalesce(p.o || chr(10), '')
             || CASE WHEN q.e = 'K' THEN rows[p.i + 1].role WHEN p.u THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN q.e = 'I' THEN '' ELSE rows[p.i + 1].text END END},
    {'e': '', 'i': 0::BIGINT, 'u': false, 'o': NULL::VARCHAR}).o AS whole
  FROM b)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON c.conv_id IS NOT DISTINCT FROM m.conv_id
"""
