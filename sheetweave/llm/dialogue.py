"""Conversations brought into the form system?, (user, assistant)+ at the least cost.

What is left to pay from a turn on depends on the turns behind it and on four states of the grammar only, so a backward
pass over a conversation's turns gives the cost-to-go of every (turn, state). A forward walk then takes, among the
edits that keep to it, the one whose initial comes first in ASCII, so the audit is the least of all cheapest ones, and
the turns are rebuilt by replaying the audit.

Costs-to-go differ by a few units between states, so few different steps exist; they are computed once and a turn
remembers the number of its step, two bytes. Texts never wait in memory: audits are found from one byte a turn, then the
turns stream by in order a second time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.llm.shared import column, give_back, shelve

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, behind a system turn, behind a user's, behind an assistant's. NEXT: where the role that fits leads; END: to pay at the end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
END = (0, 2 * INSERT, INSERT, 0)
#: Of a turn: its role's initial (place in "sua", 3 for others), and whether it is truncated or has to go.
CUT, GONE = 4, 8
#: Conversations whose results are handed on at a time.
ROWS = 1_000


def fits(state: int) -> str:
    """The role that a turn at a state is given by Rerole or Insert."""
    return "assistant" if state == USER else "user"


def kept_to(state: int, initial: int) -> int | None:
    """The state behind a turn that is kept, if the grammar lets it stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if initial in (1, 2) and fits(state)[0] == "sua"[initial] else None


@functools.cache
def _step(code: int, behind: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """One turn before costs-to-go `behind`: (least cost, costs-to-go above it, for each state the edits up to this turn and the state then)."""
    extra = TRUNCATED if code & CUT else 0
    edits = []
    for q in range(4):
        own = {"D": (DELETE + behind[q], q)}
        to = kept_to(q, code & 3)
        if not code & GONE:
            own["R"] = (REROLE + extra + behind[NEXT[q]], NEXT[q])
            if to is not None:
                own["K"] = (extra + behind[to], to)
        edits.append(own)
    cost = [min(c for c, _ in own.values()) for own in edits]
    for _ in range(3):  # no more turns are ever worth inserting at one place
        cost = [min(cost[q], INSERT + cost[NEXT[q]]) for q in range(4)]

    def walk(q: int) -> tuple[str, int]:
        letters = ""
        while True:
            tight = {e: to for e, (c, to) in edits[q].items() if c == cost[q]}
            if cost[q] == INSERT + cost[NEXT[q]]:
                tight["I"] = NEXT[q]
            first = min(tight)
            letters, q = letters + first, tight[first]
            if first != "I":
                return letters, q

    least = min(cost)
    return least, tuple(c - least for c in cost), tuple(walk(q) for q in range(4))


def cheapest(codes: bytes | bytearray) -> tuple[int, str]:
    """(cost, audit) of a conversation given by its turns' codes."""
    steps: dict[tuple[int, tuple[int, ...]], int] = {}
    walks: list[tuple[tuple[str, int], ...]] = []
    taken, behind, total = array("I"), END, 0
    for code in reversed(codes):
        least, above, walk = _step(code, behind)
        number = steps.setdefault((code, behind), len(walks))
        if number == len(walks):
            walks.append(walk)
        taken.append(number)
        behind, total = above, total + least
    total += behind[START]
    q, audit = START, []
    for number in reversed(taken):
        letters, q = walks[number][q]
        audit.append(letters)
    audit.append("I" * (END[q] // INSERT))
    return total, "".join(audit)


def _bare(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACES))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text): turns with the faults that a hash of `conv:turn` deals out. A null role or text is one
    space, and so is a null in the hashed key; a null turn stays null."""
    conv, turn = column(rows, conv_col), column(rows, turn_col)
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))  # noqa: E731
    out = rows.select(
        conv.alias("conv"), turn.cast("long").alias("turn"), spaced(column(rows, role_col)).alias("role"), spaced(column(rows, text_col)).alias("text"),
        (F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20).alias("fate"),
    ).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    out = out.select("conv", "turn", role.alias("role"), text.alias("text"), "fate")
    return out.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("col", "fate")


def judged(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, fault, code): equal rows as one with their number n; faults are those of the first of them.

    Equal rows are counted before anything is shuffled; only then the rows of a conversation meet."""
    once = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = _bare(F.col("text"))
    once = once.repartition("conv").withColumn("again", F.row_number().over(said) > 1)
    fault = F.when(bare == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1
    code = F.when(F.col("role") == "", 3).when(initial < 0, 3).otherwise(initial)
    once = once.withColumn("fault", fault)
    code = code + F.when(F.col("fault") == "truncated", CUT).when(F.col("fault") != "", GONE).otherwise(0)
    return once.select("conv", "turn", "role", "text", "n", "fault", code.alias("code"))


def _in_order(df: DataFrame) -> DataFrame:
    """A conversation's rows in one task and in order, its head (kind 0) first. Spark sorts on disk where it must."""
    order = ("turn", "role", "text") if "role" in df.columns else ("turn",)
    return df.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "kind", *[F.col(c).asc_nulls_first() for c in order])


class _Audit:
    """One conversation read for its audit."""

    def __init__(self) -> None:
        self.codes, self.faults = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.before = -1

    def add(self, turn: int | None, code: int, n: int, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial, pairs = code & 3, ((0, 1), (1, 2), (2, 1))
        self.illegal += (self.before >= 0 and (self.before, initial) not in pairs) + n - 1
        self.before = initial
        self.codes += bytes([code]) + bytes([initial | GONE]) * (n - 1)
        if fault:
            self.faults[fault] += 1
        if n > 1:
            self.faults["blank" if fault == "blank" else "duplicate"] += n - 1

    def row(self) -> list:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return [gaps, *self.faults.values(), self.illegal, *cheapest(self.codes)]


class _Replay:
    """One conversation rebuilt by its audit."""

    def __init__(self, audit: str):
        self.left, self.state = iter(audit), START

    def turns(self, role: str, text: str, n: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what comes out up to these n equal turns."""
        for _ in range(n):
            for edit in self.left:
                fit = fits(self.state)
                if edit == "I":
                    yield edit, fit, ""
                elif edit == "R":
                    yield edit, fit, text
                elif edit == "K":
                    yield edit, role, text
                if edit == "K" and role[0] == "s":
                    self.state = SYSTEM
                elif edit != "D":
                    self.state = NEXT[self.state]
                if edit != "I":
                    break

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.left:
            yield edit, fits(self.state), ""
            self.state = NEXT[self.state]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _batches(rows: Iterator[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches: ROWS at most, fewer where they are large."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == ROWS or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
    give_back()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield from zip(*[c.to_pylist() for c in b.slice(lo, ROWS).columns])


def _peeked(batches: Iterator) -> tuple[pa.RecordBatch | None, Iterator]:
    first = next(batches, None)
    return first, iter(()) if first is None else itertools.chain([first], batches)


def audits(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of convs (conv). turns: of judged()."""
    nothing = [F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "code", "n", "fault", "role", "text")]
    heads = convs.select("conv", F.lit(0).alias("kind"), *nothing)
    both = _in_order(heads.unionByName(turns.select("conv", F.lit(1).alias("kind"), "turn", "code", "n", "fault", "role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batches = _peeked(batches)

        def rows() -> Iterator[list]:
            conv, at = None, None
            for c, kind, turn, code, n, fault in _streamed(batches):
                if kind:
                    at.add(turn, code, n, fault)
                    continue
                if at is not None:
                    yield [conv, *at.row()]
                conv, at = c, _Audit()
            if at is not None:
                yield [conv, *at.row()]

        if first is not None:
            fields = [("conv", first.schema.field(0).type), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string())]
            yield from _batches(rows(), pa.schema(fields))

    types = f"conv {turns.schema['conv'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string"
    return both.select("conv", "kind", "turn", "code", "n", "fault").mapInArrow(run, types)


def _replayed(turns: DataFrame, found: DataFrame, fields: list[tuple[str, pa.DataType, str]], use: Callable[[Any, list, Iterator], Iterator[list]]) -> DataFrame:
    """use(conv, its audits() row, turns of the repaired conversation) -> rows, for one conversation after the other."""
    nothing = [F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "n")]
    heads = found.select("conv", F.lit(0).alias("kind"), *nothing, *_COUNTS, "audit")
    rest = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in (*_COUNTS, "audit")]
    both = _in_order(heads.unionByName(turns.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "n", *rest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batches = _peeked(batches)
        stream = _streamed(batches)
        following: list[tuple] = []

        def repaired(replay: _Replay) -> Iterator[tuple[str, str, str]]:
            for row in stream:
                if not row[1]:
                    following.append(row)
                    break
                yield from replay.turns(*row[2:5])
            yield from replay.rest()

        def rows() -> Iterator[list]:
            following.append(next(stream))
            while following:
                head = following.pop()
                yield from use(head[0], list(head[5:]), repaired(_Replay(head[-1])))

        if first is not None:
            yield from _batches(rows(), pa.schema([("conv", first.schema.field(0).type), *[f[:2] for f in fields]]))

    types = ", ".join(["conv " + turns.schema["conv"].dataType.simpleString(), *[f"{name} {kind}" for name, _, kind in fields]])
    return both.select("conv", "kind", "role", "text", "n", *_COUNTS, "audit").mapInArrow(run, types)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the turns of every repaired conversation, from place 0; edit is K, R or I."""

    def use(conv: Any, head: list, out: Iterator) -> Iterator[list]:
        for place, row in enumerate(out):
            yield [conv, place, *row]

    return _replayed(turns, found, [("place", pa.int64(), "bigint"), *[(c, pa.string(), "string") for c in ("edit", "role", "text")]], use)


def digest(turns: DataFrame, found: DataFrame) -> DataFrame:
    """audits() with repaired_sha256: of the repaired turns as `role:text`, joined by newlines, hashed as they stream by."""

    def use(conv: Any, head: list, out: Iterator) -> Iterator[list]:
        of = hashlib.sha256()
        for place, (_, role, text) in enumerate(out):
            of.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield [conv, *head, of.hexdigest()]

    fields = [*[(c, pa.int64(), "bigint") for c in _COUNTS], *[(c, pa.string(), "string") for c in ("audit", "repaired_sha256")]]
    return _replayed(turns, found, fields, use)


def examine(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with faults and each conversation's audit, for repaired() and digest().

    turns: (conv, turn, role, text), as damage() gives them; convs: (conv), whose repeated rows count once. A conversation
    without turns has an empty audit and costs nothing; a null conv is a conversation; turns are ordered by turn (nulls
    first), then role, then text; equal rows are duplicates of the first; empty texts and texts of white space are blank;
    a role that is none of the three (or empty) can be reroled or deleted; an empty table gives no rows. Texts of any
    length stream by. A conversation of any length is read by one task, as its audit and its hash are one value each,
    which holds one byte and the number of a step a turn; equal rows are one row by then.
    """
    held = shelve(judged(turns))
    return held, audits(held, convs.select("conv").distinct())


def rows_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """examine() of a table of conversations, damaged first."""
    return examine(damage(conversations), conversations.select(column(conversations, "conv_id").alias("conv")))


#: The contract's rows in DuckDB: cheapest ways to each state turn by turn, forward; the least of (cost, audit) at a state stays.
SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
           lambda ch: list_transform(range(8), lambda k: ((ascii(ch) >> k::INTEGER) & 1)::BIGINT))), lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) % 20 AS fate
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, E' 	
') AS bare,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before
  FROM placed
), ends(q, more, said, q2, cost) AS (
  VALUES (0, '', '', 0, 0), (1, '', '', 1, 0), (2, '', '', 2, 0), (3, '', '', 3, 0),
    (0, 'I', E'
user:', 2, 5), (1, 'I', E'
user:', 2, 5), (2, 'I', E'
assistant:', 3, 5), (3, 'I', E'
user:', 2, 5),
    (0, 'II', E'
user:
assistant:', 3, 10), (1, 'II', E'
user:
assistant:', 3, 10)
), walked AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, j.i, o.e.q AS q, w.cost + d.cost + o.e.cost AS cost, w.audit || d.more || o.e.letter AS audit, w.said || d.said || o.e.said AS said
      FROM walked w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ends d ON d.q = w.q,
        LATERAL (SELECT unnest([
          {'letter': 'D', 'q': d.q2, 'cost': 2, 'said': ''},
          {'letter': 'K', 'q': CASE WHEN j.ini = 's' AND d.q2 = 0 THEN 1 WHEN j.ini = 'u' AND d.q2 <> 2 THEN 2 WHEN j.ini = 'a' AND d.q2 = 2 THEN 3 ELSE -1 END,
           'cost': CASE j.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'said': E'
' || j.role || ':' || j.text},
          {'letter': 'R', 'q': CASE d.q2 WHEN 2 THEN 3 ELSE 2 END, 'cost': CASE j.fault WHEN 'truncated' THEN 6 ELSE 1 END,
           'said': CASE d.q2 WHEN 2 THEN E'
assistant:' ELSE E'
user:' END || j.text}]) AS e) o
      WHERE o.e.q >= 0 AND (o.e.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate'))))
  WHERE best = 1
), last AS (
  SELECT conv_id, cost, audit, said FROM (
    SELECT w.conv_id, w.cost + d.cost AS cost, w.audit || d.more AS audit, w.said || d.said AS said, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + d.cost, w.audit || d.more) AS best
    FROM walked w JOIN ends d ON d.q = w.q LEFT JOIN (SELECT conv_id, max(i) AS n FROM judged GROUP BY ALL) c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
    WHERE w.i = coalesce(c.n, 0) AND d.q2 IN (0, 3))
  WHERE best = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY ALL
)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(substr(said, 2)) AS repaired_sha256
FROM last l LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""
