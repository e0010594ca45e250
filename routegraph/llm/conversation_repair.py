"""Conversation structure repair: the cheapest edits that give a legal order of roles.

A conversation is legal when the initials of its roles match ``(s?(ua)+)?``. Its rows are
kept (0), reroled (2) or deleted (3), and empty rows inserted (2). Every choice is decided
by one integer minimum over a DAG of (gap, state of the role automaton): the weight of a
path is a big integer whose high digits are its cost and whose low digits, one octal digit
for each letter of the audit with zeros behind the last, spell its letters in order. So the
least integer is the cheapest path, and of equally cheap ones that with the ASCII-least
audit. The minimum runs from the last gap to the first; an edit puts its letter in front.

Conversations of up to ``long_rows`` rows and ``long_bytes`` bytes are whole in one task,
which streams over sorted rows. Longer ones are range-sorted and cut into blocks: each block
gives the least weight from every state to every state (equal rows are counted before), and
the blocks of a conversation are composed in order. Two paths of equal cost through a block
from one state to another never continue each other (the longer one would hold paid
inserts), so the composition is exact. Texts of a long conversation meet only as a stream,
for its hash; what is held of it is a multiple of its audit, which its result row holds too.

Defined results: nulls in role and text are one space; rows are ordered by turn (nulls
first), role and text; a null key is a conversation of its own; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import CRC32_ENTRIES, crc32_sql
from routegraph.llm.packed import rows_of
from routegraph.operators.lineage import RoundTables, row_count

SPACES = " \t\n\x0b\x0c\r"
#: States of the role automaton and what a role's initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state behind an inserted or reroled row: what may stand next is one role everywhere.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
LEGAL = frozenset({"su", "ua", "au"})
#: Letters by their digit, in ASCII order; 0 pads the end.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LONG_ROWS, LONG_BYTES = 4096, 32 << 20


# ---- weights -----------------------------------------------------------------------------


def before(value: int | None, letter: int, width: int, extra: int = 0, times: int = 1) -> int | None:
    """The weight of a path with ``times`` edits in front of one of weight ``value``."""
    if value is None or not times:
        return value
    bits = 3 * width
    run = letter * ((1 << 3 * times) - 1) // 7
    cost = (value >> bits) + COST[letter] * times + extra
    return cost << bits | run << (bits - 3 * times) | (value & ((1 << bits) - 1)) >> 3 * times


def least(*values: int | None) -> int | None:
    return min((v for v in values if v is not None), default=None)


def gap(after: list, width: int) -> list:
    """Up to two inserts: a third would come back to a state that was there for nothing."""
    once = [least(v, before(after[NEXT[q]], INSERT, width)) for q, v in enumerate(after)]
    return [least(v, before(once[NEXT[q]], INSERT, width)) for q, v in enumerate(after)]


def row(after: list, initial: str, fault: int, copies: int, width: int) -> list:
    """Weights in front of a row that stands ``copies`` times; all but the first must go."""
    if copies > 1:
        after = [before(v, DELETE, width, times=copies - 1) for v in after]
    gone = [before(v, DELETE, width) for v in after]
    if fault in (BLANK, DUPLICATE):
        return gone
    extra = int(fault == TRUNCATED)
    out = []
    for q in range(4):
        kept = STEP[q].get(initial)
        out.append(
            least(
                gone[q],
                None if kept is None else before(after[kept], KEEP, width, extra),
                before(after[NEXT[q]], REROLE, width, extra),
            )
        )
    return out


Item = tuple[str, int, int]


def width_of(items: list[Item]) -> int:
    return sum(n for *_, n in items) + 2 * len(items) + 2


def solve(items: list[Item], after: list, width: int) -> list:
    for item in reversed(items):
        after = gap(row(after, *item, width), width)
    return after


def spelled(value: int, width: int) -> tuple[int, str]:
    """(cost, letters) of a weight."""
    low = value & ((1 << 3 * width) - 1)
    return value >> 3 * width, f"{low:0{width}o}".rstrip("0").translate({ord(str(i)): c for i, c in enumerate(LETTERS) if i})


def ended(width: int) -> list:
    """Weights of the last gap."""
    return gap([0 if q in ACCEPTED else None for q in range(4)], width)


def best(items: list[Item]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    width = width_of(items)
    return spelled(solve(items, ended(width), width)[START], width)


def between(items: list[Item]) -> list[list[tuple[int, str] | None]]:
    """[from state][to state]: (cost, letters) of the least path through a block's rows."""
    width = width_of(items)
    columns = [solve(items, [0 if q == end else None for q in range(4)], width) for end in range(4)]
    return [[None if c[q] is None else spelled(c[q], width) for c in columns] for q in range(4)]


def as_digits(letters: str) -> int:
    return int("0" + "".join(str(LETTERS.index(c)) for c in letters), 8)


def joined(blocks: Iterable[list[list[tuple[int, str] | None]]]) -> tuple[int, list[str]]:
    """(cost, letters of each block) of a conversation cut into blocks."""
    # by state: (cost, letters so far as a number, how many); ways: by block and state, whence
    at: list[tuple[int, int, int] | None] = [(0, 0, 0), None, None, None]
    ways: list[list[tuple[int, str] | None]] = []

    def extended(part: list[list[tuple[int, str] | None]]) -> None:
        found = []
        for end in range(4):
            ends = []
            for q, so_far in enumerate(at):
                if so_far is not None and part[q][end] is not None:
                    cost, letters = part[q][end]
                    ends.append((so_far[0] + cost, so_far[1] << 3 * len(letters) | as_digits(letters), so_far[2] + len(letters), q, letters))
            width = max((e[2] for e in ends), default=0)
            found.append(min(ends, key=lambda e: e[0] << 3 * width | e[1] << 3 * (width - e[2]), default=None))
        at[:] = [None if e is None else e[:3] for e in found]
        ways.append([None if e is None else e[3:] for e in found])

    for part in blocks:
        extended(part)
    last = [None if v is None else spelled(v, 2) for v in ended(2)]
    extended([[v, None, None, None] for v in last])
    out, q = [], START
    for way in reversed(ways):
        q, letters = way[q]
        out.append(letters)
    out.reverse()
    tail = out.pop()
    if out:
        out[-1] += tail
    return at[START][0], out


# ---- rows --------------------------------------------------------------------------------


def fault_of(text: str, seen: bool) -> int:
    body = text.rstrip(SPACES)
    if not body:
        return BLANK
    return DUPLICATE if seen else NONE if body[-1] in ".!?" else TRUNCATED


class Lines:
    """Hash of repaired lines as they come."""

    def __init__(self) -> None:
        self.state, self.sha, self.first = START, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def edit(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "K":
            self.state = STEP[self.state][role[:1]]
            self._line(role, text)
        elif letter != "D":
            self.state = NEXT[self.state]
            self._line(NAMES[self.state], text if letter == "R" else "")

    def edits(self, letters: str, rows: Iterator[tuple[str, str]]) -> None:
        for letter in letters:
            self.edit(letter, *(() if letter == "I" else next(rows)))


def counted(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def repaired(rows: list[tuple]) -> tuple:
    """Result columns of one conversation from its ordered (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = best([(i, f, 1) for i, f in zip(initials, faults, strict=True)])
    lines = Lines()
    lines.edits(audit, ((r, t) for _, r, t in rows))
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return (
        counted(t for t, *_ in rows), *(faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), illegal,
        cost, audit, lines.sha.hexdigest(),
    )


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_COUNTS = [(c, pa.int64()) for c in RESULT[:6]]


def _streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(key values, iterator of the other values) for every run of equal first ``keys`` columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, (r[keys:] for r in group)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield rows_of(held, schema)
            held = []
    yield rows_of(held, schema)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _short(rows: DataFrame) -> DataFrame:
    kind = rows.schema["_conv"].dataType.simpleString()
    schema = pa.schema([("_conv", _arrow(rows, "_conv")), *_COUNTS, ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (*key, *repaired([r[:3] for r in group for _ in range(r[3])])) for key, group in _streamed(batches, 1)
        )
        return _batches(found, schema)

    ordered = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    return ordered.select("_conv", "_turn", "_role", "_text", "_copies").mapInArrow(
        stream, f"_conv {kind}, " + ", ".join(f"{c} long" for c in RESULT[:6]) + ", audit string, repaired_sha256 string"
    )


# ---- long conversations ------------------------------------------------------------------

_PART = pa.schema(
    [("_block", pa.int64()), ("_costs", pa.list_(pa.int64())), ("_letters", pa.list_(pa.string())), ("_firsts", pa.string()),
     ("_lasts", pa.string()), ("_illegal", pa.int64())]
)
_PART_DDL = "_block long, _costs array<long>, _letters array<string>, _firsts string, _lasts string, _illegal long"


def _long(rows: DataFrame, t: RoundTables, block_rows: int) -> DataFrame:
    """Rows of long conversations, in blocks of up to ``block_rows`` different rows."""
    kind, arrow = rows.schema["_conv"].dataType.simpleString(), _arrow(rows, "_conv")
    order = ["_conv", "_turn", "_role", "_text"]
    counts = rows.filter("_copies > 0").groupBy(*order).agg(F.sum("_copies").alias("_copies"))
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id())
    table, m = t.write(ranged, "ranged", row_count())
    body = F.rtrim(F.col("_text"), F.lit(SPACES))
    end = F.right(body, F.lit(1))
    thin = table.select(
        "_conv", "_turn", "_at", F.floor(F.col("_at") / block_rows).alias("_block"), "_copies",
        F.left("_role", F.lit(1)).alias("_initial"), (body == "").alias("_blank"), end.isin(".", "!", "?").alias("_whole"),
        F.sha2(F.concat_ws("\0", F.length("_role").cast("string"), "_role", "_text"), 256).alias("_same"),
    )
    thin, _ = t.write(thin, "thin", row_count())
    again = thin.groupBy("_conv", "_same").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = again.select(F.col("_conv").alias("_c"), F.col("_same").alias("_s"), "_first")
    told = thin.join(again, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_same") == F.col("_s")), "left")
    fault = (
        F.when(F.col("_blank"), BLANK).when(F.col("_first") < F.col("_at"), DUPLICATE)
        .when(F.col("_whole"), NONE).otherwise(TRUNCATED).alias("_fault")
    )
    told, _ = t.write(told.select("_conv", "_turn", "_at", "_block", "_copies", "_initial", fault), "faults", row_count())

    copies, extra = F.col("_copies"), F.col("_copies") - 1
    sums = told.groupBy("_conv").agg(
        F.max("_turn").alias("_high"), F.min("_turn").alias("_low"), F.count_distinct("_turn").alias("_turns"),
        F.sum(F.when(F.col("_fault") == BLANK, copies).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("_fault") == BLANK, 0).when(F.col("_fault") == DUPLICATE, copies).otherwise(extra)).alias("duplicate"),
        F.sum(F.when(F.col("_fault") == TRUNCATED, 1).otherwise(0)).alias("truncated"),
    )

    part_schema = pa.schema([("_conv", arrow), *_PART])

    def block(table: pa.Table) -> pa.Table:
        cols = ("_conv", "_at", "_block", "_initial", "_fault", "_copies")
        entries = sorted(zip(*(table.column(c).to_pylist() for c in cols), strict=True), key=lambda r: r[1])
        out = []
        for conv, group in groupby(entries, key=lambda r: r[0]):
            group = list(group)
            parts = [p for r in between([(i, f, n) for *_, i, f, n in group]) for p in r]
            pairs = [a[3] + b[3] not in LEGAL for a, b in zip(group, group[1:], strict=False)]
            repeats = sum((n - 1) for *_, n in group)  # a role never stands legally beside itself
            out.append(
                (conv, group[0][2], [p and p[0] for p in parts], [p and p[1] for p in parts], group[0][3], group[-1][3], sum(pairs) + repeats)
            )
        return pa.Table.from_batches([rows_of(out, part_schema)], schema=part_schema)

    parts = told.groupBy("_block").applyInArrow(block, f"_conv {kind}, {_PART_DDL}")
    chosen_schema = pa.schema(
        [("_conv", arrow), ("_block", pa.int64()), ("_letters", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
    )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for key, group in _streamed(batches, 1):
                numbers, matrices, illegal, last = [], [], 0, None
                for number, costs, letters, first, end, inside in group:
                    numbers.append(number)
                    cells = [None if c is None else (c, x) for c, x in zip(costs, letters, strict=True)]
                    matrices.append([cells[4 * q : 4 * q + 4] for q in range(4)])
                    illegal += inside + (last is not None and last + first not in LEGAL)
                    last = end
                cost, letters = joined(matrices)
                yield (*key, None, None, illegal, cost, "".join(letters))
                for number, part in zip(numbers, letters, strict=True):
                    yield (*key, number, part, None, None, None)

        return _batches(found(), chosen_schema)

    chosen, _ = t.write(
        parts.repartition("_conv").sortWithinPartitions("_conv", "_block").mapInArrow(
            compose, f"_conv {kind}, _block long, _letters string, illegal long, cost long, audit string"
        ),
        "chosen", row_count(),
    )

    edit_schema = pa.schema([("_at", pa.int64()), ("_edits", pa.string())])

    def deal(entries: pa.Table, letters: pa.Table) -> pa.Table:
        """Each row's letters: inserts before it and its own, at the end also those behind."""
        rows = sorted(zip(*(entries.column(c).to_pylist() for c in ("_conv", "_at", "_copies")), strict=True), key=lambda r: r[1])
        of = dict(zip(letters.column("_conv").to_pylist(), letters.column("_letters").to_pylist(), strict=True))
        out = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            text, at, group = of[conv], 0, list(group)
            for _, row_at, n in group:
                end, left = at, n
                while left:
                    left -= text[end] != "I"
                    end += 1
                out.append((row_at, text[at:end]))
                at = end
            out[-1] = (out[-1][0], out[-1][1] + text[at:])
        return pa.Table.from_batches([rows_of(out, edit_schema)], schema=edit_schema)

    own = told.select("_conv", "_at", "_copies", "_block").groupBy("_block")
    dealt = own.cogroup(
        chosen.filter("_block IS NOT NULL").select("_conv", "_letters", F.col("_block").alias("_b")).groupBy("_b")
    ).applyInArrow(deal, "_at long, _edits string")
    hash_schema = pa.schema([("_c", arrow), ("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for key, group in _streamed(batches, 1):
                lines = Lines()
                for _, role, text, edits in group:
                    for letter in edits:
                        lines.edit(letter, *(() if letter == "I" else (role, text)))
                yield (*key, lines.sha.hexdigest())

        return _batches(found(), hash_schema)

    shas = (
        table.select("_conv", "_at", "_role", "_text").join(dealt, "_at").select("_conv", "_at", "_role", "_text", "_edits")
        .repartition("_conv").sortWithinPartitions("_conv", "_at").mapInArrow(hashed, f"_c {kind}, repaired_sha256 string")
    )
    whole = chosen.filter("_block IS NULL").select(F.col("_conv").alias("_k"), "illegal", "cost", "audit")
    gaps = F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0)).cast("long").alias("gaps")
    out = sums.join(whole, F.col("_conv").eqNullSafe(F.col("_k"))).join(shas, F.col("_conv").eqNullSafe(F.col("_c")))
    return out.select("_conv", gaps, *[F.col(c) for c in RESULT[1:]])


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: str | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``copies`` names a column of how often a row stands (0: its conversation is listed only).
    """
    narrow = rows.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_text"),
        (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("_copies"),
    )
    t = RoundTables(rows.sparkSession, "repair")
    try:
        sizes = narrow.groupBy("_conv").agg(
            F.sum("_copies").alias("_n"), F.sum(F.octet_length("_text") * F.least("_copies", F.lit(1))).alias("_bytes")
        )
        large, m = t.write(
            sizes.filter((F.col("_n") > long_rows) | (F.col("_bytes") > long_bytes)).select(F.col("_conv").alias("_large")),
            "large", row_count(),
        )
        if not m["n"]:
            t.drop()
            out = _short(narrow)
        else:
            same = F.col("_conv").eqNullSafe(F.col("_large"))
            out = _short(narrow.join(large, same, "left_anti"))
            out = out.unionByName(_long(narrow.join(large, same, "left_semi"), t, long_rows))
            t.drop_at_exit()
        return out.withColumnRenamed("_conv", conv)
    except BaseException:
        t.drop()
        raise


# ---- query -------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the damage that the check sum of their key and turn names."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    text = F.coalesce("text", space)
    narrow = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_h"))
    h = F.col("_h")
    return narrow.select(
        "conv_id", "turn",
        F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("_stands"),
    )


def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations), copies="_stands")


def _fold() -> str:
    """DuckDB text: one row ``x`` {t: initial, f: fault} put in front of ``acc``, which holds the
    cheapest (cost, letters) from each state of the role automaton on."""

    def cell(cost: str, letters: str, rest: str) -> str:
        return f"{{'c': {rest}.c + {cost}, 'a': '{letters}' || {rest}.a}}"

    def front(state: int, cost: int, letters: str) -> list[str]:
        """Candidates for the row itself, after inserts of this cost and these letters."""
        kept = " ".join(
            f"WHEN x.f IN (0, 3) AND x.t = '{initial}' THEN " + cell(f"{cost} + (x.f = 3)::INT", letters + "K", f"acc.q{to}")
            for initial, to in STEP[state].items()
        )
        far = f"{{'c': 1000000000, 'a': ''}}"
        return [
            cell(f"{cost + 3}", letters + "D", f"acc.q{state}"),
            f"CASE {kept} ELSE {far} END",
            f"CASE WHEN x.f IN (0, 3) THEN {cell(f'{cost + 2} + (x.f = 3)::INT', letters + 'R', f'acc.q{NEXT[state]}')} ELSE {far} END",
        ]

    def best_of(state: int) -> str:
        one = NEXT[state]
        return f"list_sort([{', '.join(front(state, 0, '') + front(one, 2, 'I') + front(NEXT[one], 4, 'II'))}])[1]"

    return "{" + ", ".join(f"'q{q}': {best_of(q)}" for q in range(4)) + "}"


_LAST = "{'q0': {'c': 0, 'a': ''}, 'q1': {'c': 4, 'a': 'II'}, 'q2': {'c': 2, 'a': 'I'}, 'q3': {'c': 0, 'a': ''}}"

OP11_SQL = rf"""
WITH crc AS (SELECT {CRC32_ENTRIES} AS entries),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), hashed AS (SELECT *, {crc32_sql("name")} % 20 AS h FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed
), numbered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM numbered
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 0 ELSE 3 END AS f,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'t': left(role, 1), 'f': f}} ORDER BY i DESC) AS items
  FROM faulty GROUP BY conv_id
), solved AS (
  SELECT * EXCLUDE (items), list_reduce(items, lambda acc, x: {_fold()}, {_LAST}).q0 AS best FROM sums
), letters AS (
  SELECT conv_id, k, best.a[k] AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS k FROM solved)
), told AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER upto AS i, count(*) FILTER (letter <> 'D') OVER upto AS o
  FROM letters WINDOW upto AS (PARTITION BY conv_id ORDER BY k)
), lines AS (
  SELECT t.conv_id, t.o, t.letter, r.role, r.text,
    max((t.o = 1 AND t.letter = 'K' AND left(r.role, 1) = 's')::INT) OVER (PARTITION BY t.conv_id) AS led
  FROM told t LEFT JOIN placed r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i AND t.letter <> 'I'
  WHERE t.letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
    chr(10) ORDER BY o) AS body
  FROM lines GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
