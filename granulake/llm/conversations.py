"""Conversation structure repair by weighted interval parsing.

The rows of a conversation are the terminals, in the order of their turns. The repair grammar is in Chomsky normal form:
its symbol N(p, q) stands for a span whose repaired roles lead the pattern `(s?(ua)+)?` from state p to state q, with rules
N(p, q) -> N(p, r) N(r, q), and terminal rules for the edits of one row (keep, rerole, delete), closed under insertions
before and after it. A cell holds for each symbol of a span its least (cost, audit). As the symbols carry both states,
every way to cut a span gives the same cell, so one cut a span suffices: spans are combined bottom-up by length 1, 2, 4,
... (`span`). Of equal costs no audit is the beginning of another, so the least audit of a span is made of
the least audits of its parts.

On Spark (`repair`): rows that are equal in everything are one row with a number of copies. Rows are range-partitioned
and sorted by conversation, turn, role and text digest, so a conversation of any size spreads over tasks. A task
parses what lies whole inside its range. What touches the edge of a range, or is longer than a block,
leaves it as blocks of at most `block_rows` rows and about `block_bytes` bytes with the cell of each; the cells of a conversation are
folded in order, and a second pass applies the audit to its blocks, one block in memory at a time.

Defined results: NULL role and text read as one space, NULL turns come first and do not count as turns; rows of the same
turn stand in the order of role and text digest; a NULL conv_id is a conversation of its own; a conversation
without rows has zeros, no audit and no text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulake.session import cut, shuffle_partitions

BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20
BLANK = " \t\n\x0b\x0c\r"

# ---- grammar -----------------------------------------------------------------------------------

#: Pattern `(s?(ua)+)?`: state 0 before anything, 1 after s, 2 after u, 3 after a; what each role's initial leads to.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits; a truncated row that is not deleted adds one.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
Cell = dict[tuple[int, int], tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """Cell of a span from the cells of its two parts."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (start, q), (more, rest) in right.items():
            if start == r:
                best = out.get((p, q))
                if best is None or (cost + more, audit + rest) < best:
                    out[p, q] = cost + more, audit + rest
    return out


def _closure() -> Cell:
    """Insertions alone: the cheapest from each state to each other."""
    once: Cell = {(p, p): (0, "") for p in range(4)}
    once |= {(p, q): (INSERT, "I") for (role, p), q in STEPS.items() if role in ROLES}
    while (twice := join(once, once)) != once:
        once = twice
    return once


INSERTED = _closure()


@lru_cache(maxsize=64)
def terminal(kind: str) -> Cell:
    """Cell of one row. `kind`: D for a row that must go, else the role's initial (x: another), upper case if truncated."""
    rules: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "D":
        extra = TRUNCATED if kind.isupper() else 0
        for (role, p), q in STEPS.items():
            if role == kind.lower():
                rules[p, q] = KEEP + extra, "K"
            elif role in ROLES:
                rules[p, q] = REROLE + extra, "R"
    return join(join(INSERTED, rules), INSERTED)


@lru_cache(maxsize=1 << 15)
def _short(kinds: str) -> Cell:
    if len(kinds) == 1:
        return terminal(kinds)
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return join(_short(kinds[:half]), _short(kinds[half:]))


def span(kinds: str) -> Cell:
    """Cell of a span of rows, bottom-up by span length; short spans are remembered."""
    if not kinds:
        return INSERTED
    level = [_short(kinds[i : i + 16]) for i in range(0, len(kinds), 16)]
    while len(level) > 1:
        level = [join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best(cells: Cell) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    return min(cells[0, q] for q in FINAL if (0, q) in cells)


def apply(audit: Iterator[str], rows, state: int) -> Iterator[tuple[str, int]]:
    """(line, state after it) of the repaired text, as `audit` edits the (kind, role, text) rows from `state` on."""
    rows = iter(rows)
    for edit in audit:
        kind, role, text = next(rows) if edit != "I" else ("", "", "")
        if edit == "D":
            continue
        if edit == "K":
            state = STEPS[kind.lower(), state]
        else:
            initial = next(r for r in ROLES if (r, state) in STEPS)
            role, state = ROLES[initial], STEPS[initial, state]
        yield f"{role}:{text}", state


# ---- damage ------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `copies` of the rows after damage; a dropped row has no copies and only its conv_id."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    there = fate != 0
    return rows.select(
        "conv_id",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.when(fate == 4, "user").otherwise(name("role"))).alias("role"),
        F.when(there, text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


# ---- faults ------------------------------------------------------------------------------------


def _judged(rows: DataFrame) -> DataFrame:
    """The different rows with their copies, digest and fault letter: `kind` as in `terminal`, and `fault`."""
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")))
    rows = rows.withColumn("digest", digest)
    # texts that a conversation repeats in a later turn, with the first turn that has them
    again = (
        rows.where("copies > 0").groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same"))
        .agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.bool_or(F.col("turn").isNull()).alias("none"))
        .where("least < most or none and least is not null")
        .select("of", "same", F.expr("if(none, null, least)").alias("first"), F.lit(True).alias("repeated"))
    )
    alike = rows.groupBy("conv_id", "turn", "role", "text", "digest").agg(F.sum("copies").alias("copies"))
    joined = alike.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    body = F.rtrim("text", F.lit(BLANK))
    last, initial = F.right(body, F.lit(1)), F.substring("role", 1, 1)
    later = F.coalesce("repeated", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(body == "", "blank").when(later, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    out = joined.select("conv_id", "turn", "role", "text", "digest", "copies", fault.alias("fault"), initial.alias("initial"), letter.alias("letter"))
    kind = F.expr("case when fault in ('blank', 'duplicate') then 'D' when fault = 'truncated' then upper(letter) else letter end")
    return out.withColumn("kind", kind)


def _copy_kinds(kind: str, copies: int) -> str:
    """Further copies of a row repeat it, so they must go."""
    return kind + "D" * (copies - 1)


NUMBERS = ("rows", "blank", "duplicate", "truncated", "illegal")
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
BLOCKS = (
    "conv_id bigint, part int, block int, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "low bigint, high bigint, turns bigint, last_turn bigint, first_turn bigint, head string, tail string, "
    "cell array<struct<p:int,q:int,cost:bigint,audit:string>>, lines array<struct<kind:string,copies:bigint,role:string,text:string>>, "
    "cost bigint, audit string, repaired_sha256 string"
)
_TYPES = {
    "cell": pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
    "lines": pa.list_(pa.struct([("kind", pa.string()), ("copies", pa.int64()), ("role", pa.string()), ("text", pa.string())])),
    "part": pa.int32(), "block": pa.int32(), "head": pa.string(), "tail": pa.string(), "audit": pa.string(),
    "repaired_sha256": pa.string(),
}
LEGAL = ("su", "ua", "au")


class Stretch:
    """Following rows of a conversation, or (`fold`) following stretches of it: what its result needs."""

    def __init__(self, conv):
        self.conv = conv
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = self.head = self.tail = None

    def _meet(self, head: str) -> None:
        if self.rows:
            self.illegal += self.tail + head not in LEGAL
        else:
            self.head = head

    def _turn(self, turn, count: int, last) -> None:
        """`count` different turns from `turn` to `last` follow."""
        if turn is None:
            return
        self.turns += count - (self.last_turn == turn)
        if self.low is None:
            self.low = self.first_turn = turn
        self.high = self.last_turn = last

    def row(self, turn, fault: str, initial: str, copies: int) -> None:
        self._meet(initial)
        self.illegal += copies - 1
        self._turn(turn, 1, turn)
        self.tail = initial
        self.rows += copies
        self.blank += copies if fault == "blank" else 0
        self.duplicate += 0 if fault == "blank" else copies if fault == "duplicate" else copies - 1
        self.truncated += fault == "truncated"

    def fold(self, other: dict) -> None:
        if other["rows"]:
            self._meet(other["head"])
            self.tail = other["tail"]
            self._turn(other["first_turn"], other["turns"], other["last_turn"])
        for name in NUMBERS:
            setattr(self, name, getattr(self, name) + other[name])

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.low is not None else 0


def _digest(lines: Iterator[str]) -> str:
    out, first = hashlib.sha256(), True
    for line in lines:
        out.update((line if first else "\n" + line).encode())
        first = False
    return out.hexdigest()


def _table(rows: list[dict], schema: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES.get(c, pa.int64())) for c in schema], names=schema)


def _names(ddl: str) -> list[str]:
    """Column names of a schema text whose nested types have no blank after a comma."""
    return [part.split(" ")[0] for part in ddl.split(", ")]


class _Cutter:
    """Cuts the ordered rows of a task into whole conversations and blocks."""

    def __init__(self, part: int, block_rows: int, block_bytes: int):
        self.block_rows, self.block_bytes = block_rows, block_bytes
        self.part, self.first, self.block, self.size = part, True, 0, 0
        self.now: Stretch | None = None
        self.lines: list[tuple] = []
        self.kinds: list[str] = []
        self.out: list[dict] = []

    def row(self, conv, turn, role, text, copies, fault, initial, kind) -> None:
        if self.now is None or conv != self.now.conv:
            self.close(last=False)
            self.now = Stretch(conv)
        if not copies:
            return
        self.now.row(turn, fault, initial, copies)
        self.lines.append((kind, copies, role, text))
        self.kinds.append(_copy_kinds(kind, copies))
        self.size += len(text) + copies
        if len(self.lines) >= self.block_rows or self.size >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        """The rows so far as a block."""
        now = self.now
        cell = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in span("".join(self.kinds)).items()]
        lines = [dict(zip(("kind", "copies", "role", "text"), x)) for x in self.lines]
        numbers = {k: getattr(now, k) for k in (*NUMBERS, "low", "high", "turns", "first_turn", "last_turn", "head", "tail")}
        self.out.append(numbers | {"conv_id": now.conv, "part": self.part, "block": self.block, "cell": cell, "lines": lines})
        self.block, self.lines, self.kinds, self.size = self.block + 1, [], [], 0
        self.now = Stretch(now.conv)

    def close(self, last: bool) -> None:
        """The conversation ends here, or (`last`) the rows of the task do."""
        now = self.now
        if now is None:
            return
        if self.first or last or self.block:
            if self.lines or not self.block:
                self.flush()
        else:
            cost, audit = best(span("".join(self.kinds)))
            each = ((k, r, t) for kind, n, r, t in self.lines for k in _copy_kinds(kind, n))
            numbers = {k: getattr(now, k) for k in (*NUMBERS, "low", "high", "turns")}
            sha = _digest(line for line, _ in apply(audit, each, 0))
            self.out.append(numbers | {"conv_id": now.conv, "cost": cost, "audit": audit, "repaired_sha256": sha})
        self.first, self.block, self.lines, self.kinds, self.size = False, 0, [], [], 0


def _cut_rows(batches, block_rows: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    names = _names(BLOCKS)
    cutter = _Cutter(TaskContext.get().partitionId(), block_rows, block_bytes)
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault", "initial", "kind"))):
            cutter.row(*row)
            if len(cutter.out) >= 1000 or cutter.out and "lines" in cutter.out[-1]:
                yield _table(cutter.out, names)
                cutter.out = []
    cutter.close(last=True)
    if cutter.out:
        yield _table(cutter.out, names)


_PARSED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, rows bigint"


def _fold(batches) -> Iterator[pa.RecordBatch]:
    """Ordered blocks to parsed conversations."""
    now, cells = None, None

    def result():
        cost, audit = best(cells) if now.rows else (0, "")
        row = {k: getattr(now, k) for k in NUMBERS} | {"conv_id": now.conv, "gaps": now.gaps(), "cost": cost, "audit": audit}
        return _table([row], _names(_PARSED))

    for batch in batches:
        for i in range(batch.num_rows):
            block = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if now is None or now.conv != block["conv_id"]:
                if now is not None:
                    yield result()
                now, cells = Stretch(block["conv_id"]), {(0, 0): (0, "")}
            now.fold(block)
            # only from the beginning on: at most one audit a state
            cells = join(cells, {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in block["cell"]})
    if now is not None:
        yield result()


def _apply(batches) -> Iterator[pa.RecordBatch]:
    """Ordered rows of a conversation, its parsed row first and then its blocks, to results."""
    names = _names(RESULT)
    row = out = edits = None
    state, begun = 0, False

    def lines(blocks):
        for b in blocks:
            for kind, role, text, n in ((x["kind"], x["role"], x["text"], x["copies"]) for x in b):
                for k in _copy_kinds(kind, n):
                    yield k, role, text

    def feed(audit, rows):
        nonlocal state, begun
        for line, state in apply(audit, rows, state):
            out.update(("\n" + line if begun else line).encode())
            begun = True

    def result():
        feed(row["audit"][edits:], ())  # insertions at the end
        return _table([row | {"repaired_sha256": out.hexdigest()}], names)

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("lines")[i].as_py() is None:
                if row is not None:
                    yield result()
                row = {c: batch.column(c)[i].as_py() for c in names if c != "repaired_sha256"}
                out, edits, state, begun = hashlib.sha256(), 0, 0, False
                continue
            each = list(lines([batch.column("lines")[i].as_py()]))
            left, upto, audit = len(each), edits, row["audit"]
            while left:
                left -= audit[upto] != "I"
                upto += 1
            feed(audit[edits:upto], each)
            edits = upto
    if row is not None:
        yield result()


def repair(rows: DataFrame, *, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The result of every conversation of `rows` (as `damage` gives them): counts, cost, audit and repaired text's digest."""
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    ranged = _judged(rows).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", "turn", "role", "text", "copies", "fault", "initial", "kind")
    parts = cut(ranged.mapInArrow(lambda b: _cut_rows(b, block_rows, block_bytes), BLOCKS), "conversations")
    gaps = F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0).cast("bigint"))
    whole = parts.where("block is null").withColumn("gaps", gaps)
    blocks = parts.where("block is not null")
    place = ["conv_id", "part", "block"]
    cells = blocks.drop("lines", "cost", "audit", "repaired_sha256").repartition("conv_id").sortWithinPartitions(*place)
    parsed = cells.mapInArrow(_fold, _PARSED)
    nothing = {c: F.lit(None) for c in ("part", "block", "lines")}
    both = parsed.withColumns(nothing).unionByName(blocks.select(*place, "lines"), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").asc_nulls_first(), "block")
    columns = _names(RESULT)
    return whole.select(*columns).union(ordered.mapInArrow(_apply, RESULT).select(*columns))
