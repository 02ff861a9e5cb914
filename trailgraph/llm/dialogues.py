"""Conversation structure repair: weighted interval parsing of turn sequences.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``.
The repair grammar in Chomsky normal form has one nonterminal for every pair of
states of that pattern, X_pq: "a span that leads from p to q". Its rules are
X_pq -> X_pr X_rq for two neighbouring spans, and X_pq -> row for an edited row
(keep, rerole, delete). A cell holds the least (cost, audit) of its
nonterminal; the audit is the edits' initials in order. Insertion is a closure:
each row's cell is multiplied by the cheapest ways to insert turns before and
after it, so products need no further insertions.

Spans are combined bottom-up by length. The split point of a span does not
matter here: of two audits over the same rows with equal cost neither is a
prefix of the other (what follows would be inserts, which cost), so the order
of audits survives concatenation, the product is associative, and one split per
span gives the minimum over all splits. So spans of 1, 2, 4, ... rows suffice.

Spark ranges all rows by (conversation, turn, role, text digest), so a long
conversation lies in several tasks. Each task parses blocks of at most BLOCK
rows into one cell matrix; only matrices meet by conversation. Texts take no
part in this; they are sorted by conversation once, and streamed past their
audit. Repeated rows are counted before they are moved.

Null roles and texts count as one space; a null conversation id is a
conversation of its own; null turns come first. Rows of equal turn stand in the
order of role, then of their text's SHA-256. An empty table gives no rows, an
empty role fits nothing. Columns other than the four named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

# Edit costs, legal neighbours.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
#: Runs of equal rows in one block of the parse.
BLOCK = 512
ROLES = {"u": "user", "a": "assistant"}
#: The pattern's states: 0 nothing yet, 1 after s, 2 after u, 3 after ua; where each initial leads.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What a turn that is written anew must be in each state.
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
ENDS = (0, 3)

Cells = dict[tuple[int, int], tuple[int, str]]


def product(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans as one span."""
    out: Cells = {}
    for (p, r), (c1, a1) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r == r2:
                best = out.get((p, q))
                if best is None or c1 + c2 <= best[0]:
                    cell = (c1 + c2, a1 + a2)
                    if best is None or cell < best:
                        out[p, q] = cell
    return out


def _closure() -> Cells:
    """Cheapest inserted turns from each state to each other one; nothing from a state to itself."""
    out: Cells = {}
    for p in range(4):
        at, cost, audit = p, 0, ""
        while (p, at) not in out:
            out[p, at] = (cost, audit)
            at, cost, audit = STEP[at, WANTED[at]], cost + INSERT, audit + "I"
    return out


INSERTS = _closure()


def row_cells(initial: str, must_go: bool, truncated: bool) -> Cells:
    """Cells of one row, insertions around it included."""
    own: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if not must_go:
        extra = TRUNCATED if truncated else 0
        for p in range(4):
            own[p, STEP[p, WANTED[p]]] = (REROLE + extra, "R")
        for p in range(4):
            if (p, initial) in STEP:
                own[p, STEP[p, initial]] = (extra, "K")
    return product(product(INSERTS, own), INSERTS)


def deleted(n: int) -> Cells:
    return product({(p, p): (DELETE * n, "D" * n) for p in range(4)}, INSERTS)


def combine(spans: list[Cells]) -> Cells:
    """One span of all, by doubling lengths."""
    while len(spans) > 1:
        spans = [product(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[0, q] for q in ENDS if (0, q) in cells)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """The planted faults of the registered query: conv_id, turn, role, text by crc32(``conv_id:turn``) mod 20."""
    kind = F.pmod(F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("_k")).filter("_k != 0")
    times = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select("conv_id", "turn", F.when(F.col("_k") == 4, F.lit("user")).otherwise(_text("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode(F.col("text"), "UTF-8"), 256))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n (equal rows), blank, seen (role and text stand earlier), cut (truncated)."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    light = _rows(rows).select("conv_id", "turn", "role", _digest().alias("digest"), (solid == "").alias("blank"), (~solid.rlike(r"[.!?]\z")).alias("cut"))
    counted = light.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # A null turn stands before all others.
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = counted.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(place).alias("_first"))
    at_home = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return counted.join(first, at_home).select("conv_id", "turn", "role", "digest", "n", "blank", "cut", (~F.col("_first").eqNullSafe(place)).alias("seen"))


CELLS = "array<struct<p:int,q:int,cost:long,audit:string>>"
STATS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"


class Block:
    """Cells and counts of consecutive rows of one conversation."""

    def __init__(self):
        self.spans: list[Cells] = []
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, n: int, blank: bool, cut: bool, seen: bool) -> None:
        initial = role[:1]
        if self.n:
            self.illegal += self.last_role + initial not in LEGAL
        else:
            self.first_role = initial
        self.illegal += (n - 1) * (initial * 2 not in LEGAL)
        self.n += n
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if blank:
            self.blank += n
        else:
            self.duplicate += n - (not seen)
            self.truncated += cut and not seen
        fresh = not (blank or seen)
        if fresh:
            self.spans.append(row_cells(initial, False, cut))
        if n > fresh:
            self.spans.append(deleted(n - fresh))

    def join(self, other: "Block") -> None:
        """Append the block that follows."""
        self.illegal += other.illegal + (self.last_role + other.first_role not in LEGAL)
        self.turns += other.turns - (other.first_turn is not None and other.first_turn == self.last_turn)
        self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if other.last_turn is None else other.last_turn
        self.last_role = other.last_role
        for name in ("n", "blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.spans += other.spans


def _batch(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(names)], schema=schema)


def _stream(df: DataFrame, fn, ddl: str, size: int = 4096) -> DataFrame:
    """mapInArrow with ``fn(iterator of row tuples) -> iterator of row tuples``."""
    schema = T.arrow_schema(ddl)

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for row in fn(rows):
            out.append(row)
            if len(out) == size:
                yield _batch(schema.names, out, schema)
                out = []
        if out:
            yield _batch(schema.names, out, schema)

    return df.mapInArrow(run, ddl)


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted runs of rows to blocks, in order of (piece, block)."""
    piece, no, conv, block, runs = TaskContext.get().partitionId(), 0, None, None, 0

    def done():
        cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in combine(block.spans).items()]
        return (conv, piece, no, cells, *(getattr(block, x.split()[0]) for x in STATS.split(", ")))

    for conv_id, turn, role, n, blank, cut, seen in rows:
        if block and (conv_id != conv or runs == BLOCK):
            yield done()
            no, block = no + 1, None
        if block is None:
            conv, block, runs = conv_id, Block(), 0
        block.add(turn, role, n, blank, cut, seen)
        runs += 1
    if block:
        yield done()


def _whole(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of each conversation to its result."""
    names = [x.split()[0] for x in STATS.split(", ")]
    conv, total = None, None

    def done():
        cost, audit = cheapest(combine(total.spans))
        gaps = total.last_turn - total.first_turn + 1 - total.turns if total.turns else 0
        return conv, gaps, total.blank, total.duplicate, total.truncated, total.illegal, cost, audit

    for conv_id, _, _, cells, *stats in rows:
        block = Block()
        for name, value in zip(names, stats):
            setattr(block, name, value)
        block.spans = [{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in cells}]
        if total and conv_id == conv:
            total.join(block)
        else:
            if total:
                yield done()
            conv, total = conv_id, block
    if total:
        yield done()


PARSED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def parse(rows: DataFrame) -> DataFrame:
    """One row per conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest")]
    ranged = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = _stream(ranged.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "n", "blank", "cut", "seen"), _blocks, f"conv_id long, piece int, block int, cells {CELLS}, {STATS}")
    return _stream(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "block"), _whole, PARSED)


class Writer:
    """Applies an audit to the rows that come in its order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _made(self, initial: str) -> None:
        self.state = STEP[self.state, initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the inserts that stand here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            initial = WANTED[self.state]
            self._made(initial)
            yield "I", ROLES[initial], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._made(role[:1])
            yield edit, role, text
        elif edit == "R":
            initial = WANTED[self.state]
            self._made(initial)
            yield edit, ROLES[initial], text


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, pos, edit, role, text) in order; each conversation's audit comes before its rows."""
    conv, writer, pos = None, None, 0
    for conv_id, audit, role, text in rows:
        if audit is not None:
            for x in writer.inserted() if writer else ():
                yield conv, pos, *x
                pos += 1
            conv, writer, pos = conv_id, Writer(audit), 0
            continue
        for x in writer.row(role, text):
            yield conv, pos, *x
            pos += 1
    for x in writer.inserted() if writer else ():
        yield conv, pos, *x
        pos += 1


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, sha = None, None
    for conv_id, pos, _, role, text in _repaired(rows):
        if pos == 0:
            if sha:
                yield conv, sha.hexdigest()
            conv, sha = conv_id, hashlib.sha256()
        sha.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
    if sha:
        yield conv, sha.hexdigest()


def _audited(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Audits and rows in one stream per conversation."""
    audits = parsed.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("_d"), "audit")
    texts = _rows(rows).select(F.col("conv_id").cast("long"), F.lit(1).alias("_kind"), F.col("turn").cast("long"), "role", "text", _digest().alias("_d"), F.lit(None).cast("string").alias("audit"))
    return audits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "role", "_d").select("conv_id", "audit", "role", "text")


def repair(rows: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, pos (from 0), edit (K, R or I), role, text. Deleted rows are gone."""
    return _stream(_audited(rows, parse(rows) if parsed is None else parsed), _repaired, "conv_id long, pos long, edit string, role string, text string")


def digests(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of each conversation that keeps a row: ``role:text`` lines.

    A digest is sequential, so each conversation streams through one task, row
    by row from Spark's external sort; nothing of it is held.
    """
    return _stream(_audited(rows, parsed), _digests, "conv_id long, repaired_sha256 string")


def report(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``parse`` with repaired_sha256 for every conversation of ``ids``, those without rows included."""
    parsed = cut_lineage(parse(rows))
    found = parsed.join(digests(rows, parsed).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c").withColumnRenamed("conv_id", "_i")
    every = ids.select(F.col("conv_id").cast("long")).distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_i")), "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
