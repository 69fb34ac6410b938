"""Conversation structure repair by weighted CYK interval parsing.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Rows may be kept, given
another role, deleted (blank and duplicate rows must be), and empty rows may be inserted; the cheapest
repair is the ASCII-least string of edits among those of least cost.

The grammar is in Chomsky normal form. Its nonterminals ``A[p, q]`` derive the edits that take the
role automaton from state p to state q, with the rules ``A[p, q] -> A[p, r] A[r, q]`` over spans, one
row as terminal, and the closure of insertions in front of and behind each row. A span's table has a
cell (cost, audit) for each nonterminal. Edits of equal cost over the same rows are never a prefix of
one another (all but insertions are one letter a row, and insertions cost), so the least audit of two
spans is made of the least audits of each, and cells suffice. As ``A[p, q]`` holds every way from p to
q, any one split of a span gives its full cell: spans are combined bottom-up by length 1, 2, 4, ...,
O(rows) of them. A test compares that with the table over all spans and all splits.

Distribution: equal rows of a conversation are counted first. Rows without their text are numbered by
a global range sort, so a conversation of any length lies over as many tasks as its rows need; its
spans of up to CHUNK rows are parsed apart, and their cells, of at most a few letters a row, are
combined per conversation. The digest of the repaired text is one SHA-256 over one stream of sorted
rows a conversation: it holds one row at a time and the edits, never the conversation.

Nulls: a null conv_id is a conversation of its own; null turns come first; null roles and texts count
as one space, and nulls are written as one space in the damage key. Empty and white texts are blank.
Long texts are passed through whole. Rows of equal turn are ordered by role, then by the SHA-256 of
their text; equal rows are repetitions. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlens.llm.common import written

WHITE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of ``(s?(ua)+)?``: nothing yet, behind s, behind u, behind a. Final: START and A.
START, S, U, A = range(4)
MOVES = {"s": ((START, S),), "u": ((START, U), (S, U), (A, U)), "a": ((U, A),)}
FINAL = (START, A)
#: Symbols of a row: its role's initial (o for another), by fault.
FINE, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "1234", "5678"
ROLE = {c: "suao"[k % 4] for k, c in enumerate(FINE + TRUNCATED + BLANK + DUPLICATE)}
LEGAL = ("su", "ua", "au")
#: Rows whose spans are parsed in one piece.
CHUNK = 4096
#: Spans of so many rows are remembered.
REMEMBERED = 6
#: A table of a span: 4 x 4 cells (cost, audit) or None, row by row.
Table = tuple


def least(cells) -> tuple[int, str] | None:
    return min((c for c in cells if c is not None), default=None)


def combine(left: Table, right: Table) -> Table:
    """A[p, q] -> A[p, r] A[r, q] for two spans side by side."""
    out = []
    for p in range(4):
        for q in range(4):
            out.append(
                least(
                    (x[0] + y[0], x[1] + y[1])
                    for r in range(4)
                    if (x := left[4 * p + r]) is not None and (y := right[4 * r + q]) is not None
                )
            )
    return tuple(out)


def _insertions() -> Table:
    """The closure of insertions: the cheapest way from state to state without a row."""
    one: list = [None] * 16
    for p in range(4):
        one[5 * p] = (0, "")
    for role in "ua":
        for p, q in MOVES[role]:
            one[4 * p + q] = (INSERT, "I")
    table = tuple(one)
    while (longer := combine(table, table)) != table:
        table = longer
    return table


INSERTIONS = _insertions()


@lru_cache(maxsize=64)
def row_table(symbol: str) -> Table:
    """A span of one row, with insertions around it."""
    cells: list = [[] for _ in range(16)]
    for p in range(4):
        cells[5 * p].append((DELETE, "D"))
    if symbol in FINE + TRUNCATED:
        extra = CUT if symbol in TRUNCATED else 0
        for p, q in MOVES.get(ROLE[symbol], ()):
            cells[4 * p + q].append((extra, "K"))
        for role in "ua":
            for p, q in MOVES[role]:
                cells[4 * p + q].append((REROLE + extra, "R"))
    return combine(combine(INSERTIONS, tuple(least(c) for c in cells)), INSERTIONS)


@lru_cache(maxsize=20_000)
def short_table(symbols: str) -> Table:
    if len(symbols) == 1:
        return row_table(symbols)
    half = 1 << ((len(symbols) - 1).bit_length() - 1)
    return combine(short_table(symbols[:half]), short_table(symbols[half:]))


def fold(tables: list[Table]) -> Table:
    """Combine neighbouring spans, level by level."""
    while len(tables) > 1:
        pairs = [combine(a, b) for a, b in zip(tables[::2], tables[1::2], strict=False)]
        tables = pairs + tables[2 * len(pairs) :]
    return tables[0] if tables else INSERTIONS


def span_table(symbols: str) -> Table:
    """The table of a run of rows."""
    step = REMEMBERED
    return fold([short_table(symbols[k : k + step]) for k in range(0, len(symbols), step)])


def cheapest(table: Table) -> tuple[int, str]:
    """Cost and audit of the whole conversation."""
    return least(table[q] for q in FINAL)


def illegal_pairs(roles: str) -> int:
    return sum(roles[k : k + 2] not in LEGAL for k in range(len(roles) - 1))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, ``copies`` (2 where repeated, else 1)."""
    blank = F.lit(" ")
    of = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (
            F.crc32(
                F.concat(
                    F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), blank),
                ).cast("binary")
            ) % 20
        ).alias("damage"),
    ).where("damage <> 0")
    return of.select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit(""))
        .when(F.col("damage") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("damage") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Equal rows counted, with the digest of the text that orders rows of one turn and role."""
    return (
        rows.groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    )


def numbered_symbols(rows: DataFrame) -> DataFrame:
    """conv_id, idx, symbols: the symbols of each distinct row of ``distinct_rows``, numbered in the
    order of conversations and rows. The second and later copies of a row are duplicates."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    end = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", "copies",
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("truncated"),
    )
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("idx", F.monotonically_increasing_id()), "conversation-rows")
    # one row for each different (role, text): joined by its number, so no key is hot
    first = kept.groupBy("conv_id", "role", "digest").agg(F.min("idx").alias("idx")).select("idx", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    of = lambda symbols: F.substring(F.lit(symbols), place, F.lit(1))
    again = F.when(F.col("blank"), of(BLANK)).otherwise(of(DUPLICATE))
    once = (
        F.when(F.col("blank"), of(BLANK))
        .when(F.col("first").isNull(), of(DUPLICATE))
        .when(F.col("truncated"), of(TRUNCATED))
        .otherwise(of(FINE))
    )
    return kept.join(first, "idx", "left").select(
        "conv_id", "idx", F.concat(once, F.repeat(again, (F.col("copies") - 1).cast("int"))).alias("symbols")
    )


CELLS = "array<struct<cost: bigint, audit: string>>"
COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _stored(table: Table) -> list:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for c in table]


def _loaded(cells) -> Table:
    return tuple(None if c is None else (c["cost"], c["audit"]) for c in cells)


def parse_span(symbols: pd.Series) -> pd.DataFrame:
    """Fault counts and cells of runs of rows."""
    rows = []
    for run in symbols:
        roles = "".join(map(ROLE.__getitem__, run))
        counts = [sum(map(run.count, kind)) for kind in (BLANK, DUPLICATE, TRUNCATED)]
        rows.append([*counts, illegal_pairs(roles), roles[0], roles[-1], _stored(span_table(run))])
    return pd.DataFrame(rows, columns=["blank", "duplicate", "truncated", "illegal", "head", "tail", "cells"])


def join_spans(spans: pd.Series) -> pd.DataFrame:
    """Totals and cheapest repairs of conversations from their runs, in order."""
    rows = []
    for parts in spans:
        parts = [p["span"] for p in parts]
        seams = sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
        counts = [sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")]
        cost, audit = cheapest(fold([_loaded(p["cells"]) for p in parts]))
        rows.append([*counts[:3], counts[3] + seams, cost, audit])
    return pd.DataFrame(rows, columns=["blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def parsed(symbols: DataFrame) -> DataFrame:
    """Per conversation: fault counts, illegal pairs, cost and audit of the cheapest repair."""
    of_run = F.pandas_udf(parse_span, f"{COUNTS}, head string, tail string, cells {CELLS}")
    of_conversation = F.pandas_udf(join_spans, f"{COUNTS}, cost bigint, audit string")
    run = F.sort_array(F.collect_list(F.struct("idx", "symbols")))
    spans = (
        symbols.groupBy("conv_id", F.floor(F.col("idx") / CHUNK).alias("chunk"))
        .agg(F.array_join(F.transform(run, lambda x: x["symbols"]), "").alias("symbols"))
        .select("conv_id", "chunk", of_run("symbols").alias("span"))
    )
    return (
        spans.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", F.struct("span").alias("of")))).alias("spans"))
        .select("conv_id", of_conversation(F.transform("spans", lambda x: x["of"])).alias("repair"))
        .select("conv_id", "repair.*")
    )


class Repair:
    """Applies an audit to the rows of a conversation, which come one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _next_role(self) -> str:
        self.state = A if self.state == U else U
        return "assistant" if self.state == A else "user"

    def inserted(self) -> Iterator[str]:
        """Lines to put in here."""
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield f"{self._next_role()}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        """Lines that stand for the next row."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield f"{self._next_role()}:{text}"
        elif edit == "K":
            self.state = {"s": S, "u": U, "a": A}[role[0]]
            yield f"{role}:{text}"


def repaired_lines(heads: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """One stream of each conversation: its audit first, then its rows in order."""
    null = F.lit(None)
    top = heads.select("conv_id", "audit", null.cast("long").alias("turn"), null.cast("string").alias("role"),
                       null.cast("string").alias("digest"), null.cast("string").alias("text"), null.cast("long").alias("copies"))
    below = rows.select("conv_id", null.cast("string").alias("audit"), "turn", "role", "digest", text, "copies")
    order = ["conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "digest"]
    return top.union(below).repartition("conv_id").sortWithinPartitions(*order).drop("turn", "digest")


def digests(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired lines, streamed."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, ids, out = None, [], []
        repair = hasher = None
        first = True

        def put(lines):
            nonlocal first
            for line in lines:
                hasher.update(line.encode() if first else b"\n" + line.encode())
                first = False

        for batch in batches:
            for conv, audit, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:
                    if repair is not None:
                        put(repair.inserted())
                        ids.append(open_)
                        out.append(hasher.hexdigest())
                    open_, repair, hasher, first = conv, Repair(audit), hashlib.sha256(), True
                else:
                    for _ in range(copies):
                        put(repair.row(role, text))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out)], ["conv_id", "repaired_sha256"])
                ids, out = [], []
        if repair is not None:
            put(repair.inserted())
            yield pa.RecordBatch.from_arrays([pa.array([open_], pa.int64()), pa.array([hasher.hexdigest()])], ["conv_id", "repaired_sha256"])

    return repaired_lines(heads, rows).mapInArrow(stream, "conv_id long, repaired_sha256 string")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conv_id of ``conversations`` with the faults of its ``rows`` (as ``damaged`` gives them),
    the cheapest repair and the digest of the repaired conversation."""
    unique = distinct_rows(rows)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = (
        rows.groupBy("conv_id")
        .agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
        .withColumnRenamed("conv_id", "c")
    )
    repairs = parsed(numbered_symbols(unique)).withColumnRenamed("conv_id", "r")
    heads = (
        conversations.select("conv_id").distinct()
        .join(repairs, F.col("conv_id").eqNullSafe(F.col("r")), "left")
        .join(gaps, F.col("conv_id").eqNullSafe(F.col("c")), "left")
        .select("conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"))
    )
    heads = written(heads, "conversation-heads")
    hashed = digests(heads, unique).withColumnRenamed("conv_id", "h")
    return heads.join(hashed, F.col("conv_id").eqNullSafe(F.col("h"))).drop("h")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the conversations, count their faults and repair them at least cost."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(table, damaged(table))
