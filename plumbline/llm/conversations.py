"""Conversation structure repair.

Every turn is judged once: blank, a repeat of an earlier turn's role and text,
or cut off before its last sentence ends. The cheapest edits that give legal
roles then come from role_repair's run-length program. Judging, digests and
the search for repeats are column expressions and a pre-aggregated grouping,
spread over rows whatever the conversation. Each conversation then passes one
task as a sorted stream: first its turns without their texts, from which the
runs and the edits follow, then its turns with texts, which are repaired and
hashed as they pass. A task holds the open conversation's runs and edits (a
byte or so a turn, as in the audit it returns) and never its texts, so a
conversation with a third of all turns takes time, but no memory: the hash of
one conversation is sequential by its definition.

Order: by turn, nulls first; turns of equal number by role, then digest of the
text, so that equal rows are neighbours. Defined cases: a null role or text
counts as one space, hence a null text is blank; a null conversation id is a
conversation; a role is judged by its first letter; a conversation without
turns has zeros, an empty audit and the hash of nothing; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import role_repair
from plumbline.llm.shared import table

#: White space of the contract, and what ends a sentence.
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = [".", "!", "?"]
INITIALS = {"s": role_repair.SYSTEM, "u": role_repair.USER, "a": role_repair.ASSISTANT}
LEGAL_PAIRS = {(role_repair.SYSTEM, role_repair.USER), (role_repair.USER, role_repair.ASSISTANT), (role_repair.ASSISTANT, role_repair.USER)}
FINE, BLANK, CUT_OFF = range(3)

#: Conversations whose edits a worker remembers by their runs, and the most runs of one.
MEMO, MEMO_RUNS = 50_000, 32
ROWS_OUT, BYTES_OUT = 2_000, 8 << 20

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def judged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent_col: str | None) -> DataFrame:
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    absent = F.coalesce(turns[absent_col], F.lit(False)) if absent_col else F.lit(False)
    rows = turns.select(turns[conv_col].alias("conv"), turns[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"), absent.alias("absent"))
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == letter, code) for letter, code in INITIALS.items()], F.lit(role_repair.OTHER))
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(ENDINGS), CUT_OFF).otherwise(FINE)
    return rows.withColumns({"digest": F.sha2("text", 256), "initial": initial, "fault": fault})


def _stream(rows: DataFrame) -> DataFrame:
    """Each conversation's turns twice, sorted: slim with their faults, then with their texts."""
    here = rows.where("not absent")
    order = F.struct(F.col("turn").isNotNull(), "turn")
    repeats = here.groupBy("conv", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = repeats.select(F.col("conv").alias("of"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    slim = here.select("conv", "turn", "role", "digest", "initial", "fault").join(repeats, F.expr("conv <=> of and role = r and digest = d"), "left")
    slim = slim.select("conv", F.lit(1).alias("phase"), "turn", "role", "digest", "initial", "fault", (F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("repeat"), F.lit(None).cast("string").alias("text"))
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("initial", "int"), ("fault", "int"), ("repeat", "boolean"))]
    full = here.select("conv", F.lit(2).alias("phase"), "turn", "role", "digest", *blank, "text")
    ids = rows.select("conv").distinct().select("conv", F.lit(0).alias("phase"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), *blank, F.lit(None).cast("string").alias("text"))
    return ids.union(slim).union(full).repartition("conv").sortWithinPartitions("conv", "phase", F.asc_nulls_first("turn"), "role", "digest")


class Conversation:
    """What is known of the open conversation."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(COUNTS, 0)
        self.runs: list[list[int]] = []
        self.low = self.high = None
        self.turns, self.before, self.last = 0, None, None
        self.audit, self.edits = "", None
        self.hash, self.place = hashlib.sha256(), 0

    def judge(self, turn: int | None, role: str, digest: str, initial: int, fault: int, repeat: bool) -> None:
        c = self.counts
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.before is not None and (self.before, initial) not in LEGAL_PAIRS:
            c["illegal"] += 1
        repeat = repeat or self.last == (turn, role, digest)
        self.before, self.last = initial, (turn, role, digest)
        if fault == BLANK:
            c["blank"] += 1
        elif repeat:
            c["duplicate"] += 1
        elif fault == CUT_OFF:
            c["truncated"] += 1
        symbol = role_repair.GONE if repeat or fault == BLANK else 2 * initial + (fault == CUT_OFF)
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])

    def solve(self, memo: dict) -> None:
        if len(memo) > MEMO:
            memo.clear()
        key = tuple(map(tuple, self.runs)) if len(self.runs) <= MEMO_RUNS else None
        if key is None or (found := memo.get(key)) is None:
            found = role_repair.solve(self.runs)
            if key is not None and len(found[1]) <= 4 * MEMO_RUNS:
                memo[key] = found
        self.counts["cost"], self.audit = found
        self.counts["gaps"] = self.high - self.low + 1 - self.turns if self.turns else 0
        self.edits, self.runs = role_repair.Edits(self.audit), []

    def put(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(f"{'\n' if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.place - 1, role, text


def _repair(kind: pa.DataType, with_turns: bool):
    names = ["conv", "place", "role", "text"] if with_turns else ["conv", *COUNTS, "audit", "repaired_sha256"]
    types = [kind, pa.int64(), pa.string(), pa.string()] if with_turns else [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        out: list[tuple] = []
        held = 0
        key, talk = None, None

        def flush() -> pa.RecordBatch:
            nonlocal held
            held = 0
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def add(turn: tuple[int, str, str]) -> None:
            nonlocal held
            if with_turns:
                out.append((key, *turn))
                held += len(turn[2])

        def close() -> None:
            nonlocal held
            if talk.edits is None:
                talk.solve(memo)
            for role in talk.edits.inserted():
                add(talk.put(role, ""))
            if not with_turns:
                out.append((key, *talk.counts.values(), talk.audit, talk.hash.hexdigest()))
                held += len(talk.audit)

        for batch in batches:
            for conv, phase, turn, role, digest, initial, fault, repeat, text in zip(*(c.to_pylist() for c in batch.columns)):
                if phase == 0:
                    if talk is not None:
                        close()
                    key, talk = conv, Conversation()
                elif phase == 1:
                    talk.judge(turn, role, digest, initial, fault, repeat)
                else:
                    if talk.edits is None:
                        talk.solve(memo)
                    for made in talk.edits.inserted():
                        add(talk.put(made, ""))
                    if (now := talk.edits.row(role)) is not None:
                        add(talk.put(now, text))
                if len(out) >= ROWS_OUT or held >= BYTES_OUT:
                    yield flush()
        if talk is not None:
            close()
        if out:
            yield flush()

    return run


def _repaired(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent_col: str | None, with_turns: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = judged(turns, conv_col, turn_col, role_col, text_col, absent_col)
    kind = rows.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind)])
    for name in ["place"] if with_turns else COUNTS:
        out = out.add(name, T.LongType())
    for name in ["role", "text"] if with_turns else ["audit", "repaired_sha256"]:
        out = out.add(name, T.StringType())
    return _stream(rows).mapInArrow(_repair(to_arrow_type(kind), with_turns), out).withColumnRenamed("conv", conv_col)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, absent_col: str | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows for which ``absent_col`` is true only name their conversation. The
    audit has an initial for each edit: K keep, R give the role that is due,
    D delete, I insert an empty turn of the role that is due.
    """
    return _repaired(turns, conv_col, turn_col, role_col, text_col, absent_col, False)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, absent_col: str | None = None) -> DataFrame:
    """The repaired conversations themselves: id, place (from 0), role and text of every turn."""
    return _repaired(turns, conv_col, turn_col, role_col, text_col, absent_col, True)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` with the contract's damage, chosen by the CRC-32 of ``conversation:turn``; ``absent`` marks dropped rows."""

    def filled(name: str) -> Column:
        return F.coalesce(turns[name].cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    rows = turns.select(turns[conv_col].alias(conv_col), turns[turn_col].alias(turn_col), filled(role_col).alias(role_col), filled(text_col).alias(text_col), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate(text_col, "".join(ENDINGS), "")).otherwise(F.col(text_col))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col(role_col))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), (F.col("draw") == 0).alias("absent"), copies.alias("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), absent_col="absent")
