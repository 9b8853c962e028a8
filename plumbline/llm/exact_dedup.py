"""Exact dedup by content sort.

Sampled splitters deal the rows to ranges of (leading bytes, content digest,
id), an external sort inside each range brings equal texts together, and every
text is compared in full with its neighbour. The id is part of the splitters,
so a text that a third of all rows share is spread over many ranges; the runs
at the edges of ranges (two a range) are then joined by full text.

Defined cases: a null text counts as empty; of rows that repeat an id and a
text exactly one is kept; a null id loses against any other; an empty table
gives an empty result; other columns pass through untouched whatever they are
called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import shuffle_partitions, staged, table

#: Leading characters in a splitter: enough for content order, little for the sampler to hold.
SPLITTER_CHARS = 24


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; of the open run what stands beside the text is held (with ``carry`` the rows), of one range at most."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    text, run = None, -1

    def rows(batch: pa.RecordBatch, numbers: np.ndarray, sizes: np.ndarray, first: np.ndarray, edge: np.ndarray, leads: pa.Array, shown: str | None) -> pa.RecordBatch:
        n = batch.num_rows
        head = first & edge
        texts = pa.array([shown if h else None for h in head], pa.string()) if head.any() else pa.nulls(n, pa.string())
        columns = {name: batch.column(name) for name in batch.schema.names if name != "text"}
        columns |= {"part": pa.array(np.full(n, part, np.int32)), "run": pa.array(numbers), "run_size": pa.array(sizes), "first": pa.array(first), "edge": pa.array(edge), "run_id": leads, "edge_text": texts}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        total, start = sum(b.num_rows for b in held), True
        for b in held:
            first = np.zeros(b.num_rows, bool)
            first[0] = start
            lead = pa.array([held[0].column("id")[0].as_py()] * b.num_rows, b.schema.field("id").type)
            yield rows(b, np.full(b.num_rows, run, np.int64), np.full(b.num_rows, total, np.int64), first, np.full(b.num_rows, last or run == 0), lead, text)
            start = False
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("text")
        slim = batch.drop_columns(["text"])
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.asarray(pc.not_equal(texts[1:], texts[:-1]))
        new[0] = text is None or texts[0].as_py() != text
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(slim)
            continue
        if starts[0]:
            held.append(slim.slice(0, starts[0]))
        if held:
            yield from close(False)
        if len(starts) > 1:
            if run < 0:  # the range's first run has its text shown
                text, run = texts[0].as_py(), 0
                held.append(slim.slice(0, starts[1]))
                yield from close(False)
                starts = starts[1:]
            inner = slim.slice(starts[0], starts[-1] - starts[0])
            if inner.num_rows:
                sizes = np.diff(starts)
                numbers = np.repeat(run + 1 + np.arange(len(sizes)), sizes)
                leads = slim.column("id").take(pa.array(np.repeat(starts[:-1], sizes)))
                yield rows(inner, numbers, np.repeat(sizes, sizes), new[starts[0] : starts[-1]], np.zeros(inner.num_rows, bool), leads, None)
                run += len(sizes)
        text, run = texts[int(starts[-1])].as_py(), run + 1
        held.append(slim.slice(starts[-1]))
    if held:
        yield from close(True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, largest: bool = False, normalise: Callable[[Column], Column] = lambda c: c, carry: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The smallest id of equal normalised texts stays (``largest``: the
    largest). With ``carry`` a struct column ``row`` holds the input row.
    """
    spark = docs.sparkSession
    text = F.coalesce(normalise(docs[text_col].cast("string")), F.lit(""))
    keyed = docs.select(docs[id_col].alias("id"), text.alias("text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []))
    keyed = keyed.withColumn("text_sha256", F.sha2("text", 256)).withColumn("lead", F.substring("text", 1, SPLITTER_CHARS))
    order = [F.desc_nulls_last("id") if largest else F.asc_nulls_last("id")]
    dealt = keyed.repartitionByRange(partitions or shuffle_partitions(spark), "lead", "text_sha256", *order)
    ordered = dealt.sortWithinPartitions("lead", "text_sha256", "text", *order).drop("lead")
    out = T.StructType([f for f in ordered.schema if f.name != "text"])
    for name, kind in (("part", T.IntegerType()), ("run", T.LongType()), ("run_size", T.LongType()), ("first", T.BooleanType()), ("edge", T.BooleanType()), ("run_id", keyed.schema["id"].dataType), ("edge_text", T.StringType())):
        out = out.add(name, kind)
    runs = staged(ordered.mapInArrow(_runs, out), "exact-runs")

    # Two runs a range at most: small enough to broadcast whatever the number of rows.
    edges = runs.where("edge and first").groupBy("edge_text").agg(F.sum("run_size").alias("all_size"), F.min(F.struct("part", "run", "run_id")).alias("top"), F.collect_list(F.struct("part", "run")).alias("of"))
    edges = edges.select("all_size", "top", F.inline("of")).select("part", "run", "all_size", F.col("top.part").alias("top_part"), F.col("top.run").alias("top_run"), F.col("top.run_id").alias("top_id"))
    joined = runs.drop("edge_text").join(F.broadcast(edges), ["part", "run"], "left")
    joined = joined.withColumns({
        "keep_id": F.when(F.col("edge"), F.col("top_id")).otherwise(F.col("run_id")),
        "group_size": F.when(F.col("edge"), F.col("all_size")).otherwise(F.col("run_size")),
        "kept": F.col("first") & (~F.col("edge") | ((F.col("part") == F.col("top_part")) & (F.col("run") == F.col("top_run")))),
    })
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", *(["row"] if carry else []))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with the columns of ``docs``."""
    return exact_dedup(docs, id_col, text_col, carry=True, **how).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), largest=True)


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
