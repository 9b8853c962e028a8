"""Token ids written as range-coded segments and read back.

Documents are range-partitioned and sorted by id; each task encodes its range
to token ids and writes segments of whole documents (rangecoder.py's format,
one Parquet row a segment, with the segment's document ids and lengths beside
the coded bytes). Ranges and segments are numbered in id order, so a running
sum over the segments' sizes places every document in the whole stream.

Defined cases: a null or empty text has only the end id; a null id sorts
first; rows that repeat an id are written one after another, ordered by text;
an empty table writes no segment; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import rangecoder, tokenids, words
from plumbline.llm.shared import shared_folder, shuffle_partitions, table

END_ID = 2
#: Ids in a segment before it is closed; a longer document is a segment of its own.
SEGMENT_IDS = 4 << 20


def _segments(path: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokenids.token_ids(path), TaskContext.get().partitionId()
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        before = number = 0

        def close() -> pa.RecordBatch:
            nonlocal before, number
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            doc_ids = pa.concat_arrays(keys)
            rows = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), rows, pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([rangecoder.encode(ids)], pa.binary())], ["part", "segment", "before", "doc_ids", "lengths", "payload"])
            before, number = before + len(ids), number + 1
            held.clear(), sizes.clear(), keys.clear()
            return out

        for batch in words.batches(batches, "text"):
            at, ids = tokenids.with_end(*encoder.encode(words.text_array(batch.column("text"))), end_id)
            start = 0
            while start < batch.num_rows:
                room = limit - sum(map(len, held))
                stop = int(np.searchsorted(at, at[start] + room, "right")) - 1
                if stop <= start and held:
                    yield close()
                    continue
                stop = max(stop, start + 1)
                held.append(ids[at[start] : at[stop]])
                sizes.append(np.diff(at[start : stop + 1]))
                keys.append(batch.column("id").slice(start, stop - start))
                start = stop
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the token ids of ``docs`` to ``path`` in ascending id order."""
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    ordered = slim.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"part int, segment long, before long, doc_ids array<{kind}>, lengths array<long>, payload binary"
    ordered.mapInArrow(_segments(tokenizer or tokenids.default_path(), end_id, segment_ids), schema).write.parquet(path)


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = rangecoder.decode(batch.column("payload")[k].as_py())
                keys = batch.column("doc_ids")[k].values
                lengths = np.array(batch.column("lengths")[k].values, np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths + batch.column("base")[k].as_py() + batch.column("before")[k].as_py()
                crcs = [tokenids.crc(ids[e - n : e]) for e, n in zip(ends, lengths)]
                columns = [keys, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_tokens(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files at ``path``: id, start, n_tokens, ids_crc32 (and ids)."""
    files = spark.read.parquet(path)
    # One row a range: a few thousand at most, so one task can sum them.
    sizes = files.select("part", F.expr("before + aggregate(lengths, 0L, (a, x) -> a + x)").alias("size")).groupBy("part").agg(F.max("size").alias("size"))
    bases = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    out = files.join(F.broadcast(bases), "part").select("base", "before", "doc_ids", "lengths", "payload")
    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return out.mapInArrow(_documents(with_ids), schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
