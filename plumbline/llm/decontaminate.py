"""Benchmark decontamination with an FM-index per training shard.

Each shard of about ``SHARD_BYTES`` of documents is indexed inside its task;
every benchmark window is searched backwards in it, its occurrences are
located from sampled suffixes, and the words they cover are merged to spans.
Nothing is shuffled. The benchmark is read in blocks of bounded size, each a
broadcast of its own, and a later block's spans are merged into the earlier
ones'.

Defined cases: a null text has no words and is not contaminated; an item
without words has no window; a null item_id marks words but is listed nowhere;
repeated rows are judged each for itself; equal texts in a shard are indexed
once; an empty benchmark leaves every document clean; other columns pass
through untouched whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.fm_index import FMIndex
from plumbline.llm.shared import table

WINDOW = 13
#: Bytes of documents in one index, and of benchmark text in one broadcast block.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20


@dataclass
class Windows:
    """Distinct windows of a block of items, right-aligned, as numbers into ``vocabulary``."""

    vocabulary: list[str]
    phrases: np.ndarray
    lengths: np.ndarray
    #: Names of the items that hold each window.
    items: list[list[str]]


def windows(rows: list[tuple[str | None, str | None]], width: int = WINDOW) -> Windows:
    """``rows``: (item name or None, text)."""
    numbers, at, distinct = words.split(words.text_array(pa.array([t for _, t in rows], pa.string())), words.ALNUM_WORDS)
    of: dict[tuple, set] = {}
    for k, (name, _) in enumerate(rows):
        own = numbers[at[k] : at[k + 1]].tolist()
        for i in range(max(len(own) - width, 0) + 1 if own else 0):
            of.setdefault(tuple(own[i : i + width]), set()).update([name] if name is not None else [])
    phrases = np.full((len(of), width), -1, np.int64)
    for k, w in enumerate(of):
        phrases[k, width - len(w) :] = w
    return Windows(words.strings(distinct), phrases, np.array([len(w) for w in of], np.int64), [sorted(x) for x in of.values()])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def occurrences(texts: pa.Array, block: Windows) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, list[str]]]]:
    """Words of each text, and for texts with hits: span starts, span ends, item names."""
    coded = texts.dictionary_encode()
    which = np.asarray(coded.indices)
    numbers, at, distinct = words.split(words.text_array(coded.dictionary), words.ALNUM_WORDS)
    found: dict[int, tuple] = {}
    if len(numbers) and len(block.phrases):
        known = {w: k + 1 for k, w in enumerate(words.strings(distinct))}
        code = np.array([*(known.get(w, -1) for w in block.vocabulary), -1], np.int64)
        index = FMIndex(numbers + 1, at[1:])
        lo, hi = index.search(code[block.phrases], block.lengths)
        live = np.flatnonzero(hi > lo)
        window = np.repeat(live, (hi - lo)[live])
        doc, word = index.place(index.locate(words.gather(lo[live], (hi - lo)[live])))
        by = np.argsort(doc, kind="stable")
        doc, word, window = doc[by], word[by], window[by]
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            starts, ends = merged(word[a:b], word[a:b] + block.lengths[window[a:b]])
            found[int(doc[a])] = (starts, ends, sorted({x for w in np.unique(window[a:b]) for x in block.items[w]}))
    return np.diff(at)[which], {row: found[d] for row, d in enumerate(which.tolist()) if d in found}


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.batches(batches, "text", SHARD_BYTES):
            n_words, found = occurrences(words.text_array(batch.column("text")), shared.value)
            starts, ends, items = (batch.column(c).to_pylist() for c in ("span_starts", "span_ends", "items"))
            for k, (s, e, names) in found.items():
                s, e = merged(np.concatenate([np.array(starts[k], np.int64), s]), np.concatenate([np.array(ends[k], np.int64), e]))
                starts[k], ends[k], items[k] = s.tolist(), e.tolist(), sorted({*items[k], *names})
            out = {c: batch.column(c) for c in ("row", "text")} | {"n_words": pa.array(n_words), "span_starts": pa.array(starts, pa.list_(pa.int32())), "span_ends": pa.array(ends, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's (name, text) rows in blocks of about ``limit`` bytes."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("name"), benchmark[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n
    n = max(1, -(-size // limit))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [(r.name, r.text) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the input row), n_words, span_starts, span_ends (word numbers, merged, ends exclusive), items."""
    row = F.struct(*[docs[c] for c in docs.columns])
    none = F.array().cast("array<int>")
    out = docs.select(row.alias("row"), docs[text_col].cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), none.alias("span_starts"), none.alias("span_ends"), F.array().cast("array<string>").alias("items"))
    for block in blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(windows(block, width))
        out = out.mapInArrow(_search(shared), out.schema)
    return out.drop("text")


def hit_words() -> F.Column:
    return F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def judged(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated: a twentieth of the words at least."""
    out = found.withColumn("n_hit", hit_words())
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_rows(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    return judged(decontaminate(docs, benchmark, **how)).where("NOT contaminated").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(decontaminate(docs, table(spark, sf_dir, "benchmark")))
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS g
       FROM (SELECT *, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i + 1, i + k), ' ') AS g
       FROM (SELECT d.doc_id, d.w, s.k, unnest(range(len(d.w) - s.k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) s WHERE len(d.w) >= s.k)),
hits AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
