"""Substring dedup by hashing lines and blocks of sentences.

A unit is a line, or a block: from each sentence on, the fewest sentences in a
row, over line ends too, that have ``block_words`` words together. Units are
normalised (A-Z lower-cased, white space runs made one space, trimmed) and
hashed, and digests are grouped over all documents. The earliest unit by (id,
row, place) stays. A later copy of a line is removed; a later copy of a block
is removed if the first is in another row, so a document's own rhythm is left
alone. Blocks catch a passage that starts and ends inside lines, as long as
whole sentences of it add up to a block; lines catch all that repeats as a
line, however short. Offsets refer to the original text.

A sentence ends after a run of ``.``, ``!`` and ``?`` with the white space
behind it, or with its line. A line of which everything is removed goes with
its line feed.

Defined cases: a null text counts as empty; an empty line, or one of white
space, is no unit; each row is judged by itself under a key that is written
once, so rows that repeat an id or have none do not touch each other's lines,
and a null id ranks after all others; an empty table gives an empty result;
columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.shared import settled, staged, table

#: Words that the sentences of a block have together at least.
BLOCK_WORDS = 8
SENTENCE = re.compile(r"[^.!?]*[.!?]+[ \t\v\f\r]*|[^.!?]+")
#: The same in bytes, where white space of ``split`` is ASCII's and A-Z alone change in ``LOWER``.
SENTENCE_BYTES = re.compile(rb"[^.!?]*[.!?]+[ \t\v\f\r]*|[^.!?]+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def sentences(text: str) -> list[list[str]]:
    """The sentences of each line; an empty line is one empty sentence."""
    return [SENTENCE.findall(line) or [""] for line in text.split("\n")]


def units(text: str, block_words: int = BLOCK_WORDS) -> Iterator[tuple[bool, int, int, bytes]]:
    """(whether it is a line, first sentence, sentence after the last, normalised text) of each unit."""
    at, full, sizes, texts = 0, [], [0], []
    for line in text.encode().translate(LOWER).split(b"\n"):
        pieces = SENTENCE_BYTES.findall(line)
        if own := line.split():
            # A line is normalised as a whole: its sentences may join without white space.
            yield True, at, at + len(pieces), b" ".join(own)
            for k, piece in enumerate(pieces, at):
                if found := piece.split():
                    full.append(k)
                    sizes.append(sizes[-1] + len(found))
                    texts.append(b" ".join(found))
        at += len(pieces) or 1
    last = 0
    for n, k in enumerate(full):
        while last < len(full) and sizes[last] - sizes[n] < block_words:
            last += 1
        if sizes[last] - sizes[n] < block_words:
            return
        yield False, k, full[last - 1] + 1, b" ".join(texts[n:last])


def _hashed(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.batches(batches, "text", 1 << 20):
            rows, firsts, ends, lines, digests = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for line, first, end, own in units(text or "", block_words):
                    rows.append(k)
                    firsts.append(first)
                    ends.append(end)
                    lines.append(line)
                    digests.append(hashlib.blake2b(own, digest_size=16, person=b"line" if line else b"block").digest())
            if rows:
                at = pa.array(rows)
                columns = [batch.column("id").take(at), batch.column("row").take(at), pa.array(lines), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "line", "first", "end", "digest"])

    return run


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, text), with a key for each row that every reader sees alike."""
    return staged(docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), docs[text_col].cast("string").alias("text")), "rows")


def repeated_units(slim: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, row, line, first, end, first_id) of every unit of ``numbered`` rows to be removed; ``first`` and ``end`` count sentences."""
    kind = slim.schema["id"].dataType.simpleString()
    hashed = staged(slim.mapInArrow(_hashed(block_words), f"id {kind}, row long, line boolean, first int, end int, digest binary"), "units")
    place = F.struct(F.col("id").isNull().alias("unknown"), F.col("id"), F.col("row"), F.col("first"))
    # Written first, so that the join below reads two plain tables and a digest of many units can be split.
    tops = staged(hashed.groupBy("digest").agg(F.min(place).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-units")
    later = (F.col("row") != F.col("top.row")) | (F.col("line") & (F.col("first") != F.col("top.first")))
    return hashed.join(tops, "digest").where(later).select("id", "row", "line", "first", "end", F.col("top.id").alias("first_id"))


def judged(text: str, gone: list) -> tuple:
    """(lines, sentences, sentences removed, characters removed, removed spans, kept text) of a text and its removed units."""
    lines = sentences(text)
    total = sum(map(len, lines))
    if not gone:
        return len(lines), total, 0, 0, [], text
    turns = [0] * (total + 1)
    for x in gone:
        turns[x["first"]] += 1
        turns[x["end"]] -= 1
    out = [n > 0 for n in accumulate(turns[:-1])]
    kept, spans, at, place, chars, open_ = [], [], 0, 0, 0, None
    for line in lines:
        rest = []
        for piece in line:
            if out[at]:
                open_ = place if open_ is None else open_
                close, chars = place + len(piece), chars + len(piece)
            else:
                if open_ is not None:
                    spans.append((open_, close))
                open_ = None
                rest.append(piece)
            place += len(piece)
            at += 1
        place += 1
        if rest:
            kept.append("".join(rest))
    if open_ is not None:
        spans.append((open_, close))
    return len(lines), total, sum(out), chars, spans, "\n".join(kept)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.batches(batches, "text"):
        found = [judged(text or "", gone or []) for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())]
        n_lines, n_sentences, removed, chars, spans, kept = zip(*found)
        columns = [pa.array(x, pa.int64()) for x in (n_lines, n_sentences, removed, chars)]
        columns += [pa.array([",".join(f"{a}-{b}" for a, b in x) for x in spans], pa.string()), pa.array(kept, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, batch.column("gone")], ["id", "n_lines", "n_sentences", "n_removed", "removed_chars", "removed_spans", "kept_text", "kept_sha256", "units"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, *, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_sentences, n_removed (sentences), removed_chars, removed_spans, kept_text, kept_sha256, units.

    ``removed_spans`` lists start-end of the removed runs in characters of the
    original text, ``units`` the removed units with the document that keeps each;
    without ``keep_text`` kept_text and units are left out.
    """
    spark = docs.sparkSession

    def build() -> DataFrame:
        slim = numbered(docs, id_col, text_col)
        kind = slim.schema["id"].dataType.simpleString()
        # A table of its own, so that all units and their shuffles are gone before the texts move.
        gone = settled(spark, "gone", lambda: repeated_units(slim, block_words).groupBy("row").agg(F.collect_list(F.struct("first", "end", "line", "first_id")).alias("gone")))
        joined = slim.join(gone, "row", "left").select("id", "text", "gone")
        schema = f"id {kind}, n_lines long, n_sentences long, n_removed long, removed_chars long, removed_spans string, kept_text string, kept_sha256 string, units array<struct<first: int, end: int, line: boolean, first_id: {kind}>>"
        out = joined.mapInArrow(_without, schema)
        return out if keep_text else out.drop("kept_text", "units")

    return settled(spark, "line-dedup", build).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), keep_text=False)


SQL = rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
cut AS (SELECT *, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '[^.!?]*[.!?]+[ \t\v\f\r]*|[^.!?]+') END AS p FROM split),
pieces AS (SELECT doc_id, n, unnest(p) AS piece, generate_subscripts(p, 1) AS k, len(p) AS of FROM cut),
normal AS (
  SELECT *, trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\v\f\r ]+', ' ', 'g'), ' ') AS norm,
         row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i,
         coalesce(sum(length(piece) + CASE WHEN k = of THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM pieces),
full_ AS (
  SELECT *, sum(size) OVER own AS after, sum(size) OVER own - size AS before,
         sum(length(norm) + 1) OVER own AS stop, sum(length(norm) + 1) OVER own - length(norm) AS start
  FROM (SELECT *, len(string_split(norm, ' ')) AS size FROM normal WHERE norm <> '') sized
  WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
whole AS (SELECT doc_id, string_agg(norm, ' ' ORDER BY i) AS body FROM full_ GROUP BY doc_id),
ranges AS (
  SELECT s.doc_id, s.i AS first, e.i AS last, s.start, e.stop
  FROM (SELECT *, before + {BLOCK_WORDS} AS need FROM full_) s ASOF JOIN full_ e ON s.doc_id = e.doc_id AND s.need <= e.after),
blocks AS (SELECT doc_id, first, last, substr(body, CAST(start AS BIGINT), CAST(stop - start AS BIGINT)) AS own FROM ranges JOIN whole USING (doc_id)),
later_blocks AS (SELECT doc_id, first, last FROM (SELECT *, min(doc_id) OVER (PARTITION BY own) AS top FROM blocks) WHERE top < doc_id),
line_units AS (
  SELECT doc_id, n, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\v\f\r ]+', ' ', 'g'), ' ') AS own FROM split),
later_lines AS (SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY doc_id, n) AS r FROM line_units WHERE own <> '') WHERE r > 1),
gone AS (
  SELECT doc_id, unnest(range(first, last + 1)) AS i FROM later_blocks
  UNION SELECT doc_id, i FROM normal JOIN later_lines USING (doc_id, n)),
marked AS (SELECT d.*, g.i IS NOT NULL AS out FROM normal d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.i = g.i),
runs AS (
  SELECT doc_id, min(pos) AS a, max(pos + length(piece)) AS b
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked WHERE out) GROUP BY doc_id, run),
spans AS (SELECT doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id),
lines AS (SELECT doc_id, n, coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE NOT out), '') AS rest, bool_and(out) AS dropped FROM marked GROUP BY doc_id, n),
kept AS (SELECT doc_id, count(*) AS n_lines, coalesce(string_agg(rest, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '') AS kept FROM lines GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE out) AS n_removed, CAST(coalesce(sum(length(piece)) FILTER (WHERE out), 0) AS BIGINT) AS removed_chars FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_sentences, n_removed, removed_chars, coalesce(spans, '') AS removed_spans, sha256(kept) AS kept_sha256
FROM counts JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
