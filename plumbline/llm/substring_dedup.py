"""Byte-exact substring dedup by merging shard Burrows-Wheeler transforms.

Every ``WIDTH``-byte window that also starts in a document of smaller id is
found, and the bytes such windows cover are removed. The work is dealt by
content, so that no task sees the whole corpus:

1. Documents are written in chunks of about 2 MB, ordered by id inside each, as
   a table bucketed by chunk, so that the texts move once.
   Whole texts that an earlier document has are set aside: all their windows
   are later ones, and none of them is a window's only source.
2. A window belongs to its anchor, the ``ANCHOR``-byte string in it with the
   least hash; equal windows have equal anchors at equal places. Hashes of the
   anchors with the bytes that any window around them must hold are counted
   over all chunks (each chunk sends each hash once), and windows whose anchor
   no second document has in that company are done.
3. Runs of remaining windows with one anchor go to the anchor's bucket as one
   string. A string that the chunk already sent for a smaller id is not sent
   again: its windows are all later ones. Runs are counted by anchor in step 2;
   the windows of an anchor with more than ``HOT_RUNS`` go one by one to buckets
   of their own, by a hash of all their bytes, so that equal ones meet.
4. A bucket's strings are split into shards, each shard's transform is built,
   and the transforms are merged by interleave refinement (bwt_merge.py),
   which yields the repeated intervals. Equal strings enter once, with the
   least of their ids.
5. Spans go back to the chunks and are merged to maximal runs.

Defined cases: a null text is an empty one; documents of one id are no sources
for each other; a null id ranks after all ids; ids are integers; texts shorter
than the window lose nothing; repeated rows are judged each for itself; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.bwt_merge import later_windows
from plumbline.llm.shared import discard, settled, shared_folder, shuffle_partitions, staged, table

WIDTH, ANCHOR = 50, 12
REACH = WIDTH - ANCHOR + 1  # windows around one anchor
SIDE = (WIDTH - ANCHOR) // 2  # bytes beside the anchor that a window has on one side at least
LAST = np.iinfo(np.int64).max
#: Text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Windows hashed together.
SEGMENT = 1 << 16
#: Buckets of strings for each shuffle partition: a bucket is merged by one task call.
BUCKETS = 12
#: Runs of an anchor, over all chunks, beyond which its windows are dealt one by one; at most so many anchors (the largest).
HOT_RUNS, HOT_ANCHORS = 1 << 15, 1 << 12
#: Runs of an anchor in a chunk below which the chunk does not report it.
CHUNK_RUNS = 8
COUNTED = np.dtype([("anchor", "<u8"), ("runs", "<i8")])
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
BYTE_CODES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(37))


def rolling(body: np.ndarray, size: int) -> dict[int, tuple[np.ndarray, int]]:
    """Polynomial hashes of the strings of 1, 2, 4 .. bytes (up to ``size``) at every place, with their multipliers."""
    powers, m, step = {1: (BYTE_CODES[body], MULTIPLIER)}, MULTIPLIER, 1
    while 2 * step <= size:
        h = powers[step][0]
        powers[2 * step] = (h[: max(len(h) - step, 0)] * np.uint64(m) + h[step:], m := m * m % (1 << 64))
        step *= 2
    return powers


def hashed(powers: dict[int, tuple[np.ndarray, int]], size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes at every place, or at the places ``at``."""
    n = len(powers[1][0]) - size + 1
    total, done = None, 0
    for step in sorted(powers, reverse=True):
        while size - done >= step:
            h, m = powers[step]
            own = h[done : done + n] if at is None else h[at + done]
            total = own if total is None else total * np.uint64(m) + own
            done += step
    total = (total ^ total >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def _mixed(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at the places ``at``."""
    total = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        total = total * np.uint64(MULTIPLIER) + BYTE_CODES[body[at + k]]
    total = (total ^ total >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def runs(body: np.ndarray, ends: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, inside documents not skipped: (first window, windows, document, anchor place, anchor hash, company hash).

    The company hash covers the anchor with ``SIDE`` bytes on the side where
    the windows have the more.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    # No window starts in a document's last bytes, nor in one that is skipped.
    closed = np.where(skip, starts, np.maximum(starts, ends - WIDTH + 1))
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(len(body) - WIDTH + 1, 0), SEGMENT):
        part = body[begin : begin + SEGMENT + WIDTH - 1]
        n = len(part) - WIDTH + 1
        powers = rolling(part, ANCHOR + SIDE)
        bits = np.uint64(24)
        least = hashed(powers, ANCHOR) >> bits << bits
        least |= np.arange(len(least), dtype=np.uint64)
        span = 1
        while 2 * span <= REACH:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        rest = REACH - span
        least = np.minimum(least[: len(least) - rest], least[rest:])[:n]
        first, last = np.searchsorted(ends, [begin, begin + n], "right")
        last = min(last, len(ends) - 1)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.clip(closed[first : last + 1] - begin, 0, n), 1)
        np.add.at(edge, np.clip(ends[first : last + 1] - begin, 0, n), -1)
        window = np.flatnonzero(np.cumsum(edge[:n]) == 0)
        place = (least[window] & np.uint64((1 << 24) - 1)).astype(np.int64)
        left = place - window >= SIDE
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (left[1:] != left[:-1]) | (window[1:] != window[:-1] + 1)
        lead = np.flatnonzero(new)
        place, left, window = place[lead], left[lead], window[lead]
        company = hashed(powers, ANCHOR + SIDE, np.where(left, place - SIDE, place)) ^ np.where(left, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        anchor = hashed(powers, ANCHOR, place)
        out.append((window + begin, np.diff(np.append(lead, len(new))), np.searchsorted(ends, window + begin, "right"), place + begin, anchor, company))
    if not out:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in words.batches(batches, "text", CHUNK_BYTES):
        by = pc.sort_indices(batch.column("id"), null_placement="at_end")
        at, body = words.raw(words.text_array(batch.column("text").take(by)))
        ids = batch.column("id").take(by)
        columns = [pa.array([part << 32 | n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([at[1:].tolist()], pa.list_(pa.int64())), pa.array([body.tobytes()], pa.binary())]
        n += 1
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "ends", "body"])


def _row(batch: pa.RecordBatch, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, ids with null as the largest, ends, body)."""
    ids = np.array(pc.fill_null(batch.column("ids")[k].values.cast(pa.int64()), int(LAST)), np.int64)
    body = np.frombuffer(batch.column("body")[k].as_buffer(), np.uint8)
    return batch.column("chunk")[k].as_py(), ids, np.array(batch.column("ends")[k].values, np.int64), body


def _skipped(batch: pa.RecordBatch, k: int, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[batch.column("copies")[k].as_py() or []] = True
    return out


def _text_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            chunk, ids, ends, body = _row(batch, k)
            starts = np.concatenate([[0], ends[:-1]])
            long = np.flatnonzero(ends - starts >= WIDTH)
            raw = body.tobytes()
            digests = [hashlib.blake2b(raw[starts[d] : ends[d]], digest_size=16).digest() for d in long]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(long), pa.int64()), pa.array(long.astype(np.int32)), pa.array(ids[long]), pa.array(digests, pa.binary())], ["chunk", "doc", "id", "digest"])


def _company(buckets: int):
    """Each chunk's distinct company hashes and its frequent anchors with their runs, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, ids, ends, body = _row(batch, k)
                found = runs(body, ends, _skipped(batch, k, len(ids)))
                order = _chunk_hashes(ids, *found[2::3])[0]
                bucket = (order % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                packed = [np.ascontiguousarray(order[by[a:b]][:, None].view(np.uint8)[:, 2:7]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                often = _frequent(found[4])
                goal = (often["anchor"] % np.uint64(buckets)).astype(np.int64)
                counted = {b: often[goal == b].tobytes() for b in np.unique(goal).tolist()}
                full = [b for b in range(buckets) if packed[b] or b in counted]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([packed[b] for b in full], pa.binary()), pa.array([counted.get(b, b"") for b in full], pa.binary())], ["bucket", "chunk", "hashes", "anchors"])

    return run


def _frequent(anchor: np.ndarray, least: int = CHUNK_RUNS) -> np.ndarray:
    """The anchors of at least so many runs, with their runs."""
    found, n = np.unique(anchor, return_counts=True)
    out = np.zeros(int((n >= least).sum()), COUNTED)
    out["anchor"], out["runs"] = found[n >= least], n[n >= least]
    return out


def _most(counted: list[bytes], hot_runs: int) -> np.ndarray:
    """The anchors of more than ``hot_runs`` runs in all, the ``HOT_ANCHORS`` largest."""
    parts = np.frombuffer(b"".join(counted), COUNTED)
    found, of = np.unique(parts["anchor"], return_inverse=True)
    out = np.zeros(len(found), COUNTED)
    out["anchor"] = found
    np.add.at(out["runs"], of, parts["runs"])
    out = out[out["runs"] > hot_runs]
    return out[np.argsort(-out["runs"], kind="stable")[:HOT_ANCHORS]]


def _chunk_hashes(ids: np.ndarray, doc: np.ndarray, company: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct company hashes, whether two ids of the chunk have it)."""
    by = np.argsort(company)
    found, owner = company[by], ids[doc[by]]
    lead = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(owner, lead) != np.maximum.reduceat(owner, lead) if len(lead) else np.zeros(0, bool)
    return found[lead], several


def _shared(hot_runs: int):
    """A bitmap for each chunk of the bucket: the hashes that another chunk sent too; as chunk -1 the hot anchors."""

    def run(key: tuple[pa.Scalar, ...], table_: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table_.column("hashes").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, :5] = np.concatenate(parts)
        values = wide.view("<u8").ravel()
        by = np.argsort(values)
        new = np.concatenate([[True], values[by][1:] != values[by][:-1]])
        count = np.diff(np.append(np.flatnonzero(new), len(values)))
        twice = np.zeros(len(values), bool)
        twice[by] = np.repeat(count > 1, count)
        bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(sizes)[:-1])]
        chunks, numbers = table_.column("chunk").to_pylist(), table_.column("bucket").to_pylist()
        if len(hot := _most(table_.column("anchors").to_pylist(), hot_runs)):
            chunks, numbers, bits = [*chunks, -1], [*numbers, numbers[0]], [*bits, hot.tobytes()]
        return pa.Table.from_arrays([pa.array(chunks, pa.int64()), pa.array(numbers, pa.int32()), pa.array(bits, pa.binary())], ["chunk", "bucket", "bits"])

    return run


def _strings(buckets: int, out_buckets: int, hot: np.ndarray):
    """Strings of windows that may repeat, by their anchor's bucket; windows already known to be later ones as spans.

    Windows of ``hot`` anchors are strings by themselves, in the buckets from ``out_buckets`` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, ids, ends, body = _row(batch, k)
                window, size, doc, place, anchor, company = runs(body, ends, _skipped(batch, k, len(ids)))
                known, several = _chunk_hashes(ids, doc, company)
                bucket = (known % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                shared = several.copy()
                for x in batch.column("answers")[k].as_py() or []:
                    a, b = cuts[x["bucket"]], cuts[x["bucket"] + 1]
                    shared[by[a:b]] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
                raw = body.tobytes()
                sent: dict[bytes, int] = {}
                later: list[tuple[int, int]] = []
                out: dict[int, list[tuple[int, int, int, bytes]]] = {}
                good = shared[np.searchsorted(known, company)] if len(known) else np.zeros(0, bool)
                window, size, doc, place, anchor = window[good], size[good], doc[good], place[good], anchor[good]
                # The two sides of one anchor are one string where both may repeat.
                lead = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + size[:-1])])) if len(window) else np.zeros(0, np.int64)
                size = np.add.reduceat(size, lead) if len(lead) else size
                # High bits of the anchor's hash: its low bits are those of its company's bucket.
                goal = ((anchor[lead] >> np.uint64(20)) % np.uint64(out_buckets)).astype(np.int64)
                start, owners = window[lead], ids[doc[lead]]
                if (often := np.isin(anchor[lead], hot)).any():
                    ones = np.repeat(start[often] - (np.cumsum(size[often]) - size[often]), size[often]) + np.arange(int(size[often].sum()))
                    own = _mixed(body, ones)
                    goal = np.concatenate([goal[~often], out_buckets + (own % np.uint64(out_buckets)).astype(np.int64)])
                    start, owners = np.concatenate([start[~often], ones]), np.concatenate([owners[~often], np.repeat(owners[often], size[often])])
                    size = np.concatenate([size[~often], np.ones(len(ones), np.int64)])
                for start, n, b, owner in zip(start.tolist(), size.tolist(), goal.tolist(), owners.tolist()):
                    text = raw[start : start + n + WIDTH - 1]
                    if sent.setdefault(text, owner) < owner:
                        later.append((start, start + n))
                    else:
                        out.setdefault(b, []).append((start, n + WIDTH - 1, owner, text))
                rows = [(b, *map(list, (s, n, i)), b"".join(t), [], []) for b, (s, n, i, t) in ((b, zip(*x)) for b, x in out.items())]
                if later:
                    rows.append((chunk % out_buckets, [], [], [], b"", [s for s, _ in later], [e for _, e in later]))
                if rows:
                    b, s, n, i, t, f, e = zip(*rows)
                    longs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(s, longs), pa.array(n, longs), pa.array(i, longs), pa.array(t, pa.binary()), pa.array(f, longs), pa.array(e, longs)], ["bucket", "chunk", "starts", "sizes", "owners", "strings", "span_starts", "span_ends"])

    return run


def _repeats():
    """The bucket's later windows, as spans of each chunk."""

    def run(key: tuple[pa.Scalar, ...], table_: pa.Table) -> pa.Table:
        def flat(name: str) -> np.ndarray:
            return np.asarray(table_.column(name).combine_chunks().flatten())

        lengths, owners, starts = flat("sizes"), flat("owners"), flat("starts")
        per_row = np.asarray(pc.list_value_length(table_.column("sizes")))
        body = np.frombuffer(b"".join(table_.column("strings").to_pylist()), np.uint8)
        flagged = later_windows(body, lengths, owners, WIDTH)
        begins = np.cumsum(lengths) - lengths
        edge = np.diff(flagged.astype(np.int8), prepend=0, append=0)
        on, off = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        # The last bytes of a string start no window, so a run of flags stays inside its string.
        of = np.searchsorted(begins, on, "right") - 1
        first, last = starts[of] + on - begins[of], starts[of] + off - begins[of]
        row = np.searchsorted(np.cumsum(per_row), of, "right")
        cuts = np.searchsorted(row, np.arange(table_.num_rows + 1))
        spans = [(a + f, b + e) for a, b, f, e in zip(table_.column("span_starts").to_pylist(), table_.column("span_ends").to_pylist(), [first[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:])], [last[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:])])]
        longs = pa.list_(pa.int64())
        return pa.Table.from_arrays([table_.column("chunk"), pa.array([s for s, _ in spans], longs), pa.array([e for _, e in spans], longs)], ["chunk", "span_starts", "span_ends"])

    return run


def _documents(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, ids, ends, body = _row(batch, k)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                edge = np.zeros(len(body) + 1, np.int64)
                for first, last in ((x["span_starts"], x["span_ends"]) for x in batch.column("spans")[k].as_py() or []):
                    np.add.at(edge, np.array(first, np.int64), 1)
                    np.add.at(edge, np.array(last, np.int64) + WIDTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                for d in np.flatnonzero(_skipped(batch, k, len(ids))):
                    gone[starts[d] : ends[d]] = True
                kept, cuts, texts, digests, removed, n_spans = ~gone, [], [], [], [], []
                for a, b in zip(starts, ends):
                    own = gone[a:b]
                    turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                    rest = body[a:b][kept[a:b]].tobytes()
                    cuts.append(turn.tolist())
                    digests.append(hashlib.sha256(rest).hexdigest())
                    removed.append(int(own.sum()))
                    n_spans.append(len(turn) // 2)
                    texts.append(rest)
                columns = [batch.column("ids")[k].values, pa.array(ends - starts), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
                if keep_text:
                    columns += [pa.array(cuts, pa.list_(pa.int64())), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(columns)])

    return run


def chunked(slim: DataFrame, name: str) -> DataFrame:
    """The chunks as a table bucketed by chunk, in the shared folder: what is joined to it later moves, the texts do not."""
    spark, n = slim.sparkSession, shuffle_partitions(slim.sparkSession)
    kind = slim.schema["id"].dataType.simpleString()
    found = slim.mapInArrow(_chunks, f"chunk long, ids array<{kind}>, ends array<long>, body binary")
    found.repartition(n, "chunk").write.bucketBy(n, "chunk").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def beside(chunks: DataFrame, small: DataFrame) -> DataFrame:
    """``chunks`` with the columns of ``small``, which has a row a chunk at most."""
    return chunks.join(small.hint("shuffle_hash"), "chunk", "left")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    ``keep_text`` adds ``spans`` (starts and ends of the removed runs, in
    bytes, in turn) and ``kept`` (the bytes that stay; a cut inside a character
    leaves part of it). ``hot_runs`` does not change the result.
    """
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    chunks = f"substring_chunks_{uuid.uuid4().hex}"
    try:
        return settled(spark, "substring-dedup", lambda: _found(chunked(slim, chunks), slim.schema["id"].dataType.simpleString(), keep_text, hot_runs)).withColumnRenamed("id", id_col)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {chunks}")
        discard(spark, f"{shared_folder(spark)}/{chunks}")


def _found(chunks: DataFrame, kind: str, keep_text: bool, hot_runs: int) -> DataFrame:
    spark = chunks.sparkSession
    hashes = staged(chunks.mapInArrow(_text_hashes, "chunk long, doc int, id long, digest binary"), "text-hashes")
    firsts = staged(hashes.groupBy("digest").agg(F.min("id").alias("top"), F.max("id").alias("low")).where("top < low").drop("low"), "first-texts")
    copies = hashes.join(firsts, "digest").where("id > top").groupBy("chunk").agg(F.collect_list("doc").alias("copies"))
    chunks = beside(chunks, staged(copies, "copies"))

    buckets = shuffle_partitions(spark)
    sent = chunks.mapInArrow(_company(buckets), "bucket int, chunk long, hashes binary, anchors binary")
    answers = sent.groupBy("bucket").applyInArrow(_shared(hot_runs), "chunk long, bucket int, bits binary")
    answers = staged(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), "answers")
    # Few: at most HOT_ANCHORS of each bucket, all of more than hot_runs runs.
    counted = [x.bits for row in answers.where("chunk = -1").collect() for x in row.answers]
    hot = _most([bytes(x) for x in counted], hot_runs)["anchor"]
    asked = beside(chunks, answers)

    strings = asked.mapInArrow(_strings(buckets, BUCKETS * buckets, hot), "bucket int, chunk long, starts array<long>, sizes array<long>, owners array<long>, strings binary, span_starts array<long>, span_ends array<long>")
    spans = strings.groupBy("bucket").applyInArrow(_repeats(), "chunk long, span_starts array<long>, span_ends array<long>")
    spans = staged(spans.where("size(span_starts) > 0").groupBy("chunk").agg(F.collect_list(F.struct("span_starts", "span_ends")).alias("spans")), "spans")
    found = beside(chunks, spans)
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<long>, kept binary" if keep_text else "")
    return found.mapInArrow(_documents(keep_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
