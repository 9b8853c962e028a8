"""WARC archives of pages with a two-level capture index.

Writing: a page's payload is its html in UTF-8. Of equal payloads (by SHA-256)
the row with the smallest id is a response and the others are revisits that
refer to it; one small row a repeated payload decides that, pre-aggregated
where it is read. Every task writes its pages as gzip members of ``.warc.gz``
files and reports where each record lies.

Index: the captures are range-partitioned and sorted by reversed-host URL key
(then id and place, so one host or URL with a third of all pages is spread over
many files). A task writes its range as compressed blocks of ``BLOCK_LINES``
captures, followed by the sparse directory of their first keys. The root, one
line an index file, is a small table.

Reading: a wanted key or range of keys is routed by the root to its index
files, binary-searched in their directories, and only the blocks that can hold
it are read; the captures found are sorted by place, neighbouring records are
read together, and every payload's digest is checked.

Files are written and read with pyarrow's file systems, so the folder can be
wherever all executors and pyarrow reach (shared paths, object stores, HDFS).
A file has the name of one task attempt; only files of attempts that Spark
committed are in the index, the others are deleted.

Defined cases: a null html is empty; a null url has the key of an empty one;
a null id is larger than any other; of rows that repeat id and payload exactly
one is the response; control characters of a url are percent-coded in the
record's header; an empty table gives archives without records; other columns
are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import discard, drop, settled, shared_folder, shuffle_partitions, staged, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
#: Bytes after which an archive file is closed, captures in an index block, and characters of a key in the root.
ARCHIVE_BYTES, BLOCK_LINES, ROOT_CHARS = 1 << 30, 3000, 256
#: Repeated payloads up to which their table is broadcast (some 100 bytes each); beyond it the join is by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes read in one go, and the gap between two records that is read over.
READ_BYTES, READ_GAP = 4 << 20, 64 << 10
LEVEL = 6
CAPTURE = "key string, id string, file string, offset long, length long"

# The record format's words.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, and what follows the host: ``http://a.Example.com/x`` is ``com,example,a)/x``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(url, r"^(?s).*?://[^/?#]*", ""))


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _name() -> str:
    return f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"


def _record_id(page: str | None, key: int) -> str:
    return f"<urn:plumbline:page:{'none' if page is None else 'id:' + quote(page, safe='')}:{key}>"


def _page_of(record_id: str) -> str | None:
    kind, _, rest = record_id.removeprefix("<urn:plumbline:page:").partition(":")
    return unquote(rest.rpartition(":")[0]) if kind == "id" else None


def record(page: str | None, key: int, url: str | None, payload: bytes, digest: str, refers: tuple[str | None, int] | None, date: str) -> bytes:
    """One uncompressed record; a revisit has the response's HTTP head and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_record_id(page, key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(*refers)}"]
    head += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(headers, HTTP headers, payload) of a record."""

    def fields(head: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    named = fields(head)
    http, _, payload = rest[: int(named["Content-Length"])].partition(b"\r\n\r\n")
    return named, fields(http), payload


def _packed(raw: bytes) -> bytes:
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return coder.compress(raw) + coder.flush()


def _unpacked(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


def _archive(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _place(folder)
        sink, name = None, ""
        try:
            for batch in batches:
                rows = []
                for key, page, url, html, digest, top_page, top_key, surt in zip(*(batch.column(c).to_pylist() for c in ("row_key", "page", "url", "html", "digest", "top_page", "top_key", "surt"))):
                    if sink is None or sink.tell() >= ARCHIVE_BYTES:
                        if sink is not None:
                            sink.close()
                        name = f"{_name()}.warc.gz"
                        sink = fs.open_output_stream(f"{top}/{name}", compression=None)
                        sink.write(_packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n".encode()))
                    refers = None if top_key is None or top_key == key else (top_page, top_key)
                    packed = _packed(record(page, key, url, html.encode(), digest, refers, date))
                    rows.append((surt, page, name, sink.tell(), len(packed)))
                    sink.write(packed)
                if rows:
                    yield _batch(rows)
        finally:
            if sink is not None:
                sink.close()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "id", "file", "offset", "length"])


def _index(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _place(folder)
        sink, name, directory, held = None, f"{_name()}.idx.gz", [], []
        last = ""

        def close() -> None:
            block = _packed(json.dumps(held).encode())
            directory.append((held[0][0], sink.tell(), len(block), len(held)))
            sink.write(block)
            held.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                sink = sink or fs.open_output_stream(f"{top}/{name}", compression=None)
                held.append(line)
                last = line[0]
                if len(held) == lines:
                    close()
        if sink is None:
            return
        if held:
            close()
        tail = _packed(json.dumps(directory).encode())
        sink.write(tail + len(tail).to_bytes(8, "little"))
        sink.close()
        rows = [[name], [directory[0][0][:ROOT_CHARS]], [last[:ROOT_CHARS]], [sum(d[3] for d in directory)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["file", "low", "high", "captures"])

    return run


def _tidy(spark: SparkSession, folder: str, named: set[str]) -> None:
    """Delete the files of attempts that did not count."""
    fs, top = _place(folder)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(top)):
        if info.base_name not in named:
            fs.delete_file(info.path)


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE, block_lines: int = BLOCK_LINES) -> None:
    """Write ``pages`` to ``folder``: archive/*.warc.gz, index/*.idx.gz and the index's root."""
    spark = pages.sparkSession
    for part in ("archive", "index"):
        fs, top = _place(f"{folder}/{part}")
        fs.create_dir(top, recursive=True)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    # The key tells rows that repeat an id apart; it is written once, so that every reader sees the same.
    rows = staged(pages.select(F.monotonically_increasing_id().alias("row_key"), pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")), "warc-pages")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_key"))
    repeated = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(first.alias("top"), F.count("*").alias("n")).where("n > 1")
    repeated = staged(repeated.select(F.col("digest").alias("of"), F.col("top.page_id").cast("string").alias("top_page"), F.col("top.row_key").alias("top_key")), "warc-repeated")
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(repeated) if few else repeated, rows["digest"] == repeated["of"], "left")
    joined = joined.select("row_key", F.col("page_id").cast("string").alias("page"), "url", "html", "digest", "top_page", "top_key", url_key(F.col("url")).alias("surt"))
    captures = staged(joined.mapInArrow(_archive(f"{folder}/archive", date), CAPTURE), "warc-captures")
    drop(rows)
    drop(repeated)
    _tidy(spark, f"{folder}/archive", {r.file for r in captures.select("file").distinct().collect()})

    ordered = captures.repartitionByRange(shuffle_partitions(spark), "key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
    ordered.mapInArrow(_index(f"{folder}/index", block_lines), "file string, low string, high string, captures long").write.parquet(f"{folder}/root")
    drop(captures)
    _tidy(spark, f"{folder}/index", {r.file for r in spark.read.parquet(f"{folder}/root").select("file").collect()})


def _route(root: list[tuple[str, str, str]]):
    lows, highs, files = [r[1] for r in root], [r[2] for r in root], [r[0] for r in root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()):
                for k in range(bisect.bisect_left(highs, low[:ROOT_CHARS]), bisect.bisect_right(lows, high[:ROOT_CHARS])):
                    out.append((files[k], low, high))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["file", "low", "high"])

    return run


class IndexFile:
    """An open index file: its directory and the block last read."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.source = fs.open_input_file(path)
        size = self.source.size()
        tail = int.from_bytes(self.source.read_at(8, size - 8), "little")
        self.blocks = json.loads(_unpacked(self.source.read_at(tail, size - 8 - tail)))
        self.firsts = [b[0] for b in self.blocks]
        self.at, self.lines, self.keys, self.reads = -1, [], [], 0

    def block(self, k: int) -> None:
        if k != self.at:
            _, offset, length, _ = self.blocks[k]
            self.lines = json.loads(_unpacked(self.source.read_at(length, offset)))
            self.at, self.keys, self.reads = k, [line[0] for line in self.lines], self.reads + 1

    def between(self, low: str, high: str) -> Iterator[list]:
        """Captures with ``low <= key <= high``, in order."""
        k = max(bisect.bisect_left(self.firsts, low) - 1, 0)
        while k < len(self.blocks) and self.firsts[k] <= high:
            self.block(k)
            lines = self.lines[bisect.bisect_left(self.keys, low) : bisect.bisect_right(self.keys, high)]
            yield from lines
            k += 1


def _search(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _place(folder)
        index, name = None, None
        for batch in batches:
            out: list[tuple] = []
            for file, low, high in zip(*(batch.column(c).to_pylist() for c in ("file", "low", "high"))):
                if file != name:
                    if index is not None:
                        index.source.close()
                    index, name = IndexFile(fs, f"{top}/{file}"), file
                for line in index.between(low, high):
                    out.append(tuple(line))
                    if len(out) == 10_000:
                        yield _batch(out)
                        out.clear()
            if out:
                yield _batch(out)

    return run


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Captures (key, id, file, offset, length) for the ranges ``low`` to ``high`` of keys in ``wanted``.

    A row of ``wanted`` with ``low`` equal to ``high`` asks for one key. Ranges that
    overlap give their captures once for each.
    """
    # One line an index file, of at most 256 characters a key: bounded by the partitions they were written from.
    root = sorted((r.low, r.high, r.file) for r in spark.read.parquet(f"{folder}/root").collect())
    routed = wanted.select("low", "high").mapInArrow(_route([(f, low, high) for low, high, f in root]), "file string, low string, high string")
    return routed.repartitionByRange(shuffle_partitions(spark), "file", "low", "high").sortWithinPartitions("file", "low", "high").mapInArrow(_search(f"{folder}/index"), CAPTURE)


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Slices of (offset, length) pairs to read in one go."""
    start = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][0] - sum(rows[k - 1]) > READ_GAP or sum(rows[k]) - rows[start][0] > READ_BYTES:
            yield start, k
            start = k


def _records(folder: str, with_payload: bool):
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def read(raw: bytes, where: str) -> tuple:
        named, http, payload = parse(_unpacked(raw))
        digest, size, revisit = named["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"]), named["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged record in {where}")
        return _page_of(named["WARC-Record-ID"]), size, digest, named["WARC-Type"], _page_of(named["WARC-Refers-To"]) if revisit else None, *([named.get("WARC-Target-URI"), None if revisit else payload] if with_payload else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _place(folder)
        source, name = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            k = 0
            while k < len(files):
                stop = k
                while stop < len(files) and files[stop] == files[k]:
                    stop += 1
                if files[k] != name:
                    if source is not None:
                        source.close()
                    source, name = fs.open_input_file(f"{top}/{files[k]}"), files[k]
                spots = list(zip(offsets[k:stop], lengths[k:stop]))
                for a, b in _ranges(spots):
                    base = spots[a][0]
                    raw = source.read_at(sum(spots[b - 1]) - base, base)
                    found = [read(raw[o - base : o - base + n], f"{name} at {o}") for o, n in spots[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
                k = stop

    return run


def read_records(captures: DataFrame, folder: str, *, id_type: str = "string", with_payload: bool = False) -> DataFrame:
    """The records at ``captures``: id, payload_bytes, payload_digest, record_type, refers_to (with_payload: url, payload; a revisit's is null)."""
    spark = captures.sparkSession
    ordered = captures.select("file", "offset", "length").repartitionByRange(shuffle_partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", url string, payload binary" * with_payload
    found = ordered.mapInArrow(_records(f"{folder}/archive", with_payload), schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """Write ``pages``, look every url of theirs up in the index and read what it names; the archives go, the rows stay."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"

    def rows() -> DataFrame:
        write_archive(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col, **how)
        keys = pages.select(url_key(pages[url_col]).alias("low")).distinct()
        found = staged(lookup(spark, folder, keys.select("low", F.col("low").alias("high"))), "warc-found")
        return read_records(found, folder, id_type=pages.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)

    try:
        return settled(spark, "warc-rows", rows)
    finally:
        discard(spark, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS bytes FROM pages),
     r AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS top, row_number() OVER (PARTITION BY body ORDER BY page_id) AS place FROM p)
SELECT page_id, bytes AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND place > 1 THEN top END AS refers_to
FROM r
"""
