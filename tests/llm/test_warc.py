"""WARC archives: the query against SQL and brute force, the files themselves, the index and its range reads."""

import glob
import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(pages):
    """Rows by brute force; of rows that repeat id and payload one is the response."""
    groups = {}
    for page, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, page in enumerate(ids):
            revisit = k > 0 and len(body) >= 100
            out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_on_the_small_table(spark, small):
    found = warc.query(spark, small)
    assert found.columns == COLUMNS
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    sql = sorted((tuple(r) for r in duck.sql(warc.SQL).select(*map(duckdb.ColumnExpression, COLUMNS)).fetchall()), key=str)
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(found) == sql == expected(pages)


@pytest.fixture(scope="module")
def messy_pages():
    long = "<p>long</p>" * 100_000
    same = "<html><body>" + "the same words again " * 10 + "</body></html>"
    out = [
        (1, "http://a.Example.com/x?y=1#z", same),
        (2, None, same),
        (3, "", None),
        (4, "no scheme", ""),
        (5, "https://example.com/tab\tnew\nline end\x7f", same),
        (5, "https://example.com/tab\tnew\nline end\x7f", same),
        (None, "https://example.com/", same),
        (None, None, None),
        (6, "https://example.com", "Größe 日本 \x00 \r\n\r\n" * 20),
        (7, "https://example.com", "short"),
        (8, "https://example.com", "short"),
        (9, "https://b.example.com/long", long),
        (-4, "https://b.example.com/long", long),
        (10, "https://" + "deep." * 2000 + "org/" + "p" * 5000, "x" * 99),
        (11, "https://dup.net/", "x" * 99),
        (12, "https://dup.net/", "x" * 100),
        (13, "https://dup.net/", "x" * 100),
    ]
    return out + [(100 + n, "http://hot.org/one", f"<p>{'page ' * 30}{n % 40}</p>") for n in range(400)] + [(600 + n, f"http://s{n % 7}.org/{n}", same) for n in range(300)]


@pytest.fixture(scope="module")
def frame(spark, messy_pages):
    df = spark.createDataFrame(messy_pages, "page_id bigint, url string, html string")
    return df.withColumns({n: F.lit("clash") for n in ["row_key", "digest", "top", "of", "key", "id", "file", "offset", "low", "n", "odd name-1"]}).repartition(4)


def test_messy_pages(frame, messy_pages):
    assert rows(warc.archived(frame, block_lines=7)) == expected(messy_pages)
    assert warc.archived(frame.where("false")).count() == 0


def test_join_beyond_the_broadcast(frame, messy_pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert rows(warc.archived(frame)) == expected(messy_pages)


@pytest.fixture(scope="module")
def written(frame, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    warc.write_archive(frame, folder, block_lines=11)
    return folder


def test_files_are_warc(written, messy_pages):
    """Every record by plain gzip: as many as pages, in members of their own, with their urls and payloads."""
    bodies, kinds = [], []
    for path in glob.glob(f"{written}/archive/*.warc.gz"):
        raw = gzip.open(path).read()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            if kinds[-1] == "response":
                bodies.append(rest[:size].partition(b"\r\n\r\n")[2])
            raw = rest[size + 4 :]
    files = len(glob.glob(f"{written}/archive/*"))
    assert kinds.count("warcinfo") == files and len(kinds) == len(messy_pages) + files
    want = [(html or "").encode() for _, _, html in messy_pages]
    assert sorted(bodies) == sorted([b for b in set(want) if len(b) >= 100] + [b for b in want if len(b) < 100])


def reversed_key(url):
    url = url or ""
    host, rest = "", url
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return ",".join(reversed(host.split("."))) + ")" + rest


def test_lookup(spark, written, messy_pages):
    """Exact keys, ranges (a host with its subdomains) and keys that are not there, each equal to a scan."""
    keys = [(reversed_key(url), page) for page, url, _ in messy_pages]
    assert "com,example,a)/x?y=1#z" in {k for k, _ in keys}
    asked = [(k, k) for k in sorted({k for k, _ in keys})] + [("com,example", "com,example\U0010ffff"), ("zzz", "zzzz"), ("", "\x00"), ("org,hot)/one", "org,s3)/9")]
    wanted = spark.createDataFrame(asked, "low string, high string")
    found = [(r.key, r.id) for r in warc.lookup(spark, written, wanted).collect()]
    assert sorted(found, key=str) == sorted(((k, None if p is None else str(p)) for low, high in asked for k, p in keys if low <= k <= high), key=str)


def test_directory_is_sparse(written):
    """An exact key opens the blocks that hold it and no other."""
    import pyarrow.fs

    fs = pyarrow.fs.LocalFileSystem()
    total = 0
    for path in glob.glob(f"{written}/index/*"):
        index = warc.IndexFile(fs, path)
        total += sum(b[3] for b in index.blocks)
        assert all(b[3] <= 11 for b in index.blocks)
        if len(index.blocks) > 3:
            index.block(2)
            key = index.keys[5]
            other = warc.IndexFile(fs, path)
            assert [key] * len(found := [c for c in other.between(key, key)]) == [c[0] for c in found] and found
            blocks = sum(b[0] <= key for b in other.blocks) - max(sum(b[0] < key for b in other.blocks) - 1, 0)
            assert other.reads <= blocks
    assert total == 717


def test_payloads_come_back(spark, written, messy_pages):
    captures = warc.lookup(spark, written, spark.createDataFrame([("", "\U0010ffff")], "low string, high string"))
    found = warc.read_records(captures, written, id_type="long", with_payload=True).collect()
    assert sorted((r.id, r.payload_digest) for r in found if r.id) == sorted((p, hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in messy_pages if p)
    by_id = {p: (u, (h or "").encode()) for p, u, h in messy_pages if p}
    for r in found:
        if r.id:
            url, body = by_id[r.id]
            assert (r.payload is None) == (r.record_type == "revisit") and r.payload in (None, body)
            assert (r.url is None) == (url is None)


def test_damage_is_found(frame, spark, tmp_path):
    warc.write_archive(frame, str(tmp_path))
    everything = warc.lookup(spark, str(tmp_path), spark.createDataFrame([("", "\U0010ffff")], "low string, high string"))
    spot = everything.where("id = '8'").first()  # a short payload is no revisit
    path = f"{tmp_path}/archive/{spot.file}"
    raw = bytearray(open(path, "rb").read())
    payload = warc._unpacked(bytes(raw[spot.offset : spot.offset + spot.length]))
    again = warc._packed(payload.replace(b"sha256:", b"sha256:0", 1))
    with open(path, "wb") as f:
        f.write(raw[: spot.offset] + again + raw[spot.offset + spot.length :])
    one = everything.where((F.col("file") == spot.file) & (F.col("offset") == spot.offset)).withColumn("length", F.lit(len(again)).cast("long"))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_records(one, str(tmp_path)).collect()
