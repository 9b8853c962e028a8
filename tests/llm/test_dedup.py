"""Exact, line, substring and near-duplicate dedup against brute force."""

import collections
import hashlib
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bwt_merge, exact_dedup, jaccard_join, line_dedup, substring_dedup
from plumbline.llm.components import components
from plumbline.llm.queries import ORACLES, QUERIES


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df, sql = QUERIES[name](spark, small), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("largest", [False, True])
def test_exact_dedup_of_a_hot_text_over_many_ranges(spark, partitions, largest):
    texts = ["hot" if n % 3 else f"t{n % 50}" for n in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    by = collections.defaultdict(list)
    for n, t in enumerate(texts):
        by[t].append(n)
    for r in exact_dedup.exact_dedup(df, largest=largest, partitions=partitions).collect():
        group = by[texts[r.doc_id]]
        keep = (max if largest else min)(group)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(group), r.doc_id == keep, hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_exact_dedup_messy(messy, no_docs):
    out = exact_dedup.exact_dedup(messy, largest=True).collect()
    assert len(out) == 15
    by = collections.defaultdict(list)
    for r in out:
        by[r.text_sha256].append(r)
    for group in by.values():
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)}
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids) if ids else None}
    assert len(by[hashlib.sha256(b"").hexdigest()]) == 3
    kept = exact_dedup.kept_rows(messy)
    assert kept.columns == messy.columns and kept.count() == len(by)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    lower = exact_dedup.exact_dedup(messy, normalise=lambda c: __import__("pyspark.sql.functions", fromlist=["lower"]).lower(c))
    assert lower.count() == 15


def test_line_dedup_messy(messy, no_docs):
    out = line_dedup.line_dedup(messy).collect()
    passage = next(r for r in out if r.doc_id == 8)
    assert passage.n_removed == 0 and not passage.units
    nine = sorted((r for r in out if r.doc_id == 9), key=lambda r: r.kept_text)
    # Both lose the passage, and the later row of the id the short line too.
    assert [r.kept_text for r in nine] == ["", "something else"] and nine[1].removed_spans.startswith("15-")
    assert {u.first_id for r in nine for u in r.units} == {8, 9}
    assert next(r for r in out if r.doc_id is None and r.n_lines == 2).kept_text == "no id here"
    assert len(out) == 15 and line_dedup.line_dedup(no_docs).count() == 0


def test_line_dedup_judges_each_row_of_an_id_by_itself(spark):
    copy, mine, other = (" ".join(f"{w}{n}" for n in range(25)) for w in ("copy", "mine", "other"))
    docs = [(1, f"head\n{copy}"), (None, f"a\n{copy}"), (None, f"b\n{mine}"), (7, f"c\n{copy}"), (7, f"d\n{other}"), (8, other), (8, f"e\n{other}"), (9, copy), (9, copy)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.kept_text, str(sorted({u.first_id for u in r.units or []}))) for r in line_dedup.line_dedup(df).collect())
    want = [(1, f"head\n{copy}", []), (None, "a", [1]), (None, f"b\n{mine}", []), (7, "c", [1]), (7, f"d\n{other}", []), (8, "", [7]), (8, "e", [7]), (9, "", [1]), (9, "", [1])]
    assert got == sorted((str(i), t, str(f)) for i, t, f in want)


def test_line_dedup_finds_passages_inside_lines_and_short_lines(spark):
    passage = " ".join(f"Sentence {n} of the passage goes on for some words." for n in range(9))
    docs = [(1, f"Own start. {passage} Own end.\nShort line"), (2, f"Other words come first, {passage} and others follow.\nshort  LINE\nlast"), (3, "la la. " * 40)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert out[1].n_removed == out[3].n_removed == 0  # what a document repeats inside its own lines stays
    assert out[2].kept_text.split("\n") == ["Other words come first, Sentence 0 of the passage goes on for some words. and others follow.", "last"]
    spans = [tuple(map(int, x.split("-"))) for x in out[2].removed_spans.split(",")]
    assert docs[1][1][spans[0][0] : spans[0][1]].startswith("Sentence 1 of") and sum(b - a for a, b in spans) == out[2].removed_chars


def brute_windows(docs, width):
    first = {}
    for i, t in docs:
        for p in range(len(t) - width + 1):
            k = t[p : p + width]
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                gone[p : p + width] = True
        turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        out.setdefault(i, []).append((len(t), int(gone.sum()), len(turn) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def substring_result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id if r.doc_id is not None else 1 << 62, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {i: sorted(x) for i, x in out.items()}


def some_strings(rng, width):
    texts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 20 + width))).astype(np.uint8)) for _ in range(int(rng.integers(1, 12)))]
    texts += [t[int(rng.integers(0, len(t))) :] for t in texts[::2]]
    ids = rng.integers(0, 6, len(texts))
    first = {}
    for t, i in zip(texts, ids):
        for p in range(len(t) - width + 1):
            first[t[p : p + width]] = min(first.get(t[p : p + width], 99), i)
    want = [p + width <= len(t) and bool(first[t[p : p + width]] < i) for t, i in zip(texts, ids) for p in range(len(t))]
    return (np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), ids, width), want


@pytest.mark.parametrize("shard", [1 << 20, 40, 7])
def test_bwt_merge_against_brute_force(monkeypatch, shard):
    monkeypatch.setattr(bwt_merge, "SHARD_SYMBOLS", shard)
    rng = np.random.default_rng(shard)
    for _ in range(120):
        strings, want = some_strings(rng, int(rng.choice([2, 6, 8, 10, 26, 50])))
        assert bwt_merge.later_windows(*strings).tolist() == want


@pytest.mark.parametrize("width", [6, 16])
def test_bwt_merge_needs_the_shards_order(monkeypatch, width):
    """The places of the merge follow from the order of each shard: with scrambled shards they are wrong."""
    monkeypatch.setattr(bwt_merge, "SHARD_SYMBOLS", 200)
    rng = np.random.default_rng(4)
    cases = [some_strings(rng, width) for _ in range(20)]
    assert all(bwt_merge.later_windows(*strings).tolist() == want for strings, want in cases)
    real = bwt_merge.string_order
    monkeypatch.setattr(bwt_merge, "string_order", lambda *a: np.random.default_rng(1).permutation(real(*a)))
    assert sum(bwt_merge.later_windows(*strings).tolist() != want for strings, want in cases) > 4


def test_scratch_tables_are_dropped(spark, small):
    before = {t.name for t in spark.catalog.listTables()}
    assert substring_dedup.query(spark, small).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_substring_dedup_small_table(spark, small):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert substring_result(substring_dedup.query(spark, small)) == brute_windows(docs, 50)


def test_substring_dedup_messy(spark, messy, no_docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1000)
    docs = [(r.doc_id if r.doc_id is not None else 1 << 62, (r.text or "").encode()) for r in messy.select("doc_id", "text").collect()]
    assert substring_result(substring_dedup.substring_dedup(messy)) == brute_windows(docs, 50)
    assert substring_dedup.substring_dedup(no_docs).count() == 0
    kept = {r.doc_id: r for r in substring_dedup.substring_dedup(messy, keep_text=True).collect()}
    assert bytes(kept[7].kept) and len(kept[7].spans) == 2 * kept[7].n_spans


def hot_line_docs(n):
    rng = np.random.default_rng(5)
    line, edges = b"this line of forty odd bytes is all over", [bytes(rng.integers(97, 123, 60).astype(np.uint8)) for _ in range(2 * n)]
    # Every tenth document shares its neighbours with an earlier one.
    return [(i, edges[2 * (i // 10 if i % 10 == 9 else i)] + line + edges[2 * i + 1][: i % 60] + b"\0" * (i % 3)) for i in range(n)]


@pytest.mark.parametrize("hot_runs", [20, 1 << 30])
def test_substring_dedup_of_a_line_with_many_neighbours(spark, hot_runs):
    docs = hot_line_docs(300)
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id bigint, text string").repartition(4)
    assert substring_result(substring_dedup.substring_dedup(df, hot_runs=hot_runs)) == brute_windows(docs, 50)


def test_hot_anchor_is_dealt_over_buckets():
    docs, longs = hot_line_docs(600), pa.list_(pa.int64())
    ends, body = np.cumsum([len(t) for _, t in docs]), b"".join(t for _, t in docs)
    columns = {"chunk": pa.array([0]), "ids": pa.array([[i for i, _ in docs]], longs), "ends": pa.array([ends.tolist()], longs), "body": pa.array([body], pa.binary()), "copies": pa.array([None], pa.list_(pa.int32())), "answers": pa.array([None], pa.list_(pa.int32()))}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sent = [x for out in substring_dedup._company(4)(iter([batch])) for x in out.column("anchors").to_pylist()]
    hot = substring_dedup._most(sent, 200)["anchor"]
    assert 0 < len(hot) < 10

    def largest(anchors):
        out = pa.Table.from_batches(substring_dedup._strings(4, 64, anchors)(iter([batch])))
        sizes = dict(zip(out.column("bucket").to_pylist(), map(len, out.column("strings").to_pylist())))
        return max(sizes.values()), sum(sizes.values())

    before, after = largest(hot[:0]), largest(hot)
    assert before[0] > before[1] / 4 and after[0] < after[1] / 16


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_jaccard(docs, k, percent):
    sets = collections.defaultdict(list)
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i].append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (sorted(len(s) for s in sets[i]), find(i)) for i in ids}


def jaccard_result(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append((r.n_shingles, r.component_id))
    return {i: (sorted(n for n, _ in x), x[0][1]) for i, x in out.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_small_table(spark, small, k, percent):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = jaccard_result(jaccard_join.jaccard_components(docs, k=k, percent=percent))
    assert got == brute_jaccard([tuple(r) for r in docs.collect()], k, percent)


def test_jaccard_near_copies_around_the_threshold(spark):
    rng = np.random.default_rng(3)
    base, docs = [f"w{n}" for n in range(120)], []
    for n in range(150):
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(0, 5)), replace=False):
            w[at] = f"x{n}_{at}"
        docs.append((n, " ".join(w[: int(rng.integers(100, 121))])))
    docs += [(200 + n, f"short text {n % 3}") for n in range(9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert jaccard_result(jaccard_join.jaccard_components(df, k=3, percent=90)) == brute_jaccard(docs, 3, 90)


@pytest.mark.parametrize(("k", "percent"), [(1, 50), (1, 60), (2, 60), (1, 70), (3, 70)])
def test_jaccard_at_low_thresholds_with_hot_tokens(spark, k, percent, monkeypatch):
    """Small sets that share few tokens, a token in every third document, prefixes that get a new order."""
    monkeypatch.setattr(jaccard_join, "MANY", 4)
    rng = np.random.default_rng(percent + k)
    docs = [(1, "a b q r"), (2, "a b"), (3, "a b c")]
    docs += [(10 + n, " ".join(["hot"] * (n % 3 == 0) + [f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(1, 12))) % 60])) for n in range(220)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert jaccard_result(jaccard_join.jaccard_components(df, k=k, percent=percent)) == brute_jaccard(docs, k, percent)


def test_jaccard_messy(messy, no_docs):
    out = jaccard_join.jaccard_components(messy, k=3, percent=90).collect()
    assert len(out) == 15
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert got[2].component_id == 1 and got[7].component_id == 6
    assert all(got[i].n_shingles == 0 and got[i].component_id == i for i in (3, 4, 5)) and got[12].n_shingles == 1
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert jaccard_join.jaccard_components(no_docs, k=3, percent=90).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 140)] + [(7, 7)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[n] == 0 for n in range(61)) and all(got[n] == 100 for n in range(100, 140))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert os.path.isabs(__file__)
