"""Token ids, packing and the token files: equality with the tokenizer, exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import packing, rangecoder, token_output, tokenids, words

TOKENS = tokenids.token_ids(tokenids.default_path())


def direct(text):
    return TOKENS.tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("abÀß µ'sS.,19²\t\n\x1c\x85\xa0<|>", max_size=30)), max_size=6))
def test_ids_equal_the_tokenizers(texts):
    at, ids = TOKENS.encode(words.text_array(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [direct(t) for t in texts]


@pytest.mark.parametrize("text", ["a<|endoftext|>B", "<|startoftext|>", "İstanbul ΣΑΣ", "it's DON'T", "x\u0000y", "日本 中"])
def test_ids_of_odd_texts(text):
    at, ids = TOKENS.encode(words.text_array(pa.array([text, "plain words", text])))
    assert ids[at[0] : at[1]].tolist() == ids[at[2] : at[3]].tolist() == direct(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=400), st.sampled_from([1, 7, 64, 2048]))
def test_range_coder_round_trip(ids, block):
    coded = rangecoder.encode(np.array(ids, np.uint32), block)
    assert rangecoder.decode(coded).tolist() == ids


def test_range_coder_compresses_and_detects_damage():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 50_000), 49_000).astype(np.uint32)
    ids[20_000:30_000] = ids[:10_000]
    coded = rangecoder.encode(ids)
    assert (rangecoder.decode(coded) == ids).all() and len(coded) < len(ids) * 2 * 0.75
    broken = bytearray(coded)
    broken[-40] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode(bytes(broken))
    with pytest.raises(ValueError, match="segment"):
        rangecoder.decode(b"????" + coded[4:])
    with pytest.raises(ValueError, match="65535"):
        rangecoder.encode(np.array([70_000]))


def stream(df):
    return [tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


def expected_stream(docs):
    out, at = [], 0
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = [*direct(text), 2]
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files_small_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert stream(token_output.query(spark, small)) == expected_stream(docs)


def test_token_files_messy(spark, messy, no_docs, tmp_path):
    token_output.write_tokens(messy, str(tmp_path / "a"), segment_ids=500)
    docs = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    assert stream(token_output.read_tokens(spark, str(tmp_path / "a"))) == expected_stream(docs)
    first = token_output.read_tokens(spark, str(tmp_path / "a"), with_ids=True).where("doc_id = 1").first()
    assert first.ids == [*direct(docs[[d[0] for d in docs].index(1)][1]), 2]
    token_output.write_tokens(no_docs, str(tmp_path / "b"))
    assert token_output.read_tokens(spark, str(tmp_path / "b")).count() == 0


def check_packing(found, docs):
    want = {}
    for i, text in docs:
        ids = [*direct(text), 0]
        for p in range(-(-len(ids) // 2048)):
            part = ids[2048 * p : 2048 * (p + 1)]
            want.setdefault((i, p, 2048 * p, len(part), crc(part)), 0)
            want[(i, p, 2048 * p, len(part), crc(part))] += 1
    got, sequences = {}, {}
    for r in found:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), -(-sum(r.length for r in found) // 2048)


def test_packing_small_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packing(packing.query(spark, small).collect(), docs)
    assert used <= 1.02 * least + 1


def test_packing_messy(spark, messy, no_docs):
    docs = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    cut = packing.pieces(messy).cache()
    check_packing(packing.pack(cut).withColumnRenamed("id", "doc_id").collect(), docs)
    assert packing.pack(packing.pieces(no_docs)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1 + seed / 8, 20_000).astype(int), 1, 2048)
    histogram = {int(k): int(n) for k, n in enumerate(np.bincount(lengths)) if n}
    plan, used = packing.solve(histogram), {}
    for items, n in plan.configs:
        assert sum(k * m for k, m in items.items()) <= 2048 and n > 0
        for k, m in items.items():
            used[k] = used.get(k, 0) + m * n
    assert used == histogram
    left = np.zeros(2049, np.int64)
    left[list(histogram)] = list(histogram.values())
    greedy = sum(n for _, n in packing.best_fit(left, 2048))
    assert plan.sequences() <= greedy and plan.sequences() >= -(-int(lengths.sum()) // 2048)


@pytest.mark.parametrize("times", [1, 20, 200])
def test_the_program_places_the_pieces(times):
    """Thousands of lengths, a few of each or many: best-fit gets next to nothing, and the count is within 0.1 % of the bound."""
    rng = np.random.default_rng(9)
    counts = np.bincount(rng.choice(np.clip(rng.lognormal(6, 1.2, 4_000).astype(int), 1, 2047), 10_000))
    plan = packing.solve({k: int(n) * times for k, n in enumerate(counts) if n})
    assert plan.left_over <= 0.1 and plan.bound <= plan.sequences() <= 1.001 * plan.bound + 1


def two_at_most(lengths):
    """The optimum where no three pieces fit: two pointers."""
    lengths, used, low = sorted(lengths), 0, 0
    high = len(lengths) - 1
    while low <= high:
        low += low < high and lengths[low] + lengths[high] <= 2048
        used, high = used + 1, high - 1
    return used


@pytest.mark.parametrize(("draw", "n"), [("uniform", 1_000), ("uniform", 20_000), ("two", 30_000), ("normal", 1_000), ("normal", 20_000), ("narrow", 20_000)])
def test_many_large_pieces(draw, n):
    """Never more sequences than best-fit; near the bound where pieces of all sizes are there; the optimum where two fit at most."""
    rng = np.random.default_rng(5)
    lengths = {"uniform": lambda: rng.integers(1, 2048, n), "two": lambda: rng.integers(700, 1400, n), "normal": lambda: np.clip(rng.normal(1000, 200, n), 1, 2047).astype(int), "narrow": lambda: rng.integers(500, 1001, n)}[draw]()
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.solve({k: int(m) for k, m in enumerate(counts) if m})
    used = np.zeros(2049, int)
    for items, m in plan.configs:
        assert sum(k * c for k, c in items.items()) <= 2048
        for k, c in items.items():
            used[k] += c * m
    assert (used == counts).all()
    greedy = sum(m for _, m in packing.best_fit(counts.copy(), 2048))
    assert plan.bound - 1e-6 <= plan.sequences() <= greedy
    if draw == "uniform":
        assert plan.sequences() <= 1.005 * plan.bound + 3
    if draw == "two":
        assert plan.sequences() == two_at_most(lengths.tolist())
    if draw == "narrow":
        assert plan.sequences() <= 0.97 * greedy


@pytest.mark.parametrize("seed", range(4))
def test_few_lengths_reach_the_fractional_optimum(seed):
    rng = np.random.default_rng(seed)
    plan = packing.solve({k: int(rng.integers(77, 300)) for k in (683, 684, 682, 1025, 1023, 500)})
    assert plan.left_over <= 0.1 and plan.sequences() <= plan.bound + 3  # the bound is within 1 of the optimum


def test_ties_and_repeated_pieces(spark):
    rows = [(n % 3, 1000) for n in range(60)] + [(7, 2048)] * 4 + [(None, 5)] * 9
    df = spark.createDataFrame(rows, "id bigint, length bigint").repartition(3)
    found = packing.pack(df).collect()
    assert sorted((str(r.id), r.length) for r in found) == sorted((str(i), n) for i, n in rows)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(rows) and len({r.sequence_id for r in found}) == 34


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        value, stock = np.where(rng.random(31) < 0.4, rng.random(31), 0), rng.integers(0, 4, 31)
        value[0] = stock[0] = 0
        best = np.zeros(31)
        for k in range(1, 31):
            best = np.array([max(best[room - k * m] + m * value[k] for m in range(min(stock[k], room // k) + 1)) for room in range(31)])
        shelf = packing.Knapsack(value, stock, 30)
        assert np.allclose(shelf.best, best)
        row, length, copies = shelf.fill(np.arange(31))
        assert np.allclose(np.bincount(row, copies * value[length], 31), best) and (np.bincount(row, copies * length, 31) <= np.arange(31)).all()
