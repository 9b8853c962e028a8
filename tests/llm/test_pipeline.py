"""Each stage of the pipeline on its own input."""

import functools
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, jaccard_join, lang_id
from plumbline.llm.shared import shared_folder, staged, table


def test_stages_on_the_small_table(spark, small):
    docs = table(spark, small, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, small), "test-stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
        assert before.join(docs, "doc_id", "left_anti").count() == counts[-2] - counts[-1]
    assert counts[1] == counts[0]  # every document has letters
    assert counts[2] == table(spark, small, "documents").select("text").distinct().count()
    again = jaccard_join.jaccard_components(docs, k=5, percent=80)
    assert again.where("doc_id <> component_id").count() == 0
    assert decontaminate.judged(decontaminate.decontaminate(docs, table(spark, small, "benchmark"))).where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_stages_on_messy_rows(spark, messy, no_docs, small):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, messy, small)
        assert out.columns == messy.columns, name
        assert 0 < out.count() <= 15
        assert stage(spark, no_docs, small).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, small).count() == 0


def test_language_stage_without_labels(spark, messy, small):
    """All languages null, or only in rows that never train: documents with a letter stay."""
    held = F.when(lang_id.held_out(F.col("doc_id")), F.col("lang"))
    for lang in (F.lit(None).cast("string"), held):
        out = corpus_pipeline.language(spark, messy.withColumn("lang", lang), small)
        assert out.columns == messy.columns
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, 6, 7, 8, 9, 9, None, 11, 12]))


def test_near_stage_judges_rows_not_ids(spark, small):
    base, other = [f"w{n}" for n in range(100)], " ".join(f"v{n}" for n in range(60))
    near = [" ".join([*base[:-1], f"end{n}"]) for n in range(5)]
    far = [" ".join([f"u{n}" for n in range(50)] + [f"tip{k}"]) for k in range(2)]
    docs = [(5, near[0]), (None, near[1]), (7, near[2]), (7, other), (3, near[3]), (None, far[0]), (None, far[1]), (3, "short text"), (None, "short too")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, df, small).collect()}
    assert got - {(None, far[0]), (None, far[1])} == {(7, other), (3, near[3]), (3, "short text"), (None, "short too")}
    assert len(got) == 5


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_of_equal(rows):
    """The row with the largest id of each text; a null text is empty, a null id loses."""
    best = {}
    for i, text in rows:
        at = best.get(text or "")
        if at is None or (i is not None and (at[0] is None or i > at[0])):
            best[text or ""] = (i, text)
    return best.values()


def one_of_near(rows, k=5, percent=80):
    """One row of each group linked by shared shingles, that with the smallest id."""
    def shingled(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w[p : p + k]) for p in range(max(len(w) - k, 0) + 1)} if w else set()

    sets, group = [shingled(t) for _, t in rows], list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    best = {}
    for g, row in zip(group, rows):
        if g not in best or (row[0] is None, row[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = row
    return best.values()


def uncontaminated(rows, items):
    wins = set()
    for text in items:
        w = WORD.findall((text or "").translate(LOWER))
        wins.update(tuple(w[p : p + 13]) for p in range(max(len(w) - 13, 0) + 1 if w else 0))
    sizes = {len(w) for w in wins}
    for i, text in rows:
        w, hit = WORD.findall((text or "").translate(LOWER)), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
        if not (hit and 20 * len(hit) >= len(w)):
            yield i, text


def with_letter(rows):
    return [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]


def shown(rows):
    return sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("source", ["small", "messy"])
def test_stages_equal_brute_force(spark, messy, small, source):
    """Each stage on what its predecessor kept, row for row."""
    docs = table(spark, small, "documents") if source == "small" else messy
    items = [r.text for r in table(spark, small, "benchmark").collect()]
    plain = [with_letter, one_of_equal, one_of_near, functools.partial(uncontaminated, items=items)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], plain):
        docs = staged(stage(spark, docs, small), "test-stage")
        got = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert shown(got) == shown(brute(rows)), name
        rows = got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sorted({str(p.doc_id) for p in pieces}) == sorted({str(i) for i, _ in rows})
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert shared_folder(spark)
