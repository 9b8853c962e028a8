"""The corpus pipeline's stages, and all of them in a row; corpus_pipeline.py says what they do."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, exact_dedup, jaccard_join, lang_id, packing
from plumbline.llm.shared import settled, staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID gives a language; all that have a letter where no language could be learned."""
    model = lang_id.trained(docs)
    if not model.langs:  # nothing to learn from says nothing about a text
        return docs.where(docs["text"].cast("string").rlike(r"\p{L}"))
    return lang_id.known_rows(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest id."""
    return exact_dedup.kept_rows(docs, largest=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 80 % of five-word shingles, that with the smallest id."""
    # Written with a key of each row, as ids may repeat or be null.
    keyed = staged(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row")), "keyed")
    slim = keyed.select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    found = jaccard_join.jaccard_components(slim, "key", k=5, percent=80).select("key", "component_id")
    linked = found.where("key <> component_id")
    # Both ends of every link: the rows beside the one a group is named after, and that one.
    member = staged(linked.union(linked.select(F.col("component_id").alias("key"), "component_id").distinct()).join(slim.select("key", "doc_id"), "key"), "near-copies")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    stays = member.groupBy("component_id").agg(F.min(place)["key"].alias("stays"))
    dropped = staged(member.join(stays, "component_id").where("key <> stays").select("key"), "near-dropped")
    small = dropped.count() <= jaccard_join.BROADCAST_IDS
    return keyed.join(F.broadcast(dropped) if small else dropped, "key", "left_anti").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark contaminates."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and offset."""
    return packing.pack(staged(packing.pieces(docs), "pieces")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", clean),
    ("best-fit packing", pack),
]

def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it; what a stage leaves goes when it is no longer read."""

    def packed() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = settled(spark, name.replace(" ", "-"), functools.partial(stage, spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)

    return settled(spark, "pipeline", packed)
