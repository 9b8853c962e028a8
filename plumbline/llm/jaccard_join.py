"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct word shingles, as 64-bit hashes. Equal sets
are one class with one representative. Tokens have one global order, rare
ones first, and a set's leading ``n - ceil(t n) + 1`` tokens are its prefix:
two sets that reach the threshold have a token in common that is in both
prefixes, and behind it (it included) enough tokens of either for the overlap
they need. The order comes from two looks at the corpus: a fixed-size count
sketch over all shingles, which hides what is below its noise, and then exact
counts of the tokens in prefixes; those in many prefixes are marked in a
bitmap of fixed size, go to the end of the order, and the sets that had them
in their prefix get a new one.

Groups are partitions of similar documents: the members of a token's column
are linked to the one with the most tokens behind it, each link is verified,
and connected components are the groups. The matrix then holds, for each token
and group, the union's bound: the most that any member can have in common from
this token on. A document's overlap with a group is bounded by that of a token
they share, so only groups that leave room for the threshold are opened, in
blocks of members, and only groups other than its own need to be. Pairs from
opened groups pass an exact bound on bucketed token counts and are then
verified on their whole sets. No pair at the threshold is lost, whatever the
threshold and shingle length, but those inside one group, which make no
difference to it.

Defined cases: a null or empty text has an empty set, is linked with nothing
and is its own component; equal sets are linked; rows that repeat an id count
as one document; a row without an id takes the component of an equal set, else
null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.components import components
from plumbline.llm.shared import drop, settled, staged, table

#: Buckets of the frequency sketch, its slices on the way to the driver, buckets of the overlap bound.
SKETCH, SLICES, BOUND = 1 << 20, 64, 64
#: Members of a group that are stored, and opened, together.
BLOCK = 64
#: Bits of the bitmap of tokens that are in many prefixes; prefixes that are many; tokens that may be marked (those in the most prefixes).
MARKS, MANY, MARKED = 1 << 24, 8, 1 << 20
#: Levels of marked tokens come after all others.
LATE = 32
#: Ids that may be broadcast to pick documents; beyond it they are joined.
BROADCAST_IDS = 1 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's shingles with repeats, offsets of each text's)."""
    numbers, at, distinct = words.split(texts, words.BLANK_WORDS)
    if not len(numbers):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    own = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[numbers]
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    starts = words.gather(at[:-1], count)
    short = np.repeat(np.minimum(n, k), count)  # words in the shingle: k but for shorter texts
    total = short.astype(np.uint64)
    for j in range(k):
        odd = _mixed(np.array([j + 1], np.uint64))[0] | np.uint64(1)
        word = own[np.minimum(starts + j, len(own) - 1)]
        total += np.where(short > j, _mixed(word ^ ODD[j % 3]) * odd, np.uint64(0))
    return _mixed(total), np.concatenate([[0], np.cumsum(count)])


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in words.batches(batches, "text"):
            hashes, at = shingles(words.text_array(batch.column("text")), k)
            sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - 20)).astype(np.int64), minlength=SKETCH)
        if counts.any():
            yield _slices({k: part for k, part in enumerate(counts.reshape(SLICES, -1))})

    return run


def _slices(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts.values()], pa.binary())], ["slice", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(zlib.decompress(packed), "<i8")
            parts[k] = parts[k] + own if k in parts else own
    if parts:
        yield _slices(parts)


def commonness(texts: DataFrame, k: int) -> np.ndarray:
    """A level for each sketch bucket: 0 for rare tokens, higher the commoner; SKETCH bytes whatever the input."""
    found = texts.mapInArrow(_sketch(k), "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(_add, "slice int, counts binary")
    counts = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for row in found.collect():  # SLICES rows
        counts[row["slice"]] += np.frombuffer(zlib.decompress(bytes(row["counts"])), "<i8")
    counts = counts.ravel()
    mean = counts.mean()
    # What a bucket holds beyond chance.
    return np.floor(np.log2(np.maximum(counts - mean - 4 * np.sqrt(mean), 1))).astype(np.uint8)


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits at some places of a packed bitmap, as 0 and 1."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.uint64)


def _sets(shared, marks, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value.astype(np.uint64)
        bits = np.frombuffer(zlib.decompress(marks.value), np.uint8) if marks else None
        for batch in words.batches(batches, "text"):
            hashes, at = shingles(words.text_array(batch.column("text")), k)
            # Level first, then the hash: the global order of tokens.
            place = level[(hashes >> np.uint64(64 - 20)).astype(np.int64)]
            if bits is not None:
                place += marked(bits, (hashes >> np.uint64(7) & np.uint64(MARKS - 1)).astype(np.int64)) * np.uint64(LATE)
            keys = place << np.uint64(57) | hashes >> np.uint64(7)
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own, first = np.unique(keys[a:b], return_index=True)
                n = len(own)
                whole = _mixed(hashes[a:b][first] ^ ODD[0])
                prefix = own[: n - -(-percent * n // 100) + 1] if n else own
                bound = np.minimum(np.bincount((own & np.uint64(BOUND - 1)).astype(np.int64), minlength=BOUND), 65535)
                rows.append((n, int(whole.sum().view(np.int64)), int(_mixed(whole).sum().view(np.int64)), prefix.astype(np.int64).tolist(), bound.astype("<u2").tobytes()))
            n, s1, s2, prefix, bound = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bound, pa.binary())], ["id", "n", "s1", "s2", "prefix", "bound"])

    return run


def _late(marks):
    """Ids of sets with a marked token in their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(marks.value), np.uint8)
        for batch in batches:
            prefix = batch.column("prefix")
            size = np.asarray(pc.list_value_length(prefix)).astype(np.int64)
            hit = marked(bits, np.asarray(prefix.flatten()) & (MARKS - 1))
            found = np.bincount(np.repeat(np.arange(batch.num_rows), size), hit, batch.num_rows) > 0
            yield batch.filter(pa.array(found)).select(["rep"])

    return run


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.batches(batches, "text"):
            hashes, at = shingles(words.text_array(batch.column("text")), k)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "hashes"])

    return run


def _bounded(percent: int):
    """Pairs whose bucketed counts leave room for the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BOUND).astype(np.int64) for c in ("bound_a", "bound_b"))
            total = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            most = np.minimum(x, y).sum(1)
            full = ((x == 65535) | (y == 65535)).any(1)
            keep = full | (100 * most >= percent * (total - most))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _opened(percent: int):
    """Members of opened blocks that leave room for the threshold with the document that opened them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                members = batch.column("members").combine_chunks() if isinstance(batch.column("members"), pa.ChunkedArray) else batch.column("members")
                size = np.asarray(pc.list_value_length(members))
                row, flat = np.repeat(np.arange(batch.num_rows), size), members.flatten()
                own = np.frombuffer(b"".join(batch.column("bound_a").to_pylist()), "<u2").reshape(-1, BOUND)[row]
                theirs = np.frombuffer(b"".join(flat.field("bound").to_pylist()), "<u2").reshape(-1, BOUND)
                n_a, n_b = np.asarray(batch.column("n_a"))[row], np.asarray(flat.field("n"))
                most = np.minimum(own, theirs).sum(1, dtype=np.int64)
                full = ((own == 65535) | (theirs == 65535)).any(1)
                keep = np.flatnonzero((n_b <= n_a) & (100 * n_b >= percent * n_a) & (full | (100 * most >= percent * (n_a + n_b - most))))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(row[keep])), flat.field("rep").take(pa.array(keep))], ["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


class Join:
    """One run of the join: its representatives and how candidate pairs become links."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
        self.kind = self.texts.schema["id"].dataType.simpleString()
        self.level = self.spark.sparkContext.broadcast(commonness(self.texts, k))
        full = staged(self.texts.mapInArrow(_sets(self.level, None, k, percent), self.schema("prefix", "bound")), "sets")
        self.sets = staged(full.select("id", "n", "s1", "s2"), "set-keys")
        same = full.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2")
        classes = staged(same.agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bound").alias("bound")), "classes")
        drop(full)
        self.classes = staged(classes.select("n", "s1", "s2", "rep"), "class-keys")
        # With a smaller set no other set is near enough: s / (s + 1) is below the threshold.
        self.reps = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1))
        if (better := self.rare_first()) is not self.reps:
            drop(classes)
        self.reps = better
        self.columns = settled(self.spark, "columns", self.shared_tokens)
        # Prefixes are no longer needed, once the tokens that several sets hold are known.
        self.reps = staged(better.select("rep", "n", "bound"), "bounds")
        drop(better)

    def schema(self, *more: str) -> str:
        kinds = {"prefix": "array<long>", "bound": "binary"}
        return f"id {self.kind}, n long, s1 long, s2 long" + "".join(f", {c} {kinds[c]}" for c in more)

    def tokens(self) -> DataFrame:
        return self.reps.select("rep", "n", F.posexplode("prefix").alias("at", "token"))

    def rare_first(self) -> DataFrame:
        """``reps`` with prefixes in which tokens of many prefixes come last."""
        found = staged(self.tokens().groupBy("token").agg(F.count("*").alias("prefixes")).where(F.col("prefixes") >= MANY), "frequent")
        # One row a power of two.
        sizes = {r.power: r.n for r in found.groupBy(F.floor(F.log2("prefixes")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()}
        least = next((p for p in sorted(sizes) if sum(n for q, n in sizes.items() if q >= p) <= MARKED), None)
        if least is None:
            return self.reps
        marks = np.zeros(MARKS, bool)
        # At most MARKED numbers.
        chosen = found.where(F.col("prefixes") >= 2**least).select(F.col("token").bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("mark")).distinct()
        marks[np.asarray(chosen.toArrow().column("mark"))] = True
        shared = self.spark.sparkContext.broadcast(zlib.compress(np.packbits(marks).tobytes(), 1))
        late = self.reps.select("rep", "prefix").mapInArrow(_late(shared), f"rep {self.kind}")
        texts = self.of_ids(staged(late.select(F.col("rep").alias("id")), "late"))
        new = texts.mapInArrow(_sets(self.level, shared, self.k, self.percent), self.schema("prefix", "bound"))
        new = new.where("id IS NOT NULL").select(F.col("id").alias("rep"), "n", "s1", "s2", F.col("prefix").alias("better")).dropDuplicates(["rep", "n", "s1", "s2"])
        joined = self.reps.join(new, ["rep", "n", "s1", "s2"], "left")
        return staged(joined.select("rep", "n", "s1", "s2", F.coalesce("better", "prefix").alias("prefix"), "bound"), "reps")

    def of_ids(self, ids: DataFrame) -> DataFrame:
        """The texts of a written table of ids."""
        return self.texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def shared_tokens(self) -> DataFrame:
        """The rows of tokens that several prefixes hold."""
        tokens = self.tokens()
        several = staged(tokens.groupBy("token").agg(F.count("*").alias("prefixes")).where("prefixes > 1").select("token"), "several")
        return tokens.join(several, "token")

    def behind(self, n: str, at: str, other: str):
        """Whether a set's tokens from a shared one on are enough for the overlap that it needs with a set of ``other`` tokens."""
        return 100 * F.col(n) - (100 + self.percent) * F.col(at) >= self.percent * F.col(other)

    def star_pairs(self) -> DataFrame:
        """For each token, its members against the one that has the most behind it."""
        lead = F.struct((F.col("at") * 100 / F.col("n")).alias("share"), "at", "n", "rep")
        first = staged(self.columns.groupBy("token").agg(F.min(lead).alias("first")), "firsts").select("token", F.col("first.rep").alias("a"), F.col("first.n").alias("n_a"), F.col("first.at").alias("at_a"))
        pairs = self.columns.select("token", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")).join(first, "token")
        return pairs.where((F.col("a") != F.col("b")) & self.behind("n_a", "at_a", "n_b") & self.behind("n_b", "at_b", "n_a")).select("a", "b").distinct()

    def open_pairs(self, groups: DataFrame) -> DataFrame:
        """Pairs of documents with members, no larger, of the groups that a shared token leaves room for."""
        rows = self.columns.join(groups, self.columns.rep == groups.vertex, "left").select("token", "rep", "n", "at", F.coalesce("component", "rep").alias("group"))
        rows = staged(rows, "matrix-rows")
        inside = rows.where(self.behind("n", "at", "n"))
        reach = F.max(100 * F.col("n") - (100 + self.percent) * F.col("at")).alias("reach")
        matrix = staged(inside.groupBy("token", "group").agg(F.min("n").alias("least"), reach), "matrix")
        asked = rows.select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("group").alias("from"))
        # A link is found from its larger set's side.
        room = (F.col("from") != F.col("group")) & (F.col("reach") >= self.percent * F.col("n_a")) & (F.col("least") <= F.col("n_a")) & self.behind("n_a", "at_a", "least")
        opened = staged(asked.join(matrix, "token").where(room).select("a", "n_a", "group").distinct(), "opened")
        asking = opened.join(self.reps.select(F.col("rep").alias("a"), F.col("bound").alias("bound_a")), "a")
        near = (100 * F.col("most") >= self.percent * F.col("n_a")) & (F.col("least") <= F.col("n_a"))
        found = asking.join(self.blocks(groups, opened), "group").where(near).select("a", "n_a", "bound_a", "members")
        return found.mapInArrow(_opened(self.percent), f"a {self.kind}, b {self.kind}").distinct()

    def blocks(self, groups: DataFrame, opened: DataFrame) -> DataFrame:
        """(group, members, least, most) of the opened groups: blocks of about BLOCK members of like size."""
        of = self.reps.join(groups, self.reps.rep == groups.vertex, "left").select("rep", "n", "bound", F.coalesce("component", "rep").alias("group"))
        of = of.join(opened.select("group").distinct(), "group", "left_semi")
        band = F.floor(F.log(F.col("n").cast("double")) * 20).alias("band")
        of = staged(of.select("*", band), "open-members")
        sizes = staged(of.groupBy("group", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "block-counts")
        salted = of.join(sizes, ["group", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        # Dealt by block, or a large group would be packed in one task.
        packed = salted.repartition("group", "band", "block").groupBy("group", "band", "block").agg(F.collect_list(F.struct("rep", "n", "bound")).alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
        return staged(packed.drop("band", "block"), "blocks")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bound").alias(f"bound_{x}"))
        both = staged(pairs, "pairs").join(side("a"), "a").join(side("b"), "b")
        return both.mapInArrow(_bounded(self.percent), f"a {self.kind}, b {self.kind}")

    def links(self, pairs: Callable[[], DataFrame]) -> DataFrame:
        """The pairs that reach the threshold on their whole sets."""
        near = settled(self.spark, "near-pairs", pairs)

        def verified() -> DataFrame:
            ids = staged(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "near-ids")
            sets = staged(self.of_ids(ids).mapInArrow(_whole_sets(self.k), f"id {self.kind}, hashes binary"), "whole-sets")
            both = near.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b")), "b")
            return both.mapInArrow(_verified(self.percent), f"a {self.kind}, b {self.kind}")

        return settled(self.spark, "links", verified)

    def groups(self) -> DataFrame:
        """(vertex, component) of all representatives with a link."""
        links = self.links(lambda: self.bounded(self.star_pairs()))
        groups = settled(self.spark, "groups", lambda: components(links))
        more = self.links(lambda: self.open_pairs(groups))
        return settled(self.spark, "groups", lambda: components(groups.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(more)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links of at least ``percent`` %)."""
    def build() -> DataFrame:
        join = Join(docs, id_col, text_col, k, percent)
        groups = join.groups()
        classes = join.classes.select("n", "s1", "s2", "rep").join(groups, F.col("rep") == groups.vertex, "left")
        classes = staged(classes.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id")), "class-components")
        out = join.sets.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
        own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))

    return settled(docs.sparkSession, "jaccard", build).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)
