"""Best-fit packing by a configuration linear program over the length histogram.

Lengths are at most ``capacity``, so however many pieces there are, the
histogram has at most ``capacity`` entries and the program is solved on the
driver: a configuration is a multiset of lengths that fits one sequence; the
covering program over configurations is solved by multiplicative weights, and
each sweep's columns come from a knapsack dynamic program on the weights,
bounded by the pieces there are. The fractional solution is rounded to whole
sequences that use no length more often than it occurs, the rest is solved
and rounded again, and what remains at last (a few pieces in a thousand) is
packed best-fit on its own histogram. Where large pieces leave the program a
gap to its own bound, it is solved again in smaller steps, and leaves to
best-fit as much as gives the fewest sequences.

Pieces then take their places without meeting in one task: a piece's rank
among the pieces of its length comes from counts per (length, salt), and its
rank selects configuration, copy and offset from the plan.

Defined cases: a null or empty text is one piece that holds the separator
only; rows that repeat an id are packed each for itself; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import tokenids, words
from plumbline.llm.shared import shuffle_partitions, staged, table

CAPACITY = 2048
SEPARATOR = 0
#: Rounds of solving what rounding left.
ROUNDS = 12
#: The program ends when it has left so small a share of the tokens.
REST = 0.004
#: Columns of a sweep are worth so much less than the best at most.
SLACK = 0.02
#: For up to so many lengths, for more, and for more where that left a gap: the cover a length may gain in a sweep, eta, the cover to reach, and sweeps at most.
FEW_LENGTHS = 24
FINE, COARSE, CLOSE = (0.02, 5.0, 30.0, 3000), (1.0, 0.3, 1.0, 40), (0.25, 1.0, 3.0, 120)
#: A plan this near its bound is not solved again in smaller steps.
GAP = 0.003


class Knapsack:
    """Best fillings of every room 0 .. capacity that use length k at most ``stock[k]`` times.

    ``value[k]`` is the worth of one piece of length k. Stocks are split into
    powers of two, so one pass over a row of rooms decides each part.
    """

    def __init__(self, value: np.ndarray, stock: np.ndarray, capacity: int):
        self.parts: list[tuple[int, int]] = []  # length, copies
        for k in np.flatnonzero((value > 0) & (stock > 0)).tolist():
            rest, copies = min(int(stock[k]), capacity // k), 1
            while rest:
                copies = min(copies, rest)
                self.parts.append((k, copies))
                rest, copies = rest - copies, 2 * copies
        self.best = np.zeros(capacity + 1)
        self.taken = np.zeros((len(self.parts), capacity + 1), bool)
        for row, (k, copies) in zip(self.taken, self.parts):
            worth = self.best[: capacity + 1 - k * copies] + copies * value[k]
            np.greater(worth, self.best[k * copies :], out=row[k * copies :])
            self.best[k * copies :] = np.maximum(worth, self.best[k * copies :])

    def fill(self, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best filling of each room, as (row of ``rooms``, length, copies)."""
        rooms, found = rooms.copy(), [(np.zeros(0, np.int64), 0, 0)]
        for row, (k, copies) in zip(self.taken[::-1], reversed(self.parts)):
            if len(hit := np.flatnonzero(row[rooms])):
                rooms[hit] -= k * copies
                found.append((hit, k, copies))
        sizes = [len(hit) for hit, _, _ in found]
        return np.concatenate([hit for hit, _, _ in found]), np.repeat([k for _, k, _ in found], sizes), np.repeat([c for _, _, c in found], sizes)


def columns(price: np.ndarray, stock: np.ndarray, capacity: int, slack: float = SLACK) -> tuple[list[tuple[tuple[int, int], ...]], float]:
    """Configurations worth at least (1 - slack) of the best, best first: for each length it with the best filling beside it. And the best worth."""
    shelf = Knapsack(price, stock, capacity)
    lengths = np.flatnonzero(stock)
    worth = price[lengths] + shelf.best[capacity - lengths]
    good = lengths[worth >= (1 - slack) * worth.max()]
    row, length, copies = shelf.fill(capacity - good)
    found = [{int(k): 1} for k in good]
    for r, k, n in zip(row.tolist(), length.tolist(), copies.tolist()):
        found[r][k] = found[r].get(k, 0) + n
    value = {tuple(sorted(items.items())): sum(price[k] * n for k, n in items.items()) for items in found}
    return sorted(value, key=lambda c: (-value[c], c)), float(shelf.best[capacity])


def fractional(left: np.ndarray, capacity: int, many: tuple[float, float, float, int] = COARSE) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(configurations with fractional counts that cover ``left`` on the whole, a lower bound of the counts' sum).

    A length's price falls exponentially with its cover. Each sweep prices
    columns by the knapsack and raises them, best first, until one of their
    lengths has got the sweep's share; few lengths are solved in many small
    steps, many in fewer, larger ones. Any prices bound the program from
    below: what all pieces are worth over what the best configuration is.
    """
    lengths = np.flatnonzero(left)
    few = len(lengths) <= FEW_LENGTHS
    step, eta, full, sweeps = FINE if few else many
    n, cover, bound = left.astype(float), np.zeros(capacity + 1), 0.0
    used: dict[tuple[tuple[int, int], ...], float] = {}
    tokens = float((n * np.arange(capacity + 1)).sum())
    for _ in range(sweeps):
        price = np.zeros(capacity + 1)
        price[lengths] = lengths / capacity * np.exp(-eta * (cover[lengths] - cover[lengths].mean()))
        found, best = columns(price, left, capacity)
        bound = max(bound, float((n * price).sum()) / best)
        room = (step * n).tolist()
        for items in found:
            x = min(room[k] / m for k, m in items)
            if x > 0:
                used[items] = used.get(items, 0.0) + x
                for k, m in items:
                    room[k] -= x * m
                    cover[k] += x * m / n[k]
        if (cover * n * np.arange(capacity + 1)).sum() > full * tokens:
            break
    # Cover of 1 for each length, or nearly so where it is uneven.
    mean = float((cover * n * np.arange(capacity + 1)).sum()) / tokens
    scale = 1 / max(float(cover[lengths].min()), 0.9 * mean)
    return [(dict(items), x * scale) for items, x in used.items()], bound


def rounded(columns: list[tuple[dict[int, int], float]], left: np.ndarray, capacity: int, seed: int) -> list[tuple[dict[int, int], int]]:
    """Whole counts of the columns, taken from ``left``.

    Counts are rounded down where that keeps half of the program; else
    systematically: of columns in random order, each gets the whole numbers
    that the running sum of the counts passes in it.
    """
    x = np.array([x for _, x in columns])
    if 2 * np.floor(x + 1e-9).sum() >= x.sum():
        order = np.argsort(-x, kind="stable")
        whole = np.floor(x[order] + 1e-9)
    else:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        whole = np.diff(np.floor(np.cumsum(x[order]) + rng.random()), prepend=0)
    out = []
    for at, n in zip(order.tolist(), whole.astype(np.int64).tolist()):
        items = columns[at][0]
        if (n := min([n, *(int(left[k]) // m for k, m in items.items())])) > 0:
            out.append((items, n))
            for k, m in items.items():
                left[k] -= n * m
    return out


@dataclass
class Plan:
    """Configurations with the number of sequences that follow each."""

    configs: list[tuple[dict[int, int], int]]
    #: Share of the tokens of pieces below capacity that the program left to best-fit.
    left_over: float = 0.0
    #: No packing has fewer sequences than this.
    bound: float = 0.0

    def sequences(self) -> int:
        return sum(n for _, n in self.configs)

    def slots(self) -> tuple[np.ndarray, ...]:
        """Per (length, configuration): length, first rank, places a sequence, first sequence, first offset; in order of length and rank."""
        rows, ranks, sequence = [], {}, 0
        for items, n in self.configs:
            offset = 0
            for k in sorted(items, reverse=True):
                rows.append((k, ranks.get(k, 0), items[k], sequence, offset))
                ranks[k] = ranks.get(k, 0) + n * items[k]
                offset += k * items[k]
            sequence += n
        rows.sort()
        return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram; sequences of equal contents stay together."""
    rooms: list[int] = []  # distinct rooms, ascending
    open_: dict[int, list[list]] = {}  # room -> [contents, how many]

    def put(room: int, items: dict[int, int], n: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append([items, n])

    for k in np.flatnonzero(left)[::-1]:
        k, n = int(k), int(left[k])
        while n:
            at = bisect.bisect_left(rooms, k)
            if at == len(rooms):
                many = capacity // k
                if n >= many:
                    put(capacity - many * k, {k: many}, n // many)
                    n %= many
                else:
                    put(capacity - n * k, {k: n}, 1)
                    n = 0
                continue
            room = rooms[at]
            items, m = open_[room][-1]
            many = min(room // k, n)
            copies = min(m, n // many)
            open_[room][-1][1] -= copies
            if open_[room][-1][1] == 0:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            put(room - many * k, items | {k: items.get(k, 0) + many}, copies)
            n -= many * copies
    return [(items, n) for found in open_.values() for items, n in found]


def attempt(whole: np.ndarray, capacity: int, many: tuple[float, float, float, int]) -> Plan:
    """Solve, round and solve the rest again; of the plans that leave the rest to best-fit after each round, the one with the fewest sequences.

    Best-fit alone is the plan before the first round, so no plan is worse than it.
    """
    left, at = whole.copy(), np.arange(capacity + 1)
    short = first = int((left * at).sum())
    placed: list[tuple[dict[int, int], int]] = []
    best, bound = Plan(best_fit(left, capacity), 1.0), 0.0
    for seed in range(ROUNDS):
        if not left.any():
            break
        found, least = fractional(left, capacity, many)
        bound = bound or least
        placed += rounded(found, left, capacity, seed)
        before, short = short, int((left * at).sum())
        plan = Plan(placed + best_fit(left, capacity), short / first if first else 0.0)
        if plan.sequences() <= best.sequences():
            best = plan
        if short > 0.9 * before or short <= REST * first:
            break
    best.bound = bound
    return best


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan that places every piece of the histogram (length -> count)."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        left[int(k)] = n
    full, left[capacity] = int(left[capacity]), 0
    best = attempt(left, capacity, COARSE)
    if best.sequences() > (1 + GAP) * best.bound + 1 and np.count_nonzero(left) > FEW_LENGTHS:
        closer = attempt(left, capacity, CLOSE)
        bound = max(best.bound, closer.bound)
        best = min(best, closer, key=Plan.sequences)
        best.bound = bound
    if full:
        best.configs.insert(0, ({capacity: 1}, full))
        best.bound += full
    if not left.any():
        best.left_over = 0.0
    return best


def _pieces(path: str, separator: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenids.token_ids(path)
        for batch in words.batches(batches, "text"):
            at, ids = tokenids.with_end(*encoder.encode(words.text_array(batch.column("text"))), separator)
            n = -(-np.diff(at) // capacity)
            row = np.repeat(np.arange(batch.num_rows), n)
            piece = words.gather(np.zeros(len(n), np.int64), n)
            start = piece * capacity
            length = np.minimum(np.diff(at)[row] - start, capacity)
            crcs = [tokenids.crc(ids[s : s + k]) for s, k in zip(at[row] + start, length)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces."""
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_pieces(tokenizer or tokenids.default_path(), separator, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _places(slots: tuple[np.ndarray, ...]):
    length, first, many, sequence, offset = slots
    ranks = int(first.max()) + 1 if len(first) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.array(batch.column("length"), np.int64)
            rank = np.array(batch.column("rank"), np.int64)
            # The keys fit: lengths are small, ranks are capped at the plan's largest first rank.
            at = np.searchsorted(length * (ranks + 1) + first, k * (ranks + 1) + np.minimum(rank, ranks), "right") - 1
            copy, place = np.divmod(rank - first[at], many[at])
            out = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            out |= {"sequence_id": pa.array(sequence[at] + copy), "offset": pa.array(offset[at] + place * k)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``lengths`` (any columns, ``length`` among them) with sequence_id and offset.

    ``lengths`` is read three times: pass a written table.
    """
    spark = lengths.sparkSession
    salts = max(64, min(1024, shuffle_partitions(spark)))
    salted = lengths.withColumn("salt", F.pmod(F.xxhash64(*[lengths[c] for c in lengths.columns]), F.lit(salts)))
    counts = staged(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    # At most ``capacity`` rows.
    plan = solve({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy(*[c for c in lengths.columns if c != "length"])
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"]).select(*lengths.columns, (F.col("before") + F.col("own")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_places(plan.slots()), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = staged(pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(cut).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
