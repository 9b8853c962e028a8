"""Language identification by segmentation-marginalised unigrams.

The pieces are a public tokenizer's vocabulary, fixed. A word's probability in
a language is the sum, over all ways to cut it into pieces, of the product of
that language's piece probabilities, computed by a forward recursion. The
piece probabilities are fitted by expectation-maximisation on the language's
word counts, gathered from all training rows. Pieces do not cross words, so a
text's score is a sum over its words, and each distinct word is worked once.

Each pass of the expectation runs where the word counts are, over all words;
only the sums by language and piece come to the driver, whose size is that of
the model: the fixed vocabulary times the languages. Defined cases: a null text or one without a letter gets ``und``
and score 0; rows without a language do not train; repeated rows count as often
as they occur; an empty training set gives ``und`` for every text; ties go to
the alphabetically first language; more than ``MOST_LANGS`` different labels
are refused with an error, as they are no language column; other columns are
not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import words
from plumbline.llm.shared import staged, table

UNKNOWN = "und"
MOST_LANGS, PASSES = 1_000, 3
#: Weight of the uniform distribution mixed into each language's pieces, and of a character no piece covers.
SMOOTH, FOREIGN = 0.02, 1e-7
#: Text whose distinct words are scored together.
PREDICT_BYTES = 3 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model, lower-cased, without control pieces; a word's first piece starts with U+2581."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return {p: n for n, p in enumerate(dict.fromkeys(pieces))}


def arcs(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end 1 .. n in the marked word: (start, piece), piece -1 for a character alone that is no piece."""
    word = "▁" + word
    out = []
    for end in range(1, len(word) + 1):
        found = [(start, n) for start in range(max(0, end - longest), end) if (n := pieces.get(word[start:end])) is not None]
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, -1))
        out.append(found)
    return out


#: Words up to this length are summed together; no product of their pieces is too small for a double.
TOGETHER = 40
#: Words in one such sum.
SLICE = 8_000
HASH = np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """The vocabulary, with the pieces of each length by hash."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers, self.longest = numbers, max(map(len, numbers), default=1)
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        spelt: dict[int, list[str]] = {}
        for piece in numbers:
            spelt.setdefault(len(piece), []).append(piece)
        for size, found in spelt.items():
            codes = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).reshape(-1, size)
            h = np.zeros(len(found), np.uint64)
            for k in range(size):
                h = h * HASH + codes[:, k] + np.uint64(1)
            by = np.argsort(h)
            self.of_length[size] = h[by], np.array([numbers[x] for x in found])[by]


class Lattice:
    """All ways to cut many words into pieces: arcs from place to place, a piece each; the sums over them advance for all words together."""

    def __init__(self, found: list[str], pieces: Pieces):
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
        codes = np.frombuffer("".join("▁" + w for w in found).encode("utf-32-le"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(found)), sizes)
        inside = np.arange(len(codes)) - begins[of]
        room = sizes[of] - inside
        at, lengths, numbers, h = [], [], [], np.zeros(len(codes), np.uint64)
        live = np.arange(len(codes))
        for size in range(1, pieces.longest + 1):
            live = live[room[live] >= size]
            h = h[: len(codes) - size + 1] * HASH + codes[size - 1 :] + np.uint64(1)
            keys, own = pieces.of_length.get(size, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            place = np.searchsorted(keys, h[live])
            hit = np.zeros(len(live), bool) if not len(keys) else keys[np.minimum(place, len(keys) - 1)] == h[live]
            good, number = live[hit], own[place[hit]]
            if size == 1:  # a character that is no piece stands alone
                good, number = np.concatenate([good, live[~hit]]), np.concatenate([number, np.full(int((~hit).sum()), -1)])
            at.append(good), lengths.append(np.full(len(good), size)), numbers.append(number)
        at, lengths, self.piece = (np.concatenate(x) for x in (at, lengths, numbers))
        # A place before each character and one after each word.
        self.places = len(codes) + len(found)
        self.first = begins + np.arange(len(found))
        self.last = self.first + sizes
        self.word = of[at]
        self.source = at + self.word
        self.target = self.source + lengths
        self.start, self.end = inside[at], inside[at] + lengths

    def _steps(self, step: np.ndarray, goal: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arcs in order of ``step``, those of one goal side by side: (arcs, where each goal's begin among them, goals) of each step."""
        by = np.argsort((step - step.min()) * self.places + goal) if len(step) else np.zeros(0, np.int64)
        step, goal = step[by], goal[by]
        cuts = np.flatnonzero(np.diff(step, prepend=step[:1] - 1, append=step[-1:] + 1)) if len(step) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            heads = np.flatnonzero(np.diff(goal[a:b], prepend=-1))
            out.append((by[a:b], heads, goal[a:b][heads]))
        return out

    def sums(self, weight: np.ndarray, backward: bool = False) -> np.ndarray:
        """For each place the sum, over all paths from the word's beginning (or to its end), of the products of the arcs' weights."""
        out = np.zeros((self.places, *weight.shape[1:]))
        out[self.last if backward else self.first] = 1.0
        other = self.target if backward else self.source
        for arc, heads, goal in self._steps(-self.start, self.source) if backward else self._steps(self.end, self.target):
            out[goal] = np.add.reduceat(out[other[arc]] * weight[arc], heads, axis=0)
        return out


@dataclass
class Model:
    langs: list[str]
    pieces: dict[str, int]
    #: One row a language: a probability for every piece, then that of a foreign character.
    probability: np.ndarray

    def __post_init__(self):
        self.by_piece = np.ascontiguousarray(self.probability.T)
        self.index = Pieces(self.pieces)

    def word(self, word: str) -> np.ndarray:
        """Log probability of a lower-case word in each language."""
        longest = self.index.longest
        total, recent = 0.0, [np.ones(len(self.langs))]  # the forward sums that a piece can still start from
        for end, arc in enumerate(arcs(word, self.pieces, longest), 1):
            value = sum(recent[start - end] * self.by_piece[piece] for start, piece in arc)
            recent = [*recent[-longest:], value]
            if (top := value.max()) < 1e-100:  # a long word: rescale
                recent, total = [f / top for f in recent], total + math.log(top)
        return np.log(np.maximum(recent[-1], 1e-300)) + total

    def words(self, found: list[str]) -> np.ndarray:
        """``word`` of many words, one row each."""
        out = np.zeros((len(found), len(self.langs)))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        for k in np.flatnonzero(sizes > TOGETHER):
            out[k] = self.word(found[k])
        short = np.flatnonzero(sizes <= TOGETHER)
        for start in range(0, len(short), SLICE):
            part = short[start : start + SLICE]
            lattice = Lattice([found[k] for k in part], self.index)
            out[part] = np.log(np.maximum(lattice.sums(self.by_piece[lattice.piece])[lattice.last], 1e-300))
        return out


def expected(word: str, pieces: dict[str, int], p: np.ndarray) -> tuple[dict[int, float], float]:
    """Expected number of uses of each piece in one word of any length, and the word's probability; sums are kept as logarithms."""
    lattice = arcs(word, pieces, max(map(len, pieces), default=1))
    forward, backward = [0.0], [-math.inf] * len(lattice) + [0.0]
    for arc in lattice:
        ways = [forward[start] + math.log(p[piece]) for start, piece in arc if p[piece] > 0]
        top = max(ways, default=-math.inf)
        forward.append(top + math.log(sum(math.exp(x - top) for x in ways)) if top > -math.inf else top)
    for end in range(len(lattice), 0, -1):
        for start, piece in lattice[end - 1]:
            if p[piece] > 0 and backward[end] > -math.inf:
                x, y = sorted((backward[start], backward[end] + math.log(p[piece])))
                backward[start] = y + math.log1p(math.exp(x - y)) if x > -math.inf else y
    out: dict[int, float] = {}
    if (total := forward[-1]) > -math.inf:
        for end, arc in enumerate(lattice, 1):
            for start, piece in arc:
                if p[piece] > 0 and (use := math.exp(forward[start] + math.log(p[piece]) + backward[end] - total)) > 0:
                    out[piece] = out.get(piece, 0.0) + use
    return out, math.exp(total)


def uses(found: list[str], lang: np.ndarray, times: np.ndarray, probability: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece (a foreign character last) in each language, by forward and backward sums over words of one language each."""
    langs, width = probability.shape
    out = np.zeros(langs * width)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    for k in np.flatnonzero(sizes > TOGETHER):
        for piece, value in expected(found[k], pieces.numbers, probability[lang[k]])[0].items():
            out[lang[k] * width + piece % width] += times[k] * value
    short = np.flatnonzero(sizes <= TOGETHER)
    for start in range(0, len(short), SLICE):
        part = short[start : start + SLICE]
        lattice = Lattice([found[k] for k in part], pieces)
        key = lang[part][lattice.word] * width + lattice.piece % width
        weight = probability.ravel()[key]
        forward, backward = lattice.sums(weight), lattice.sums(weight, backward=True)
        share = times[part] / np.maximum(forward[lattice.last], 1e-300)
        out += np.bincount(key, forward[lattice.source] * weight * backward[lattice.target] * share[lattice.word], len(out))
    return out.reshape(langs, width)


def uniform(langs: int, pieces: int) -> np.ndarray:
    return np.hstack([np.full((langs, pieces), 1 / max(pieces, 1)), np.full((langs, 1), FOREIGN)])


def fitted(use: np.ndarray) -> np.ndarray:
    """Piece probabilities from expected uses, with some of the uniform distribution mixed in."""
    langs, n = use.shape[0], use.shape[1] - 1
    total = use[:, :n].sum(1, keepdims=True)
    share = np.where(total > 0, use[:, :n] / np.maximum(total, 1e-300), 1 / max(n, 1))
    return np.hstack([(1 - SMOOTH) * share + SMOOTH / max(n, 1), np.full((langs, 1), FOREIGN)])


def fit(counts: dict[str, dict[str, int]], pieces: dict[str, int], passes: int = PASSES) -> Model:
    """``train`` on counts at hand: language -> word -> count."""
    langs, index = sorted(counts), Pieces(pieces)
    rows = [(w, k, n) for k, lang in enumerate(langs) for w, n in counts[lang].items()]
    probability = uniform(len(langs), len(pieces))
    for _ in range(passes if rows else 0):
        found, lang, times = zip(*rows)
        probability = fitted(uses(list(found), np.array(lang), np.array(times, float), probability, index))
    return Model(langs, pieces, probability)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Letter words of lower-cased texts."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    return words.split(spaced, None)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.batches(batches, "text"):
        numbers, at, distinct = _letters(words.text_array(batch.column("text")))
        lang = batch.column("lang").dictionary_encode()
        code = np.repeat(np.asarray(lang.indices), np.diff(at))
        keys, n = np.unique(code.astype(np.int64) * max(len(distinct), 1) + numbers, return_counts=True)
        which, word = np.divmod(keys, max(len(distinct), 1))
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(which)).cast(pa.string()), distinct.take(pa.array(word)).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all rows with a text and a language."""
    slim = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return slim.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(vocabulary(path))


def _uses(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, probability = shared.value
        code, total = {x: k for k, x in enumerate(langs)}, np.zeros_like(probability)
        for batch in batches:
            lang = np.array([code[x] for x in batch.column("lang").to_pylist()], np.int64)
            total += uses(batch.column("word").to_pylist(), lang, np.asarray(batch.column("n")).astype(float), probability, _pieces(path))
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total.ravel()[key])], ["key", "value"])

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocab: str | None = None, passes: int = PASSES) -> Model:
    """Fit on all words of all rows with a language."""
    spark, path = docs.sparkSession, vocab or vocabulary_path()
    counts = staged(word_counts(docs, text_col, lang_col), "word-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} labels in {lang_col}: no language column")
    pieces = vocabulary(path)
    probability = uniform(len(langs), len(pieces))
    for _ in range(passes if langs else 0):
        shared = spark.sparkContext.broadcast((langs, probability))
        # At most one number a language and piece.
        found = counts.mapInArrow(_uses(shared, path), "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
        use = np.zeros(probability.size)
        use[np.asarray(found.column("key"))] = np.asarray(found.column("value"))
        probability = fitted(use.reshape(probability.shape))
        shared.unpersist()
    return Model(langs, pieces, probability)


def judged(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(number of each text's language, that of none being the number of languages; its share of the likelihood)."""
    numbers, at, distinct = _letters(texts)
    pick, score = np.full(len(at) - 1, len(model.langs)), np.zeros(len(at) - 1)
    if len(model.langs) and len(numbers):
        each = model.words(words.strings(distinct))
        full = np.flatnonzero(np.diff(at) > 0)
        total = np.zeros((len(full), each.shape[1]))
        for k in range(each.shape[1]):
            total[:, k] = np.add.reduceat(each[numbers, k], at[:-1][full])
        best = total.argmax(1)
        pick[full] = best
        score[full] = 1 / np.exp(np.minimum(total - total[np.arange(len(full)), best][:, None], 0)).sum(1)
    return pick, score


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*shared.value.langs, UNKNOWN], object)
        for batch in words.batches(batches, "text", PREDICT_BYTES):
            pick, score = judged(words.text_array(batch.column("text")), shared.value)
            rest = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            rest |= {"lang_pred": pa.array(langs[pick].tolist(), pa.string()), "score": pa.array(score)}
            yield pa.RecordBatch.from_arrays(list(rest.values()), list(rest))

    return run


def _known(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.batches(batches, text, PREDICT_BYTES):
            pick, _ = judged(words.text_array(batch.column(text)), shared.value)
            yield batch.filter(pa.array(pick < len(shared.value.langs)))

    return run


def known_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text, a string, is in one of the model's languages; the text moves once, with its row."""
    numbered = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary x MOST_LANGS
    out = numbered.mapInArrow(_known(shared, f"c{docs.columns.index(text_col)}"), numbered.schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def predict(docs: DataFrame, model: Model, text_col: str = "text", **carry: Column) -> DataFrame:
    """``carry`` columns, lang_pred and score (the language's share of the likelihood) for each row."""
    slim = docs.select(docs[text_col].cast("string").alias("text"), *[c.alias(name) for name, c in carry.items()])
    schema = T.StructType([f for f in slim.schema if f.name != "text"]).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary x MOST_LANGS
    return slim.mapInArrow(_predict(shared), schema)


def held_out(id_column: Column) -> Column:
    """Rows that never train: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, id_col: str = "doc_id") -> Model:
    return train(docs.where(~held_out(docs[id_col])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, trained(docs), doc_id=docs["doc_id"], held_out=held_out(docs["doc_id"]))
