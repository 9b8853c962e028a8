"""Token ids of text columns by a public tokenizer file."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm import words

#: Distinct chunks a worker remembers before it starts afresh.
MEMO_ENTRIES = 600_000

# The pre-tokenizer's classes for code points below U+0100.
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = "\t-\r \x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class TokenIds:
    """Ids of whole texts, with each distinct white-space-free chunk encoded once.

    White space separates pre-tokens, so the ids of a text are those of its
    chunks one after another. Texts with code points above U+00FF go to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_letters()
        self.simple = self._has_expected_stages()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _has_expected_stages(self) -> bool:
        import json

        stages = json.loads(self.tokenizer.to_str())
        split = (stages["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        kinds = [x.get("type") for x in (stages["normalizer"] or {}).get("normalizers", [])]
        # Fixed value: the pattern that PIECES stands for.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": pattern} and self.tokenizer.get_vocab_size() < 1 << 16

    def _piece(self, piece: str) -> bytes:
        if (found := self.pieces.get(piece)) is None:
            spelt = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
            found = np.array([t.id for t in self.model.tokenize(spelt)], "<u2").tobytes()
            self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk:  # may hold the name of a special token
            found = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
        else:
            found = b"".join(map(self._piece, PIECES.findall(chunk)))
        self.chunks[chunk] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of each text's ids, ids)."""
        at, body = words.raw(texts)
        high = np.concatenate([[0], np.cumsum(body >= 0xC4)])
        hard = high[at[1:]] > high[at[:-1]] if self.simple else np.ones(len(texts), bool)
        ids, offsets = self._easy(pc.if_else(pa.array(hard), "", texts) if hard.any() else texts)
        if hard.any():
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for k in np.flatnonzero(hard):
                parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts) if parts else ids
        return offsets, ids

    def _easy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks) > MEMO_ENTRIES:
            self.chunks = {}
        if len(self.pieces) > MEMO_ENTRIES:
            self.pieces = {}
        numbers, at, distinct = words.split(pc.utf8_lower(texts), None)
        if any_special := pc.any(pc.match_substring(distinct, "<|")).as_py():
            numbers, at, distinct = words.split(texts, None)  # special names are matched before lower-casing
        known = self.chunks
        coded = []
        for chunk in words.strings(distinct):
            key = chunk if not any_special or "<|" in chunk else chunk.lower()
            coded.append(found if (found := known.get(key)) is not None else self._chunk(key))
        counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        flat = np.frombuffer(b"".join(coded), "<u2")
        each = counts[numbers]
        ids = flat[words.gather(starts[numbers], each)].astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[at]


@functools.lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end`` after each one's ids."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    place = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))
    out[place] = ids
    return offsets + np.arange(n + 1), out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
