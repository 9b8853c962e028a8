"""Words of Arrow text columns, as numbers.

Texts are split by Arrow and dictionary-encoded, so Python sees each distinct
word of a batch once; everything per word is a numpy gather.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled together; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20


def byte_table(lower: bool, keep) -> np.ndarray:
    """A 256-entry map of bytes: ``keep(b)`` stays, all else becomes a space."""
    out = np.array([b if keep(b) else 0x20 for b in range(256)], np.uint8)
    if lower:
        for b in range(0x41, 0x5B):
            out[b] = b + 32
    return out


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM_WORDS = byte_table(True, lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: ``[^\x20\x09-\x0D]+`` after A-Z became a-z.
BLANK_WORDS = byte_table(True, lambda b: not (b == 0x20 or 9 <= b <= 13))


def text_array(column) -> pa.Array:
    """A gapless large_string array without nulls (a null becomes an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.concat_arrays([column, column[:0]])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a text array."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], body[at[0] : at[-1]]


def from_raw(offsets: np.ndarray, body: np.ndarray) -> pa.Array:
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))


def split(texts: pa.Array, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word numbers, offsets of each text's words, distinct words).

    ``table`` maps bytes before the split at ASCII white space; None leaves
    the texts as they are.
    """
    offsets, body = raw(texts)
    if table is not None:
        texts = from_raw(offsets, table[body])
    lists = pc.ascii_split_whitespace(texts)
    at = np.asarray(lists.offsets).astype(np.int64)
    words = lists.flatten()
    at = at - at[0]
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        words, at = words.filter(pa.array(full)), before[at]
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices).astype(np.int64), at, coded.dictionary


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start .. start + count - 1 of all pairs, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def batches(source: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes at most."""
    for batch in source:
        at, _ = raw(text_array(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker may idle beside the next stage


def strings(distinct: pa.Array) -> list[str]:
    """A string array without nulls as a list, faster than ``to_pylist``."""
    return distinct.to_numpy(zero_copy_only=False).tolist()
