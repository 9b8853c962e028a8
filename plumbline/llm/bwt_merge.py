"""Repeated windows in a collection of strings, by merging Burrows-Wheeler transforms.

The strings are split into shards; each shard's suffixes are sorted once, by
their first ``width`` symbols, which gives the shard's transform. A merged
order is kept as an interleave only: for each place the shard whose next row
stands there. The interleave by the first symbols starts from the shards'
sorted rows; that by the first h + 2 symbols follows from that by the first h:
the places are dealt, in order, by the two symbols that the transforms hold for
them, each shard's rows being read in its own order. No suffix is compared or
sorted again. Two neighbours part in the step that first tells them apart;
those that never parted within ``width`` symbols share a prefix of that length
and form one repeated interval.
"""

from __future__ import annotations

import numpy as np

SHARD_SYMBOLS = 1 << 17
#: Symbols that the interleave starts from, and that a step adds.
START, STEP = 8, 2
LAST = np.iinfo(np.int64).max


def _joined(head: np.ndarray, tail: np.ndarray, skip: int, bits: int) -> np.ndarray:
    """``head`` with ``bits`` bits of what stands ``skip`` places on, unless a string ended before."""
    out, n = head << np.uint64(bits), max(len(head) - skip, 0)
    out[:n] |= np.where(head[:n] & np.uint64(255), tail[skip : skip + n], np.uint64(0))
    return out


def leading(symbols: np.ndarray) -> np.ndarray:
    """The next eight symbols at each place as one number, with 0 from a string's end on."""
    one = symbols.astype(np.uint64)
    two = _joined(one, one, 1, 8)
    four = _joined(two, two, 2, 16)
    return _joined(four, four, 4, 32)


def string_order(lead: np.ndarray, room: np.ndarray, width: int) -> np.ndarray:
    """Suffix order, by ``width`` symbols at least, of strings that each end in 0; ``room``: symbols before that end."""
    n = len(lead)
    by = np.argsort(lead)
    heads = np.flatnonzero(np.concatenate([[True], lead[by][1:] != lead[by][:-1]]))
    sizes = np.diff(np.append(heads, n))
    order, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    order[:] = by
    rank[by] = np.repeat(heads, sizes)
    todo = by[np.repeat(sizes > 1, sizes)]
    step = START
    while len(todo) and step < width:
        key = rank[todo]
        for k in (1, 2):
            place = todo + k * step
            key = key << 21 | np.where(room[todo] >= k * step, rank[np.minimum(place, n - 1)] + 1, 0)
        by = np.argsort(key)
        todo, key = todo[by], key[by]
        group = rank[todo]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        row = group + np.arange(len(todo)) - np.repeat(first, np.diff(np.append(first, len(todo))))
        order[row] = todo
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(todo)))
        rank[todo] = np.repeat(row[heads], sizes)
        todo = todo[np.repeat(sizes > 1, sizes)]
        step *= 3
    return order


class Shard:
    """A shard's transform: for each of its rows, in order, the two symbols before it; and how its suffix lies in its string."""

    def __init__(self, symbols: np.ndarray, room: np.ndarray, before: np.ndarray, width: int):
        lead = leading(symbols)
        self.order, self.width = string_order(lead, room, width), width
        self.lead, self.room, self.before = lead[self.order], room[self.order], before[self.order]
        near = np.concatenate([[0], symbols[:-1]]).astype(np.uint16)
        far = np.concatenate([[0], near[:-1]]).astype(np.uint16)
        self.code = (far << np.uint16(8) | near)[self.order]

    def rows(self, h: int) -> np.ndarray:
        """The rows whose first h symbols are the last h of ``width`` symbols inside a string; no other leads to such a prefix."""
        return np.flatnonzero((self.room >= h) & (self.before >= self.width - h))


def merge(shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards by ``width`` symbols (a shard's number for each place), and where a new prefix starts.

    Suffixes of fewer symbols have no place in it. ``width`` must be even.
    """
    h = START if width >= START else 0
    rows = [s.rows(h) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint32), [len(x) for x in rows])
    new = np.arange(len(z)) == 0
    if h:
        lead = np.concatenate([s.lead[x] for s, x in zip(shards, rows)])
        by = np.argsort(lead, kind="stable")  # sorted runs, one a shard, so this only merges
        z, lead = z[by], lead[by]
        np.not_equal(lead[1:], lead[:-1], out=new[1:])
    while h < width:
        # What the transforms hold for each place: every shard's rows are read in its order.
        code, group = np.empty(len(z), np.uint16), np.cumsum(new, dtype=np.int32)
        code[np.argsort(z, kind="stable")] = np.concatenate([s.code[s.rows(h)] for s in shards])
        by = np.argsort(code, kind="stable")
        z, code, group = z[by], code[by], group[by]
        np.not_equal(code[1:], code[:-1], out=new[1:])
        new[1:] |= group[1:] != group[:-1]
        h += STEP
    return z, new


def least_owners(body: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int) -> np.ndarray:
    """For each byte of the strings in ``body``: the least owner of a string that has the ``width`` bytes from it, LAST where a string ends before.

    ``width`` must be even. Bytes of 0xFF do not occur in UTF-8 and are not supported.
    """
    least = np.full(len(body), LAST)
    if not len(lengths):
        return least
    ends = np.cumsum(lengths)
    cuts = [0]
    while cuts[-1] < len(lengths):
        start = ends[cuts[-1]] - lengths[cuts[-1]]
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends + np.arange(len(ends)), start + cuts[-1] + SHARD_SYMBOLS, "right"))))
    shards, places = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        size, begin = lengths[a:b], int(ends[a] - lengths[a])
        k = b - a
        symbols = np.zeros(int(size.sum()) + k, np.uint8)
        where = np.arange(int(size.sum())) + np.repeat(np.arange(k), size)
        symbols[where] = body[begin : begin + int(size.sum())] + 1
        tails = np.cumsum(size) + np.arange(k)  # each string's end
        room = np.repeat(tails, size + 1) - np.arange(len(symbols))
        place = np.full(len(symbols), -1, np.int64)
        place[where] = np.arange(begin, begin + int(size.sum()))
        before = np.arange(len(symbols)) - np.repeat(tails - size, size + 1)
        shards.append(shard := Shard(symbols, room, before, width))
        places.append(place[shard.order[shard.rows(width)]])
    z, new = merge(shards, width)
    if len(z):
        at = np.empty(len(z), np.int64)
        at[np.argsort(z, kind="stable")] = np.concatenate(places)
        heads = np.flatnonzero(new)
        of = np.repeat(owners, lengths)[at]
        least[at] = np.repeat(np.minimum.reduceat(of, heads), np.diff(np.append(heads, len(z))))
    return least


def distinct(body: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each string's first equal, least owner for each of those that are first, by number)."""
    raw, ends = body.tobytes(), np.cumsum(lengths).tolist()
    seen: dict[bytes, int] = {}
    of = np.empty(len(lengths), np.int64)
    start = 0
    for k, end in enumerate(ends):
        of[k] = seen.setdefault(raw[start:end], len(seen))
        start = end
    least = np.full(len(seen), LAST)
    np.minimum.at(least, of, owners)
    return of, least


def later_windows(body: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """For each byte of the strings in ``body``: whether the ``width`` bytes from it also start in a string of smaller id.

    Equal strings enter the merge once, with the least of their ids.
    """
    if not len(lengths):
        return np.zeros(len(body), bool)
    of, owners = distinct(body, lengths, ids)
    first = np.full(len(owners), len(of))
    np.minimum.at(first, of, np.arange(len(of)))
    begins, sizes = np.cumsum(lengths) - lengths, lengths[first]
    places = lambda start, size: np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    least = least_owners(body[places(begins[first], sizes)], sizes, owners, width)
    return least[places((np.cumsum(sizes) - sizes)[of], lengths)] < np.repeat(ids, lengths)
