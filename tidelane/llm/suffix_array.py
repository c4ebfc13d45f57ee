"""Linear suffix grouping of many short strings in one block.

Every suffix starts with its Lyndon prefix, which ends at the next smaller suffix of its
string.  Suffixes with equal Lyndon prefixes form a group, groups stand in the order of
these prefixes, and within a group suffixes stand in the order of the suffixes that their
next-smaller pointers name.  Those are smaller, so one ascending sweep over the growing
suffix array puts every suffix in its place: no suffix is renamed or sorted again.

The pointers are found from the last position of the strings to the first, in descending
order of position, for all strings of the block in lockstep: from each suffix the chain of
pointers is followed past all greater suffixes.
"""

from __future__ import annotations

import numpy as np

from tidelane.llm.bytetext import span_hashes


def _eights(text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The next eight symbols of every slot as one number, zeros beyond its string."""
    n = len(text)
    out = np.zeros(n, np.uint64)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    at = np.arange(n)
    for j in range(8):
        out |= np.where(at + j < stop, wide[j : n + j], 0).astype(np.uint64) << np.uint64(8 * (7 - j))
    return out


def next_smaller(eights: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For every slot the next slot of its string with a smaller suffix; the slot after a string counts as the empty suffix."""
    pointer = np.arange(len(eights))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    falling = -size
    for p in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        own = first[: int(np.searchsorted(falling, -p, "left"))] + p
        to = own + 1
        at, here, there = np.arange(len(own)), own, to
        while len(at):
            a, b = eights[here], eights[there]
            greater = b > a
            tied = np.flatnonzero(a == b)
            x, y = here[tied], there[tied]
            while len(tied):
                x, y = x + 8, y + 8
                a, b = eights[x], eights[y]
                greater[tied] = b > a
                more = a == b
                tied, x, y = tied[more], x[more], y[more]
            at, here = at[greater], here[greater]
            there = pointer[there[greater]]
            to[at] = there
        pointer[own] = to
    return pointer


def _order_words(eights: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rank of each of some distinct words in dictionary order, a prefix before what it starts."""

    def column(rows: np.ndarray, k: int) -> np.ndarray:
        left = np.clip(size[rows] - 8 * k, 0, 8).astype(np.uint64)
        own = np.where(left > 0, eights[np.minimum(start[rows] + 8 * k, len(eights) - 1)], 0)
        cut = np.where(left > 0, np.uint64(64) - np.uint64(8) * np.maximum(left, 1), 0).astype(np.uint64)
        return (own >> cut) << cut

    rank = np.zeros(len(start), np.int64)
    rows = np.arange(len(start))
    k = 0
    while len(rows):
        c = column(rows, k)
        order = np.lexsort((c, rank[rows]))
        rows, c = rows[order], c[order]
        base = rank[rows]
        new_base = np.concatenate([[True], base[1:] != base[:-1]])
        new = new_base | np.concatenate([[True], c[1:] != c[:-1]])
        within = np.arange(len(rows)) - np.maximum.accumulate(np.where(new_base, np.arange(len(rows)), 0))
        rank[rows] = base + within[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        tied = ~new | np.concatenate([~new[1:], [False]])
        rows = rows[tied]
        k += 1
    return rank


def suffix_array(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of ``data`` in the order of the suffixes of the strings ``data[bounds[i]:bounds[i + 1]]``.

    Equal suffixes of different strings stand in the order of their strings.  Bytes are below 255, as in UTF-8.
    """
    size = np.diff(bounds)
    n, m = len(data), len(size)
    if not n:
        return np.zeros(0, np.int64)
    first = bounds[:-1] + np.arange(m)  # each string has one more slot
    string = np.repeat(np.arange(m), size)
    slot = np.arange(n) + string
    text = np.zeros(n + m, np.uint8)
    text[slot] = data + np.uint8(1)
    eights = _eights(text, np.repeat(first + size, size + 1))
    pointer = next_smaller(eights, first, size)
    length = pointer[slot] - slot
    _, one, group = np.unique(span_hashes(data, np.arange(n), np.arange(n) + length), return_index=True, return_inverse=True)
    group = _order_words(eights, slot[one], length[one])[group]
    # What waits for a slot: a chain through all suffixes that point to it.
    to = pointer[slot]
    order = np.argsort(to, kind="stable")
    same = to[order[1:]] == to[order[:-1]]
    later = np.full(n + m, -1, np.int64)
    later[slot[order[:-1]]] = np.where(same, slot[order[1:]], -1)
    waiting = np.full(n + m, -1, np.int64)
    heads = order[np.concatenate([[True], ~same])]
    waiting[to[heads]] = slot[heads]
    owner = np.full(n + m, -1, np.int64)
    owner[slot] = group
    counts = np.bincount(group)
    free = (np.cumsum(counts) - counts).tolist()
    later, waiting, owner = later.tolist(), waiting.tolist(), owner.tolist()
    out = [0] * n

    for i in (first + size).tolist():
        j = waiting[i]
        while j >= 0:
            g = owner[j]
            out[free[g]] = j
            free[g] += 1
            j = later[j]
    for i in out:  # grows ahead of the sweep
        j = waiting[i]
        while j >= 0:
            g = owner[j]
            out[free[g]] = j
            free[g] += 1
            j = later[j]
    ready = np.array(out, np.int64)
    return ready - (np.searchsorted(first, ready, "right") - 1)
