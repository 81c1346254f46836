"""Suffixes of many short texts in order, by grouping them by their Lyndon prefixes.

A suffix's Lyndon prefix ends where the next smaller suffix of its text starts. These are found for all texts at once,
place by place from the last on: while the next candidate is greater, that one's next smaller suffix is the candidate.
Suffixes with the same Lyndon prefix are a group, and groups are in the order of their prefixes. Within a group, the
next smaller suffixes decide, so the groups along their chain are compared, twice as many in each round.

The end of a text is below all symbols. Equal suffixes of different texts are neighbours in any order. Rounds go with the
longest text and not with the number of texts, so this is for texts of some hundred symbols at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The order of all suffixes of a sequence of numbers; a shorter suffix comes before one that it starts."""
    if not len(symbols):
        return []
    ranks = np.unique(np.asarray(symbols), return_inverse=True)[1].astype(np.uint32)
    return sorted_suffixes(ranks[None], np.array([len(ranks)]))[1].tolist()


def sorted_suffixes(symbols: np.ndarray, sizes: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of all suffixes of at least ``least`` symbols, in order.

    Each row of symbols is a text, as unsigned numbers of at most four bytes; sizes has how many of them count.
    """
    by_size = np.argsort(-sizes, kind="stable")
    sizes = sizes[by_size]
    words, step = packed_words(symbols[by_size], sizes)
    after = next_smaller(words, sizes, step)
    width, n = words.shape
    # the suffixes asked for, and those that their chains reach
    used = np.arange(width)[:, None] + least <= sizes
    for i in range(width - 1):
        rows = np.flatnonzero(used[i])
        used[after[i, rows], rows] = True
    used[sizes, np.arange(n)] = False
    at = np.flatnonzero(used)
    place, row, end = at // n, at % n, after.ravel()[at].astype(np.int64)
    group = prefix_groups(words, at, end - place, step)
    number = np.full(words.size, len(at), np.int32)  # the ends of texts come after all others
    number[at] = np.arange(len(at))
    chain = np.append(number[end * n + row], len(at))
    while True:
        same = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
        deeper = refined(group[same], np.append(group, -1)[chain[same]])
        if np.array_equal(deeper, group[same]):
            break
        group[same], chain = deeper, chain[chain]
    order = np.argsort(group, kind="stable")
    order = order[place[order] + least <= sizes[row[order]]]
    return by_size[row[order]], place[order]


def packed_words(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """As many symbols as eight bytes hold from each place (row) of each text (column) on, and how many these are.

    Past a text's end they are zero.
    """
    step, bits = 8 // symbols.itemsize, np.uint64(8 * symbols.itemsize)
    n, width = symbols.shape
    padded = np.zeros((width + step, n), np.uint64)
    padded[:width] = np.where(np.arange(width)[:, None] < sizes, symbols.T, 0)
    words = np.zeros((width + 1, n), np.uint64)
    for k in range(step):
        words <<= bits
        words |= padded[k : k + width + 1]
    return words, step


def next_smaller(words: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """Where the next smaller suffix of a text starts, for each place of it. Texts come by falling size."""
    width, n = words.shape
    flat, after = words.ravel(), np.zeros(words.shape, np.int32)
    for i in range(width - 2, -1, -1):
        live = np.arange(np.searchsorted(-sizes, -i))  # those longer than i
        found = np.full(len(live), i + 1)
        while len(live):
            live = live[found[live] < sizes[live]]
            live = live[less(flat, i * n + live, found[live] * n + live, step * n)]
            found[live] = after[found[live], live]
        after[i, : len(found)] = found
    return after


def less(flat: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Whether suffixes are less than later ones of the same texts; a text's next word is ``step`` on."""
    out, tied = np.zeros(len(a), bool), np.arange(len(a))
    while len(tied):
        x, y = flat[a], flat[b]
        out[tied] = x < y
        same = np.flatnonzero((x == y) & (b + step < len(flat)))  # where the later one ends, it is less
        a, b, tied = a[same] + step, b[same] + step, tied[same]
    return out


def prefix_groups(words: np.ndarray, at: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
    """A number for the first ``length`` symbols from each place on, in their order."""
    flat, ahead = words.ravel(), step * words.shape[1]
    masks = np.array([2**64 - 2 ** (64 - 64 // step * k) for k in range(step + 1)], np.uint64)
    group = refined(np.zeros(len(at), np.int64), flat[at] & masks[np.minimum(length, step)])
    k = 1
    while (longer := length > k * step).any():
        open_ = np.zeros(len(at), bool)
        open_[group[longer]] = True
        part = np.flatnonzero(open_[group] & (np.bincount(group)[group] > 1))
        left = np.clip(length[part] - k * step, 0, step)
        group[part] = refined(group[part], flat[np.minimum(at[part] + k * ahead, len(flat) - 1)] & masks[left])
        k += 1
    one = np.zeros(len(at), np.int64)
    one[group] = length
    return refined(group, length) if (one[group] != length).any() else group  # zeros at the end of the longer


def refined(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers of whole groups that a key splits: a group's number is that of all before it, so others stay as they are."""
    order = np.lexsort((key, group))
    group_of, key = group[order], key[order]
    place = np.arange(len(order))
    head = np.ones(len(order), bool)
    head[1:] = group_of[1:] != group_of[:-1]
    new = head.copy()
    new[1:] |= key[1:] != key[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = group_of + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
    return out
