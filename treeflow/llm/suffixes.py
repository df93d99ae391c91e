"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Buckets that hold at least so many suffixes on average are swept whole, as arrays; smaller ones suffix by suffix.
SWEPT = 64


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S), False where it is larger (L); the last is S."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        # a run of one symbol is as its last suffix is, so its type comes from the next place where symbols change
        change = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=text.dtype), n - 1)
        at = np.minimum.accumulate(change[::-1])[::-1]
        out[:-1] = (at < n - 1) & (text[np.minimum(at, n - 2)] < text[np.minimum(at, n - 2) + 1])
    return out


def leftmost_smaller(types: np.ndarray) -> np.ndarray:
    """Places of S suffixes that follow an L suffix, in text order."""
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def _append(sa: np.ndarray, pointer: np.ndarray, where: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Put suffixes at their buckets' pointers, in order; pointers move by step."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
    size = np.diff(np.concatenate([first, [len(c)]]))
    rank = np.arange(len(c)) - np.repeat(first, size)
    sa[pointer[c] + step * rank] = where[order]
    pointer[c[first]] += step * size


def _buckets(text: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.bincount(text, minlength=sigma)
    ends = np.cumsum(counts)
    return counts, ends - counts, ends


def _induce_swept(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes induce: L suffixes forwards, then S suffixes backwards.

    A bucket is swept as a whole. Suffixes that induce others in their own bucket (runs of one symbol) take one wave
    for each symbol of the run.
    """
    n = len(text)
    counts, heads, ends = _buckets(text, sigma)
    sa = np.full(n, -1, text.dtype)
    seed_chars = text[seeds]
    by_char = np.argsort(seed_chars, kind="stable")
    seeds_sorted = seeds[by_char]
    seed_ends = np.cumsum(np.bincount(seed_chars, minlength=sigma))
    seed_heads = np.concatenate([[0], seed_ends[:-1]])
    present = np.flatnonzero(counts).tolist()

    pointer = heads.copy()
    for c in present:
        done = heads[c]
        while True:
            stop = pointer[c]
            if done == stop:
                break
            before = sa[done:stop] - 1
            done = stop
            before = before[before >= 0]
            before = before[~types[before]]
            if len(before):
                _append(sa, pointer, before, text[before], 1)
        own = seeds_sorted[seed_heads[c] : seed_ends[c]] - 1
        own = own[own >= 0]
        own = own[~types[own]]
        if len(own):
            _append(sa, pointer, own, text[own], 1)
    large = pointer - heads
    tail = ends - 1
    for c in reversed(present):
        done = ends[c] - 1
        if c == text[n - 1] and types[n - 1] and tail[c] == ends[c] - 1 and counts[c] == 1:
            sa[tail[c]] = n - 1  # the end marker
            tail[c] -= 1
        while True:
            stop = tail[c]
            if done == stop:
                break
            before = sa[stop + 1 : done + 1][::-1] - 1
            done = stop
            before = before[before >= 0]
            before = before[types[before]]
            if len(before):
                _append(sa, tail, before, text[before], -1)
        before = sa[heads[c] : heads[c] + large[c]][::-1] - 1
        before = before[before >= 0]
        before = before[types[before]]
        if len(before):
            _append(sa, tail, before, text[before], -1)
    return sa


def _induce_each(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """What ``_induce_swept`` makes, one suffix at a time: for alphabets whose buckets are too small to sweep."""
    _, heads, ends = _buckets(text, sigma)
    t, small = text.tolist(), types.tolist()
    out = [-1] * len(t)
    tail = ends.tolist()
    for j in reversed(seeds.tolist()):
        c = t[j]
        tail[c] = p = tail[c] - 1
        out[p] = j
    head = heads.tolist()
    for j in out:  # grows ahead of the place that is read
        if j > 0:
            j -= 1
            if not small[j]:
                c = t[j]
                out[head[c]] = j
                head[c] += 1
    tail = ends.tolist()
    for j in reversed(out):
        if j > 0:
            j -= 1
            if small[j]:
                c = t[j]
                tail[c] = p = tail[c] - 1
                out[p] = j
    return np.array(out, text.dtype)


def _induce(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    return (_induce_swept if len(text) >= SWEPT * sigma else _induce_each)(text, types, seeds, sigma)


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Places of the suffixes of ``text`` in order; its last symbol must be its smallest and occur once.

    Leftmost-smaller substrings are sorted by inducing from their places alone, and named; where names repeat, the
    sequence of names is sorted the same way, by recursion. The sorted leftmost-smaller suffixes induce all others.
    """
    n = len(text)
    if n <= 2:
        return np.argsort(text, kind="stable")
    text = np.ascontiguousarray(text, dtype=np.int32 if n < 1 << 31 else np.int64)
    types = suffix_types(text)
    lms = leftmost_smaller(types).astype(text.dtype)
    if len(lms) > 1:
        sa = _induce(text, types, lms, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        stop = np.empty(n, text.dtype)
        stop[lms] = np.concatenate([lms[1:], [n - 1]]) + 1
        new = np.concatenate([[False], _differ(text, ordered, stop)])
        name = np.empty(n, text.dtype)
        name[ordered] = np.cumsum(new)
        reduced = name[lms]
        names = int(reduced.max()) + 1
        lms = lms[np.argsort(reduced) if names == len(lms) else suffix_array(reduced, names)]
    return _induce(text, types, lms, sigma)


def _differ(text: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether neighbouring leftmost-smaller substrings differ, symbol by symbol while any pair still agrees."""
    a, b = at[:-1], at[1:]
    size = stop[a] - a
    out = size != stop[b] - b
    left = np.flatnonzero(~out)
    k = 0
    while len(left):
        left = left[size[left] > k]
        unlike = text[a[left] + k] != text[b[left] + k]
        out[left[unlike]] = True
        left = left[~unlike]
        k += 1
    return out


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the length of the prefix that each suffix shares with the one before it in the suffix array, up
    to ``most`` symbols, and the place of that suffix (-1 for the first).

    A suffix shares at least as much as the one a step earlier in the text, less the step. So every 64th place is
    compared first, then the places half way between those known, each from the length its neighbour leaves it; four
    symbols (of 16 bits) are compared at once.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + most + 8, np.uint16)
    padded[:n] = text
    fours = np.ndarray((n + most + 4,), "<u8", padded.data, strides=(2,))
    out = np.zeros(n, np.int32)
    step = 64
    todo = np.arange(0, n, step)
    while True:
        known = np.maximum(0, out[todo - step] - step) if step < 64 else np.zeros(len(todo), np.int32)
        left = before[todo] >= 0
        at, k = todo[left], known[left].astype(np.int64)
        while len(at):
            unlike = fours[at + k] ^ fours[before[at] + k]
            more = (unlike == 0) & (k + 4 < most)
            done = ~more
            u = unlike[done]
            same = np.where(u == 0, 4, np.where(u & np.uint64(0xFFFF) != 0, 0, np.where(u & np.uint64(0xFFFFFFFF) != 0, 1, np.where(u & np.uint64(0xFFFFFFFFFFFF) != 0, 2, 3))))
            out[at[done]] = np.minimum(k[done] + same, most)
            at, k = at[more], k[more] + 4
        if step == 1:
            return out, before
        step //= 2
        todo = np.arange(step, n, 2 * step)


def repeated_prefixes(text: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """For each place, whether its suffix shares ``width`` symbols with a neighbour in the suffix array."""
    lengths, before = permuted_prefixes(text, sa, width)
    at = np.flatnonzero(lengths >= width)
    out = np.zeros(len(sa), bool)
    out[at] = True
    out[before[at]] = True
    return out
