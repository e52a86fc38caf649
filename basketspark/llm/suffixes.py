"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's strings."""

from __future__ import annotations

import numpy as np

from ._bytes import prefix_hashes, span_hashes

#: The symbol between two strings; bytes are above it, the sentinel is 0.
MARK = 1


def types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the positions of the leftmost of each such run."""
    n = len(s)
    rise = np.sign(np.diff(s, append=-1).astype(np.int64))
    at = np.where(rise != 0, np.arange(n), n)
    after = np.minimum.accumulate(at[::-1])[::-1]
    small = rise[np.minimum(after, n - 1)] > 0
    small[n - 1] = True
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def induce(s: np.ndarray, small: np.ndarray, left: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from those at ``left`` given in order.

    The scans of induced sorting go bucket by bucket. What a bucket puts into itself are
    the positions before it with the same symbol: first those one before, then those two
    before, and so on. So a bucket is completed and passed on as an array.
    """
    n = len(s)
    size = np.bincount(s, minlength=sigma)
    stop = np.cumsum(size)
    start = stop - size
    sa = np.full(n, -1, np.int64)
    # how often the symbol of a position stands before it without a break
    new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    before = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))

    def ranks(c: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.arange(len(c)) - (np.cumsum(counts) - counts)[c]

    def own(block: np.ndarray) -> np.ndarray:
        """What a block puts into its own bucket, in order."""
        k = before[block]
        if not k.any():
            return block[:0]
        i = np.repeat(np.arange(len(block)), k)
        step = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + 1
        by = np.argsort(step, kind="stable")
        return block[i[by]] - step[by]

    by = left[np.argsort(s[left], kind="stable")]
    counts = np.bincount(s[by], minlength=sigma)
    seeds = stop - counts
    sa[seeds[s[by]] + ranks(s[by], counts)] = by

    head = start.copy()
    present = np.flatnonzero(size)
    for c in present:
        # of the larger suffixes those before the same symbol are larger themselves; those before a seed aren't of its symbol
        block = sa[start[c] : head[c]]
        more = own(block)
        sa[head[c] : head[c] + len(more)] = more
        head[c] += len(more)
        block = np.concatenate([sa[start[c] : head[c]], sa[seeds[c] : stop[c]]])
        j = block[block > 0] - 1
        j = j[~small[j] & (s[j] != c)]
        if len(j):
            j = j[np.argsort(s[j], kind="stable")]
            counts = np.bincount(s[j], minlength=sigma)
            sa[head[s[j]] + ranks(s[j], counts)] = j
            head += counts

    tail = stop.copy()
    tail[0] = start[0] + 1  # the sentinel stays
    for c in present[::-1]:
        if c <= MARK:
            continue
        block = sa[tail[c] : stop[c]][::-1]
        more = own(block)
        sa[tail[c] - len(more) : tail[c]] = more[::-1]
        tail[c] -= len(more)
        block = np.concatenate([sa[tail[c] : stop[c]][::-1], sa[start[c] : head[c]][::-1]])
        j = block[block > 0] - 1
        j = j[small[j] & (s[j] != c) & (s[j] != MARK)]  # marks stay in order of their places
        if len(j):
            j = j[np.argsort(s[j], kind="stable")]
            counts = np.bincount(s[j], minlength=sigma)
            sa[tail[s[j]] - 1 - ranks(s[j], counts)] = j
            tail -= counts
    return sa


def substring_names(s: np.ndarray, small: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The ranks of the leftmost-smaller substrings, equal ones with equal ranks.

    Symbol by symbol; of substrings that are still together one ends where all end, since
    with equal symbols a larger suffix is before a smaller one.
    """
    key = s * 2 + small
    last = np.append(left[1:], len(s) - 1) - left
    wide = int(key.max()) + 1
    _, rank, sizes = np.unique(key[left], return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[rank]  # how many are smaller
    active = np.flatnonzero(np.bincount(rank, minlength=len(left))[rank] > 1)
    at = 0
    while len(active):
        at += 1
        active = active[last[active] >= at]
        if not len(active):
            break
        value = rank[active] * wide + key[left[active] + at]
        by = np.argsort(value, kind="stable")
        value, active = value[by], active[by]
        new = np.append(True, value[1:] != value[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        r = rank[active]
        of_group = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), np.arange(len(r)), 0))
        rank[active] = r + first - of_group
        active = active[np.bincount(first, minlength=len(first))[first] > 1]
    return np.unique(rank, return_inverse=True)[1]


def names_in_order(s: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of a string of names, which ends in its only 0, by the same steps one symbol at a time."""
    small, left = types(s)
    if len(left) > 1:
        names = substring_names(s, small, left)
        most = int(names.max()) + 1
        left = left[names_in_order(names, most) if most < len(left) else np.argsort(names)]
    size = np.bincount(s, minlength=sigma)
    stop = np.cumsum(size)
    head, tail = (stop - size).tolist(), stop.tolist()
    symbols, smaller = s.tolist(), small.tolist()
    n = len(symbols)
    sa = [-1] * n
    for i in left[::-1].tolist():
        c = symbols[i]
        tail[c] -= 1
        sa[tail[c]] = i
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not smaller[j]:
            c = symbols[j]
            sa[head[c]] = j
            head[c] += 1
    tail = stop.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and smaller[j]:
            c = symbols[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa)


def symbols(buf: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Bytes as symbols above the marks at ``ends``, with the sentinel."""
    s = np.append(buf.astype(np.int64) + MARK + 1, 0)
    if ends is not None:
        s[ends] = MARK
    return s


def suffix_array(buf: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """The positions of all suffixes of the bytes, in order (linear: recursion on names of leftmost-smaller substrings).

    What stands at ``ends`` (the last position not among them) are marks smaller than every
    byte, in order of their places; so no more of two strings is compared than both have.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    s = symbols(buf, ends)
    small, left = types(s)
    if ends is not None:
        # of marks beside each other every one is the leftmost of its own run, as the next one is greater by its place
        small[ends] = True
        left = np.union1d(left, ends)
    if len(left) > 1:
        sa = induce(s, small, left, 258)
        is_left = np.zeros(len(s), bool)
        is_left[left] = True
        in_order = sa[is_left[sa]]
        stops = np.zeros(len(s), np.int64)
        stops[left] = np.minimum(np.append(left[1:], len(s) - 1) + 1, len(buf))
        part = span_hashes(prefix_hashes(buf), in_order, np.maximum(stops[in_order], in_order))
        new = np.append(True, part[1:] != part[:-1])
        new[: min(2, len(new))] = True  # the sentinel's is a part of its own
        if ends is not None:
            marked = np.zeros(len(s) + 1, bool)
            marked[ends] = True
            alone = marked[in_order] | marked[np.maximum(stops[in_order] - 1, 0)]
            new |= alone
            new[1:] |= alone[:-1]
        names = np.cumsum(new) - 1
        if names[-1] + 1 < len(left):
            of = np.zeros(len(s), np.int64)
            of[in_order] = names
            left = left[names_in_order(of[left], int(names[-1]) + 1)]
        else:
            left = in_order
    return induce(s, small, left, 258)[1:]


def common_prefixes(buf: np.ndarray, sa: np.ndarray, cap: int, ends: np.ndarray | None = None) -> np.ndarray:
    """For each position the length, up to ``cap``, that its suffix shares with the one before it in order."""
    n = len(buf)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([symbols(buf, ends), np.zeros(cap + 8, np.int64)])
    word = np.zeros(n + cap, np.int64)
    for j in range(6):  # six symbols of nine bits in a word
        word = word << 9 | padded[j : j + n + cap]
    plcp = np.zeros(n, np.int64)
    alive = np.flatnonzero(before >= 0)
    for at in range(0, cap, 6):
        same = word[alive + at] == word[np.minimum(before[alive] + at, n + cap - 1)]
        i = alive[~same]
        d = word[i + at] ^ word[before[i] + at]
        plcp[i] = at + 5 - np.floor(np.log2(d.astype(float))).astype(np.int64) // 9
        alive = alive[same]
    plcp[alive] = cap
    return np.minimum(plcp, cap)
