"""Suffix order and longest previous factors of segments that lie one after another.

A suffix ends with its segment.  Suffixes are ordered by prefix doubling, which goes on only for
those that are not yet told apart.  Among suffixes in order, the previous and the next one
that start earlier in the texts share the longest beginnings with any earlier suffix; the
larger of both lengths is the longest previous factor.
"""

from __future__ import annotations

import numpy as np

#: Bytes told apart by the first sort: they and how many are left fill 64 bits.
HEAD = 7


def _heads(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The first bytes of every suffix, and how many it has up to ``HEAD``, in order as a number."""
    padded = np.append(data, np.zeros(HEAD, np.uint8))
    heads = np.zeros(len(data), np.uint64)
    for k in range(HEAD):
        heads = (heads << np.uint64(8)) | np.where(rest > k, padded[k : k + len(data)], np.uint8(0))
    return (heads << np.uint64(8)) | np.minimum(rest, HEAD).astype(np.uint64)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each sorted value's group of equal ones, whether it is alone there)."""
    new = np.ones(len(values) + 1, bool)
    new[1:-1] = values[1:] != values[:-1]
    begins = np.flatnonzero(new[:-1])
    return begins[np.cumsum(new[:-1]) - 1], new[:-1] & new[1:]


class SuffixOrder:
    """The suffixes of ``data``, cut at ``edges``, in order.

    ``rank`` grows with the order, the same for suffixes equal up to their ends; ``near`` is the
    rank by the first ``depth`` bytes, the most that doubling passes without exceeding ``size``.
    """

    def __init__(self, data: np.ndarray, edges: np.ndarray, size: int):
        count, lengths = len(data), np.diff(edges)
        self.size = size
        self.rest = np.repeat(edges[1:], lengths) - np.arange(count)
        self.heads = _heads(data, self.rest)
        order = np.argsort(self.heads)
        begin, alone = _groups(self.heads[order])
        rank = np.empty(count, np.int64)
        rank[order] = begin + 1
        self.near, self.depth, done = rank, HEAD, HEAD
        open_ = order[~alone]
        open_ = open_[self.rest[open_] >= done]
        longest = int(lengths.max(initial=0))
        while len(open_) and done < longest:
            ahead = open_ + done
            # Nothing follows a suffix that ends here: that is less than anything.
            follow = np.where(self.rest[open_] > done, rank[np.minimum(ahead, count - 1)], 0)
            pair = (rank[open_] << 32) | follow
            by = np.argsort(pair)
            open_, pair = open_[by], pair[by]
            begin, alone = _groups(pair)
            before, _ = _groups(pair >> 32)
            rank = rank.copy()
            rank[open_] += begin - before
            done *= 2
            if done <= size:
                self.near, self.depth = rank, done
            open_ = open_[~alone]
            open_ = open_[self.rest[open_] >= done]
        self.rank = rank

    def alike(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Do windows of ``size`` bytes at these places have the same bytes?"""
        if self.size <= HEAD:
            shift = np.uint64(8 * (8 - self.size))
            return self.heads[one] >> shift == self.heads[two] >> shift
        # Twice the depth exceeds the size, unless no two windows are the same so far.
        skip = self.size - self.depth
        same = self.near[one] == self.near[two]
        return same & (self.near[one + skip] == self.near[two + skip])

    def shared(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many bytes suffixes share that share ``size`` at least."""
        length = np.full(len(one), self.size)
        most = np.minimum(self.rest[one], self.rest[two])
        # Whole depths first, which ranks tell, then what is left by heads.
        whole = np.flatnonzero(length < most)
        while len(whole):
            alike = self.near[one[whole] + length[whole]] == self.near[two[whole] + length[whole]]
            whole = whole[alike]
            length[whole] = np.minimum(length[whole] + self.depth, most[whole])
            whole = whole[length[whole] < most[whole]]
        going = np.flatnonzero(length < most)
        while len(going):
            a, b = one[going] + length[going], two[going] + length[going]
            differ = (self.heads[a] ^ self.heads[b]) >> np.uint64(8)
            step = np.zeros(len(going), np.int64)
            for k in range(HEAD):
                step += differ < np.uint64(1 << 8 * k)
            length[going] = np.minimum(length[going] + step, most[going])
            going = going[(step == HEAD) & (length[going] < most[going])]
        return length


def _smaller_before(values: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each, down to ``floor``; -1 without any.

    Steps of powers of two over minima, so any run of larger values is passed in few of them.
    """
    at = np.arange(len(values))
    widest = int((at - floor).max(initial=0))
    least = [values]  # least[k][i]: the smallest of 2^k values that end at i
    while 1 << len(least) <= widest:
        half, last = 1 << (len(least) - 1), least[-1]
        wider = last.copy()
        wider[half:] = np.minimum(last[half:], last[:-half])
        least.append(wider)
    place = at - 1
    for k in range(len(least) - 1, -1, -1):
        go = np.flatnonzero(place - (1 << k) + 1 >= floor)
        go = go[least[k][place[go]] >= values[go]]
        place[go] -= 1 << k
    return np.where(place >= floor, place, -1)


def longest_previous_factors(
    suffixes: SuffixOrder, at: np.ndarray, doc: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For the windows at ``at``, which begin at ``place`` of document ``doc``: the length of the
    longest previous factor if it reaches ``size``, else 0; and whether it is the one to keep of
    the windows with its bytes.  Equal places of one document are not earlier than each other.

    Only where a neighbour in suffix order shares ``size`` bytes can the factor be so long.
    """
    factor, leads = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    if len(at) < 2:
        return factor, leads
    order = np.argsort(suffixes.rank[at])
    joined = suffixes.alike(at[order[1:]], at[order[:-1]])
    some = order[np.append(joined, False) | np.append(False, joined)]
    if not len(some):
        return factor, leads
    # Places in the texts as numbers, in order, the same for the same place.
    by_place = np.lexsort((place[some], doc[some]))
    new = np.zeros(len(some), np.int64)
    own_doc, own_place = doc[some][by_place], place[some][by_place]
    new[1:] = (own_doc[1:] != own_doc[:-1]) | (own_place[1:] != own_place[:-1])
    position = np.empty(len(some), np.int64)
    position[by_place] = np.cumsum(new)
    by = np.argsort((suffixes.rank[at[some]] << 32) | position)
    some, position = some[by], position[by]
    where = at[some]
    apart = np.append(True, ~suffixes.alike(where[1:], where[:-1]))
    begins = np.flatnonzero(apart)
    block = np.cumsum(apart) - 1
    stops = np.append(begins[1:], len(some))
    before = _smaller_before(position, begins[block])
    back = len(some) - 1
    after = _smaller_before(position[::-1], back + 1 - stops[block][::-1])[::-1]
    after = np.where(after >= 0, back - after, -1)
    for other in (before, after):
        has = np.flatnonzero(other >= 0)
        length = suffixes.shared(where[has], where[other[has]])
        factor[some[has]] = np.maximum(factor[some[has]], length)
    least = np.minimum.reduceat(position, begins)[block]
    firsts = np.flatnonzero(position == least)
    leads[some] = False
    leads[some[firsts[np.unique(block[firsts], return_index=True)[1]]]] = True
    return factor, leads
