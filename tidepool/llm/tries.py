"""Double-array tries of word numbers, walked at all positions of a text at once.

A word's number is spelled in digits of at most seven bits, so that a state has
few followers and their slots pack well.  First words have a table of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MOST_BITS = 7


@dataclass
class Trie:
    """`base[s] + digit` is the follower's slot, if `check` there is s; `value` is 0 but where a phrase ends."""

    root: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    digits: int
    bits: int

    def to_row(self) -> dict[str, bytes]:
        return {n: getattr(self, n).tobytes() for n in ("root", "base", "check", "value")} | {"digits": self.digits, "bits": self.bits}

    @classmethod
    def from_row(cls, row) -> Trie:
        return cls(*(np.frombuffer(row[n], np.int32) for n in ("root", "base", "check", "value")), row["digits"], row["bits"])

    def walk(self, words: np.ndarray, most: int):
        """For 1 to `most` words: (k, positions at which k words of some phrase start, value of their states)."""
        at = np.flatnonzero((words > 0) & (words < len(self.root)))
        state = self.root[words[at]]
        at, state = at[state > 0], state[state > 0]
        for k in range(1, most + 1):
            yield k, at, self.value[state]
            if k == most:
                return
            alive = at < len(words) - k
            at, state = at[alive], state[alive]
            follower = words[at + k]
            alive = (follower > 0) & (follower < 1 << (self.bits * self.digits))
            at, state, follower = at[alive], state[alive], follower[alive]
            for d in range(self.digits - 1, -1, -1):
                to = self.base[state] + ((follower >> (self.bits * d)) & ((1 << self.bits) - 1))
                alive = np.flatnonzero(self.check[to] == state)
                at, state, follower = at[alive], to[alive], follower[alive]


def _place(parent: np.ndarray, digit: np.ndarray, nodes: int, used: int, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """(base of each node, slot of each edge): no two edges share a slot; nodes with most followers are placed first."""
    rng = np.random.default_rng(0)
    order = np.lexsort((digit, parent))
    parent, digit = parent[order], digit[order]
    starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if parent.size else np.zeros(0, int)
    many = np.diff(np.r_[starts, parent.size])
    free = np.ones(used + parent.size + parent.size // 8 + 4 * fanout, bool)
    free[:used] = False
    owner = np.zeros(free.size, np.int64)
    base = np.zeros(nodes, np.int64)
    place = np.zeros(parent.size, np.int64)
    for c in range(fanout, 1, -1):
        pending = starts[many == c]
        tried = 0
        while pending.size:
            b = rng.integers(used, free.size - fanout, pending.size)
            edges = pending[:, None] + np.arange(c)
            slots = b[:, None] + digit[edges]
            good = np.flatnonzero(free[slots].all(axis=1))
            owner[slots[good]] = pending[good, None]
            won = good[(owner[slots[good]] == pending[good, None]).all(axis=1)]
            free[slots[won]] = False
            place[edges[won]] = slots[won]
            base[parent[pending[won]]] = b[won]
            rest = np.ones(pending.size, bool)
            rest[won] = False
            pending, tried = pending[rest], tried + 1
            if tried % 16 == 0 and pending.size:  # it is too full for nodes of this size
                more = max(fanout * 4, min(free.size // 8, 2 * c * pending.size))
                free, owner = np.r_[free, np.ones(more, bool)], np.r_[owner, np.zeros(more, np.int64)]
    single = starts[many == 1]
    slots = np.flatnonzero(free)[: single.size]
    if slots.size < single.size:
        slots = np.r_[slots, np.arange(free.size, free.size + single.size - slots.size)]
    place[single] = slots
    base[parent[single]] = slots - digit[single]
    out = np.zeros(parent.size, np.int64)
    out[order] = place
    return base, out


def build_trie(phrases: np.ndarray, values: np.ndarray) -> Trie:
    """A trie of different phrases: rows of word numbers from 1, 0 after the last; `values` are over 0."""
    top = int(phrases.max(initial=1))
    digits = -(-top.bit_length() // _MOST_BITS)
    bits = -(-top.bit_length() // digits)
    fanout = 1 << bits
    first, node = np.unique(phrases[:, 0], return_inverse=True)
    nodes, edges = first.size, []
    worth = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    rows = np.arange(len(phrases))
    for k in range(phrases.shape[1]):
        if k:
            going = phrases[rows, k] > 0
            rows, node = rows[going], node[going]
            for d in range(digits - 1, -1, -1):
                digit = (phrases[rows, k].astype(np.int64) >> (bits * d)) & (fanout - 1)
                keys, inverse = np.unique(node.astype(np.int64) * fanout + digit, return_inverse=True)
                edges.append((keys // fanout, keys % fanout, np.arange(nodes, nodes + keys.size)))
                node, nodes = inverse + nodes, nodes + keys.size
        ends = np.ones(rows.size, bool) if k + 1 == phrases.shape[1] else phrases[rows, k + 1] == 0
        worth = [np.r_[worth[0], node[ends]], np.r_[worth[1], values[rows[ends]]]]
    parent, digit, child = (np.concatenate(x) if edges else np.zeros(0, np.int64) for x in (zip(*edges) if edges else ((), (), ())))
    slot = np.zeros(nodes, np.int64)
    used = fanout + first.size  # slots that no digit reaches from an empty base, then first words
    slot[: first.size] = np.arange(fanout, used)
    base_of, place = _place(parent, digit, nodes, used, fanout)
    slot[child] = place
    size = int(max(slot.max(initial=0), base_of.max(initial=0))) + fanout + 1
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    base[slot] = base_of
    check[slot[child]] = slot[parent]
    value[slot[worth[0]]] = worth[1]
    root = np.zeros(int(first.max(initial=0)) + 1, np.int32)
    root[first] = slot[: first.size]
    return Trie(root, base, check, value, digits, bits)
