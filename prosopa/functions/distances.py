"""Weighted sums of edit distances, in array operations over Arrow batches."""

from __future__ import annotations

import numpy as np

#: Masks of tokens that are kept at once, so that a large vocabulary doesn't fill the memory.
KEPT = 1024
#: Machine words by their bits; longer members take several of the last.
WORDS = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}


def _sums(members: list[str], weights: np.ndarray, bits: int, words: int, order: list[tuple[int, str]], out: np.ndarray) -> None:
    """Adds to `out` for each (place, text) of `order` the weighted distances to `members` of at most `words` * `bits` characters."""
    n, kind = len(members), WORDS[bits]
    one, top, none = kind(1), kind(bits - 1), kind(0)
    size = np.array([len(m) for m in members], dtype=np.int64)
    sign = np.frombuffer("".join(members).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(sign)) - np.repeat(np.cumsum(size) - size, size)
    by = np.argsort(sign, kind="stable")
    token, start = np.unique(sign[by], return_index=True)
    part = {int(t): by[a:b] for t, a, b in zip(token, start, [*start[1:], len(by)])}
    held: dict[int, np.ndarray] = {}

    def where(t: int) -> np.ndarray:
        """The places of a token in each member, as bits."""
        if t not in held:
            if len(held) >= KEPT:
                held.clear()
            found = np.zeros((words, n), dtype=kind)
            if (rows := part.get(t)) is not None:
                np.bitwise_or.at(found, (at[rows] // bits, owner[rows]), one << (at[rows] % bits).astype(kind))
            held[t] = found
        return held[t]

    mask = np.zeros((words, n), dtype=kind)
    for w in range(words):
        inside = np.clip(size - bits * w, 0, bits)
        mask[w] = np.where(inside == bits, ~none, (one << np.minimum(inside, bits - 1).astype(kind)) - one)
    whole = int(weights.sum())
    # Sums of distances below 2^53 are exact as floating numbers, whose products are faster.
    exact = float if whole * max(int(size.max()), 1) < 2**53 else np.int64
    weights = weights.astype(exact)
    # Of each prefix of the text at hand: where the column of the distance table goes up and down, as bits.
    ups, downs, before = [np.full((words, n), ~none)], [np.zeros((words, n), dtype=kind)], ""
    a, b = np.empty(n, dtype=kind), np.empty(n, dtype=kind)
    for place, text in order:
        same = 0
        while same < min(len(before), len(text)) and before[same] == text[same]:
            same += 1
        del ups[same + 1 :], downs[same + 1 :]
        for c in text[same:]:
            equal, up, down = where(ord(c)), np.empty((words, n), dtype=kind), np.empty((words, n), dtype=kind)
            carry_up, carry_down = one, none
            for w in range(words):
                u, d, over, under = ups[-1][w], downs[-1][w], up[w], down[w]
                e = equal[w] if w == 0 else equal[w] | carry_down
                np.bitwise_and(e, u, out=a)
                np.add(a, u, out=a)
                np.bitwise_xor(a, u, out=a)
                np.bitwise_or(a, e, out=a)  # where the row above comes across
                np.bitwise_or(a, u, out=b)
                np.invert(b, out=b)
                np.bitwise_or(b, d, out=over)
                np.bitwise_and(u, a, out=under)
                if w + 1 < words:
                    next_up, next_down = over >> top, under >> top
                np.left_shift(over, one, out=over)
                np.bitwise_or(over, carry_up, out=over)
                np.left_shift(under, one, out=under)
                if w:
                    np.bitwise_or(under, carry_down, out=under)
                np.bitwise_or(equal[w], d, out=a)
                np.bitwise_or(a, over, out=b)
                np.invert(b, out=b)
                np.bitwise_and(over, a, out=a)
                np.bitwise_or(under, b, out=up[w])
                down[w] = a
                if w + 1 < words:
                    carry_up, carry_down = next_up, next_down
            ups.append(up)
            downs.append(down)
        before = text
        for w in range(words):
            np.bitwise_and(ups[-1][w], mask[w], out=a)
            np.bitwise_and(downs[-1][w], mask[w], out=b)
            steps = np.bitwise_count(a).view(np.int8) - np.bitwise_count(b).view(np.int8)
            out[place] += int(steps.astype(exact) @ weights)
        out[place] += whole * len(text)


def weighted_distances(members: list[str], weights: list[int], texts: list[str]) -> np.ndarray:
    """For each text the sum of its edit distances to all members, each times its weight. The columns of the
    distance tables of all members go on together, as bits of machine words, and texts that begin alike share theirs."""
    out = np.zeros(len(texts), dtype=np.int64)
    order = sorted(enumerate(texts), key=lambda x: x[1])
    size = np.array([len(m) for m in members])
    bits = np.select([size <= b for b in WORDS], list(WORDS), max(WORDS))
    words = np.maximum(1, -(-size // bits))
    for b, w in sorted(set(zip(bits.tolist(), words.tolist()))):
        at = np.flatnonzero((bits == b) & (words == w))
        _sums([members[i] for i in at], np.asarray(weights, dtype=np.int64)[at], b, w, order, out)
    return out
