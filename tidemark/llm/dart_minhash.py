"""Signatures of weighted sets by DartMinHash, over word shingles of whole texts.

A text is the set of its shingles, each with the number of times it occurs as its weight.

Every element owns a plane of weight and rank. Darts fall on it as a Poisson process
that depends on the element's hash alone: within each unit of weight their ranks are
sums of hashed exponential gaps. A dart counts if it falls below the element's
weight; its hash names one of ``k`` coordinates, and each coordinate keeps the
earliest dart of all elements. Two sets agree on a coordinate with the probability
of their weighted Jaccard similarity. Only ranks up to a bound that fills all
coordinates with high probability are thrown; a set that has a coordinate left
empty is thrown at again with twice the bound, which changes no filled coordinate.

All steps work on arrays that hold many texts at once.
"""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
#: White space beyond ASCII.
OTHER_SPACE = re.compile(r"[^\S\t-\r ]")
GOLD, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Odd base of the polynomial hash of a word, and its inverse modulo 2^64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once.
GROUP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (in a new array)."""
    x = x ^ (x >> U(30))
    x *= MIX_A
    x ^= x >> U(27)
    x *= MIX_B
    x ^= x >> U(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    held = _POWERS.get(str(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, GROUP + 4096), base, dtype=U)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if len(held) <= GROUP + 4096:
            _POWERS[str(base)] = held
    return held[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, in order; words are split at white space."""
    encoded = [OTHER_SPACE.sub(" ", t.lower()).encode("utf-8", "replace") for t in texts]
    data = b"\n".join(encoded)
    starts_at = np.cumsum([0, *(len(e) + 1 for e in encoded[:-1])])
    codes = np.frombuffer(data, dtype=np.uint8)
    if not len(codes):
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.empty(len(codes) + 1, dtype=U)
    sums[0] = 0
    np.cumsum((codes.astype(U) + U(1)) * powers(BASE, len(codes)), out=sums[1:])
    words = (sums[end] - sums[start]) * powers(INVERSE, len(codes) + 1)[start]
    words = mix(words + (end - start).astype(U) * GOLD)
    return words, np.searchsorted(starts_at, start, "right") - 1


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, count) of each text's distinct shingles, by text and hash.

    A text of fewer words than ``size`` has one shingle, of all its words.
    """
    words, owner = word_hashes(texts)
    n = len(words)
    if not n:
        return words, owner, owner
    factors = mix(np.arange(1, size + 1, dtype=U) * GOLD) | U(1)
    if n >= size:
        whole = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
        grams = np.zeros(len(whole), dtype=U)
        for j in range(size):
            grams += words[whole + j] * factors[j]
    else:
        whole, grams = np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    of = owner[whole]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    length = np.diff(np.r_[first, n])
    short = length < size
    if short.any():
        extra = np.zeros(short.sum(), dtype=U)
        for j in range(size - 1):
            has = length[short] > j
            extra[has] += words[first[short][has] + j] * factors[j]
        grams, of = np.r_[grams, extra], np.r_[of, owner[first[short]]]
    grams = mix(grams)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])
    return grams[new], of[new], np.diff(np.r_[new, len(grams)])


def signatures(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray | None, n_sets: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_sets, k) hashes of the earliest darts, and whether a set has any element.

    ``weights``: any positive numbers; None for 1 each.
    """
    if weights is None:
        ceiling, mass = np.ones(len(hashes)), np.bincount(owner, minlength=n_sets).astype(float)
        cell, element = mix(hashes + GOLD), np.arange(len(hashes))
    else:
        cells = np.ceil(weights).astype(np.int64)
        cell, element = occurrences(hashes, np.arange(len(hashes)), cells)
        place = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
        ceiling = np.minimum(1.0, weights[element] - place)
        mass = np.bincount(owner, weights=weights, minlength=n_sets)
    cell_owner = owner[element]
    best = np.full(n_sets * k, np.inf)
    ident = np.zeros(n_sets * k, dtype=U)
    open_sets, darts = mass > 0, k * (np.log(k) + 2)
    while open_sets.any():
        bound = np.divide(darts, mass, out=np.zeros(n_sets), where=mass > 0)
        best.reshape(n_sets, k)[open_sets] = np.inf
        active = np.flatnonzero(open_sets[cell_owner])
        limit = bound[cell_owner[active]]
        rank, throw = np.zeros(len(active)), 0
        keys, ranks, names = [], [], []
        while len(active):
            throw += 1
            z = mix(cell[active] + U(throw * int(MIX_B) % (1 << 64)))
            rank = rank - np.log(((z >> U(11)).astype(np.float64) + 1) * 2.0**-53)
            hit = rank <= limit
            active, limit, rank, z = active[hit], limit[hit], rank[hit], mix(z[hit])
            if weights is None:
                below = slice(None)
            else:
                below = (mix(z + GOLD) >> U(11)).astype(np.float64) * 2.0**-53 < ceiling[active]
            keys.append(cell_owner[active[below]] * k + (z[below] >> U(32)).astype(np.int64) % k)
            ranks.append(rank[below])
            names.append(z[below])
        key, r, name = np.concatenate(keys), np.concatenate(ranks), np.concatenate(names)
        np.minimum.at(best, key, r)
        earliest = r == best[key]
        ident[key[earliest]] = name[earliest]
        open_sets = open_sets & np.isinf(best.reshape(n_sets, k)).any(axis=1)
        darts *= 2
    return ident.reshape(n_sets, k), mass > 0


def occurrences(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every occurrence of a shingle; the Jaccard similarity of these sets is the weighted one."""
    element = np.repeat(np.arange(len(hashes)), counts)
    place = np.arange(len(element)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(hashes[element] + GOLD * (place + 1).astype(U)), owner[element]


def groups(texts: list[str]):
    """Slices of texts of about ``GROUP`` bytes each."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def bands_of(ident: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band is part of the key."""
    factors = mix(np.arange(1, rows + 1, dtype=U) * MIX_A) | U(1)
    summed = (ident[:, : bands * rows].reshape(len(ident), bands, rows) * factors).sum(axis=2, dtype=U)
    return mix(summed + np.arange(1, bands + 1, dtype=U) * GOLD)
