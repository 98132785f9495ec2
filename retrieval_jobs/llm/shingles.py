"""Word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone modulo 2**64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = U(1)
    return np.multiply.accumulate(out)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z lower-cased, and the number of words of each text.

    Words are the runs of characters other than the six ASCII blanks. A word's hash is its polynomial
    in BASE, taken from running sums over the bytes of all texts.
    """
    raw = [x.encode("utf-8", "surrogatepass").translate(LOWER) for x in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    inverse = U(pow(int(BASE), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * _powers(BASE, len(data)))])
    polynomial = (sums[ends] - sums[starts]) * _powers(inverse, len(data))[starts]
    hashes = mix(polynomial ^ ((ends - starts).astype(U) << U(48)))
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    return hashes, np.bincount(owner, minlength=len(texts))


def shingle_sets(texts: Sequence[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; a text of fewer words has its whole sequence, one without words nothing."""
    with np.errstate(over="ignore"):
        hashes, counts = word_hashes([x or "" for x in texts])
        out, at = [], 0
        for n in counts.tolist():
            own = hashes[at : at + n]
            at += n
            width = min(words, n)
            if not n:
                out.append(own)
                continue
            total = np.full(n - width + 1, U(width), U)
            for k in range(width):
                total = total * BASE + own[k : n - width + 1 + k]
            out.append(np.unique(mix(total)))
        return out
