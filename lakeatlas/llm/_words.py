"""Words and their 64-bit hashes, computed with numpy over whole batches of texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased before. A text without such bytes has no
words. The hash of a word depends on its bytes only. Two of ``n`` different words collide with probability about
``n * n / 2 ** 65``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
SEGMENT = 1 << 17
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 1024)
        for k, base in enumerate((_P, _P_INVERSE)):
            table = np.full(size, U(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def _segments(data: bytes) -> Iterator[bytes]:
    """Pieces of about SEGMENT bytes which end at white space; a single longer word stays whole."""
    at, n = 0, len(data)
    while n - at > SEGMENT:
        cut = max(data.rfind(c, at, at + SEGMENT) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            after = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(c, at + SEGMENT)) >= 0]
            cut = min(after) if after else n
        yield data[at:cut]
        at = cut
    yield data[at:]


def _hash_joined(pieces: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the pieces, and the number of words of each piece.

    With ``prefixes``, a row for the words and one for their first bytes of each given number (shorter words: whole).
    """
    joined = b" ".join(pieces) + b" "
    data = np.frombuffer(joined, np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # starts and ends by turns, for the last byte is a gap
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    if prefixes:
        hashes = np.stack([hashes, *(mix((sums[np.minimum(starts + k, ends)] - sums[starts]) * inverse[starts]) for k in prefixes)])
    begins = np.cumsum([0] + [len(p) + 1 for p in pieces])
    counts = np.diff(np.searchsorted(starts, begins))
    return hashes, counts


def word_hashes(texts: Iterable[bytes], prefixes: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """The word hashes of each (lower-cased) text, in order; small texts are worked on together."""
    pieces: list[bytes] = []
    owners: list[int] = []
    size = count = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, counts = _hash_joined(pieces, prefixes)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        for k in range(count):
            lo, hi = np.searchsorted(owners, [k, k + 1])
            yield hashes[..., bounds[lo] : bounds[hi]]

    for text in texts:
        if len(text) > SEGMENT:
            if count:
                yield from flush()
            pieces, owners, size, count = [], [], 0, 0
            yield np.concatenate([_hash_joined([s], prefixes)[0] for s in _segments(text)], axis=-1)
            continue
        if count and size + len(text) > SEGMENT:
            yield from flush()
            pieces, owners, size, count = [], [], 0, 0
        pieces.append(text)
        owners.append(count)
        size += len(text) + 1
        count += 1
    if count:
        yield from flush()


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``width`` words; of fewer words, the one run of all; of none, none."""
    n = len(words)
    if not n:
        return words[:0]
    k = min(n, width)
    h = np.full(n - k + 1, U(k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    for i in range(k):
        h = mix(h + words[i : n - k + 1 + i])
    return np.unique(h)


def set_hash(shingles: np.ndarray) -> int:
    """One signed 64-bit value for a set of shingles."""
    with np.errstate(over="ignore"):
        total = np.sum(mix(shingles + U(0x2545F4914F6CDD1D)), dtype=U) + U(len(shingles)) * U(0x9FB21C651E98DF25)
        return int(mix(np.array([total], U)).view(np.int64)[0])


def pack_planes(values: np.ndarray) -> bytes:
    """Bytes of the values by significance, so that leading zeros compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
