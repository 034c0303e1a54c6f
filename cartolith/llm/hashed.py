"""Hashed n-grams of many texts at once, as numpy arrays.

Texts are taken whole, but a bounded number of characters at a time: a `Block` holds short texts together or one
stretch of a long text. A stretch reaches a little into the next one, so every n-gram is seen once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Characters of one block.
BLOCK_CHARS = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that their leading bits can serve as a bucket."""
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def blocks(texts: Iterable[str | None], reach: int) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (row, lower-cased stretch, number of its own characters); what lies beyond is the reach into the next."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for a in range(0, len(text or ""), BLOCK_CHARS):
            own = text[a : a + BLOCK_CHARS].lower()
            held.append((row, own + text[a + BLOCK_CHARS : a + BLOCK_CHARS + reach].lower(), len(own)))
            size += len(own)
            if size >= BLOCK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_grams(texts: Iterable[str | None], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every character n-gram, block by block and order by order; a row's entries are adjacent."""
    reach = max(orders) - 1
    for held in blocks(texts, reach):
        points = _points("".join(t for _, t, _ in held)).astype(np.uint64)
        size = np.array([len(t) for _, t, _ in held])
        end = np.repeat(np.cumsum(size), size)
        at = np.arange(len(points))
        row = np.repeat(np.array([r for r, _, _ in held]), size)
        own = at < np.repeat(np.cumsum(size) - size + np.array([n for *_, n in held]), size)
        for n in orders:
            h = np.full(max(0, len(points) - n + 1), n, np.uint64)
            for k in range(n):
                h = h * _ODD + points[k : k + len(h)]
            whole = own[: len(h)] & (at[: len(h)] + n <= end[: len(h)])
            yield row[: len(h)][whole], bucket(h[whole], bits)


def _in_word(c: str) -> bool:
    return c >= "\x80" or c.isalnum()


def words(texts: Iterable[str | None], reach_words: int = 0, stems: tuple[int, ...] = ()) -> Iterator[tuple]:
    """(row, hash, own, stem hashes) of the words of each text: lower-cased runs of ASCII letters and digits and of
    characters beyond ASCII. ``stems`` gives lengths of word beginnings to be hashed as well.

    A stretch of a long text ends between words; ``reach_words`` words after it follow with ``own`` false.
    """
    held, size = [], 0

    def hashed(held):
        row = np.array([r for r, *_ in held])
        text = "\n".join(t for _, t, _ in held) + "\n"
        points = _points(text)
        inside = (points >= 128) | ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0]))))
        begin, stop = edges[::2], edges[1::2]
        if not len(begin):
            return row[:0], np.zeros(0, np.uint64), np.zeros(0, bool), [np.zeros(0, np.uint64) for _ in stems]
        length = stop - begin
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        power = np.cumprod(np.concatenate(([1], np.full(int(length.max()), _ODD, np.uint64))), dtype=np.uint64)
        terms = (points[np.repeat(begin, length) + place].astype(np.uint64) + np.uint64(1)) * power[place]
        at = np.cumsum(length) - length
        h = mix(np.add.reduceat(terms, at))
        beginnings = [mix(np.add.reduceat(np.where(place < k, terms, np.uint64(0)), at) + np.uint64(k)) for k in stems]
        ends = np.cumsum([len(t) + 1 for _, t, _ in held])
        part = np.searchsorted(ends, begin, "right")
        own = begin < (ends - np.array([len(t) + 1 for _, t, _ in held]) + np.array([n for *_, n in held]))[part]
        return row[part], h, own, beginnings

    for row, text in enumerate(texts):
        text, a = (text or "").lower(), 0
        while a < len(text):
            b = a + BLOCK_CHARS
            while b < len(text) and _in_word(text[b]):
                b += 1
            c = b
            for _ in range(reach_words if b < len(text) else 0):
                while c < len(text) and not _in_word(text[c]):
                    c += 1
                while c < len(text) and _in_word(text[c]):
                    c += 1
            held.append((row, text[a:c], min(b, len(text)) - a))
            size += c - a
            a = b
            if size >= BLOCK_CHARS:
                yield hashed(held)
                held, size = [], 0
    if held:
        yield hashed(held)


def distinct_rows(row: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with the number of their occurrences, by row."""
    key, count = np.unique((row.astype(np.int64) << bits) | feature, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count
