"""Array kernels shared by the text operators of this subpackage.

A batch of texts becomes one array of code points with the offsets of the
texts.  Folding, word spans and hashes of spans are then a handful of numpy
passes over that array, so Python never loops over characters or words.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Characters of one array chunk; bounds the memory of a Python worker whatever the batch holds.
CHUNK_CHARS = 1_000_000

#: Latin and Greek letters and the Macedonian letters they look like, lower and upper case.
LOOKALIKE_LATIN = dict(zip("aeopcyxjsèABEKMHOPCTYXJSÈ", "аеорсухјѕѐАВЕКМНОРСТУХЈЅЀ", strict=True))
LOOKALIKE_GREEK = dict(zip("οΑΒΕΗΚΜΟΡΤΧΥ", "оАВЕНКМОРТХУ", strict=True))
#: Letters whose capitals, but not whose small forms, look alike; only comparison folds them.
LOOKALIKE_BY_CAPITAL = dict(zip("hbmtk", "нвмтк", strict=True)) | dict(zip("αβεηικμνρτυχ", "авенікмнртух", strict=True))

#: What folding gives for characters that vanish, such as marks and invisible characters.
GONE = np.uint32(0xFFFFFFFF)
_PRIME = np.uint64(2**31 - 1)
_BASES = (1_103_515_245, 1_812_433_253)
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of at most `most` characters; a longer single text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets of the texts; null counts as empty."""
    texts = [t or "" for t in texts]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), off


def fold_char(ch: str) -> str:
    """One character in comparison form; "" if it vanishes, " " if it separates words."""
    if unicodedata.category(ch) in ("Mn", "Me", "Cf"):
        return ""
    out = ""
    for c in unicodedata.normalize("NFKD", ch.lower()):
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            continue
        c = {"ı": "i"}.get(c, c)
        c = LOOKALIKE_LATIN.get(c) or LOOKALIKE_GREEK.get(c) or LOOKALIKE_BY_CAPITAL.get(c) or c
        out += c if c.isalnum() else " "
    return out[:1]


@lru_cache(1)
def fold_table() -> np.ndarray:
    """For each code point its comparison form: GONE, 0 for a separator, or a letter or digit."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for block in ((0, 0x3100), (0xFB00, 0xFFFF), (0x1D400, 0x1D800), (0xE0000, 0xE0200)):
        for cp in range(*block):
            f = fold_char(chr(cp))
            table[cp] = GONE if not f else 0 if f == " " else ord(f)
    for block in ((0x3100, 0xFB00), (0x10000, 0x1D400), (0x1D800, 0xE0000)):
        text = "".join(map(chr, range(*block)))
        table[block[0] : block[1]] = [ord(c) if c.isalnum() else 0 for c in text]
    return table


def fold(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Comparison form of the texts: folded characters, offsets, and each character's place before."""
    f = fold_table()[cp]
    at = np.flatnonzero(f != GONE)
    return f[at], np.searchsorted(at, off), at


def word_spans(f: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in folded characters, and the word offsets of the texts."""
    w = f != 0
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    edge = off[1:-1]  # a word never crosses into the next text
    inner = edge[(edge > 0) & (edge < len(f))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    x -= _PRIME * (x >= _PRIME)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of a base modulo the prime; the table grows by doubling and is kept."""
    table = _TABLES.get(base)
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) <= n:
        step = np.uint64(int(table[-1]) * base % int(_PRIME))
        table = np.concatenate([table, _reduced(table * step)])
    _TABLES[base] = table
    return table


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value times base**place, for two bases modulo a prime of 31 bits."""
    mixed = mix(values)
    sums = []
    for base, part in zip(_BASES, (mixed >> np.uint64(33), mixed & _PRIME), strict=True):
        p = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_reduced(part * _powers(base, len(values))[: len(values)]), out=p[1:])
        sums.append(p)
    return sums[0], sums[1]


def span_hash(hashed: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes wherever they stand.

    The sums are taken modulo a prime: modulo a power of two, some
    self-similar texts of a thousand letters would collide whatever the base.
    """
    parts = []
    for base, p in zip(_BASES, hashed, strict=True):
        inverse = _powers(pow(base, -1, int(_PRIME)), len(p))
        parts.append(_reduced(_reduced(p[ends] - p[starts]) * inverse[starts]))
    return mix((parts[0] << np.uint64(31)) | parts[1])


def distinct_spans(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each different text, and for every span the place of its own among those.

    Spans are grouped by hash and then compared letter by letter with the
    first of their group, so spans with equal hashes but other letters stay
    apart.
    """
    _, first, which = np.unique(span_hash(prefix_hash(cp), starts, ends), return_index=True, return_inverse=True)
    lens = ends - starts
    like = lens == lens[first[which]]
    n = np.where(like, lens, 0)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    differ = cp[np.repeat(starts, n) + at] != cp[np.repeat(starts[first[which]], n) + at]
    if differ.any():
        like[np.repeat(np.arange(len(n)), n)[differ]] = False
    if not like.all():
        own: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(~like).tolist():
            text = cp[starts[i] : ends[i]].tobytes()
            if text not in own:
                own[text] = len(first) + len(extra)
                extra.append(i)
            which[i] = own[text]
        first = np.append(first, extra)
    return first, which


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of all texts, and the word offsets of the texts."""
    cp, off = codepoints(texts)
    f, foff, _ = fold(cp, off)
    s, e, woff = word_spans(f, foff)
    return span_hash(prefix_hash(f), s, e), woff


def gram_hashes(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within a text, the words they start at, and their offsets by text."""
    n = np.maximum(np.diff(off) - k + 1, 0)
    goff = np.zeros(len(off), np.int64)
    np.cumsum(n, out=goff[1:])
    start = np.arange(goff[-1]) + np.repeat(off[:-1] - goff[:-1], n)
    return span_hash(prefix_hash(words), start, start + k), start, goff


def window_minima(h: np.ndarray, off: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost least hash in each window of w hashes of one text (winnowing).

    A text of fewer than w hashes counts as one window.  Uses block minima
    from both sides, so the cost does not depend on w.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    # order keys: equal hashes are told apart by place, later first
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-np.arange(n), h))] = np.arange(n)
    lens = np.diff(off)
    lens_f = lens[lens > 0]
    starts = off[:-1][lens > 0]
    blocks = -(-lens_f // w)
    padded_off = np.zeros(len(lens_f) + 1, np.int64)
    np.cumsum((blocks + 1) * w, out=padded_off[1:])
    pad = np.full(padded_off[-1], n, np.int64)
    shift = np.repeat(padded_off[:-1] - starts, lens_f)
    here = np.arange(n) + shift
    pad[here] = rank
    grid = pad.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.maximum(lens_f - w + 1, 1)
    woff = np.zeros(len(windows) + 1, np.int64)
    np.cumsum(windows, out=woff[1:])
    at = np.arange(woff[-1]) + np.repeat(padded_off[:-1] - woff[:-1], windows)
    least = np.minimum(right[at], left[at + w - 1])
    order = np.empty(n + 1, np.int64)
    order[rank] = np.arange(n)
    return np.unique(order[least])


def longest_common(a: np.ndarray, b: np.ndarray, least: int = 0) -> int:
    """Length of the longest common subsequence; may stop with a smaller number once `least` is out of reach.

    Works on bit rows held in Python integers, one step for each word of the
    shorter side, so very long texts need len(a) * len(b) / 64 operations.
    """
    if len(a) > len(b):
        a, b = b, a
    place: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        place[x] = place.get(x, 0) | (1 << i)
    row, full, n = 0, (1 << len(b)) - 1, len(a)
    for i, x in enumerate(a.tolist()):
        m = place.get(x)
        if m is not None:
            both = row | m
            row = both & (both ^ (both - ((row << 1) | 1)))
            row &= full
        if i % 64 == 63 and row.bit_count() + n - i - 1 < least:
            break
    return row.bit_count()
