"""Corpus encoding with a byte-level BPE vocabulary (problem 6).

Pre-tokens are located by array operations, without regular expressions: every
code point gets a class (letter, number, white space, other), and the
automaton that splits at changes of class is run as an associative scan.  Its
transition functions are of two kinds only, the identity (same class as before)
and a constant (a new run starts here), and composing such functions from left
to right is a running maximum over run starts.  The two irregular rules of the
vocabulary's split pattern, the blank that joins the following run and the
English contractions, are local corrections of the boundaries found.

The slices are told apart by hash and then letter by letter, merged once for
each distinct slice of a batch, and the merged pieces are kept by their letters
in a cache of bounded size for each Python worker.  The rank file is read by
the driver and broadcast; executors need no file of their own.
Character offsets of every token can be kept, so that any token can be decoded
or traced to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import chunks, codepoints, distinct_spans

#: Where the rank files lie unless a path is given.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Distinct slices that a worker keeps; beyond it the cache starts anew, which changes speed only.
CACHE_SLICES = 200_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of white space in the split pattern.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions that the split pattern keeps as tokens, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    first = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[:] = first
    table[WHITE_SPACE] = SPACE
    return table


def boundaries(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted starts of the pre-tokens of all texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[cp]
    at = np.arange(n)
    text_start = np.zeros(n + 1, bool)
    text_start[off[:-1]] = True
    text_start = text_start[:n]
    change = text_start.copy()
    change[1:] |= kind[1:] != kind[:-1]
    # scan of identity and constant transition functions: where the current run began
    run = np.maximum.accumulate(np.where(change, at, 0))
    ends_run = np.ones(n, bool)
    ends_run[:-1] = change[1:]
    ends_text = np.ones(n, bool)
    ends_text[:-1] = text_start[1:]

    start = change.copy()
    space = kind == SPACE
    # the last white space of a run stands alone, unless the text ends there
    last = space & ends_run & ~ends_text
    start |= last
    # a plain blank before another run belongs to that run
    joins = np.flatnonzero(last & (cp == 32))
    start[joins + 1] = False
    # contractions: a lone apostrophe that starts a token, followed by letters
    apostrophe = (cp == 39) & (run == at) & ends_run & ~ends_text & start
    apostrophe[-1] = False
    for i in np.flatnonzero(apostrophe):
        if kind[i + 1] != LETTER:
            continue
        after = "".join(map(chr, cp[i + 1 : i + 3])) if i + 2 < n and not text_start[i + 2] else chr(cp[i + 1])
        for c in CONTRACTIONS:
            if after.startswith(c):
                start[i + 1] = False
                if i + 1 + len(c) < n:
                    start[i + 1 + len(c)] = True
                break
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of byte sequences and the merging of slices."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.slices: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[tuple[int, int]]:
        """Tokens of one slice as (id, bytes); pairs of least rank merge first, left before right.

        A heap over a linked list, so the cost is n log n in the bytes of the slice.
        """
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [(whole, len(piece))]
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            j = after[i]
            if left is None or j >= len(parts) or len(left) + len(parts[j]) != size:
                continue
            left += parts[j]
            parts[i], parts[j] = left, None
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (r := ranks.get(left + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(left) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + left)) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(left)))
        return [(ranks[p], len(p)) for p in parts if p is not None]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(digest: str, ranks: bytes) -> Vocabulary:
    """The vocabulary of a rank file's content, parsed once in each process."""
    if digest not in _VOCABULARIES:
        _VOCABULARIES[digest] = Vocabulary(ranks)
    return _VOCABULARIES[digest]


def rank_file(path: str) -> tuple[str, bytes]:
    """Digest and content of a rank file."""
    with open(path, "rb") as f:
        ranks = f.read()
    return hashlib.sha256(ranks).hexdigest(), ranks


def vocabulary(path: str) -> Vocabulary:
    return vocabulary_of(*rank_file(path))


def encode_batch(texts: list[str | None], vocab: Vocabulary, offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids of all texts in a row, the id offsets of the texts, and each token's character offset within its text."""
    cp, off = codepoints(texts)
    starts = boundaries(cp, off)
    ends = np.append(starts[1:], len(cp)) if len(starts) else starts
    first, which = distinct_spans(cp, starts, ends)
    if len(vocab.slices) > CACHE_SLICES:
        vocab.slices.clear()
    lists = []
    for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
        key = cp[s:e].tobytes()
        got = vocab.slices.get(key)
        if got is None:
            piece = key.decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
            got = vocab.slices[key] = tuple(i for i, _ in vocab.merge(piece))
        lists.append(got)
    lens = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(lens.sum()))
    flat_off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=flat_off[1:])
    n = lens[which] if len(which) else np.zeros(0, np.int64)
    out_off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out_off[1:])
    take = np.arange(out_off[-1]) + np.repeat(flat_off[:-1][which] - out_off[:-1], n) if len(n) else np.zeros(0, np.int64)
    text_off = out_off[np.searchsorted(starts, off)]
    places = None
    if offsets:
        inner = np.concatenate([_char_places(vocab, cp, s, e) for s, e in zip(starts[first], ends[first], strict=True)] or [np.zeros(0, np.int64)])
        places = inner[take] + np.repeat(starts, n) - np.repeat(off[:-1], np.diff(text_off))
    return flat[take], text_off, places


def _char_places(vocab: Vocabulary, cp: np.ndarray, s: int, e: int) -> np.ndarray:
    """For each token of a slice, the character of the slice in which its first byte lies."""
    chars = [len(chr(c).encode("utf-8", "replace")) for c in cp[s:e]]
    at = np.repeat(np.arange(len(chars)), chars)
    sizes = [n for _, n in vocab.merge(cp[s:e].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"))]
    return at[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, offsets: bool = False) -> DataFrame:
    """(id, ids[, offsets]) of each row; special tokens are neither added nor recognised.

    Null and empty texts give an empty list.  Repeated rows are encoded like
    any other, an empty table gives an empty result, other columns are not
    read.  The plan is a scan and one Arrow map, without a shuffle.
    """
    path = vocabulary_path or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
    shared = df.sparkSession.sparkContext.broadcast(rank_file(path))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary_of(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, off, places = encode_batch(texts[a:b], vocab, offsets)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(places, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", *["offsets"] * offsets])

    schema = f"`{id_col}` {kind.simpleString()}, ids array<int>" + ", offsets array<int>" * offsets
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(ids: list[int], vocabulary_path: str | None = None) -> str:
    """The text of a list of ids."""
    vocab = vocabulary(vocabulary_path or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken"))
    if not hasattr(vocab, "pieces"):
        vocab.pieces = {i: b for b, i in vocab.ranks.items()}
    return b"".join(vocab.pieces[i] for i in ids).decode("utf-8", "replace")
