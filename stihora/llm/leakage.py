"""Evaluation passages inside a corpus (problem 7).

Both sides are winnowed: the least hash of each window of grams is kept.  One
shared fingerprint is enough for an item and a document to be compared, so the
guarantee of winnowing is that of the operator: a case cannot be missed while
it holds a run of GRAM + WINDOW - 1 shared words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, gram_hashes, window_minima, word_hashes
from .shared import written

#: Words of a fingerprinted gram, and grams of a winnowing window.  Every run of GRAM + WINDOW - 1 = 4
#: shared words has a fingerprint in common.  A stretch of ten words or more with one in eight changed,
#: rounded, always has such a run: twelve words with two changed leave ten in three runs.
GRAM, WINDOW = 3, 2
#: Consecutive words of an item that make a case by themselves.
RUN = 12
#: Share of an item's words that a changed stretch must span, the fewest words of one, and the share of
#: words that may be changed, rounded to whole words.
STRETCH, SHORTEST, CHANGED = 0.5, 10, 1 / 8
#: Words of all items together up to which their index is broadcast (16 bytes a word); beyond it, joins are used.
BROADCAST_WORDS = 2_000_000


def fingerprints(words: np.ndarray, off: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed gram hashes of texts given as word hashes, the words they start at in the array, and their texts."""
    h, start, goff = gram_hashes(words, off, gram)
    at = window_minima(h, goff, window)
    return h[at], start[at], np.searchsorted(goff, at, "right") - 1


def may_change(n: np.ndarray | int, changed: float) -> np.ndarray | int:
    """How many of n words may be changed: the share, rounded half up."""
    return np.floor(n * changed + 0.5).astype(np.int64) if isinstance(n, np.ndarray) else int(n * changed + 0.5)


def stretches(item: np.ndarray, doc: np.ndarray, hits: list[tuple[int, int]], run: int = RUN, stretch: float = STRETCH, changed: float = CHANGED) -> tuple[int, int] | None:
    """(words in common, first word in the document) of the best passage of an item in a document, if it is a case.

    `hits` are (word of the document, word of the item) of shared
    fingerprints.  Each is extended: first to the longest exact run, then, by
    diagonal neighbourhood, to the longest stretch of the item that stands in
    order in the document with at most the given share of words changed.
    """
    best = None
    n = len(item)
    done: set[tuple[int, int]] = set()
    for p, k in hits:
        if (p, k) in done:
            continue
        a, b = p, k
        while a and b and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        e, f = p, k
        while e < len(doc) and f < n and doc[e] == item[f]:
            done.add((e, f))
            e, f = e + 1, f + 1
        if e - a >= run and (best is None or e - a > best[0]):
            best = (e - a, a)
    least = max(SHORTEST, int(np.ceil(stretch * n)))
    slack = may_change(n, changed) + 1
    own = np.sort(item)
    seen = None
    for d in sorted({p - k for p, k in hits}):
        if seen is not None and d - seen <= slack:
            continue
        seen = d
        low, high = max(0, d - slack), min(len(doc), d + n + 2 * slack)
        part = doc[low:high]
        shared = own[np.minimum(np.searchsorted(own, part), n - 1)] == part
        if int(shared.sum()) < least - may_change(least, changed):  # too few words of the item stand here in any order
            continue
        got = _aligned(item, part, least, changed)
        if got and (best is None or got[0] > best[0]):
            best = (got[0], low + got[1])
    return best


def _aligned(item: np.ndarray, part: np.ndarray, least: int, changed: float) -> tuple[int, int] | None:
    """(words in common, first word in part) of the best stretch of the item in order, if it is a case.

    A local alignment, in which a row of the item is one array operation.
    Changed words cost so little that a shared word at the edge of a case
    outweighs all changes that may follow it.
    The paths to all ends that a case could have are traced back, the best
    first, and the best stretch on each is taken.
    """
    n, m = len(item), len(part)
    cost = 2.0 ** -(may_change(n, changed) + 2).bit_length()
    equal = item[:, None] == part[None, :]
    score = np.zeros((n + 1, m + 1), np.float32)
    step = np.arange(m + 1, dtype=np.float32) * cost
    for i in range(n):
        row = np.maximum(score[i, :-1] + np.where(equal[i], 1.0, -cost), score[i, 1:] - cost)
        score[i + 1, 1:] = np.maximum(row, 0)
        score[i + 1] = np.maximum.accumulate(score[i + 1] + step) - step
    change = may_change(least, changed)
    ends = np.flatnonzero(score >= least - change - cost * change)
    best = None
    taken = np.zeros(score.shape, bool)
    for flat in ends[np.argsort(-score.ravel()[ends], kind="stable")].tolist():
        i, j = divmod(flat, m + 1)
        path = []
        while i and j and score[i, j] > 0 and not taken[i, j]:
            taken[i, j] = True
            s = score[i, j]
            if equal[i - 1, j - 1] and s == score[i - 1, j - 1] + 1:
                i, j = i - 1, j - 1
                path.append((i, j))
            elif s == score[i - 1, j - 1] - cost:
                i, j = i - 1, j - 1
            elif s == score[i - 1, j] - cost:
                i -= 1
            else:
                j -= 1
        if len(path) >= least - change:
            got = _best_stretch(np.array(path[::-1]), least, changed)
            if got and (best is None or got[0] > best[0]):
                best = got
    return best


def _best_stretch(path: np.ndarray, least: int, changed: float) -> tuple[int, int] | None:
    """(words in common, first word in part) of the longest part of an alignment that is long and whole enough."""
    x, y = np.triu_indices(len(path), 1)
    span = path[y, 0] - path[x, 0] + 1
    wide = path[y, 1] - path[x, 1] + 1
    longer = np.maximum(span, wide)
    good = (span >= least) & (longer - (y - x + 1) <= may_change(longer, changed))
    if not good.any():
        return None
    at = int(np.argmax(np.where(good, y - x + 1, 0)))
    return int(y[at] - x[at] + 1), int(path[x[at], 1])


def leaked_items(docs: DataFrame, items: DataFrame, gram: int = GRAM, window: int = WINDOW, run: int = RUN, stretch: float = STRETCH, changed: float = CHANGED, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, first_word): documents that hold a passage of an item.

    A passage is `run` consecutive words of the item, or a stretch of at least
    the share `stretch` of its words, and SHORTEST words, in order with at most
    the share `changed` of them replaced or dropped, rounded to whole words.  Case, punctuation, spacing and look-alike
    characters do not count.

    Both sides are winnowed with the same window, so every run of
    gram + window - 1 shared words is found; shared fingerprints are extended
    on the whole texts.  While all items together have few words, their index
    is broadcast and a document is read and judged in one pass without a
    shuffle; beyond that, fingerprints are joined, and only the texts with
    shared fingerprints are read again.  A gram that very many documents hold
    is then a skewed key, which the adaptive join splits over tasks.  Null, empty and wordless texts hold
    nothing; repeated rows count once; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).head()[0] or 0  # a word and its separator have two characters at least
    if size / 2 <= broadcast_words:
        return _by_broadcast(docs, items, gram, window, run, stretch, changed)
    return _by_join(docs, items, gram, window, run, stretch, changed)


_SCHEMA = "doc_id bigint, item_id bigint, n_words int, first_word int"


def _result(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "n_words", "first_word"])


def _by_broadcast(docs: DataFrame, items: DataFrame, gram: int, window: int, run: int, stretch: float, changed: float) -> DataFrame:
    rows = items.dropDuplicates(["item_id"]).collect()
    ids = np.array([r.item_id for r in rows], np.int64)
    words, off = word_hashes([r.text for r in rows])
    h, start, text = fingerprints(words, off, gram, window)
    order = np.argsort(h, kind="stable")
    index = docs.sparkSession.sparkContext.broadcast((ids, words, off, h[order], start[order], text[order]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, off, h, start, text = index.value
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                dw, doff = word_hashes(texts[a:b])
                dh, dstart, dtext = fingerprints(dw, doff, gram, window)
                lo, hi = np.searchsorted(h, dh, "left"), np.searchsorted(h, dh, "right")
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for x in np.flatnonzero(hi > lo).tolist():
                    t = int(dtext[x])
                    for y in range(int(lo[x]), int(hi[x])):
                        i = int(text[y])
                        hits.setdefault((t, i), []).append((int(dstart[x] - doff[t]), int(start[y] - off[i])))
                out = []
                for (t, i), found in hits.items():
                    if (best := stretches(words[off[i] : off[i + 1]], dw[doff[t] : doff[t + 1]], found, run, stretch, changed)):
                        out.append((doc_ids[a + t], int(ids[i]), *best))
                yield _result(out)

    return docs.mapInArrow(judge, _SCHEMA).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max_by("first_word", "n_words").alias("first_word"))


def _by_join(docs: DataFrame, items: DataFrame, gram: int, window: int, run: int, stretch: float, changed: float) -> DataFrame:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                words, off = word_hashes(texts[a:b])
                h, start, text = fingerprints(words, off, gram, window)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + text]), pa.array(h.view(np.int64)), pa.array((start - off[text]).astype(np.int32))], names=["id", "print", "at"])

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                words, off = word_hashes(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(words.view(np.int64)))], names=["id", "words"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                hits = [(x["at"], x["item_at"]) for x in batch.column("hits")[r].as_py()]
                best = stretches(batch.column("item_words")[r].values.to_numpy(), batch.column("doc_words")[r].values.to_numpy(), hits, run, stretch, changed)
                if best:
                    out.append((batch.column("doc_id")[r].as_py(), batch.column("item_id")[r].as_py(), *best))
            yield _result(out)

    schema = "id bigint, print bigint, at int"
    of_docs = docs.mapInArrow(prints, schema).withColumnRenamed("id", "doc_id")
    of_items = items.mapInArrow(prints, schema).select(F.col("id").alias("item_id"), "print", F.col("at").alias("item_at"))
    hits = written(of_docs.join(of_items, "print").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("at", "item_at")).alias("hits")))
    doc_words = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(words_of, "id bigint, words array<bigint>").toDF("doc_id", "doc_words")
    item_words = items.join(hits.select("item_id").distinct(), "item_id", "left_semi").dropDuplicates(["item_id"]).mapInArrow(words_of, "id bigint, words array<bigint>").toDF("item_id", "item_words")
    joined = hits.join(doc_words, "doc_id").join(item_words, "item_id")
    return joined.mapInArrow(judge, _SCHEMA).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max_by("first_word", "n_words").alias("first_word"))
