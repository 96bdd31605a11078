"""Languages of documents and passages (problem 8), by nearest centroid.

Words are brought into one script and one form, and described by their
character n-grams and the word itself, weighted by TF-IDF: the inverse
document frequency of the n-gram, times how unevenly it is spread over the
languages.  Several centroids for each language are found by spherical
k-means.  The vector of a document or passage is the sum of the unit vectors
of its words, so its products with the centroids are sums over words, worked
out once for each distinct word; divided by the norm of that vector they are
its cosines.  A text whose nearest centroid is farther than texts of a known
language of that length ever are is rejected: it is in no known language.

Which words of a text are in which language is decided by the path of
languages with the highest total of word cosines, where each change of
language costs a fixed amount.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .arrays import chunks, codepoints, distinct_spans
from .normal_form import repair_characters, repairs, script

#: Hashed n-grams, their lengths, how often the word itself counts, centroids of a language, and k-means rounds.
DIMENSIONS, LENGTHS, WORD_WEIGHT, CENTROIDS, ROUNDS = 1 << 16, (1, 2, 3, 4), 3, 3, 12
#: How strongly n-grams that few languages have are preferred.
SPREAD_POWER = 3
#: Most labelled texts that are collected for fitting: trusted ones, and documents whose label the first fit confirms.
TRUSTED_AT_MOST, DOCUMENTS_AT_MOST, OF_ONE_LANGUAGE = 2_000, 4_000, 150
#: The cost of a change of language; words in a row that make a passage; and the confidence below which a label
#: that names the runner-up is not called wrong, in texts too short for a passage.
CHANGE, PASSAGE, CLEAR = 0.3, 10, 0.51
#: Rejection: lengths in words for which a limit is fitted, parts into which the fitted texts are cut for that, the
#: share of texts in a known language that may lie beyond the limit, and the margin below it.
LENGTHS_FITTED, FOLDS, BEYOND, MARGIN = (1, 2, 3, 5, 8, 12, 20, 40, 80, 160), 4, 0.002, 0.75
#: Distinct words a worker keeps products of; beyond it the cache starts anew.
CACHE_WORDS = 100_000

#: The Latin spelling of Cyrillic letters that Macedonian and Serbian have; letters of the
#: other languages stay as they are, for those are not written in Latin script.
LATIN = dict(zip("абвгдезијклмнопрстуфхцѓќѕљњџжчшђћѐѝ", "a b v g d e z i j k l m n o p r s t u f h c gj kj dz lj nj dzh zh ch sh đ ć e i".split(), strict=True)) | {"č": "ch", "š": "sh", "ž": "zh"}

#: Other codes and names of the languages.
NAMES = {
    "mk": "mk mkd mac macedonian македонски makedonski",
    "sr": "sr srp scc serbian српски srpski",
    "bg": "bg bul bulgarian български",
    "ru": "ru rus russian русский",
    "en": "en eng english",
    "sq": "sq sqi alb albanian shqip",
    "tr": "tr tur turkish türkçe",
    "de": "de deu ger german deutsch",
}
#: Labels that name no language.
NO_LANGUAGE = "und unknown undetermined undefined xx xxx zxx mis mul n/a na nan none null nil no other tbd todo missing"


def label_code(label: Column) -> Column:
    """The code of the language that a label names: one of the eight, "other", or null if it names none."""
    plain = F.regexp_replace(F.lower(label), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    base = F.regexp_replace(plain, r"[-_].*$", "")
    known = F.create_map(*(F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)))
    empty = plain.isNull() | plain.isin(NO_LANGUAGE.split()) | base.isin(NO_LANGUAGE.split()) | ~plain.rlike(r"\p{L}")
    return F.when(empty, F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, base), F.lit("other")))


def canonical(word: str) -> str:
    """A word in one script and form: repaired, lower case, without stress marks, Latin where both scripts are in use."""
    word = repair_characters(word)
    if found := repairs(word):
        word = found[0][1]
    word = unicodedata.normalize("NFC", word.lower())
    return "".join(LATIN.get(c, c) for c in word if not unicodedata.combining(c))


@lru_cache(50_000)
def word_grams(word: str) -> np.ndarray:
    """Hashed n-grams of a word's canonical form, and the whole of it."""
    word = canonical(word)
    padded = f"^{word}$"
    grams = [padded] * WORD_WEIGHT + [padded[i : i + n] for n in LENGTHS for i in range(len(padded) - n + 1) if padded[i : i + n] not in ("^", "$")]
    return np.array([zlib.crc32(g.encode()) % DIMENSIONS for g in grams], np.int64)


def raw_words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts (letters with their marks and invisible characters), and word offsets."""
    w = _word_class()[np.minimum(cp, 0xFFFF)]
    edge = np.zeros(len(cp) + 1, bool)
    edge[off] = True
    inside = w > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    letters = np.concatenate([[0], np.cumsum(w == 2)])
    real = letters[e] > letters[s]
    s, e = s[real], e[real]
    return s, e, np.searchsorted(s, off)


_CLASS: list[np.ndarray] = []


def _word_class() -> np.ndarray:
    if not _CLASS:
        kinds = (unicodedata.category(chr(c)) for c in range(0x10000))
        _CLASS.append(np.array([2 if k[0] == "L" else 1 if k in ("Mn", "Mc", "Cf") else 0 for k in kinds], np.uint8))
    return _CLASS[0]


_SUMS = np.zeros(DIMENSIONS)
#: Random directions by which the norm of a text is estimated; the exact one is worked out only near a limit.
SKETCH, NEAR = 64, 1.5


@lru_cache(1)
def _signs() -> np.ndarray:
    return (np.random.default_rng(1).integers(0, 2, (DIMENSIONS, SKETCH), np.int8) * np.int8(2) - np.int8(1)).astype(np.float32)


@dataclass
class Words:
    """The distinct words of some texts: products with the centroids, a sketch of the vector, n-grams and their weights; and which of them each word is."""

    products: np.ndarray
    sketches: np.ndarray
    grams: list[np.ndarray]
    weights: list[np.ndarray]
    which: np.ndarray


@dataclass
class Model:
    """Centroids of the languages, the weights of the n-grams, and the least cosine by length; of fixed size whatever it was fitted on."""

    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray
    cache: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def word(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cosines of a word with all centroids, the sketch of its unit vector, its n-grams, and their weights in it; nothing for words in other scripts."""
        if not any(script(c) in ("LATIN", "CYRILLIC") for c in word):
            return np.zeros(len(self.owner), np.float32), np.zeros(SKETCH, np.float32), np.zeros(0, np.uint16), np.zeros(0, np.float32)
        g = word_grams(word)
        w = self.weights[g]
        w = w / max(1e-9, float(np.sqrt((w * w).sum())))
        w = w.astype(np.float32)
        return (self.centroids[:, g] @ w).astype(np.float32), w @ _signs()[g] / np.float32(SKETCH**0.5), g.astype(np.uint16), w

    def words(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
        """All words, worked out once for each distinct one."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        first, which = distinct_spans(cp, starts, ends)
        rows = []
        for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            key = cp[s:e].tobytes()
            row = self.cache.get(key)
            if row is None:
                row = self.cache[key] = self.word(key.decode("utf-32-le", "replace"))
            rows.append(row)
        products, sketches = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        return Words(products.reshape(-1, len(self.owner)), sketches.reshape(-1, SKETCH), [r[2] for r in rows], [r[3] for r in rows], which)

    def by_language(self, products: np.ndarray) -> np.ndarray:
        """Products with the nearest centroid of each language."""
        return np.maximum.reduceat(products, np.searchsorted(self.owner, np.arange(len(self.languages))), axis=1)

    def cosines(self, words: Words, picked: np.ndarray) -> np.ndarray:
        """Cosine of the text that some words make with the nearest centroid of each language."""
        own, n = np.unique(words.which[picked], return_counts=True)
        own = own.tolist()
        g = np.concatenate([words.grams[i] for i in own])
        w = np.concatenate([words.weights[i] for i in own]) * np.repeat(n, [len(words.grams[i]) for i in own])
        np.add.at(_SUMS, g, w)  # only the places of these n-grams are touched, and cleared again
        norm = float(_SUMS[g] @ w)
        _SUMS[g] = 0.0
        return self.by_language((n @ words.products[own])[None, :])[0] / max(1e-9, norm**0.5)

    def nearest(self, words: Words, picked: np.ndarray | slice) -> tuple[np.ndarray, bool]:
        """For the text that some words make, its products with the nearest centroid of each language, and whether it is too far from all of them."""
        own = words.which[picked]
        products = self.by_language(words.products[own].sum(0, keepdims=True))[0]
        sketch = words.sketches[own].sum(0)
        best, limit = float(products.max()), self.limit(len(own))
        least = limit * float(sketch @ sketch) ** 0.5
        if best > NEAR * least:
            return products, False
        if NEAR * best < least:
            return products, True
        return products, float(self.cosines(words, picked).max()) < limit

    def limit(self, n: int) -> float:
        """The cosine below which a text of n words is in no known language."""
        return float(np.interp(n, LENGTHS_FITTED, self.limits))


def fit(texts: list[tuple[str, str]]) -> Model:
    """A model from (language, text) pairs."""
    languages = [x for x in NAMES if any(x == lang for lang, _ in texts)]
    found: list[tuple[int, np.ndarray, np.ndarray]] = []  # language, n-grams, counts
    grams: dict[str, np.ndarray] = {}
    for lang, text in texts:
        cp, off = codepoints([text])
        s, e, _ = raw_words(cp, off)
        words = Counter(cp[a:b].tobytes().decode("utf-32-le", "replace") for a, b in zip(s, e, strict=True))
        for w in words:
            if w not in grams:
                grams[w] = word_grams(w)
        if words:
            found.append((languages.index(lang), *np.unique(np.concatenate([np.repeat(grams[w], n) for w, n in words.items()]), return_counts=True)))
    df = np.zeros((len(languages), DIMENSIONS), np.float32)
    for i, g, _ in found:
        df[i, g] += 1
    share = df / np.maximum(np.bincount([i for i, _, _ in found], minlength=len(languages))[:, None], 1)
    share /= np.maximum(share.sum(0), 1e-9)
    spread = -(share * np.log(np.maximum(share, 1e-12))).sum(0) / max(1e-9, np.log(len(languages)))
    total = df.sum(0)
    weights = np.where(total > 0, (np.log((1 + len(found)) / (1 + total)) + 1) * (1.02 - spread) ** SPREAD_POWER, 1.0).astype(np.float32)
    centroids, whose = [], []
    for i in range(len(languages)):  # a language at a time, so that the dense rows stay few
        rows = [(g, n) for lang, g, n in found if lang == i]
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for r, (g, n) in enumerate(rows):
            x[r, g] = (1 + np.log(n)) * weights[g]
            x[r] /= max(1e-9, float(np.linalg.norm(x[r])))
        own = _spherical_means(x, CENTROIDS)
        centroids.append(own)
        whose += [i] * len(own)
    return Model(languages, weights, np.concatenate(centroids), np.array(whose), np.zeros(len(LENGTHS_FITTED)))


def fit_limits(texts: list[tuple[str, str]]) -> np.ndarray:
    """For each fitted length, a cosine that hardly any text of that length in a known language falls below.

    Every part of the texts is measured with a model of the other parts, in
    windows of each length; a language must be in both.  Limits never fall
    with the length.
    """
    found: list[list[float]] = [[] for _ in LENGTHS_FITTED]
    for fold in range(FOLDS):
        kept = [t for i, t in enumerate(texts) if i % FOLDS != fold]
        if not kept:
            continue
        model = fit(kept)
        for lang, text in texts[fold::FOLDS]:
            if lang not in model.languages:
                continue
            cp, off = codepoints([text])
            s, e, _ = raw_words(cp, off)
            words = model.words(cp, s, e)
            for j, n in enumerate(LENGTHS_FITTED):
                for at in range(0, len(s) - n + 1, max(n, len(s) // 3)):
                    found[j].append(float(model.cosines(words, np.arange(at, at + n)).max()))
    limits = np.array([np.quantile(x, BEYOND) * MARGIN if len(x) > 20 else 0.0 for x in found])
    return np.maximum.accumulate(np.maximum(limits, 0.0))


def _spherical_means(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids; starts from the row nearest to the mean, then from rows far from those taken."""
    taken = [int((x @ x.sum(0)).argmax())]
    while len(taken) < min(k, len(x)):
        taken.append(int((x @ x[taken].T).max(1).argmin()))
    c = x[taken].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def bounded_sample(df: DataFrame, key: str, most: int) -> list[Row]:
    """At most `most` rows, those with the smallest hash of `key`, in the order of the hash.

    The rows are counted first, so that no more than are wanted leave the
    executors, whatever the number of tasks.
    """
    h = F.xxhash64(key)
    rate = 0.95 * most / max(1, df.count())
    chosen = df if rate >= 0.95 else df.filter(h / 2.0**64 + 0.5 < rate)
    rows = chosen.withColumn("_h", h).limit(most).collect()
    return sorted(rows, key=lambda r: r["_h"])


def fit_on_tables(trusted: DataFrame, documents: DataFrame | None = None) -> Model:
    """A model from trusted (lang, text), refined with labelled documents (doc_id, lang, text).

    Bounded samples are collected: about TRUSTED_AT_MOST trusted texts and
    DOCUMENTS_AT_MOST labelled documents at most, chosen by a hash.  Of the
    documents, up to OF_ONE_LANGUAGE for each language are used, if the first
    fit confirms the label clearly.  Everything else runs over all rows.
    """
    rows = bounded_sample(trusted.filter(F.col("lang").isin(list(NAMES)) & F.col("text").isNotNull()), "text", TRUSTED_AT_MOST)
    base = [(r.lang, r.text) for r in rows]
    model = fit(base)
    limits = fit_limits(base)  # of a model of fewer texts, so rather too low than too high for the one returned
    if documents is None:
        return replace(model, limits=limits)
    labelled = documents.select("doc_id", label_code(F.col("lang")).alias("code"), "text").filter(F.col("code").isin(list(NAMES)) & F.col("text").isNotNull() & F.length("text").between(100, 20_000))
    found = [(r.code, r.text) for r in bounded_sample(labelled, "doc_id", DOCUMENTS_AT_MOST)]
    used: Counter[str] = Counter()
    more = []
    for lang, text in found:
        if used[lang] < OF_ONE_LANGUAGE and lang in model.languages:
            cp, off = codepoints([text])
            s, e, _ = raw_words(cp, off)
            if len(s) < 20:
                continue
            words = model.words(cp, s, e)
            total = model.cosines(words, np.arange(len(s)))
            order = np.argsort(-total)
            if model.languages[order[0]] == lang and total[order[0]] > 1.25 * total[order[1]]:
                used[lang] += 1
                more.append((lang, text))
    return replace(fit(base + more), limits=limits)


def segments(scores: np.ndarray, off: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The language of each word on the best path of each text.

    All texts take their steps together, the longest first, so a step is one
    array operation for all texts that are not at their end.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int8)
    lens = np.diff(off)
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    begin, size = off[:-1][order], lens[order]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts longer than t words
    back = np.zeros((n, k), np.int8)
    best = scores[begin].copy()
    stay = np.arange(k, dtype=np.int8)
    for t in range(1, int(size[0])):
        a = int(active[t])
        v = best[:a]
        top = v.argmax(1)
        switch = v[np.arange(a), top] - change
        keep = v >= switch[:, None]
        back[begin[:a] + t] = np.where(keep, stay, top[:, None])
        best[:a] = np.where(keep, v, switch[:, None]) + scores[begin[:a] + t]
    out = np.zeros(n, np.int8)
    state = best.argmax(1)
    out[begin + size - 1] = state
    for t in range(int(size[0]) - 1, 0, -1):
        a = int(active[t])
        state[:a] = back[begin[:a] + t, state[:a]]
        out[begin[:a] + t - 1] = state[:a]
    return out


def languages_of(texts: list[str | None], model: Model, passage: int = PASSAGE) -> list[list[tuple[str, str | None, float | None, int, int, int, str | None, int]]]:
    """For each text (part, language, confidence, words, first character, end character, runner-up, words in a known script): the document, then its passages.

    Passages come only where at least two languages fill `passage` or more
    words in a row.  A document, or a passage, whose cosine with the nearest
    centroid is below the limit for its length is in no known language: such a
    document has no language, the nearest one as runner-up, and such a passage does not count.  Confidence
    is the best language's share of the sum of the two best cosines, between 0.5 and 1.
    """
    cp, off = codepoints(texts)
    s, e, woff = raw_words(cp, off)
    words = model.words(cp, s, e)
    own_scores = model.by_language(words.products) if len(s) else np.zeros((0, len(model.languages)))
    scores = own_scores[words.which]
    path = segments(scores, woff)
    known = scores.any(axis=1)
    out = []
    for t in range(len(texts)):
        a, b = int(woff[t]), int(woff[t + 1])
        if a == b or not known[a:b].any():
            out.append([])
            continue
        own = path[a:b]
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), b - a]
        runs = [(x, y) for x, y in zip(cuts, cuts[1:]) if y - x >= passage]
        passages = []
        counted = known[a:b].copy()
        if len({int(own[x]) for x, _ in runs}) > 1:
            for x, y in runs:
                near, far = model.nearest(words, slice(a + x, a + y))
                if not far:
                    lang = int(own[x])
                    passages.append(("passage", model.languages[lang], _confidence(near, lang), y - x, int(s[a + x] - off[t]), int(e[a + y - 1] - off[t]), model.languages[_second(near, lang)], int(known[a + x : a + y].sum())))
                else:
                    counted[x:y] = False
            if len({p[1] for p in passages}) < 2:
                passages = []
        size, n_known = int(off[t + 1] - off[t]), int(known[a:b].sum())
        near, far = model.nearest(words, a + np.flatnonzero(counted))
        if not counted.any() or (far and not passages):
            out.append([("document", None, None, 0, 0, size, model.languages[int(near.argmax())], n_known)])
            continue
        count = np.bincount(own[counted], minlength=len(model.languages))
        main = int(np.lexsort((near, count))[-1])
        out.append([("document", model.languages[main], _confidence(near, main), int(count[main]), 0, size, model.languages[_second(near, main)], n_known), *passages])
    return out


def _confidence(near: np.ndarray, lang: int) -> float:
    other = max((x for i, x in enumerate(near.tolist()) if i != lang), default=0.0)
    own = float(near[lang])
    return min(1.0, max(0.0, own / max(1e-9, own + max(0.0, other))))


def _second(near: np.ndarray, lang: int) -> int:
    order = np.argsort(-near, kind="stable")
    return int(order[1] if len(order) > 1 and order[0] == lang else order[0])


_FIELDS = (("part", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32()), ("first", pa.int32()), ("end", pa.int32()), ("second", pa.string()), ("n_known", pa.int32()))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, lang, confidence, n_words, first, end, second, n_known): the language of each document and of its passages.

    One row of part "document" for each row of df with its main language, the
    one with most words, and, if it is mixed, one of part "passage" for each
    run of PASSAGE words or more in one language, with its place in the text.
    `second` is the runner-up, n_known the number of words in a known script.
    Null, empty and wordless texts, and texts that are in no known language,
    give a document row without language, confidence null, 0 words.  Repeated
    rows are repeated; columns other than the two are not read.  One scan and
    one Arrow map; the model is broadcast and has a fixed size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                found = languages_of(texts[a:b], model)
                take = [a + i for i, rows in enumerate(found) for _ in range(max(1, len(rows)))]
                flat = [r for rows in found for r in (rows or [("document", None, None, 0, 0, 0, None, 0)])]
                columns = list(zip(*flat, strict=True)) or [[]] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True))], names=[id_col, *(n for n, _ in _FIELDS)])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, part string, lang string, confidence double, n_words int, first int, end int, second string, n_known int")


def label_issues(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, issue, lang, confidence) of documents with a missing or wrong label, or in several languages.

    `missing`: the label is null, blank or names no language; `wrong`: it
    names another language than the main one; `mixed`: one row for each
    language that fills a passage.  A label that names the runner-up is let
    stand only where the words don't decide: fewer than PASSAGE of them are
    known, all are taken for one language, and its score is hardly the higher.  Documents without words are no cases.
    """
    labels = df.select(F.struct("doc_id", "lang").alias("key"), "text")
    found = identify(labels, model, "key").filter("lang is not null")
    code = label_code(F.col("key.lang"))
    few = (F.col("n_known") < PASSAGE) & (F.col("n_words") == F.col("n_known"))
    unclear = few & (F.col("confidence") < CLEAR) & (F.col("second") == code)
    whole = found.filter("part = 'document'").withColumn("issue", F.when(code.isNull(), "missing").when((code != F.col("lang")) & ~unclear, "wrong")).filter("issue is not null")
    mixed = found.filter("part = 'passage'").withColumn("issue", F.lit("mixed"))
    both = whole.unionByName(mixed).select(F.col("key.doc_id").alias("doc_id"), "issue", "lang", "confidence")
    return both.groupBy("doc_id", "issue", "lang").agg(F.max("confidence").alias("confidence"))
