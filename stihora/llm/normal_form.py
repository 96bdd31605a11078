"""One consistent written form for text (problem 5).

Characters are repaired first: letters composed from base and mark, full-width
forms, invisible characters and unusual spaces.  Then scripts are repaired by
token: the dominant script of each token is determined, and look-alike letters
are substituted only in tokens that mix scripts or consist of look-alikes of
the corpus script alone, with the result looked up in the corpus vocabulary.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOOKALIKE_GREEK, LOOKALIKE_LATIN, chunks, codepoints, distinct_spans

#: Texts without any of these characters are in the consistent form already (Java pattern).
SUSPICIOUS = r"[\p{IsLatin}\p{IsGreek}\p{M}\p{Cf}\u034F\u115F\u1160\u17B4\u17B5\u3164\uFFA0\uFF01-\uFF5E\uFFE0-\uFFE6]|[\p{Zs}&&[^ ]]"

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_FULL_WIDTH = {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7)]}
_SPACES = {ord(c): " " for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs"}
_EMOJI_JOIN = regex.compile(r"(?<=[\p{So}\p{Sk}\uFE0F])\u200D(?=\p{So})")
_INVISIBLE = regex.compile(r"[\p{Cf}\u034F\u115F\u1160\u17B4\u17B5\u3164\uFFA0]")
_KEPT = "\uE000"
_CHARS = _FULL_WIDTH | _SPACES

_TO_CYRILLIC = {k: v for k, v in LOOKALIKE_LATIN.items() if k.isascii()} | LOOKALIKE_GREEK
_TO_LATIN = {v: k for k, v in LOOKALIKE_LATIN.items() if k.isascii()} | {k: next(a for a, b in LOOKALIKE_LATIN.items() if b == v) for k, v in LOOKALIKE_GREEK.items() if v in LOOKALIKE_LATIN.values()}
_TO_GREEK = {v: k for k, v in LOOKALIKE_GREEK.items()} | {a: k for k, v in LOOKALIKE_GREEK.items() for a, b in LOOKALIKE_LATIN.items() if b == v}
_TARGETS = (("CYRILLIC", _TO_CYRILLIC), ("LATIN", _TO_LATIN), ("GREEK", _TO_GREEK))


@lru_cache(10_000)
def script(ch: str) -> str:
    """CYRILLIC, LATIN, GREEK or "" of a character."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ", 1)[0]
    return name if name in ("CYRILLIC", "LATIN", "GREEK") else ""


def repair_characters(text: str) -> str:
    """The text with composed letters, plain forms, plain spaces and no invisible characters."""
    text = text.translate(_CHARS)
    if "\u200d" in text and (joined := _EMOJI_JOIN.sub(_KEPT, text)) != text and _KEPT not in text:
        text = _INVISIBLE.sub("", joined).replace(_KEPT, "\u200d")
    else:
        text = _INVISIBLE.sub("", text)
    return unicodedata.normalize("NFC", text)


@lru_cache(50_000)
def repairs(token: str) -> tuple[tuple[str, str], ...]:
    """(script, result) of each way to bring a token into one script, the most dominant first; empty if it is fine.

    A token in one script is fine, unless it is Latin or Greek and every
    letter looks like a Cyrillic one: real foreign words have a letter that
    does not.  A token that cannot be brought into one script is left alone.
    """
    plain = unicodedata.normalize("NFD", token)
    count = Counter(filter(None, map(script, plain)))
    if not count or set(count) == {"CYRILLIC"}:
        return ()
    if len(count) == 1 and not all(c in _TO_CYRILLIC for c in plain if script(c)):
        return ()
    found = []
    for name, table in _TARGETS:
        if name != "CYRILLIC" and all(c in _TO_CYRILLIC or script(c) == "CYRILLIC" for c in plain if script(c)):
            continue  # nothing in it is distinctly foreign, so it is no foreign word
        out = [c if script(c) in ("", name) else table.get(c) for c in plain]
        if None not in out:
            found.append((-count[name], name, unicodedata.normalize("NFC", "".join(out))))
    return tuple((name, out) for _, name, out in sorted(found))


def repair_tokens(text: str, known: set[str], known_only: bool) -> tuple[str, int]:
    """The text with its mixed tokens replaced, and how many results the vocabulary does not know."""
    unknown = 0

    def one(m: regex.Match) -> str:
        nonlocal unknown
        token = m.group()
        found = repairs(token)
        if not found:
            return token
        for _, result in found:
            if result in known:
                return result
        unknown += 1
        return token if known_only else found[0][1]

    return _TOKEN.sub(one, text), unknown


def corpus_vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """(token, n): the tokens of all texts with their counts; counted by chunk before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                cp, off = codepoints(texts[a:b])
                w = _letters()[np.minimum(cp, 0xFFFF)]
                edge = np.zeros(len(cp) + 1, bool)
                edge[off] = True
                first = w.copy()
                first[1:] &= ~w[:-1] | edge[1:-1]
                last = w.copy()
                last[:-1] &= ~w[1:] | edge[1:-1]
                s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
                at, which = distinct_spans(cp, s, e)
                n = np.bincount(which, minlength=len(at))
                tokens = [cp[x:y].tobytes().decode("utf-32-le", "replace") for x, y in zip(s[at], e[at], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(n, pa.int64())], names=["token", "n"])

    return df.select(text_col).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)])


def consistent_form(df: DataFrame, key_cols: list[str], text_col: str = "text", known_only: bool = False) -> DataFrame:
    """Rows of (keys, text, form, changed, unknown): every text in its consistent form.

    A text is changed if it holds a letter written as base letter plus mark
    where one character exists, a full-width form, an invisible character, a
    space other than the plain one, or a letter of another script in place of
    the one it looks like.  A mixed token takes the script, in order of
    dominance, whose result stands in the corpus vocabulary.  If none does, as
    with invented names, the dominant script is taken all the same, so that no
    such letter remains, and `unknown` counts it; known_only=True leaves those
    tokens alone instead.  A token that no substitution brings into one
    script, and a foreign stem with an ending after a hyphen, stay.

    Null stays null and empty stays empty, unchanged.  Repeated rows stay
    repeated.  Columns other than the keys and the text are dropped, so their
    names cannot clash.  Only texts with a suspicious character leave the JVM
    for repair; the vocabulary is joined with the results of mixed tokens, not
    collected.
    """
    rows = df.select(*key_cols, F.col(text_col).alias("text"))
    odd = F.coalesce(F.col("text").rlike(SUSPICIOUS), F.lit(False))
    plain = rows.filter(~odd).select(*key_cols, "text", F.col("text").alias("form"), F.lit(False).alias("changed"), F.lit(0).alias("unknown"))
    suspicious = rows.filter(odd).withColumn("text_key", F.xxhash64("text"))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {
                (h, r)
                for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for t in set(_TOKEN.findall(repair_characters(text)))
                for _, r in repairs(t)
            }
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([r for _, r in out], pa.string())], names=["text_key", "token"])

    wanted = suspicious.select("text_key", "text").mapInArrow(results, "text_key bigint, token string")
    known = wanted.join(corpus_vocabulary(rows, "text"), "token", "left_semi").groupBy("text_key").agg(F.collect_set("token").alias("known"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = batch.column("text").to_pylist(), batch.column("known").to_pylist()
            done = [repair_tokens(repair_characters(t), set(k or ()), known_only) for t, k in zip(texts, sets, strict=True)]
            out = [batch.column(c) for c in key_cols] + [
                batch.column("text"),
                pa.array([f for f, _ in done], pa.string()),
                pa.array([f != t for (f, _), t in zip(done, texts, strict=True)], pa.bool_()),
                pa.array([u for _, u in done], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[*key_cols, "text", "form", "changed", "unknown"])

    repaired = suspicious.join(known, "text_key", "left").select(*key_cols, "text", "known").mapInArrow(repair, plain.schema)
    return plain.unionByName(repaired)
