"""The same or nearly the same records on both sides of a split (problem 3).

Records with the same words are one class, and one record stands for it.
Minwise hashes of word shingles are made for those records only, and banded;
buckets with both sides make candidates, whose whole texts are then compared.
A bucket that very many different texts share is an ordinary skewed key: the
join splits it over tasks, and only pairs of candidates leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, gram_hashes, longest_common, mix, prefix_hash, span_hash, word_hashes
from .shared import written

#: Words of a shingle.  Two, not five: records count as nearly the same with one word in five changed,
#: and changes spread evenly would then leave no shingle of five words.
SHINGLE = 2
#: Bands and hashes of a band.  Two records with 80 % of their words in common have at least 0.43 of
#: their shingles in common, and then share a band with probability 0.98; with 0.6 in common, 0.99999.
BANDS, BAND_ROWS = 48, 3
#: Least share of the words of the longer record that both have in the same order.
SIMILARITY = 0.8
#: Exact copies of one text on one side up to which all of them are paired; of more, only the first stands for them
#: towards other texts, and towards its copies on the other side each is paired with the first there.
COPIES_AT_MOST = 1_000


def text_keys_of(words: np.ndarray, off: np.ndarray) -> pa.Array:
    """A key of 16 bytes for the words of each text: two hashes of different kinds, so that different texts do not meet at any size of corpus."""
    parts = [span_hash(prefix_hash(w), off[:-1], off[1:]) for w in (words, mix(words ^ np.uint64(0x5DEECE66D)))]
    raw = np.ascontiguousarray(np.stack(parts, axis=1)).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(off) - 1, [None, pa.py_buffer(raw)]).cast(pa.binary())


def band_keys(texts: list[str | None], shingle: int, bands: int, band_rows: int) -> np.ndarray:
    """The band keys of each text, which has a word at least."""
    words, off = word_hashes(texts)
    n = np.diff(off)
    grams, _, goff = gram_hashes(words, off, shingle)
    short = (n > 0) & (np.diff(goff) == 0)  # fewer words than a shingle: the whole text is one
    sizes = np.where(short, 1, np.diff(goff))
    all_off = np.zeros(len(off), np.int64)
    np.cumsum(sizes, out=all_off[1:])
    values = np.empty(all_off[-1], np.uint64)
    own = np.repeat(short, sizes)
    values[own], values[~own] = span_hash(prefix_hash(words), off[:-1], off[1:])[short], grams
    some = np.flatnonzero(sizes)
    keys = np.zeros((len(texts), bands), np.uint64)
    at = all_off[:-1][some]
    for b in range(bands):
        band = np.full(len(some), mix(np.array([b + 1], np.uint64))[0])
        for r in range(band_rows):
            odd = mix(np.array([b * band_rows + r + 1], np.uint64))[0] | np.uint64(1)
            scrambled = values * odd
            scrambled ^= scrambled >> np.uint64(32)
            scrambled *= odd
            if len(some):
                band = mix(band ^ np.minimum.reduceat(scrambled, at))
        keys[some, b] = band
    return keys


def close_classes(records: DataFrame, sides: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sides (id, train, held_out) once each; members (id, key, exact, train, held_out) of the classes of
    records with the same words; and (key_e, key_t, similarity, jaccard) of different classes that are nearly
    the same, key_e with held-out members and key_t with members in train.  `exact` is a hash of the text as stored."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                keys = band_keys(texts[a:b], shingle, bands, band_rows)
                ids = np.repeat(batch.column(0).to_numpy()[a:b], bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel().view(np.int64))], names=["id", "band"])

    texts = records.select(F.col("id").cast("bigint").alias("id"), "text").filter("id is not null")
    sides = (
        sides.filter("id is not null").groupBy(F.col("id").cast("bigint").alias("id"))
        .agg(F.coalesce(F.max("train"), F.lit(False)).alias("train"), F.coalesce(F.max("held_out"), F.lit(False)).alias("held_out"))
        .filter("train or held_out")
    )
    members = written(_keyed(texts).join(sides, "id"))
    # one record stands for each different text, so a bucket never holds two copies of a text, and only its bands are made;
    # a record that was delivered with several texts may stand for several classes
    classes = members.groupBy("key").agg(F.min("id").alias("id"), F.max("train").alias("train"), F.max("held_out").alias("held_out"))
    classes = written(classes)
    # written, so that its size is known: it is broadcast while it is small, and the texts are shuffled by id beyond that
    own = written(classes.groupBy("id").agg(F.max("train").alias("train"), F.max("held_out").alias("held_out")))

    def banded(side: str) -> DataFrame:
        return texts.join(own.filter(side).select("id"), "id", "left_semi").mapInArrow(sketch, "id bigint, band bigint")

    near = banded("held_out").withColumnRenamed("id", "id_e").join(banded("train").withColumnRenamed("id", "id_t"), "band").filter("id_e <> id_t").select("id_e", "id_t").distinct()
    keys = classes.select("id", "key", "train", "held_out")
    candidates = written(
        near.join(keys.filter("held_out").select(F.col("id").alias("id_e"), F.col("key").alias("key_e")), "id_e")
        .join(keys.filter("train").select(F.col("id").alias("id_t"), F.col("key").alias("key_t")), "id_t")
        .select("key_e", "key_t")
    )
    # the texts of one record that stands for several classes
    several = classes.groupBy("id").agg(F.collect_list(F.struct("key", "train", "held_out")).alias("own")).filter("size(own) > 1")
    within = several.select(F.explode("own").alias("e"), "own").filter("e.held_out").select("e", F.explode("own").alias("t")).filter("t.train and e.key <> t.key").select("e.key", "t.key")
    candidates = candidates.union(within)

    needed = written(candidates.select(F.col("key_e").alias("key")).union(candidates.select("key_t")).distinct().join(classes.select("key", "id"), "key"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for a, b in chunks(rows):
                words, off = word_hashes(rows[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), text_keys_of(words, off), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(words.view(np.int64)))],
                    names=["id", "key", "words"],
                )

    words = texts.join(needed.select("id"), "id", "left_semi").mapInArrow(words_of, "id bigint, key binary, words array<bigint>").groupBy("key").agg(F.any_value("words").alias("words"))
    pairs = candidates.join(words.toDF("key_e", "words_e"), "key_e").join(words.toDF("key_t", "words_t"), "key_t")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            wa, wb = batch.column("words_e"), batch.column("words_t")
            for i, (ka, kb) in enumerate(zip(batch.column("key_e").to_pylist(), batch.column("key_t").to_pylist(), strict=True)):
                a, b = wa[i].values.to_numpy(), wb[i].values.to_numpy()
                most = max(len(a), len(b))
                if min(len(a), len(b)) < similarity * most:
                    continue
                same = longest_common(a, b, int(similarity * most))
                if same >= similarity * most:
                    out.append((ka, kb, same / most, _jaccard(a, b, shingle)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], names=["key_e", "key_t", "similarity", "jaccard"])

    close = pairs.mapInArrow(verify, "key_e binary, key_t binary, similarity double, jaccard double")
    return sides, members, close


def near_duplicates_across(records: DataFrame, sides: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, similarity: float = SIMILARITY, copies_at_most: int = COPIES_AT_MOST) -> DataFrame:
    """(a, b, similarity, jaccard) of records on different sides whose texts are nearly the same, a < b.

    `records` has id (integer) and text, `sides` has id, train and held_out
    (true for the sides the record is on; ids need not stand in records).
    The similarity is the share of the longer text's words that both have in
    the same order, disregarding case, marks, punctuation, spacing and
    look-alike characters; jaccard is that of their word shingles.  A record
    on both sides is a pair with itself (similarity null if it has no text).
    Null and empty texts, and texts without words, match nothing.

    Copies are collapsed to classes before anything is compared, so a text
    that makes up a third of all records is hashed into buckets once.  Only
    buckets with both sides make candidates; their verification works on whole
    texts.  The classes' members are joined on at the end, as the result asks
    for pairs; of more than copies_at_most exact copies on one side only the first
    stands for all towards other texts, and text_classes() has the others.
    Repeated rows and texts of one id are taken once; empty tables
    give no rows.
    """

    sides, members, close = close_classes(records, sides, shingle, bands, band_rows, similarity)
    ends = members.groupBy("key", "exact").agg(*(F.min(F.when(F.col(c), F.col("id"))).alias(f"first_{c}") for c in ("held_out", "train")), *(F.count_if(c).alias(f"n_{c}") for c in ("held_out", "train")))

    def side(name: str, key: str, alias: str) -> DataFrame:
        own = members.filter(name).join(ends.select("key", "exact", f"first_{name}", f"n_{name}"), ["key", "exact"])
        return own.filter((F.col(f"n_{name}") <= copies_at_most) | (F.col("id") == F.col(f"first_{name}"))).select(F.col("key").alias(key), F.col("id").alias(alias))

    held, train = side("held_out", "key_e", "e"), side("train", "key_t", "t")
    across = close.join(held, "key_e").join(train, "key_t").select("e", "t", "similarity", "jaccard")
    # the same words on both sides; of many exact copies also each with the first on the other side
    alike = held.join(train, F.col("key_e") == F.col("key_t")).select("e", "t")
    large = ends.filter((F.col("n_held_out") > 0) & (F.col("n_train") > 0) & ((F.col("n_held_out") > copies_at_most) | (F.col("n_train") > copies_at_most)))
    many = members.join(large, ["key", "exact"])
    star = many.filter("held_out").select(F.col("id").alias("e"), F.col("first_train").alias("t")).union(many.filter("train").select(F.col("first_held_out").alias("e"), F.col("id").alias("t")))
    found = (
        across.unionByName(alike.union(star).select("e", "t", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("jaccard"))).filter("e <> t")
        .groupBy(F.least("e", "t").alias("a"), F.greatest("e", "t").alias("b"))
        .agg(F.max("similarity").alias("similarity"), F.max("jaccard").alias("jaccard"))
    )
    both = sides.filter("train and held_out").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("jaccard"))
    return found.unionByName(both)


def _keyed(records: DataFrame) -> DataFrame:
    """(id, key, exact): the hashes of each record's words and of its text as stored, once; records without an id or words are left out."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                words, off = word_hashes(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), text_keys_of(words, off), pa.array(np.diff(off).astype(np.int32))], names=["id", "exact", "key", "n"])

    keyed = records.select(F.col("id").cast("bigint").alias("id"), "text", F.xxhash64("text").alias("exact")).filter("id is not null").mapInArrow(keys, "id bigint, exact bigint, key binary, n int")
    return keyed.filter("n > 0").select("id", "key", "exact").distinct()


def text_keys(records: DataFrame) -> DataFrame:
    """(id, key): the hash of each record's words, once; records without an id or words are left out."""
    return _keyed(records).select("id", "key").distinct()


def text_classes(records: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(id, cls, n_copies[, n_links]): the class of records with the same words, named by its smallest id.

    With `sides` also the number of other classes across the split that are
    nearly the same; a record without a side has none.
    """
    keyed = text_keys(records)
    named = keyed.join(keyed.groupBy("key").agg(F.min("id").alias("cls"), F.count("*").alias("n_copies")), "key")
    if sides is None:
        return named.select("id", "cls", "n_copies")
    _, _, close = close_classes(records, sides)
    close = written(close)
    ends = close.select(F.col("key_e").alias("key"), F.col("key_t").alias("other")).union(close.select("key_t", "key_e")).distinct()
    linked = named.join(ends.groupBy("key").agg(F.count("*").alias("n_links")), "key", "left")
    return linked.select("id", "cls", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _jaccard(a: np.ndarray, b: np.ndarray, shingle: int) -> float:
    """Exact Jaccard similarity of two texts' shingles; of their words if one is shorter than a shingle."""
    k = shingle if min(len(a), len(b)) >= shingle else 1
    x, y = (set(zip(*(w[i:].tolist() for i in range(k)), strict=False)) for w in (a, b))
    return len(x & y) / len(x | y)


def overlap_report(records: DataFrame, sides: DataFrame, sources: DataFrame) -> DataFrame:
    """(split, source, n_records, n_pairs): the held-out records with a partner in train, by split and source.

    `records` has id and text, `sides` has id and split (one row for each
    split of a record), `sources` has id and source; a record without source
    counts under null.  n_pairs counts the pairs of a record of the split with
    a record in train, itself too if it is on both sides, of all copies.
    Records with the same texts are counted as one class, whose partners in
    train are the sum of its partner classes' sizes, so no pair is listed.
    """
    held = sides.filter("split <> 'train' and id is not null").select(F.col("id").cast("bigint").alias("id"), "split").distinct()
    both, members, close = close_classes(records, sides.select("id", (F.col("split") == "train").alias("train"), (F.col("split") != "train").alias("held_out")))
    # a record may have several texts: classes are of records with the same set of texts, so that no partner counts twice
    sets = written(members.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.max("train").alias("train")))
    classes = sets.groupBy("keys").agg(F.count_if("train").alias("n_train")).select(F.explode("keys").alias("key"), "keys", "n_train")
    to = close.select("key_e", "key_t").union(members.filter("held_out").select("key", "key").distinct())
    theirs = classes.filter("n_train > 0").select(F.col("key").alias("key_t"), F.col("keys").alias("keys_t"), "n_train")
    linked = classes.select(F.col("key").alias("key_e"), "keys").join(to, "key_e").join(theirs, "key_t").select("keys", "keys_t", "n_train").distinct()
    partners = linked.groupBy("keys").agg(F.sum("n_train").alias("n"))
    of_texts = sets.join(partners, "keys").select("id", "n")
    textless = both.filter("train and held_out").join(members, "id", "left_anti").select("id", F.lit(1).cast("bigint").alias("n"))
    source = sources.groupBy("id").agg(F.min("source").alias("source"))
    return (
        of_texts.unionByName(textless).join(held, "id").join(source, "id", "left").groupBy("split", "source")
        .agg(F.count("*").alias("n_records"), F.sum("n").alias("n_pairs"))
    )
