"""The relations that everything else is built on: poems, lines, stanzas, tokens.

Order is part of the data, so every relation carries its ordinals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stihora.functions import text as T

CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")


def required(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which no such column is null or blank."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & (T.trimmed(F.col(c).cast("string")) != ""))
    return df


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one delivered last; rows with a null key are dropped."""
    rest = [c for c in df.columns if c not in keys]
    one = F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_one")
    return df.dropna(subset=keys).groupBy(*keys).agg(one).select(*keys, "_one.*")


def poems(songs: DataFrame) -> DataFrame:
    """poem_id, author, title, text of each poem with an author and a text; lines are trimmed."""
    one = latest(songs, ["poem_id"], "ingested_at") if "ingested_at" in songs.columns else songs.dropDuplicates(["poem_id"])
    return required(one, "author", "song_text").select("poem_id", T.trimmed(F.col("author")).alias("author"), F.col("song_title").alias("title"), T.trim_lines(F.col("song_text")).alias("text"))


def dense_ids(df: DataFrame, order: list[str], name: str = "dense_id") -> DataFrame:
    """A gapless number from 0 in the order of some columns, without a global window.

    Rows are range-partitioned and numbered within each partition; the
    partitions' sizes, one number each, are summed up and added.
    """
    from stihora.storage import written

    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = written(df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + within - 1).drop("_part", "_before")


def line_table(df: DataFrame, key: str = "poem_id", text: str = "text", keep: tuple[str, ...] = ("author",)) -> DataFrame:
    """key, kept columns, line_no (from 1) and line of each line that is not blank."""
    return df.select(key, *keep, F.posexplode(T.lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def stanza_table(df: DataFrame, key: str = "poem_id", text: str = "text", keep: tuple[str, ...] = ("author",)) -> DataFrame:
    return df.select(key, *keep, F.posexplode(T.stanzas(F.col(text))).alias("stanza_no", "stanza")).withColumn("stanza_no", F.col("stanza_no") + 1)


def token_table(lines: DataFrame, key: str = "poem_id", keep: tuple[str, ...] = ("author",), pattern: str = T.LETTERS) -> DataFrame:
    """key, kept columns, line_no, tok_no (from 1 within the line) and word of each word."""
    return lines.select(key, *keep, "line_no", F.posexplode(T.words(F.col("line"), pattern)).alias("tok_no", "word")).withColumn("tok_no", F.col("tok_no") + 1)


#: The rule tagger's endings.  It stands in wherever no trained tagger is plugged in.
VERB_END, ADJ_END, ADV_END, ARTICLE, PLURAL = "(ува|ее|ие|ѓа|ќа|ши|ри)$", "(на|ва|ма|да|ра)$", "(но|ку|ко|ѓу)$", "(от|та|то|те)$", "(и|ите)$"


def rule_pos(word: Column) -> Column:
    return (
        F.when(F.length(word) <= 3, "ADP").when(word.rlike(VERB_END), "VERB").when(word.rlike(ADJ_END), "ADJ").when(word.rlike(ADV_END), "ADV").otherwise("NOUN")
    )


def rule_lemma(word: Column) -> Column:
    return F.when(F.length(word) > 5, F.regexp_replace(word, ARTICLE, "")).otherwise(word)


def rule_feats(word: Column) -> Column:
    definite = F.when((F.length(word) > 5) & word.rlike(ARTICLE), "Definite=Def").otherwise("Definite=Ind")
    return F.concat_ws("|", definite, F.when(word.rlike(PLURAL), "Number=Plur").otherwise("Number=Sing"))


def rule_tagged(tokens: DataFrame) -> DataFrame:
    """Tokens with lemma, pos and feats by rule, as expressions inside the JVM."""
    w = F.col("word")
    return tokens.withColumns({"lemma": rule_lemma(w), "pos": rule_pos(w), "feats": rule_feats(w)})


def content(tokens: DataFrame, xpos: str | None = None) -> DataFrame:
    """Content words: by part of speech, and not relative adverbs where a finer tag is given."""
    kept = tokens.filter(F.col("pos").isin(*CONTENT_POS))
    return kept.filter(F.coalesce(F.col(xpos), F.lit("")) != "Rg") if xpos else kept


@lru_cache(1 << 16)
def rule_term(word: str) -> str | None:
    """Lemma and part of speech of a word of letters by rule_lemma() and rule_pos(), outside the JVM; None if it isn't a content word."""
    ends = (("VERB", VERB_END), ("ADJ", ADJ_END), ("ADV", ADV_END))
    pos = "ADP" if len(word) <= 3 else next((p for p, end in ends if re.search(end, word)), "NOUN")
    return f"{re.sub(ARTICLE, '', word) if len(word) > 5 else word}|{pos}" if pos in CONTENT_POS else None


def term_sets(df: DataFrame, text: str) -> DataFrame:
    """x: the different rule_term()s of each text, without a row for each token; a different word is tagged once in a batch.

    Lines end in no letters, so a text's words are those of its lines.
    """
    return df.select(F.array_distinct(T.words(F.col(text))).alias("x")).mapInArrow(_term_sets, "x array<string>")


def _term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        texts = batch.column(0)
        words = texts.flatten().dictionary_encode()
        terms = pa.array([rule_term(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
        term = np.asarray(terms.indices.fill_null(-1), np.int64)[np.asarray(words.indices)]
        row = np.repeat(np.arange(len(texts)), np.asarray(texts.value_lengths().fill_null(0)))
        n = max(1, len(terms.dictionary))
        both = np.sort((row * n + term)[term >= 0])
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        ends = np.append(0, np.cumsum(np.bincount(both // n, minlength=len(texts))))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms.dictionary.take(pa.array(both % n)))], names=["x"])


def eligible(df: DataFrame, group: str = "author", key: str = "poem_id", least: int = 5) -> DataFrame:
    """Rows of the groups that have at least so many different keys."""
    enough = df.groupBy(group).agg(F.countDistinct(key).alias("_n")).filter(F.col("_n") >= least).select(group)
    return df.join(enough, group, "left_semi")
