"""TF-IDF with smoothed document frequencies and unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stihora.functions import text as T

from .stylometry import top_n


def tfidf(terms: DataFrame, doc: str, term: str, sublinear: bool = False, least_df: int = 1, most_df: float = 1.0, n_docs: int | None = None) -> DataFrame:
    """(doc, term, tf, df, weight): weight = tf * (ln((1 + n) / (1 + df)) + 1), each document at length one.

    sublinear takes 1 + ln(tf) for tf.  Terms in fewer than least_df documents
    or in more than the share most_df of them are dropped before the length
    is taken.  Document frequencies are counted before they are shuffled and
    joined on, so a term that stands in every document is never gathered in
    one task: the adaptive join splits or broadcasts it.
    """
    from stihora.storage import written

    tf = written(terms.groupBy(doc, term).agg(F.count("*").alias("tf")))  # read three times
    n: Column | int = n_docs if n_docs is not None else tf.agg(F.countDistinct(doc)).head()[0]
    frequency = tf.groupBy(term).agg(F.count("*").alias("df")).filter((F.col("df") >= least_df) & (F.col("df") <= most_df * n))
    df = tf.join(frequency, term)
    raw = (1 + F.log("tf") if sublinear else F.col("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    weighed = df.withColumn("_w", raw)
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return weighed.select(doc, term, "tf", "df", (F.col("_w") / length).alias("weight"))


def top_terms(weights: DataFrame, doc: str, term: str, n: int) -> DataFrame:
    return top_n(weights.filter("weight > 0"), [doc], [F.desc("weight"), F.col(term)], n)


def char_ngrams(words: DataFrame, word: str = "word", low: int = 2, high: int = 4) -> DataFrame:
    """Character n-grams within words that are padded by a blank on both sides."""
    padded = F.concat(F.lit(" "), F.col(word), F.lit(" "))

    def of_length(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (k - 1), F.lit(1)))
        return F.when(F.length(padded) >= k, F.transform(starts, lambda i: F.substring(padded, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*(of_length(k) for k in range(low, high + 1))))
    return words.withColumn("gram", F.explode(grams))


def word_ngrams(df: DataFrame, text: str = "text") -> DataFrame:
    """Words and pairs of words of a text."""
    w = T.words(F.col(text))
    return df.withColumn("gram", F.explode(F.concat(w, T.ngrams(w, 2))))
