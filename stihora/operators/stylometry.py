"""Style profiles of authors and poems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stihora.functions import numeric as N
from stihora.functions import text as T

POS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")


def mattr(tokens: DataFrame, group: str, order: list[str], item: str = "lemma", window: int = 200, by_range: bool = False) -> DataFrame:
    """(group, n, window_sum, mattr): mean share of different items over all windows of so many tokens.

    Each token adds one to every window in which it is the first of its kind,
    and the number of those follows from the place of the previous equal
    token: one lag and one sum replace counting each window.  Groups no longer
    than the window have one window, the whole.

    Places are numbered within each group; with by_range they come from a
    range partitioning of all tokens, so that a group that holds a large part
    of them is numbered by many tasks.
    """
    if by_range:
        from .relations import dense_ids

        numbered = dense_ids(tokens.select(group, *order, F.col(item).alias("_item")), [group, *order], "_d")
        bounds = numbered.groupBy(group).agg(F.min("_d").alias("_first"), F.count("*").alias("n"))
        placed = numbered.join(bounds, group).select(group, "_item", (F.col("_d") - F.col("_first")).alias("_i"), "n")
    else:
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
        n = F.count("*").over(Window.partitionBy(group))
        placed = tokens.select(group, F.col(item).alias("_item"), place.alias("_i"), n.alias("n"))
    before = F.coalesce(F.lag("_i").over(Window.partitionBy(group, "_item").orderBy("_i")), F.lit(-1))
    w = F.least(F.lit(window), F.col("n"))
    first = F.greatest(before + 1, F.col("_i") - w + 1, F.lit(0))
    starts = F.greatest(F.lit(0), F.least(F.col("_i"), F.col("n") - w) - first + 1)
    sums = placed.withColumn("_s", starts).groupBy(group).agg(F.any_value("n").alias("n"), F.sum("_s").alias("window_sum"))
    size = F.least(F.lit(window), F.col("n"))
    return sums.withColumn("mattr", F.col("window_sum") / ((F.col("n") - size + 1) * size))


def pos_bigrams(tokens: DataFrame, key: str = "poem_id", keep: tuple[str, ...] = ("author",)) -> DataFrame:
    """Adjacent parts of speech, never across poems."""
    w = Window.partitionBy(key).orderBy("line_no", "tok_no")
    return tokens.select(key, *keep, "pos", F.lead("pos").over(w).alias("next_pos")).filter("next_pos is not null")


def neighbours(tokens: DataFrame, key: str = "poem_id") -> DataFrame:
    """Tokens with the parts of speech before and after them in their line, null at its edges."""
    w = Window.partitionBy(key, "line_no").orderBy("tok_no")
    return tokens.withColumns({"prev_pos": F.lag("pos").over(w), "next_pos": F.lead("pos").over(w)})


def transitions(bigrams: DataFrame, group: str = "author") -> DataFrame:
    """(group, pos, next_pos, n, p): how often one part of speech follows another, and its share."""
    n = bigrams.groupBy(group, "pos", "next_pos").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group, "pos")))


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= n)


def vocabulary(tokens: DataFrame, group: str = "author") -> DataFrame:
    """(group, pos, lemma, n)."""
    return tokens.groupBy(group, "pos", "lemma").agg(F.count("*").alias("n"))


def majority(df: DataFrame, group: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first."""
    n = df.groupBy(*group, *value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    best = F.min_by(F.struct(*value, "n"), F.struct((-F.col("n")).alias("a"), F.col("_first").alias("b")))
    return n.groupBy(*group).agg(best.alias("_v")).select(*group, "_v.*")


def line_stats(poems: DataFrame, keep: tuple[str, ...] = ("author",)) -> DataFrame:
    """poem_id, kept columns, tokens, lines, stanzas and lines in stanzas of each poem."""
    ls, st = T.lines(F.col("text")), T.stanzas(F.col("text"))
    per_line = F.aggregate(ls, F.lit(0), lambda s, x: s + F.size(T.whitespace_tokens(x)))
    per_stanza = F.aggregate(st, F.lit(0), lambda s, x: s + F.size(T.lines(x)))
    return poems.select("poem_id", *keep, per_line.alias("tokens"), F.size(ls).alias("lines"), F.size(st).alias("stanzas"), per_stanza.alias("stanza_lines"))


def poem_features(poems: DataFrame, tokens: DataFrame, window: int = 200) -> DataFrame:
    """One row of features for each poem; zeros for a poem without words of content."""
    stats = line_stats(poems)
    shares = tokens.groupBy("poem_id").agg(*(F.avg((F.col("pos") == p).cast("double")).alias(f"share_{p.lower()}") for p in POS), F.count("*").alias("n_content"))
    diversity = mattr(tokens, "poem_id", ["line_no", "tok_no"], window=window).select("poem_id", "mattr")
    zero = {f"share_{p.lower()}": 0.0 for p in POS} | {"n_content": 0, "mattr": 0.0}
    return (
        stats.join(shares, "poem_id", "left").join(diversity, "poem_id", "left").fillna(zero)
        .withColumn("tokens_per_line", N.share(F.col("tokens"), F.col("lines")))
        .withColumn("lines_per_stanza", N.share(F.col("stanza_lines"), F.col("stanzas")))
    )


def author_profile(poems: DataFrame, tokens: DataFrame, rhymes: DataFrame, group: str = "author", window: int = 200, top: int = 5) -> DataFrame:
    """One row of style for each author that has tokens; ratios are ratios of sums."""
    from stihora.storage import written

    tokens = written(tokens.select(group, "poem_id", "line_no", "tok_no", "lemma", "pos"))  # read three times
    stats = line_stats(poems, (group,)).groupBy(group).agg(F.count("*").alias("num_poems"), *(F.sum(c).alias(c) for c in ("tokens", "lines", "stanzas", "stanza_lines")))
    words = tokens.groupBy(group).agg(
        F.count("*").alias("num_tokens"), *(F.avg((F.col("pos") == p).cast("double")).alias(f"pct_{p.lower()}") for p in POS), (F.countDistinct("lemma") / F.count("*")).alias("ttr"),
    )
    diversity = mattr(tokens, group, ["poem_id", "line_no", "tok_no"], window=window, by_range=True).select(group, "mattr")
    pairs = pos_bigrams(tokens, keep=(group,)).groupBy(group, F.concat_ws(">", "pos", "next_pos").alias("item")).agg(F.count("*").alias("n"))
    return (
        words.join(stats, group).join(diversity, group).join(_top_list(pairs, group, top, "top_bigrams"), group, "left")
        .join(_top_list(rhymes.groupBy(group, F.col("ending").alias("item")).agg(F.count("*").alias("n")), group, top, "top_rhymes"), group, "left")
        .withColumns({
            "tokens_per_line": N.share(F.col("tokens"), F.col("lines")), "lines_per_poem": F.col("lines") / F.col("num_poems"),
            "stanzas_per_poem": F.col("stanzas") / F.col("num_poems"), "lines_per_stanza": N.share(F.col("stanza_lines"), F.col("stanzas")),
        }).drop("tokens", "lines", "stanzas", "stanza_lines")
    )


def _top_list(counted: DataFrame, group: str, n: int, name: str) -> DataFrame:
    best = top_n(counted, [group], [F.desc("n"), F.col("item")], n)
    items = F.sort_array(F.collect_list(F.struct("rank", "item")))
    return best.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x["item"]), "|").alias(name))


def percentiles(profile: DataFrame, name: str, value: str, key: str = "author") -> DataFrame:
    """(key, value, percentile from 0 to 100); ties go by key, and a single row has 0.

    One row for each author is ranked at once, not the corpus.
    """
    w = Window.orderBy(value, key)
    n = F.count("*").over(Window.partitionBy())
    return profile.select(key, F.lit(name).alias("name"), F.col(value).alias("value"), F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1) * 100).otherwise(0.0).alias("percentile"))


def band(percentile: Column) -> Column:
    return F.when(percentile < 33.3, "low").when(percentile <= 66.7, "mid").otherwise("high")


def describe(bands: DataFrame, phrases: DataFrame, key: str = "author") -> DataFrame:
    """One text for each author from the phrases (name, band, phrase, place) of its bands."""
    joined = bands.join(phrases, ["name", "band"])
    return joined.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "phrase"))), lambda x: x["phrase"]), " ").alias("description"))
