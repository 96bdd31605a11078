"""Candidates for replacing words, ranked by tiers, and their inflected forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stihora.functions import numeric as N
from stihora.functions import text as T

#: Weights of the parts of a candidate's score: TF-IDF, similarity, co-occurrence, transition.
WEIGHTS = (0.4, 0.35, 0.15, 0.10)


def transition_score(slots: DataFrame, transitions: DataFrame, author: str) -> DataFrame:
    """slots (prev_pos, pos, next_pos) with the mean probability of the sides that exist; a bigram never seen counts 0."""
    t = transitions.select(F.col("author").alias(author), F.col("pos").alias("_from"), F.col("next_pos").alias("_to"), "p")
    before = t.toDF(author, "prev_pos", "pos", "_in")
    after = t.toDF(author, "pos", "next_pos", "_out")
    out = slots.join(before, [author, "prev_pos", "pos"], "left").join(after, [author, "pos", "next_pos"], "left")
    into = F.when(F.col("prev_pos").isNotNull(), F.coalesce("_in", F.lit(0.0)))
    from_ = F.when(F.col("next_pos").isNotNull(), F.coalesce("_out", F.lit(0.0)))
    return out.withColumn("transition", F.coalesce(N.mean_of_known(into, from_), F.lit(0.0))).drop("_in", "_out")


def composite(pool: DataFrame, slot: str) -> DataFrame:
    """pool (tfidf, sem, cooc, transition) with its score; TF-IDF and co-occurrence count relative to the slot's largest."""
    w = Window.partitionBy(slot)
    top = lambda c: F.coalesce(F.nullif(F.max(c).over(w), F.lit(0)), F.lit(1))
    a, b, c, d = WEIGHTS
    return pool.withColumn("score", a * F.col("tfidf") / top("tfidf") + b * F.coalesce("sem", F.lit(0.0)) + c * F.col("cooc") / top("cooc") + d * F.col("transition"))


def relaxed_threshold(pool: DataFrame, slot: str, enough: int = 3, start: float = 0.65, least: float = 0.45, step: float = 0.05) -> DataFrame:
    """(slot, threshold): the first, ever lower threshold that enough candidates reach; the lowest if none does.

    Candidates are counted at all thresholds in one aggregation.
    """
    n = round((start - least) / step)
    steps = [round(start - i * step, 6) for i in range(n + 1)]
    counted = pool.groupBy(slot).agg(*(F.count_if(F.col("sem").isNull() | (F.col("sem") >= t)).alias(f"_c{i}") for i, t in enumerate(steps)))
    pick = F.coalesce(*(F.when(F.col(f"_c{i}") >= enough, F.lit(t)) for i, t in enumerate(steps)), F.lit(steps[-1]))
    return counted.select(slot, pick.alias("threshold"))


def ranked(candidates: DataFrame, slot: str, k: int = 3) -> DataFrame:
    """The k best candidates of each slot: by tier, then score, then lemma."""
    w = Window.partitionBy(slot).orderBy("tier", F.round("score", 9).desc(), "lemma")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def should_replace(tokens: DataFrame, source_terms: DataFrame, target_terms: DataFrame, target_vocabulary: DataFrame) -> DataFrame:
    """tokens with `replace`: typical of the source and not of the target, or an adjective, adverb or verb that the target lacks."""
    flag = lambda df, name, *on: df.select(*on).distinct().withColumn(name, F.lit(True))
    out = (
        tokens.join(flag(source_terms, "_src", "author", "lemma"), ["author", "lemma"], "left")
        .join(flag(target_terms, "_tgt", "target", "lemma"), ["target", "lemma"], "left")
        .join(flag(target_vocabulary, "_has", "target", "pos", "lemma"), ["target", "pos", "lemma"], "left")
    )
    typical = F.col("_src").isNotNull() & F.col("_tgt").isNull()
    lacking = F.col("pos").isin("ADJ", "ADV", "VERB") & F.col("_has").isNull()
    return out.withColumn("replace", typical | lacking).drop("_src", "_tgt", "_has")


def morph_lookup(tokens: DataFrame, group: list[str]) -> DataFrame:
    """(group, lemma, pos, feats, surface): the most frequent surface of each bundle, alphabetically first of equal ones."""
    n = tokens.groupBy(*group, "lemma", "pos", "feats", "word").agg(F.count("*").alias("n"))
    return n.groupBy(*group, "lemma", "pos", "feats").agg(F.min_by("word", F.struct((-F.col("n")).alias("a"), F.col("word").alias("b"))).alias("surface"))


def surface_forms(wanted: DataFrame, own: DataFrame, pooled: DataFrame) -> DataFrame:
    """wanted (author, lemma, pos, feats) with surface and tier.

    In order: the author's form for the bundle, anyone's form for it, a form
    for ever looser bundles, the form that most bundles of the lemma have, the
    lemma itself.  Later ways are only tried for what earlier ones left.
    """
    keyed = wanted.withColumn("_id", F.xxhash64("author", "lemma", "pos", "feats"))
    exact = keyed.join(own.withColumnRenamed("surface", "_own"), ["author", "lemma", "pos", "feats"], "left").join(pooled.withColumnRenamed("surface", "_any"), ["lemma", "pos", "feats"], "left")
    exact = exact.withColumns({"_own": F.when(F.col("feats") != "", F.col("_own")), "_any": F.when(F.col("feats") != "", F.col("_any"))})
    left = exact.filter("_own is null and _any is null").select("_id", "author", "lemma", "pos", "feats")
    bundles = left.withColumn("_steps", T.relaxed_features(T.parse_features(F.col("feats")), F.col("pos"))).select("*", F.posexplode("_steps").alias("_step", "_want"))

    def match(stored: DataFrame, on: list[str], side: int) -> DataFrame:
        have = stored.withColumn("_have", T.parse_features(F.col("feats"))).drop("feats")
        hit = bundles.join(have, on).filter(F.forall(F.map_entries("_want"), lambda e: F.coalesce(F.try_element_at(F.col("_have"), e["key"]) == e["value"], F.lit(False))))
        votes = hit.groupBy("_id", "_step", "surface").agg(F.count("*").alias("n"))
        return votes.withColumn("_side", F.lit(side))

    loose = match(own, ["author", "lemma", "pos"], 0).unionByName(match(pooled, ["lemma", "pos"], 1))
    loose = loose.groupBy("_id").agg(F.min_by("surface", F.struct("_step", "_side", (-F.col("n")).alias("a"), "surface")).alias("_loose"))

    def nearest(stored: DataFrame, on: list[str], side: int) -> DataFrame:
        gender = lambda c: F.try_element_at(T.parse_features(F.col(c)), F.lit("Gender"))
        hit = left.withColumnRenamed("feats", "_want").join(stored, on).filter(gender("_want").isNull() | (F.col("pos") == "NOUN") | (gender("_want") == gender("feats")))
        return hit.groupBy("_id", "surface").agg(F.count("*").alias("n")).withColumn("_side", F.lit(side))

    near = nearest(own, ["author", "lemma", "pos"], 0).unionByName(nearest(pooled, ["lemma", "pos"], 1))
    near = near.groupBy("_id").agg(F.min_by("surface", F.struct("_side", (-F.col("n")).alias("a"), "surface")).alias("_near"))
    out = exact.join(loose, "_id", "left").join(near, "_id", "left")
    tier = F.when(F.col("_own").isNotNull(), "exact").when(F.col("_any").isNotNull(), "cross_author").when(F.col("_loose").isNotNull(), "relaxed").when(F.col("_near").isNotNull(), "nearest_attested").otherwise("unresolved")
    return out.select(*wanted.columns, F.coalesce("_own", "_any", "_loose", "_near", "lemma").alias("surface"), tier.alias("tier"))


#: Endings of a verbal adverb and what its verb may end in.
GERUND, VERB_STEMS = "јќи", ("", "и", "е")


def gerund_lemmas(gerunds: DataFrame, verbs: DataFrame) -> DataFrame:
    """(word, lemma, known): the verb behind each verbal adverb; of the possible stems the most frequent verb."""
    stem = F.regexp_replace("word", f"{GERUND}$", "")
    bare = F.regexp_replace(stem, "[аеи]$", "")
    tried = gerunds.select("word", stem.alias("_stem"), F.explode(F.array(stem, F.concat(bare, F.lit("и")), F.concat(bare, F.lit("е")))).alias("lemma")).distinct()
    found = tried.join(verbs.select("lemma", "n"), "lemma").groupBy("word").agg(F.max_by("lemma", F.struct("n", "lemma")).alias("_found"))
    fallback = F.when(stem.endswith("е"), F.concat(bare, F.lit("и"))).otherwise(stem)
    return gerunds.join(found, "word", "left").select("word", F.coalesce("_found", fallback).alias("lemma"), F.col("_found").isNotNull().alias("known"))


def flag_reasons(tokens: DataFrame, tag_share: Column | None = None) -> DataFrame:
    """tokens with `reasons`, the doubts about each tagging; expects share and n of the tag among the word's tags."""
    w, lemma, pos = F.col("word"), F.col("lemma"), F.col("pos")
    rules = {
        "unknown_tag": pos.isin("X", "SYM"), "mixed_script": w.rlike("[Ѐ-ӿ]") & w.rlike("[A-Za-z]"), "non_cyrillic": ~w.rlike("[Ѐ-ӿ]"), "empty_lemma": F.coalesce(lemma, F.lit("")) == "",
        "bad_lemma": lemma.rlike(r"[^\p{L}\-']"), "lowercase_propn": (pos == "PROPN") & (F.lower(w) == w), "unstable_tag": (F.col("n_word") >= 4) & (F.col("tag_share") <= 0.20),
    }
    return tokens.withColumn("reasons", F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull()))


def with_tag_shares(tokens: DataFrame) -> DataFrame:
    """tokens with how often their word stands in the corpus and the share of their tag; counted first, then joined."""
    n = tokens.groupBy("word", "pos").agg(F.count("*").alias("_c"))
    shares = n.withColumn("n_word", F.sum("_c").over(Window.partitionBy("word"))).withColumn("tag_share", F.col("_c") / F.col("n_word")).drop("_c")
    return tokens.join(shares, ["word", "pos"])


def slot_spec(slots: DataFrame, poem: str = "poem_id", explicit: bool = False) -> DataFrame:
    """(poem, spec): one line of text for each slot, in order."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("word"), F.lit(" ["), F.col("pos"), F.lit("]"), F.concat(F.lit(" -> "), F.array_join("options", " / ")) if explicit else F.lit(""))
    items = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return slots.groupBy(poem).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("spec"))
