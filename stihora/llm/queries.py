"""The queries of problems 1 to 8 and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stihora.shipping import ship

from . import answers, contributor_cap, cross_split, language, leakage, normal_form, shared, shared_spans, tokenizer


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


#: The share of all poems that one author may keep.
AUTHOR_SHARE = 0.03


def _scored_songs(spark: SparkSession, d: str) -> DataFrame:
    """contributor, record and quality of each poem_id."""
    songs = _t(spark, d, "stripped_songs").filter("poem_id is not null").groupBy("poem_id").agg(F.max_by("author", F.struct("ingested_at", "author")).alias("author"))
    latest = F.struct("scored_at", F.coalesce("quality", F.lit(float("-inf"))))
    scores = _t(spark, d, "scored_poems").groupBy("poem_id").agg(F.max_by("quality", latest).alias("quality"))
    named = contributor_cap.contributors(songs, "author", _t(spark, d, "authors"), ["author", "author_latin"], "author_id")
    return named.join(scores, "poem_id", "left").select("contributor", F.col("poem_id").alias("record"), "quality")


def _author_cap(spark: SparkSession, d: str) -> int:
    n = _t(spark, d, "stripped_songs").agg(F.countDistinct("poem_id")).head()[0]
    return int(AUTHOR_SHARE * n)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Poems beyond their author's cap."""
    return contributor_cap.over_cap(_scored_songs(spark, d), _author_cap(spark, d)).select(F.col("record").alias("poem_id"))


def p1_authors(spark: SparkSession, d: str) -> DataFrame:
    """How many poems each author has, and how many are beyond the cap."""
    scored = _scored_songs(spark, d)
    over = contributor_cap.over_cap(scored, _author_cap(spark, d)).groupBy("contributor").agg(F.count("*").alias("n_over"))
    every = scored.groupBy("contributor").agg(F.count("*").alias("n_poems"))
    return every.join(over, "contributor", "left").select("contributor", "n_poems", F.coalesce("n_over", F.lit(0)).cast("bigint").alias("n_over"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _scored_songs_sql() -> str:
    a, b = map(_sql_text, shared.fold_maps())
    key = f"array_to_string(list_sort(regexp_extract_all(translate(lower(%s), {a}, {b}), '[\\p{{L}}\\p{{N}}]+')), ' ')"
    return f"""
        songs AS (SELECT poem_id, arg_max(author, (ingested_at, author)) AS author FROM stripped_songs GROUP BY 1),
        scores AS (SELECT poem_id, quality FROM scored_poems
            QUALIFY row_number() OVER (PARTITION BY poem_id ORDER BY scored_at DESC, quality DESC NULLS LAST) = 1),
        aliases AS (SELECT k, min(author_id) AS id FROM (
            SELECT {key % "author"} AS k, author_id FROM authors UNION ALL SELECT {key % "author_latin"}, author_id FROM authors) GROUP BY 1),
        keyed AS (SELECT poem_id, nullif({key % "author"}, '') AS k FROM songs),
        named AS (SELECT keyed.poem_id, coalesce('id:' || aliases.id, 'name:' || keyed.k) AS contributor, quality
            FROM keyed LEFT JOIN aliases ON keyed.k = aliases.k LEFT JOIN scores ON keyed.poem_id = scores.poem_id),
        ranked AS (SELECT *, contributor IS NOT NULL AND row_number() OVER (PARTITION BY contributor ORDER BY quality DESC NULLS LAST, poem_id)
            > floor({AUTHOR_SHARE}::DOUBLE * (SELECT count(DISTINCT poem_id) FROM stripped_songs)) AS beyond FROM named)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Poems and generated examples as records, named p:id and g:id."""
    songs = _t(spark, d, "stripped_songs").select(F.concat(F.lit("p:"), "poem_id").alias("rec"), F.col("song_text").alias("text"))
    examples = _t(spark, d, "synthetic_dataset").select(F.concat(F.lit("g:"), "example_id").alias("rec"), F.col("generated_poem").alias("text"))
    return songs.unionByName(examples)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records with a common span of at least 100 characters."""
    return shared_spans.SharedSpans(_records(spark, d)).pairs()


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Each record with a shared span, its class of copies and its number of links."""
    return shared_spans.SharedSpans(_records(spark, d)).membership()


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans that very many texts share, with every record that holds one."""
    return shared_spans.SharedSpans(_records(spark, d)).span_classes()


def p2_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The maximal repeats of 100 characters or more: length, number of texts, and first place."""
    return shared_spans.SharedSpans(_records(spark, d)).maximal_repeats().drop("text")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record of 100 characters or more is found elsewhere."""
    return shared_spans.SharedSpans(_records(spark, d)).coverage()


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """id and split of each assignment; labels are compared without case and outer spaces."""
    label = F.regexp_replace(F.lower("split"), r"^\s+|\s+$", "")
    return _t(spark, d, "poem_splits").select(F.col("poem_id").alias("id"), label.alias("split")).filter("split in ('train', 'val', 'test')")


def _songs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "stripped_songs").select(F.col("poem_id").alias("id"), F.col("song_text").alias("text"))


def _two_sides(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d).select("id", (F.col("split") == "train").alias("train"), (F.col("split") != "train").alias("held_out"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of poems across train and the held-out splits with the same or nearly the same text."""
    return cross_split.near_duplicates_across(_songs(spark, d), _two_sides(spark, d)).select(F.col("a").alias("poem_a"), F.col("b").alias("poem_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Poems with the same words as classes, and the number of classes across the split that are nearly the same."""
    return cross_split.text_classes(_songs(spark, d), _two_sides(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Held-out poems with a partner in train, by split and author."""
    songs = _t(spark, d, "stripped_songs").select("poem_id", "author")
    named = contributor_cap.contributors(songs, "author", _t(spark, d, "authors"), ["author", "author_latin"], "author_id")
    return cross_split.overlap_report(_songs(spark, d), _sides(spark, d), named.select(F.col("poem_id").alias("id"), F.col("contributor").alias("source")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each affected document with the items it contains."""
    # fingerprints are joined here, as for an index too large to be broadcast
    found = leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"), broadcast_words=-1)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.max("n_words").alias("longest"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    songs = _t(spark, d, "stripped_songs").select(F.lit("song_text").alias("field"), F.col("poem_id").alias("rec_id"), F.col("song_text").alias("text"))
    words = _t(spark, d, "pos_corrections").select(F.lit("word").alias("field"), F.col("rule_id").alias("rec_id"), F.col("word").alias("text"))
    return songs.unionByName(words)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are not in the consistent form."""
    return normal_form.consistent_form(_fields(spark, d), ["field", "rec_id"]).filter("changed").select("field", "rec_id").distinct()


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    return normal_form.consistent_form(_fields(spark, d), ["field", "rec_id"])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_documents(_t(spark, d, "documents"))


def _language_model(spark: SparkSession, d: str) -> language.Model:
    trusted = _t(spark, d, "lang_samples").select("lang", "text").unionByName(_t(spark, d, "eval_items").select("lang", "text"))
    return language.fit_on_tables(trusted, _t(spark, d, "documents"))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    examples = _t(spark, d, "synthetic_dataset").select("example_id", F.col("source_poem_id").alias("source_id"), F.col("generated_poem").alias("answer"))
    prompts = _t(spark, d, "stripped_songs").select(F.col("poem_id").alias("id"), F.col("song_text").alias("text"))
    trusted = _t(spark, d, "lang_samples").select("lang", "text").unionByName(_t(spark, d, "eval_items").select("lang", "text"))
    return answers.defects(examples, prompts, language.fit_on_tables(trusted))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each defective example with its first defect."""
    return answers.first_defects(_defects(spark, d))


def p4_all(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of each example."""
    return _defects(spark, d).select("example_id", "defect")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a missing or wrong label, or in several languages."""
    return language.label_issues(_t(spark, d, "documents"), _language_model(spark, d)).select("doc_id", "issue", "lang")


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of each document and of each passage in another language, with confidence."""
    return language.identify(_t(spark, d, "documents"), _language_model(spark, d)).drop("n_known")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_scored_songs_sql()} SELECT poem_id FROM ranked WHERE beyond",
        "p1_authors": f"WITH {_scored_songs_sql()} SELECT contributor, count(*) AS n_poems, count(*) FILTER (beyond) AS n_over FROM ranked GROUP BY 1",
    }
