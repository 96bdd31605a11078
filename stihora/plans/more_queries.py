"""Queries of the remaining sources, sinks, projections and small functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stihora.functions import text as T
from stihora.operators import evaluation as E
from stihora.operators import generation as G
from stihora.operators import graph as GR
from stihora.operators import ml as M
from stihora.operators import relations as R
from stihora.functions import numeric as N
from stihora.operators import stylometry as S
from stihora.sources import files
from stihora.streaming import streams

from .evaluation_queries import scored, steps
from .graph_queries import EDGES, best_words, cooc_edges, pos_colour
from .other_queries import EVENT_SCHEMA, _events, _folder
from .registry import CONTENT, GENERATED, POEMS, TOKENS, generated, poems, query, sql_lines, tokens
from .style_queries import ELIGIBLE_WORDS, r6, tfidf_ctes
from .tables import table, written
from .text_queries import REPETITION, repetition


@query("SELECT count(*) FILTER (trim(author) <> '' AND trim(song_text, chr(10) || ' ') <> '') AS n_good, count(*) - count(*) FILTER (trim(author) <> '' AND trim(song_text, chr(10) || ' ') <> '') AS n_rejected FROM stripped_songs")
def s2_rejects(spark, d):
    path = _folder(spark)
    songs = table(spark, d, "stripped_songs").select("author", "song_title", "song_text")
    files.write_csv(songs, path)
    good, bad = files.read_csv_checked(spark, path, ["author", "song_title", "song_text"], ["author", "song_text"])
    return good.agg(F.count("*").alias("n_good")).join(bad.agg(F.count("*").alias("n_rejected")))


@query("SELECT max(length(text))::INT AS longest, count(*) AS n FROM documents WHERE text IS NOT NULL")
def s3_long_fields(spark, d):
    path = _folder(spark)
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    files.write_csv(docs.select("doc_id", F.concat(F.lit("|"), "text", F.lit("|")).alias("text")), path)
    return files.read_csv(spark, path, "doc_id bigint, text string").agg((F.max(F.length("text")) - 2).alias("longest"), F.count("*").alias("n"))


@query()
def s7_model_round_trip(spark, d):
    """Predictions of a classifier that was saved and loaded again."""
    train = R.eligible(poems(spark, d)).select("poem_id", "author", "text")
    path = _folder(spark)
    M.author_classifier(train).save(path)
    return M.predict(M.AuthorModel.load(spark, path), train).select("poem_id", "predicted")


@query("SELECT poem_id, author, song_title, split FROM poem_splits")
def s9_csv_overwrite(spark, d):
    path = _folder(spark)
    kept = ("author", "song_title", "split")
    for _ in range(2):
        files.write_csv(table(spark, d, "poem_splits").withColumns({c: F.concat(F.lit("|"), c, F.lit("|")) for c in kept}), path, single=True)
    back = files.read_csv(spark, path, "poem_id bigint, author string, song_title string, split string")
    return back.withColumns({c: F.regexp_replace(c, r"(?s)^\||\|$", "") for c in kept})


@query("SELECT sample_id, lang, text FROM lang_samples UNION ALL SELECT sample_id, lang, text FROM lang_samples")
def s10_append(spark, d):
    path = _folder(spark)
    for _ in range(2):
        files.append_rows(table(spark, d, "lang_samples"), path)
    return spark.read.parquet(path).select("sample_id", "lang", "text")


@query("SELECT item_id, task, split, lang, text FROM eval_items")
def s11_json_documents(spark, d):
    path = _folder(spark)
    files.write_json_documents(table(spark, d, "eval_items"), path, by="task")
    return spark.read.json(path).select("item_id", "task", "split", "lang", "text")


@query("SELECT run, poem_id, quality FROM scored_poems UNION ALL SELECT run, poem_id, quality FROM scored_poems")
def s12_json_lines_append(spark, d):
    path = _folder(spark)
    for _ in range(2):
        files.append_rows(table(spark, d, "scored_poems"), path, "json")
    return files.read_json_lines(spark, path, "run string, poem_id bigint, quality double")


@query("SELECT v.version, poem_id, author, song_title, split FROM poem_splits, (VALUES (1), (2)) v(version)")
def s13_versions(spark, d):
    root = _folder(spark)
    for v in ("1", "2"):
        files.write_versioned(table(spark, d, "poem_splits"), root, v)
    return spark.read.parquet(root).select("version", "poem_id", "author", "song_title", "split")


@query(f"WITH {GENERATED} SELECT example_id, 'Во стилот на ' || target_author || ':' AS prompt, generated_poem AS completion FROM examples WHERE generated_poem IS NOT NULL AND split = 'train'")
def s19_prompt_completion(spark, d):
    g = generated(spark, d).filter("generated_poem is not null and split = 'train'")
    return g.select("example_id", F.concat(F.lit("Во стилот на "), "target_author", F.lit(":")).alias("prompt"), F.col("generated_poem").alias("completion"))


@query(
    f"""{EDGES}, deg AS (SELECT src AS id, sum(weight)::BIGINT AS degree FROM links GROUP BY 1) SELECT 'node' AS kind, id AS a, NULL::VARCHAR AS b, CASE split_part(id, '|', 2) WHEN 'NOUN' THEN '#4c72b0' WHEN 'VERB' THEN '#c44e52' WHEN 'ADJ' THEN '#55a868' ELSE '#8172b2' END AS colour, round(10 + 40 * degree / (SELECT max(degree) FROM deg), 6)::DOUBLE AS size FROM deg
    UNION ALL SELECT 'edge', src, dst, '#999999', round(5.0::DOUBLE * weight / (SELECT max(weight) FROM edges), 6) FROM edges"""
)
def s16_graph_view(spark, d):
    """What a viewer draws: nodes with colour and size, edges with width."""
    e = cooc_edges(spark, d)
    nodes = GR.node_sizes(GR.weighted_degree(e), "degree", 10.0, 40.0)
    drawn = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), pos_colour(F.element_at(F.split("id", r"\|"), 2)).alias("colour"), r6("size").alias("size"))
    widths = GR.node_sizes(e.withColumnRenamed("weight", "w"), "w", 0.0, 5.0)
    return drawn.unionByName(widths.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("#999999").alias("colour"), r6("size").alias("size")))


@query("SELECT event_type, date_trunc('hour', ts) AS step, round(avg(value), 6) AS v FROM events GROUP BY 1, 2")
def s17_plot_points(spark, d):
    return steps(spark, d).withColumn("v", r6("v"))


@query("SELECT run, poem_id, clf_top1, judge_top1, line_uniqueness FROM scored_poems")
def proj_p1_scoring_columns(spark, d):
    return scored(spark, d).select("run", "poem_id", "clf_top1", "judge_top1", "line_uniqueness")


@query("SELECT example_id FROM synthetic_dataset WHERE source_author IS NOT NULL AND source_author <> target_author")
def proj_p10_no_self_transfer(spark, d):
    return table(spark, d, "synthetic_dataset").filter("source_author <> target_author").select("example_id")


@query(f"WITH texts AS (SELECT DISTINCT example_id, generated_poem AS text FROM synthetic_dataset WHERE generated_poem IS NOT NULL), {REPETITION} SELECT example_id FROM repetition WHERE d1 < 0.4::DOUBLE OR line_uniqueness < 0.8::DOUBLE")
def proj_p14_degenerate(spark, d):
    g = table(spark, d, "synthetic_dataset").filter("generated_poem is not null").select("example_id", F.col("generated_poem").alias("text")).distinct()
    return repetition(g).filter("d1 < 0.4 or line_uniqueness < 0.8").select("example_id")


@query(f"{POEMS}, n AS (SELECT poem_id, author, len({sql_lines('text')}) AS n FROM poems) SELECT poem_id, author, n::INT AS n_lines FROM n WHERE n BETWEEN 8 AND 30")
def proj_p17_length_band(spark, d):
    n = F.size(T.lines(F.col("text")))
    return poems(spark, d).filter(n.between(8, 30)).select("poem_id", "author", n.alias("n_lines"))


@query(f"{ELIGIBLE_WORDS}, {tfidf_ctes('author', 'word', True, 2, 0.85, 5)} SELECT author, word FROM best")
def proj_p19_first_words(spark, d):
    return S.top_n(best_words(spark, d), ["author"], [F.desc("weight"), F.col("word")], 5).select("author", "word")


@query(f"{TOKENS} SELECT line_no::INT AS line_no, tok_no::INT AS tok_no, word FROM tokens WHERE poem_id = (SELECT min(poem_id) FROM poems)")
def proj_p20_one_poem(spark, d):
    first = table(spark, d, "stripped_songs").filter("trim(author) <> '' and trim(song_text) <> ''").agg(F.min("poem_id")).head()[0]
    one = R.poems(table(spark, d, "stripped_songs").filter(F.col("poem_id") == first))
    return R.rule_tagged(R.token_table(R.line_table(one))).select("line_no", "tok_no", "word")


@query(f"{CONTENT} SELECT author, round(100.0 * count(*) FILTER (pos = 'NOUN') / count(*), 4)::DOUBLE AS noun, round(100.0 * count(*) FILTER (pos = 'VERB') / count(*), 4)::DOUBLE AS verb, round(100.0 * count(*) FILTER (pos = 'ADJ') / count(*), 4)::DOUBLE AS adj FROM content GROUP BY 1")
def a4_pos_percentages(spark, d):
    n = R.content(tokens(spark, d)).groupBy("author").pivot("pos", ["NOUN", "VERB", "ADJ", "ADV"]).count().fillna(0)
    total = F.col("NOUN") + F.col("VERB") + F.col("ADJ") + F.col("ADV")
    return n.select("author", *(F.round(100 * F.col(p) / total, 4).alias(p.lower()) for p in ("NOUN", "VERB", "ADJ")))


@query()
def a25_cross_validation(spark, d):
    """Accuracy and F1 of five folds of the author classifier."""
    busy = R.eligible(poems(spark, d), least=5).select("poem_id", "author", "text")
    return M.cross_validated(busy, "author", "poem_id")


@query("SELECT DISTINCT source_poem_id::VARCHAR AS id, row_number() OVER (ORDER BY source_poem_id) - 1 AS place FROM (SELECT DISTINCT source_poem_id FROM synthetic_dataset WHERE source_poem_id IS NOT NULL)")
def o4_numeric_order(spark, d):
    ids = table(spark, d, "synthetic_dataset").select(F.col("source_poem_id").cast("string").alias("id")).dropna().distinct()
    return R.dense_ids(ids.withColumn("number", F.col("id").cast("bigint")), ["number"], "place").select("id", F.col("place").cast("bigint").alias("place"))


@query("SELECT scope, lower(word) AS word, row_number() OVER (ORDER BY scope NULLS FIRST, lower(word) NULLS FIRST, rule_id) AS place FROM (SELECT DISTINCT rule_id, scope, word FROM pos_corrections)")
def o5_ordered_flags(spark, d):
    f = table(spark, d, "pos_corrections").select("rule_id", "scope", F.lower("word").alias("word")).distinct()
    return R.dense_ids(f, ["scope", "word", "rule_id"], "place").select("scope", "word", (F.col("place") + 1).cast("bigint").alias("place"))


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents WHERE n_chars > 500 LIMIT 20)")
def o13_early_stop(spark, d):
    return table(spark, d, "documents").filter("n_chars > 500").select("doc_id").limit(20).agg(F.count("*").alias("n"))


PAIR_WORDS = rf"""WITH {GENERATED}, w AS (SELECT example_id, list_distinct(regexp_extract_all(lower(generated_poem), '\p{{L}}+')) AS g, list_distinct(regexp_extract_all(lower(source_title), '\p{{L}}+')) AS t FROM examples WHERE generated_poem IS NOT NULL AND source_title IS NOT NULL)"""


@query(f"{PAIR_WORDS} SELECT example_id, len(list_intersect(g, t))::INT AS n_common, len(list_distinct(g || t))::INT AS n_union FROM w")
def x5_set_sizes(spark, d):
    g = generated(spark, d).filter("generated_poem is not null and source_title is not null")
    a, b = T.words(F.col("generated_poem")), T.words(F.col("source_title"))
    return g.select("example_id", F.size(F.array_intersect(a, b)).alias("n_common"), F.size(F.array_union(a, b)).alias("n_union"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '\p{L}+'))::INT AS letters, len(regexp_extract_all(lower(text), '[а-шѓќўџa-z]+'))::INT AS narrow, len(list_distinct([w for w in regexp_extract_all(lower(text), '\p{L}+') if length(w) >= 4]))::INT AS content_types FROM documents WHERE text IS NOT NULL""")
def t1_tokenizers(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(T.words(c)).alias("letters"), F.size(T.words(c, "[а-шѓќўџa-z]+")).alias("narrow"), F.size(T.content_types(c)).alias("content_types"))


@query(rf"""SELECT doc_id, len({sql_lines("text")})::INT AS n_lines, len({sql_lines("text")}) > 0 AS nonempty, {sql_lines("text")}[1] AS first_line FROM documents WHERE text IS NOT NULL""")
def t4_lines(spark, d):
    ls = T.lines(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(ls).alias("n_lines"), (F.size(ls) > 0).alias("nonempty"), F.get(ls, F.lit(0)).alias("first_line"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN len(ws) > 1 THEN len(list_distinct([ws[i] || ' ' || ws[i+1] for i in range(1, len(ws))])) / (len(ws) - 1) ELSE 0 END, 6)::DOUBLE AS distinct_2 FROM w""")
def t8_distinctness(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", r6(T.distinctness(T.words(F.col("text")), 2)).alias("distinct_2"))


@query(r"""SELECT doc_id AS probe, regexp_matches(text, '(?i)^\s*(here is|sure|еве|секако)') AS preamble, len([x for x in regexp_split_to_array(text, '\r\n|\n|\r') if regexp_replace(x, '[\s\x0B\x85\p{Z}]+', '', 'g') <> ''])::INT AS n_lines FROM documents WHERE text IS NOT NULL""")
def t17_infill_report(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    probes = docs.select(F.col("doc_id").alias("probe"), F.array().cast("array<string>").alias("frozen"), F.col("text").alias("answer"))
    return G.probe_report(probes).select("probe", "preamble", "n_lines")


@query("SELECT DISTINCT target_author, regexp_replace(regexp_replace(target_author, '[^\\p{L}\\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, printf('%s (%d)', target_author, sample_index) AS label FROM synthetic_dataset")
def t23_slugs_and_labels(spark, d):
    g = table(spark, d, "synthetic_dataset")
    return g.select("target_author", T.slug(F.col("target_author")).alias("slug"), F.format_string("%s (%d)", "target_author", "sample_index").alias("label")).distinct()


@query(f"SELECT example_id, h, {N.first_draw_sql('h', duck=True)} AS x FROM (SELECT example_id, {N.small_hash_sql('example_id', duck=True)} AS h FROM (SELECT DISTINCT example_id FROM synthetic_dataset))")
def t32_hashes_and_numbers(spark, d):
    """Small hashes of example ids and the first number drawn from each."""
    ids = table(spark, d, "synthetic_dataset").select("example_id").distinct()
    return ids.withColumn("h", F.expr(N.small_hash_sql("example_id"))).withColumn("x", F.expr(N.first_draw_sql("h")))


@query("SELECT word, regexp_matches(word, '(ски|ска|ско|цки|цка|цко)$') AS of_a_place, regexp_replace(lower(word), '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g') AS bare FROM (SELECT DISTINCT word FROM pos_corrections WHERE word IS NOT NULL)")
def t33_affixes(spark, d):
    w = table(spark, d, "pos_corrections").filter("word is not null").select("word").distinct()
    return w.select("word", T.has_suffix(F.col("word"), ("ски", "ска", "ско", "цки", "цка", "цко")).alias("of_a_place"), F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "").alias("bare"))


@query("SELECT run, poem_id, scored_at, round((clf_top1 + judge_top1) / 2 * 1.0 / 2.5 + line_uniqueness * 1.0 / 2.5 + coalesce(quality, 0) * 0.5 / 2.5, 6)::DOUBLE AS style FROM scored_poems WHERE clf_top1 IS NOT NULL AND judge_top1 IS NOT NULL")
def n15_style_composite(spark, d):
    s = scored(spark, d).filter("clf_top1 is not null and judge_top1 is not null")
    out = E.style_composite(s, {"pos": ["clf_top1", "judge_top1"], "line": ["line_uniqueness"], "words": ["quality"]})
    return out.select("run", "poem_id", "scored_at", r6("style").alias("style"))


@query(r"""SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿA-Za-z]')) > 0 THEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) / len(regexp_extract_all(text, '[Ѐ-ӿA-Za-z]')) ELSE 0 END * CASE WHEN regexp_matches(text, '(?m)\*\*|^#{1,6} |```') THEN 0 ELSE 1 END, 6)::DOUBLE AS gate_valid FROM documents WHERE text IS NOT NULL""")
def n16_gates(spark, d):
    c = F.col("text")
    docs = table(spark, d, "documents").filter(c.isNotNull())
    return E.gates(docs.select("doc_id", T.script_ratio(c).alias("cyrillic"), F.when(T.has_markup(c, chat_only=True), 0).otherwise(1).alias("no_chat"), F.when(F.size(T.lines(c)) > 0, 1).otherwise(0).alias("nonempty"), F.lit(1.0).alias("line_uniqueness"), F.lit(1.0).alias("novelty"))).select("doc_id", r6("gate_valid").alias("gate_valid"))


@query("WITH m AS (SELECT poem_id, run, max(quality) AS q FROM scored_poems WHERE quality IS NOT NULL GROUP BY 1, 2) SELECT a.poem_id, 'rescored' AS better, 'baseline' AS worse, a.q > b.q AS holds FROM m a JOIN m b USING (poem_id) WHERE a.run = 'rescored' AND b.run = 'baseline'")
def n23_expectations(spark, d):
    m = scored(spark, d).filter("quality is not null").groupBy("poem_id", "run").agg(F.max("quality").alias("q"))
    return E.expectations(m, "poem_id", "run", "q", [("rescored", "baseline")])


@query("SELECT lang, list_sort(list(DISTINCT doc_type))[1:2] AS first_types, coalesce(map_from_entries(list(DISTINCT (doc_type, length(doc_type))))['poem'], 0)::INT AS poem_length FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def m2_slices_and_lookups(spark, d):
    g = table(spark, d, "documents").filter("lang is not null").groupBy("lang").agg(F.sort_array(F.collect_set("doc_type")).alias("t"))
    lengths = F.map_from_arrays("t", F.transform("t", F.length))
    return g.select("lang", F.slice("t", 1, 2).alias("first_types"), F.coalesce(F.try_element_at(lengths, F.lit("poem")), F.lit(0)).alias("poem_length"))


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def m6_exploded(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))


@query("SELECT run, ['judge=' || printf('%.2f', avg(judge_top1)), 'unique=' || printf('%.2f', avg(line_uniqueness))] AS rounded FROM scored_poems GROUP BY 1")
def m7_rounded_tree(spark, d):
    m = scored(spark, d).groupBy("run").agg(F.create_map(F.lit("judge"), F.avg("judge_top1"), F.lit("unique"), F.avg("line_uniqueness")).alias("m"))
    rounded = F.transform_values("m", lambda _, v: F.format_string("%.2f", v))
    return m.select("run", F.transform(F.map_entries(rounded), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("rounded"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, [ws[i] || '>' || ws[i+1] for i in range(1, len(ws))] AS pairs FROM w WHERE len(ws) > 1""")
def m8_adjacent_pairs(spark, d):
    w = table(spark, d, "documents").filter("text is not null").select("doc_id", T.words(F.col("text")).alias("w")).filter("size(w) > 1")
    pairs = F.transform(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b")), lambda p: F.concat(p["a"], F.lit(">"), p["b"]))
    return w.select("doc_id", pairs.alias("pairs"))


@query("SELECT DISTINCT event_type, CASE WHEN event_type = 'click' THEN 2.0 ELSE 1.0 END::DOUBLE AS alpha, 3.0::DOUBLE AS power FROM events")
def m10_config_override(spark, d):
    default = F.create_map(F.lit("alpha"), F.lit(1.0), F.lit("power"), F.lit(3.0))
    own = F.when(F.col("event_type") == "click", F.create_map(F.lit("alpha"), F.lit(2.0))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    kept = F.map_filter(default, lambda k, _: ~F.map_contains_key(own, k))
    m = F.map_concat(kept, own)
    return table(spark, d, "events").select("event_type").distinct().select("event_type", m["alpha"].alias("alpha"), m["power"].alias("power"))


@query()
def k1_character_classifier(spark, d):
    """Author classifier over character n-grams, fitted on four folds of five: accuracy on the fifth."""
    p = R.eligible(poems(spark, d)).select("poem_id", "author", "text")
    folded = written(M.folds(p, "author", "poem_id").select("poem_id", "fold").join(p, "poem_id"))
    model = M.author_classifier(folded.filter("fold > 0").select("poem_id", "author", "text"), chars=True)
    held = M.predict(model, folded.filter("fold = 0").select("poem_id", "author", "text"))
    return held.agg(F.count("*").alias("n"), r6(F.avg((F.col("predicted") == F.col("author")).cast("double"))).alias("accuracy"))


@query(f"{TOKENS} SELECT pos, count(*) AS n, count(DISTINCT lemma) AS n_lemmas, count(DISTINCT feats) AS n_feats FROM tokens GROUP BY 1")
def k8_rule_tagger(spark, d):
    return tokens(spark, d).groupBy("pos").agg(F.count("*").alias("n"), F.countDistinct("lemma").alias("n_lemmas"), F.countDistinct("feats").alias("n_feats"))


@query("SELECT count(*) AS n FROM eval_items")
def l2_backends(spark, d):
    """Prompts answered by a backend that is registered by name."""
    G.register_backend("upper", lambda: str.upper)
    items = table(spark, d, "eval_items").select("item_id", "text")
    return G.complete(items, "item_id", "text", G.BACKENDS["upper"]()).filter("error is null").agg(F.count("text").alias("n"))


@query("SELECT event_type, date_trunc('hour', ts) AS step, round(avg(value) + 1e-9, 5)::DOUBLE AS v FROM events GROUP BY 1, 2")
def r3_stream_then_average(spark, d):
    s = streams.file_stream(spark, _events(spark, d), EVENT_SCHEMA, files=4)
    by = s.groupBy("event_type", F.date_trunc("hour", "ts").alias("step")).agg(F.avg("value").alias("v"))
    out = streams.run_to_end(by, f"r3_{uuid.uuid4().hex[:8]}", "complete")
    return out.select("event_type", F.col("step").cast("timestamp_ntz").alias("step"), F.round(F.col("v") + 1e-9, 5).alias("v"))


@query("SELECT 'big' AS kind, count(*) FILTER (value > 10) AS n FROM events UNION ALL SELECT 'all', count(*) FROM events")
def r4_one_batch_two_sinks(spark, d):
    """Each batch is scored once and goes to two tables."""
    root = _folder(spark)

    def both(df, number):
        once = df.withColumn("big", F.col("value") > 10).persist()
        once.filter("big").write.mode("append").parquet(f"{root}/big")
        once.write.mode("append").parquet(f"{root}/all")
        once.unpersist()

    s = streams.file_stream(spark, _events(spark, d), EVENT_SCHEMA, files=2)
    s.writeStream.foreachBatch(both).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    n = lambda k: spark.read.parquet(f"{root}/{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n("big").union(n("all"))
