"""Queries of sources and sinks, model calls, classifiers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stihora.functions import text as T
from stihora.operators import generation as G
from stihora.operators import ml as M
from stihora.operators import relations as R
from stihora.operators import stylometry as S
from stihora.operators import tfidf as I
from stihora.sources import files
from stihora.storage import shared_dir
from stihora.streaming import streams

from .join_queries import splits
from .registry import CONTENT, POEMS, generated, poems, query, tokens
from .style_queries import r6
from .tables import table


def _folder(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT poem_id, md5(song_text) AS digest FROM stripped_songs WHERE song_text IS NOT NULL")
def s1_csv_round_trip(spark, d):
    path = _folder(spark)
    files.write_csv(table(spark, d, "stripped_songs").filter("song_text is not null").select("poem_id", F.concat(F.lit("|"), "song_text", F.lit("|")).alias("song_text")), path)
    back = files.read_csv(spark, path, "poem_id bigint, song_text string")
    return back.select("poem_id", F.md5(F.expr("substring(song_text, 2, length(song_text) - 2)")).alias("digest"))


@query("SELECT lang, count(*) AS n FROM lang_samples GROUP BY 1")
def s5_json_lines(spark, d):
    path = _folder(spark)
    files.write_json_documents(table(spark, d, "lang_samples"), path)
    return files.read_json_lines(spark, path, "lang string").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT author, pos, lemma, n FROM (" + CONTENT + " SELECT author, pos, lemma, count(*) AS n FROM content GROUP BY ALL HAVING count(*) >= 10)")
def s4_nested_json(spark, d):
    v = S.vocabulary(R.content(tokens(spark, d))).filter("n >= 10")
    by_pos = v.groupBy("author", "pos").agg(F.map_from_entries(F.collect_list(F.struct("lemma", "n"))).alias("m"))
    by_author = by_pos.groupBy("author").agg(F.map_from_entries(F.collect_list(F.struct("pos", "m"))).alias("m"))
    path = _folder(spark)
    by_author.select(F.to_json(F.create_map("author", "m"))).write.text(path)
    nested = spark.read.text(path).select(F.from_json("value", "map<string, map<string, map<string, bigint>>>").alias("v"))
    return nested.select(F.explode("v").alias("author", "v")).select("author", F.explode("v").alias("pos", "v")).select("author", "pos", F.explode("v").alias("lemma", "n"))


@query("SELECT model AS run, count(*) AS n FROM synthetic_dataset WHERE model IS NOT NULL GROUP BY 1")
def s6_runs_by_file(spark, d):
    path = _folder(spark)
    g = table(spark, d, "synthetic_dataset").filter("model is not null").select("example_id", "model")
    g.withColumn("run", F.col("model")).write.partitionBy("run").option("header", True).csv(path)
    back = spark.read.option("header", True).schema("example_id string, model string").csv(f"{path}/*/*.csv")
    found = back.withColumn("run", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "run=([^/]+)/", 1)))
    return found.groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT split, count(*) AS n FROM synthetic_dataset WHERE split IN ('train', 'val', 'test') GROUP BY 1")
def s20_split_folders(spark, d):
    path = _folder(spark)
    files.write_by_split(table(spark, d, "synthetic_dataset").filter("split in ('train', 'val', 'test')").select("example_id", "split"), path, ("train", "val", "test"))
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT example_id, replace(replace(replace(replace(replace(to_json({'t': generated_poem}), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029') AS safe FROM (SELECT DISTINCT example_id, generated_poem FROM synthetic_dataset WHERE generated_poem IS NOT NULL)")
def s15_script_safe(spark, d):
    g = table(spark, d, "synthetic_dataset").filter("generated_poem is not null").select("example_id", "generated_poem").distinct()
    return g.select("example_id", T.script_safe(F.to_json(F.struct(F.col("generated_poem").alias("t")))).alias("safe"))


@query("SELECT DISTINCT example_id, 'Преведи: ' || generated_poem AS text FROM synthetic_dataset WHERE generated_poem IS NOT NULL")
def l1_completions(spark, d):
    """Answers of the echoing client, which stands in for a model."""
    g = generated(spark, d).filter("generated_poem is not null").select("example_id", F.concat(F.lit("Преведи: "), "generated_poem").alias("prompt"))
    return G.complete(g, "example_id", "prompt", G.BACKENDS["echo"], lazy=True).filter("error is null").select("example_id", "text")


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_texts FROM documents WHERE text IS NOT NULL")
def l4_cached_completions(spark, d):
    path = _folder(spark)
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("text").alias("prompt"))
    once = G.cached_completions(docs, "prompt", path, lambda p: p, "echo")
    again = G.cached_completions(once.drop("text", "cache_key"), "prompt", path, lambda p: p, "echo")
    return again.agg(F.count("text").alias("n"), F.countDistinct("text").alias("n_texts"))


@query("SELECT count(*) FILTER (length(text) <= 200) AS n_ok, count(*) FILTER (length(text) > 200) AS n_errors FROM documents WHERE text IS NOT NULL")
def l8_errors_as_rows(spark, d):
    def refuse(prompt: str) -> str:
        if len(prompt) > 200:
            raise ValueError("too long")
        return prompt

    out = G.complete(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", refuse)
    return out.agg(F.count("text").alias("n_ok"), F.count("error").alias("n_errors"))


@query()
def l5_prompts(spark, d):
    """Prompts from keywords of the poem and style of the target."""
    best = S.top_n(I.tfidf(R.content(tokens(spark, d)).select("poem_id", "lemma"), "poem_id", "lemma"), ["poem_id"], [F.round("weight", 9).desc(), F.col("lemma")], 5)
    n = R.content(tokens(spark, d)).groupBy("author", "lemma").agg(F.count("*").alias("n"))
    top = poems(spark, d).groupBy("author").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "author").limit(3)
    words = S.top_n(n.join(F.broadcast(top), "author"), ["author"], [F.desc("n"), F.col("lemma")], 10).groupBy(F.col("author").alias("target")).agg(F.array_join(F.sort_array(F.collect_list("lemma")), ", ").alias("palette"))
    return G.assembled_prompts(poems(spark, d), best, words.withColumn("description", F.lit("кратки редови")))


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws, ['река', 'песна', 'the', 'ноќ'] AS frozen FROM documents WHERE text IS NOT NULL) SELECT doc_id AS probe, len(list_intersect(frozen, ws)) / 4.0::DOUBLE AS kept, len(regexp_extract_all(text, '\[MASK\]|\[[^\]]*\]'))::INT AS markers_left FROM w""")
def l6_probe_report(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    probes = docs.select(F.col("doc_id").alias("probe"), F.array(*map(F.lit, ("река", "песна", "the", "ноќ"))).alias("frozen"), F.col("text").alias("answer"))
    return G.probe_report(probes).select("probe", "kept", "markers_left")


@query(r"SELECT str_split(module, '.')[-1] AS component, count(*) AS n FROM (SELECT DISTINCT replace(log_path, '/', '.') AS module FROM synthetic_dataset WHERE log_path IS NOT NULL) WHERE regexp_full_match(module, '.*_[0-2]\.json') GROUP BY 1")
def k10_matching_targets(spark, d):
    """Parts of dotted names that a full pattern matches; the names are those of log files."""
    modules = table(spark, d, "synthetic_dataset").select(F.replace("log_path", F.lit("/"), F.lit(".")).alias("module")).dropna().distinct()
    return G.matching_targets(modules, pattern=r".*_[0-2]\.json")


@query("SELECT poem_id, author, ((row_number() OVER (PARTITION BY author ORDER BY md5('42|' || poem_id::VARCHAR), poem_id) - 1) % 5)::INT AS fold FROM (" + POEMS + " SELECT poem_id, author FROM poems)")
def k2_folds(spark, d):
    return M.folds(poems(spark, d).select("poem_id", "author"), "author", "poem_id")


@query()
def k3_author_judge(spark, d):
    """Held-out accuracy of the author classifier fitted on the train split."""
    p = R.eligible(poems(spark, d)).join(splits(spark, d), "poem_id")
    model = M.author_classifier(R.eligible(p.filter("split = 'train'")).select("poem_id", "author", "text"))
    return M.held_out_accuracy(model, p.filter("split <> 'train'").select("poem_id", "author", "text")).withColumn("accuracy", r6("accuracy"))


@query()
def k4_author_predictions(spark, d):
    """Predicted author of each generated poem and the probability of its target."""
    train = R.eligible(poems(spark, d)).select("poem_id", "author", "text")
    model = M.author_classifier(train)
    g = generated(spark, d).select("example_id", "target_author", F.col("generated_poem").alias("text"))
    return M.predict(model, g, "target_author").select("example_id", "predicted", r6("top_probability").alias("top_probability"), r6("target_probability").alias("target_probability"))


@query()
def k7_embeddings(spark, d):
    """Vectors of all different lines."""
    return M.embed(R.line_table(poems(spark, d)), "line")


def _events(spark, d):
    path = _folder(spark)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").write.parquet(path)
    return path


EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def r2_log_means(spark, d):
    s = streams.file_stream(spark, _events(spark, d), EVENT_SCHEMA, files=2)
    return streams.run_to_end(streams.step_means(s, "event_type", "value"), f"r2_{uuid.uuid4().hex[:8]}", "complete").withColumn("mean", r6("mean"))


@query("SELECT event_id FROM events")
def r1_resumable(spark, d):
    root = _folder(spark)
    source = _events(spark, d)
    for _ in range(2):  # the second run finds everything done
        s = streams.file_stream(spark, source, EVENT_SCHEMA, files=4)
        streams.resumable(s, ["event_id"], lambda df: df.select("event_id", F.lit(None).cast("string").alias("error")), f"{root}/done", f"{root}/errors", f"{root}/{uuid.uuid4().hex}").awaitTermination()
    return spark.read.parquet(f"{root}/done")


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r6_tumbling_windows(spark, d):
    s = streams.file_stream(spark, _events(spark, d), EVENT_SCHEMA, files=4)
    out = streams.run_to_end(streams.windowed(s, "ts", "1 hour", late="40 days", by=("event_type",)), f"r6_{uuid.uuid4().hex[:8]}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def r5_least_used_stream(spark, d):
    """Candidates chosen by a stream that remembers what each poem used."""
    path = _folder(spark)
    t = R.content(tokens(spark, d))
    t.select("poem_id", (F.col("line_no") * 1000 + F.col("tok_no")).cast("int").alias("place"), F.array("lemma", F.lit("тивко"), F.lit("рано")).alias("candidates")).write.parquet(path)
    s = streams.file_stream(spark, path, "poem_id bigint, place int, candidates array<string>", files=100)
    return streams.run_to_files(streams.least_used_stream(s, "poem_id"), _folder(spark))


@query(
    """SELECT l.event_id, l.user_id, r.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'view') l LEFT JOIN LATERAL (SELECT value FROM events e WHERE e.event_type = 'click' AND e.user_id = l.user_id AND e.ts <= l.ts ORDER BY e.ts DESC LIMIT 1) r ON true"""
)
def r6_as_of(spark, d):
    e = table(spark, d, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_click"))
    return streams.as_of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "last_click").select("event_id", "user_id", "last_click")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def r6_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
