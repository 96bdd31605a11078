"""Queries of run comparison, rewards, ratings and numeric steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stihora.functions import numeric as N
from stihora.functions import text as T
from stihora.operators import evaluation as E
from stihora.operators import joins as J
from stihora.operators import relations as R
from stihora.operators import stylometry as S

from .join_queries import SPLITS, _lines, splits
from .registry import CONTENT, GENERATED, POEMS, TOKENS, generated, poems, query, sql_lines, tokens
from .style_queries import A5_SQL, BIGRAMS, r6
from .tables import table
from .text_queries import PAIRED, REPETITION, paired, repetition

METRICS = ["clf_top1", "judge_top1", "line_uniqueness", "quality"]
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)


def scored(spark, d):
    return table(spark, d, "scored_poems")


@query(f"SELECT run, count(*) AS n, {MEANS} FROM scored_poems GROUP BY 1")
def a11_run_means(spark, d):
    return E.run_means(scored(spark, d), "run", METRICS).withColumns({m: r6(m) for m in METRICS})


@query(
    f"""WITH w AS (SELECT * FROM scored_poems WHERE run IN ('baseline', 'rescored')), k AS (SELECT poem_id FROM w GROUP BY 1 HAVING count(DISTINCT run) = 2)
    SELECT run, 'all' AS view, count(*) AS n, {MEANS} FROM scored_poems GROUP BY 1 UNION ALL SELECT run, 'paired', count(*), {MEANS.replace(' AS ', ' AS ')} FROM w WHERE poem_id IN (SELECT poem_id FROM k) GROUP BY 1"""
)
def a12_two_views(spark, d):
    return E.two_views(scored(spark, d), "run", ["poem_id"], METRICS, ["baseline", "rescored"]).withColumns({m: r6(m) for m in METRICS})


@query(
    """WITH s AS (SELECT s.*, p.author AS target FROM scored_poems s JOIN (SELECT poem_id, min(author) AS author FROM stripped_songs GROUP BY 1) p USING (poem_id)), size AS (SELECT run, count(*) AS size FROM s GROUP BY 1),
    taken AS (SELECT run, clf_predicted AS target, count(*) AS taken FROM s GROUP BY 1, 2)
    SELECT target, run, count(*) AS n, round(avg(clf_top1), 6) AS clf_top1, round(coalesce(any_value(taken), 0) / any_value(size), 6) AS share_predicted FROM s JOIN size USING (run) LEFT JOIN taken USING (run, target) GROUP BY 1, 2"""
)
def a13_identification(spark, d):
    target = table(spark, d, "stripped_songs").groupBy("poem_id").agg(F.min("author").alias("target"))
    s = scored(spark, d).join(target, "poem_id")
    # a null target takes no part in the share, as in any join
    out = E.identification(s, "target", "clf_predicted", "run", ["clf_top1"])
    return out.withColumns({"clf_top1": r6("clf_top1"), "share_predicted": r6("share_predicted")})


@query("SELECT s.run, s.poem_id, CASE WHEN t.poem_id IS NULL THEN judge_top1 END AS judge_top1 FROM (SELECT DISTINCT run, poem_id, judge_top1 FROM scored_poems) s LEFT JOIN (SELECT DISTINCT poem_id FROM poem_splits WHERE trim(lower(split)) = 'train') t USING (poem_id)")
def proj_p21_masked_labels(spark, d):
    train = splits(spark, d).filter("split = 'train'").select("poem_id", F.lit(True).alias("train"))
    s = scored(spark, d).select("run", "poem_id", "judge_top1").distinct().join(train, "poem_id", "left")
    return E.masked(s, F.col("train").isNotNull(), "judge_top1").select("run", "poem_id", "judge_top1")


@query(
    f"""{POEMS}, {SPLITS}, {A5_SQL}, f AS (SELECT author, tokens / lines AS tokens_per_line, lines::DOUBLE AS lines, stanzas::DOUBLE AS stanzas FROM a5 JOIN splits USING (poem_id) WHERE split = 'train'),
    l AS (UNPIVOT f ON tokens_per_line, lines, stanzas INTO NAME feature VALUE value), c AS (SELECT feature, stddev_pop(value) AS corpus_std FROM l GROUP BY 1)
    SELECT author, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(any_value(corpus_std), 6) AS corpus_std FROM l JOIN c USING (feature) GROUP BY 1, 2"""
)
def a14_calibration(spark, d):
    train = splits(spark, d).filter("split = 'train'").select("poem_id")
    f = S.line_stats(poems(spark, d)).join(train, "poem_id").select("author", (F.col("tokens") / F.col("lines")).alias("tokens_per_line"), F.col("lines").cast("double").alias("lines"), F.col("stanzas").cast("double").alias("stanzas"))
    return E.calibration(f, "author", ["tokens_per_line", "lines", "stanzas"]).withColumns({c: r6(c) for c in ("mean", "std", "corpus_std")})


@query("SELECT source, round(greatest(quantile_cont(n_chars, 0.9), 20), 6)::DOUBLE AS p FROM documents GROUP BY 1")
def a15_percentile(spark, d):
    return E.hit_percentile(table(spark, d, "documents"), "source", "n_chars", 0.9, 20.0).withColumn("p", r6("p"))


@query(
    f"""{CONTENT}, {BIGRAMS}, b AS (SELECT author, poem_id, pos || '>' || next_pos AS item, count(*) AS n FROM bigrams GROUP BY ALL), t AS (SELECT author, item, sum(n) AS total FROM b GROUP BY 1, 2),
    r AS (SELECT b.author, p.poem_id, b.item, b.n FROM b JOIN (SELECT DISTINCT author, poem_id FROM b) p ON p.author = b.author AND p.poem_id <> b.poem_id), rest AS (SELECT author, poem_id, item, sum(n) AS m FROM r GROUP BY ALL),
    len AS (SELECT author, poem_id, sum(m * m) AS sq FROM rest GROUP BY 1, 2), own AS (SELECT author, poem_id, sum(n * n) AS sq FROM b GROUP BY 1, 2), dot AS (SELECT b.author, b.poem_id, sum(b.n * rest.m) AS x FROM b JOIN rest USING (author, poem_id, item) GROUP BY 1, 2)
    SELECT own.author, own.poem_id, round(coalesce(x / (sqrt(own.sq) * sqrt(len.sq)), 0), 6)::DOUBLE AS cosine FROM own LEFT JOIN len USING (author, poem_id) LEFT JOIN dot USING (author, poem_id)"""
)
def a16_leave_one_out(spark, d):
    b = S.pos_bigrams(R.content(tokens(spark, d))).groupBy("author", "poem_id", F.concat_ws(">", "pos", "next_pos").alias("item")).agg(F.count("*").alias("n"))
    return E.leave_one_out(b, "author", "poem_id", "item").withColumn("cosine", r6("cosine"))


@query(
    """WITH s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL)
    SELECT any_value(n) AS n, max(v) AS largest, max(v) FILTER (i = least(n - 1, floor(0.5::DOUBLE * n))) AS p50, max(v) FILTER (i = least(n - 1, floor(0.95::DOUBLE * n))) AS p95, max(v) FILTER (i = least(n - 1, floor(0.99::DOUBLE * n))) AS p99,
    count(*) FILTER (v > 512) AS over_512, count(*) FILTER (v > 2048) AS over_2048 FROM s"""
)
def a17_length_summary(spark, d):
    return E.nearest_rank(table(spark, d, "documents"), "n_chars", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, {"over_512": 512, "over_2048": 2048})


@query("WITH b AS (SELECT run, avg(line_uniqueness) AS m, stddev_pop(line_uniqueness) AS s FROM scored_poems GROUP BY 1) SELECT round((SELECT avg(line_uniqueness) FROM scored_poems), 6) AS mean, round(avg(s), 6) AS within_std, round(stddev_pop(m), 6) AS between_std FROM b")
def a18_spread(spark, d):
    return E.spread(scored(spark, d), "run", "line_uniqueness").withColumns({c: r6(c) for c in ("mean", "within_std", "between_std")})


@query(
    """WITH u AS (SELECT poem_id, list(quality) AS xs FROM scored_poems WHERE quality IS NOT NULL GROUP BY 1 HAVING count(*) > 1), v AS (SELECT poem_id, unnest(xs) AS x, len(xs) AS m FROM u),
    o AS (SELECT sum((a.x - b.x) * (a.x - b.x) / (a.m - 1)) AS s FROM v a JOIN v b USING (poem_id)), e AS (SELECT sum((a.x - b.x) * (a.x - b.x)) AS s FROM v a, v b), n AS (SELECT count(*) AS n FROM v)
    SELECT (SELECT count(*) FROM u) AS n_units, round(1 - (o.s / n.n) / (e.s / (n.n * (n.n - 1))), 5)::DOUBLE AS alpha FROM o, e, n"""
)
def a19_alpha(spark, d):
    return E.interval_alpha(scored(spark, d), "poem_id", "quality").withColumn("alpha", F.round("alpha", 5))


@query()
def a20_bootstrap(spark, d):
    """Interval of the mean quality from 200 resamples."""
    return E.bootstrap_interval(scored(spark, d), "quality")


@query("WITH i AS (SELECT run, poem_id, clf_predicted, avg(quality) AS m FROM scored_poems GROUP BY ALL) SELECT run, clf_predicted, count(*) AS n_items, round(avg(m) + 1e-9, 6)::DOUBLE AS mean FROM i GROUP BY 1, 2")
def a21_two_level_means(spark, d):
    return E.two_level_means(scored(spark, d), "run", "poem_id", "clf_predicted", "quality").withColumn("mean", r6(F.col("mean") + 1e-9))


@query("WITH e AS (SELECT poem_id, run, count(*) AS size, min(scored_at) AS first FROM scored_poems GROUP BY 1, 2) SELECT poem_id, run, size FROM e QUALIFY row_number() OVER (PARTITION BY poem_id ORDER BY size DESC, first, run) = 1")
def a22_largest_export(spark, d):
    e = scored(spark, d).groupBy("poem_id", "run").agg(F.count("*").alias("size"), F.min("scored_at").alias("first"))
    return E.largest_export(e.withColumn("order", F.struct("first", "run")), ["poem_id"], "size", "order").select("poem_id", "run", "size")


@query("SELECT date_trunc('hour', ts) AS step, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a23_step_means(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("step")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM events GROUP BY 1")
def a24_tier_shares(spark, d):
    return E.tier_shares(table(spark, d, "events"), "event_type").withColumn("share", r6("share"))


STEPS = "WITH s AS (SELECT event_type, date_trunc('hour', ts) AS step, avg(value) AS v FROM events GROUP BY 1, 2)"


def steps(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("step")).agg(F.avg("value").alias("v"))


@query(f"{STEPS} SELECT event_type, step, round(CASE WHEN count(*) OVER w >= 10 THEN avg(v) OVER w END, 6) AS rolling FROM s WINDOW w AS (PARTITION BY event_type ORDER BY step ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)")
def w7_rolling_mean(spark, d):
    w = Window.partitionBy("event_type").orderBy("step").rowsBetween(-24, 0)
    return steps(spark, d).select("event_type", "step", r6(F.when(F.count("v").over(w) >= 10, F.avg("v").over(w))).alias("rolling"))


@query(
    f"""{STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) AS a, row_number() OVER (PARTITION BY event_type ORDER BY step DESC) AS b FROM s)
    SELECT event_type, round(avg(v) FILTER (a <= 50), 6) AS first_mean, round(avg(v) FILTER (b <= 50), 6) AS last_mean FROM r GROUP BY 1"""
)
def w8_first_and_last(spark, d):
    w = Window.partitionBy("event_type")
    r = steps(spark, d).withColumns({"a": F.row_number().over(w.orderBy("step")), "b": F.row_number().over(w.orderBy(F.desc("step")))})
    return r.groupBy("event_type").agg(r6(F.avg(F.when(F.col("a") <= 50, F.col("v")))).alias("first_mean"), r6(F.avg(F.when(F.col("b") <= 50, F.col("v")))).alias("last_mean"))


@query("WITH m AS (SELECT run, poem_id, avg(quality) AS q FROM scored_poems GROUP BY 1, 2) SELECT count(*) AS n, round(avg(b.q - a.q), 6) AS mean_difference FROM m a JOIN m b USING (poem_id) WHERE a.run = 'baseline' AND b.run = 'rescored' AND a.q IS NOT NULL AND b.q IS NOT NULL")
def w14_paired_difference(spark, d):
    m = scored(spark, d).groupBy("run", "poem_id").agg(F.avg("quality").alias("q")).filter("q is not null")
    a, b = m.filter("run = 'baseline'").select("poem_id", F.col("q").alias("a")), m.filter("run = 'rescored'").select("poem_id", F.col("q").alias("b"))
    return a.join(b, "poem_id").agg(F.count("*").alias("n"), r6(F.avg(F.col("b") - F.col("a"))).alias("mean_difference"))


N10_SQL = f"""{PAIRED}, t AS (SELECT example_id, {sql_lines('gen')} AS gl, {sql_lines('src')} AS sl FROM paired),
n AS (SELECT example_id, len(gl) AS g_lines, len(sl) AS s_lines, CASE WHEN len(gl) > 0 THEN list_sum([len(regexp_extract_all(x, '{T.NON_SPACE}')) for x in gl]) / len(gl) ELSE 0 END AS g_tpl, CASE WHEN len(sl) > 0 THEN list_sum([len(regexp_extract_all(x, '{T.NON_SPACE}')) for x in sl]) / len(sl) ELSE 0 END AS s_tpl FROM t)"""


def structure(spark, d):
    def measure(c):
        ls = T.lines(F.col(c))
        return F.size(ls), N.share(F.aggregate(ls, F.lit(0), lambda s, x: s + F.size(T.whitespace_tokens(x))), F.size(ls))

    (gl, gt), (sl, st) = measure("gen"), measure("src")
    return paired(spark, d).select("example_id", gl.alias("g_lines"), sl.alias("s_lines"), gt.alias("g_tpl"), st.alias("s_tpl"))


@query(f"{N10_SQL} SELECT example_id, g_lines - s_lines AS delta_lines, round(g_tpl - s_tpl, 6)::DOUBLE AS delta_tokens_per_line FROM n")
def n10_structure_deltas(spark, d):
    return structure(spark, d).select("example_id", (F.col("g_lines") - F.col("s_lines")).cast("bigint").alias("delta_lines"), r6(F.col("g_tpl") - F.col("s_tpl")).alias("delta_tokens_per_line"))


@query(f"{N10_SQL} SELECT example_id, round((1 / (1 + abs(g_lines - s_lines) / greatest(s_lines, 4)) + 1 / (1 + abs(g_tpl - s_tpl) / greatest(s_tpl, 1))) / 2, 6)::DOUBLE AS fit FROM n")
def n11_structure_fit(spark, d):
    s = structure(spark, d)
    fits = N.fit(F.col("g_lines") - F.col("s_lines"), F.col("s_lines"), 4.0) + N.fit(F.col("g_tpl") - F.col("s_tpl"), F.col("s_tpl"), 1.0)
    return s.select("example_id", r6(fits / 2).alias("fit"))


@query(
    """WITH c AS (SELECT clf_predicted, avg(line_uniqueness) AS m, stddev_pop(line_uniqueness) AS s FROM scored_poems GROUP BY 1), o AS (SELECT stddev_pop(line_uniqueness) AS os FROM scored_poems)
    SELECT run, poem_id, scored_at, round(exp(-power((line_uniqueness - m) / greatest(s, 0.5 * os, 1e-6), 2) / 2), 6) AS gaussian, round(CASE WHEN line_uniqueness >= m THEN 1 ELSE exp(-power((line_uniqueness - m) / greatest(s, 1e-6), 2) / 2) END, 6)::DOUBLE AS one_sided,
    round(least(greatest((line_uniqueness - 0.5) / 0.5, 0), 1), 6)::DOUBLE AS rescaled FROM scored_poems JOIN c USING (clf_predicted), o"""
)
def n12_scores(spark, d):
    s = scored(spark, d)
    c = s.groupBy("clf_predicted").agg(F.avg("line_uniqueness").alias("m"), F.stddev_pop("line_uniqueness").alias("s"))
    o = s.agg(F.stddev_pop("line_uniqueness").alias("os"))
    x = F.col("line_uniqueness")
    return s.join(c, "clf_predicted").join(F.broadcast(o)).select(
        "run", "poem_id", "scored_at", r6(N.gaussian_score(x, F.col("m"), F.col("s"), F.col("os"))).alias("gaussian"), r6(N.one_sided_score(x, F.col("m"), F.col("s"))).alias("one_sided"), r6(N.rescaled(x, 0.5)).alias("rescaled"),
    )


N17_SQL = rf"""{PAIRED}, texts AS (SELECT example_id, gen AS text, src FROM paired), {REPETITION},
copied AS (SELECT example_id, src, [array_to_string(regexp_extract_all(lower(x), '\p{{L}}+'), ' ') for x in {sql_lines('src')}] AS sl FROM paired),
m AS (SELECT r.example_id, CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿA-Za-z]')) > 0 THEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) / len(regexp_extract_all(text, '[Ѐ-ӿA-Za-z]')) ELSE 0 END AS cyrillic,
  CASE WHEN regexp_matches(text, '(?m)\*\*|^#{{1,6}} |```') THEN 0 ELSE 1 END AS no_chat, CASE WHEN len(ls) > 0 THEN 1 ELSE 0 END AS nonempty, line_uniqueness, d1,
  CASE WHEN len(ls) > 0 THEN len([x for x in ls if NOT list_contains(sl, array_to_string(regexp_extract_all(lower(x), '\p{{L}}+'), ' '))]) / len(ls) ELSE 0 END AS novelty FROM repetition r JOIN copied USING (example_id))"""


@query(f"{N17_SQL} SELECT example_id, round(cyrillic * no_chat * nonempty, 6)::DOUBLE AS valid, round(cyrillic * no_chat * nonempty * line_uniqueness * d1, 6)::DOUBLE AS reward_style, round(cyrillic * no_chat * nonempty * (line_uniqueness * d1 + power(novelty, 3) * d1), 6)::DOUBLE AS reward FROM m")
def n17_reward(spark, d):
    p = repetition(paired(spark, d).withColumnRenamed("gen", "text"))
    ls, sl = F.transform(T.lines(F.col("text")), T.normalized_line), F.transform(T.lines(F.col("src")), T.normalized_line)
    m = p.select(
        "example_id", T.script_ratio(F.col("text")).alias("cyrillic"), F.when(T.has_markup(F.col("text"), chat_only=True), 0).otherwise(1).alias("no_chat"), F.when(F.size(ls) > 0, 1).otherwise(0).alias("nonempty"),
        "line_uniqueness", N.share(F.size(F.filter(ls, lambda x: ~F.array_contains(sl, x))), F.size(ls)).alias("novelty"), F.col("d1").alias("style"), F.col("d1").alias("content"),
    )
    return E.reward(m).select("example_id", r6("valid").alias("valid"), r6("reward_style").alias("reward_style"), r6("reward").alias("reward"))


@query(
    """SELECT rule_id, list_filter([CASE WHEN word IS NULL OR trim(word) = '' THEN 'no_word' END, CASE WHEN pos IS NULL THEN 'no_pos' END, CASE WHEN scope = 'poem' AND poem_id IS NULL THEN 'no_poem' END, CASE WHEN correction IS NULL AND lemma_fix IS NULL THEN 'no_effect' END], lambda x: x IS NOT NULL) AS errors
    FROM (SELECT DISTINCT rule_id, word, pos, scope, poem_id, correction, lemma_fix FROM pos_corrections)"""
)
def proj_p16_validation(spark, d):
    rules = {
        "no_word": F.col("word").isNull() | (F.trim("word") == ""), "no_pos": F.col("pos").isNull(), "no_poem": (F.col("scope") == "poem") & F.col("poem_id").isNull(),
        "no_effect": F.col("correction").isNull() & F.col("lemma_fix").isNull(),
    }
    c = table(spark, d, "pos_corrections").select("rule_id", "word", "pos", "scope", "poem_id", "correction", "lemma_fix").distinct()
    return E.errors_of(c, rules).select("rule_id", "errors")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.NON_SPACE}'))::BIGINT AS n_tokens FROM documents WHERE len(regexp_extract_all(text, '{T.NON_SPACE}')) <= 100")
def proj_p15_token_budget(spark, d):
    n = F.size(T.whitespace_tokens(F.col("text")))
    return E.within_budget(table(spark, d, "documents").filter("text is not null"), n, 100).select("doc_id", n.cast("bigint").alias("n_tokens"))


@query(f"SELECT max(n)::INT AS longest, min(x)::INT AS \"limit\" FROM (SELECT max(len(regexp_extract_all(text, '{T.NON_SPACE}'))) AS n FROM documents) LEFT JOIN (VALUES (256), (512), (1024), (2048), (4096)) v(x) ON x >= n")
def n22_smallest_limit(spark, d):
    lengths = table(spark, d, "documents").select(F.size(T.whitespace_tokens(F.col("text"))).alias("n"))
    return E.smallest_fitting(lengths, "n", [256, 512, 1024, 2048, 4096])


@query("WITH a AS (SELECT poem_id, avg(clf_top1) AS x, avg(judge_top1) AS y FROM scored_poems GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (abs(x - y) <= 0.01) AS n_equal, round(max(abs(x - y)), 6) AS largest FROM a")
def n21_tolerance(spark, d):
    a = scored(spark, d).groupBy("poem_id").agg(F.avg("clf_top1").alias("x"), F.avg("judge_top1").alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    return a.agg(F.count("*").alias("n"), F.count_if(gap <= 0.01).alias("n_equal"), r6(F.max(gap)).alias("largest"))


@query(
    f"""{TOKENS}, pal AS (SELECT author, list(word) AS ws FROM (SELECT author, word, count(*) AS n FROM tokens WHERE pos = 'NOUN' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, word) <= 20) GROUP BY 1),
    own AS (SELECT poem_id, author, list(DISTINCT word) AS ws FROM tokens GROUP BY 1, 2) SELECT poem_id, round(len(list_intersect(pal.ws, own.ws)) / len(pal.ws), 6)::DOUBLE AS hit_rate FROM own JOIN pal USING (author)"""
)
def n25_palette_hits(spark, d):
    t = tokens(spark, d)
    n = t.filter("pos = 'NOUN'").groupBy("author", "word").agg(F.count("*").alias("n"))
    palette = S.top_n(n, ["author"], [F.desc("n"), F.col("word")], 20).groupBy("author").agg(F.collect_list("word").alias("palette"))
    own = t.groupBy("poem_id", "author").agg(F.collect_set("word").alias("own"))
    return own.join(palette, "author").select("poem_id", r6(N.share(F.size(F.array_intersect("palette", "own")), F.size("palette"))).alias("hit_rate"))


@query(
    f"""{N17_SQL}, r AS (SELECT example_id, text, n_tokens, d1, d2, line_uniqueness, max_line_repeats FROM repetition) SELECT example_id, n_tokens, round(r.d1, 6)::DOUBLE AS d1, round(r.d2, 6)::DOUBLE AS d2, round(r.line_uniqueness, 6)::DOUBLE AS line_uniqueness, max_line_repeats, round(novelty, 6)::DOUBLE AS novelty, round(cyrillic, 6)::DOUBLE AS cyrillic FROM r JOIN m USING (example_id)"""
)
def n24_all_metrics(spark, d):
    p = repetition(paired(spark, d).withColumnRenamed("gen", "text"))
    ls, sl = F.transform(T.lines(F.col("text")), T.normalized_line), F.transform(T.lines(F.col("src")), T.normalized_line)
    return p.select(
        "example_id", "n_tokens", r6("d1").alias("d1"), r6("d2").alias("d2"), r6("line_uniqueness").alias("line_uniqueness"), "max_line_repeats",
        r6(N.share(F.size(F.filter(ls, lambda x: ~F.array_contains(sl, x))), F.size(ls))).alias("novelty"), r6(T.script_ratio(F.col("text"))).alias("cyrillic"),
    )


@query(
    """SELECT run, metric, printf('%.3f', value) AS shown FROM (UNPIVOT (SELECT run, avg(clf_top1) AS clf_top1, avg(judge_top1) AS judge_top1, avg(line_uniqueness) AS line_uniqueness FROM scored_poems GROUP BY 1) ON clf_top1, judge_top1, line_uniqueness INTO NAME metric VALUE value)"""
)
def s18_comparison_table(spark, d):
    wide = E.run_means(scored(spark, d), "run", ["clf_top1", "judge_top1", "line_uniqueness"]).drop("n")
    return wide.unpivot(["run"], ["clf_top1", "judge_top1", "line_uniqueness"], "metric", "value").select("run", "metric", F.coalesce(F.format_string("%.3f", "value"), F.lit("--")).alias("shown"))


@query(
    f"""WITH {GENERATED} SELECT example_id, ['system', 'user', 'assistant'] AS roles, ['Пиши стихови.', 'Во стилот на ' || target_author, generated_poem] AS contents FROM examples WHERE generated_poem IS NOT NULL AND split = 'train'"""
)
def m9_chat_messages(spark, d):
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    g = generated(spark, d).filter("generated_poem is not null and split = 'train'")
    return g.select("example_id", F.array(said("system", F.lit("Пиши стихови.")), said("user", F.concat(F.lit("Во стилот на "), "target_author")), said("assistant", F.col("generated_poem"))).alias("messages")).select("example_id", F.col("messages.role").alias("roles"), F.col("messages.content").alias("contents"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def m5_json_attributes(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("SELECT doc_type, array_to_string(list_sort(list(DISTINCT lang)), '|') AS langs, list_sort(list(DISTINCT lang))[1:3] AS first_langs FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def m1_delimited_lists(spark, d):
    langs = table(spark, d, "documents").filter("lang is not null").groupBy("doc_type").agg(F.sort_array(F.collect_set("lang")).alias("l"))
    joined = langs.select("doc_type", F.array_join("l", "|").alias("langs"))
    return joined.withColumn("first_langs", F.slice(F.split("langs", r"\|"), 1, 3))


@query(f"{CONTENT} SELECT author, pos, list(lemma || '=' || n ORDER BY lemma) AS lemmas FROM (SELECT author, pos, lemma, count(*) AS n FROM content GROUP BY ALL HAVING count(*) >= 5) GROUP BY 1, 2")
def m4_nested_map(spark, d):
    v = S.vocabulary(R.content(tokens(spark, d))).filter("n >= 5")
    nested = v.groupBy("author", "pos").agg(F.map_from_entries(F.collect_list(F.struct("lemma", "n"))).alias("m"))
    return nested.select("author", "pos", F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("lemmas"))


@query("SELECT label, round(list_sum(list(x ORDER BY vec_id)) / count(*), 5)::DOUBLE AS centroid_first, count(*) AS n FROM (SELECT label, vec_id, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY 1")
def n8_centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    c = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.any_value("n").alias("n"))
    return c.select("label", F.round(F.col("centroid")[0], 5).alias("centroid_first"), "n")


@query("SELECT a.vec_id AS a, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def n5_dot_products(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), F.round(N.dot(F.col("embedding"), F.col("next")), 5).alias("dot"))
