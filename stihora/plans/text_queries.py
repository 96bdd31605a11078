"""Queries of projections, filters and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stihora.functions import text as T
from stihora.operators import relations as R

from .registry import GENERATED, LINES, POEMS, TOKENS, generated, poems, query, sql_lines, sql_trim, tokens
from .tables import table


@query(f"{POEMS} SELECT poem_id, author, text FROM poems")
def proj_p3_trimmed_lines(spark, d):
    return poems(spark, d).select("poem_id", "author", "text")


@query(f"{POEMS} SELECT poem_id, author, row_number() OVER (ORDER BY author, poem_id) - 1 AS dense_id FROM poems")
def proj_p4_dense_ids(spark, d):
    return R.dense_ids(poems(spark, d).select("poem_id", "author"), ["author", "poem_id"]).select("poem_id", "author", F.col("dense_id").cast("bigint").alias("dense_id"))


@query(f"{TOKENS} SELECT pos, count(*) AS n, count(DISTINCT lemma) AS n_lemmas FROM tokens WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN') GROUP BY 1")
def proj_p5_content_words(spark, d):
    return R.content(tokens(spark, d)).groupBy("pos").agg(F.count("*").alias("n"), F.countDistinct("lemma").alias("n_lemmas"))


@query(f"{POEMS} SELECT poem_id, author FROM poems WHERE author IN (SELECT author FROM poems GROUP BY 1 HAVING count(*) >= 5)")
def proj_p6_eligible_authors(spark, d):
    return R.eligible(poems(spark, d).select("poem_id", "author"))


@query(
    r"""SELECT run, poem_id, line_uniqueness, clf_predicted, coalesce(sample_index, '0') AS sample_index
    FROM (SELECT run, poem_id, line_uniqueness, clf_predicted, NULL::VARCHAR AS sample_index FROM scored_poems)"""
)
def proj_p2_default_column(spark, d):
    scored = table(spark, d, "scored_poems").select("run", "poem_id", "line_uniqueness", "clf_predicted")
    shape = spark.createDataFrame([], "run string, poem_id bigint, line_uniqueness double, clf_predicted string, sample_index string")
    return shape.unionByName(scored, allowMissingColumns=True).withColumn("sample_index", F.coalesce("sample_index", F.lit("0")))


@query("SELECT run, count(*) AS n, count(*) FILTER (quality IS NULL OR quality >= 0.65) AS kept FROM scored_poems GROUP BY 1")
def proj_p7_null_or_above(spark, d):
    scored = table(spark, d, "scored_poems")
    return scored.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull() | (F.col("quality") >= 0.65)).alias("kept"))


PLACE = ("ски", "ска", "ско", "цки", "цка", "цко")


@query(f"{TOKENS} SELECT poem_id, line_no::INT AS line_no, tok_no::INT AS tok_no, word FROM tokens WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND NOT regexp_matches(word, '({'|'.join(PLACE)})$')")
def proj_p9_replaceable(spark, d):
    return R.content(tokens(spark, d)).filter((F.col("pos") != "PROPN") & ~T.has_suffix(F.col("word"), PLACE)).select("poem_id", "line_no", "tok_no", "word")


@query("SELECT poem_id, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS split FROM poem_splits WHERE lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) IN ('train', 'val', 'test')")
def proj_p11_split_filter(spark, d):
    label = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    return table(spark, d, "poem_splits").select("poem_id", label.alias("split")).filter(F.col("split").isin("train", "val", "test"))


@query("SELECT run, poem_id, clf_top1 FROM scored_poems WHERE run <> 'baseline'")
def proj_p12_without_reference(spark, d):
    return table(spark, d, "scored_poems").filter("run <> 'baseline'").select("run", "poem_id", "clf_top1")


@query(
    """SELECT kind, run, count(*) AS n, min(poem_id) AS first_id FROM (
    SELECT unnest(['degenerate', 'wrong_voice']) AS kind, unnest([line_uniqueness < 0.8, clf_top1 = 0]) AS hit, run, poem_id FROM scored_poems) WHERE hit GROUP BY ALL"""
)
def proj_p13_failures(spark, d):
    kinds = F.array(F.when(F.col("line_uniqueness") < 0.8, "degenerate"), F.when(F.col("clf_top1") == 0, "wrong_voice"))
    rows = table(spark, d, "scored_poems").select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"), "run", "poem_id")
    return rows.groupBy("kind", "run").agg(F.count("*").alias("n"), F.min("poem_id").alias("first_id"))


REPETITION = rf"""measured AS (SELECT *, regexp_extract_all(lower(text), '\p{{L}}+') AS ws, {sql_lines("text")} AS ls FROM texts),
repetition AS (SELECT *, len(ws)::BIGINT AS n_tokens,
  CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END AS d1,
  CASE WHEN len(ws) > 1 THEN len(list_distinct([ws[i] || ' ' || ws[i+1] for i in range(1, len(ws))])) / (len(ws) - 1) ELSE 0 END AS d2,
  CASE WHEN len(ws) > 2 THEN len(list_distinct([ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] for i in range(1, len(ws) - 1)])) / (len(ws) - 2) ELSE 0 END AS d3,
  CASE WHEN len(ls) > 0 THEN len(list_distinct(ls)) / len(ls) ELSE 0 END AS line_uniqueness,
  coalesce(list_max(map_values(CASE WHEN len(ls) > 0 THEN list_histogram(ls) END)), 0)::BIGINT AS max_line_repeats FROM measured)"""


def repetition(df):
    """Repetition metrics of a text column."""
    w, ls = F.col("_w"), F.col("_l")
    df = df.withColumns({"_w": T.words(F.col("text")), "_l": T.lines(F.col("text"))})
    return df.select(
        *[c for c in df.columns if c not in ("_w", "_l")], F.size(w).cast("bigint").alias("n_tokens"), T.distinctness(w, 1).alias("d1"), T.distinctness(w, 2).alias("d2"), T.distinctness(w, 3).alias("d3"),
        (F.size(F.array_distinct(ls)) / F.greatest(F.size(ls), F.lit(1))).alias("line_uniqueness"), T.most_repeats(ls).cast("bigint").alias("max_line_repeats"),
    )


@query(
    f"""WITH texts AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL), {REPETITION}
    SELECT doc_id, source, n_tokens, round(d1, 6)::DOUBLE AS d1, round(d2, 6)::DOUBLE AS d2, round(d3, 6)::DOUBLE AS d3, round(line_uniqueness, 6)::DOUBLE AS line_uniqueness, max_line_repeats FROM repetition"""
)
def t9_repetition(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", "text")
    rounded = {c: F.round(c, 6) for c in ("d1", "d2", "d3", "line_uniqueness")}
    return repetition(docs).withColumns(rounded).drop("text")


@query(
    f"""WITH texts AS (SELECT source, text FROM documents WHERE text IS NOT NULL), {REPETITION}
    SELECT source, count(*) AS n, sum(n_tokens)::BIGINT AS n_tokens, round(avg(d1), 6) AS d1, round(avg(d2), 6) AS d2, round(avg(line_uniqueness), 6) AS line_uniqueness FROM repetition GROUP BY 1"""
)
def a11_repetition_by_source(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("source", "text")
    return repetition(docs).groupBy("source").agg(
        F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"), *(F.round(F.avg(c), 6).alias(c) for c in ("d1", "d2", "line_uniqueness")),
    )


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0B\x85\p{Z}]+'))::BIGINT AS n_tokens, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::BIGINT AS n_words FROM documents WHERE text IS NOT NULL""")
def t3_tokens(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(T.whitespace_tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(T.words(F.col("text"), T.WORD_CHARS)).cast("bigint").alias("n_words"))


@query(
    rf"""{POEMS} SELECT poem_id, len([x for x in string_split({sql_trim("text")}, chr(10) || chr(10)) if {sql_trim("x")} <> ''])::BIGINT AS n_stanzas, len({sql_lines("text")})::BIGINT AS n_lines FROM poems"""
)
def t5_stanzas(spark, d):
    return poems(spark, d).select("poem_id", F.size(T.stanzas(F.col("text"))).cast("bigint").alias("n_stanzas"), F.size(T.lines(F.col("text"))).cast("bigint").alias("n_lines"))


RHYME_CTES = r"""stripped AS (SELECT poem_id, author, line_no, [regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') for w in regexp_split_to_array(lower(line), '[\s\x0B\x85\p{Z}]+')] AS ws FROM lines),
last AS (SELECT *, [w for w in ws if regexp_full_match(w, '\p{L}+') and regexp_matches(w, '[аеиоу]')][-1] AS w FROM stripped),
rhymes AS (SELECT poem_id, author, line_no, CASE WHEN regexp_matches(w, '[аеиоу].*[аеиоу]') THEN regexp_extract(w, '[аеиоу]([^аеиоу]*[аеиоу][^аеиоу]*)$', 1)
  ELSE regexp_extract(w, '([аеиоу][^аеиоу]*)$', 1) END AS ending FROM last WHERE w IS NOT NULL)"""
RHYME_SQL = f"{LINES}, {RHYME_CTES}"


def rhymes(spark, d):
    lines = R.line_table(poems(spark, d))
    return lines.select("poem_id", "author", "line_no", T.rhyme_ending(F.col("line")).alias("ending")).filter("ending is not null")


@query(f"{RHYME_SQL} SELECT poem_id, line_no::INT AS line_no, ending FROM rhymes")
def t7_rhyme_endings(spark, d):
    return rhymes(spark, d).select("poem_id", "line_no", "ending")


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[Ѐ-ӿ]'))::BIGINT AS cyrillic, len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS latin,
    regexp_matches(text, '(?m)\*\*|^#{1,6} |^[-*] |^[0-9]+\. |```') AS markup, regexp_matches(text, '(?m)\*\*|^#{1,6} |```') AS chat_markup FROM documents WHERE text IS NOT NULL"""
)
def t10_scripts_and_markup(spark, d):
    c = T.script_counts(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select(
        "doc_id", c["cyrillic"].cast("bigint").alias("cyrillic"), c["latin"].cast("bigint").alias("latin"), T.has_markup(F.col("text")).alias("markup"), T.has_markup(F.col("text"), chat_only=True).alias("chat_markup"),
    )


PAIRED = f"""{POEMS}, {GENERATED}, paired AS (SELECT e.example_id, e.target_author, e.generated_poem AS gen, p.text AS src FROM examples e JOIN poems p ON e.source_poem_id = p.poem_id WHERE e.generated_poem IS NOT NULL)"""


def paired(spark, d):
    """Generated poems with the poems behind them."""
    g = generated(spark, d).filter("generated_poem is not null").select("example_id", "target_author", F.col("source_poem_id").alias("poem_id"), F.col("generated_poem").alias("gen"))
    return g.join(poems(spark, d).select("poem_id", F.col("text").alias("src")), "poem_id").drop("poem_id")


@query(
    rf"""{PAIRED}, t AS (SELECT example_id, list_distinct([w for w in regexp_extract_all(lower(gen), '\p{{L}}+') if length(w) >= 4]) AS g, list_distinct([w for w in regexp_extract_all(lower(src), '\p{{L}}+') if length(w) >= 4]) AS s,
    [array_to_string(regexp_extract_all(lower(x), '\p{{L}}+'), ' ') for x in {sql_lines("gen")}] AS gl, [array_to_string(regexp_extract_all(lower(x), '\p{{L}}+'), ' ') for x in {sql_lines("src")}] AS sl FROM paired)
    SELECT example_id, round(CASE WHEN len(s) > 0 THEN len(list_intersect(g, s)) / len(s) ELSE 0 END, 6)::DOUBLE AS content_recall,
    round(CASE WHEN len(g) + len(s) > 0 THEN len(list_intersect(g, s)) / (len(g) + len(s) - len(list_intersect(g, s))) ELSE 0 END, 6)::DOUBLE AS content_jaccard,
    round(CASE WHEN len(gl) > 0 THEN len([x for x in gl if NOT list_contains(sl, x)]) / len(gl) ELSE 0 END, 6)::DOUBLE AS line_novelty FROM t"""
)
def t14_content_preservation(spark, d):
    from stihora.functions import numeric as N

    norm = lambda c: F.transform(T.lines(c), T.normalized_line)
    t = paired(spark, d).select("example_id", T.content_types(F.col("gen")).alias("g"), T.content_types(F.col("src")).alias("s"), norm(F.col("gen")).alias("gl"), norm(F.col("src")).alias("sl"))
    new = F.filter("gl", lambda x: ~F.array_contains("sl", x))
    return t.select(
        "example_id", F.round(N.share(F.size(F.array_intersect("g", "s")), F.size("s")), 6).alias("content_recall"), F.round(N.jaccard(F.col("g"), F.col("s")), 6).alias("content_jaccard"),
        F.round(N.share(F.size(new), F.size("gl")), 6).alias("line_novelty"),
    )


@query(rf"""SELECT doc_id, regexp_replace({sql_trim("lower(text)")}, '{T.WS}+', ' ', 'g') AS collapsed FROM documents WHERE text IS NOT NULL""")
def t15_collapsed(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.collapsed_line(F.col("text")).alias("collapsed"))


@query(
    """SELECT doc_id, list_sort([x for x in ['ѓ', 'ќ', 'ѕ', 'љ', 'њ', 'џ', 'ј', 'ђ', 'ћ', 'ъ', 'ы', 'э'] if contains(lower(text), x)]) AS markers FROM documents WHERE text IS NOT NULL"""
)
def t16_marker_letters(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.marker_letters(F.col("text"), "ѓќѕљњџјђћъыэ").alias("markers"))


@query(
    rf"""{TOKENS}, probe AS (SELECT poem_id, arg_min(word, (line_no, tok_no)) AS word FROM tokens WHERE pos = 'NOUN' GROUP BY 1), m AS (SELECT p.poem_id, p.text, probe.word, instr(p.text, probe.word) AS place FROM poems p JOIN probe USING (poem_id))
    SELECT poem_id, word, CASE WHEN place > 0 THEN substr(text, 1, place - 1) || '[MASK]' || substr(text, place + length(word)) ELSE text END AS masked, CASE WHEN place > 0 THEN substr(text, 1, place - 1) || '[' || word || ']' || substr(text, place + length(word)) ELSE text END AS bracketed FROM m"""
)
def t18_masked(spark, d):
    word = F.min_by("word", F.struct("line_no", "tok_no")).alias("word")
    probe = tokens(spark, d).filter("pos = 'NOUN'").groupBy("poem_id").agg(word)
    m = poems(spark, d).select("poem_id", "text").join(probe, "poem_id")
    return m.select("poem_id", "word", T.mask_first(F.col("text"), F.col("word")).alias("masked"), T.mask_first(F.col("text"), F.col("word"), brackets=True).alias("bracketed"))


@query(
    rf"""{POEMS} SELECT poem_id, array_to_string([CASE WHEN len(regexp_split_to_array(x, '{T.WS}+')) >= 4 THEN regexp_replace(x, '{T.NON_SPACE}$', 'ноќ') ELSE x END for x in {sql_lines("text")}], chr(10)) AS near_copy FROM poems"""
)
def t20_near_copies(spark, d):
    return poems(spark, d).select("poem_id", T.near_copy(F.col("text"), "ноќ").alias("near_copy"))


@query(
    r"""SELECT DISTINCT example_id, CASE WHEN contains(x, '<think>') THEN '' ELSE regexp_replace(x, '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g') END AS answer FROM (SELECT example_id, regexp_replace(generated_poem, '(?s)<think>.*?</think>', '', 'g') AS x FROM synthetic_dataset WHERE generated_poem IS NOT NULL)"""
)
def t22_without_reasoning(spark, d):
    return table(spark, d, "synthetic_dataset").filter("generated_poem is not null").select("example_id", T.strip_reasoning(F.col("generated_poem")).alias("answer")).distinct()


@query(
    r"""SELECT DISTINCT example_id, regexp_replace(regexp_replace(regexp_replace(generated_poem, '\r\n', chr(10), 'g'), '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS display, regexp_replace(regexp_replace(target_author, '[^\p{L}\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM synthetic_dataset"""
)
def t21_display(spark, d):
    return table(spark, d, "synthetic_dataset").select("example_id", T.clean_display(F.col("generated_poem")).alias("display"), T.slug(F.col("target_author")).alias("slug")).distinct()


@query(
    """SELECT DISTINCT substr(sha1(concat_ws('|', '42', model, source_poem_id::VARCHAR, target_author)), 1, 10) AS item_id, sha256(concat_ws(chr(31), model, 'v1', generated_poem)) AS cache_key FROM synthetic_dataset"""
)
def t31_ids(spark, d):
    df = table(spark, d, "synthetic_dataset")
    return df.select(T.item_id(F.lit("42"), F.col("model"), F.col("source_poem_id").cast("string"), F.col("target_author")).alias("item_id"), T.cache_key(F.col("model"), F.lit("v1"), F.col("generated_poem")).alias("cache_key")).distinct()


@query(f"{TOKENS} SELECT DISTINCT feats, str_split(str_split(feats, '|')[1], '=')[2] AS definite, str_split(str_split(feats, '|')[2], '=')[2] AS number FROM tokens")
def t27_features(spark, d):
    parsed = T.parse_features(F.col("feats"))
    return tokens(spark, d).select("feats").distinct().select(T.render_features(parsed).alias("feats"), parsed["Definite"].alias("definite"), parsed["Number"].alias("number"))
