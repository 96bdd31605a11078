"""Queries of style: profiles, diversity, transitions, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stihora.functions import numeric as N
from stihora.functions import text as T
from stihora.operators import relations as R
from stihora.operators import stylometry as S
from stihora.operators import tfidf as I

from .registry import CONTENT, LINES, POEMS, TOKENS, poems, query, sql_lines, sql_trim, tokens
from .tables import table
from .text_queries import RHYME_CTES, rhymes

r6 = lambda c: F.round(c, 6)

A5_SQL = rf"""stats AS (SELECT poem_id, author, list_sum([len(regexp_extract_all(x, '{T.NON_SPACE}')) for x in {sql_lines("text")}])::BIGINT AS tokens, len({sql_lines("text")})::BIGINT AS lines,
  [x for x in string_split({sql_trim("text")}, chr(10) || chr(10)) if {sql_trim("x")} <> ''] AS st FROM poems),
a5 AS (SELECT poem_id, author, tokens, lines, len(st)::BIGINT AS stanzas, list_sum([len({sql_lines("x")}) for x in st])::BIGINT AS stanza_lines FROM stats)"""


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def a1_group_count(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT source, count(DISTINCT author) AS n_authors, count(DISTINCT lang) AS n_langs FROM documents GROUP BY 1")
def a2_count_distinct(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("author").alias("n_authors"), F.countDistinct("lang").alias("n_langs"))


@query(f"{CONTENT} SELECT author, round(count(DISTINCT lemma) / count(*), 6) AS ttr, round(avg((pos = 'NOUN')::INT), 6) AS noun, round(avg((pos = 'VERB')::INT), 6) AS verb, round(avg((pos = 'ADJ')::INT), 6) AS adj, round(avg((pos = 'ADV')::INT), 6) AS adv FROM content GROUP BY 1")
def a3_ttr_and_pos_shares(spark, d):
    shares = [r6(F.avg((F.col("pos") == p).cast("double"))).alias(p.lower()) for p in ("NOUN", "VERB", "ADJ", "ADV")]
    return R.content(tokens(spark, d)).groupBy("author").agg(r6(F.countDistinct("lemma") / F.count("*")).alias("ttr"), *shares)


@query(f"{POEMS}, {A5_SQL} SELECT * FROM a5")
def a5_line_stats(spark, d):
    return S.line_stats(poems(spark, d)).withColumns({c: F.col(c).cast("bigint") for c in ("tokens", "lines", "stanzas", "stanza_lines")})


W1_SQL = """placed AS (SELECT author, count(DISTINCT lemma) OVER (PARTITION BY author ORDER BY poem_id, line_no, tok_no ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS k,
  row_number() OVER (PARTITION BY author ORDER BY poem_id, line_no, tok_no) AS i, count(*) OVER (PARTITION BY author) AS n FROM content),
w1 AS (SELECT author, n, sum(k)::BIGINT AS window_sum, sum(k) / ((n - least(n, 200) + 1) * least(n, 200)) AS mattr FROM placed WHERE i >= least(n, 200) GROUP BY 1, 2)"""


@query(f"{CONTENT}, {W1_SQL} SELECT author, n, window_sum, round(mattr, 6)::DOUBLE AS mattr FROM w1")
def w1_mattr(spark, d):
    return S.mattr(R.content(tokens(spark, d)), "author", ["poem_id", "line_no", "tok_no"], by_range=True).withColumn("mattr", r6("mattr"))


BIGRAMS = "bigrams AS (SELECT * FROM (SELECT poem_id, author, pos, lead(pos) OVER (PARTITION BY poem_id ORDER BY line_no, tok_no) AS next_pos FROM content) WHERE next_pos IS NOT NULL)"


@query(f"{CONTENT}, {BIGRAMS} SELECT poem_id, pos, next_pos, count(*) AS n FROM bigrams GROUP BY ALL")
def w2_pos_bigrams(spark, d):
    return S.pos_bigrams(R.content(tokens(spark, d))).groupBy("poem_id", "pos", "next_pos").agg(F.count("*").alias("n"))


@query(f"{CONTENT} SELECT prev_pos, pos, next_pos, count(*) AS n FROM (SELECT pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos FROM content WINDOW w AS (PARTITION BY poem_id, line_no ORDER BY tok_no)) GROUP BY ALL")
def w3_neighbours(spark, d):
    return S.neighbours(R.content(tokens(spark, d))).groupBy("prev_pos", "pos", "next_pos").agg(F.count("*").alias("n"))


@query(f"{CONTENT}, {BIGRAMS}, n AS (SELECT author, pos, next_pos, count(*) AS n FROM bigrams GROUP BY ALL) SELECT author, pos, next_pos, n, round(n / sum(n) OVER (PARTITION BY author, pos), 6) AS p FROM n")
def a10_transitions(spark, d):
    return S.transitions(S.pos_bigrams(R.content(tokens(spark, d)))).withColumn("p", r6("p"))


VOCAB = "vocab AS (SELECT author, pos, lemma, count(*) AS n FROM content GROUP BY ALL)"


@query(f"{CONTENT}, {VOCAB} SELECT * FROM vocab")
def a9_vocabulary(spark, d):
    return S.vocabulary(R.content(tokens(spark, d)))


@query(f"{CONTENT}, {VOCAB} SELECT author, pos, lemma, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY author, pos ORDER BY n DESC, lemma) AS rank FROM vocab) WHERE rank <= 5")
def w4_top_per_group(spark, d):
    return S.top_n(S.vocabulary(R.content(tokens(spark, d))), ["author", "pos"], [F.desc("n"), F.col("lemma")], 5)


MAJORITY = """counted AS (SELECT word, lemma, pos, count(*) AS n, min((poem_id, line_no, tok_no)) AS first FROM content GROUP BY ALL),
major AS (SELECT word, lemma, pos, n FROM counted QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, first) = 1)"""


@query(f"{CONTENT}, {MAJORITY} SELECT * FROM major")
def a8_majority(spark, d):
    return S.majority(R.content(tokens(spark, d)), ["word"], ["lemma", "pos"], ["poem_id", "line_no", "tok_no"])


@query(
    f"""{CONTENT}, {A5_SQL}, {W1_SQL}, {BIGRAMS}, {RHYME_CTES},
    sums AS (SELECT author, count(*) AS num_tokens, avg((pos = 'NOUN')::INT) AS noun, count(DISTINCT lemma) / count(*) AS ttr FROM content GROUP BY 1),
    s AS (SELECT author, count(*) AS num_poems, sum(tokens) / sum(lines) AS tpl, sum(lines) / count(*) AS lpp, sum(stanzas) / count(*) AS spp, sum(stanza_lines) / sum(stanzas) AS lps FROM a5 GROUP BY 1),
    tb AS (SELECT author, string_agg(item, '|' ORDER BY n DESC, item) AS top_bigrams FROM (SELECT author, pos || '>' || next_pos AS item, count(*) AS n FROM bigrams GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, item) <= 5) GROUP BY 1),
    tr AS (SELECT author, string_agg(item, '|' ORDER BY n DESC, item) AS top_rhymes FROM (SELECT author, ending AS item, count(*) AS n FROM rhymes GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, item) <= 5) GROUP BY 1)
    SELECT author, num_poems, num_tokens, round(noun, 6) AS pct_noun, round(ttr, 6) AS ttr, round(mattr, 6)::DOUBLE AS mattr, round(tpl, 6) AS tokens_per_line, round(lpp, 6) AS lines_per_poem, round(spp, 6) AS stanzas_per_poem, round(lps, 6) AS lines_per_stanza, top_bigrams, top_rhymes
    FROM sums JOIN s USING (author) JOIN w1 USING (author) LEFT JOIN tb USING (author) LEFT JOIN tr USING (author)"""
)
def a6_author_profile(spark, d):
    p = S.author_profile(poems(spark, d), R.content(tokens(spark, d)), rhymes(spark, d))
    ratios = ("pct_noun", "ttr", "mattr", "tokens_per_line", "lines_per_poem", "stanzas_per_poem", "lines_per_stanza")
    return p.select("author", "num_poems", "num_tokens", *(r6(c).alias(c) for c in ratios), "top_bigrams", "top_rhymes")


@query(
    f"""{CONTENT}, {A5_SQL}, p AS (SELECT poem_id, count(*) AS n_content, avg((pos = 'NOUN')::INT) AS noun, count(DISTINCT lemma) / count(*) AS ttr FROM content GROUP BY 1)
    SELECT poem_id, tokens, lines, coalesce(n_content, 0) AS n_content, round(coalesce(noun, 0), 6) AS share_noun, round(CASE WHEN lines > 0 THEN tokens / lines ELSE 0 END, 6) AS tokens_per_line,
    round(CASE WHEN stanzas > 0 THEN stanza_lines / stanzas ELSE 0 END, 6) AS lines_per_stanza FROM a5 LEFT JOIN p USING (poem_id)"""
)
def a7_poem_features(spark, d):
    f = S.poem_features(poems(spark, d), R.content(tokens(spark, d)))
    return f.select("poem_id", F.col("tokens").cast("bigint").alias("tokens"), F.col("lines").cast("bigint").alias("lines"), "n_content", *(r6(c).alias(c) for c in ("share_noun", "tokens_per_line", "lines_per_stanza")))


PERCENTILES = f"""{POEMS}, {A5_SQL}, value AS (SELECT author, sum(tokens) / sum(lines) AS value FROM a5 GROUP BY 1),
ranked AS (SELECT author, value, CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY value, author) - 1) / (count(*) OVER () - 1) * 100 ELSE 0 END AS percentile FROM value)"""


def _percentiles(spark, d):
    stats = S.line_stats(poems(spark, d)).groupBy("author").agg((F.sum("tokens") / F.sum("lines")).alias("tokens_per_line"))
    return S.percentiles(stats, "tokens_per_line", "tokens_per_line")


@query(f"{PERCENTILES} SELECT author, round(value, 6) AS value, round(percentile, 6)::DOUBLE AS percentile FROM ranked")
def w5_percentiles(spark, d):
    return _percentiles(spark, d).select("author", r6("value").alias("value"), r6("percentile").alias("percentile"))


@query(f"{PERCENTILES} SELECT author, CASE WHEN percentile < 33.3 THEN 'low' WHEN percentile <= 66.7 THEN 'mid' ELSE 'high' END AS band FROM ranked")
def w6_bands(spark, d):
    return _percentiles(spark, d).select("author", S.band(F.col("percentile")).alias("band"))


PHRASES = [("tokens_per_line", "low", "Short lines.", 1), ("tokens_per_line", "mid", "Lines of middle length.", 1), ("tokens_per_line", "high", "Long lines.", 1)]


@query(f"{PERCENTILES} SELECT author, CASE WHEN percentile < 33.3 THEN 'Short lines.' WHEN percentile <= 66.7 THEN 'Lines of middle length.' ELSE 'Long lines.' END AS description FROM ranked")
def t26_style_prose(spark, d):
    bands = _percentiles(spark, d).select("author", "name", S.band(F.col("percentile")).alias("band"))
    return S.describe(bands, spark.createDataFrame(PHRASES, "name string, band string, phrase string, place int"))


def tfidf_ctes(doc: str, term: str, sublinear: bool, low: int, high: float, top: int) -> str:
    """CTEs from `terms` to `best`, the top terms of each document."""
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""tf AS (SELECT {doc}, {term}, count(*) AS tf FROM terms GROUP BY ALL), size AS (SELECT count(DISTINCT {doc}) AS n FROM terms),
    df AS (SELECT *, count(*) OVER (PARTITION BY {term}) AS df FROM tf), kept AS (SELECT df.*, n FROM df, size WHERE df >= {low} AND df <= {high}::DOUBLE * n),
    raw AS (SELECT *, {tf} * (ln((1 + n) / (1 + df)) + 1) AS w FROM kept), u AS (SELECT {doc}, {term}, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY {doc})) AS weight FROM raw),
    best AS (SELECT {doc}, {term}, tf, df, round(weight, 6) AS weight FROM u QUALIFY row_number() OVER (PARTITION BY {doc} ORDER BY round(weight, 9) DESC, {term}) <= {top})"""


def _tfidf_sql(base: str, doc: str, term: str, sublinear: bool, low: int, high: float, top: int) -> str:
    return f"{base}, {tfidf_ctes(doc, term, sublinear, low, high, top)} SELECT * FROM best"


def _top(weights, doc, term, n):
    best = S.top_n(weights, [doc], [F.round("weight", 9).desc(), F.col(term)], n)
    return best.select(doc, term, "tf", "df", r6("weight").alias("weight"))


ELIGIBLE_WORDS = (
    LINES
    + r""", busy AS (SELECT author FROM poems GROUP BY 1 HAVING count(*) >= 5), terms AS (SELECT author, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM poems WHERE author IN (SELECT author FROM busy))"""
)


def eligible_words(spark, d):
    return R.eligible(poems(spark, d)).select("author", F.explode(T.words(F.col("text"))).alias("word"))


@query(_tfidf_sql(ELIGIBLE_WORDS, "author", "word", True, 2, 0.85, 20))
def n1_author_tfidf(spark, d):
    return _top(I.tfidf(eligible_words(spark, d), "author", "word", sublinear=True, least_df=2, most_df=0.85), "author", "word", 20)


@query(_tfidf_sql(CONTENT + ", terms AS (SELECT poem_id, lemma FROM content)", "poem_id", "lemma", False, 1, 1.0, 10))
def n2_poem_tfidf(spark, d):
    return _top(I.tfidf(R.content(tokens(spark, d)).select("poem_id", "lemma"), "poem_id", "lemma"), "poem_id", "lemma", 10)


@query(
    _tfidf_sql(
        LINES + r""", w AS (SELECT author, ' ' || unnest(regexp_extract_all(lower(text), '\p{L}+')) || ' ' AS p FROM poems),
        terms AS (SELECT author, unnest(flatten([[substr(p, i, 2) for i in range(1, length(p))], [substr(p, i, 3) for i in range(1, length(p) - 1)], [substr(p, i, 4) for i in range(1, length(p) - 2)]])) AS gram FROM w)""",
        "author", "gram", True, 2, 1.0, 10,
    )
)
def n3_char_ngrams(spark, d):
    words = poems(spark, d).select("author", F.explode(T.words(F.col("text"))).alias("word"))
    return _top(I.tfidf(I.char_ngrams(words).select("author", "gram"), "author", "gram", sublinear=True, least_df=2), "author", "gram", 10)


@query(
    _tfidf_sql(
        LINES + r""", w AS (SELECT author, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM poems), terms AS (SELECT author, unnest(ws || CASE WHEN len(ws) > 1 THEN [ws[i] || ' ' || ws[i+1] for i in range(1, len(ws))] ELSE [] END) AS gram FROM w)""",
        "author", "gram", True, 2, 1.0, 10,
    )
)
def n4_word_ngrams(spark, d):
    return _top(I.tfidf(I.word_ngrams(poems(spark, d)).select("author", "gram"), "author", "gram", sublinear=True, least_df=2), "author", "gram", 10)


@query(f"{CONTENT} SELECT author, lemma, n, round(n / max(n) OVER (PARTITION BY author), 6) AS relative FROM (SELECT author, lemma, count(*) AS n FROM content GROUP BY ALL)")
def a27_max_normalised(spark, d):
    n = R.content(tokens(spark, d)).groupBy("author", "lemma").agg(F.count("*").alias("n"))
    return n.withColumn("relative", r6(F.col("n") / F.max("n").over(Window.partitionBy("author"))))


@query(f"{TOKENS} SELECT author, pos, round(count(*) / sum(count(*)) OVER (PARTITION BY author), 6) AS p FROM tokens GROUP BY 1, 2")
def n7_distribution(spark, d):
    n = tokens(spark, d).groupBy("author", "pos").agg(F.count("*").alias("n"))
    return n.select("author", "pos", r6(F.col("n") / F.sum("n").over(Window.partitionBy("author"))).alias("p"))


@query(
    f"""{TOKENS}, a AS (SELECT author, pos, count(*) AS n FROM tokens GROUP BY 1, 2), g AS (SELECT pos, count(*) AS m FROM tokens GROUP BY 1)
    SELECT author, round(sum(n * m) / (sqrt(sum(n * n)) * sqrt((SELECT sum(m * m) FROM g))), 6) AS cosine FROM a JOIN g USING (pos) GROUP BY 1"""
)
def n6_distribution_cosine(spark, d):
    n = tokens(spark, d).groupBy("author", "pos").agg(F.count("*").alias("n"))
    own = n.groupBy("author").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("own"))
    every = n.groupBy("pos").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("every"))
    return own.join(F.broadcast(every)).select("author", r6(N.map_cosine(F.col("own"), F.col("every"))).alias("cosine"))


@query(rf"""{POEMS} SELECT author, length(string_agg(text, chr(10) ORDER BY poem_id))::BIGINT AS n_chars, md5(string_agg(text, chr(10) ORDER BY poem_id)) AS digest FROM poems GROUP BY 1""")
def a26_one_text_per_author(spark, d):
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("poem_id", "text"))), lambda x: x["text"]), "\n")
    joined = poems(spark, d).groupBy("author").agg(whole.alias("t"))
    return joined.select("author", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))
