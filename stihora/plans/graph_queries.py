"""Queries of graphs, candidates, morphology and sequential steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stihora.functions import text as T
from stihora.operators import candidates as C
from stihora.operators import graph as G
from stihora.operators import joins as J
from stihora.operators import relations as R
from stihora.operators import sequential as Q
from stihora.operators import stylometry as S
from stihora.operators import tfidf as I

from .join_queries import J9, MAJOR_LEMMA, PAIRS, SPLITS, TERMS, similar_authors, terms
from .registry import CONTENT, POEMS, TOKENS, poems, query, tokens
from .style_queries import ELIGIBLE_WORDS, VOCAB, _top, eligible_words, r6, tfidf_ctes
from .tables import table, written

BEST = f"{MAJOR_LEMMA}, {TERMS}, {tfidf_ctes('author', 'word', True, 2, 0.85, 20)}"


def best_words(spark, d):
    return _top(I.tfidf(eligible_words(spark, d), "author", "word", sublinear=True, least_df=2, most_df=0.85), "author", "word", 20)


#: Distinctive words as nodes: the term (lemma and part of speech) that a typical word mostly stands for, if it is frequent enough.
MAJOR_TERM = "said AS (SELECT word, lemma, pos, count(*) AS n, min((poem_id, line_no, tok_no)) AS first FROM tokens GROUP BY ALL), major_term AS (SELECT word, lemma || '|' || pos AS term FROM said QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, first) = 1)"
DISTINCTIVE = f"{CONTENT}, {TERMS}, {tfidf_ctes('author', 'word', True, 2, 0.85, 20)}, {MAJOR_TERM}, freq AS (SELECT word, count(*) AS f FROM tokens GROUP BY 1), distinctive AS (SELECT author AS src, term AS dst, max(round(weight, 6)) AS weight, count(*) AS n_surfaces FROM best JOIN major_term USING (word) JOIN freq USING (word) WHERE f >= 2 GROUP BY 1, 2)"


@query(f"{DISTINCTIVE} SELECT * FROM distinctive")
def g1_distinctive_edges(spark, d):
    t = tokens(spark, d)
    major = S.majority(t, ["word"], ["lemma", "pos"], ["poem_id", "line_no", "tok_no"]).select("word", F.concat_ws("|", "lemma", "pos").alias("term"))
    freq = t.groupBy("word").agg(F.count("*").alias("f")).filter("f >= 2")
    e = best_words(spark, d).join(major, "word").join(freq, "word", "left_semi")
    return e.groupBy(F.col("author").alias("src"), F.col("term").alias("dst")).agg(F.max("weight").alias("weight"), F.count("*").alias("n_surfaces"))


EDGES = f"{DISTINCTIVE}, nodes AS (SELECT DISTINCT dst AS term FROM distinctive), sets AS (SELECT DISTINCT poem_id, lemma || '|' || pos AS term FROM content WHERE lemma || '|' || pos IN (SELECT term FROM nodes)), {PAIRS}, edges AS (SELECT a AS src, b AS dst, n AS weight FROM pairs WHERE n >= 2), links AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"


@query(f"{EDGES} SELECT * FROM edges")
def g2_cooccurrence_edges(spark, d):
    return cooc_edges(spark, d)


def cooc_edges(spark, d):
    """Distinctive words that stand together in two poems or more, however frequent they are."""
    nodes = g1_distinctive_edges(spark, d).select(F.col("dst").alias("term")).distinct()
    pairs = J.cooccurrence(terms(spark, d).join(nodes, "term", "left_semi"), "poem_id", "term")
    return written(pairs.filter("n >= 2").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight")))


@query(f"{EDGES} SELECT src AS id, sum(weight)::BIGINT AS degree, count(*) AS n_edges FROM links GROUP BY 1")
def g6_weighted_degree(spark, d):
    return G.weighted_degree(cooc_edges(spark, d))


@query(f"{EDGES}, deg AS (SELECT src AS id, sum(weight)::BIGINT AS degree FROM links GROUP BY 1) SELECT id, round(10 + 40 * degree / (SELECT max(degree) FROM deg), 6)::DOUBLE AS size FROM deg")
def g5_node_sizes(spark, d):
    return G.node_sizes(G.weighted_degree(cooc_edges(spark, d)), "degree", 10.0, 40.0).select("id", r6("size").alias("size"))


#: Rounds that the SQL twin unrolls; it takes the first whose ranks moved by less than the tolerance, as the operator does.
_ROUNDS, _TOLERANCE = 25, 1e-6
_RANKS = ", ".join(
    f"r{i} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / c.n + 0.85 * coalesce(g.got, 0) AS rank FROM ids n CROSS JOIN c LEFT JOIN (SELECT s.dst AS id, sum(s.share * r.rank) AS got FROM shares s JOIN r{i - 1} r ON r.id = s.src GROUP BY 1) g ON g.id = n.id)"
    for i in range(1, _ROUNDS + 1)
)
_MOVED = " UNION ALL ".join(f"SELECT {i} AS k, sum(abs(x.rank - y.rank)) AS moved FROM r{i} x JOIN r{i - 1} y USING (id)" for i in range(1, _ROUNDS + 1))
_EVERY = " UNION ALL ".join(f"SELECT {i} AS k, id, rank FROM r{i}" for i in range(1, _ROUNDS + 1))


@query(
    f"""{EDGES.replace("links AS (", "links AS MATERIALIZED (")}, total AS (SELECT src, sum(weight) AS t FROM links GROUP BY 1), shares AS MATERIALIZED (SELECT src, dst, weight / t AS share FROM links JOIN total USING (src)), ids AS MATERIALIZED (SELECT DISTINCT src AS id FROM links), c AS MATERIALIZED (SELECT count(*) AS n FROM ids),
    r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM ids, c), {_RANKS}, stop AS (SELECT min(k) AS k FROM ({_MOVED}) m, c WHERE moved < {_TOLERANCE}::DOUBLE * c.n) SELECT id, round(rank * 1000, 6) AS rank FROM ({_EVERY}) e WHERE k = (SELECT k FROM stop)"""
)
def g7_pagerank(spark, d):
    return G.pagerank(cooc_edges(spark, d), rounds=100, tolerance=_TOLERANCE).select("id", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query()
def g8_communities(spark, d):
    """Communities of words that stand together."""
    return G.communities(cooc_edges(spark, d))


@query(f"{J9} SELECT a AS src, b AS dst, round(jaccard, 6) AS weight FROM alike")
def g3_author_edges(spark, d):
    return similar_authors(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), r6("jaccard").alias("weight"))


@query("SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def g4_semantic_edges(spark, d):
    return J.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.35).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("cosine", 5).alias("weight"))


@query()
def g9_community_report(spark, d):
    """Communities over distinctive and co-occurrence edges that have an author, with their sizes."""
    words = g1_distinctive_edges(spark, d).select(F.concat(F.lit("author:"), "src").alias("src"), "dst", "weight")
    edges = words.unionByName(cooc_edges(spark, d).select("src", "dst", (F.col("weight") / 100).alias("weight")))
    return G.community_report(G.communities(edges), words.select(F.col("src").alias("id")).distinct())


@query(f"{EDGES}, t AS (SELECT src, dst, 'cooccurrence' AS edge_type, weight::DOUBLE AS weight FROM edges UNION ALL SELECT dst, src, 'reverse', weight * 2::DOUBLE FROM edges WHERE weight >= 4) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(edge_type) AS edge_type, arg_max(weight, edge_type) AS weight FROM t GROUP BY 1, 2")
def g10_collapsed_edges(spark, d):
    e = cooc_edges(spark, d).select("src", "dst", F.lit("cooccurrence").alias("edge_type"), F.col("weight").cast("double").alias("weight"))
    back = e.filter("weight >= 4").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("reverse").alias("edge_type"), (F.col("weight") * 2).alias("weight"))
    return G.collapsed(e.unionByName(back), ["reverse", "cooccurrence"])


@query(f"{EDGES} SELECT dst AS neighbour, weight FROM links WHERE src = (SELECT min(src) FROM links)")
def g11_neighbours(spark, d):
    links = G.both_ways(cooc_edges(spark, d))
    first = links.agg(F.min("src").alias("src"))
    return links.join(F.broadcast(first), "src").select(F.col("dst").alias("neighbour"), "weight")


@query(
    f"""{EDGES}, ids AS (SELECT DISTINCT src AS id FROM links) SELECT '<node id="' || id || '" label="' || id || '"/>' AS line FROM ids UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '" weight="' || weight || '"/>' FROM edges
    UNION ALL SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>', '</nodes><edges>', '</edges></graph></gexf>'])"""
)
def s8_gexf(spark, d):
    e = cooc_edges(spark, d)
    nodes = G.both_ways(e).select(F.col("src").alias("id")).distinct()
    return G.gexf(nodes, e)


@query(f"{CONTENT} SELECT pos, CASE pos WHEN 'NOUN' THEN '#4c72b0' WHEN 'VERB' THEN '#c44e52' WHEN 'ADJ' THEN '#55a868' ELSE '#8172b2' END AS colour, count(DISTINCT lemma) AS n FROM content GROUP BY 1")
def proj_p18_colours(spark, d):
    return R.content(tokens(spark, d)).groupBy("pos").agg(F.countDistinct("lemma").alias("n")).select("pos", pos_colour(F.col("pos")).alias("colour"), "n")


def pos_colour(pos):
    return F.when(pos == "NOUN", "#4c72b0").when(pos == "VERB", "#c44e52").when(pos == "ADJ", "#55a868").otherwise("#8172b2")


SLOTS = "slots AS (SELECT poem_id, line_no, tok_no, author, lag(pos) OVER w AS prev_pos, pos, lead(pos) OVER w AS next_pos FROM content WINDOW w AS (PARTITION BY poem_id, line_no ORDER BY tok_no))"
TRANS = "bigrams AS (SELECT * FROM (SELECT poem_id, author, pos, lead(pos) OVER (PARTITION BY poem_id ORDER BY line_no, tok_no) AS next_pos FROM content) WHERE next_pos IS NOT NULL), tn AS (SELECT author, pos, next_pos, count(*) AS n FROM bigrams GROUP BY ALL), trans AS (SELECT author, pos, next_pos, n / sum(n) OVER (PARTITION BY author, pos) AS p FROM tn)"


@query(
    f"""{CONTENT}, {SLOTS}, {TRANS}, x AS (SELECT s.*, CASE WHEN prev_pos IS NOT NULL THEN coalesce(a.p, 0) END AS i, CASE WHEN s.next_pos IS NOT NULL THEN coalesce(b.p, 0) END AS o FROM slots s LEFT JOIN trans a ON a.author = s.author AND a.pos = s.prev_pos AND a.next_pos = s.pos LEFT JOIN trans b ON b.author = s.author AND b.pos = s.pos AND b.next_pos = s.next_pos)
    SELECT poem_id, line_no::INT AS line_no, tok_no::INT AS tok_no, round(CASE WHEN i IS NULL AND o IS NULL THEN 0 ELSE (coalesce(i, 0) + coalesce(o, 0)) / ((i IS NOT NULL)::INT + (o IS NOT NULL)::INT) END, 6)::DOUBLE AS transition FROM x"""
)
def n19_transition_score(spark, d):
    t = R.content(tokens(spark, d))
    slots = S.neighbours(t).select("poem_id", "line_no", "tok_no", "author", "prev_pos", "pos", "next_pos")
    return C.transition_score(slots, S.transitions(S.pos_bigrams(t)), "author").select("poem_id", "line_no", "tok_no", r6("transition").alias("transition"))


POOL = """pool AS (SELECT author || '|' || pos AS slot, lemma, n::DOUBLE AS tfidf, CASE WHEN length(lemma) % 3 = 0 THEN NULL ELSE (unicode(lemma) % 40) / 100.0::DOUBLE + 0.4 END AS sem, (length(lemma) % 7)::DOUBLE AS cooc, 0.5::DOUBLE AS transition FROM vocab)"""


def pool(spark, d):
    """Candidates of each author and part of speech, with stand-ins for the parts that need trained vectors."""
    v = S.vocabulary(R.content(tokens(spark, d)))
    sem = F.when(F.length("lemma") % 3 != 0, (F.ascii("lemma") % 40) / 100.0 + 0.4)
    return v.select(F.concat_ws("|", "author", "pos").alias("slot"), "lemma", F.col("n").cast("double").alias("tfidf"), sem.alias("sem"), (F.length("lemma") % 7).cast("double").alias("cooc"), F.lit(0.5).alias("transition"))


SCORED = f"{CONTENT}, {VOCAB}, {POOL}, scored AS (SELECT *, 0.4 * tfidf / coalesce(nullif(max(tfidf) OVER (PARTITION BY slot), 0), 1) + 0.35 * coalesce(sem, 0) + 0.15 * cooc / coalesce(nullif(max(cooc) OVER (PARTITION BY slot), 0), 1) + 0.1 * transition AS score FROM pool)"


@query(f"{SCORED} SELECT slot, lemma, round(score, 6)::DOUBLE AS score FROM scored")
def n18_candidate_scores(spark, d):
    return C.composite(pool(spark, d), "slot").select("slot", "lemma", r6("score").alias("score"))


@query(f"{SCORED} SELECT slot, CASE WHEN a >= 3 THEN 0.65 WHEN b >= 3 THEN 0.6 WHEN c >= 3 THEN 0.55 WHEN e >= 3 THEN 0.5 ELSE 0.45 END::DOUBLE AS threshold FROM (SELECT slot, count(*) FILTER (sem IS NULL OR sem >= 0.65::DOUBLE) AS a, count(*) FILTER (sem IS NULL OR sem >= 0.6::DOUBLE) AS b, count(*) FILTER (sem IS NULL OR sem >= 0.55::DOUBLE) AS c, count(*) FILTER (sem IS NULL OR sem >= 0.5::DOUBLE) AS e FROM pool GROUP BY 1)")
def n20_relaxed_thresholds(spark, d):
    return C.relaxed_threshold(pool(spark, d), "slot")


@query(f"{SCORED}, tiered AS (SELECT *, CASE WHEN sem IS NULL OR sem >= 0.65::DOUBLE THEN 0 ELSE 1 END AS tier FROM scored) SELECT slot, lemma, tier, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY tier, round(score, 9) DESC, lemma) AS rank FROM tiered) WHERE rank <= 3")
def o2_ranked_candidates(spark, d):
    tier = F.when(F.col("sem").isNull() | (F.col("sem") >= 0.65), 0).otherwise(1)
    return C.ranked(C.composite(pool(spark, d), "slot").withColumn("tier", tier), "slot").select("slot", "lemma", "tier", "rank")


@query(
    f"""{TOKENS}, {TERMS}, {tfidf_ctes('author', 'word', True, 2, 0.85, 20)}, tgt AS (SELECT max(author) AS t FROM best), src AS (SELECT DISTINCT author, word AS lemma FROM best), has AS (SELECT DISTINCT pos, lemma FROM tokens WHERE author = (SELECT t FROM tgt) AND pos <> 'ADP'),
    c AS (SELECT * FROM tokens WHERE pos <> 'ADP') SELECT poem_id, line_no::INT AS line_no, tok_no::INT AS tok_no FROM c WHERE ((author, lemma) IN (SELECT author, lemma FROM src) AND lemma NOT IN (SELECT lemma FROM src WHERE author = (SELECT t FROM tgt))) OR (pos IN ('ADJ', 'ADV', 'VERB') AND (pos, lemma) NOT IN (SELECT pos, lemma FROM has))"""
)
def proj_p8_replacement(spark, d):
    best = best_words(spark, d).select("author", F.col("word").alias("lemma"))
    target = best.agg(F.max("author")).head()[0]
    t = R.content(tokens(spark, d)).withColumn("target", F.lit(target))
    vocabulary = t.filter(F.col("author") == target).select("target", "pos", "lemma")
    out = C.should_replace(t, best, best.filter(F.col("author") == target).withColumnRenamed("author", "target"), vocabulary)
    return out.filter("replace").select("poem_id", "line_no", "tok_no")


@query(f"{CONTENT}, n AS (SELECT author, lemma, pos, feats, word, count(*) AS n FROM content GROUP BY ALL) SELECT author, lemma, pos, feats, word AS surface FROM n QUALIFY row_number() OVER (PARTITION BY author, lemma, pos, feats ORDER BY n DESC, word) = 1")
def a8_morph_lookup(spark, d):
    return C.morph_lookup(R.content(tokens(spark, d)), ["author"])


@query(
    f"""{CONTENT}, n AS (SELECT author, lemma, pos, feats, word, count(*) AS n FROM content GROUP BY ALL), own AS (SELECT author, lemma, pos, feats, word FROM n QUALIFY row_number() OVER (PARTITION BY author, lemma, pos, feats ORDER BY n DESC, word) = 1),
    m AS (SELECT lemma, pos, feats, word, count(*) AS n FROM content GROUP BY ALL), pooled AS (SELECT lemma, pos, feats, word FROM m QUALIFY row_number() OVER (PARTITION BY lemma, pos, feats ORDER BY n DESC, word) = 1),
    top AS (SELECT author FROM poems GROUP BY 1 ORDER BY count(*) DESC, author LIMIT 3), wanted AS (SELECT t.author, p.lemma, p.pos, p.feats FROM (SELECT DISTINCT lemma, pos, feats FROM pooled) p, top t)
    SELECT CASE WHEN o.word IS NOT NULL THEN 'exact' ELSE 'cross_author' END AS tier, count(*) AS n, count(DISTINCT coalesce(o.word, p.word)) AS n_forms FROM wanted w LEFT JOIN own o USING (author, lemma, pos, feats) JOIN pooled p USING (lemma, pos, feats) GROUP BY 1"""
)
def j19_surface_forms(spark, d):
    from .join_queries import targets

    t = R.content(tokens(spark, d))
    own, pooled = C.morph_lookup(t, ["author"]), C.morph_lookup(t, [])
    wanted = J.with_targets(pooled.select("lemma", "pos", "feats").withColumn("_none", F.lit(None).cast("string")), targets(spark, d, 3), "_none").select(F.col("target").alias("author"), "lemma", "pos", "feats")
    return C.surface_forms(wanted, own, pooled).groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("surface").alias("n_forms"))


@query(f"{TOKENS} SELECT DISTINCT feats, pos, 0::BIGINT AS n_relaxed FROM tokens")
def t28_relaxed_features(spark, d):
    t = tokens(spark, d).select("feats", "pos").distinct()
    return t.select("feats", "pos", F.size(T.relaxed_features(T.parse_features(F.col("feats")), F.col("pos"))).cast("bigint").alias("n_relaxed"))


@query(
    rf"""{TOKENS}, v AS (SELECT lemma, count(*) AS n FROM tokens WHERE pos = 'VERB' GROUP BY 1), g AS (SELECT DISTINCT word FROM tokens WHERE regexp_matches(word, 'јќи$')), s AS (SELECT word, regexp_replace(word, 'јќи$', '') AS stem FROM g),
    c AS (SELECT word, stem, unnest(list_distinct([stem, regexp_replace(stem, '[аеи]$', '') || 'и', regexp_replace(stem, '[аеи]$', '') || 'е'])) AS lemma FROM s), f AS (SELECT word, arg_max(lemma, (n, lemma)) AS lemma FROM c JOIN v USING (lemma) GROUP BY 1)
    SELECT s.word, coalesce(f.lemma, CASE WHEN stem LIKE '%е' THEN regexp_replace(stem, '[аеи]$', '') || 'и' ELSE stem END) AS lemma, f.lemma IS NOT NULL AS known FROM s LEFT JOIN f USING (word)"""
)
def t29_gerunds(spark, d):
    t = tokens(spark, d)
    verbs = t.filter("pos = 'VERB'").groupBy("lemma").agg(F.count("*").alias("n"))
    return C.gerund_lemmas(t.filter(F.col("word").rlike(f"{C.GERUND}$")).select("word").distinct(), verbs)


@query(
    r"""WITH r AS (SELECT DISTINCT rule_id, word, pos, lemma_fix FROM pos_corrections WHERE word IS NOT NULL), n AS (SELECT word, pos, count(*) AS c FROM r GROUP BY 1, 2), s AS (SELECT word, pos, sum(c) OVER (PARTITION BY word) AS n_word, c / sum(c) OVER (PARTITION BY word) AS tag_share FROM n),
    f AS (SELECT rule_id, unnest(list_filter([CASE WHEN regexp_matches(word, '[Ѐ-ӿ]') AND regexp_matches(word, '[A-Za-z]') THEN 'mixed_script' END, CASE WHEN NOT regexp_matches(word, '[Ѐ-ӿ]') THEN 'non_cyrillic' END, CASE WHEN coalesce(lemma_fix, '') = '' THEN 'empty_lemma' END,
      CASE WHEN pos = 'PROPN' AND lower(word) = word THEN 'lowercase_propn' END, CASE WHEN n_word >= 4 AND tag_share <= 0.2::DOUBLE THEN 'unstable_tag' END, CASE WHEN pos IN ('X', 'SYM') THEN 'unknown_tag' END, CASE WHEN regexp_matches(lemma_fix, '[^\p{L}\-'']') THEN 'bad_lemma' END], lambda x: x IS NOT NULL)) AS reason FROM r JOIN s USING (word, pos))
    SELECT reason, count(*) AS n FROM f GROUP BY 1"""
)
def t30_flags(spark, d):
    r = table(spark, d, "pos_corrections").filter("word is not null").select("rule_id", "word", "pos", F.col("lemma_fix").alias("lemma")).distinct()
    return C.flag_reasons(C.with_tag_shares(r)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"{CONTENT} SELECT poem_id, string_agg(rank || '. ' || word || ' [' || pos || ']', chr(10) ORDER BY rank) AS spec FROM (SELECT *, row_number() OVER (PARTITION BY poem_id ORDER BY line_no, tok_no) AS rank FROM content) WHERE rank <= 5 GROUP BY 1")
def t25_slot_specs(spark, d):
    return C.slot_spec(S.top_n(R.content(tokens(spark, d)), ["poem_id"], [F.col("line_no"), F.col("tok_no")], 5))


@query(rf"""{POEMS} SELECT poem_id, 'X' || substr(text, 3, 3) || 'YY' || substr(text, 8) AS spliced FROM poems WHERE length(text) >= 10""")
def t19_spliced(spark, d):
    edit = lambda a, b, put: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(put).alias("put"))
    return poems(spark, d).filter(F.length("text") >= 10).select("poem_id", T.splice(F.col("text"), F.array(edit(5, 7, "YY"), edit(0, 2, "X"))).alias("spliced"))


def norm_lines(spark, d):
    return R.line_table(poems(spark, d)).withColumn("norm", T.normalized_line(F.col("line"))).filter("norm <> ''").select("author", "poem_id", "line_no", "norm")


@query(f"{TOKENS}, l AS (SELECT author, poem_id, line_no, string_agg(word, ' ' ORDER BY tok_no) AS norm FROM tokens GROUP BY 1, 2, 3), o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY author, norm ORDER BY poem_id, line_no) = 1) SELECT author, poem_id, line_no::INT AS line_no, norm FROM o QUALIFY row_number() OVER (PARTITION BY author, poem_id ORDER BY line_no) <= 2")
def w9_line_quota(spark, d):
    return Q.quota_lines(norm_lines(spark, d), "author", "poem_id", "norm", ["line_no"])


@query()
def w9_line_quota_exact(spark, d):
    """The same with lines that one poem's quota turned away taken from a later poem."""
    return Q.quota_lines(norm_lines(spark, d), "author", "poem_id", "norm", ["line_no"], exact=True)


@query()
def w10_exclusive_claims(spark, d):
    """One line of each cluster and author, the smallest cluster first, no poem twice."""
    lines = w9_line_quota(spark, d).withColumn("cluster", F.pmod(F.length("norm"), F.lit(5)).cast("int"))
    return Q.claim_exclusively(lines, "author", "cluster", "poem_id", "line_no")


@query()
def w11_least_used(spark, d):
    """For each slot the candidate that its poem used least so far."""
    t = R.content(tokens(spark, d))
    top = C.ranked(C.composite(pool(spark, d), "slot").withColumn("tier", F.lit(0)), "slot").groupBy("slot").agg(F.collect_list(F.struct("lemma", "score")).alias("candidates"))
    slots = t.select("poem_id", (F.col("line_no") * 1000 + F.col("tok_no")).alias("place"), F.concat_ws("|", "author", "pos").alias("slot"))
    return Q.least_used(slots.join(top, "slot").select("poem_id", "place", "candidates"), "poem_id", "place")


@query(rf"{POEMS} SELECT poem_id, len(regexp_extract_all(text, '\p{{L}}+'))::BIGINT AS n_words, 0::BIGINT AS n_absent FROM poems")
def w12_word_spans(spark, d):
    p = poems(spark, d).select("poem_id", "text", F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0).alias("words"))
    s = Q.word_spans(p, ["poem_id"], "text", "words")
    return s.select("poem_id", F.size("spans").cast("bigint").alias("n_words"), F.size(F.filter("spans", lambda x: x < 0)).cast("bigint").alias("n_absent"))


@query(
    f"""WITH {SPLITS}, p AS (SELECT DISTINCT s.split, p.poem_id, p.author FROM splits s JOIN poem_splits p ON p.poem_id = s.poem_id AND lower(regexp_replace(p.split, '^\\s+|\\s+$', '', 'g')) = s.split WHERE p.poem_id IS NOT NULL AND p.author IS NOT NULL),
    q AS (SELECT *, count(*) OVER (PARTITION BY split, author) AS size, count(*) OVER (PARTITION BY split) AS n FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY size DESC, md5(split || '|' || author), author, md5(split || '|' || poem_id), poem_id) - 1 AS k FROM q)
    SELECT split, poem_id, author, (CASE WHEN k < (n + 1) // 2 THEN 2 * k ELSE 2 * (k - (n + 1) // 2) + 1 END)::INT AS place FROM r"""
)
def w13_no_neighbours(spark, d):
    """Poems of each split in an order in which neighbours have different authors."""
    label = F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split")
    s = table(spark, d, "poem_splits").select(label, "poem_id", "author")
    return Q.order_without_neighbours(s, "split", "poem_id", "author")


@query()
def k6_k_means(spark, d):
    """Clusters of vectors within each label."""
    return Q.k_means(table(spark, d, "embeddings"), "label", "embedding", "vec_id", k=3).withColumn("distance", r6("distance"))
