"""Queries of joins, set operations, samples and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stihora.functions import text as T
from stihora.operators import joins as J
from stihora.operators import relations as R
from stihora.operators import sampling as P
from stihora.operators import stylometry as S

from .registry import CONTENT, GENERATED, LINES, POEMS, TOKENS, generated, poems, query, sql_lines, tokens
from .style_queries import ELIGIBLE_WORDS, VOCAB, _top, eligible_words, r6, tfidf_ctes
from .tables import table
from .text_queries import PAIRED, paired

SPLITS = r"""splits AS (SELECT DISTINCT poem_id, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) AS split FROM poem_splits WHERE split IS NOT NULL)"""


def splits(spark, d):
    return table(spark, d, "poem_splits").filter("split is not null").select("poem_id", F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split")).distinct()


@query(f"{POEMS}, {GENERATED} SELECT example_id, poem_id, author FROM examples JOIN poems ON source_poem_id = poem_id")
def j1_source_of_example(spark, d):
    known = poems(spark, d).select("poem_id", "author")
    wanted = generated(spark, d).select("example_id", F.col("source_poem_id").alias("poem_id"))
    return J.require_match(wanted.join(known, "poem_id", "left_semi"), known, ["poem_id"])


@query(f"{POEMS}, {GENERATED} SELECT example_id, source_poem_id, author FROM examples LEFT JOIN poems ON source_poem_id = poem_id")
def j2_left_lookup(spark, d):
    known = poems(spark, d).select(F.col("poem_id").alias("source_poem_id"), "author")
    return generated(spark, d).select("example_id", "source_poem_id").join(known, "source_poem_id", "left")


@query(f"{POEMS}, {SPLITS} SELECT poem_id, author FROM poems WHERE poem_id IN (SELECT poem_id FROM splits WHERE split = 'val')")
def j3_poems_in_split(spark, d):
    return poems(spark, d).select("poem_id", "author").join(splits(spark, d).filter("split = 'val'"), "poem_id", "left_semi")


@query("SELECT DISTINCT poem_id FROM stripped_songs s WHERE NOT EXISTS (SELECT 1 FROM synthetic_dataset g WHERE g.source_poem_id = s.poem_id)")
def j4_not_done_yet(spark, d):
    done = table(spark, d, "synthetic_dataset").select(F.col("source_poem_id").alias("poem_id"))
    return J.todo(table(spark, d, "stripped_songs").select("poem_id").distinct(), done, ["poem_id"])


TARGETS = "targets AS (SELECT author AS target FROM poems GROUP BY 1 ORDER BY count(*) DESC, author LIMIT 5)"


def targets(spark, d, n=5):
    """The n authors with most poems; a short list by its definition."""
    best = poems(spark, d).groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(n)
    return [r.author for r in best.collect()]


@query(f"{POEMS}, {TARGETS} SELECT poem_id, target, sample_index::INT AS sample_index FROM poems, targets, range(2) r(sample_index) WHERE author <> target")
def j5_pairs_with_targets(spark, d):
    return J.with_targets(poems(spark, d).select("poem_id", "author"), targets(spark, d), "author", samples=2).select("poem_id", "target", "sample_index")


@query(f"{POEMS}, {TARGETS} SELECT target FROM targets")
def o3_target_authors(spark, d):
    best = poems(spark, d).groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(5)
    return best.select(F.col("author").alias("target"))


_RULE = "arg_max(struct_pack(correction := correction, lemma_fix := lemma_fix), rule_id) AS v"
J6_SQL = f"""{TOKENS}, r0 AS (SELECT lower(word) AS w, pos AS p, {_RULE} FROM pos_corrections WHERE scope IS NULL OR scope NOT IN ('row', 'poem') GROUP BY 1, 2),
r1 AS (SELECT lower(word) AS w, pos AS p, poem_id, {_RULE} FROM pos_corrections WHERE scope = 'poem' GROUP BY 1, 2, 3),
r2 AS (SELECT lower(word) AS w, pos AS p, poem_id, regexp_replace(lower(context), '[^\\p{{L}}]+', '', 'g') AS c, {_RULE} FROM pos_corrections WHERE scope = 'row' GROUP BY 1, 2, 3, 4),
tl AS (SELECT tokens.*, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') AS c FROM tokens JOIN lines USING (poem_id, author, line_no)),
ruled AS (SELECT t.* EXCLUDE (c), coalesce(r2.v, r1.v, r0.v) AS rule FROM tl t LEFT JOIN r0 ON r0.w = t.word AND r0.p = t.pos LEFT JOIN r1 ON r1.w = t.word AND r1.p = t.pos AND r1.poem_id = t.poem_id
  LEFT JOIN r2 ON r2.w = t.word AND r2.p = t.pos AND r2.poem_id = t.poem_id AND r2.c = t.c)"""


def ruled(spark, d):
    """Tokens with their rule; rules of one row are told by the letters of the line they quote."""
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")
    rules = table(spark, d, "pos_corrections").withColumn("context", letters("context"))
    lined = R.line_table(poems(spark, d)).select("poem_id", "author", "line_no", letters("line").alias("context"))
    return J.scoped_lookup(tokens(spark, d).join(lined, ["poem_id", "author", "line_no"]), rules, "word", "pos", ["correction", "lemma_fix"], context="context").drop("context")


@query(f"{J6_SQL} SELECT poem_id, line_no::INT AS line_no, tok_no::INT AS tok_no, word, rule.correction AS correction, rule.lemma_fix AS lemma_fix FROM ruled WHERE rule IS NOT NULL")
def j6_scoped_lookup(spark, d):
    return ruled(spark, d).filter("rule is not null").select("poem_id", "line_no", "tok_no", "word", "rule.correction", "rule.lemma_fix")


@query(
    f"""{J6_SQL} SELECT coalesce(nullif(rule.correction, ''), pos) AS new_pos, count(*) AS n, count(*) FILTER (lower(rule.lemma_fix) <> lemma) AS n_lemmas FROM ruled
    WHERE rule IS NULL OR rule.correction IS NULL OR rule.correction <> 'DROP' GROUP BY 1"""
)
def j6_corrected(spark, d):
    both = J.apply_corrections(ruled(spark, d).withColumn("before", F.col("lemma")))
    return both.groupBy(F.col("pos").alias("new_pos")).agg(F.count("*").alias("n"), F.count_if(F.col("lemma") != F.col("before")).alias("n_lemmas"))


#: A term is a lemma with its part of speech.
PAIRS = "pairs AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM sets a JOIN sets b ON a.poem_id = b.poem_id AND a.term < b.term GROUP BY 1, 2)"
COOC = f"{CONTENT}, sets AS (SELECT DISTINCT poem_id, lemma || '|' || pos AS term FROM content), {PAIRS}"


def term_sets(spark, d):
    """The different terms x of each poem; a blank text has none, so only authors are required."""
    songs = R.latest(table(spark, d, "stripped_songs"), ["poem_id"], "ingested_at")
    return R.term_sets(R.required(songs, "author"), "song_text")


def terms(spark, d):
    return R.content(tokens(spark, d)).select("poem_id", F.concat_ws("|", "lemma", "pos").alias("term"))


@query(f"{COOC} SELECT a, b, n FROM pairs")
def j7_cooccurrence(spark, d):
    return J.cooccurring(term_sets(spark, d))


@query(f"{COOC} SELECT a, b, n FROM pairs UNION ALL SELECT b, a, n FROM pairs")
def j8_symmetric(spark, d):
    return J.symmetric(J.cooccurring(term_sets(spark, d)))


J9 = f"""{CONTENT}, busy AS (SELECT author FROM poems GROUP BY 1 HAVING count(*) >= 5), sets AS (SELECT DISTINCT author, lemma FROM content WHERE author IN (SELECT author FROM busy)), size AS (SELECT author, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.author AS a, b.author AS b, count(*) AS n_common FROM sets a JOIN sets b ON a.lemma = b.lemma AND a.author < b.author GROUP BY 1, 2),
alike AS (SELECT a, b, n_common, n_common / (x.n + y.n - n_common) AS jaccard FROM common JOIN size x ON x.author = a JOIN size y ON y.author = b WHERE n_common / (x.n + y.n - n_common) >= 0.15)"""


def similar_authors(spark, d):
    return J.jaccard_pairs(R.eligible(R.content(tokens(spark, d))), "author", "lemma", 0.15)


@query(f"{J9} SELECT a, b, n_common, round(jaccard, 6) AS jaccard FROM alike")
def j9_author_jaccard(spark, d):
    return similar_authors(spark, d).withColumn("jaccard", r6("jaccard"))


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, a.label AS block, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3"""
)
def j10_cosine_pairs(spark, d):
    return J.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3).withColumn("cosine", F.round("cosine", 5))


@query(
    f"""{CONTENT}, stored AS (SELECT DISTINCT lemma, pos, feats FROM content) SELECT a.lemma, a.pos, a.feats AS wanted, count(*) AS n FROM stored a JOIN stored b ON a.lemma = b.lemma AND a.pos = b.pos AND a.feats = b.feats GROUP BY ALL"""
)
def j11_containment(spark, d):
    stored = R.content(tokens(spark, d)).select("lemma", "pos", "feats").distinct().withColumn("have", T.parse_features(F.col("feats")))
    wanted = stored.select("lemma", "pos", F.col("feats").alias("wanted"), F.col("have").alias("want"))
    return J.containment(stored.drop("feats"), wanted, ["lemma", "pos"], "have", "want").groupBy("lemma", "pos", "wanted").agg(F.count("*").alias("n"))


GEN_LINES = rf"""{PAIRED}, gl AS (SELECT example_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT example_id, {sql_lines("gen")} AS ls FROM paired)),
sl AS (SELECT example_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS src_no FROM (SELECT example_id, {sql_lines("src")} AS ls FROM paired)),
g AS (SELECT *, regexp_extract_all(lower(line), '\p{{L}}+') AS w FROM gl), s AS (SELECT *, regexp_extract_all(lower(line), '\p{{L}}+') AS w FROM sl)"""


def _lines(spark, d, col):
    return R.line_table(paired(spark, d), "example_id", col, ()).withColumn("words", T.words(F.col("line"))).drop("line")


@query(
    f"""{GEN_LINES}, m AS (SELECT example_id, line_no, src_no, CASE WHEN len(g.w) + len(s.w) > 0 THEN len(list_intersect(g.w, s.w)) / len(list_distinct(g.w || s.w)) ELSE 0 END AS sim FROM g JOIN s USING (example_id)),
    p AS (SELECT example_id, avg(x) AS precision FROM (SELECT example_id, line_no, max(sim) AS x FROM m GROUP BY 1, 2) GROUP BY 1), r AS (SELECT example_id, avg(x) AS recall FROM (SELECT example_id, src_no, max(sim) AS x FROM m GROUP BY 1, 2) GROUP BY 1)
    SELECT example_id, round(precision + 1e-9, 5)::DOUBLE AS precision, round(recall + 1e-9, 5)::DOUBLE AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END + 1e-9, 5)::DOUBLE AS f1 FROM p JOIN r USING (example_id)"""
)
def j12_best_line_matches(spark, d):
    from stihora.functions import numeric as N

    gen = _lines(spark, d, "gen").withColumnsRenamed({"line_no": "gen_no", "words": "g"})
    src = _lines(spark, d, "src").withColumnsRenamed({"line_no": "src_no", "words": "s"})
    scores = gen.join(src, "example_id").select("example_id", "gen_no", "src_no", N.jaccard(F.col("g"), F.col("s")).alias("sim"))
    return J.best_matches(scores, "example_id").withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("precision", "recall", "f1")})


@query(
    f"""{GEN_LINES}, j AS (SELECT g.example_id, g.line_no, any_value(g.w) AS w, max(len(list_intersect(g.w, s.w)) / len(list_distinct(g.w))) AS part, bool_or(g.w = s.w) AS same FROM g LEFT JOIN s USING (example_id) WHERE len(g.w) > 0 GROUP BY 1, 2),
    n AS (SELECT example_id, count(*) AS n_lines, count(*) FILTER (CASE WHEN len(w) >= 3 THEN coalesce(part, 0) >= 0.75 ELSE coalesce(same, false) END) AS n_copied FROM j GROUP BY 1)
    SELECT example_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_copied, 0) AS n_copied, round(CASE WHEN n_lines > 0 THEN 1 - n_copied / n_lines ELSE 0 END, 6)::DOUBLE AS novelty FROM (SELECT DISTINCT example_id FROM g) LEFT JOIN n USING (example_id)"""
)
def j13_copy_novelty(spark, d):
    return J.copied_lines(_lines(spark, d, "gen"), _lines(spark, d, "src"), "example_id").withColumn("novelty", r6("novelty"))


TERMS = ELIGIBLE_WORDS.removeprefix(LINES).lstrip(", ")
MAJOR_LEMMA = "counted AS (SELECT word, lemma, count(*) AS n, min((poem_id, line_no, tok_no)) AS first FROM tokens GROUP BY ALL), major AS (SELECT word, lemma FROM counted QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, first) = 1)"


@query(
    f"""{TOKENS}, {MAJOR_LEMMA}, {TERMS}, {tfidf_ctes("author", "word", True, 2, 0.85, 20)}
    SELECT author, word, lemma, coalesce(embedding[1]::DOUBLE, -1.0::DOUBLE) AS first_value FROM best LEFT JOIN major USING (word) LEFT JOIN embeddings ON vec_id = length(lemma) * 40 + unicode(lemma) % 40"""
)
def j14_palette(spark, d):
    from stihora.operators import tfidf as I

    best = _top(I.tfidf(eligible_words(spark, d), "author", "word", sublinear=True, least_df=2, most_df=0.85), "author", "word", 20)
    lemmas = S.majority(tokens(spark, d), ["word"], ["lemma"], ["poem_id", "line_no", "tok_no"]).drop("n")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("first_value"))
    keyed = best.join(lemmas, "word", "left").withColumn("vec_id", (F.length("lemma") * 40 + F.ascii("lemma") % 40).cast("bigint"))
    return keyed.join(vectors, "vec_id", "left").select("author", "word", "lemma", F.coalesce("first_value", F.lit(-1.0)).alias("first_value"))


@query(
    f"""{J9}, {VOCAB}, both_ways AS (SELECT a, b, jaccard FROM alike UNION ALL SELECT b, a, jaccard FROM alike), donors AS (SELECT a AS author, b AS donor FROM both_ways QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(jaccard, 9) DESC, b) <= 3)
    SELECT donors.author, donor, pos, count(*) AS n_candidates FROM donors JOIN vocab ON vocab.author = donor GROUP BY ALL"""
)
def j15_donors(spark, d):
    both = J.symmetric(similar_authors(spark, d).select("a", "b", "jaccard"))
    donors = S.top_n(both, ["a"], [F.round("jaccard", 9).desc(), F.col("b")], 3).select(F.col("a").alias("author"), F.col("b").alias("donor"))
    vocabulary = S.vocabulary(R.content(tokens(spark, d))).withColumnRenamed("author", "donor")
    return donors.join(vocabulary, "donor").groupBy("author", "donor", "pos").agg(F.count("*").alias("n_candidates"))


@query("SELECT DISTINCT run, poem_id FROM scored_poems WHERE poem_id IN (SELECT poem_id FROM scored_poems GROUP BY 1 HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM scored_poems) - 1)")
def j16_common_keys(spark, d):
    runs = table(spark, d, "scored_poems").select("run", "poem_id").distinct()
    n = runs.select("run").distinct().agg((F.count("*") - 1).alias("_all"))
    shared = runs.groupBy("poem_id").agg(F.count("*").alias("_n")).join(F.broadcast(n)).filter("_n = _all").select("poem_id")
    return runs.join(shared, "poem_id", "left_semi")


@query("SELECT poem_id FROM (SELECT poem_id FROM scored_poems WHERE run = 'baseline' INTERSECT SELECT poem_id FROM scored_poems WHERE run = 'rescored')")
def x3_intersection(spark, d):
    scored = table(spark, d, "scored_poems")
    return scored.filter("run = 'baseline'").select("poem_id").intersect(scored.filter("run = 'rescored'").select("poem_id"))


@query("SELECT poem_id FROM scored_poems WHERE run = 'baseline' EXCEPT SELECT poem_id FROM scored_poems WHERE run = 'judge_v2'")
def x4_difference(spark, d):
    scored = table(spark, d, "scored_poems")
    return scored.filter("run = 'baseline'").select("poem_id").subtract(scored.filter("run = 'judge_v2'").select("poem_id"))


@query("SELECT example_id, target_author, 'a' AS part FROM synthetic_dataset WHERE split = 'train' UNION ALL SELECT example_id, target_author, 'b' FROM synthetic_dataset WHERE split <> 'train'")
def x1_union_of_parts(spark, d):
    g = table(spark, d, "synthetic_dataset")
    a, b = g.filter("split = 'train'"), g.filter("split <> 'train'")
    return a.select("example_id", "target_author", F.lit("a").alias("part")).unionByName(b.select("target_author", "example_id", F.lit("b").alias("part")))


@query(
    """WITH t AS (SELECT DISTINCT source_poem_id, target_author, sample_index FROM synthetic_dataset WHERE split = 'val'), p AS (SELECT *, row_number() OVER (PARTITION BY source_poem_id, target_author, sample_index ORDER BY target_author) AS rn FROM synthetic_dataset)
    SELECT source_poem_id, target_author, sample_index FROM p WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.source_poem_id = p.source_poem_id AND t.target_author = p.target_author AND t.sample_index = p.sample_index)"""
)
def x2_insert_absent(spark, d):
    key = ["source_poem_id", "target_author", "sample_index"]
    g = table(spark, d, "synthetic_dataset")
    parts = g.select(*key, "generated_poem", F.col("target_author").alias("part"))
    return J.insert_absent(g.filter("split = 'val'").select(*key), parts, key, "part").select(*key)


@query(f"{TOKENS}, p AS (SELECT pos, count(*) AS n FROM tokens GROUP BY 1), q AS (SELECT author, pos, count(*) AS n FROM tokens GROUP BY 1, 2) SELECT author, pos, p.n - q.n AS rest FROM q JOIN p USING (pos) WHERE p.n - q.n > 0")
def x6_bag_difference(spark, d):
    n = tokens(spark, d).groupBy("author", "pos").agg(F.count("*").alias("n"))
    return n.withColumn("rest", F.sum("n").over(Window.partitionBy("pos")) - F.col("n")).filter("rest > 0").select("author", "pos", "rest")


@query(f"{POEMS}, {TARGETS} SELECT poem_id, author FROM poems WHERE author = (SELECT max(target) FROM targets)")
def x7_rows_of_one_author(spark, d):
    return poems(spark, d).filter(F.col("author") == max(targets(spark, d))).select("poem_id", "author")


@query("SELECT author, song_title, count(DISTINCT poem_id) AS n, CASE WHEN count(DISTINCT poem_id) = 1 THEN min(poem_id) END AS poem_id, CASE WHEN count(DISTINCT poem_id) > 1 THEN count(DISTINCT poem_id) || ' candidates' END AS error FROM stripped_songs GROUP BY 1, 2")
def j20_resolve_unique(spark, d):
    return J.resolve_unique(table(spark, d, "stripped_songs"), ["author", "song_title"], "poem_id")


@query("SELECT run, coalesce(a.model, b.model) AS file FROM (SELECT DISTINCT model || '' AS run FROM synthetic_dataset) r LEFT JOIN (SELECT DISTINCT model FROM synthetic_dataset) a ON a.model = run || '_test' LEFT JOIN (SELECT DISTINCT model FROM synthetic_dataset) b ON b.model = run")
def j21_label_alias(spark, d):
    models = table(spark, d, "synthetic_dataset").select("model").distinct()
    return J.first_of_aliases(models.withColumnRenamed("model", "run"), models, "run", "model").select("run", "file")


@query(
    f"""{ELIGIBLE_WORDS}, {tfidf_ctes("author", "word", True, 2, 0.85, 5)}
    SELECT p.author, word FROM (SELECT DISTINCT author FROM poems) p JOIN best USING (author)"""
)
def j22_fallback_pool(spark, d):
    from stihora.operators import tfidf as I

    best = _top(I.tfidf(eligible_words(spark, d), "author", "word", sublinear=True, least_df=2, most_df=0.85), "author", "word", 5)
    return poems(spark, d).select("author").distinct().join(best.select("author", "word"), "author")


def _ordered(key):
    return f"md5('42|' || {key}::VARCHAR), {key}"


@query(f"SELECT doc_id FROM documents ORDER BY {_ordered('doc_id')} LIMIT 50")
def o7_sample(spark, d):
    return P.sample_n(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_ordered('doc_id')}) <= greatest(1, round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY source), 0))")
def o8_stratified(spark, d):
    return P.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.1)


@query(
    f"""{POEMS}, n AS (SELECT poem_id, author, row_number() OVER (PARTITION BY author ORDER BY {_ordered('poem_id')}) AS r, count(*) OVER (PARTITION BY author) AS n FROM poems), h AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1::DOUBLE, 0)) ELSE 0 END AS k FROM n)
    SELECT poem_id, author, CASE WHEN r <= k THEN 'val' WHEN r <= 2 * k THEN 'test' ELSE 'train' END AS split FROM h"""
)
def o9_split(spark, d):
    return P.split(poems(spark, d).select("poem_id", "author"), "author", "poem_id")


@query(f"{POEMS}, n AS (SELECT poem_id, author, len({sql_lines('text')}) BETWEEN 8 AND 30 AS good FROM poems) SELECT poem_id, author, good FROM n QUALIFY row_number() OVER (PARTITION BY author ORDER BY good DESC, {_ordered('poem_id')}) <= 3")
def o10_sample_per_group(spark, d):
    p = poems(spark, d).select("poem_id", "author", F.size(T.lines(F.col("text"))).between(8, 30).alias("good"))
    return P.sample_per_group(p, "author", "poem_id", 3, prefer=F.col("good"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_ordered('doc_id')}) - 1 AS place FROM documents")
def o11_shuffled(spark, d):
    docs = table(spark, d, "documents").select("doc_id").withColumn("h", P.draw(F.col("doc_id")))
    return R.dense_ids(docs, ["h", "doc_id"], "place").select("doc_id", F.col("place").cast("bigint").alias("place"))


@query(
    f"""{POEMS}, l AS (SELECT poem_id AS a, author AS group_a, row_number() OVER (ORDER BY md5('42|' || poem_id::VARCHAR), poem_id) AS i FROM poems), r AS (SELECT poem_id AS b, author AS group_b, row_number() OVER (ORDER BY md5('42b|' || poem_id::VARCHAR), poem_id) AS i FROM poems)
    SELECT a, b, group_a, group_b FROM l JOIN r USING (i) WHERE group_a <> group_b ORDER BY i LIMIT 200"""
)
def o12_random_pairs(spark, d):
    return P.random_pairs(poems(spark, d), "poem_id", "author", 200)


@query("SELECT run, poem_id, quality FROM scored_poems ORDER BY quality DESC NULLS LAST, run, poem_id LIMIT 100")
def o1_ordered_top(spark, d):
    return table(spark, d, "scored_poems").select("run", "poem_id", "quality").orderBy(F.col("quality").desc_nulls_last(), "run", "poem_id").limit(100)


@query("SELECT clf_predicted, arg_max(poem_id, (quality, -poem_id)) AS best FROM scored_poems WHERE quality IS NOT NULL GROUP BY 1")
def o6_argmax(spark, d):
    scored = table(spark, d, "scored_poems").filter("quality is not null")
    return scored.groupBy("clf_predicted").agg(F.max_by("poem_id", F.struct("quality", -F.col("poem_id"))).alias("best"))


@query("SELECT target_author, arg_min(example_id, (coalesce(source_poem_id, -1), sample_index, example_id)) AS first_example FROM synthetic_dataset GROUP BY 1")
def o14_first_match(spark, d):
    return table(spark, d, "synthetic_dataset").groupBy("target_author").agg(F.min_by("example_id", F.struct(F.coalesce("source_poem_id", F.lit(-1)), "sample_index", "example_id")).alias("first_example"))


@query("SELECT source_poem_id, target_author, min(example_id) AS first_seen FROM synthetic_dataset GROUP BY 1, 2")
def o15_ordered_distinct(spark, d):
    return table(spark, d, "synthetic_dataset").groupBy("source_poem_id", "target_author").agg(F.min("example_id").alias("first_seen"))


O16 = rf"""{POEMS}, st AS (SELECT poem_id, unnest(s) AS stanza, generate_subscripts(s, 1) AS stanza_no FROM (SELECT poem_id, [x for x in string_split(regexp_replace(text, '^{T.WS}+|{T.WS}+$', '', 'g'), chr(10) || chr(10)) if regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g') <> ''] AS s FROM poems WHERE contains(author, 'Тихорина')))"""


@query(f"{O16} SELECT poem_id, stanza_no::INT AS stanza_no, stanza FROM st WHERE len({sql_lines('stanza')}) >= 4 ORDER BY poem_id, stanza_no LIMIT 1")
def o16_first_stanza(spark, d):
    s = R.stanza_table(poems(spark, d).filter(F.contains("author", F.lit("Тихорина"))), keep=())
    return s.filter(F.size(T.lines(F.col("stanza"))) >= 4).orderBy("poem_id", "stanza_no").limit(1).select("poem_id", "stanza_no", "stanza")


@query("SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*), label)::INT AS place FROM embeddings GROUP BY 1")
def o17_smallest_first(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("n", "label")))


@query(f"{TOKENS}, first_words AS (SELECT poem_id, list(word ORDER BY line_no, tok_no) AS ws FROM tokens GROUP BY 1) SELECT poem_id, len(ws)::INT AS n_words, len(ws)::INT AS n_aligned FROM first_words")
def j17_align_itself(spark, d):
    stream = tokens(spark, d).groupBy("poem_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "tok_no", "word"))).alias("s")).select("poem_id", F.transform("s", lambda x: x["word"]).alias("stream"))
    return J.align_words(stream.withColumn("words", F.col("stream")), "words", "stream", ["poem_id"]).select("poem_id", "n_words", "n_aligned")


@query()
def j18_best_aligned_source(spark, d):
    """For each example the poem of its source author that covers most of its words; the smallest id of equal ones."""
    gen = generated(spark, d).filter("generated_poem is not null").select("example_id", F.col("source_author").alias("author"), T.words(F.col("generated_poem"), T.WORD_CHARS).alias("words"))
    src = poems(spark, d).select("author", "poem_id", T.words(F.col("text"), T.WORD_CHARS).alias("stream"))
    found = J.best_aligned(gen, src, "author", "example_id", "poem_id")
    return found.select("example_id", "poem_id", r6(F.when(F.col("n_words") > 0, F.col("n_aligned") / F.col("n_words")).otherwise(0.0)).alias("coverage"))
