"""Joins with a meaning of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails while running if a row of the left side has no partner."""
    marked = right.withColumn("_found", F.lit(True))
    joined = left.join(marked, on, "left")
    key = F.concat_ws(", ", *(F.col(c).cast("string") for c in on))
    return joined.withColumn("_found", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no partner for "), key)).cast("boolean")).otherwise(True)).filter("_found").drop("_found")


def todo(wanted: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is wanted and not done yet; failures are not in `done`, so they come again."""
    return wanted.join(done.select(*on).distinct(), on, "left_anti")


def with_targets(df: DataFrame, targets: list[str], own: str, samples: int = 1) -> DataFrame:
    """Each row with every target but its own, and with every sample number.

    The targets are a short list that is chosen first, so rows are multiplied
    in place, without a join.
    """
    each = F.explode(F.array(*map(F.lit, targets))) if targets else F.explode(F.array().cast("array<string>"))
    return df.withColumn("target", each).filter(F.col(own).isNull() | (F.col(own) != F.col("target"))).withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def scoped_lookup(df: DataFrame, rules: DataFrame, word: str, pos: str, value: list[str], poem: str = "poem_id", context: str | None = None) -> DataFrame:
    """df with the rule of the most specific scope: its row, else its poem, else everywhere.

    `rules` has word, pos, scope, poem_id, context, rule_id and the values.  A
    later rule (greater rule_id) replaces an earlier one with the same key.
    Scopes other than row and poem, null included, count as everywhere.
    """
    key = [F.lower("word").alias("_word"), F.col("pos").alias("_pos")]
    last = lambda df, keys: df.groupBy(*keys).agg(F.max_by(F.struct(*value), "rule_id").alias("_v"))
    everywhere = last(rules.filter("scope is null or scope not in ('row', 'poem')").select(*key, *value, "rule_id"), ["_word", "_pos"]).withColumnRenamed("_v", "_v0")
    poemwise = last(rules.filter("scope = 'poem'").select(*key, F.col("poem_id").alias("_poem"), *value, "rule_id"), ["_word", "_pos", "_poem"]).withColumnRenamed("_v", "_v1")
    on = [F.lower(df[word]) == F.col("_word"), df[pos] == F.col("_pos")]
    out = df.join(everywhere, on, "left").drop("_word", "_pos")
    out = out.join(poemwise, [F.lower(out[word]) == F.col("_word"), out[pos] == F.col("_pos"), out[poem] == F.col("_poem")], "left").drop("_word", "_pos", "_poem")
    found = [F.col("_v1"), F.col("_v0")]
    if context:
        rowwise = last(rules.filter("scope = 'row'").select(*key, F.col("poem_id").alias("_poem"), F.col("context").alias("_context"), *value, "rule_id"), ["_word", "_pos", "_poem", "_context"]).withColumnRenamed("_v", "_v2")
        out = out.join(rowwise, [F.lower(out[word]) == F.col("_word"), out[pos] == F.col("_pos"), out[poem] == F.col("_poem"), out[context] == F.col("_context")], "left").drop("_word", "_pos", "_poem", "_context")
        found = [F.col("_v2"), *found]
    return out.withColumn("rule", F.coalesce(*found)).drop("_v0", "_v1", "_v2")


def apply_corrections(tokens: DataFrame) -> DataFrame:
    """Tokens with their `rule` (correction, lemma_fix) applied; DROP removes a token, a new part of speech clears the features."""
    kept = tokens.filter(F.col("rule").isNull() | F.col("rule.correction").isNull() | (F.col("rule.correction") != "DROP"))
    new = F.coalesce(F.nullif(F.col("rule.correction"), F.lit("")), F.col("pos"))
    return kept.select(
        *[c for c in kept.columns if c not in ("rule", "pos", "lemma", "feats")], new.alias("pos"),
        F.coalesce(F.nullif(F.lower("rule.lemma_fix"), F.lit("")), F.col("lemma")).alias("lemma"), F.when(new == F.col("pos"), F.col("feats")).otherwise(F.lit("")).alias("feats"),
    )


def resolve_unique(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, error): the one value of each key; an error text where there are several."""
    found = df.groupBy(*keys).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value))
    return found.withColumns({value: F.when(F.col("n") == 1, F.col(value)), "error": F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" candidates")))})


def containment(stored: DataFrame, wanted: DataFrame, on: list[str], stored_map: str, wanted_map: str) -> DataFrame:
    """Rows of both sides with equal keys whose stored features hold all wanted ones."""
    joined = stored.join(wanted, on)
    return joined.filter(F.forall(F.map_entries(wanted_map), lambda e: F.coalesce(F.try_element_at(F.col(stored_map), e["key"]) == e["value"], F.lit(False))))


def common_keys(df: DataFrame, key: list[str], run: str) -> DataFrame:
    """Rows whose key stands in every run."""
    runs = df.select(run).distinct().agg(F.count("*").alias("_all"))
    shared = df.groupBy(*key).agg(F.countDistinct(run).alias("_n")).join(F.broadcast(runs)).filter("_n = _all").select(*key)
    return df.join(shared, key, "left_semi")


def first_of_aliases(runs: DataFrame, files: DataFrame, label: str, stem: str, suffix: str = "_test") -> DataFrame:
    """The file of each label: the one with the suffix, else the plain one, else null."""
    a = files.select(F.col(stem).alias("_a"))
    b = files.select(F.col(stem).alias("_b"))
    joined = runs.join(a, F.concat(F.col(label), F.lit(suffix)) == F.col("_a"), "left").join(b, F.col(label) == F.col("_b"), "left")
    return joined.withColumn("file", F.coalesce("_a", "_b")).drop("_a", "_b")


def jaccard_pairs(df: DataFrame, group: str, item: str, least: float) -> DataFrame:
    """(a, b, n_common, jaccard) of groups a < b with so similar sets of items.

    Items are ranked, rare ones first.  Two groups so similar have one of the
    first n - ceil(least * n) + 1 items of both in common, so only groups that
    share such an item are candidates, and a common item is rarely among them;
    sizes that are too different are dropped too.  What a pair has in common is
    counted for candidates only.
    """
    from stihora.storage import written

    sets = written(df.select(group, item).dropna().distinct())
    size = sets.groupBy(group).agg(F.count("*").alias("n"))
    found_in = sets.groupBy(item).agg(F.count("*").alias("_df"))
    order = F.row_number().over(Window.partitionBy(group).orderBy("_df", item))
    first = sets.join(found_in, item).withColumn("_place", order).join(size, group).filter(F.col("_place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    first = written(first.select(group, item, "n"))
    alike = first.toDF("a", item, "n_a").join(first.toDF("b", item, "n_b"), item).filter(F.col("a") < F.col("b")).filter(F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9)
    candidates = written(alike.select("a", "b").distinct())
    both = candidates.join(sets.toDF("a", item), "a").join(sets.toDF("b", item), ["b", item]).groupBy("a", "b").agg(F.count("*").alias("n_common"))
    out = both.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
    return out.withColumn("jaccard", F.col("n_common") / (F.col("n_a") + F.col("n_b") - F.col("n_common"))).filter(F.col("jaccard") >= least).select("a", "b", "n_common", "jaccard")


#: Terms of a document that are paired in one piece; terms, pairs and rows that are held at a time in a task; its most frequent terms, whose pairs are counted in a table.
TILE, TERMS_AT_A_TIME, PAIRS_AT_A_TIME, ROWS_AT_A_TIME, HEAD = 1024, 2_000_000, 2_000_000, 50_000, 1024


def cooccurrence(df: DataFrame, doc: str, term: str, tile: int = TILE) -> DataFrame:
    """(a, b, n): in how many documents two terms a < b stand together."""
    sets = df.select(doc, term).dropna().distinct().groupBy(doc).agg(F.collect_list(term).alias("x"))
    return cooccurring(sets.select("x"), tile)


def cooccurring(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b, n) as cooccurrence(), from the different terms x of each document.

    Pairs are made and counted in arrays, never as rows, and only a task's
    counts are shuffled.  A document with more than `tile` terms is cut into
    tiles, whose pairs are spread over tasks, so no document is too long for one.
    """
    from stihora.storage import written

    kind = sets.schema["x"].dataType.simpleString()
    sets = written(sets.select("x"))  # read twice
    none = F.lit(None).cast(kind)
    short = sets.filter(F.size("x") <= tile).select("x", none.alias("y"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / tile).cast("int")), lambda i: F.slice("x", i * tile + 1, tile))
    long = sets.filter(F.size("x") > tile).select(parts.alias("p")).select(F.posexplode("p").alias("i", "x"), "p")
    long = long.select("x", F.explode(F.concat(F.array(none), F.slice("p", F.col("i") + 2, F.size("p")))).alias("y")).repartition("x", "y")
    item = kind.removeprefix("array<").removesuffix(">")
    return short.union(long).mapInArrow(_counted_pairs, f"a {item}, b {item}, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within x, or of x and y where y is given, with their counts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(len(c.flatten()) for c in batch.columns)
        if size >= TERMS_AT_A_TIME:
            yield from _pairs_of(held)
            held, size = [], 0
    if size:
        yield from _pairs_of(held)


def _pairs_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms are numbered, frequent ones first; pairs of frequent terms are counted in a table, others by sorting."""
    import numpy as np
    import pyarrow.compute as pc

    xs, ys = (pa.concat_arrays([b.column(k) for b in batches]) for k in (0, 1))
    coded = pa.concat_arrays([xs.flatten(), ys.flatten()]).dictionary_encode()
    code = np.asarray(coded.indices)
    order = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")
    names = coded.dictionary.take(pa.array(order))
    number, place = np.empty((2, len(names)), np.int64)
    number[order] = place[np.asarray(pc.sort_indices(names))] = np.arange(len(names))
    ids = number[code]
    head = min(HEAD, len(names))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n_x, n_y = (np.asarray(c.value_lengths().fill_null(0), np.int64) for c in (xs, ys))
        at_x, at_y = np.cumsum(n_x) - n_x, n_x.sum() + np.cumsum(n_y) - n_y
        for n in np.unique(n_x[n_y == 0]):  # documents of one size form a matrix
            i, j = np.triu_indices(n, 1)
            at = at_x[(n_x == n) & (n_y == 0)]
            step = max(1, PAIRS_AT_A_TIME // max(1, len(i)))
            for k in range(0, len(at) if n > 1 else 0, step):
                m = np.ascontiguousarray(np.sort(ids[at[k : k + step, None] + np.arange(n)], axis=1).T)
                yield m[i].ravel(), m[j].ravel()
        for k in np.flatnonzero(n_y):
            x, y = np.meshgrid(ids[at_x[k] : at_x[k] + n_x[k]], ids[at_y[k] : at_y[k] + n_y[k]])
            yield np.minimum(x, y).ravel(), np.maximum(x, y).ravel()

    def named(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(n), ROWS_AT_A_TIME):
            x, y = a[k : k + ROWS_AT_A_TIME], b[k : k + ROWS_AT_A_TIME]
            first = place[x] < place[y]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.where(first, x, y))), names.take(pa.array(np.where(first, y, x))), pa.array(n[k : k + ROWS_AT_A_TIME], pa.int64())], names=["a", "b", "n"])

    def sorted_out(made: list) -> Iterator[pa.RecordBatch]:
        pair, n = np.unique(np.concatenate(made), return_counts=True)
        yield from named(pair >> 32, pair & 0xFFFFFFFF, n)

    table = np.zeros(head * head, np.int64)
    frequent, rest = [], []
    for a, b in pairs():
        near = b < head
        if near.all():
            frequent.append(a * head + b)
        else:
            frequent.append(a[near] * head + b[near])
            rest.append((a[~near] << 32) | b[~near])
        if sum(map(len, frequent)) > PAIRS_AT_A_TIME:
            table += np.bincount(np.concatenate(frequent), minlength=head * head)
            frequent = []
        if sum(map(len, rest)) > PAIRS_AT_A_TIME:
            yield from sorted_out(rest)
            rest = []
    if frequent:
        table += np.bincount(np.concatenate(frequent), minlength=head * head)
    if rest:
        yield from sorted_out(rest)
    found = np.flatnonzero(table)
    yield from named(found // head, found % head, table[found])


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each pair in both orders; rows are doubled in place, so pairs are made once."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(both).alias("_pair"), *rest).select("_pair.a", "_pair.b", *rest)


def cosine_pairs(df: DataFrame, key: str, vector: str, block: str, least: float, rows: int = 512) -> DataFrame:
    """(a, b, block, cosine) of vectors a < b of one block with at least such a cosine.

    A block is cut into tiles of a bounded number of rows, and two tiles at a
    time are multiplied as matrices, so a block may be larger than any task.
    """
    import numpy as np

    spec = f"a {df.schema[key].dataType.simpleString()}, b {df.schema[key].dataType.simpleString()}, block {df.schema[block].dataType.simpleString()}, cosine double"
    sizes = df.groupBy(block).agg(F.ceil(F.count("*") / rows).cast("int").alias("_tiles"))
    tiled = df.select(block, key, vector).join(sizes, block).withColumn("_tile", F.pmod(F.xxhash64(key), "_tiles").cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda t: F.struct(F.least(t, "_tile").alias("lo"), F.greatest(t, "_tile").alias("hi")))
    spread = tiled.select(block, key, vector, "_tile", F.explode(met).alias("_m")).select(block, key, vector, "_tile", "_m.lo", "_m.hi")

    def multiply(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = keys[1], keys[2]
        x, y = pdf[pdf["_tile"] == lo], pdf[pdf["_tile"] == hi]
        out: dict[str, list] = {"a": [], "b": [], "block": [], "cosine": []}
        if len(x) and len(y):
            m = [np.array(list(p[vector]), np.float64) for p in (x, y)]
            m = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in m]
            for i, j in zip(*np.nonzero((c := m[0] @ m[1].T) >= least), strict=True):
                a, b = x[key].iloc[i], y[key].iloc[j]
                if a < b or (lo != hi and a != b):
                    for name, v in zip(out, (min(a, b), max(a, b), keys[0], float(c[i, j])), strict=True):
                        out[name].append(v)
        return pd.DataFrame(out)

    return spread.groupBy(block, "lo", "hi").applyInPandas(multiply, spec)


def best_matches(scores: DataFrame, pair: str) -> DataFrame:
    """(pair, precision, recall, f1) from similarities (pair, gen_no, src_no, sim): the mean best match of either side."""
    gen = scores.groupBy(pair, "gen_no").agg(F.max("sim").alias("s")).groupBy(pair).agg(F.avg("s").alias("precision"))
    src = scores.groupBy(pair, "src_no").agg(F.max("sim").alias("s")).groupBy(pair).agg(F.avg("s").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return gen.join(src, pair).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def copied_lines(gen: DataFrame, src: DataFrame, pair: str, least: float = 0.75, short: int = 3) -> DataFrame:
    """(pair, n_lines, n_copied, novelty): lines of a generated text that stand in its source.

    A line is copied if so large a share of its different words stands in one
    line of the source; a shorter one if its words are a source line's.  Lines
    without words are left out; a text without lines has novelty 0.
    """
    match = (
        gen.select(pair, "line_no", F.explode(F.array_distinct("words")).alias("w")).join(src.select(pair, F.col("line_no").alias("src_no"), F.explode(F.array_distinct("words")).alias("w")), [pair, "w"])
        .groupBy(pair, "line_no", "src_no").agg(F.count("*").alias("n")).groupBy(pair, "line_no").agg(F.max("n").alias("n"))
    )
    exact = src.select(pair, F.array_join("words", " ").alias("_line")).distinct().withColumn("_same", F.lit(True))
    lines = gen.filter(F.size("words") > 0).withColumn("_line", F.array_join("words", " ")).join(match, [pair, "line_no"], "left").join(exact, [pair, "_line"], "left")
    copied = F.when(F.size("words") >= short, F.coalesce(F.col("n") / F.size(F.array_distinct("words")), F.lit(0.0)) >= least).otherwise(F.coalesce("_same", F.lit(False)))
    out = lines.groupBy(pair).agg(F.count("*").alias("n_lines"), F.count_if(copied).alias("n_copied"))
    every = gen.select(pair).distinct().join(out, pair, "left").fillna(0, ["n_lines", "n_copied"])
    return every.withColumn("novelty", F.when(F.col("n_lines") > 0, 1 - F.col("n_copied") / F.col("n_lines")).otherwise(0.0))


def align_words(df: DataFrame, words: str, stream: str, key: list[str]) -> DataFrame:
    """Greedy alignment of a text's words to a token stream: (key, n_words, n_aligned, places).

    Each word takes the first equal token at or after the place behind the last
    one taken; a word without one is skipped and does not move the place.  The
    steps depend on each other, so this runs in Python, by batches of rows.
    """
    spec = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key) + ", n_words int, n_aligned int, places array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ws, ts in zip(pdf[words], pdf[stream], strict=True):
                index: dict[str, list[int]] = {}
                for i, t in enumerate(ts if ts is not None else ()):
                    index.setdefault(t, []).append(i)
                at, places = 0, []
                for w in ws if ws is not None else ():
                    own = index.get(w, ())
                    k = _first_from(own, at)
                    places.append(k)
                    if k >= 0:
                        at = k + 1
                out.append(places)
            yield pdf[key].assign(n_words=[len(p) for p in out], n_aligned=[sum(k >= 0 for k in p) for p in out], places=out)

    return df.select(*key, words, stream).mapInPandas(run, spec)


def _first_from(places: list[int] | tuple, at: int) -> int:
    from bisect import bisect_left

    i = bisect_left(places, at)
    return places[i] if i < len(places) else -1


#: Texts and streams of a group that are aligned with each other in one piece.
TEXTS_AT_A_TIME, STREAMS_AT_A_TIME = 4_000, 20_000


def best_aligned(texts: DataFrame, streams: DataFrame, by: str, key: str, source: str, n_texts: int = TEXTS_AT_A_TIME, n_streams: int = STREAMS_AT_A_TIME) -> DataFrame:
    """(key, source, n_words, n_aligned): for each text (key, by, words) the stream (source, by, stream) of its group with most words aligned.

    Of equal ones the smallest source counts.  The alignment is that of
    align_words(), of a text with all streams of a group at once: a word moves
    the places of all streams that have it after their place.  Groups are cut
    into tiles of a bounded number of texts and streams.
    """

    def tiles(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    sizes = tiles(texts, n_texts, "_n_t").join(tiles(streams, n_streams, "_n_s"), by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = texts.join(sizes, by).select(by, key, "words", own(key, "_n_t").alias("_t"), every("_n_s").alias("_s"))
    right = streams.join(sizes, by).select(by, source, "stream", every("_n_t").alias("_t"), own(source, "_n_s").alias("_s"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((texts, key), (streams, source))]
    found = left.groupBy(by, "_t", "_s").cogroup(right.groupBy(by, "_t", "_s")).applyInArrow(_aligned_best(key, source), f"`{key}` {kinds[0]}, `{source}` {kinds[1]}, n_words int, n_aligned int")
    best = found.groupBy(key).agg(F.max_by(F.struct(source, "n_words", "n_aligned"), F.struct("n_aligned", -F.col(source))).alias("_one"))
    return best.select(key, "_one.*")


def _aligned_best(key: str, source: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def align(texts: pa.Table, streams: pa.Table) -> pa.Table:
        import numpy as np

        if not (texts.num_rows and streams.num_rows):
            return pa.table([pa.array([], texts.schema.field(key).type), pa.array([], streams.schema.field(source).type), *[pa.array([], pa.int32())] * 2], names=[key, source, "n_words", "n_aligned"])
        streams = streams.sort_by(source)
        lists = streams.column("stream").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        tokens = lists.flatten().dictionary_encode()
        word = np.asarray(tokens.indices)
        number = {w: i for i, w in enumerate(tokens.dictionary.to_pylist())}
        behind = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + 1  # the place behind each token
        # by word, the last tokens first: of several in a stream the first one is then assigned last
        order = np.argsort(word, kind="stable")[::-1]
        ends = len(word) - np.append(0, np.cumsum(np.bincount(word, minlength=len(number))))
        which, behind = np.repeat(np.arange(len(size)), size)[order], behind[order]
        found = [(which[ends[i + 1] : ends[i]], behind[ends[i + 1] : ends[i]]) for i in range(len(number))]
        best, most, n_words = [], [], []
        for ws in texts.column("words").to_pylist():
            at = np.zeros(len(size), np.int64)
            n = np.zeros(len(size), np.int32)
            for w in ws or ():
                if (i := number.get(w)) is not None:
                    stream, place = found[i]
                    free = place > at[stream]
                    stream = stream[free]
                    at[stream] = place[free]
                    n[stream] += 1  # once for each stream
            best.append(int(n.argmax()))
            most.append(int(n[best[-1]]))
            n_words.append(len(ws or ()))
        return pa.table([texts.column(key), streams.column(source).take(pa.array(best)), pa.array(n_words, pa.int32()), pa.array(most, pa.int32())], names=[key, source, "n_words", "n_aligned"])

    return align


def insert_absent(target: DataFrame, parts: DataFrame, key: list[str], part: str) -> DataFrame:
    """Rows of the parts that the target lacks; of several with one key, the first part's."""
    rest = [c for c in parts.columns if c not in key]
    first = parts.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(F.col(part), F.xxhash64(*rest))).alias("_one")).select(*key, "_one.*")
    return first.join(target.select(*key).distinct(), key, "left_anti")


def tiered(slots: DataFrame, tiers: list[Callable[[DataFrame], DataFrame]], slot: str, enough: int) -> DataFrame:
    """Candidates of the first tier, and of each later tier for the slots that still have too few."""
    from stihora.storage import written

    found = None
    short = slots
    for number, tier in enumerate(tiers):
        part = tier(short).withColumn("tier", F.lit(number))
        found = written(part if found is None else found.unionByName(part))
        full = found.groupBy(slot).agg(F.count("*").alias("_n")).filter(F.col("_n") >= enough).select(slot)
        short = slots.join(full, slot, "left_anti")
    return found


def running_rank(group: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))
