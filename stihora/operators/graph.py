"""Graphs as tables of nodes (id) and edges (src, dst, weight), undirected unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stihora.storage import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.filter("src <> dst").select("dst", "src", "weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"), F.count("*").alias("n_edges"))


def collapsed(edges: DataFrame, precedence: list[str]) -> DataFrame:
    """One edge for each pair of nodes: of several types the first in precedence counts."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, precedence)), F.col("edge_type")), F.lit(len(precedence) + 1))
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    return edges.groupBy(*pair).agg(F.min_by(F.struct("edge_type", "weight"), F.struct(order.alias("o"), "edge_type")).alias("e")).select("src", "dst", "e.edge_type", "e.weight")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(id, rank), summing to 1.  What nodes without edges hold is spread evenly.

    Ranks are joined with edges that are already partitioned and summed by
    node; every round is written, which cuts the lineage.  With a tolerance
    the rounds end once the ranks move by less than tolerance * nodes.
    """
    links = written(both_ways(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = written(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    every = links.select(F.col("src").alias("id")).union(nodes.select("id") if nodes is not None else links.select("dst")).distinct()
    every = written(every.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("total").isNull().alias("dangling")))
    n = every.count()
    ranks = every.select("id", "dangling", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        held = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("h")).head()[0]
        got = shares.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = every.join(got, "id", "left").select("id", "dangling", (F.lit((1 - damping) / n + damping * held / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = written(new)
        if tolerance is not None:
            moved = new.join(ranks.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0] or 0.0
            if moved < tolerance * n:
                ranks = new
                break
        ranks = new
    return ranks.select("id", "rank")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by synchronous label propagation: each node takes the label with most weight around it.

    A node's own label counts with half its heaviest edge, which keeps two
    groups of nodes from swapping labels for ever; ties take the smaller label.
    """
    links = written(both_ways(edges))
    labels = written(links.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    own = links.groupBy(F.col("src").alias("id")).agg((F.max("weight") / 2).alias("w"))
    for _ in range(rounds):
        seen = links.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label", F.col("weight").alias("w"))
        votes = seen.unionByName(labels.join(own, "id").select("id", "label", "w")).groupBy("id", "label").agg(F.sum("w").alias("w"))
        new = written(votes.groupBy("id").agg(F.min_by("label", F.struct((-F.round("w", 9)).alias("a"), F.col("label").alias("b"))).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").count()
        labels = new
        if not moved:
            break
    return labels.select("id", F.col("label").alias("community"))


def community_report(found: DataFrame, authors: DataFrame) -> DataFrame:
    """(community, n_authors, n_words) of the communities with an author."""
    marked = found.join(authors.select(F.col("id"), F.lit(True).alias("is_author")), "id", "left")
    return marked.groupBy("community").agg(F.count_if(F.coalesce("is_author", F.lit(False))).alias("n_authors"), F.count_if(F.col("is_author").isNull()).alias("n_words")).filter("n_authors > 0")


def node_sizes(nodes: DataFrame, col: str, base: float, span: float) -> DataFrame:
    top = nodes.agg(F.max(col).alias("_top"))
    return nodes.join(F.broadcast(top)).withColumn("size", base + span * F.col(col) / F.col("_top")).drop("_top")


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GEXF file, in order, as one column; written as text they are the file."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    spark = nodes.sparkSession
    fixed = lambda at, text: spark.createDataFrame([(at, "", text)], "part int, key string, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("key"), F.concat(F.lit('<node id="'), quoted("id"), F.lit('" label="'), quoted("id"), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(3).alias("part"), F.concat_ws("|", "src", "dst").alias("key"), F.concat(F.lit('<edge source="'), quoted("src"), F.lit('" target="'), quoted("dst"), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>'
    return fixed(0, head).union(n).union(fixed(2, "</nodes><edges>")).union(e).union(fixed(4, "</edges></graph></gexf>")).orderBy("part", "key").select("line")
