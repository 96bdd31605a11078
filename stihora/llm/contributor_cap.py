"""Capping the records of dominant contributors (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import folded_words, written

#: Bins of one histogram level; a contributor's histogram has at most so many rows, and one for nulls.
BINS = 1024
#: Records of one borderline bin that may be ranked in one task; larger bins get another histogram level.
RANK_AT_MOST = 50_000


def name_key(name: Column) -> Column:
    """Key of a person's name: its folded words in alphabetical order, so that neither spelling nor order of the parts counts.

    Null for a null name or one without letters.
    """
    words = F.array_sort(folded_words(name))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def contributors(df: DataFrame, name_col: str, aliases: DataFrame, alias_cols: list[str], id_col: str) -> DataFrame:
    """df with `contributor`: one value for all spellings of a name, null for null or blank names.

    `aliases` gives the known spellings (alias_cols) of each person (id_col).
    A name with no alias is a contributor of its own.  If two persons share a
    spelling, the smaller id takes it.
    """
    known = None
    for c in alias_cols:
        part = aliases.select(name_key(F.col(c)).alias("_key"), F.col(id_col).cast("string").alias("_id"), F.col(id_col).alias("_order"))
        known = part if known is None else known.unionByName(part)
    known = known.filter("_key is not null").groupBy("_key").agg(F.min_by("_id", "_order").alias("_id"))
    keyed = df.withColumn("_key", name_key(F.col(name_col)))
    return keyed.join(known, "_key", "left").withColumn("contributor", F.coalesce(F.concat(F.lit("id:"), "_id"), F.concat(F.lit("name:"), "_key"))).drop("_key", "_id")


def over_cap(df: DataFrame, cap: Column | int, bins: int = BINS, rank_at_most: int = RANK_AT_MOST) -> DataFrame:
    """(contributor, record, quality) of the records beyond each contributor's cap.

    `df` has contributor, record (an integer id, distinct) and quality (null
    last; ties by smaller record).  Records without a contributor are never
    limited.  Mergeable histograms by contributor give the bin in which each
    cap falls; what lies above that bin stays, what lies below is out, and
    only the records of the borderline bins are ranked.  A borderline bin with
    more than rank_at_most records gets a finer histogram first: over
    qualities, then over record ids once all qualities in it are equal.  So
    neither a dominant contributor nor a quality that ties for a third of all
    records is ever sorted as a whole.

    An empty table gives no rows; NaN ranks above all other qualities, and
    qualities beyond +-8e307 tie with that number.
    """
    q = F.greatest(F.lit(-8e307), F.least(F.lit(8e307), F.col("quality").cast("double")))
    q = F.when(F.col("quality").isNotNull(), q)
    need = (F.lit(cap) if isinstance(cap, int) else cap).cast("bigint")
    left = written(df.filter("contributor is not null").select("contributor", "record", q.alias("quality"), need.alias("need")))
    beyond = None
    while True:
        out, left = at_cutoff(left, bins)
        beyond = out if beyond is None else beyond.unionByName(out)
        largest = left.groupBy("contributor").count().agg(F.max("count")).head()[0]
        if largest is None:
            return beyond
        if largest <= rank_at_most:
            w = Window.partitionBy("contributor").orderBy(F.col("quality").desc_nulls_last(), "record")
            ranked = left.withColumn("rank", F.row_number().over(w)).filter("rank > need")
            return beyond.unionByName(ranked.select("contributor", "record", "quality"))


def at_cutoff(records: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """The records below each contributor's borderline bin, which are out, and those in it, with the `need` left for them.

    `records` has contributor, record, quality and need, the number that the
    contributor may keep.  Those with no more records than that give neither.
    """
    inside = written(
        records.groupBy("contributor")
        .agg(F.count("*").alias("n"), F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.count("quality").alias("scored"), F.min("record").alias("first"), F.max("record").alias("last"), F.any_value("need").alias("need"))
        .filter("n > need")
    )
    # higher bins are worse, so that counting runs upwards
    tied = F.coalesce((F.col("lo") == F.col("hi")) & (F.col("scored") == F.col("n")), F.lit(False)) | (F.col("scored") == 0)
    wide = {c: f"cast({c} as decimal(20,0))" for c in ("record", "first", "last")}
    by_record = F.expr(f"({wide['record']} - {wide['first']}) * {bins} div ({wide['last']} - {wide['first']} + 1)")
    spread = (F.col("hi") - F.col("quality")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    by_quality = F.when(F.col("quality").isNull(), F.lit(bins)).otherwise(F.least(F.floor(spread * bins), F.lit(bins - 1)))
    by_quality = F.when(F.col("quality") == F.col("hi"), F.lit(-1)).otherwise(by_quality)
    binned = records.drop("need").join(inside, "contributor").withColumn("bin", F.when(tied, by_record).otherwise(by_quality).cast("bigint"))
    w = Window.partitionBy("contributor").orderBy("bin")
    histogram = binned.groupBy("contributor", "bin").agg(F.count("*").alias("in_bin"), F.any_value("need").alias("need"))
    cutoff = written(
        histogram.withColumn("upto", F.sum("in_bin").over(w))
        .filter("upto > need and upto - in_bin <= need")
        .select("contributor", F.col("bin").alias("cut"), (F.col("need") - F.col("upto") + F.col("in_bin")).alias("rest"))
    )
    placed = binned.select("contributor", "record", "quality", "bin").join(cutoff, "contributor")
    borderline = written(placed.filter("bin = cut").select("contributor", "record", "quality", F.col("rest").alias("need")))
    return placed.filter("bin > cut").select("contributor", "record", "quality"), borderline
