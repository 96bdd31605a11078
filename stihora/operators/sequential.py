"""Steps that depend on each other within a group: grouped Python where windows cannot say it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota_lines(lines: DataFrame, group: str, poem: str, norm: str, order: list[str], quota: int = 2, exact: bool = False) -> DataFrame:
    """At most `quota` lines of each poem, and no line twice in a group.

    By windows the first place of a line counts, then the quota.  With exact,
    a line that the quota turned away in one poem may still be taken in a later
    one, which takes one pass over a group in order.
    """
    if not exact:
        once = lines.withColumn("_r", F.row_number().over(Window.partitionBy(group, norm).orderBy(poem, *order))).filter("_r = 1").drop("_r")
        return once.withColumn("_q", F.row_number().over(Window.partitionBy(group, poem).orderBy(*order))).filter(F.col("_q") <= quota).drop("_q")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        used: dict = {}
        keep = []
        pdf = pdf.sort_values([poem, *order])
        for p, n in zip(pdf[poem], pdf[norm], strict=True):
            ok = n not in seen and used.get(p, 0) < quota
            if ok:
                seen.add(n)
                used[p] = used.get(p, 0) + 1
            keep.append(ok)
        return pdf[keep]

    return lines.groupBy(group).applyInPandas(take, lines.schema)


def claim_exclusively(clustered: DataFrame, group: str, cluster: str, poem: str, order: str) -> DataFrame:
    """One line of each cluster, the smallest cluster first, and no poem twice in a group."""

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        sizes = pdf.groupby(cluster).size().reset_index(name="_n").sort_values(["_n", cluster])
        for c in sizes[cluster]:
            rows = pdf[(pdf[cluster] == c) & ~pdf[poem].isin(taken)].sort_values([order, poem])
            if len(rows):
                out.append(rows.iloc[[0]])
                taken.add(rows[poem].iloc[0])
        return pd.concat(out) if out else pdf.iloc[:0]

    return clustered.groupBy(group).applyInPandas(claim, clustered.schema)


def least_used(slots: DataFrame, poem: str, order: str) -> DataFrame:
    """slots (candidates: array of (lemma, score)) with `picked`, the candidate least used so far in the poem.

    Of equally used ones the best score counts, then the lemma.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in slots.drop('candidates').dtypes)}, picked string"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        pdf = pdf.sort_values(order)
        out = []
        for cs in pdf["candidates"]:
            best = min(((used.get(c["lemma"], 0), -c["score"], c["lemma"]) for c in (cs if cs is not None else ())), default=None)
            if best:
                used[best[2]] = used.get(best[2], 0) + 1
            out.append(best[2] if best else None)
        return pdf.drop(columns="candidates").assign(picked=out)

    return slots.groupBy(poem).applyInPandas(pick, schema)


def word_spans(df: DataFrame, key: list[str], line: str, words: str) -> DataFrame:
    """(key, spans): place of each word in its line, searched from behind the last one, else from the start; -1 if absent."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key) + ", spans array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, ws in zip(pdf[line], pdf[words], strict=True):
                at, places = 0, []
                for w in ws if ws is not None else ():
                    i = (text or "").find(w, at)
                    i = i if i >= 0 else (text or "").find(w)
                    places.append(i)
                    at = i + len(w) if i >= 0 else at
                out.append(places)
            yield pdf[key].assign(spans=out)

    return df.select(*key, line, words).mapInPandas(run, schema)


def order_without_neighbours(df: DataFrame, panel: str, item: str, group: str) -> DataFrame:
    """(panel, item, group, place): an order of each panel in which no two neighbours share a group, where that can be.

    The largest groups come first and fill every other place, then the places
    between; that keeps a group apart from itself unless it has more than half
    of the panel.  Within a group, and between groups of one size, the order is
    by hash.  Places come from one numbering by ranges of all panels, so no
    panel has to fit in one task.  Rows with a null are left out, repeated rows count once.
    """
    from stihora.operators.relations import dense_ids

    rows = df.select(panel, item, group).dropna().distinct()
    drawn = lambda *c: F.md5(F.concat_ws("|", *(F.col(x).cast("string") for x in c)))
    sized = rows.join(rows.groupBy(panel, group).agg((-F.count("*")).alias("_less")), [panel, group])
    keyed = sized.select(panel, item, group, "_less", drawn(panel, group).alias("_g"), drawn(panel, item).alias("_i"))
    numbered = dense_ids(keyed, [panel, "_less", "_g", group, "_i", item], "_no")
    ends = numbered.groupBy(panel).agg(F.min("_no").alias("_first"), F.count("*").alias("_n"))
    at, even = F.col("_no") - F.col("_first"), F.ceil(F.col("_n") / 2)
    place = F.when(at < even, 2 * at).otherwise(2 * (at - even) + 1)
    return numbered.join(ends, panel).select(panel, item, group, place.cast("int").alias("place"))


def k_means(df: DataFrame, group: str, vector: str, key: str, k: int = 5, rounds: int = 20, starts: int = 10, seed: int = 42) -> DataFrame:
    """(group, key, cluster, distance): k-means with up to k clusters within each group of bounded size."""
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, cluster int, distance double"

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), np.float64)
        best = None
        for s in range(starts):
            rng = np.random.default_rng(seed + s)
            c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
            for _ in range(rounds):
                d = ((x[:, None, :] - c[None]) ** 2).sum(2)
                near = d.argmin(1)
                c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            d = ((x[:, None, :] - c[None]) ** 2).sum(2)
            total = d.min(1).sum()
            if best is None or total < best[0] - 1e-12:
                best = (total, d.argmin(1), np.sqrt(d.min(1)))
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": best[1].astype(np.int32), "distance": best[2]})

    return df.select(group, key, vector).groupBy(group).applyInPandas(cluster, schema)
