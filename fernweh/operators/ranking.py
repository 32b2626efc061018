"""Ranking: sorts, top-k, rank fusion, frecency, recency, BM25.

Lists are cut to what can be asked for before they are numbered, so that no window ever sees more rows than a list
holds; ties always end in (mtime desc, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RRF_K = 20
POOL = 128
K1, B = 1.2, 0.75
SORTS = {"name": ["name"], "size": ["size"], "date": ["mtime"], "path": ["path"]}


def sort_order(sort: str) -> list[Column]:
    """The columns of an explicit sort; ties are broken by the path, upward."""
    desc, key = sort.startswith("-"), sort.lstrip("-")
    return [*[F.desc(c) if desc else F.asc(c) for c in SORTS[key]], F.asc("path")]


def explicit_sort(hits: DataFrame, sort: str) -> DataFrame:
    return hits.orderBy(*sort_order(sort))


def newest(files: DataFrame, k: int) -> DataFrame:
    return files.orderBy(F.desc("mtime"), "id").limit(k)


def ranked(hits: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k in this order, numbered from 0."""
    return hits.orderBy(*order).limit(k).withColumn(rank, (F.row_number().over(W.orderBy(*order)) - 1).cast("int"))


def ranked_whole(hits: DataFrame, order: list[Column], most: int) -> DataFrame:
    """All hits: the first `most` in this order numbered from 0, the others with the rank after the last. hits must be cheap to read twice."""
    first = ranked(hits, order, most)
    return first.unionByName(hits.join(first.select("id"), "id", "left_anti").withColumn("rank", F.lit(most)))


def fuse(lists: list[tuple[DataFrame, float, str]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: (id, score, sources)."""
    each = [df.select("id", (F.lit(w) / (k + F.col("rank") + 1)).alias("part"), F.lit(name).alias("source")) for df, w, name in lists]
    return reduce(DataFrame.unionByName, each).groupBy("id").agg(F.sum("part").alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))


def frecency(opens: DataFrame) -> DataFrame:
    """(path, count, last): opens folded per path. A late or repeated row changes nothing but its own count: exact repeats count once."""
    return opens.filter(F.col("path").isNotNull()).select("path", "ts", "via").distinct().groupBy("path").agg(F.count("*").alias("count"), F.max("ts").alias("last"))


def frecency_points(count: Column, last_ms: Column, now: int) -> Column:
    return F.coalesce(F.least(F.lit(30.0), 8 * F.log2(1 + count)) * F.exp(-((now - last_ms) / 86_400_000.0) / 30), F.lit(0.0))


def recency_points(mtime: Column, now: int) -> Column:
    days = (now - mtime) / 86_400_000.0
    return F.when(days < 7, 4.0).when(days < 30, 2.0).otherwise(0.0)


def boosted(score: Column, frecency_: Column, recency: Column) -> Column:
    return score * (1 + frecency_ / 200 + recency / 400)


def saturation(tf: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1)


def idf(n: Column, df: Column, groups: int) -> Column:
    return F.lit(1.0) if groups == 1 else F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(matches: DataFrame, stats: DataFrame, texts: DataFrame, tf_body: list[Column], limit: int) -> DataFrame:
    """Path score of all matches; text score of the pool of the best POOL by it, with the pool's mean length.

    matches: id, mtime, tf_name_i, tf_dirs_i; stats: one row with n and df_i; tf_body: per group a count over data.
    """
    g = len(tf_body)
    cap = lambda c: F.least(F.col(c), F.lit(20)).cast("double")
    m = matches.crossJoin(F.broadcast(stats))  # one row
    weights = [idf(F.col("n"), F.col(f"df_{i}"), g) for i in range(g)]
    path = reduce(Column.__add__, [w * (10 * saturation(cap(f"tf_name_{i}")) + 2.5 * saturation(cap(f"tf_dirs_{i}"))) for i, w in enumerate(weights)])
    m = m.withColumn("path_score", path)
    order = [F.desc("path_score"), F.desc("mtime"), F.asc("id")]
    pool = ranked(m, order, max(POOL, limit)).join(texts.select("id", "data"), "id", "left")
    length = F.coalesce(F.length("data"), F.lit(0)).cast("double")
    pool = pool.withColumn("len", length).withColumn("mean", F.greatest(F.coalesce(F.avg(F.when(F.col("data").isNotNull(), F.col("len"))).over(W.partitionBy()), F.lit(1.0)), F.lit(1.0)))
    tf = [F.coalesce(F.least(c, F.lit(1000)), F.lit(0)).cast("double") for c in tf_body]
    text = reduce(Column.__add__, [w * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("mean"))) for w, t in zip(weights, tf)])
    return pool.select("id", "mtime", "path_score", (F.col("path_score") + text).alias("score")).orderBy(F.desc("score"), F.desc("mtime"), "id").limit(limit)


def strong(hits: DataFrame, ratio: float) -> DataFrame:
    """Hits that score at least this share of the best."""
    return hits.crossJoin(F.broadcast(hits.agg(F.max("score").alias("top")))).filter(F.col("score") >= ratio * F.col("top")).drop("top")


def page(hits: DataFrame, order: list[Column], offset: int, limit: int, pool: int = 1000) -> DataFrame:
    return hits.orderBy(*order).limit(pool).orderBy(*order).offset(offset).limit(limit)
