"""Quality of rankings: nDCG, MRR, recall, overlap, paired bootstrap."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, mrr, recall) of run (query, doc, score) against qrels (query, doc, grade); per query, ties by doc."""
    top = run.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)
    ideal = qrels.filter("grade > 0").withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    best = ideal.groupBy("query").agg(F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1))).alias("idcg"), F.count("*").alias("relevant"))
    hits = top.join(qrels.filter("grade > 0"), ["query", "doc"])
    got = hits.groupBy("query").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("found"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(got, "query", "left").select("query", z(F.col("dcg") / F.col("idcg")).alias("ndcg"), z(1.0 / F.col("first")).alias("mrr"), z(F.col("found") / F.col("relevant")).alias("recall"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query, overlap): share of the top k two runs have in common."""
    cut = lambda r: r.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k).select("query", "doc")
    both = cut(a).join(cut(b), ["query", "doc"]).groupBy("query").agg(F.count("*").alias("n"))
    return cut(a).select("query").distinct().join(both, "query", "left").select("query", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("overlap"))


def bootstrap(differences: list[float], rounds: int = 4000, seed: int = 1) -> tuple[float, float, float]:
    """(mean, low, high): 95 % interval of the mean of paired differences of queries."""
    rng = random.Random(seed)
    n = len(differences)
    means = sorted(sum(rng.choices(differences, k=n)) / n for _ in range(rounds))
    return sum(differences) / n, means[int(0.025 * rounds)], means[int(0.975 * rounds) - 1]
