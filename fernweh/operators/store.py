"""Writing: texts stored once, the vocabulary grown by new words, vectors added by hash, garbage found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fernweh.operators.duplicates import text_hash


def numbered(rows: DataFrame, by: str, first: Column) -> DataFrame:
    """rows with `number`, counted from `first` in the order of a hexadecimal column. Rows are ranked within their first two digits, whose sizes, 256 at most, give where each begins."""
    head = rows.withColumn("head", F.substring(by, 1, 2))
    sizes = head.groupBy("head").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = head.withColumn("rank", F.row_number().over(W.partitionBy("head").orderBy(by)))
    return ranked.join(F.broadcast(sizes.select("head", "before")), "head").withColumn("number", first + F.col("before") + F.col("rank") - 1).drop("head", "rank", "before")


def write_contents(old_map: DataFrame, old_texts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(added, removed, content_map) as new (id, data) replace the texts of their files: texts (id, data, hash) that no file had, numbered on from the greatest id; ids of texts that no file has any more; and (id, text, hash) of all files.

    A batch meets the stored texts by hash: of those only (id, hash) is read on, no stored text is shuffled or written again. Of equal stored texts the least id stays; a null text has no row and its file loses its own."""
    fresh = new.select("id", "data", text_hash(F.col("data")).alias("hash"))
    known = old_texts.select(F.col("id").alias("text"), text_hash(F.col("data")).alias("hash"))
    asked = fresh.filter("hash IS NOT NULL").groupBy("hash").agg(F.first("data").alias("data"))
    stored = known.join(asked.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("text"))
    last = old_texts.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("first"))
    added = numbered(asked.join(stored, "hash", "left_anti").crossJoin(F.broadcast(last)), "hash", F.col("first")).select(F.col("number").cast("bigint").alias("id"), "data", "hash")
    texts = stored.unionByName(added.select("hash", F.col("id").alias("text")))
    changed = fresh.select("id", "hash").join(texts, "hash").select("id", "text", "hash")
    kept = old_map.join(fresh.select("id"), "id", "left_anti").join(known, "text").select("id", "text", "hash")
    users = kept.unionByName(changed)
    removed = old_texts.select("id").join(users.select(F.col("text").alias("id")), "id", "left_anti")
    return added, removed, users


BUCKETS = 256


def write_postings(postings: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Stores postings (term, col, id) by a hash of the term, so that a query for some words reads their parts only; in a part rows are sorted, and Parquet's statistics skip what isn't asked for."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    postings.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(folder)


def read_postings(spark, folder: str, words: list[str] | None = None, prefixes: list[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """The stored postings, or those of some words and beginnings."""
    p = spark.read.parquet(folder)
    if words is None:
        return p.drop("bucket")
    hit = F.col("term").isin(*words)
    if not prefixes:  # only the words' parts
        in_parts = F.col("bucket").isin(*[r[0] for r in spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets)).cast("int") for w in words]))).collect()])
        return p.filter(in_parts & hit).drop("bucket")
    for x in prefixes:
        hit = hit | F.col("term").startswith(x)
    return p.filter(hit).drop("bucket")


def append_vocabulary(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """Words not in earlier batches."""
    return terms.select("term").distinct().join(vocab.select("term"), "term", "left_anti")


def add_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """New (hash, vec) whose hash isn't stored, once each; of different vectors of a hash the least."""
    return new.groupBy("hash").agg(F.min("vec").alias("vec")).join(vectors.select("hash"), "hash", "left_anti")


def vector_stats(passages: DataFrame, vectors: DataFrame, state: DataFrame) -> DataFrame:
    """files, passages, vectors, partial: one row of independent counts."""
    p = passages.agg(F.countDistinct("file").alias("files"), F.count("*").alias("passages"))
    v = vectors.agg(F.countDistinct("hash").alias("vectors"))
    s = state.agg(F.count_if(F.col("upto") < F.col("total")).alias("partial"))
    return p.crossJoin(v).crossJoin(s)


def coverage_status(files: DataFrame, candidates: DataFrame, state: DataFrame) -> DataFrame:
    """files, current, pending: how much of what may be embedded is, under the signature it has now."""
    j = candidates.join(state.select("file", F.col("sig").alias("old"), "upto", "total"), "file", "left")
    now = (F.col("old") == F.col("sig")) & (F.col("upto") >= F.col("total"))
    return j.agg(F.count("*").alias("files"), F.count_if(F.coalesce(now, F.lit(False))).alias("current"), F.count_if(~F.coalesce(now, F.lit(False))).alias("pending"))
