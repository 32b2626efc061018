"""Copies: texts stored once, groups of equal files, copies folded into the best hit, hard links, moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def text_hash(col):
    return F.substring(F.sha2(col, 256), 1, 32)


def dedup_texts(texts: DataFrame) -> DataFrame:
    """(hash, id, users): one row per distinct text. Only hashes are shuffled."""
    return texts.select("id", text_hash(F.col("data")).alias("hash")).groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("users"))


def size_groups(files: DataFrame) -> DataFrame:
    """(size, n): sizes that several files share."""
    return files.filter(~F.col("is_dir") & (F.col("size") > 0)).groupBy("size").agg(F.count("*").alias("n")).filter("n > 1")


def hashed(files: DataFrame, content_map: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, path, size, dev, ino, sha): files with their content hash where the text is known; a hard link takes that of its sibling."""
    known = content_map.select("id", F.col("text").alias("t")).join(texts.select(F.col("id").alias("t"), text_hash(F.col("data")).alias("sha")), "t").select("id", "sha")
    rows = files.filter(~F.col("is_dir") & (F.col("size") > 0)).select("id", "path", "size", "dev", "ino", "mtime").join(known, "id", "left")
    twins = rows.filter("sha IS NOT NULL").groupBy("dev", "ino").agg(F.max("sha").alias("twin"))
    return rows.join(twins, ["dev", "ino"], "left").withColumn("sha", F.coalesce("sha", "twin")).drop("twin")


def groups(rows: DataFrame) -> DataFrame:
    """(size, sha, n, first): groups of two files or more; members stay rows of their own, so a huge group is no row."""
    return rows.filter("sha IS NOT NULL").groupBy("size", "sha").agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1")


def fold_copies(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, rank, copies, copies_more): of ranked hits that are copies the best stays, with the others' ids in order of rank.

    hits are a bounded list (id, rank). Copies have the same size and hash or the same inode."""
    h = hits.join(rows, "id")
    key = F.when(F.col("sha").isNotNull(), F.concat_ws(":", F.col("size").cast("string"), "sha")).otherwise(F.concat_ws(":", F.lit("inode"), F.col("dev").cast("string"), F.col("ino").cast("string")))
    h = h.withColumn("key", key)
    folded = h.groupBy("key").agg(F.min(F.struct("rank", "id", "size")).alias("best"), F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("all"))
    folded = folded.select("best.id", "best.rank", "best.size", F.transform(F.slice("all", 2, 1 << 30), lambda x: x["id"]).alias("copies"))
    same = rows.groupBy("size").agg(F.count("*").alias("same_size"))
    return folded.join(same, "size", "left").select("id", "rank", "copies", (F.col("same_size") > F.size("copies") + 1).alias("copies_more"))


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, new_path): vanished and new paths of one file, where identity, size and time agree and the match is the only one."""
    gone = old.join(new.select("path"), "path", "left_anti")
    come = new.join(old.select("path"), "path", "left_anti")
    keys = ["dev", "ino", "size", "mtime"]
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("path").alias(name)).filter("n = 1").drop("n")
    return one(gone, "old_path").join(one(come, "new_path"), keys).select("old_path", "new_path")


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action): added, updated, unchanged, removed, moved (on the new path)."""
    key = F.struct("size", "mtime", "ctime_ms", "is_dir", "kind")
    both = old.select("path", key.alias("was")).join(new.select("path", key.alias("now")), "path", "full_outer")
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    m = moves(old.filter(~F.col("is_dir")), new.filter(~F.col("is_dir")))
    out = both.select("path", action.alias("action")).join(m.select(F.col("old_path").alias("path"), F.lit(1).alias("left")), "path", "left").filter("left IS NULL").drop("left")
    return out.join(m.select(F.col("new_path").alias("path"), F.lit("moved").alias("moved")), "path", "left").select("path", F.coalesce("moved", "action").alias("action"))


def protected(diff: DataFrame, unreadable: list[str]) -> DataFrame:
    """Rows below folders that couldn't be read are kept instead of removed."""
    below = F.lit(False)
    for folder in unreadable:
        below = below | F.col("path").startswith(folder.rstrip("/") + "/")
    return diff.withColumn("action", F.when((F.col("action") == "removed") & below, "kept").otherwise(F.col("action")))


def repeated(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """The first row per key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
