"""Streams: the change log applied to a catalog, file events coalesced, opens folded, late and repeated rows harmless."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fernweh.functions import paths
from fernweh.operators.incremental import RunState
from fernweh.operators.policy import Settings, crawled

PER_FOLDER, MOST_PATHS = 128, 1000


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row per key, pre-aggregated before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def apply_changes(catalog: DataFrame, changes: DataFrame, removed: DataFrame) -> DataFrame:
    """The catalog after a batch: of each id the row of the greatest seq, without removed ids, unless an id came again after its removal. Applying a batch twice changes nothing."""
    rows = latest(catalog.unionByName(changes.select(*catalog.columns)))
    gone = removed.groupBy("id").agg(F.max("seq").alias("gone"))
    return rows.join(gone, "id", "left").filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).drop("gone")


def coalesce_round(changed: DataFrame, roots: list[str], per_folder: int = PER_FOLDER) -> DataFrame:
    """One round: paths inside another left out, then folders with many changes put in their place."""
    c = changed.select("path").distinct()
    inside = c.select("path", F.explode(paths.ancestors(F.col("path"))).alias("dir")).join(c.select(F.col("path").alias("dir")), "dir", "left_semi").select("path").distinct()
    kept = c.join(inside, "path", "left_anti").withColumn("dir", paths.parent(F.col("path")))
    within = reduce(Column.__or__, [(F.col("dir") == r) | F.col("dir").startswith(r + "/") for r in roots])
    busy = kept.groupBy("dir").agg(F.count("*").alias("n")).filter((F.col("n") > per_folder) & within)
    return kept.join(busy.select("dir"), "dir", "left_anti").select("path").unionByName(busy.select(F.col("dir").alias("path")))


def coalesced(changed: DataFrame, roots: list[str], per_folder: int = PER_FOLDER, most: int = MOST_PATHS, depth: int = 64) -> DataFrame | None:
    """Rounds until nothing changes; None, a full walk, when too many paths remain. Only counts reach the driver."""
    now = coalesce_round(changed, roots, per_folder)
    n = now.count()
    for _ in range(depth):
        nxt = coalesce_round(now, roots, per_folder)
        k = nxt.count()
        if k == n:
            break
        now, n = nxt, k
    return None if n > most else now


def frecency_stream(opens: DataFrame, late: str = "1 day", on: str = "ts") -> DataFrame:
    """Counters per path over a stream of opens; a row repeated while the watermark on `on` lasts counts once, so that what is remembered for that is bounded by time."""
    return opens.filter("path IS NOT NULL").withWatermark(on, late).dropDuplicatesWithinWatermark(["path", "ts", "via"]).groupBy("path").agg(F.count("*").alias("count"), F.max("ts").alias("last"))


def watched(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Events of paths that a crawl takes in: below the roots, outside skipped, hidden and excluded folders. A stream stays one."""
    return crawled(events.filter("path IS NOT NULL"), s)


def quiet_batches(events: DataFrame, gap: str = "1 second", most: int = 10) -> DataFrame:
    """Events of a folder joined while no pause is longer than the gap, and over `most` seconds at most: sessions end at the marks of a clock of that step."""
    slot = F.floor(F.unix_micros("ts") / (most * 1_000_000)).alias("slot")
    return events.withWatermark("ts", f"{most} seconds").groupBy(F.session_window("ts", gap), "folder", slot).agg(F.count("*").alias("events"), F.max("ts").alias("last"))


class LatestTable(RunState):
    """The last row per key of a stream, as a state table and the deltas of the batches since; a batch writes its own rows only, and every `most` batches the deltas are folded into the state. Batches that come again are known by their number."""

    def __init__(self, spark, folder: str, key: str, order: str, schema: str, most: int = 16):
        super().__init__(spark, folder)
        self.key, self.order, self.schema, self.most = key, order, schema, most

    def _said(self) -> tuple[int, dict]:
        v = self.version()
        return v, self.committed(v) if v else {"state": None, "deltas": [], "batch": -1}

    def _read(self, said: dict) -> DataFrame:
        names = [n for n in [said["state"], *said["deltas"]] if n]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return latest(self._read(self._said()[1]), self.key, self.order)

    def apply(self, batch: DataFrame, number: int) -> None:
        v, said = self._said()
        if number <= said["batch"]:
            return
        delta = self._write(latest(batch.select(*self._read(said).columns), self.key, self.order), "delta")
        new = {"state": said["state"], "deltas": [*said["deltas"], delta], "batch": number}
        if len(new["deltas"]) >= self.most:
            new |= {"state": self._write(latest(self._read(new), self.key, self.order), "state"), "deltas": []}
        if not self._claim(v + 1, new):
            raise RuntimeError(f"another stream has committed version {v + 1}")


def sink_latest(table: LatestTable):
    """A foreachBatch sink that keeps the last row per key."""
    return table.apply


def first_events(events: DataFrame, key: str, order: str) -> DataFrame:
    """The first event per key in a batch."""
    return events.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("__r = 1").drop("__r")
