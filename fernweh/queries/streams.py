"""Streams over the driver tables, run to their end, and extraction from stored texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from fernweh.corpus import Corpus
from fernweh.operators.incremental import RunState, content_hash
from fernweh.operators.policy import PACKAGES, SKIP_DIRS, Settings
from fernweh.runtime import shared_path
from fernweh.sources import extract, sinks
from fernweh.streaming import changes


_folder = shared_path


def applied_changes(spark, d):
    """The catalog after a change log: upserts of the later half, removals of every ninth file, some of which came again."""
    f = Corpus(spark, d).files.select("id", "path", "size", "seq")
    log = f.filter("id % 2 = 0").select("id", "path", (F.col("size") + 1).alias("size"), (F.col("seq") + 1_000_000).alias("seq"))
    removed = f.filter("id % 9 = 0").select("id", (F.col("seq") + 500_000).alias("seq"))
    return changes.apply_changes(f, log.unionByName(log), removed)


def coalesced_events(spark, d):
    """Changed paths after one round."""
    changed = Corpus(spark, d).table("opens").filter("path IS NOT NULL").select("path")
    return changes.coalesce_round(changed, ["/home/u"], per_folder=5)


def watched_events(spark, d):
    """Paths of opens that a crawl would take in, read as a stream."""
    schema = spark.read.parquet(f"{d}/opens.parquet").schema
    src = spark.readStream.schema(schema).parquet(f"{d}/opens.parquet*")
    out, mark = _folder(spark, "watched"), _folder(spark, "watched-log")
    q = changes.watched(src, Settings(excluded=("/home/u/Archive",))).select("path", "via").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("path string, via string").parquet(out).groupBy("path").agg(F.count("*").alias("n"))


def streamed_frecency(spark, d):
    """Opens folded by a stream that reads the table in micro-batches until it is through."""
    schema = spark.read.parquet(f"{d}/opens.parquet").schema
    src = spark.readStream.schema(schema).parquet(f"{d}/opens.parquet*")
    # watermarks need a time with a zone; the table's are UTC. Rows are in order of logged_at, to which the watermark is bound
    src = src.withColumns({"ts": F.col("ts").cast("timestamp"), "logged_at": F.col("logged_at").cast("timestamp")})
    out, mark = _folder(spark, "frecency"), _folder(spark, "frecency-log")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/b={n}")

    folded = changes.frecency_stream(src, "1 day", "logged_at")
    q = folded.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("path").agg(F.max_by("count", "b").alias("count"), F.unix_micros(F.max("last")).alias("last_us"))


def versioned_state(spark, d):
    """Three runs over a catalog that changes between them. The first of them dies midway and is run again; the second is beaten to its version by another. What all committed runs returned is each record once per content it had."""
    files = Corpus(spark, d).files.filter(~F.col("is_dir")).select("id", "size", "mtime")
    hashed = lambda f: f.withColumn("content_hash", content_hash(F.col("size"), F.col("mtime")))
    state = RunState(spark, _folder(spark, "run-state"))

    def dies(fresh):
        fresh.write.format("noop").mode("overwrite").save()
        raise OSError("lost")

    try:
        state.run(hashed(files), ["id"], dies)
    except OSError:
        pass
    state.run(hashed(files), ["id"], lambda fresh: fresh.select("id", "size"))
    after = hashed(files.withColumn("size", F.when(F.col("id") % 23 == 0, F.col("size") + 1).otherwise(F.col("size"))))

    def beaten(fresh):
        state.run(after, ["id"], lambda fresh: fresh.select("id", "size"))
        return fresh.select("id", "size")

    try:
        state.run(after, ["id"], beaten)
    except RuntimeError:
        pass
    state.run(after, ["id"], lambda fresh: fresh.select("id", "size"))
    return state.outputs("id bigint, size bigint")


def html_texts(spark, d):
    """Stored web pages as text."""
    c = Corpus(spark, d)
    pages = c.files.filter("NOT is_dir").select("id").join(c.content, "id")

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "text": [extract.html_text(t or "") for t in pdf["data"]]})

    return pages.mapInPandas(run, "id bigint, text string")


def extracted_texts(spark, d):
    """Stored texts read again as files of their name."""
    c = Corpus(spark, d)
    src = c.files.filter("NOT is_dir").select("id", F.concat(F.col("id").cast("string"), F.lit("."), "ext").alias("path")).join(c.content, "id").select("path", F.encode("data", "utf-8").alias("content"))
    return extract.extracted(src).select("path", "status", "note", "chars")


def merged_pages(spark, d):
    """Blank pages filled by recognised ones; here every second page is blanked first."""
    t = Corpus(spark, d).table("texts").filter("instr(data, '\f') > 0")
    own = t.select("id", F.array_join(F.transform(F.split("data", "\f", -1), lambda p, i: F.when(i % 2 == 0, p).otherwise("-")), "\f").alias("text"))
    return extract.merge_pages(own, t.select("id", F.col("data").alias("text"))).select("id", F.sha2("text", 256).alias("sha"))


def json_lines(spark, d):
    return sinks.rendered(Corpus(spark, d).files.filter("ext = 'csv'").select("id", "path", "size"), "json")


QUERIES = {f.__name__: f for f in (applied_changes, coalesced_events, watched_events, streamed_frecency, versioned_state, html_texts, extracted_texts, merged_pages, json_lines)}

SQL = {
    "applied_changes": """WITH a AS (SELECT id, path, size + 1 AS size, seq + 1000000 AS seq FROM files WHERE id % 2 = 0 UNION ALL SELECT id, path, size, seq FROM files), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM a) WHERE r = 1)
        SELECT id, path, size, seq FROM l WHERE id % 9 <> 0 OR seq > (SELECT seq + 500000 FROM files f WHERE f.id = l.id)""",
    "coalesced_events": r"""WITH c AS (SELECT DISTINCT path FROM opens WHERE path IS NOT NULL), k AS (SELECT path, CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS dir FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE starts_with(c.path, x.path || '/'))),
        b AS (SELECT dir FROM k WHERE dir = '/home/u' OR starts_with(dir, '/home/u/') GROUP BY dir HAVING count(*) > 5) SELECT path FROM k WHERE dir NOT IN (SELECT dir FROM b) UNION ALL SELECT dir FROM b""",
    "streamed_frecency": "SELECT path, count(*) AS count, epoch_us(max(ts)) AS last_us FROM (SELECT DISTINCT path, ts, via FROM opens WHERE path IS NOT NULL) GROUP BY path",
    "watched_events": f"""SELECT path, count(*) AS n FROM (SELECT path, list_slice(string_split(path, '/'), 4, len(string_split(path, '/'))::INT) AS parts FROM opens WHERE starts_with(path, '/home/u/') AND NOT starts_with(path, '/home/u/Archive/') AND path <> '/home/u/Archive')
        WHERE NOT list_has_any(list_slice(parts, 1, (len(parts) - 1)::INT), [{", ".join(f"'{x}'" for x in SKIP_DIRS)}]) AND len(parts) <= 64 AND len(list_filter(parts, lambda p: starts_with(p, '.'))) = 0
        AND len(list_filter(list_slice(parts, 1, (len(parts) - 1)::INT), lambda p: regexp_matches(p, '(?i).\\.({'|'.join(PACKAGES)})$'))) = 0 GROUP BY path""",
    "versioned_state": "SELECT id, size FROM files WHERE NOT is_dir UNION ALL SELECT id, size + 1 FROM files WHERE NOT is_dir AND id % 23 = 0",
    "merged_pages": "SELECT id, sha256(data) AS sha FROM texts t WHERE contains(data, chr(12))",
    "json_lines": """SELECT '{"id":' || id || ',"path":"' || path || '","size":' || size || '}' AS line FROM files WHERE ext = 'csv'""",
}
