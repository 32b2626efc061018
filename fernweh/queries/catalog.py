"""Filters, sorts, browsing, kinds and joins over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweh.corpus import NOW, Corpus
from fernweh.functions import formats, paths
from fernweh.functions import text as T
from fernweh.operators import duplicates, ranking, search
from fernweh.plans.compile import passes
from fernweh.plans.query import parse

DISPLAY = "CASE WHEN path = '/home/u' THEN '~' WHEN starts_with(path, '/home/u/') THEN substr(path, 9) ELSE path END"
TAGS = "list_transform(string_split(coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.tags') END, ''), chr(10)), lambda t: lower(t))"
BASE = r"regexp_extract(path, '([^/]*)$', 1)"
CONTENT = "(SELECT m.id, m.text, t.data FROM content_map m JOIN texts t ON t.id = m.text)"

# name of the query: (text in the language, the same in SQL)
FILTERS = {
    "filter_ext": ("ext:md,*.PDF", "ext IN ('md', 'pdf')"),
    "filter_ext_union": ("ext:md ext:csv", "ext IN ('md', 'csv')"),
    "filter_type": ("type:docs", "kind IN ('doc', 'pdf', 'markdown', 'text', 'slides', 'sheet', 'ebook')"),
    "filter_not_type": ("-type:image", "kind NOT IN ('image')"),
    "filter_in": ("in:~/Documents in:Archive", "(starts_with(path, '/home/u/Documents/') OR starts_with(path, '/home/u/Archive/'))"),
    "filter_path": ("path:P0-1 path:figure", f"contains(lower({DISPLAY}), 'p0-1') AND contains(lower({DISPLAY}), 'figure')"),
    "filter_size_over": ("size:>5k", "size >= 5120"),
    "filter_size_range": ("size:1k..4k", "size BETWEEN 1024 AND 4096"),
    "filter_size_about": ("size:=2k", "size BETWEEN 1843 AND 2253"),
    "filter_mtime_age": ("mtime:<90d", f"mtime >= {NOW} - 90 * 86400000::BIGINT"),
    "filter_mtime_old": ("mtime:>1y", f"mtime < {NOW} - 365 * 86400000::BIGINT"),
    "filter_before": ("before:2022-01-15", "mtime < 1642204800000"),
    "filter_after": ("after:7d", f"mtime >= {NOW} - 7 * 86400000::BIGINT"),
    "filter_month": ("mtime:2021-03", "mtime >= 1614556800000 AND mtime < 1617235200000"),
    "filter_year_until": ("mtime:<=2020", "mtime < 1609459200000"),
    "filter_created": ("created:2022", "created >= 1640995200000 AND created < 1672531200000"),
    "filter_tag": ("tag:URGENT tag:work", f"list_contains({TAGS}, 'urgent') AND list_contains({TAGS}, 'work')"),
    "filter_name": ("name:agenda", rf"regexp_matches({BASE}, '(?i)agenda')"),
    "filter_name_regex": (r"name:/^[a-m].*\d\./i", rf"regexp_matches({BASE}, '(?i)^[a-m].*\d\.')"),
    "filter_glob": ("*agenda*.md", rf"regexp_matches({BASE}, '(?i)^.*agenda.*\.md$')"),
    "filter_negated": ("-ext:py -size:<1k", "NOT (ext IN ('py')) AND NOT (size <= 1024)"),
    "filter_negated_tag": ("-tag:red type:image", f"NOT list_contains({TAGS}, 'red') AND kind = 'image'"),
}


def _filter(text):
    def run(spark, d):
        c = Corpus(spark, d)
        return c.files.filter(passes(parse(text, c.now, home=c.home).filters, c.home)).select("id")

    return run


def _sorted(sort, k=50):
    def run(spark, d):
        """Explicit sort with its limit; ties by path."""
        c = Corpus(spark, d)
        q = parse(f"sort:{sort} limit:{k} -type:folder", c.now)
        return search.browse(c, q).select("id", "path")

    return run


def kind_of(spark, d):
    """Extension and kind from the name alone, beside the catalog's."""
    return Corpus(spark, d).files.select("id", paths.ext_of(F.col("name")).alias("ext_of"), paths.kind_of(F.col("name"), F.col("is_dir")).alias("kind_of"))


def newest(spark, d):
    return ranking.newest(Corpus(spark, d).files.filter(~F.col("is_dir")), 100).select("id", "mtime")


def empty_query(spark, d):
    return search.empty_query(Corpus(spark, d), 60).select("id", "part")


def display_paths(spark, d):
    return Corpus(spark, d).files.select("id", paths.display(F.col("path"), "/home/u").alias("display"), paths.tildify(F.col("path"), "/home/u").alias("tilde"), paths.parent(F.col("path")).alias("parent"), F.size(paths.ancestors(F.col("path"))).alias("depth"))


def catalog_incremental(spark, d):
    """Rows a reader takes in that has seen the change log up to a number."""
    f = Corpus(spark, d).files
    seen = f.agg(F.floor(F.max("seq") / 2).alias("seen"))
    return f.crossJoin(F.broadcast(seen)).filter(F.col("seq") > F.col("seen")).select("id", "seq")


def frecency(spark, d):
    """Opens folded per path, with points."""
    c = Corpus(spark, d)
    f = ranking.frecency(c.table("opens"))
    last = F.unix_micros(F.col("last").cast("timestamp")) / 1000
    return f.select("path", "count", F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), F.round(ranking.frecency_points(F.col("count"), last, c.now), 6).alias("points"))


def recency(spark, d):
    return Corpus(spark, d).files.select("id", ranking.recency_points(F.col("mtime"), NOW).alias("points"))


def size_counts(spark, d):
    return duplicates.size_groups(Corpus(spark, d).files)


def folder_listing(spark, d):
    """Direct members of the folders at the top, folders first."""
    f = Corpus(spark, d).files
    return f.withColumn("parent", paths.parent(F.col("path"))).filter(F.col("parent") == "/home/u/Documents/p0-17-dialog").orderBy(F.desc("is_dir"), "name").select("id", "name", "is_dir")


def folder_totals(spark, d):
    """Files and bytes below every folder; a file counts for all its ancestors, pre-aggregated per folder it lies in."""
    own = Corpus(spark, d).files.filter(~F.col("is_dir")).groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    up = own.select(F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("folder"), "n", "bytes")
    return up.groupBy("folder").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"))


def content_view(spark, d):
    """Files with the length of their text."""
    return Corpus(spark, d).content.select("id", F.length("data").alias("chars"))


def embedding_candidates(spark, d):
    """Files that may be embedded, with or without a stored text."""
    c = Corpus(spark, d)
    return c.files.filter((F.col("content_state") == 1) & ~F.col("is_dir")).join(c.table("content_map").select("id", "hash"), "id", "left").select("id", "hash")


def orphans(spark, d):
    """Maintenance: recognised texts whose file is gone, vectors without a passage."""
    c = Corpus(spark, d)
    identity = ["dev", "ino", "size", "mtime"]
    ocr = c.table("ocr_cache").join(c.files.select(*identity).distinct(), identity, "left_anti").select(F.lit("ocr").alias("table"), F.col("id").cast("string").alias("key"))
    vec = c.table("vectors").select("hash").distinct().join(c.table("passages").select("hash"), "hash", "left_anti").select(F.lit("vectors").alias("table"), F.col("hash").alias("key"))
    return ocr.unionByName(vec)


def formatted(spark, d):
    """Sizes, days and ages as shown."""
    return Corpus(spark, d).files.select("id", formats.bytes_text(F.col("size")).alias("size_text"), formats.day(F.col("mtime")).alias("day"))


def csv_rows(spark, d):
    """Results as lines of a quoted table."""
    q = lambda x: F.concat(F.lit('"'), F.regexp_replace(x.cast("string"), '"', '""'), F.lit('"'))
    c = Corpus(spark, d)
    return c.files.filter(F.col("ext") == "md").select(F.concat_ws(",", q(F.col("path")), q(F.col("kind")), q(F.col("size")), q(F.timestamp_millis("mtime").cast("date"))).alias("line"))


def titles(spark, d):
    return Corpus(spark, d).files.select("id", T.title_of(F.col("name")).alias("title"))


QUERIES = {name: _filter(text) for name, (text, _) in FILTERS.items()} | {f"sort_{n}": _sorted(s) for n, s in (("name", "name"), ("size_desc", "-size"), ("date", "date"), ("path_desc", "-path"))}
QUERIES |= {f.__name__: f for f in (kind_of, newest, empty_query, display_paths, catalog_incremental, frecency, recency, size_counts, folder_listing, folder_totals, content_view, embedding_candidates, orphans, formatted, csv_rows, titles)}

SQL = {name: f"SELECT id FROM files WHERE {cond}" for name, (_, cond) in FILTERS.items()}
SQL |= {f"sort_{n}": f"SELECT id, path FROM files WHERE kind <> 'folder' ORDER BY {o}, path LIMIT 50" for n, o in (("name", "name"), ("size_desc", "size DESC"), ("date", "mtime"), ("path_desc", "path DESC"))}
_OPENED = "(SELECT path, count(*) AS n, max(ts) AS last FROM (SELECT DISTINCT path, ts, via FROM opens WHERE path IS NOT NULL) GROUP BY path)"
SQL |= {
    "kind_of": "SELECT id, ext AS ext_of, CASE WHEN ext = 'bin' THEN 'app' ELSE kind END AS kind_of FROM files",
    "newest": "SELECT id, mtime FROM files WHERE NOT is_dir ORDER BY mtime DESC, id LIMIT 100",
    "empty_query": f"""WITH o AS (SELECT id, path, last FROM {_OPENED} JOIN files USING (path) ORDER BY last DESC, id LIMIT 20)
        SELECT * FROM (SELECT id, part FROM (SELECT id, 0::INT AS part, epoch_us(last) AS t FROM o UNION ALL
          SELECT id, 1, mtime * 1000 FROM files WHERE NOT is_dir AND id NOT IN (SELECT id FROM o)) ORDER BY part, t DESC, id LIMIT 60)""",
    "display_paths": rf"""SELECT id, {DISPLAY} AS display, CASE WHEN path = '/home/u' THEN '~' WHEN starts_with(path, '/home/u/') THEN '~/' || substr(path, 9) ELSE path END AS tilde,
        CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent, greatest(len(string_split(path, '/')) - 2, 0)::INT AS depth FROM files""",
    "catalog_incremental": "SELECT id, seq FROM files WHERE seq > (SELECT max(seq) // 2 FROM files)",
    "frecency": f"""SELECT path, n AS count, epoch_us(last) AS last_us, round(least(30, 8 * log2(1 + n)) * exp(-(({NOW} - epoch_us(last) / 1000) / 86400000.0) / 30), 6) AS points FROM {_OPENED}""",
    "recency": f"SELECT id, CASE WHEN ({NOW} - mtime) / 86400000.0 < 7 THEN 4.0 WHEN ({NOW} - mtime) / 86400000.0 < 30 THEN 2.0 ELSE 0.0 END::DOUBLE AS points FROM files",
    "size_counts": "SELECT size, count(*) AS n FROM files WHERE NOT is_dir AND size > 0 GROUP BY size HAVING count(*) > 1",
    "folder_listing": "SELECT id, name, is_dir FROM files WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) = '/home/u/Documents/p0-17-dialog'",
    "folder_totals": """WITH RECURSIVE own AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n, sum(size) AS b FROM files WHERE NOT is_dir GROUP BY 1),
        up AS (SELECT dir AS folder, n, b FROM own UNION ALL SELECT regexp_extract(folder, '^(.*)/[^/]*$', 1), n, b FROM up WHERE regexp_extract(folder, '^(.*)/[^/]*$', 1) <> '')
        SELECT folder, sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes FROM up GROUP BY folder""",
    "content_view": "SELECT m.id, length(t.data)::INT AS chars FROM content_map m JOIN texts t ON t.id = m.text",
    "embedding_candidates": "SELECT f.id, m.hash FROM files f LEFT JOIN content_map m ON m.id = f.id WHERE f.content_state = 1 AND NOT f.is_dir",
    "orphans": """SELECT 'ocr' AS "table", id::VARCHAR AS key FROM ocr_cache o WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.dev = o.dev AND f.ino = o.ino AND f.size = o.size AND f.mtime = o.mtime)
        UNION ALL SELECT DISTINCT 'vectors', hash FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM passages p WHERE p.hash = v.hash)""",
    "formatted": """SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN CASE WHEN size / 1024.0 < 10 THEN printf('%.1f', round(size / 1024.0, 1)) ELSE round(size / 1024.0)::BIGINT::VARCHAR END || ' KB'
        ELSE CASE WHEN size / 1048576.0 < 10 THEN printf('%.1f', round(size / 1048576.0, 1)) ELSE round(size / 1048576.0)::BIGINT::VARCHAR END || ' MB' END AS size_text, strftime(epoch_ms(mtime), '%Y-%m-%d') AS day FROM files""",
    "csv_rows": """SELECT '"' || path || '","' || kind || '","' || size || '","' || strftime(epoch_ms(mtime), '%Y-%m-%d') || '"' AS line FROM files WHERE ext = 'md'""",
    "titles": r"""SELECT id, trim(regexp_replace(regexp_replace(name, '^(.+)\.[^.]*$', '\1'), '(\s*\(\d+\)|[\s_-]+copy(\s*\d+)?)$', '', 'i')) AS title FROM files""",
}
