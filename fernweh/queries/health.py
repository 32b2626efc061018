"""Index health, policy, copies, moves, contents and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweh.corpus import NOW, Corpus
from fernweh.functions import paths
from fernweh.functions import text as T
from fernweh.operators import duplicates, health, policy, search, store
from fernweh.queries.catalog import CONTENT, DISPLAY

RULES = [("/home/u", "*.log"), ("/home/u/Documents", "p0-1?-*/"), ("/home/u/Documents", "!p0-17-*/"), ("/home/u/Archive", "/p0-1-figure/*.md"), ("/home/u", "**/draft*")]


def index_stats(spark, d):
    return health.stats(Corpus(spark, d).files)


def problem_counts(spark, d):
    return health.problems(Corpus(spark, d).files, cloud=["/home/u/Archive"], names_only=["/home/u/Desktop"]).groupBy("category").agg(F.count("*").alias("n"))


def problem_list(spark, d):
    return health.problems(Corpus(spark, d).files, "documents").select("id", "category", "retry")


def problem_page(spark, d):
    return health.problem_page(health.problems(Corpus(spark, d).files), 10, 20).select("id", "category")


def problem_reasons(spark, d):
    return health.problems(Corpus(spark, d).files).filter("category = 'unreadable'").select("id", "reason")


def retry(spark, d):
    """Files after those that couldn't be read are queued again."""
    return health.retried(Corpus(spark, d).files, ["unreadable", "secret"]).groupBy("content_state").agg(F.count("*").alias("n"), F.count("note").alias("notes"))


def text_reasons(spark, d):
    return health.text_reason(Corpus(spark, d).files)


def machine_names(spark, d):
    return Corpus(spark, d).files.filter(~F.col("is_dir")).select("id", health.machine_named(F.col("name")).alias("machine"))


def dataset_folders(spark, d):
    """Folders of pictures with names a program gave, at a bound that small corpora reach."""
    return health.dataset_folders(Corpus(spark, d).files, ["/home/u"], least=2, share=0.0).select("dir", "images")


def estimate(spark, d):
    e = health.estimate(Corpus(spark, d).files)
    return e.withColumn("seconds", F.round("seconds", 6))


def diagnosis(spark, d):
    """Why 'saffron in:~/Desktop ext:csv size:>100m' finds nothing."""
    c = Corpus(spark, d)
    return health.diagnose(c.catalog, c.content, "saffron in:~/Desktop ext:csv size:>100m", c.now)


def unreadable_files(spark, d):
    return health.unreadable(Corpus(spark, d).files, "type:docs in:~/Documents", NOW)


def crawled(spark, d):
    return policy.crawled(Corpus(spark, d).files, policy.Settings(excluded=("/home/u/Archive",))).select("id")


def ignored(spark, d):
    return policy.ignored(Corpus(spark, d).files, RULES)


def ignore_files(spark, d):
    """The same rules, read from ignore files that stand in the folders."""
    c = Corpus(spark, d)
    by_folder: dict = {}
    for base, pattern in RULES:
        by_folder.setdefault(base, []).append(pattern)
    rows = [(-1 - k, f"{base}/.gitignore", "# rules\n\n" + "\n".join(lines), False, 100, "") for k, (base, lines) in enumerate(by_folder.items())]
    extra = spark.createDataFrame(rows, "id bigint, path string, data string, is_dir boolean, size bigint, source_path string")
    rules = policy.rules_in(extra.drop("data"), extra.select("id", "data"))
    return policy.ignored_by(c.files, rules)


def policy_changes(spark, d):
    """What other settings change."""
    return policy.policy_changes(Corpus(spark, d).files, policy.Settings(excluded=("/home/u/Archive",)), policy.Settings(names_only=("/home/u/Desktop",), excluded=("/home/u/Downloads",)))


def crawl_targets(spark, d):
    """The least walk that covers what was opened."""
    c = Corpus(spark, d)
    changed = c.table("opens").filter("path IS NOT NULL").select("path").distinct()
    return policy.targets(changed, c.files, ["/home/u"])


def access(spark, d):
    s = policy.Settings(excluded=("/home/u/Archive",), names_only=("/home/u/Desktop",), speech=False)
    return policy.access(Corpus(spark, d).files, s)


def wants_content(spark, d):
    return Corpus(spark, d).files.filter(~F.col("is_dir")).select("id", policy.wants_content(F.col("ext"), F.col("kind")).alias("wanted"))


def work_order(spark, d):
    f = Corpus(spark, d).files.filter("content_state = 4")
    return f.orderBy(policy.work_order(f)).limit(200).select("id")


def text_dedup(spark, d):
    return duplicates.dedup_texts(Corpus(spark, d).table("texts"))


def duplicate_groups(spark, d):
    c = Corpus(spark, d)
    return duplicates.groups(duplicates.hashed(c.files, c.table("content_map"), c.table("texts")))


def hard_links(spark, d):
    """Files that are one file under several names."""
    f = Corpus(spark, d).files.filter(~F.col("is_dir"))
    return f.groupBy("dev", "ino").agg(F.count("*").alias("names"), F.min("path").alias("first")).filter("names > 1")


def folded_hits(spark, d):
    """The newest files, copies folded into the best."""
    c = Corpus(spark, d)
    from fernweh.operators.ranking import ranked

    hits = ranked(c.files.filter(~F.col("is_dir") & (F.col("size") > 0)), [F.desc("mtime"), F.asc("id")], 300).select("id", "rank")
    rows = duplicates.hashed(c.files, c.table("content_map"), c.table("texts"))
    return duplicates.fold_copies(hits, rows).select("id", "rank", F.size("copies").alias("copies"), "copies_more")


def _old_new(c):
    """Two states of the catalog: some files gone, some grown, some under a new name."""
    f = c.files
    old = f.filter("id % 11 <> 0")
    new = f.filter("id % 13 <> 0").withColumn("size", F.when((F.col("id") % 17 == 0) & ~F.col("is_dir"), F.col("size") + 1).otherwise(F.col("size")))
    return old, new.withColumn("path", F.when((F.col("id") % 19 == 0) & ~F.col("is_dir"), F.concat("path", F.lit(".moved"))).otherwise(F.col("path")))


def index_diff(spark, d):
    return duplicates.index_diff(*_old_new(Corpus(spark, d)))


def index_diff_protected(spark, d):
    """Vanished rows below a folder that couldn't be read are kept."""
    return duplicates.protected(duplicates.index_diff(*_old_new(Corpus(spark, d))), ["/home/u/Downloads"]).groupBy("action").agg(F.count("*").alias("n"))


def moved_files(spark, d):
    return duplicates.moves(*[x.filter(~F.col("is_dir")) for x in _old_new(Corpus(spark, d))])


def written_contents(spark, d):
    """Files after some got the texts of others and some new ones: hash of each file's text, and whether the text is a new row."""
    c = Corpus(spark, d)
    given = c.content.filter("id % 5 = 0").select((F.col("id") + 1).alias("id"), F.when(F.col("id") % 2 == 0, F.col("data")).otherwise(F.concat("data", F.lit(" again"))).alias("data"))
    added, removed, users = store.write_contents(c.table("content_map").select("id", "text"), c.table("texts"), given)
    kept = c.table("texts").select("id").join(removed, "id", "left_anti").select(F.col("id").alias("text"), F.lit(False).alias("new"))
    return users.join(kept.unionByName(added.select(F.col("id").alias("text"), F.lit(True).alias("new"))), "text").select("id", "hash", "new")


def vocabulary_append(spark, d):
    """Words that texts of odd ids add to those of even ids."""
    t = Corpus(spark, d).table("texts")
    terms = lambda rest: t.filter(F.col("id") % 2 == rest).select(F.explode(T.terms(F.col("data"))).alias("term"))
    return store.append_vocabulary(terms(0).distinct(), terms(1))


def tidied(spark, d):
    return Corpus(spark, d).table("texts").select("id", F.length(T.tidy(F.col("data"))).alias("chars"))


def metadata_text(spark, d):
    """Metadata as lines before the text."""
    f = Corpus(spark, d).files.filter("metadata <> ''")
    m = F.map_entries(F.from_json("metadata", "map<string,string>"))
    return f.select("id", F.array_join(F.transform(F.array_sort(m), lambda e: F.concat(e["key"], F.lit(": "), F.regexp_replace(e["value"], "\n", ", "))), "\n").alias("head")).filter("head IS NOT NULL")


def stale_reads(spark, d):
    """Files read more than thirty days ago."""
    return Corpus(spark, d).files.filter(F.col("read_at").isNotNull() & (F.col("read_at") < NOW - 30 * 86_400_000)).select("id")


def last_runs(spark, d):
    """Runs by status, and the last good one."""
    return Corpus(spark, d).table("index_runs").groupBy("status").agg(F.count("*").alias("runs"), F.max("run_id").alias("last"))


QUERIES = {f.__name__: f for f in (index_stats, problem_counts, problem_list, problem_page, problem_reasons, retry, text_reasons, machine_names, dataset_folders, estimate, diagnosis, unreadable_files, crawled, ignored, ignore_files, policy_changes, crawl_targets, access, wants_content, work_order, text_dedup, duplicate_groups, hard_links, folded_hits, index_diff, index_diff_protected, moved_files, written_contents, vocabulary_append, tidied, metadata_text, stale_reads, last_runs)}

_FOLD = "lower(translate(regexp_replace({}, '([A-Za-z])[" + chr(0x300) + "-" + chr(0x36F) + "]+', '\\1', 'g'), '" + T.ACCENTED + "', '" + T.BASE + "'))"
_Q = lambda xs: ", ".join(f"'{x}'" for x in xs)
_MEDIA, _DOCS, _OCR = _Q(paths.MEDIA_EXTS), _Q(paths.DOCUMENT_EXTS), _Q(paths.OCR_EXTS)
_PARENT = r"CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"


def _category(cloud="false", names="false"):
    return f"""CASE WHEN content_state = 2 AND ext IN ({_MEDIA}) THEN 'transcription' WHEN content_state = 2 AND regexp_matches(note, '(?i)timed out|deadline') THEN 'timeout' WHEN content_state = 2 THEN 'unreadable'
        WHEN content_state = 3 AND note = 'too-large' THEN 'too-large' WHEN content_state = 3 AND note IN ('empty', 'unsupported') AND (ext IN ({_DOCS}) OR (kind = 'image' AND ext IN ({_OCR})) OR ext IN ({_MEDIA})) THEN 'no-text'
        WHEN content_state = 1 AND note = 'truncated' THEN 'truncated' WHEN content_state = 3 AND note = 'dataset' THEN 'dataset' WHEN content_state = 3 AND note = 'secret' THEN 'secret' WHEN content_state = 0 AND NOT is_dir AND {cloud} THEN 'cloud' WHEN content_state = 0 AND NOT is_dir AND {names} THEN 'names-only' END"""


_REASON = "CASE " + " ".join(f"WHEN regexp_matches(note, '{rx}') THEN '{m}'".replace("It's", "It''s").replace("can't", "can''t") for rx, m in health.MEANINGS) + " ELSE 'It could not be read.' END"
_DIFF = """old AS (SELECT * FROM files WHERE id % 11 <> 0), new AS (SELECT CASE WHEN id % 19 = 0 AND NOT is_dir THEN path || '.moved' ELSE path END AS path, CASE WHEN id % 17 = 0 AND NOT is_dir THEN size + 1 ELSE size END AS size, mtime, ctime_ms, is_dir, kind, dev, ino FROM files WHERE id % 13 <> 0),
    gone AS (SELECT dev, ino, size, mtime, min(path) AS p FROM old WHERE NOT is_dir AND path NOT IN (SELECT path FROM new) GROUP BY ALL HAVING count(*) = 1), come AS (SELECT dev, ino, size, mtime, min(path) AS p FROM new WHERE NOT is_dir AND path NOT IN (SELECT path FROM old) GROUP BY ALL HAVING count(*) = 1),
    mv AS (SELECT g.p AS old_path, c.p AS new_path FROM gone g JOIN come c USING (dev, ino, size, mtime)),
    df AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.size = n.size AND o.mtime = n.mtime AND o.ctime_ms IS NOT DISTINCT FROM n.ctime_ms AND o.is_dir = n.is_dir AND o.kind = n.kind THEN 'unchanged' ELSE 'updated' END AS action FROM old o FULL JOIN new n ON n.path = o.path),
    fin AS (SELECT path, CASE WHEN path IN (SELECT new_path FROM mv) THEN 'moved' ELSE action END AS action FROM df WHERE path NOT IN (SELECT old_path FROM mv))"""
_HASHED = """hs AS (SELECT f.id, f.path, f.size, f.dev, f.ino, f.mtime, left(sha256(c.data), 32) AS sha FROM files f LEFT JOIN (SELECT m.id, t.data FROM content_map m JOIN texts t ON t.id = m.text) c ON c.id = f.id WHERE NOT f.is_dir AND f.size > 0),
    hh AS (SELECT * REPLACE (coalesce(sha, max(sha) OVER (PARTITION BY dev, ino)) AS sha) FROM hs)"""
_IN = lambda p: f"starts_with(path, '{p}/')"
_SAFFRON = f"(contains(lower({DISPLAY}), 'saffron') OR id IN (SELECT id FROM {CONTENT} WHERE contains(lower(data), 'saffron')))"
_ANC = "(SELECT f.path, list_transform(range(2, len(string_split(f.path, '/'))), lambda n: array_to_string(list_slice(string_split(f.path, '/'), 1, n::INT), '/')) AS a, f.is_dir, f.id FROM files f)"


def _ignored_sql():
    tests = {"path": "", "dir": ""}
    for col, is_dir in (("path", "is_dir"), ("dir", "true")):
        case = "false"
        for base, p in sorted(RULES, key=lambda r: r[0].count("/")):
            rx, keep, folder = policy.ignore_regex(p)
            fits = f"starts_with({col}, '{base}/') AND regexp_matches(substr({col}, {len(base) + 2}), '{rx}')" + (f" AND {is_dir}" if folder else "")
            case = f"CASE WHEN {fits} THEN {'false' if keep else 'true'} ELSE {case} END"
        tests[col] = case
    return f"SELECT id FROM files WHERE {tests['path']} UNION SELECT id FROM (SELECT id, unnest(a) AS dir FROM {_ANC}) WHERE {tests['dir']}"


SQL = {
    "index_stats": "SELECT count(*) FILTER (WHERE NOT is_dir) AS files, count(*) FILTER (WHERE is_dir) AS folders, count(*) FILTER (WHERE content_state = 1) AS with_content, count(*) FILTER (WHERE content_state = 2) AS errors, count(*) FILTER (WHERE content_state = 3) AS skipped, count(*) FILTER (WHERE content_state = 4) AS pending, count(*) FILTER (WHERE content_state = 3 AND note = 'secret') AS secrets, coalesce(sum(content_len) FILTER (WHERE content_state = 1), 0)::BIGINT AS content_chars FROM files",
    "problem_counts": f"SELECT category, count(*) AS n FROM (SELECT {_category(_IN('/home/u/Archive'), _IN('/home/u/Desktop'))} AS category FROM files) WHERE category IS NOT NULL GROUP BY category",
    "problem_list": f"SELECT id, category, category IN ('transcription', 'timeout', 'unreadable', 'truncated') AS retry FROM (SELECT id, path, {_category()} AS category FROM files) WHERE category IS NOT NULL AND contains(lower(path), 'documents')",
    "problem_page": f"SELECT id, category FROM (SELECT id, path, {_category()} AS category FROM files) WHERE category IS NOT NULL ORDER BY list_position([{_Q(health.CATEGORIES)}], category), path LIMIT 20 OFFSET 10",
    "problem_reasons": f"SELECT id, {_REASON} AS reason FROM files WHERE {_category()} = 'unreadable'",
    "retry": f"SELECT CASE WHEN {_category()} IS NOT DISTINCT FROM 'unreadable' THEN 4 ELSE content_state END AS content_state, count(*) AS n, count(CASE WHEN {_category()} IS DISTINCT FROM 'unreadable' THEN note END) AS notes FROM files GROUP BY 1",
    "text_reasons": f"""SELECT id, CASE WHEN is_dir THEN 'folder' WHEN content_state = 1 THEN 'searchable' WHEN content_state = 4 THEN 'not read yet' WHEN content_state = 3 AND note = 'binary' THEN 'binary' WHEN content_state = 3 AND note = 'empty' THEN 'empty' WHEN content_state = 3 AND note = 'too-large' THEN 'too large'
        WHEN content_state = 3 THEN 'not readable with these settings' WHEN content_state = 2 THEN {_REASON} WHEN kind IN ('code', 'text', 'markdown', 'data', 'web', 'other') THEN 'read next' ELSE 'by name only' END AS reason FROM files""",
    "machine_names": r"""SELECT id, CASE WHEN regexp_matches(s, '\s') OR regexp_matches(s, '(?i)^(img|dsc[nf]?|pxl|mvimg|gopr|gh|dji|sam|wp|p|photo|scan|page|screenshot|capture)[_-]?\d') OR regexp_matches(s, '^((19|20)\d{6}[_-]\d{6}([_-]?\d{1,3})?|1\d{12})(\(\d+\))?$') THEN false
        WHEN regexp_matches(s, '(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$') OR regexp_matches(s, '(?i)^[0-9a-f]{16,}$') THEN true ELSE length(regexp_replace(s, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(s, '[^0-9]', '', 'g')) * 2 >= length(s) END AS machine
        FROM (SELECT id, regexp_replace(name, '^(.+)\.[^.]*$', '\1', 's') AS s FROM files WHERE NOT is_dir)""",
    "dataset_folders": f"SELECT dir, count(*) AS images FROM (SELECT {_PARENT} AS dir FROM files WHERE ext IN ({_OCR}) AND NOT is_dir) WHERE dir <> '/home/u' GROUP BY dir HAVING count(*) >= 2",
    "estimate": f"""SELECT *, round((files + folders) / 15000.0::DOUBLE + (text_files * 0.0003::DOUBLE + text_bytes / 12582912.0::DOUBLE + documents * 0.06::DOUBLE) / 4 + ocr_images * 0.2::DOUBLE / 2, 6) AS seconds FROM (SELECT count(*) FILTER (WHERE NOT is_dir) AS files, count(*) FILTER (WHERE is_dir) AS folders,
        count(*) FILTER (WHERE NOT is_dir AND size > 0 AND t) AS text_files, coalesce(sum(CASE WHEN kind = 'other' THEN least(size, 8192) ELSE size END) FILTER (WHERE NOT is_dir AND size > 0 AND t), 0)::BIGINT AS text_bytes, count(*) FILTER (WHERE NOT is_dir AND size > 0 AND ext IN ({_DOCS}) AND size <= 67108864) AS documents,
        count(*) FILTER (WHERE NOT is_dir AND size > 0 AND kind = 'image' AND ext IN ({_OCR}) AND size <= 67108864) AS ocr_images FROM (SELECT *, kind IN ('code', 'text', 'markdown', 'data', 'web', 'other') AND ext NOT IN ({_DOCS}) AND size <= 8388608 AS t FROM files))""",
    "diagnosis": f"""SELECT 'as written' AS filter, count(*) AS count FROM files WHERE {_SAFFRON} AND {_IN('/home/u/Desktop')} AND ext = 'csv' AND size >= 104857600 UNION ALL SELECT 'size', count(*) FROM files WHERE {_SAFFRON} AND {_IN('/home/u/Desktop')} AND ext = 'csv'
        UNION ALL SELECT 'type', count(*) FROM files WHERE {_SAFFRON} AND {_IN('/home/u/Desktop')} AND size >= 104857600 UNION ALL SELECT 'folder', count(*) FROM files WHERE {_SAFFRON} AND ext = 'csv' AND size >= 104857600 UNION ALL SELECT 'all', count(*) FROM files WHERE {_SAFFRON}""",
    "unreadable_files": f"SELECT count(*) AS unreadable FROM files WHERE content_state = 2 AND NOT is_dir AND kind IN ('doc', 'pdf', 'markdown', 'text', 'slides', 'sheet', 'ebook') AND {_IN('/home/u/Documents')}",
    "crawled": f"""SELECT id FROM (SELECT id, path, list_slice(string_split(path, '/'), 4, len(string_split(path, '/'))::INT) AS parts FROM files WHERE {_IN('/home/u')} AND NOT {_IN('/home/u/Archive')} AND path <> '/home/u/Archive')
        WHERE NOT list_has_any(list_slice(parts, 1, (len(parts) - 1)::INT), [{_Q(policy.SKIP_DIRS)}]) AND len(parts) <= 64 AND len(list_filter(parts, lambda p: starts_with(p, '.'))) = 0
        AND len(list_filter(list_slice(parts, 1, (len(parts) - 1)::INT), lambda p: regexp_matches(p, '(?i).\\.({'|'.join(policy.PACKAGES)})$'))) = 0""",
    "ignored": _ignored_sql(),
    "ignore_files": _ignored_sql(),
    "policy_changes": f"""SELECT * FROM (SELECT id, CASE WHEN d0 = 0 AND d1 = 1 THEN 'remove' WHEN d0 = 0 AND h0 = 0 AND (d1 = 1 OR h1 = 1) THEN 'drop' WHEN (d0 = 1 OR h0 = 1) AND d1 = 0 AND h1 = 0 THEN 'read' END AS action FROM (
        SELECT id, (NOT r OR l OR a)::INT AS d0, s::INT AS h0, (NOT r OR l OR o)::INT AS d1, (s OR n)::INT AS h1 FROM (SELECT id, path = '/home/u' OR {_IN('/home/u')} AS r, coalesce(source_path, '') <> '' AS l, path = '/home/u/Archive' OR {_IN('/home/u/Archive')} AS a, path = '/home/u/Downloads' OR {_IN('/home/u/Downloads')} AS o,
          path = '/home/u/Desktop' OR {_IN('/home/u/Desktop')} AS n, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)^(id_(rsa|dsa|ecdsa|ed25519)|.*[.](pem|key|p12|pfx|kdbx|ppk))$') AS s FROM files WHERE NOT is_dir))) WHERE action IS NOT NULL""",
    "crawl_targets": rf"""WITH RECURSIVE c0 AS (SELECT DISTINCT CASE WHEN regexp_extract(path, '([^/]*)$', 1) IN ('.gitignore', '.ignore') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE path END AS path FROM opens WHERE path IS NOT NULL AND (path = '/home/u' OR starts_with(path, '/home/u/'))),
        an AS (SELECT path, list_transform(range(2, len(string_split(path, '/'))), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n::INT), '/')) AS a FROM c0), ex AS (SELECT path, unnest(a) AS dir FROM an),
        gone AS (SELECT path, min(dir) AS g FROM ex WHERE starts_with(dir, '/home/u/') AND dir NOT IN (SELECT path FROM files WHERE is_dir) GROUP BY path),
        c AS (SELECT DISTINCT coalesce(g, c0.path) AS path FROM c0 LEFT JOIN gone USING (path))
        SELECT path FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE starts_with(c.path, x.path || '/'))""",
    "access": f"""SELECT id, denied IS NULL AS allowed, denied IS NULL AND held IS NULL AS content_ok, coalesce(denied, held) AS reason FROM (SELECT id, CASE WHEN NOT (path = '/home/u' OR {_IN('/home/u')}) THEN 'outside indexed folders' WHEN coalesce(source_path, '') <> '' AND NOT starts_with(source_path, '/home/u/') THEN 'link target is outside'
        WHEN coalesce(source_path, '') <> '' THEN 'links are disabled' WHEN path = '/home/u/Archive' OR {_IN('/home/u/Archive')} THEN 'excluded' END AS denied, CASE WHEN regexp_matches(name, '(?i)^(id_(rsa|dsa|ecdsa|ed25519)|.*\\.(pem|key|p12|pfx|kdbx|ppk))$') THEN 'secret' WHEN path = '/home/u/Desktop' OR {_IN('/home/u/Desktop')} THEN 'names only'
        WHEN ext IN ({_MEDIA}) THEN 'speech is off' END AS held FROM files)""",
    "wants_content": f"SELECT id, kind IN ('code', 'text', 'markdown', 'data', 'web', 'other') OR ext IN ({_DOCS}, 'ics', 'vcf') OR (kind = 'image' AND ext IN ({_OCR})) AS wanted FROM files WHERE NOT is_dir",
    "work_order": f"SELECT id FROM files WHERE content_state = 4 ORDER BY CASE WHEN ext IN ({_MEDIA}) THEN 2 WHEN kind = 'image' THEN 1 ELSE 0 END, mtime DESC, id LIMIT 200",
    "text_dedup": "SELECT left(sha256(data), 32) AS hash, min(id) AS id, count(*) AS users FROM texts GROUP BY 1",
    "duplicate_groups": f"WITH {_HASHED} SELECT size, sha, count(*) AS n, min(path) AS first FROM hh WHERE sha IS NOT NULL GROUP BY size, sha HAVING count(*) > 1",
    "hard_links": "SELECT dev, ino, count(*) AS names, min(path) AS first FROM files WHERE NOT is_dir GROUP BY dev, ino HAVING count(*) > 1",
    "folded_hits": f"""WITH {_HASHED}, hit AS (SELECT id, (row_number() OVER (ORDER BY mtime DESC, id) - 1)::INT AS rank FROM files WHERE NOT is_dir AND size > 0 ORDER BY mtime DESC, id LIMIT 300), k AS (SELECT hit.id, rank, size, CASE WHEN sha IS NOT NULL THEN size || ':' || sha ELSE 'inode:' || dev || ':' || ino END AS key FROM hit JOIN hh USING (id)),
        g AS (SELECT key, min(rank) AS rank, arg_min(id, rank) AS id, any_value(size) AS size, count(*) - 1 AS copies FROM k GROUP BY key) SELECT g.id, g.rank, g.copies::INT AS copies, (SELECT count(*) FROM hh WHERE hh.size = g.size) > g.copies + 1 AS copies_more FROM g""",
    "index_diff": f"WITH {_DIFF} SELECT path, action FROM fin",
    "index_diff_protected": f"WITH {_DIFF} SELECT CASE WHEN action = 'removed' AND {_IN('/home/u/Downloads')} THEN 'kept' ELSE action END AS action, count(*) AS n FROM fin GROUP BY 1",
    "moved_files": f"WITH {_DIFF} SELECT old_path, new_path FROM mv",
    "written_contents": f"""WITH n AS (SELECT id + 1 AS id, CASE WHEN id % 2 = 0 THEN data ELSE data || ' again' END AS data FROM {CONTENT} WHERE id % 5 = 0), u AS (SELECT m.id, t.data FROM content_map m JOIN texts t ON t.id = m.text WHERE m.id NOT IN (SELECT id FROM n) UNION ALL SELECT id, data FROM n)
        SELECT id, left(sha256(data), 32) AS hash, data NOT IN (SELECT data FROM texts WHERE data IS NOT NULL) AS new FROM u""",
    "vocabulary_append": rf"WITH t AS (SELECT id, unnest(list_distinct(regexp_extract_all({_FOLD.format('data')}, '[\p{{L}}\p{{N}}]+'))) AS term FROM texts) SELECT DISTINCT term FROM t WHERE id % 2 = 1 AND term NOT IN (SELECT term FROM t WHERE id % 2 = 0) AND length(term) <= 1024",
    "tidied": r"SELECT id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(data, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\v\r]+', ''), '[ \t\n\v\r]+$', ''))::INT AS chars FROM texts",
    "metadata_text": """SELECT id, array_to_string(list_transform(list_sort(json_keys(metadata)), lambda k: k || ': ' || replace(json_extract_string(metadata, '$."' || k || '"'), chr(10), ', ')), chr(10)) AS head FROM files WHERE metadata <> '' AND json_valid(metadata)""",
    "stale_reads": f"SELECT id FROM files WHERE read_at IS NOT NULL AND read_at < {NOW} - 30 * 86400000::BIGINT",
    "last_runs": "SELECT status, count(*) AS runs, max(run_id) AS last FROM index_runs GROUP BY status",
}
