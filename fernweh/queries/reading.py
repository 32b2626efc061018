"""Passages as lines, previews, pages, key sweeps, recent searches, completions, the state record."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweh.corpus import NOW, Corpus
from fernweh.operators import reading, search, snippets
from fernweh.plans.query import parse
from fernweh.queries.catalog import CONTENT
from fernweh.queries.health import _category
from fernweh.queries.matching import _LINES, _POST, _VOC


def passage_lines(spark, d):
    c = Corpus(spark, d)
    p = c.table("passages").filter("start_pos >= 0").select("file", "n", "start_pos", "end_pos").distinct()
    return reading.passage_lines(p, c.content, ["saffron"])


def preview_window(spark, d):
    return reading.preview(Corpus(spark, d).table("texts"), lambda x: F.lower(x).contains("saffron"), window=12).select("id", "line")


def preview_folded(spark, d):
    t = Corpus(spark, d).table("texts").filter(F.lower("data").contains("saffron"))
    return reading.preview(t, lambda x: F.lower(x).contains("saffron"), window=400, fold=True).select("id", "line")


def pages_of_lines(spark, d):
    t = Corpus(spark, d).table("texts").filter("instr(data, '\f') > 0")
    found = snippets.matching_lines(t, lambda x: F.length(x) > 60, 5)
    return reading.page_of_line(snippets.page_starts(t), found)


def key_sweep(spark, d):
    """Texts that hold a private key and have to be read again; every seventh file gets one first."""
    key = F.when(F.col("id") % 7 == 0, "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----\n").otherwise("")
    return reading.key_holders(Corpus(spark, d).content.withColumn("data", F.concat("data", key)))


def recent_paths(spark, d):
    return reading.recent(Corpus(spark, d).table("opens"), "path", "ts").select("name")


def state_record(spark, d):
    c = Corpus(spark, d)
    r = reading.state_record(c.files, c.table("index_runs"))
    return r.select("files", "errors", "last_run", "last_status", F.size("problems").alias("categories"))


def completions(spark, d):
    """The best fuzzy names that aren't folders."""
    c = Corpus(spark, d)
    return search.fuzzy_names(c, "saffr", 20, parse("-type:folder", c.now).filters).limit(20).select("id")


def containing_terms(spark, d):
    v = search.vocabulary(Corpus(spark, d)).filter("NOT is_long")
    return search.containing_terms(v, "affro")


def negated_words(spark, d):
    """Files near a word, without those whose name or text holds another."""
    c = Corpus(spark, d)
    return search.keyword_ids(c, ["saffron"], ["barley", "narrow"]).join(c.files.filter("kind NOT IN ('code', 'data')").select("id"), "id", "left_semi").select("id")


def line_counts(spark, d):
    return reading.line_count(Corpus(spark, d).table("texts"))


def prompts_embedded(spark, d):
    """Distinct prompts through the stand-in model: their vectors' lengths."""
    p = Corpus(spark, d).table("passages").filter("prompt IS NOT NULL").select("hash", "prompt")
    return reading.embedded(p).select("hash", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def recently_read(spark, d):
    return reading.retry_due(Corpus(spark, d).files.withColumn("note", F.when(F.col("content_state") == 3, "OCR timed out")).withColumn("content_state", F.when(F.col("content_state") == 3, 2).otherwise(F.col("content_state"))), None, NOW)


QUERIES = {f.__name__: f for f in (passage_lines, preview_window, preview_folded, pages_of_lines, key_sweep, recent_paths, state_record, completions, containing_terms, negated_words, line_counts, prompts_embedded, recently_read)}

_HITS = f"(SELECT id, line FROM {_LINES} WHERE contains(lower(text), 'saffron'))"
SQL = {
    "passage_lines": rf"""WITH p AS (SELECT DISTINCT file, n, start_pos, end_pos FROM passages WHERE start_pos >= 0), s AS (SELECT file, n, string_split_regex(substr(data, start_pos + 1, end_pos - start_pos), '[\n\f]') AS l, len(string_split_regex(substr(data, 1, start_pos), '[\n\f]')) AS f FROM p JOIN {CONTENT} c ON c.id = p.file),
        r AS (SELECT file, n, f, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM s), h AS (SELECT *, contains(lower(strip_accents(text)), 'saffron') AS hit FROM r),
        k AS (SELECT *, bool_or(hit) OVER (PARTITION BY file, n, f, i - i) AS any_hit FROM h) SELECT file, n, line, text FROM (SELECT file, n, (f + i - 1)::INT AS line, text, any_hit, row_number() OVER (PARTITION BY file, n, f ORDER BY i) AS o FROM k WHERE CASE WHEN any_hit THEN hit ELSE trim(text, ' ') <> '' END) WHERE o <= CASE WHEN any_hit THEN 3 ELSE 2 END""",
    "preview_window": f"WITH l AS (SELECT * FROM {_LINES}), f AS (SELECT id, min(line) AS focus FROM {_HITS} GROUP BY id) SELECT l.id, l.line FROM l LEFT JOIN f USING (id) WHERE l.line >= greatest(1, coalesce(focus, 1) - 3) AND l.line < greatest(1, coalesce(focus, 1) - 3) + 12",
    "preview_folded": f"WITH l AS (SELECT * FROM {_LINES}) SELECT id, line FROM (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY line) AS o FROM (SELECT DISTINCT l.id, l.line FROM l JOIN {_HITS} h ON h.id = l.id AND abs(h.line - l.line) <= 2)) WHERE o <= 400",
    "pages_of_lines": r"""SELECT id, line, page FROM (SELECT id, line, (1 + len(regexp_extract_all(array_to_string(list_slice(ends, 1, line - 1), ''), '\f')))::INT AS page, row_number() OVER (PARTITION BY id ORDER BY line) AS o FROM (
        SELECT id, unnest(string_split_regex(data, '[\n\f]')) AS text, generate_subscripts(string_split_regex(data, '[\n\f]'), 1)::INT AS line, regexp_extract_all(data, '[\n\f]') AS ends FROM texts WHERE contains(data, chr(12))) WHERE length(text) > 60) WHERE o <= 5""",
    "key_sweep": f"SELECT id FROM {CONTENT} WHERE id % 7 = 0 OR regexp_matches(data, '-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----|PuTTY-User-Key-File')",
    "recent_paths": "SELECT name FROM (SELECT arg_max(path, struct_pack(ts, path)) AS name, max(ts) AS t FROM opens WHERE path IS NOT NULL GROUP BY upper(path)) ORDER BY t DESC, name LIMIT 50",
    "state_record": f"SELECT count(*) FILTER (WHERE NOT is_dir) AS files, count(*) FILTER (WHERE content_state = 2) AS errors, (SELECT max(run_id) FROM index_runs) AS last_run, (SELECT arg_max(status, run_id) FROM index_runs) AS last_status, count(DISTINCT {_category()})::INT AS categories FROM files",
    "containing_terms": f"SELECT term FROM {_VOC} WHERE contains(term, 'affro') AND term <> 'affro' AND NOT regexp_matches(term, '^[a-z0-9]{{32,64}}$')",
    "negated_words": f"SELECT DISTINCT id FROM {_POST} WHERE term = 'saffron' AND id NOT IN (SELECT id FROM {_POST} WHERE term IN ('barley', 'narrow')) AND id IN (SELECT id FROM files WHERE kind NOT IN ('code', 'data'))",
    "line_counts": r"SELECT id, len(string_split_regex(data, '[\n\f]'))::BIGINT AS lines, (1 + len(regexp_extract_all(data, '\f')))::INT AS pages FROM texts",
    "prompts_embedded": "SELECT DISTINCT hash, 1.0::DOUBLE AS norm FROM passages WHERE prompt IS NOT NULL",
    "recently_read": "SELECT id FROM files WHERE content_state = 3 AND kind IN ('image', 'audio', 'video')",
}
