"""Finding text: literals, patterns, words, proximity, folding, keyword search, fuzzy and typo-tolerant names, groups, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweh.corpus import Corpus
from fernweh.functions import formats, fuzzy, paths
from fernweh.functions import text as T
from fernweh.operators import ranking, search, snippets, store
from fernweh.operators.policy import Settings
from fernweh.plans.compile import Matcher, pattern_of
from fernweh.plans.query import groups, parse
from fernweh.queries.catalog import CONTENT, DISPLAY
from fernweh.runtime import shared_path

FOLD = "lower(translate(regexp_replace({}, '([A-Za-z])[" + chr(0x300) + "-" + chr(0x36F) + "]+', '\\1', 'g'), '" + T.ACCENTED + "', '" + T.BASE + "'))"  # the same letters as the operator's
WORDS = r"'[\p{L}\p{N}]+'"


def _counts(text):
    def run(spark, d):
        c = Corpus(spark, d)
        return search.content_matches(c, parse(text, c.now)).select("id", "count")

    return run


def _count_sql(pattern, flags="", where="true", view="data"):
    return f"SELECT c.id, least(10000, len(regexp_extract_all({view}, '{pattern}', 0, '{flags}')))::INT AS count FROM {CONTENT} c JOIN files f ON f.id = c.id WHERE NOT f.is_dir AND {where} AND regexp_matches({view}, '{pattern}', '{flags}')"


COUNTS = {
    "find_literal": ("saffron", _count_sql("saffron", "i")),
    "find_case": ("Velurvane", _count_sql("Velurvane", "c")),
    "find_filtered": ("saffron type:text size:>1k", _count_sql("saffron", "i", "f.kind IN ('text', 'markdown') AND f.size >= 1024")),
    "find_case_on": ("The case:on", _count_sql("The", "c")),
    "regex_find": (r"/\b\w+tion\b/", _count_sql(r"\b\w+tion\b", "i")),
    "regex_alternatives": ("/(saffron|barley)s?/i", _count_sql("(saffron|barley)s?", "i")),
    "near_words": ("the of near:3", _count_sql(r"the([^\p{L}\p{N}]+[\p{L}\p{N}]+){0,3}[^\p{L}\p{N}]+of", "i")),
    "diacritics_off": ("reunion diacritics:off", _count_sql("reunion", "", view=FOLD.format("data"))),
}


def all_words(spark, d):
    """Every word somewhere in the text."""
    c = Corpus(spark, d)
    m = Matcher(parse('all:saffron "narrow" barley', c.now))
    return c.content.filter(m.matches(F.col("data"))).select("id")


def whole_word(spark, d):
    c = Corpus(spark, d)
    m = Matcher(parse("path word:on", c.now))
    return c.content.filter(m.matches(F.col("data"))).select("id")


def name_regex(spark, d):
    """Names that match, and where."""
    c = Corpus(spark, d)
    q = parse(r"/s[a-z]+on/", c.now)
    return search.name_matches(c, q).select("id")


def find_ranked(spark, d):
    """The find mode end to end: names and texts fused, boosted, cut."""
    c = Corpus(spark, d)
    return search.find(c, parse("saffron type:docs limit:20", c.now)).select("id", "path", F.round("score", 6).alias("score"), "count")


def fold_terms(spark, d):
    """Distinct folded words of each text, as a digest of their sorted list; letters of other alphabets keep their marks."""
    return Corpus(spark, d).table("texts").select("id", F.md5(F.array_join(F.array_sort(T.terms(F.col("data"))), " ").cast("binary")).alias("terms"))


def vocabulary_long(spark, d):
    """How many words are long ones of letters and digits, which are left out of typo search."""
    return search.vocabulary(Corpus(spark, d)).groupBy("is_long").agg(F.count("*").alias("words"), F.sum("df").alias("uses"))


def _lookup(v):
    case = F.when(F.col("term").contains("arl"), "part").when(F.col("term").endswith("tion"), "end").when(F.col("term").startswith("sub"), "start")
    return v.select("term", case.alias("by")).filter("by IS NOT NULL")


def vocabulary_lookup(spark, d):
    """Words by a part, an ending and a beginning."""
    return _lookup(search.vocabulary(Corpus(spark, d)))


def keyword_all(spark, d):
    c = Corpus(spark, d)
    return search.keyword_ids(c, ["saffron", "narrow"]).select("id")


def keyword_any(spark, d):
    c = Corpus(spark, d)
    return search.keyword_ids(c, ["saffron", "zanzibarite"], any_word=True).select("id", "hits")


def keyword_without(spark, d):
    c = Corpus(spark, d)
    return search.keyword_ids(c, ["saffron"], ["narrow"]).select("id")


def keyword_prefix(spark, d):
    c = Corpus(spark, d)
    return search.keyword_ids(c, ["saff"], prefix_last=True).select("id")


def keyword_fallback(spark, d):
    """No file holds both words, so either counts."""
    c = Corpus(spark, d)
    return search.keyword(c, parse("saffron zanzibarite ", c.now)).select("id")


def phrase_words(spark, d):
    """A phrase holds if all its words do, since postings keep no places."""
    c = Corpus(spark, d)
    return search.keyword(c, parse('"narrow saffron" ', c.now)).select("id")


def document_frequency(spark, d):
    return search.postings(Corpus(spark, d), ["saffron", "narrow", "barley"]).groupBy("term").agg(F.countDistinct("id").alias("df"))


def typo_terms(spark, d):
    """Words of the vocabulary like a misspelt one."""
    v = search.vocabulary(Corpus(spark, d))
    return search.similar_terms(v, "saffrno").unionByName(search.similar_terms(v, "barly"))


def did_you_mean(spark, d):
    """The nearest word of the vocabulary."""
    return search.similar_terms(search.vocabulary(Corpus(spark, d)), "schedlue").limit(1)


def identifiers(spark, d):
    """Parts of compound names."""
    return Corpus(spark, d).files.select("id", F.array_join(T.split_identifier(F.col("name")), " ").alias("parts"))


def name_tokens(spark, d):
    return Corpus(spark, d).files.select("id", F.array_join(F.array_sort(T.name_tokens(F.col("name"))), " ").alias("tokens"))


def stems(spark, d):
    """Words without their English endings; those with digits or of other alphabets stay."""
    return search.vocabulary(Corpus(spark, d)).select("term", T.stem(F.col("term")).alias("stem"))


def fuzzy_candidates(spark, d):
    """Names that hold the letters in order."""
    c = Corpus(spark, d)
    return c.catalog.filter(fuzzy.may_match(F.col("display"), fuzzy.parse_terms("sfrn !archive .md$"))).select("id")


def fuzzy_names(spark, d):
    return search.fuzzy_names(Corpus(spark, d), "safron").select("id", F.round("score", 6).alias("score"))


def typo_names(spark, d):
    return search.typo_names(Corpus(spark, d), ["saffrno"])


def group_or(spark, d):
    c = Corpus(spark, d)
    return search.search_group(c, groups("(saffron ext:md) OR (barley ext:csv)")).select("id", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


def group_and(spark, d):
    c = Corpus(spark, d)
    return search.search_group(c, groups("(saffron OR barley) type:markdown")).select("id", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


def group_sorted(spark, d):
    """A group in the order it asks for."""
    return search.search(Corpus(spark, d), "(saffron OR barley) sort:-size limit:30").select("id", "path")


def sort_with_text(spark, d):
    """Hits of a word by name: the first of all hits, not of the best."""
    return search.search(Corpus(spark, d), "saffron sort:name limit:25").select("id", "path")


def search_allowed(spark, d):
    """What a policy lets be found: one folder is left out, one is searched by name only, and so are links."""
    s = Settings(excluded=("/home/u/Archive",), names_only=("/home/u/Documents",))
    return search.search(Corpus(spark, d), "saffron", limit=60, settings=s).select("id", "path", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


def stored_postings(spark, d):
    """Keyword search over postings stored by term."""
    folder = shared_path(spark, "postings")
    store.write_postings(search.postings(Corpus(spark, d)), folder)
    return search.keyword_ids(Corpus(spark, d, postings=folder), ["saffron", "narr"], prefix_last=True, any_word=True)


def lines_found(spark, d):
    """The first lines of each text that hold the word."""
    return snippets.matching_lines(Corpus(spark, d).table("texts"), lambda x: F.lower(x).contains("saffron"), 3)


def lines_pages(spark, d):
    """Lines with their pages."""
    return snippets.lines(Corpus(spark, d).table("texts").filter(F.instr("data", "\f") > 0)).select("id", "line", "page", F.length("text").alias("chars"))


def lines_folded(spark, d):
    """Lines that hold a word without its accents."""
    return snippets.matching_lines(Corpus(spark, d).table("texts"), lambda x: T.fold(x).contains("reunion"), 8)


def lines_clipped(spark, d):
    """Long lines cut to a window around the match."""
    c = Corpus(spark, d)
    found = snippets.matching_lines(c.table("texts"), lambda x: F.lower(x).contains("saffron"), 3)
    return found.select("id", "line", snippets.clip(F.col("text"), F.instr(F.lower("text"), "saffron") - 1).alias("shown"))


def lines_around(spark, d):
    """Matching lines with their neighbours."""
    t = Corpus(spark, d).table("texts")
    found = snippets.matching_lines(t, lambda x: F.lower(x).contains("saffron"), 2)
    rows = snippets.lines(t.join(found.select("id").distinct(), "id", "left_semi"))
    return snippets.around(found, rows, 1).select("id", "line", "text")


def line_range(spark, d):
    return snippets.line_range(Corpus(spark, d).table("texts"), 3, 4, 2000)


def read_on(spark, d):
    """Three hundred characters from the middle of the second line on, and where reading goes on."""
    return snippets.read_on(Corpus(spark, d).table("texts"), 2, 10, 300)


def page_starts(spark, d):
    return snippets.page_starts(Corpus(spark, d).table("texts").filter(F.instr("data", "\f") > 0))


def highlight_ranges(spark, d):
    t = Corpus(spark, d).table("texts").filter(F.lower("data").contains("saffron"))
    return t.select("id", F.size(snippets.highlights(F.col("data"), "saffron")).alias("ranges"))


def match_counts(spark, d):
    """How often each text holds the word: the key of find's order."""
    m = Matcher(parse("saffron", 0))
    return Corpus(spark, d).table("texts").select("id", m.count(F.col("data")).cast("int").alias("count")).filter("count > 0")


def bm25(spark, d):
    """Words ranked by where and how often files hold them."""
    c = Corpus(spark, d)
    words = ["saffron", "narrow"]
    m = search.keyword_ids(c, words).select("id").join(c.catalog.select("id", "mtime", "name", paths.parent(F.col("display")).alias("dirs")), "id")
    count = lambda col, w: F.regexp_count(F.array_join(T.name_tokens(F.col(col)), " "), F.lit(rf"(?i)\b{w}\b"))
    m = m.select("id", "mtime", *[count("name", w).alias(f"tf_name_{i}") for i, w in enumerate(words)], *[count("dirs", w).alias(f"tf_dirs_{i}") for i, w in enumerate(words)])
    p = search.postings(c, words)
    stats = p.agg(*[F.countDistinct(F.when(F.col("term") == w, F.col("id"))).alias(f"df_{i}") for i, w in enumerate(words)]).crossJoin(c.files.agg(F.count("*").alias("n")))
    tf = [F.regexp_count(F.lower("data"), F.lit(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])")) for w in words]
    return ranking.bm25(m, stats, c.content, tf, 50).select("id", F.round("score", 6).alias("score"))


def rrf(spark, d):
    """Fusion of the largest, the newest and the first files by name."""
    f = Corpus(spark, d).files.filter(~F.col("is_dir"))
    lists = [(ranking.ranked(f, [F.desc("size"), F.asc("id")], 100), 1.3, "size"), (ranking.ranked(f, [F.desc("mtime"), F.asc("id")], 100), 0.9, "new"), (ranking.ranked(f, [F.asc("path")], 100), 0.6, "path")]
    return ranking.fuse(lists).select("id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


def paged(spark, d):
    """One page of the newest files."""
    f = Corpus(spark, d).files.filter(~F.col("is_dir"))
    return ranking.page(f, [F.desc("mtime"), F.asc("id")], 40, 20).select("id")


def strong_hits(spark, d):
    f = Corpus(spark, d).files.filter(~F.col("is_dir")).select("id", F.col("size").cast("double").alias("score"))
    return ranking.strong(f, 0.6).select("id")


QUERIES = {name: _counts(text) for name, (text, _) in COUNTS.items()}
QUERIES |= {f.__name__: f for f in (all_words, whole_word, name_regex, find_ranked, fold_terms, vocabulary_long, vocabulary_lookup, keyword_all, keyword_any, keyword_without, keyword_prefix, keyword_fallback, phrase_words, document_frequency, typo_terms, did_you_mean, identifiers, name_tokens, stems, fuzzy_candidates, fuzzy_names, typo_names, group_or, group_and, group_sorted, sort_with_text, search_allowed, stored_postings, lines_found, lines_pages, lines_folded, lines_clipped, lines_around, line_range, read_on, page_starts, highlight_ranges, match_counts, bm25, rrf, paged, strong_hits)}

_NAMES = rf"(SELECT id, unnest(list_distinct(regexp_extract_all({FOLD.format('name')} || ' ' || {FOLD.format(chr(39) + chr(39))}, {WORDS}))) AS term FROM files)"
_SPLIT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g')"
_BOTH = lambda col: rf"{FOLD.format(col)} || ' ' || {FOLD.format(_SPLIT.format(col))}"
_POST = rf"""(SELECT id, unnest(list_distinct(regexp_extract_all({_BOTH('name')}, {WORDS}))) AS term FROM files
   UNION SELECT id, unnest(list_distinct(regexp_extract_all({_BOTH("regexp_extract(" + DISPLAY + ", '^(.*)/[^/]*$', 1)")}, {WORDS}))) FROM files
   UNION SELECT m.id, term FROM content_map m JOIN (SELECT id AS t, unnest(list_distinct(regexp_extract_all({FOLD.format('data')}, {WORDS}))) AS term FROM texts) x ON x.t = m.text)"""
_LINES = "(SELECT id, unnest(string_split_regex(data, '[\\n\\f]')) AS text, generate_subscripts(string_split_regex(data, '[\\n\\f]'), 1)::INT AS line FROM texts)"
_VOC = rf"(SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(regexp_extract_all({FOLD.format('data')}, {WORDS}))) AS term FROM texts) GROUP BY term)"
_OPENS = "(SELECT path, count(*) AS n, max(ts) AS last FROM (SELECT DISTINCT path, ts, via FROM opens WHERE path IS NOT NULL) GROUP BY path)"
_BOOST = """(1 + coalesce(least(30, 8 * log2(1 + n)) * exp(-((1706745600000 - epoch_us(last) / 1000) / 86400000.0) / 30), 0) / 200
    + (CASE WHEN (1706745600000 - f.mtime) / 86400000.0 < 7 THEN 4 WHEN (1706745600000 - f.mtime) / 86400000.0 < 30 THEN 2 ELSE 0 END) / 400)"""


def _fused(word, cond, names_most=5000, body_most=5000, tail=True, names_order="id", body_order="count DESC, mtime DESC, id"):
    """Hits of one word in names and texts, fused and boosted; those after the last rank share it, or are cut."""
    last = lambda most: f"least(r, {most})" if tail else "r"
    keep = lambda most: "true" if tail else f"r < {most}"
    names = f"SELECT id, {last(names_most)} AS r FROM (SELECT id, row_number() OVER (ORDER BY {names_order}) - 1 AS r FROM files f WHERE {cond} AND contains(lower({DISPLAY}), '{word}')) WHERE {keep(names_most)}"
    hits = f"SELECT c.id, f.mtime, f.size, f.path, f.name, least(10000, len(regexp_extract_all(lower(data), '{word}'))) AS count FROM {CONTENT} c JOIN files f ON f.id = c.id WHERE NOT f.is_dir AND {cond} AND contains(lower(data), '{word}')"
    body = f"SELECT id, {last(body_most)} AS r FROM (SELECT id, row_number() OVER (ORDER BY {body_order}) - 1 AS r FROM ({hits})) WHERE {keep(body_most)}"
    return f"SELECT f.id, s * {_BOOST} AS score, bys FROM (SELECT id, sum(1.0::DOUBLE / (20 + r + 1)) AS s, list_sort(list_distinct(list(b))) AS bys FROM (SELECT id, r, 'name' AS b FROM ({names}) UNION ALL SELECT id, r, 'content' FROM ({body})) GROUP BY id) x JOIN files f ON f.id = x.id LEFT JOIN {_OPENS} o ON o.path = f.path"



_PERMIT = "(f.path = '/home/u' OR starts_with(f.path, '/home/u/')) AND coalesce(f.source_path, '') = '' AND NOT (f.path = '/home/u/Archive' OR starts_with(f.path, '/home/u/Archive/'))"
_READ = "NOT (f.path = '/home/u/Documents' OR starts_with(f.path, '/home/u/Documents/'))"

SQL = {name: sql for name, (_, sql) in COUNTS.items()}
SQL |= {
    "all_words": f"SELECT id FROM {CONTENT} WHERE contains(lower(data), 'saffron') AND contains(lower(data), 'narrow') AND contains(lower(data), 'barley')",
    "whole_word": rf"SELECT id FROM {CONTENT} WHERE regexp_matches(data, '(?i)(^|[^\p{{L}}\p{{N}}])path($|[^\p{{L}}\p{{N}}])')",
    "name_regex": f"SELECT id FROM files WHERE regexp_matches({DISPLAY}, '(?i)s[a-z]+on')",
    "find_ranked": f"""WITH docs AS (SELECT * FROM files WHERE kind IN ('doc', 'pdf', 'markdown', 'text', 'slides', 'sheet', 'ebook')),
        names AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM docs WHERE contains(lower({DISPLAY}), 'saffron') ORDER BY id LIMIT 20),
        hits AS (SELECT c.id, least(10000, len(regexp_extract_all(lower(data), 'saffron')))::INT AS count, mtime FROM {CONTENT} c JOIN docs USING (id) WHERE NOT is_dir AND contains(lower(data), 'saffron')),
        body AS (SELECT id, count, row_number() OVER (ORDER BY count DESC, mtime DESC, id) - 1 AS r FROM hits ORDER BY count DESC, mtime DESC, id LIMIT 100),
        fused AS (SELECT id, sum(1.0 / (20 + r + 1)) AS s FROM (SELECT id, r FROM names UNION ALL SELECT id, r FROM body) GROUP BY id),
        o AS (SELECT path, count(*) AS n, max(ts) AS last FROM (SELECT DISTINCT path, ts, via FROM opens WHERE path IS NOT NULL) GROUP BY path),
        scored AS (SELECT f.id, f.path, f.mtime, b.count, s * (1 + coalesce(least(30, 8 * log2(1 + n)) * exp(-((1706745600000 - epoch_us(last) / 1000) / 86400000.0) / 30), 0) / 200
          + (CASE WHEN (1706745600000 - f.mtime) / 86400000.0 < 7 THEN 4 WHEN (1706745600000 - f.mtime) / 86400000.0 < 30 THEN 2 ELSE 0 END) / 400) AS score
          FROM fused JOIN files f USING (id) LEFT JOIN body b USING (id) LEFT JOIN o ON o.path = f.path)
        SELECT id, path, round(score, 6) AS score, count FROM scored ORDER BY scored.score DESC, mtime DESC, id LIMIT 20""",
    "fold_terms": rf"SELECT id, md5(array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({FOLD.format('data')}, {WORDS})), lambda w: length(w) <= 1024)), ' ')) AS terms FROM texts",
    "vocabulary_long": f"SELECT regexp_matches(term, '^[a-z0-9]{{32,64}}$') AS is_long, count(*) AS words, sum(df)::BIGINT AS uses FROM {_VOC} WHERE length(term) <= 1024 GROUP BY 1",
    "vocabulary_lookup": f"SELECT term, CASE WHEN contains(term, 'arl') THEN 'part' WHEN suffix(term, 'tion') THEN 'end' WHEN starts_with(term, 'sub') THEN 'start' END AS by FROM {_VOC} WHERE length(term) <= 1024 AND (contains(term, 'arl') OR suffix(term, 'tion') OR starts_with(term, 'sub'))",
    "keyword_all": f"SELECT id FROM {_POST} WHERE term IN ('saffron', 'narrow') GROUP BY id HAVING count(DISTINCT term) = 2",
    "keyword_any": f"SELECT id, count(DISTINCT term)::INT AS hits FROM {_POST} WHERE term IN ('saffron', 'zanzibarite') GROUP BY id",
    "keyword_without": f"SELECT DISTINCT id FROM {_POST} WHERE term = 'saffron' AND id NOT IN (SELECT id FROM {_POST} WHERE term = 'narrow')",
    "keyword_prefix": f"SELECT DISTINCT id FROM {_POST} WHERE starts_with(term, 'saff')",
    "keyword_fallback": f"SELECT DISTINCT id FROM {_POST} WHERE term IN ('saffron', 'zanzibarite')",
    "phrase_words": f"SELECT id FROM {_POST} WHERE term IN ('saffron', 'narrow') GROUP BY id HAVING count(DISTINCT term) = 2",
    "document_frequency": f"SELECT term, count(DISTINCT id) AS df FROM {_POST} WHERE term IN ('saffron', 'narrow', 'barley') GROUP BY term",
    "typo_terms": f"""SELECT damerau_levenshtein(term, w)::INT AS distance, term FROM {_VOC}, (VALUES ('saffrno'), ('barly')) x(w)
        WHERE NOT regexp_matches(term, '^[a-z0-9]{{32,64}}$') AND term <> w AND damerau_levenshtein(term, w) <= 1 AND (term[1] = w[1] OR term[-1] = w[-1])""",
    "typo_names": rf"""SELECT id, max(56 - 12 * damerau_levenshtein(w, 'saffrno'))::BIGINT AS score FROM (SELECT id, unnest(list_distinct(regexp_extract_all({_BOTH('name')}, {WORDS}))) AS w FROM files) WHERE damerau_levenshtein(w, 'saffrno') <= 1 GROUP BY id""",
    "bm25": rf"""WITH post AS {_POST}, m AS (SELECT id FROM post WHERE term IN ('saffron', 'narrow') GROUP BY id HAVING count(DISTINCT term) = 2),
        st AS (SELECT (SELECT count(*) FROM files)::DOUBLE AS n, count(DISTINCT CASE WHEN term = 'saffron' THEN id END) AS d0, count(DISTINCT CASE WHEN term = 'narrow' THEN id END) AS d1 FROM post),
        w AS (SELECT ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) AS w0, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) AS w1 FROM st),
        tf AS (SELECT f.id, f.mtime, c.data, list_distinct(regexp_extract_all({_BOTH('f.name')}, {WORDS})) AS nm, list_distinct(regexp_extract_all({_BOTH("regexp_extract(" + DISPLAY + ", '^(.*)/[^/]*$', 1)")}, {WORDS})) AS dr
          FROM m JOIN files f USING (id) LEFT JOIN {CONTENT} c ON c.id = f.id),
        p AS (SELECT *, list_contains(nm, 'saffron')::INT AS n0, list_contains(nm, 'narrow')::INT AS n1, list_contains(dr, 'saffron')::INT AS e0, list_contains(dr, 'narrow')::INT AS e1,
          len(regexp_extract_all(lower(data), '(^|[^\p{{L}}\p{{N}}])saffron($|[^\p{{L}}\p{{N}}])')) AS b0, len(regexp_extract_all(regexp_replace(lower(data), 'narrow', 'narrow ', 'g'), '(^|[^\p{{L}}\p{{N}}])narrow($|[^\p{{L}}\p{{N}}])')) AS b1, coalesce(length(data), 0)::DOUBLE AS l FROM tf),
        s AS (SELECT id, mtime, data, l, b0, b1, w0, w1, w0 * (10 * n0 * 2.2 / (n0 + 1.2) + 2.5 * e0 * 2.2 / (e0 + 1.2)) + w1 * (10 * n1 * 2.2 / (n1 + 1.2) + 2.5 * e1 * 2.2 / (e1 + 1.2)) AS ps FROM p, w),
        q AS (SELECT * FROM s ORDER BY ps DESC, mtime DESC, id LIMIT 128), a AS (SELECT greatest(coalesce(avg(CASE WHEN data IS NOT NULL THEN l END), 1), 1) AS mean FROM q)
        SELECT id, round(ps + w0 * coalesce(b0, 0) * 2.2 / (coalesce(b0, 0) + 1.2 * (0.25 + 0.75 * l / mean)) + w1 * coalesce(b1, 0) * 2.2 / (coalesce(b1, 0) + 1.2 * (0.25 + 0.75 * l / mean)), 6) AS score FROM q, a
        ORDER BY score DESC, mtime DESC, id LIMIT 50""",
    "identifiers": rf"SELECT id, trim(regexp_replace({_SPLIT.format('name')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS parts FROM files",
    "stems": f"""SELECT term, CASE WHEN regexp_matches(term, '[0-9]') THEN term WHEN suffix(term, 'ies') AND length(term) >= 6 THEN left(term, length(term) - 3) WHEN suffix(term, 'ing') AND length(term) >= 7 THEN left(term, length(term) - 3) WHEN suffix(term, 'ed') AND length(term) >= 6 THEN left(term, length(term) - 2)
        WHEN suffix(term, 'es') AND length(term) >= 6 THEN left(term, length(term) - 2) WHEN suffix(term, 's') AND NOT suffix(term, 'ss') AND length(term) >= 5 THEN left(term, length(term) - 1) ELSE term END AS stem FROM {_VOC} WHERE length(term) <= 1024""",
    "fuzzy_candidates": f"SELECT id FROM files WHERE regexp_matches(lower({DISPLAY}), '(?s)s.*f.*r.*n') AND NOT contains(lower({DISPLAY}), 'archive') AND suffix(lower({DISPLAY}), '.md')",
    "group_or": f"SELECT id, round(sum(score), 6) AS score, array_to_string(list_sort(list_distinct(flatten(list(bys)))), ',') AS sources FROM ({_fused('saffron', chr(39) + 'md' + chr(39) + ' = ext')} UNION ALL {_fused('barley', chr(39) + 'csv' + chr(39) + ' = ext')}) GROUP BY id",
    "group_and": f"SELECT id, round(sum(score), 6) AS score, array_to_string(list_sort(list_distinct(flatten(list(bys)))), ',') AS sources FROM ({_fused('saffron', 'true')} UNION ALL {_fused('barley', 'true')}) WHERE id IN (SELECT id FROM files WHERE kind = 'markdown') GROUP BY id",
    "group_sorted": f"SELECT id, path FROM files WHERE id IN (SELECT id FROM ({_fused('saffron', 'true')} UNION ALL {_fused('barley', 'true')})) ORDER BY size DESC, path LIMIT 30",
    "sort_with_text": f"SELECT id, path FROM files WHERE id IN (SELECT id FROM ({_fused('saffron', 'true')})) ORDER BY name, path LIMIT 25",
    "search_allowed": f"SELECT id, path, round(score, 6) AS score, array_to_string(bys, ',') AS sources FROM (SELECT x.*, f.path, f.mtime FROM ({_fused('saffron', _PERMIT, 60, 300, False).replace('NOT f.is_dir AND', 'NOT f.is_dir AND ' + _READ + ' AND')}) x JOIN files f USING (id)) y ORDER BY y.score DESC, mtime DESC, id LIMIT 60",
    "stored_postings": f"SELECT id, count(DISTINCT term)::INT AS hits FROM {_POST} WHERE term = 'saffron' OR starts_with(term, 'narr') GROUP BY id",
    "name_tokens": rf"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_split_to_array(name, '[^\p{{L}}\p{{N}}]+'), regexp_split_to_array({_SPLIT.format('name')}, '[^\p{{L}}\p{{N}}]+')), lambda w: w <> ''))), ' ') AS tokens FROM files",
    "did_you_mean": f"SELECT damerau_levenshtein(term, 'schedlue')::INT AS distance, term FROM {_VOC} WHERE NOT regexp_matches(term, '^[a-z0-9]{{32,64}}$') AND term <> 'schedlue' AND length(term) BETWEEN 6 AND 10 AND damerau_levenshtein(term, 'schedlue') <= 2 AND (term[1] = 's' OR term[-1] = 'e') ORDER BY 1, 2 LIMIT 1",
    "lines_found": f"SELECT id, line, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM {_LINES} WHERE contains(lower(text), 'saffron')) WHERE r <= 3",
    "lines_pages": r"""SELECT id, line, (1 + len(regexp_extract_all(array_to_string(list_slice(ends, 1, line - 1), ''), '\f')))::INT AS page, length(text)::INT AS chars FROM (
        SELECT id, unnest(string_split_regex(data, '[\n\f]')) AS text, generate_subscripts(string_split_regex(data, '[\n\f]'), 1)::INT AS line, regexp_extract_all(data, '[\n\f]') AS ends FROM texts WHERE contains(data, chr(12)))""",
    "lines_folded": f"SELECT id, line, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM {_LINES} WHERE contains({FOLD.format('text')}, 'reunion')) WHERE r <= 8",
    "lines_around": f"""WITH l AS (SELECT * FROM {_LINES}), m AS (SELECT id, line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM l WHERE contains(lower(text), 'saffron')) WHERE r <= 2)
        SELECT DISTINCT l.id, l.line, l.text FROM l JOIN m ON m.id = l.id AND abs(l.line - m.line) <= 1""",
    "line_range": f"SELECT id, line, text FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY id ORDER BY line) AS total FROM {_LINES} WHERE line BETWEEN 3 AND 6) WHERE total <= 2000 OR line = 3",
    "read_on": r"""WITH l AS (SELECT id, data, string_split_regex(data, '[\n\f]') AS ls FROM texts), a AS (SELECT id, data, ls, length(ls[1]) + 1 + least(10, length(ls[2])) AS pos FROM l WHERE len(ls) >= 2), t AS (SELECT *, substr(data, pos + 1, 300) AS text FROM a), s AS (SELECT *, string_split_regex(text, '[\n\f]') AS x FROM t)
        SELECT id, text, CASE WHEN pos + length(text) < length(data) THEN 1 + len(x) END::INT AS next_line, CASE WHEN pos + length(text) < length(data) THEN length(x[-1]) + CASE WHEN len(x) = 1 THEN least(10, length(ls[2])) ELSE 0 END END::INT AS next_column FROM s""",
    "page_starts": r"""SELECT id, page, (CASE WHEN page = 1 THEN 1 ELSE 1 + len(regexp_extract_all(array_to_string(list_slice(parts, 1, page - 1), chr(12)) || chr(12), '[\n\f]')) END)::INT AS line
        FROM (SELECT id, string_split(data, chr(12)) AS parts, generate_subscripts(string_split(data, chr(12)), 1)::INT AS page FROM texts WHERE contains(data, chr(12)))""",
    "highlight_ranges": "SELECT id, len(regexp_extract_all(lower(data), 'saffron'))::INT AS ranges FROM texts WHERE contains(lower(data), 'saffron')",
    "match_counts": "SELECT id, least(10000, len(regexp_extract_all(lower(data), 'saffron')))::INT AS count FROM texts WHERE contains(lower(data), 'saffron')",
    "rrf": """SELECT id, round(sum(w / (20 + r)), 9) AS score, string_agg(s, ',' ORDER BY s) AS sources FROM (
        SELECT * FROM (SELECT id, row_number() OVER (ORDER BY size DESC, id) AS r, 1.3::DOUBLE AS w, 'size' AS s FROM files WHERE NOT is_dir) WHERE r <= 100 UNION ALL
        SELECT * FROM (SELECT id, row_number() OVER (ORDER BY mtime DESC, id), 0.9, 'new' FROM files WHERE NOT is_dir) t(id, r, w, s) WHERE r <= 100 UNION ALL
        SELECT * FROM (SELECT id, row_number() OVER (ORDER BY path), 0.6, 'path' FROM files WHERE NOT is_dir) t(id, r, w, s) WHERE r <= 100) GROUP BY id""",
    "paged": "SELECT id FROM files WHERE NOT is_dir ORDER BY mtime DESC, id LIMIT 20 OFFSET 40",
    "strong_hits": "SELECT id FROM files WHERE NOT is_dir AND size::DOUBLE >= 0.6 * (SELECT max(size)::DOUBLE FROM files WHERE NOT is_dir)",
}
