"""Vector search queries: the query is a stored vector, the last in order of hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweh.corpus import Corpus
from fernweh.functions import text as T
from fernweh.operators import metrics, search, semantic, store
from fernweh.runtime import materialize

DIM = 128
WORDS = ["saffron", "narrow"]


def _vectors(c):
    return semantic.usable_vectors(c.table("vectors"), DIM)


def _passages(c):
    return c.table("passages").filter("start_pos >= 0").dropDuplicates(["file", "n"]).select("file", "n", "hash", "start_pos", (F.col("n") < semantic.FIRST_ROUND).alias("sets_scale"), F.lit(0).alias("modality"))


def _query(v):
    """The vector asked for; one row, taken to the driver as an application would pass it in."""
    last = v.orderBy(F.desc("hash")).select("vec").first()
    return [float(x) for x in last[0]] if last else [0.0] * DIM


def _scored(c):
    v = _vectors(c)
    return materialize(semantic.scored(_passages(c), v, _query(v)), "scored")  # the scalars below read it several times


def cosine_scores(spark, d):
    """Cosine of every distinct usable vector and the query."""
    v = _vectors(Corpus(spark, d))
    return v.select("hash", F.round(semantic.dot(F.col("vec"), _query(v)), 6).alias("score"))


def cosine_topk(spark, d):
    v = _vectors(Corpus(spark, d))
    s = v.select("hash", semantic.dot(F.col("vec"), _query(v)).alias("score"))
    return s.orderBy(F.desc("score"), "hash").limit(20).select("hash", F.round("score", 6).alias("score"))


def meaning_z(spark, d):
    """How far each passage stands out."""
    return semantic.meaning(_scored(Corpus(spark, d))).select("file", "n", F.round("z", 6).alias("z"))


def best_by_file(spark, d):
    return semantic.best_by_file(semantic.meaning(_scored(Corpus(spark, d)))).select("file", F.round("z", 6).alias("z"))


def word_coverage(spark, d):
    """Share of the query's words each file holds, plain and weighted."""
    c = Corpus(spark, d)
    hits = search.postings(c, WORDS).select("id", "term").distinct()
    total = c.files.count()
    return semantic.coverage(hits, WORDS, total).select("file", "coverage", F.round("weighted", 6).alias("weighted"))


def semantic_rank(spark, d):
    """Meaning and words fused into one score."""
    c = Corpus(spark, d)
    best = semantic.best_by_file(semantic.meaning(_scored(c)))
    hits = search.postings(c, WORDS).select("col", "id", "term")
    words = semantic.coverage(hits.select("id", "term").distinct(), WORDS, c.files.count())
    named = hits.filter("col = 'name'").select("id", "term").distinct().groupBy("id").agg((F.count("*") / F.lit(float(len(WORDS)))).alias("named")).withColumnRenamed("id", "file")
    kinds = c.files.select(F.col("id").alias("file"), "kind")
    return semantic.rank(best, words, named, kinds, False, ["pdf"]).limit(100).select("file", F.round("score", 6).alias("score"))


def embedding_rounds(spark, d):
    """The first passages that a pass embeds: of every file the first ones, newest files first."""
    c = Corpus(spark, d)
    p = c.table("passages").filter("start_pos >= 0").select("file", "n").distinct()
    return semantic.rounds(p, c.files).orderBy(*semantic.round_order()).limit(500).select("file", "n", "round")


def index_actions_after_change(spark, d):
    """What a pass does after a change of the model for some files and of the cutter for others."""
    c = Corpus(spark, d)
    state = _state(c).withColumn("fingerprint", F.when(F.col("file") % 3 == 0, "old").otherwise("now")).withColumn("generation", F.when(F.col("file") % 4 == 0, 1).otherwise(2))
    return semantic.index_actions(_candidates(c), state, "now", 2)


def search_semantic(spark, d):
    """A query by meaning through the search entry: only files of the types asked for, code left out."""
    c = Corpus(spark, d)
    asked = _query(_vectors(c))
    return search.search(c, "s:saffron narrow -type:image", limit=100, embed=lambda text: asked).select(F.col("id").alias("file"), F.round("score", 6).alias("score"))


def search_semantic_words(spark, d):
    """The same without vectors, by name: words alone decide."""
    return search.search(Corpus(spark, d), "s:saffron narrow barley type:docs sort:name limit:40").select(F.col("id").alias("file"), "path")


def semantic_rank_fused(spark, d):
    """The alternative: rank fusion of the two orders."""
    c = Corpus(spark, d)
    best = semantic.best_by_file(semantic.meaning(_scored(c)))
    hits = search.postings(c, WORDS).select("id", "term").distinct()
    words = semantic.coverage(hits, WORDS, c.files.count())
    return semantic.rank_fused(best, words).select("file", F.round("score", 9).alias("score"))


def related_files(spark, d):
    """Files like the one with the most passages."""
    c = Corpus(spark, d)
    rows = materialize(_passages(c).join(_vectors(c), "hash"), "passage-vectors")
    most = rows.groupBy("file").count().orderBy(F.desc("count"), "file").first()
    return semantic.related(rows, most[0] if most else -1, floor=0.5).select("file", F.round("score", 6).alias("score"))


def passages_sharing(spark, d):
    """Passages per file and passages per vector."""
    p = _passages(Corpus(spark, d))
    return p.groupBy("file").agg(F.count("*").alias("passages"), F.countDistinct("hash").alias("vectors"))


def vectors_missing(spark, d):
    """Files with a passage whose vector isn't stored: they wait."""
    c = Corpus(spark, d)
    return _passages(c).join(c.table("vectors").select("hash"), "hash", "left_anti").select("file").distinct()


def vectors_loaded(spark, d):
    """Passages joined with their usable vectors."""
    c = Corpus(spark, d)
    return _passages(c).join(_vectors(c).select("hash"), "hash").select("file", "n", "hash")


def has_words(spark, d):
    return Corpus(spark, d).table("texts").select("id", T.has_words(F.col("data")).alias("has_words"))


def prompt_hashes(spark, d):
    """Distinct prompts to embed, by hash, and how many passages each serves."""
    p = Corpus(spark, d).table("passages").filter("prompt IS NOT NULL").select("file", "n", semantic.prompt_hash(F.col("prompt")).alias("h")).distinct()
    return p.groupBy("h").agg(F.count("*").alias("uses"))


def chunks(spark, d):
    """Texts cut into passages whose ends the text decides."""
    return semantic.passages(Corpus(spark, d).table("texts")).select("id", "n", "start_pos", "end_pos", F.length("text").alias("chars"))


def index_actions(spark, d):
    """What an index run does with each file: keep, resume, embed, drop."""
    c = Corpus(spark, d)
    return semantic.index_actions(_candidates(c), _state(c))


def coverage_status(spark, d):
    c = Corpus(spark, d)
    return store.coverage_status(c.files, _candidates(c), _state(c))


def _candidates(c):
    f = c.files.filter(~F.col("is_dir") & (F.col("content_state") == 1) & (F.col("content_len") > 0) & ~F.col("ext").isin("lean", "olean", "ilean"))
    title = F.regexp_replace("name", r"(?s)^(.+)\.[^.]*$", "$1")
    return f.join(c.table("content_map").select("id", "text", "hash"), "id").select(F.col("id").alias("file"), semantic.signature(title).alias("sig"))


def _state(c):
    ok = c.table("index_runs").filter("status = 'ok'").select("run_id")
    return c.table("vec_files").join(F.broadcast(ok), "run_id").groupBy("file").agg(F.max(F.struct("run_id", "committed_at", "upto", "total", "sig")).alias("s")).select("file", "s.sig", "s.upto", "s.total")


def vector_stats(spark, d):
    c = Corpus(spark, d)
    return store.vector_stats(c.table("passages"), c.table("vectors"), c.table("vec_files"))


def add_vectors(spark, d):
    """Hashes of passages whose vector would have to be made, once each."""
    c = Corpus(spark, d)
    return c.table("passages").filter("prompt IS NOT NULL").select("hash").distinct().join(c.table("vectors").select("hash"), "hash", "left_anti")


def evaluation(spark, d):
    """nDCG, reciprocal rank and recall: texts ranked by matches of a word, graded by length."""
    c = Corpus(spark, d)
    t = c.documents.filter(F.col("lang").isNotNull() & F.col("kind").isNotNull())
    run = t.select(F.col("kind").alias("query"), F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("score"))
    qrels = t.filter("doc_id % 7 < 3").select(F.col("kind").alias("query"), F.col("doc_id").alias("doc"), (F.col("doc_id") % 3).cast("int").alias("grade"))
    return metrics.evaluate(run, qrels, 10).select("query", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


def run_overlap(spark, d):
    """How much the ten longest and the ten newest documents of a kind have in common."""
    t = Corpus(spark, d).documents.filter("kind IS NOT NULL AND modified IS NOT NULL")
    a = t.select(F.col("kind").alias("query"), F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("score"))
    b = t.select(F.col("kind").alias("query"), F.col("doc_id").alias("doc"), F.unix_micros(F.col("modified").cast("timestamp")).cast("double").alias("score"))
    return metrics.overlap(a, b, 10)


QUERIES = {f.__name__: f for f in (cosine_scores, cosine_topk, meaning_z, best_by_file, word_coverage, semantic_rank, search_semantic, search_semantic_words, embedding_rounds, index_actions_after_change, semantic_rank_fused, related_files, passages_sharing, vectors_missing, vectors_loaded, has_words, prompt_hashes, chunks, index_actions, coverage_status, vector_stats, add_vectors, evaluation, run_overlap)}

_V = """(SELECT hash, list_transform(vec, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(vec, lambda y: y::DOUBLE * y::DOUBLE)))) AS vec FROM (SELECT hash, min(vec) AS vec FROM vectors
    WHERE vec IS NOT NULL AND len(vec) = 128 AND NOT list_bool_or(list_transform(vec, lambda x: x IS NULL OR isnan(x))) GROUP BY hash) WHERE list_sum(list_transform(vec, lambda y: y::DOUBLE * y::DOUBLE)) > 0)"""
_P = "(SELECT DISTINCT file, n, hash, start_pos FROM passages WHERE start_pos >= 0)"
_S = f"""vv AS MATERIALIZED {_V}, qq AS (SELECT vec AS q FROM vv ORDER BY hash DESC LIMIT 1), sc AS (SELECT hash, list_dot_product(vec, q) AS score FROM vv, qq),
    rows AS (SELECT p.*, score, n < 40 AS scale FROM {_P} p JOIN sc USING (hash)), av AS (SELECT avg(score) AS m FROM rows WHERE scale),
    ce AS (SELECT *, score - m AS c FROM rows, av), de AS (SELECT avg(c) AS mid, greatest(stddev_pop(c), 0.02) AS dev FROM ce WHERE scale), zz AS (SELECT file, n, hash, (c - mid) / dev AS z FROM ce, de),
    best AS (SELECT z.file, max(z) - 0.7 * ln(any_value(pf)) AS zl, arg_max(z.hash, struct_pack(z, b := -n)) AS h FROM zz z JOIN (SELECT file, count(*) AS pf FROM zz GROUP BY file) USING (file) GROUP BY z.file),
    bf AS (SELECT b.file, zl - 0.5 * ln(s) AS z FROM best b JOIN (SELECT hash, count(*) AS s FROM zz GROUP BY hash) x ON x.hash = b.h)"""
_SIG = r"concat_ws(':', f.size, f.mtime, f.content_len, regexp_replace(f.name, '^(.+)\.[^.]*$', '\1', 's'), 'text', coalesce(m.hash, '#' || m.text))"
_STATE = "(SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY file ORDER BY run_id DESC, committed_at DESC, upto DESC, total DESC, sig DESC) AS r FROM vec_files v JOIN index_runs USING (run_id) WHERE status = 'ok') WHERE r = 1)"
_CAND = f"(SELECT f.id AS file, {_SIG} AS sig FROM files f JOIN content_map m ON m.id = f.id WHERE NOT f.is_dir AND f.content_state = 1 AND f.content_len > 0 AND f.ext NOT IN ('lean', 'olean', 'ilean'))"


def _sql():
    from fernweh.queries.matching import _POST, FOLD

    hits = f"SELECT DISTINCT id, term FROM {_POST} WHERE term IN ('saffron', 'narrow')"
    cover = f"""hits AS MATERIALIZED ({hits}), nn AS (SELECT count(*)::DOUBLE AS n FROM files), idf AS (SELECT term, ln(1 + any_value(n) / count(*)) AS idf FROM hits, nn GROUP BY term),
        nrm AS (SELECT sum(idf) + (2 - count(*)) * any_value(ln(1 + n)) AS s FROM idf, nn), cov AS (SELECT id AS file, count(*) / 2.0::DOUBLE AS coverage, sum(idf) / any_value(s) AS weighted FROM hits JOIN idf USING (term), nrm GROUP BY id)"""
    return {
        "cosine_scores": f"WITH vv AS MATERIALIZED {_V}, qq AS (SELECT vec AS q FROM vv ORDER BY hash DESC LIMIT 1) SELECT hash, round(list_dot_product(vec, q), 6) AS score FROM vv, qq",
        "cosine_topk": f"WITH vv AS MATERIALIZED {_V}, qq AS (SELECT vec AS q FROM vv ORDER BY hash DESC LIMIT 1) SELECT hash, round(s, 6) AS score FROM (SELECT hash, list_dot_product(vec, q) AS s FROM vv, qq) ORDER BY s DESC, hash LIMIT 20",
        "meaning_z": f"WITH {_S} SELECT file, n, round(z, 6) AS z FROM zz",
        "best_by_file": f"WITH {_S} SELECT file, round(z, 6) AS z FROM bf",
        "word_coverage": f"WITH {cover} SELECT file, coverage, round(weighted, 6) AS weighted FROM cov",
        "semantic_rank": rf"""WITH {_S}, {cover}, nmd AS (SELECT id AS file, count(DISTINCT term) / 2.0::DOUBLE AS named FROM (SELECT id, unnest(list_distinct(regexp_extract_all({FOLD.format('name')}, '[\p{{L}}\p{{N}}]+'))) AS term FROM files) WHERE term IN ('saffron', 'narrow') GROUP BY id)
            SELECT file, round(score, 6) AS score FROM (SELECT x.file, greatest(coalesce(z, 0), 0) + 3 * coalesce(weighted, 0) ** 1.5 + 2 * coalesce(named, 0) ** 2 + (CASE WHEN kind = 'pdf' THEN 1 ELSE 0 END) - (CASE WHEN kind IN ('code', 'data') THEN 1.5 * coalesce(weighted, 0) ** 1.5 ELSE 0 END) AS score
              FROM (SELECT coalesce(b.file, c.file) AS file, z, coverage, weighted FROM bf b FULL JOIN cov c ON c.file = b.file) x LEFT JOIN nmd USING (file) JOIN files f ON f.id = x.file WHERE z >= 2 OR coalesce(coverage, 0) >= 0.5) ORDER BY score DESC, file LIMIT 100""",
        "search_semantic": rf"""WITH may AS (SELECT id FROM files WHERE NOT is_dir AND kind NOT IN ('code', 'data', 'image') AND ext NOT IN ('lean', 'olean', 'ilean')), {_S.replace(_P, f"(SELECT * FROM {_P} WHERE file IN (SELECT id FROM may))")}, {cover}, nmd AS (SELECT id AS file, count(DISTINCT term) / 2.0::DOUBLE AS named FROM (SELECT id, unnest(list_distinct(regexp_extract_all({FOLD.format('name')}, '[\p{{L}}\p{{N}}]+'))) AS term FROM files) WHERE term IN ('saffron', 'narrow') GROUP BY id)
            SELECT file, round(score, 6) AS score FROM (SELECT x.file, greatest(coalesce(z, 0), 0) + 3 * coalesce(weighted, 0) ** 1.5 + 2 * coalesce(named, 0) ** 2 AS score
              FROM (SELECT coalesce(b.file, c.file) AS file, z, coverage, weighted FROM bf b FULL JOIN cov c ON c.file = b.file) x LEFT JOIN nmd USING (file) JOIN may ON may.id = x.file WHERE z >= 2 OR coalesce(coverage, 0) >= 0.5) ORDER BY score DESC, file LIMIT 100""",
        "search_semantic_words": f"SELECT file, path FROM (SELECT id AS file, count(DISTINCT term) AS n FROM {_POST} WHERE term IN ('saffron', 'narrow', 'barley') GROUP BY id) h JOIN files f ON f.id = h.file WHERE n >= 2 AND NOT is_dir AND kind IN ('doc', 'pdf', 'markdown', 'text', 'slides', 'sheet', 'ebook') AND ext NOT IN ('lean', 'olean', 'ilean') ORDER BY name, path LIMIT 40",
        "semantic_rank_fused": f"""WITH {_S}, {cover} SELECT file, round(sum(p), 9) AS score FROM (SELECT file, 1.0 / (60 + row_number() OVER (ORDER BY z DESC, file) - 1) AS p FROM (SELECT * FROM bf ORDER BY z DESC, file LIMIT 1000)
            UNION ALL SELECT file, 1.0 / (60 + row_number() OVER (ORDER BY coverage DESC, file) - 1) FROM (SELECT * FROM cov ORDER BY coverage DESC, file LIMIT 1000)) GROUP BY file""",
        "related_files": f"""WITH vv AS MATERIALIZED {_V}, rows AS MATERIALIZED (SELECT p.file, p.n, p.hash, v.vec FROM {_P} p JOIN vv v USING (hash)), src AS (SELECT file FROM rows GROUP BY file ORDER BY count(*) DESC, file LIMIT 1),
            pf AS (SELECT file, count(*) AS pf FROM rows GROUP BY file), ph AS (SELECT hash, count(*) AS ph FROM rows GROUP BY hash),
            own AS (SELECT hash, vec, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM (SELECT hash, max(n) AS n, any_value(vec) AS vec FROM rows WHERE file = (SELECT file FROM src) GROUP BY hash)),
            picks AS (SELECT DISTINCT o.* FROM own o, range(8) r(j) WHERE j < least(8, m) AND i = floor(j * (m - 1) / greatest(least(8, m) - 1, 1))),
            vt AS (SELECT r.file, k.i, max(list_dot_product(r.vec, k.vec) - 0.025 * ln(pf) - 0.06 * ln(greatest(a.ph, b.ph))) AS v FROM rows r, picks k JOIN pf ON pf.file = r.file JOIN ph a ON a.hash = r.hash JOIN ph b ON b.hash = k.hash
              WHERE r.file <> (SELECT file FROM src) AND list_dot_product(r.vec, k.vec) >= 0.5 GROUP BY r.file, k.i HAVING v > 0)
            SELECT file, round(l[1] + 0.25 * coalesce(l[2], 0), 6) AS score FROM (SELECT file, list(v ORDER BY v DESC) AS l FROM vt GROUP BY file) ORDER BY l[1] + 0.25 * coalesce(l[2], 0) DESC, file LIMIT 20""",
        "passages_sharing": f"SELECT file, count(*) AS passages, count(DISTINCT hash) AS vectors FROM {_P} GROUP BY file",
        "vectors_missing": f"SELECT DISTINCT file FROM {_P} WHERE hash NOT IN (SELECT hash FROM vectors WHERE hash IS NOT NULL)",
        "vectors_loaded": f"SELECT p.file, p.n, p.hash FROM {_P} p JOIN {_V} v USING (hash)",
        "has_words": r"SELECT id, length(regexp_replace(data, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(data, '[^\p{L}]', '', 'g')) * 4 >= length(regexp_replace(data, '[\p{L}\s]', '', 'g')) AS has_words FROM texts",
        "prompt_hashes": "SELECT left(sha256(prompt), 32) AS h, count(*) AS uses FROM (SELECT DISTINCT file, n, prompt FROM passages WHERE prompt IS NOT NULL) GROUP BY 1",
        "index_actions": f"SELECT coalesce(c.file, s.file) AS file, CASE WHEN c.sig IS NULL THEN 'drop' WHEN s.sig IS NULL OR s.sig <> c.sig THEN 'embed' WHEN s.upto < s.total THEN 'resume' ELSE 'keep' END AS action FROM {_CAND} c FULL JOIN {_STATE} s ON s.file = c.file",
        "embedding_rounds": "SELECT file, n, round FROM (SELECT DISTINCT p.file, p.n, CASE WHEN n < 40 THEN 1 ELSE 2 END AS round, mtime FROM passages p JOIN files f ON f.id = p.file WHERE start_pos >= 0) ORDER BY round, mtime DESC, file, n LIMIT 500",
        "index_actions_after_change": f"SELECT coalesce(c.file, s.file) AS file, CASE WHEN c.sig IS NULL THEN 'drop' WHEN s.sig IS NULL OR s.sig <> c.sig OR s.file % 3 = 0 THEN 'embed' WHEN s.file % 4 = 0 THEN 'chunk' WHEN s.upto < s.total THEN 'resume' ELSE 'keep' END AS action FROM {_CAND} c FULL JOIN {_STATE} s ON s.file = c.file",
        "coverage_status": f"SELECT count(*) AS files, count(*) FILTER (WHERE coalesce(s.sig = c.sig AND s.upto >= s.total, false)) AS current, count(*) FILTER (WHERE NOT coalesce(s.sig = c.sig AND s.upto >= s.total, false)) AS pending FROM {_CAND} c LEFT JOIN {_STATE} s ON s.file = c.file",
        "vector_stats": "SELECT (SELECT count(DISTINCT file) FROM passages) AS files, (SELECT count(*) FROM passages) AS passages, (SELECT count(DISTINCT hash) FROM vectors) AS vectors, (SELECT count(*) FROM vec_files WHERE upto < total) AS partial",
        "add_vectors": "SELECT DISTINCT hash FROM passages WHERE prompt IS NOT NULL AND hash NOT IN (SELECT hash FROM vectors WHERE hash IS NOT NULL)",
        "evaluation": """WITH t AS (SELECT kind AS query, doc_id AS doc, n_chars FROM documents WHERE lang IS NOT NULL AND kind IS NOT NULL), q AS (SELECT query, doc, (doc % 3)::INT AS grade FROM t WHERE doc % 7 < 3 AND doc % 3 > 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc) AS rank FROM t), i AS (SELECT query, sum(CASE WHEN k <= 10 THEN grade / log2(k + 1) END) AS idcg, count(*) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS k FROM q) GROUP BY query),
            h AS (SELECT r.query, sum(grade / log2(rank + 1)) AS dcg, min(rank) AS f, count(*) AS n FROM r JOIN q USING (query, doc) WHERE rank <= 10 GROUP BY r.query)
            SELECT i.query, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(coalesce(n / rel, 0), 6) AS recall FROM i LEFT JOIN h USING (query)""",
        "run_overlap": """WITH t AS (SELECT kind AS query, doc_id AS doc, n_chars, modified FROM documents WHERE kind IS NOT NULL AND modified IS NOT NULL), a AS (SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc) AS r FROM t) WHERE r <= 10),
            b AS (SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY modified DESC, doc) AS r FROM t) WHERE r <= 10) SELECT a.query, count(b.doc) / 10.0::DOUBLE AS overlap FROM a LEFT JOIN b ON b.query = a.query AND b.doc = a.doc GROUP BY a.query""",
    }


SQL = _sql()
