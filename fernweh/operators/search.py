"""Searching: literal and pattern find, keyword search over postings, fuzzy names, groups.

Metadata conditions are applied to the catalog before a text is read; conditions on texts start with literals that
Parquet can test. Postings are built per text, not per file, since many files share one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweh.corpus import Corpus
from fernweh.functions import fuzzy, paths
from fernweh.functions import text as T
from fernweh.operators import ranking, semantic
from fernweh.operators.policy import Settings, verdicts
from fernweh.operators.store import read_postings
from fernweh.plans.compile import Matcher, passes
from fernweh.plans.query import Group, Query, groups, parse
from fernweh.runtime import materialize


def browse(c: Corpus, q: Query, limit: int = 200, settings: Settings | None = None) -> DataFrame:
    hits = c.files.filter(passes(q.filters, c.home) & permitted(settings)[0])
    k = q.filters.limit or limit
    return ranking.explicit_sort(hits, q.filters.sort).limit(k) if q.filters.sort else ranking.newest(hits, k)


def permitted(settings: Settings | None) -> tuple[Column, Column]:
    """(whether an entry may be shown, whether its contents may be searched)."""
    if settings is None:
        return F.lit(True), F.lit(True)
    denied, held = verdicts(settings)
    return denied.isNull(), denied.isNull() & held.isNull()


def content_matches(c: Corpus, q: Query, settings: Settings | None = None) -> DataFrame:
    """(id, mtime, path, count) of files whose text matches."""
    m = Matcher(q)
    files = c.files.filter(~F.col("is_dir") & passes(q.filters, c.home) & permitted(settings)[1]).select("id", "path", "mtime", "size", "name")
    texts = c.table("texts").filter(m.matches(F.col("data"))).select(F.col("id").alias("text"), m.count(F.col("data")).cast("int").alias("count"))
    owners = c.table("content_map").select("id", "text")
    return files.join(owners.join(texts, "text"), "id").filter("count > 0").drop("text")


def name_matches(c: Corpus, q: Query, settings: Settings | None = None) -> DataFrame:
    m = Matcher(q)
    return c.catalog.filter(passes(q.filters, c.home) & permitted(settings)[0] & m.matches(F.col("display"))).select("id", "path", "mtime", "size", "name")


def find(c: Corpus, q: Query, limit: int = 200, settings: Settings | None = None) -> DataFrame:
    """Names and texts, fused: (id, path, score, sources, count), in order of score or as the query sorts. Each list is cut after its own order, which is the query's sort where it has one, so that the first hits of a sort are the first of all."""
    k = q.filters.limit or limit
    pool = max(5 * k, 100)
    order = ranking.sort_order(q.filters.sort) if q.filters.sort else None
    names = ranking.ranked(name_matches(c, q, settings), order or [F.asc("id")], k)
    best = ranking.ranked(content_matches(c, q, settings), order or [F.desc("count"), F.desc("mtime"), F.asc("id")], pool)
    fused = ranking.fuse([(names, 1.0, "name"), (best, 1.0, "content")])
    return decorated(c, fused.join(best.select("id", "count"), "id", "left"), k, q.filters.sort)


def boosts(c: Corpus, fused: DataFrame) -> DataFrame:
    """Hits with their files' columns and the score raised by frecency and recency."""
    opens = ranking.frecency(c.table("opens")).select("path", F.col("count").alias("opened"), (F.unix_micros(F.col("last").cast("timestamp")) / 1000).alias("last_ms"))
    hits = fused.join(c.files.select("id", "path", "name", "size", "mtime"), "id").join(opens, "path", "left")
    score = ranking.boosted(F.col("score"), ranking.frecency_points(F.col("opened"), F.col("last_ms"), c.now), ranking.recency_points(F.col("mtime"), c.now))
    return hits.withColumn("score", score).drop("opened", "last_ms")


def ordered(hits: DataFrame, k: int, sort: str | None = None) -> DataFrame:
    """The first k as the query sorts, else by score."""
    return hits.orderBy(*(ranking.sort_order(sort) if sort else [F.desc("score"), F.desc("mtime"), F.asc("id")])).limit(k)


def decorated(c: Corpus, fused: DataFrame, k: int, sort: str | None = None) -> DataFrame:
    """Frecency and recency boosts, the total order, the limit."""
    return ordered(boosts(c, fused), k, sort).drop("name", "size")


# --- keyword search ---


def postings(c: Corpus, words: list[str] | None = None, prefixes: list[str] = ()) -> DataFrame:
    """(term, col, id) with set semantics: which of name, dirs and body hold the term; stored ones where the corpus has them. With words or beginnings only theirs: one pattern finds them in a text, no other word is made."""
    if c.postings:
        return read_postings(c.spark, c.postings, words, prefixes)
    of = T.terms if words is None else lambda text: T.terms_among(text, words, prefixes)
    each = lambda df, col, terms: df.select(F.lit(col).alias("col"), "id", F.explode(terms).alias("term"))
    names = each(c.files, "name", of(F.array_join(T.name_tokens(F.col("name")), " ")))
    dirs = each(c.catalog, "dirs", of(F.array_join(T.name_tokens(paths.parent(F.col("display"))), " ")))
    body = each(c.table("texts"), "body", of(F.col("data"))).withColumnRenamed("id", "text").join(c.table("content_map").select("id", "text"), "text").select("col", "id", "term")
    return reduce(DataFrame.unionByName, [names, dirs, body])


def vocabulary(c: Corpus) -> DataFrame:
    """(term, df, is_long): distinct words of texts."""
    return c.table("texts").select(F.explode(T.terms(F.col("data"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("is_long", T.is_long_word(F.col("term")))


def word_condition(word: str, prefix: bool = False) -> Column:
    """A word, or each word of a phrase since postings keep no places."""
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def query_words(q: Query) -> list[str]:
    words = []
    for w in [*q.words, *(x for p in q.phrases for x in p.split())]:
        words += [t for t in "".join(ch if ch.isalnum() else " " for ch in T.fold_py(w)).split()]
    return list(dict.fromkeys(words))


def keyword_ids(c: Corpus, words: list[str], without: list[str] = (), prefix_last: bool = False, any_word: bool = False) -> DataFrame:
    """(id, hits): files that hold all the words (or any), and none of the others, in name, folders or text. Words are tested where the terms are made; only matches are shuffled."""
    conds = [word_condition(w, prefix_last and i == len(words) - 1 and len(w) >= 3) for i, w in enumerate(words)]
    group = reduce(lambda acc, ic: F.when(ic[1], ic[0]).otherwise(acc), reversed(list(enumerate(conds))), F.lit(None).cast("int"))
    long = prefix_last and bool(words) and len(words[-1]) >= 3
    p = postings(c, [*words, *without], words[-1:] if long else [])
    hits = p.filter(reduce(Column.__or__, conds)).select("id", group.alias("g")).groupBy("id").agg(F.countDistinct("g").cast("int").alias("hits"))
    hits = hits if any_word else hits.filter(F.col("hits") == len(words))
    if without:
        hits = hits.join(p.filter(F.col("term").isin(*without)).select("id").distinct(), "id", "left_anti")
    return hits


def keyword(c: Corpus, q: Query) -> DataFrame:
    """All words; any of them where no file holds all."""
    words, without = query_words(q), [T.fold_py(w) for w in q.without]
    every = keyword_ids(c, words, without, q.typing)
    if len(words) < 2:
        return every
    none = every.limit(1).agg(F.count("*").alias("found"))
    any_ = keyword_ids(c, words, without, q.typing, any_word=True).crossJoin(F.broadcast(none)).filter("found = 0").drop("found")
    return every.unionByName(any_)


def similar_terms(vocab: DataFrame, word: str, most: int = 24) -> DataFrame:
    """Words of the vocabulary within one edit (two for eight letters or more) that share the first or last letter: (distance, term)."""
    edits = 2 if len(word) >= 8 else 1
    v = vocab.filter(~F.col("is_long") & (F.col("term") != word) & F.length("term").between(len(word) - edits, len(word) + edits))
    v = v.filter((F.substring("term", 1, 1) == word[0]) | F.col("term").endswith(word[-1])).filter(F.levenshtein("term", F.lit(word)) <= 2 * edits)
    return v.select(T.osa_udf("term", F.lit(word), F.lit(edits)).alias("distance"), "term").filter(F.col("distance") <= edits).orderBy("distance", "term").limit(most)


def containing_terms(vocab: DataFrame, part: str, most: int = 40) -> DataFrame:
    """Words that hold the part; none if there are more than `most`."""
    found = vocab.filter(F.col("term").contains(part) & (F.col("term") != part)).select("term").orderBy("term").limit(most + 1)
    n = found.agg(F.count("*").alias("found"))
    return found.crossJoin(F.broadcast(n)).filter(F.col("found") <= most).select("term")


# --- fuzzy names ---


def fuzzy_names(c: Corpus, query: str, limit: int | None = 50, filters=None, settings: Settings | None = None) -> DataFrame:
    """(id, path, score), all of them without a limit: path scores, less a thousandth of the length, plus frecency and recency; folders included."""
    terms = fuzzy.parse_terms(query)
    files = c.catalog.filter(fuzzy.may_match(F.col("display"), terms) & permitted(settings)[0])
    if filters is not None:
        files = files.filter(passes(filters, c.home))
    opens = ranking.frecency(c.table("opens")).select("path", F.col("count").alias("opened"), (F.unix_micros(F.col("last").cast("timestamp")) / 1000).alias("last_ms"))
    hits = files.select("id", "path", "display", "mtime", fuzzy.score(F.col("display"), terms).alias("raw")).filter(F.col("raw").isNotNull()).join(opens, "path", "left")
    score = F.col("raw") + ranking.frecency_points(F.col("opened"), F.col("last_ms"), c.now) + ranking.recency_points(F.col("mtime"), c.now) - F.length("display") / 1000.0
    hits = hits.select("id", "path", score.alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), "id").limit(max(2 * limit, 100))


def typo_names(c: Corpus, words: list[str]) -> DataFrame:
    """(id, score): every word has a name word within its edits; near ones score more. Name words are met once each, then joined back."""
    each = c.files.select("id", F.explode(F.array_distinct(F.transform(T.name_tokens(F.col("name")), T.fold))).alias("w"))
    types = each.select("w").distinct()
    hits = []
    for i, word in enumerate(w for w in words if len(w) >= 4):
        edits = 2 if len(word) >= 8 else 1
        near = types.filter(T.within_edits(F.col("w"), F.lit(word), F.lit(edits))).select("w", F.lit(i).alias("g"), (8 * len(word) - 12 * T.osa_udf("w", F.lit(word), F.lit(edits))).alias("points"))
        hits.append(near)
    found = each.join(reduce(DataFrame.unionByName, hits), "w").groupBy("id", "g").agg(F.max("points").alias("points"))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.sum("points").alias("score")).filter(F.col("n") == len(hits)).select("id", "score")


# --- groups ---


BRANCH = 5000  # hits of a part of a group that are ranked one by one


def leaf(c: Corpus, text: str, settings: Settings | None = None, embed=None) -> DataFrame:
    """(id, score, sources) of all hits of one part, in the mode it names; filters alone score nothing."""
    q = parse(text, c.now)
    none = F.array().cast("array<string>")
    if not q.text:
        return c.files.filter(passes(q.filters, c.home) & permitted(settings)[0]).select("id", F.lit(0.0).alias("score"), none.alias("sources"))
    if q.mode == "fuzzy":
        return fuzzy_names(c, q.text, None, q.filters, settings).select("id", "score", F.array(F.lit("name")).alias("sources"))
    if q.mode == "semantic":
        return meaning(c, q, embed, settings).select("id", "score", F.array(F.lit("meaning")).alias("sources"))
    names = ranking.ranked_whole(name_matches(c, q, settings), [F.asc("id")], BRANCH)
    found = materialize(content_matches(c, q, settings), "group-hits")  # a row per hit; ranks read them twice
    best = ranking.ranked_whole(found, [F.desc("count"), F.desc("mtime"), F.asc("id")], BRANCH)
    return boosts(c, ranking.fuse([(names, 1.0, "name"), (best, 1.0, "content")])).select("id", "score", "sources")


def search_group(c: Corpus, g: Group, settings: Settings | None = None, embed=None) -> DataFrame:
    """(id, score, sources): parts that must all hold keep the files that all have, alternatives those that any has; scores add up, sources unite. One aggregation per level, no part is cut."""
    if g.op == "leaf":
        return leaf(c, g.text, settings, embed)
    parts = [search_group(c, p, settings, embed).withColumn("part", F.lit(k)) for k, p in enumerate(g.parts)]
    out = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.countDistinct("part").alias("parts"))
    return (out.filter(F.col("parts") == len(parts)) if g.op == "and" else out).drop("parts")


def meaning(c: Corpus, q: Query, embed=None, settings: Settings | None = None) -> DataFrame:
    """(id, score, z): files by what their passages mean and by the query's words. embed(text) gives the query's vector; without it, or where it gives none, words alone decide.

    Code and data are left out unless the query asks for their type, files of proofs always. Passages are compared with those of the files that may be found; words count in all files."""
    text = " ".join([*q.words, *q.phrases]) or q.text
    terms, hinted = semantic.query_terms(text), semantic.kind_hints(text)
    lookup = semantic.is_lookup(terms)
    files = c.files.filter(~F.col("is_dir") & passes(q.filters, c.home) & permitted(settings)[1] & ~F.col("ext").isin(*semantic.NEVER))
    if not {"code", "data"} & {k for k in q.filters.kinds or ()}:
        files = files.filter(~F.col("kind").isin("code", "data"))
    kinds = files.select(F.col("id").alias("file"), "kind")
    vector = embed(text) if embed else None
    r = semantic.Ranking() if vector is not None else semantic.Ranking(**semantic.WORDS_ONLY, word_gate=min(0.5, 3 / max(1, len(terms))))
    if vector is not None:
        rows = c.table("passages").filter("start_pos >= 0").dropDuplicates(["file", "n"]).join(kinds.select("file"), "file", "left_semi")
        rows = rows.select("file", "n", "hash", (F.col("n") < semantic.FIRST_ROUND).alias("sets_scale"), F.lit(0).alias("modality"))
        scored = materialize(semantic.scored(rows, semantic.usable_vectors(c.table("vectors"), len(vector)), vector), "scored")  # its scalars read it several times
        best = semantic.best_by_file(semantic.meaning(scored), r).select("file", "z")
    else:
        best = c.spark.createDataFrame([], "file bigint, z double")
    hits = postings(c, terms).select("col", "id", "term") if terms else c.spark.createDataFrame([], "col string, id bigint, term string")
    words = semantic.coverage(hits.select("id", "term").distinct(), terms, c.files.count(), r)
    named = hits.filter("col = 'name'").select("id", "term").distinct().groupBy("id").agg((F.count("*") / F.lit(float(max(1, len(terms))))).alias("named")).withColumnRenamed("id", "file")
    return semantic.rank(best, words, named, kinds, lookup, hinted, r).select(F.col("file").alias("id"), "score", "z")


def search(c: Corpus, raw: str, mode: str = "find", limit: int = 200, settings: Settings | None = None, embed=None) -> DataFrame:
    """One query of the language in the mode it asks for. With settings, what their policy denies is never found, and what it holds back is found by name only."""
    g = groups(raw) if mode == "find" else None
    q = parse(raw, c.now, mode)
    k, sort = q.filters.limit or limit, q.filters.sort
    rows = c.files.select("id", "path", "name", "size", "mtime")
    if (q.mode or mode) == "semantic" and q.text:
        hits = meaning(c, q, embed, settings).join(rows, "id")
        return ordered(hits, k, sort) if sort else hits.orderBy(F.desc("score"), "id").limit(k)
    if g:
        return ordered(search_group(c, g, settings, embed).join(rows, "id"), k, sort)
    if not q.text:
        return browse(c, q, limit, settings) if q.filters.any() else empty_query(c, limit, settings)
    if (q.mode or mode) == "fuzzy":
        hits = fuzzy_names(c, q.text, None if sort else limit, q.filters, settings)
        return ordered(hits.select("id", "score").join(rows, "id"), k, sort) if sort else hits
    return find(c, q, limit, settings)


def empty_query(c: Corpus, limit: int, settings: Settings | None = None) -> DataFrame:
    """The files opened last, then the newest others."""
    opened = ranking.frecency(c.table("opens")).join(c.files.filter(permitted(settings)[0]).select("id", "path"), "path").orderBy(F.desc("last"), "id").limit(min(limit, 20)).select("id", "path", F.lit(0).alias("part"), F.unix_micros(F.col("last").cast("timestamp")).alias("at"))
    rest = ranking.newest(c.files.filter(~F.col("is_dir") & permitted(settings)[0]), limit + 20).join(opened.select("id"), "id", "left_anti").select("id", "path", F.lit(1).alias("part"), (F.col("mtime") * 1000).alias("at"))
    return opened.unionByName(rest).orderBy("part", F.desc("at"), "id").limit(limit)
