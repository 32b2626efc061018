"""Vector search: chunks, scores, z-scores, best passage per file, fusion with words, related files, index state.

Scores are made once per distinct vector and joined to passages by hash. A query's scalars (means, deviation) are
one-row aggregates; only those are broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from fernweh.functions import text as T
from fernweh.operators.duplicates import text_hash

CHUNK, CHUNK_LEAST, FIRST_ROUND = 1800, 1200, 40
Z_GATE, FLOOR = 2.0, 0.02
# Words of a query that say what to look for, not what is in it.
STOPWORDS = {
    "how", "does", "did", "do", "can", "could", "would", "should", "a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "and", "or", "my", "me", "that", "this",
    "these", "those", "from", "about", "where", "what", "which", "who", "when", "is", "was", "are", "were", "be", "it", "its", "some", "any", "find", "show", "file", "files",
    "photo", "photos", "picture", "image", "images", "screenshot", "screenshots", "video", "videos", "pdf", "document", "documents", "recording",
}
# Words that name kinds.
KIND_WORDS = {
    "screenshot": ["image"], "screenshots": ["image"], "photo": ["image"], "photos": ["image"], "picture": ["image"], "pictures": ["image"], "image": ["image"], "images": ["image"],
    "pdf": ["pdf"], "pdfs": ["pdf"], "paper": ["pdf"], "papers": ["pdf"], "document": ["doc"], "documents": ["doc"], "note": ["doc", "text", "markdown"], "notes": ["doc", "text", "markdown"],
    "video": ["video"], "videos": ["video"], "clip": ["video"], "movie": ["video"], "audio": ["audio"], "song": ["audio"], "podcast": ["audio"], "voice": ["audio"], "sound": ["audio"],
    "spreadsheet": ["sheet"], "spreadsheets": ["sheet"], "slides": ["slides"], "presentation": ["slides"], "deck": ["slides"], "email": ["email"], "emails": ["email"], "mail": ["email"], "book": ["ebook"], "ebook": ["ebook"],
}


@dataclass(frozen=True)
class Ranking:
    """Weights with meaning at hand; keyword_* hold without."""

    name: float = 2
    name_power: float = 2
    length: float = 0.7
    shared: float = 0.5
    coverage: float = 1.5
    words: float = 1
    meaning: float = 1
    strength: float = 0
    every_word: float = 0
    idf: bool = True
    word_weight: float = 2
    z_gate: float = Z_GATE
    word_gate: float = 0.5


# Weights where no file has a vector: names and words alone.
WORDS_ONLY = dict(name=1, name_power=1, coverage=1, every_word=0.5)
NEVER = ("lean", "olean", "ilean")  # Fixed values: endings of files that meaning never finds.


def query_terms(text: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]+", T.fold_py(text))) if len(w) >= 2 and w not in STOPWORDS]


def is_lookup(terms: list[str]) -> bool:
    """Only codes and numbers, which mean nothing to a model."""
    return bool(terms) and all(any(c.isdigit() for c in t) and (any(c.isalpha() for c in t) or len(t) >= 4) for t in terms)


def kind_hints(text: str) -> list[str]:
    return sorted({k for w in re.findall(r"[^\W_]+", T.fold_py(text)) for k in KIND_WORDS.get(w, ())})


# --- chunks ---


def _fnv(s: str) -> int:
    h = 0x811C9DC5
    for c in s:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return h


def _parts(text: str, start: int, end: int):
    """Stretches of at most CHUNK: a paragraph, else its lines, else runs of words."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if end - start <= CHUNK:
        if end > start:
            yield start, end
        return
    if "\n" in text[start : end - 1]:
        at = start
        for m in re.finditer("\n", text[start:end]):
            yield from _parts(text, at, start + m.start())
            at = start + m.end()
        yield from _parts(text, at, end)
        return
    while start < end:
        stop = min(end, start + CHUNK)
        if stop < end and (space := text.rfind(" ", start, stop + 1)) > start + CHUNK // 2:
            stop = space
        yield from _parts(text, start, stop) if stop - start < end - start else [(start, stop)]
        start = stop


def chunk(text: str) -> list[tuple[int, int]]:
    """Passages whose ends the text decides: an edit moves only the boundaries near it."""
    out, first, last = [], None, None
    at = 0
    spans = []
    for m in re.finditer(r"\n[ \t]*\n|\f", text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    for a, b in spans:
        for s, e in _parts(text, a, b):
            if first is not None and e - first > CHUNK:
                out.append((first, last))
                first = None
            first = s if first is None else first
            last = e
            if last - first >= CHUNK_LEAST and _fnv(text[s:e]) & 3 == 0:
                out.append((first, last))
                first = None
    return out + ([(first, last)] if first is not None else [])


def squeeze(text: str) -> str:
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", re.sub("[ \t ]+", " ", text))


def passages(content: DataFrame) -> DataFrame:
    """(id, n, start_pos, end_pos, text) of every text."""
    def run(frames):
        for pdf in frames:
            rows = [(i, n, s, e, squeeze(t[s:e])) for i, t in zip(pdf["id"], pdf["data"]) if t for n, (s, e) in enumerate(chunk(t))]
            yield pd.DataFrame(rows, columns=["id", "n", "start_pos", "end_pos", "text"])

    return content.select("id", "data").mapInPandas(run, "id bigint, n bigint, start_pos bigint, end_pos bigint, text string")


def prompt(title: Column, text: Column) -> Column:
    return F.when(title == "", text).otherwise(F.concat(title, F.lit("\n\n"), text))


def prompt_hash(col: Column) -> Column:
    return text_hash(col)


# --- scores ---


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def dot(a: Column, b) -> Column:
    """Dot product with a fixed vector or, row by row, with another column; a batch at a time as one matrix product. Higher-order functions of the JVM are interpreted and took ten times as long."""
    if isinstance(b, (list, tuple)):
        q = np.asarray(b, dtype=np.float64)

        @F.pandas_udf(DoubleType())
        def fixed(v: pd.Series) -> pd.Series:
            return pd.Series(_matrix(v) @ q if len(v) else [], dtype="float64")

        return fixed(a)

    @F.pandas_udf(DoubleType())
    def pairs(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", _matrix(v), _matrix(w)) if len(v) else [], dtype="float64")

    return pairs(a, b)


def _units(frames):
    for pdf in frames:
        out = []
        for h, v in zip(pdf["hash"], pdf["vec"]):
            x = np.asarray(v, dtype=np.float64)
            n = np.sqrt((x * x).sum())
            if np.isfinite(n) and n > 0:
                out.append((h, x / n))
        yield pd.DataFrame(out, columns=["hash", "vec"])


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """One vector per hash, of length one; null, cut-off, zero and broken vectors left out."""
    v = vectors.filter((F.size("vec") == dim) & ~F.array_contains("vec", F.lit(float("nan")).cast("float"))).groupBy("hash").agg(F.min("vec").alias("vec"))
    return v.mapInPandas(_units, "hash string, vec array<double>")


def scored(passages_: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Passages with the cosine of their vector and the query; passages without a usable vector left out."""
    s = vectors.select("hash", dot(F.col("vec"), query).alias("score"))
    return passages_.join(s, "hash")


def meaning(rows: DataFrame) -> DataFrame:
    """z: how far a score stands out from those of its modality, in deviations of all. rows: score, modality, sets_scale."""
    scale = rows.filter("sets_scale")
    means = scale.groupBy("modality").agg(F.avg("score").alias("own"), F.count("*").alias("of_modality"))
    everything = scale.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall"))
    m = rows.join(F.broadcast(means), "modality", "left").crossJoin(F.broadcast(everything))  # two modalities, one row
    m = m.withColumn("centred", F.col("score") - F.when(F.coalesce("of_modality", F.lit(0)) >= 20, F.col("own")).otherwise(F.col("overall"))).drop("own", "of_modality", "overall")
    dev = m.filter("sets_scale").agg(F.coalesce(F.avg("centred"), F.lit(0.0)).alias("mid"), F.greatest(F.coalesce(F.stddev_pop("centred"), F.lit(0.0)), F.lit(FLOOR)).alias("dev"))
    return m.crossJoin(F.broadcast(dev)).withColumn("z", (F.col("centred") - F.col("mid")) / F.col("dev")).drop("centred", "mid", "dev")


def best_by_file(rows: DataFrame, r: Ranking = Ranking()) -> DataFrame:
    """(file, z, n): the best passage, less for long files and for texts that many passages share. Counts are pre-aggregated and joined, so that a hash that half the passages share is one row."""
    per_file = rows.groupBy("file").agg(F.count("*").alias("passages"))
    per_hash = rows.groupBy("hash").agg(F.count("*").alias("sharing"))
    best = rows.groupBy("file").agg(F.max(F.struct("z", (-F.col("n")).alias("back"), "hash")).alias("b")).select("file", "b.z", (-F.col("b.back")).alias("n"), "b.hash")
    b = best.join(per_file, "file").join(per_hash, "hash")
    return b.select("file", (F.col("z") - r.length * F.log(F.greatest("passages", F.lit(1))) - r.shared * F.log(F.greatest("sharing", F.lit(1)))).alias("z"), "n")


def coverage(word_hits: DataFrame, terms: list[str], total: Column | int, r: Ranking = Ranking()) -> DataFrame:
    """(file, coverage, weighted): share of the query's words a file holds, plain and with rare words counting more. word_hits: (id, term), distinct."""
    df = word_hits.filter(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + F.greatest(F.lit(total), F.lit(1)) / F.greatest("df", F.lit(1))).alias("idf"))
    absent = F.log(F.lit(1.0) + F.greatest(F.lit(total), F.lit(1)))
    norm = idf.agg((F.sum("idf") + (len(terms) - F.count("*")) * absent).alias("norm"))
    hits = word_hits.filter(F.col("term").isin(terms)).join(F.broadcast(idf), "term")  # a row per word of the query
    return hits.groupBy("id").agg((F.count("*") / F.lit(float(len(terms)))).alias("coverage"), F.sum("idf").alias("sum")).crossJoin(F.broadcast(norm)).select(F.col("id").alias("file"), "coverage", (F.col("sum") / F.col("norm")).alias("weighted"))


def rank(best: DataFrame, words: DataFrame, named: DataFrame, kinds: DataFrame, lookup: bool, hinted: list[str], r: Ranking = Ranking(), pending: DataFrame | None = None) -> DataFrame:
    """(file, score, z): candidates by meaning or words, scored. best: (file, z), words: (file, coverage, weighted), named: (file, named), kinds: (file, kind)."""
    m = best.select("file", "z").join(words, "file", "full_outer").join(named, "file", "left").join(kinds, "file")
    share = F.coalesce("coverage", F.lit(0.0))
    counted = share if lookup or not r.idf else F.coalesce("weighted", F.lit(0.0))
    m = m.filter((F.col("z") >= r.z_gate) | (share >= r.word_gate))
    z = F.coalesce("z", F.lit(0.0))
    if pending is not None:
        m = m.join(pending.select("file", F.lit(True).alias("waits")), "file", "left")
        z = F.coalesce("z", F.when(F.col("waits"), r.z_gate * share).otherwise(0.0))
    meaning_w, words_w = (0.5 * r.meaning, 2 * r.word_weight * r.words) if lookup else (r.meaning, r.word_weight * r.words * r.coverage)
    score = (
        meaning_w * F.greatest(z, F.lit(0.0)) + words_w * F.pow(counted, 1.5) + r.name * F.pow(F.coalesce("named", F.lit(0.0)), r.name_power) * r.words
        + F.when(counted >= 1 - 1e-9, r.every_word * r.words).otherwise(0.0) + F.when(F.col("kind").isin(hinted), 1.0).otherwise(0.0)
        - F.when(F.col("kind").isin("code", "data"), (r.word_weight - 1) * r.words * (2 if lookup else r.coverage) * F.pow(counted, 1.5)).otherwise(0.0)
    )
    return m.select("file", score.alias("score"), "z").orderBy(F.desc("score"), "file")


def rank_fused(by_meaning: DataFrame, by_words: DataFrame, k: int = 60, most: int = 1000) -> DataFrame:
    """Rank fusion of the two orders, each cut to `most`."""
    from fernweh.operators.ranking import ranked

    lists = [ranked(by_meaning, [F.desc("z"), F.asc("file")], most), ranked(by_words, [F.desc("coverage"), F.asc("file")], most)]
    each = reduce(DataFrame.unionByName, [x.select("file", (1.0 / (k + F.col("rank"))).alias("part")) for x in lists])
    return each.groupBy("file").agg(F.sum("part").alias("score"))


# --- related files ---


def related(rows: DataFrame, source: int, votes: int = 8, floor: float = 0.75, limit: int = 20) -> DataFrame:
    """(file, score): files like the source. At most eight of its passages vote; a file's score is its best vote and a quarter of its second. rows: file, n, start_pos, hash, vec."""
    rows = rows.filter("start_pos >= 0")
    per_file = rows.groupBy("file").agg(F.count("*").alias("passages"))
    per_hash = rows.groupBy("hash").agg(F.count("*").alias("sharing"))
    own = rows.filter(F.col("file") == source).groupBy("hash").agg(F.max("n").alias("n"), F.min("vec").alias("q")).join(per_hash.withColumnRenamed("sharing", "own_sharing"), "hash")
    w = W.partitionBy(F.lit(1)).orderBy("n")  # the passages of one file
    own = own.withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(W.partitionBy(F.lit(1))))
    count = F.least(F.lit(votes), F.col("m"))
    picks = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.floor(j * (F.col("m") - 1) / F.greatest(count - 1, F.lit(1))))
    own = own.filter(F.array_contains(picks, F.col("i").cast("bigint"))).select(F.col("i").alias("voter"), "q", "own_sharing")
    vectors = rows.filter(F.col("file") != source).select("hash", "vec").dropDuplicates(["hash"])
    near = vectors.crossJoin(F.broadcast(own)).withColumn("cos", dot(F.col("vec"), F.col("q"))).filter(F.col("cos") >= floor).select("hash", "voter", "own_sharing", "cos")  # at most eight rows
    found = near.join(rows.filter(F.col("file") != source).select("file", "hash"), "hash").join(per_file, "file").join(per_hash, "hash")
    vote = F.col("cos") - 0.025 * F.log(F.greatest("passages", F.lit(1))) - 0.06 * F.log(F.greatest("sharing", "own_sharing", F.lit(1)))
    per = found.withColumn("vote", vote).filter("vote > 0").groupBy("file", "voter").agg(F.max("vote").alias("vote"))
    two = F.sort_array(F.collect_list("vote"), asc=False)
    return per.groupBy("file").agg(two.alias("v")).select("file", (F.col("v")[0] + 0.25 * F.coalesce(F.try_element_at("v", F.lit(2)), F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "file").limit(limit)


# --- index state ---


def signature(title: Column) -> Column:
    return F.concat_ws(":", F.col("size").cast("string"), F.col("mtime").cast("string"), F.col("content_len").cast("string"), title, F.lit("text"), F.coalesce("hash", F.concat(F.lit("#"), F.col("text").cast("string"))))


def rounds(passages_: DataFrame, files: DataFrame) -> DataFrame:
    """(file, n, round, mtime): the first FIRST_ROUND passages of every file are round 1, the others round 2; in a round the newest files come first."""
    return passages_.join(files.select(F.col("id").alias("file"), "mtime"), "file").select("file", "n", F.when(F.col("n") < FIRST_ROUND, 1).otherwise(2).alias("round"), "mtime")


def round_order() -> list[Column]:
    return [F.asc("round"), F.desc("mtime"), F.asc("file"), F.asc("n")]


def index_actions(candidates: DataFrame, state: DataFrame, fingerprint: str | None = None, generation: int | None = None) -> DataFrame:
    """(file, action): keep, resume, embed, chunk or drop. candidates: file, sig; state: file, sig, upto, total (one row per file), with the model's fingerprint and the cutter's generation where these are told: vectors of another model are made anew, passages of another cutter are cut anew and keep the vectors of equal ones."""
    kept = state.select("file", F.col("sig").alias("old"), "upto", "total", *[c for c in ("fingerprint", "generation") if c in state.columns])
    j = candidates.join(kept, "file", "full_outer")
    other = F.lit(False) if fingerprint is None else ~F.col("fingerprint").eqNullSafe(F.lit(fingerprint))
    recut = F.lit(False) if generation is None else ~F.col("generation").eqNullSafe(F.lit(generation))
    action = F.when(F.col("sig").isNull(), "drop").when(F.col("old").isNull() | (F.col("old") != F.col("sig")) | other, "embed").when(recut, "chunk").when(F.col("upto") < F.col("total"), "resume").otherwise("keep")
    return j.select("file", action.alias("action"))
