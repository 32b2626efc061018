"""Reading what was found: passages as lines, previews, pages of lines, key sweeps, recent searches, completions, explanations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweh.functions import text as T
from fernweh.operators import health, snippets

PREVIEW = 400
RECENT = 50
_KEY = r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----|PuTTY-User-Key-File"
LABELS = {"date": "the date filter", "created": "the created filter", "size": "the size filter", "type": "the type filter", "folder": "the folder filter", "path": "the path filter", "name": "the name filter", "tag": "the tag filter", "all": "filters"}


def passage_lines(passages: DataFrame, content: DataFrame, words: list[str]) -> DataFrame:
    """(file, n, line, text): up to three lines of each passage that hold a word, else its first two that aren't blank; lines count from the start of the file's text."""
    j = passages.join(content.withColumnRenamed("id", "file"), "file")
    before = F.substring("data", F.lit(1), F.col("start_pos").cast("int"))
    body = F.substring("data", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int"))
    first = F.size(T.lines(before))
    rows = F.transform(T.lines(body), lambda x, i: F.struct((i + first).cast("int").alias("line"), x.alias("text")))
    fits = lambda r: reduce(Column.__or__, [T.fold(r["text"]).contains(w) for w in words])
    hits = F.slice(F.filter(rows, fits), 1, 3)
    shown = F.slice(F.filter(rows, lambda r: F.trim(r["text"]) != ""), 1, 2)
    return j.select("file", "n", F.inline(F.when(F.size(hits) > 0, hits).otherwise(shown)))


def preview(texts: DataFrame, condition, window: int = PREVIEW, fold: bool = False, around: int = 2) -> DataFrame:
    """(id, line, text): a window that begins a quarter above the first match, or only matches with their neighbours."""
    rows = F.transform(T.lines(F.col("data")), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text")))
    t = texts.select("id", rows.alias("rows"))
    t = t.withColumn("hits", F.transform(F.filter("rows", lambda r: condition(r["text"])), lambda r: r["line"]))
    focus = F.coalesce(F.try_element_at("hits", F.lit(1)), F.lit(1))
    start = F.greatest(F.lit(1), focus - window // 4)
    shown = F.slice("rows", start, F.lit(window))
    if fold:
        near = F.filter("rows", lambda r: F.exists("hits", lambda h: F.abs(h - r["line"]) <= around))
        shown = F.when(F.size("hits") > 0, F.slice(near, 1, window)).otherwise(shown)
    return t.select("id", F.inline(shown))


def page_of_line(starts: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line, page): the last page that begins at or before the line; page starts of a text are one array."""
    a = starts.groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("starts"))
    return lines.join(a, "id").select("id", "line", F.size(F.filter("starts", lambda s: s <= F.col("line"))).alias("page"))


def key_holders(content: DataFrame) -> DataFrame:
    """(id): texts that hold a private key; words are tested before the pattern."""
    low = F.lower("data")
    words = (low.contains("private") & low.contains("key")) | (low.contains("putty") & low.contains("user") & low.contains("file"))
    return content.filter(words & F.col("data").rlike(_KEY)).select("id")


def recent(log: DataFrame, name: str, at: str, most: int = RECENT) -> DataFrame:
    """(name, at): the last use of each name, whatever its case, newest first."""
    return log.filter(F.col(name).isNotNull()).groupBy(F.upper(name).alias("__n")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(name).alias("name"))).alias("r")).select("r.name", "r.at").orderBy(F.desc("at"), "name").limit(most)


def retry_due(files: DataFrame, last_attempt: int | None, now: int, full_walk: bool = True, wait: int = 3_600_000) -> DataFrame:
    """(id): pictures whose recognition and recordings whose transcription timed out, when a full walk may try again."""
    due = full_walk and (last_attempt is None or now - last_attempt >= wait)
    timed_out = F.col("note").rlike("(?i)^(?:OCR )?timed out") | F.col("note").rlike("(?i)not ready|asset")
    return files.filter(F.lit(due) & (F.col("content_state") == health.ERROR) & F.col("kind").isin("image", "audio", "video") & timed_out).select("id")


def stale(last_walk: int | None, now: int, minutes: int) -> bool:
    return minutes > 0 and (last_walk is None or now - last_walk > minutes * 60_000)


def sentences(diagnosis: list[tuple[str, int]]) -> list[str]:
    """What a diagnosis says, for people."""
    out = []
    for name, n in diagnosis:
        if name != "as written" and n:
            out.append(f"{n:,} {'result' if n == 1 else 'results'} without {LABELS.get(name, name)}")
    return out


def state_record(files: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: statistics, problems by category, the last run."""
    problems = health.problems(files).groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("problems"))
    last = runs.agg(F.max_by("status", "run_id").alias("last_status"), F.max("run_id").alias("last_run"))
    return health.stats(files).crossJoin(problems).crossJoin(last)


# --- a stand-in for an embedding model, for tests: words to dimensions by hash ---

CONCEPTS = {"automobile": "car", "vehicle": "car", "sedan": "car", "bill": "invoice", "receipt": "invoice", "payment": "invoice", "puppy": "dog", "canine": "dog", "vacation": "holiday", "trip": "holiday", "travel": "holiday"}
_embedder = None


def register_embedder(embed) -> None:
    """embed(list of texts) -> array (n, d); it must be importable on executors."""
    global _embedder
    _embedder = embed


def concept_vectors(texts: list[str], dim: int = 256) -> np.ndarray:
    import zlib

    v = np.full((len(texts), dim), 0.01)
    for i, t in enumerate(texts):
        for w in "".join(c if c.isalpha() else " " for c in T.fold_py(t or "")).split():
            v[i, zlib.crc32(CONCEPTS.get(w, w).encode()) % dim] += 1 if len(w) > 3 else 0.2
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def embedded(prompts: DataFrame) -> DataFrame:
    """(hash, vec) of distinct prompts (hash, prompt)."""
    embed = _embedder or concept_vectors

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"hash": pdf["hash"], "vec": list(embed(pdf["prompt"].tolist())) if len(pdf) else []})

    return prompts.groupBy("hash").agg(F.min("prompt").alias("prompt")).mapInPandas(run, "hash string, vec array<double>")


def line_count(texts: DataFrame) -> DataFrame:
    return snippets.lines(texts).groupBy("id").agg(F.count("*").alias("lines"), F.max("page").alias("pages"))
