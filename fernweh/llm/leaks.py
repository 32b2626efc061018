"""Finding held-out test passages inside a corpus.

Both sides become word sequences of what the text looks like (see lookalikes): without case, punctuation, white
space and marks at line starts. Word n-grams of the passages are seeds. Documents are joined with the items by the
seeds they hold (the items' seeds are a bounded table, so the join is a look-up while a document is read), the
documents that hold a seed are counted over the corpus, and each pair of document and item is then aligned from its
rarest seed on.

The alignment is Smith-Waterman's with the rule of the task as its states: matches, and single words changed, dropped
or added, where an edit is open only after eight matches, the ends being free. A path through a seed leaves its
diagonal by an edit only, so the cells off the diagonals of seeds are never filled, and every seed is the anchor of an
alignment of its own: a clean stretch counts whatever else, however well it scores, lies beside it. A pair is proved
by a stretch of twenty of the item's words.

Why seeds of eight words lose nothing: of a stretch of twenty words or more in which edits keep that distance, some
run of unchanged words has eight at least. Rare seeds come first as they prove most pairs at once; none is dropped.

Test items are broadcast in blocks of a bounded number of words; more items than fit take more passes over the
documents, so memory never grows with them. Of documents only those that hold a seed, and of these only the words
that a stretch round a seed can reach, go on.

Defined cases: null or empty texts and passages are in no pair; each copy of a document is a case; repeated items
count by their id; extra columns are ignored. Words of scripts written without spaces count as found between
punctuation.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweh.llm.lookalikes import skeleton
from fernweh.runtime import materialize, spread

SEED = 8
STRETCH = 20
APART = 8
BLOCK_WORDS = 500_000
REACH = 2 * STRETCH  # words on each side of a seed that a stretch of STRETCH words through it can reach

_START = re.compile(r"(?m)^[ \t]*(?:(?:[>|#*+•–—-]+|\d{1,3}[.)]|[A-Za-z]{1,3}>)[ \t]*)+(?=\S)")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORDS.findall(_START.sub("", skeleton(text)).casefold())


def run(a: np.ndarray, b: np.ndarray, d: int, i: int) -> int:
    """Length of the run of equal words that begins at (d, i)."""
    m = min(len(a) - d, len(b) - i)
    if m <= 0:
        return 0
    same = a[d : d + m] == b[i : i + m]
    k = int(same.argmin())
    return m if same[k] else k


EDITS = ((1, 1, 1), (0, 1, 1), (1, 0, 0))  # changed, dropped, added: steps in the document, in the item, words of the item


def extend(a: np.ndarray, b: np.ndarray, d: int, i: int, before: int, need: int) -> int:
    """Words of the item that a legal path reaches beyond (d, i), where a run of `before` matches ends; followed until there are `need`."""
    best = 0
    for dd, di, words_ in EDITS:
        x, y = d + dd, i + di
        r = run(a, b, x, y)
        if not r:
            continue
        back = 0  # an edit beside equal words may as well stand earlier, which lengthens the run after it
        while dd != di and back < before - APART and x - 1 - back >= 0 and y - 1 - back >= 0 and a[x - 1 - back] == b[y - 1 - back]:
            back += 1
        reach = words_ + r
        if reach < need and r + back >= APART:
            reach += extend(a, b, x + r, y + r, r + back, need - reach)
        best = max(best, reach)
        if best >= need:
            break
    return best


def stretch(a: np.ndarray, b: np.ndarray, d: int, i: int, need: int = STRETCH) -> int:
    """Words of the item in the longest stretch through the seed at (d, i), followed until there are `need`."""
    right = run(a, b, d, i)
    ra, rb = a[::-1], b[::-1]
    left = run(ra, rb, len(a) - d, len(b) - i)
    own = left + right
    if own < need and own >= APART:
        own += extend(a, b, d + right, i + right, left + right, need - own)
    if own < need and left + right >= APART:
        own += extend(ra, rb, len(a) - d + left, len(b) - i + left, left + right, need - own)
    return own


class Items:
    """Seeds and word ids of a block of test items."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = SEED):
        self.seed = seed
        self.ids: dict[str, int] = {}
        self.words: dict[int, list[np.ndarray]] = {}
        own: dict[int, set[tuple[int, int, int]]] = {}
        for item, passage in sorted(rows):
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words(passage)], dtype=np.int32)
            k = len(self.words.setdefault(item, []))
            self.words[item].append(w)
            for at, h in enumerate(self.hashes(w)):
                own.setdefault(int(h), set()).add((item, k, at))
        self.keys = np.array(sorted(own), dtype=np.uint64)
        self.at = [sorted(own[int(h)]) for h in self.keys]

    def hashes(self, w: np.ndarray) -> np.ndarray:
        n = len(w) - self.seed + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.seed):
            h = (h ^ w[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seeds) at which the words hold a seed."""
        h = self.hashes(w)
        if not len(h) or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        where = np.flatnonzero(self.keys[at] == h)
        return where, at[where]

    def prove(self, w: np.ndarray, hits: list[tuple[int, int]]) -> list[int]:
        """Items of which the words hold a stretch; hits are (position, seed), rarest seeds first."""
        out: set[int] = set()
        seen: set[tuple[int, int, int]] = set()  # runs looked at: item, passage, diagonal with the run's end
        for d, seed in hits:
            for item, k, i in self.at[seed]:
                if item in out:
                    continue
                b = self.words[item][k]
                end = d + run(w, b, d, i)
                if (item, k, (d - i) * (1 << 32) + end) in seen:
                    continue
                seen.add((item, k, (d - i) * (1 << 32) + end))
                if stretch(w, b, d, i) >= STRETCH:
                    out.add(item)
        return sorted(out)

    def found(self, w: np.ndarray) -> list[int]:
        return self.prove(w, list(zip(*(x.tolist() for x in self.hits(w)))))


def _seeded(frames, items: Items, id_col: str, column: str):
    """(doc_id, start, words, places, seeds) of the stretches of documents that hold seeds; stretches farther apart than a path can reach are rows of their own."""
    get = items.ids.get
    for pdf in frames:
        ids, codes, ends, total = [], [], [0], 0
        for i, text in zip(pdf[id_col], pdf[column]):
            ws = words(text)
            codes.append(np.fromiter(map(get, ws, (0,) * len(ws)), dtype=np.int32, count=len(ws)))
            total += len(ws)
            ids.append(i)
            ends.append(total)
        out = []
        if total >= items.seed:  # one pass over the batch; hits across two documents are dropped below
            where, seeds = items.hits(np.concatenate(codes))
            bounds = np.array(ends)
            doc = np.searchsorted(bounds, where, side="right") - 1
            inside = where + items.seed <= bounds[doc + 1]
            where, seeds, doc = where[inside], seeds[inside], doc[inside]
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(where) > 2 * REACH + items.seed)) + 1
            for at, key, k in zip(np.split(where, cuts), np.split(seeds, cuts), doc[np.concatenate(([0], cuts))] if len(doc) else ()):
                at = at - bounds[k]
                lo = max(0, int(at[0]) - REACH)
                part = codes[k][lo : int(at[-1]) + items.seed + REACH]
                out.append((ids[k], lo, part.tobytes(), (at - lo).tolist(), key.tolist()))
        frame = pd.DataFrame(out, columns=["doc_id", "start", "words", "places", "seeds"])
        frame["doc_id"] = frame["doc_id"].astype("int64")
        yield frame


def _prove(frames, items: Items):
    for pdf in frames:
        out = []
        for doc, w, places, seeds, rarity in zip(pdf["doc_id"], pdf["words"], pdf["places"], pdf["seeds"], pdf["rarity"]):
            of = {x["seed"]: x["docs"] for x in rarity}
            hits = sorted(((int(p), int(s)) for p, s in zip(places, seeds)), key=lambda h: (of[h[1]], h[0]))
            out.extend((doc, item) for item in items.prove(np.frombuffer(w, dtype=np.int32), hits))
        yield pd.DataFrame(out, columns=["doc_id", "item_id"], dtype="int64")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents that hold a stretch of an item's passage."""
    items = items.filter(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "passage")
    total = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = int(total // (4 * BLOCK_WORDS)) + 1  # a word has about five characters; four are on the safe side
    spark = docs.sparkSession
    docs = spread(docs.select(id_col, column).filter(F.col(column).isNotNull() & F.col(id_col).isNotNull()))
    found = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
        held = materialize(docs.mapInPandas(lambda frames, shared=shared: _seeded(frames, Items(shared.value), id_col, column), "doc_id bigint, start int, words binary, places array<int>, seeds array<int>"), "seeded")
        each = held.select("doc_id", "start", F.explode(F.array_distinct("seeds")).alias("seed"))
        docs_of = each.groupBy("seed").agg(F.countDistinct("doc_id").alias("docs"))  # in how many documents: a row per seed of the block, of which there are at most BLOCK_WORDS
        rarity = each.join(F.broadcast(docs_of), "seed").groupBy("doc_id", "start").agg(F.collect_set(F.struct("seed", "docs")).alias("rarity"))
        found.append(held.join(rarity, ["doc_id", "start"]).select("doc_id", "words", "places", "seeds", "rarity").mapInPandas(lambda frames, shared=shared: _prove(frames, Items(shared.value)), "doc_id bigint, item_id bigint"))
    return reduce(DataFrame.unionByName, found).distinct()
