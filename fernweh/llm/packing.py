"""Filling containers of fixed capacity with documents.

Sizes are tokens of a public tokenizer. Documents are spread over shards by a hash of their id, so that every shard
sees the same mixture of sizes. In a shard, best-fit placement of the documents from the largest to the smallest is
followed by a local search over the bins that aren't full: moving a document, exchanging one for one or two for one,
whenever that lets the fuller bin grow, which increases the sum of squared fills; bins that lose all their documents
go. What a shard leaves underfull goes to a second, much smaller round over merged shards.

Only (id, piece, tokens) is shuffled, never a text. A shard holds about SHARD documents however large the collection
is.

Defined cases: null texts are no document; empty texts have no tokens and are in no container; a document longer than
the capacity is cut into full pieces and a rest, the only case of a split; equal texts are documents of their own; of
repeated ids each row is a document; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweh.runtime import materialize, spread

CAPACITY = 2048
SHARD = 8192  # documents that are packed together; more would hardly fill containers better, see the README
FULL = 0.985  # bins filled below this go to the second round
MERGE = 16
VOCABULARY = os.environ.get("FERNWEH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the public vocabulary's splitting pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_coders: dict = {}


def coder(vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per worker."""
    if vocabulary not in _coders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _coders[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _coders[vocabulary]


def _sizes(frames, id_col: str, column: str, vocabulary: str, capacity: int):
    encode = coder(vocabulary).encode_ordinary
    for pdf in frames:
        out = []
        for i, text in zip(pdf[id_col], pdf[column]):
            n = len(encode(text.encode("utf-8", "replace").decode("utf-8") if text else ""))
            for piece, at in enumerate(range(0, n, capacity)):
                out.append((i, piece, at, min(capacity, n - at)))
        yield pd.DataFrame(out, columns=["doc_id", "piece", "start_token", "tokens"])


def sizes(docs: DataFrame, id_col: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start_token, tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = spread(docs.select(id_col, column).filter(F.col(column).isNotNull()))
    return src.mapInPandas(lambda f: _sizes(f, id_col, column, vocabulary, capacity), f"doc_id {kind}, piece int, start_token int, tokens int")


def pack(tokens: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of positions in tokens."""
    order = sorted(range(len(tokens)), key=lambda i: (-tokens[i], i))
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # sorted (free, bin)
    for i in order:
        k = bisect_left(free, (tokens[i], -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        if room > tokens[i]:
            insort(free, (room - tokens[i], b))
    return improve(bins, tokens, capacity)


class Stock:
    """The documents of the bins that aren't full, by size."""

    def __init__(self, bins: list[list[int]], tokens: list[int], capacity: int):
        self.bins, self.tokens, self.capacity = [list(b) for b in bins], tokens, capacity
        self.fill = [sum(tokens[i] for i in b) for b in self.bins]
        self.home = {i: b for b, items in enumerate(self.bins) for i in items}
        self.of: dict[int, set[int]] = {}
        self.sizes: list[int] = []
        for b in range(len(self.bins)):
            if 0 < self.fill[b] < capacity:
                for i in self.bins[b]:
                    self.add(i)

    def add(self, i: int) -> None:
        own = self.of.setdefault(self.tokens[i], set())
        if not own:
            insort(self.sizes, self.tokens[i])
        own.add(i)

    def drop(self, i: int) -> None:
        own = self.of.get(self.tokens[i], set())
        own.discard(i)
        if not own and (k := bisect_left(self.sizes, self.tokens[i])) < len(self.sizes) and self.sizes[k] == self.tokens[i]:
            self.sizes.pop(k)

    def largest(self, limit: int, above: int, a: int) -> tuple[int, int] | None:
        """(size, document) of the largest document of over `above` and at most `limit` tokens in another bin that is no fuller than a; of several the one of the emptiest bin."""
        k = bisect_right(self.sizes, limit) - 1
        while k >= 0 and self.sizes[k] > above:
            fits = [(self.fill[self.home[i]], self.home[i], i) for i in self.of[self.sizes[k]] if self.home[i] != a and self.fill[self.home[i]] <= self.fill[a]]
            if fits:
                return self.sizes[k], min(fits)[2]
            k -= 1
        return None

    def move(self, i: int, to: int) -> None:
        self.bins[self.home[i]].remove(i)
        self.bins[to].append(i)
        self.fill[self.home[i]] -= self.tokens[i]
        self.fill[to] += self.tokens[i]
        self.home[i] = to


def improve(bins: list[list[int]], tokens: list[int], capacity: int) -> list[list[int]]:
    """Local search: every step takes tokens from an emptier bin into a fuller one, so the sum of squared fills grows; it ends where no move and no exchange of one or two for one does so.

    A bin is asked by the sizes it holds: those that differ are 63 at most where the capacity is 2,048, as their sum must fit."""
    stock = Stock(bins, tokens, capacity)
    moved = True
    while moved:
        moved = False
        for a in sorted((b for b in range(len(stock.bins)) if 0 < stock.fill[b] < capacity), key=lambda b: (-stock.fill[b], b)):
            while 0 < stock.fill[a] < capacity and (step := _step(stock, a)):
                out, come = step
                b = stock.home[come]
                for i in out:
                    stock.move(i, b)
                stock.move(come, a)
                for x in (a, b):
                    if not 0 < stock.fill[x] < capacity:
                        for i in stock.bins[x]:
                            stock.drop(i)
                moved = True
    return [b for b in stock.bins if b]


def _step(stock: Stock, a: int) -> tuple[tuple[int, ...], int] | None:
    """The move or exchange that lets bin a grow most: (documents that leave it, the one that comes)."""
    room = stock.capacity - stock.fill[a]
    mine: dict[int, list[int]] = {}
    for i in stock.bins[a]:
        mine.setdefault(stock.tokens[i], []).append(i)
    sizes = sorted(mine, reverse=True)
    ways = [()] + [(s,) for s in sizes] + [(s, t) for k, s in enumerate(sizes) for t in sizes[k:] if s != t or len(mine[s]) > 1]
    best = None
    for out in ways:
        gone = sum(out)
        got = stock.largest(room + gone, gone + (best[0] if best else 0), a)
        if got:
            best = (got[0] - gone, out, got[1])
            if best[0] == room:
                break
    if not best:
        return None
    taken: dict[int, int] = {}
    leave = []
    for s in best[1]:
        leave.append(mine[s][taken.get(s, 0)])
        taken[s] = taken.get(s, 0) + 1
    return tuple(leave), best[2]


def _pack_group(pdf: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "doc_id", "piece", "start_token"], ascending=[False, True, True, True]).reset_index(drop=True)
    size = pdf["tokens"].tolist()
    shard = int(pdf["shard"].iat[0])
    bin_of, fill_of = [0] * len(size), [0] * len(size)
    for k, b in enumerate(pack(size, capacity)):
        total = sum(size[i] for i in b)
        for i in b:
            bin_of[i], fill_of[i] = k, total
    pdf["container"] = [f"{level}-{shard}-{k}" for k in bin_of]
    pdf["fill"] = fill_of
    return pdf[["doc_id", "piece", "start_token", "tokens", "container", "fill"]]


def containers(docs: DataFrame, id_col: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """(container, doc_id, piece, start_token, tokens, fill): what each container holds."""
    items = materialize(sizes(docs, id_col, column, vocabulary, capacity), "sizes")
    n = items.count()
    shards = -(-n // SHARD) or 1
    out_schema = f"doc_id {items.schema['doc_id'].dataType.simpleString()}, piece int, start_token int, tokens int, container string, fill int"
    full = items.filter(F.col("tokens") == capacity).withColumn("container", F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string"))).withColumn("fill", F.col("tokens"))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "start_token"), F.lit(shards)).cast("int")
    first = materialize(
        items.filter(F.col("tokens") < capacity).withColumn("shard", shard).groupBy("shard").applyInPandas(lambda pdf: _pack_group(pdf, capacity, 1), out_schema), "packed"
    )
    done = first.filter(F.col("fill") >= int(FULL * capacity))
    rest = first.filter(F.col("fill") < int(FULL * capacity)).withColumn("shard", F.floor(F.split("container", "-")[1].cast("int") / MERGE).cast("int"))
    second = rest.select("doc_id", "piece", "start_token", "tokens", "shard").groupBy("shard").applyInPandas(lambda pdf: _pack_group(pdf, capacity, 2), out_schema)
    return full.select(*done.columns).unionByName(done).unionByName(second)
