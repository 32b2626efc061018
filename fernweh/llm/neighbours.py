"""The k most similar vectors of every vector, by cosine.

Balanced posting lists: a sample is clustered by repeated balanced splits until its leaves are small; the leaves'
centroids, linked to their nearest ones, are a graph that is held in memory and searched greedily. Each vector is
put into the list of its nearest centroid and, where it lies near a boundary, into the next ones too; a query visits
the lists whose centroid is at most a given ratio farther than the nearest one, however many these are: where the
graph's beam ends within the ratio, as in dense regions, all centroids are compared. Lists are kept in groups of near ones,
so that a vector travels once per group. A group that holds too many vectors is cut into blocks and one that too many
vectors visit into parts, and each block is searched with each part by itself: a list that is overfull or much visited
costs more tasks, not more memory in one.

Equal vectors are one entry: their hashes are expanded at the end, so that a vector that a third of all rows share
costs as much as any other.

Bounds: the sample is a quarter of the vectors, SAMPLE at most; there are about n / LEAF centroids for n vectors, and
at most about SAMPLE / LEAF_LEAST * 2. Centroids are what is broadcast; the sample only reaches the driver. Every
vector is indexed. Accuracy: recall against brute force is measured in the tests and stated in the README.

Vectors travel as they were stored, in 16-bit numbers where these say the same, and are brought to length one where
they are compared.

Defined cases: null vectors, those of another length, with null, NaN or infinite numbers or all zero take no part;
each hash counts once (of different rows of a hash the least vector counts); ties are broken by hash; fewer than k
others give fewer pairs; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fernweh.runtime import materialize, scatter, spread

DIM = 128
K = 5
SAMPLE, SAMPLE_LEAST = 100_000, 10_000
LEAF, LEAF_LEAST = 64, 8  # vectors per leaf of the whole collection that lists are aimed at; sample vectors per leaf, at least
GROUP = 5_000  # vectors per group of lists
REPLICAS, CLOSURE = 4, 1.12  # lists a vector is put into, and how much farther than the nearest they may be
PROBES, RATIO, PROBES_LEAST = 24, 1.15, 2  # PROBES is the graph's beam, no limit to the lists that are visited
WALK = 4096  # centroids from which on they are found by walking the graph; fewer cost less to compare outright
BLOCK, ASKED = 20_000, 20_000  # members and queries of a group that one call searches
REMEMBERED = 2_000_000  # similarities that are held at once
PLACED = 8_192  # rows of vectors in groups that are made at once


def split(x: np.ndarray, ways: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels of a balanced split: a cluster that is full costs more distance."""
    ways = min(ways, len(x))
    c = x[rng.choice(len(x), ways, replace=False)]
    load = np.zeros(ways)
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        d = 2 - 2 * x @ c.T
        label = np.argmin(d + 0.3 * d.mean() * (load / max(1.0, len(x) / ways) - 1).clip(0), axis=1)
        load = 0.5 * load + 0.5 * np.bincount(label, minlength=ways)
        for k in range(ways):
            if (m := label == k).any():
                v = x[m].sum(axis=0)
                c[k] = v / max(np.linalg.norm(v), 1e-12)
    return label


class Index:
    """Centroids, their groups and their graph, for a collection of n vectors."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        leaf = max(LEAF_LEAST, round(LEAF * len(sample) / max(n, 1)))
        leaves: list[np.ndarray] = []
        todo = [sample]
        while todo:  # depth first, so that neighbours in the tree are neighbours in the list of leaves
            part = todo.pop()
            if len(part) > leaf:
                ways = min(64 if len(part) > 64 * leaf else 8, -(-len(part) // leaf) + 1)
                label = split(part, ways, rng)
                parts = [part[label == k] for k in np.unique(label)]
                if len(parts) > 1:
                    todo.extend(parts)
                    continue
            leaves.append(part)
        cents = np.stack([p.mean(axis=0) for p in leaves])
        self.cents = (cents / np.maximum(np.linalg.norm(cents, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        k = len(self.cents)
        groups = int(min(k, max(16, n / GROUP)))
        self.group = (np.cumsum([len(p) for p in leaves]) * groups // (len(sample) + 1)).astype(np.int32)
        deg = min(24, k)
        self.links = np.empty((k, deg), dtype=np.int32)
        step = max(16, REMEMBERED // k)
        for lo in range(0, k, step):
            self.links[lo : lo + step] = np.argsort(-(self.cents[lo : lo + step] @ self.cents.T), axis=1)[:, :deg]
        self.entries = np.unique(np.linspace(0, k - 1, min(k, max(64, int(4 * k**0.5)))).astype(np.int64))

    def near(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) nearest to each row of x: a greedy search through the graph from evenly spread entries, all rows at once."""
        n = len(self.cents)
        beam = min(beam, n)
        if n <= WALK:
            sims = x @ self.cents.T
            best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            own = np.take_along_axis(sims, best, axis=1)
            order = np.argsort(-own, axis=1, kind="stable")
            return np.take_along_axis(best, order, axis=1), np.maximum(2 - 2 * np.take_along_axis(own, order, axis=1), 0)
        entry = x @ self.cents[self.entries].T
        first = min(beam, len(self.entries))
        best = self.entries[np.argsort(-entry, axis=1)[:, :first]]
        sims = np.full((len(x), n), -9.0, dtype=np.float32)  # what each row has visited; n is bounded by the sample
        rows = np.arange(len(x))[:, None]
        sims[rows, self.entries[None, :]] = entry
        for _ in range(4):
            front = self.links[best].reshape(len(x), -1)
            new = sims[rows, front] < -8
            if not new.any():
                break
            for lo in range(0, len(x), 256):  # bounds the gathered centroids
                f = front[lo : lo + 256]
                got = np.einsum("bd,bfd->bf", x[lo : lo + 256], self.cents[f], optimize=False) if f.shape[1] * 4 < n else np.take_along_axis(x[lo : lo + 256] @ self.cents.T, f, axis=1)
                np.put_along_axis(sims[lo : lo + 256], f, got, axis=1)
            part = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            if (np.sort(part, axis=1) == np.sort(best, axis=1)).all() if best.shape == part.shape else False:
                break
            best = part
        order = np.argsort(-np.take_along_axis(sims, best, axis=1), axis=1)
        best = np.take_along_axis(best, order, axis=1)
        return best, np.maximum(2 - 2 * np.take_along_axis(sims, best, axis=1), 0)


def pack(x: np.ndarray) -> bytes:
    """The numbers in 16 bits where that loses nothing, else in 32."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    return half.tobytes() if np.array_equal(half.astype(np.float32), x) else x.tobytes()


def units_of(packed, dim: int) -> np.ndarray:
    """Unit vectors of packed ones, a row each."""
    out = np.empty((len(packed), dim), dtype=np.float32)
    short = np.fromiter((len(v) == 2 * dim for v in packed), dtype=bool, count=len(packed))
    for kind, rows in ((np.float16, np.flatnonzero(short)), (np.float32, np.flatnonzero(~short))):
        if len(rows):
            out[rows] = np.frombuffer(b"".join(packed[i] for i in rows), dtype=kind).reshape(len(rows), dim)
    top = np.abs(out).max(axis=1, keepdims=True)  # first, so that no square is too large or small
    out /= np.maximum(top, np.finfo(np.float32).tiny)
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


def _column(table, name: str, kind: pa.DataType) -> pa.Array:
    """A column in one piece."""
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.cast(kind)


def _pairs(lists: pa.ListArray) -> dict[int, np.ndarray]:
    """Of each list, the rows that name it."""
    row, name = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    order = np.argsort(name, kind="stable")
    names, starts = np.unique(name[order], return_index=True)
    return dict(zip(names.tolist(), np.split(row[order], starts[1:])))


def _unit(frames, dim: int):
    for pdf in frames:
        rows = [(h, np.asarray(v, dtype=np.float32)) for h, v in zip(pdf["hash"], pdf["vec"]) if v is not None and len(v) == dim]
        rows = [(h, v) for h, v in rows if np.isfinite(v).all() and v.any()]
        packed = [pack(v) for _, v in rows]
        entries = [blake2b((u + np.float32(0)).tobytes(), digest_size=12).digest() for u in units_of(packed, dim).round(6)]
        yield pd.DataFrame({"hash": [h for h, _ in rows], "vec": packed, "entry": entries})


def _runs(values: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Of each run of values that begins at starts, those to be kept."""
    ends = np.cumsum(np.add.reduceat(keep.astype(np.int64), starts))
    return pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(values[keep], pa.int32()))


def _place(batches, index: Index, dim: int):
    """(entry, vec, grp, lists, probes) per group of lists that the vector is in or that its search visits; probes -1 is all of a group's lists. A vector may visit any number of groups, so rows leave in batches of PLACED."""
    sizes = np.bincount(index.group)
    slack = 0.02  # so that vectors on a centroid still look around
    for batch in batches:
        entries, packed = batch.column("entry").cast(pa.binary()), batch.column("vec").cast(pa.binary())
        step = max(16, REMEMBERED // len(index.cents))
        for lo in range(0, len(packed), step):
            part = units_of(packed.slice(lo, step).to_pylist(), dim)
            best, d = index.near(part, PROBES)
            limit = (d[:, :1] + slack) * RATIO**2
            place = np.arange(best.shape[1])
            probe = (d <= limit) | (place < PROBES_LEAST)
            member = (d <= (d[:, :1] + slack) * CLOSURE**2) & (place < REPLICAS)
            row, at = np.nonzero(probe)
            cent, own = best[row, at], member[row, at]
            wide = np.flatnonzero((d[:, -1] <= limit[:, 0]) & (best.shape[1] < len(index.cents)))
            if len(wide):  # the graph's beam ended within the ratio: all centroids are compared
                far = np.maximum(2 - 2 * part[wide] @ index.cents.T, 0)
                far[np.arange(len(wide))[:, None], best[wide]] = 9  # those of the beam are there already
                more_row, more = np.nonzero(far <= limit[wide])
                row, cent, own = np.concatenate((row, wide[more_row])), np.concatenate((cent, more)), np.concatenate((own, np.zeros(len(more), dtype=bool)))
            grp = index.group[cent]
            order = np.lexsort((grp, row))
            row, cent, own, grp = row[order], cent[order].astype(np.int32), own[order], grp[order]
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(grp) != 0))))
            count = np.diff(np.concatenate((starts, [len(row)])))
            whole = np.repeat(count == sizes[grp[starts]], count)
            first = np.zeros(len(row), dtype=bool)
            first[starts] = True
            vector, group = pa.array(lo + row[starts]), pa.array(grp[starts], pa.int32())
            lists, probes = _runs(cent, own, starts), _runs(np.where(whole, -1, cent), first | ~whole, starts)
            for at in range(0, len(starts), PLACED):
                who = vector.slice(at, PLACED)
                yield pa.RecordBatch.from_arrays([entries.take(who), packed.take(who), group.slice(at, PLACED), lists.slice(at, PLACED), probes.slice(at, PLACED)], ["entry", "vec", "grp", "lists", "probes"])


def _search(table: pa.Table, k: int, dim: int) -> pa.Table:
    """Best k per query among the members of one block of a group."""
    # Arrow, as frames of objects would stay until Python collects its garbage
    lists, asks = _column(table, "lists", pa.list_(pa.int32())), np.flatnonzero(_column(table, "asks", pa.bool_()).to_numpy(zero_copy_only=False))
    belongs = np.flatnonzero(lists.value_lengths().to_numpy() > 0)
    packed, entries = _column(table, "vec", pa.binary()), _column(table, "entry", pa.binary())
    if not len(belongs) or not len(asks):
        return pa.table({"entry": entries[:0], "other": entries[:0], "sim": pa.array([], pa.float32())})
    m, q = units_of(packed.take(pa.array(belongs)).to_pylist(), dim), units_of(packed.take(pa.array(asks)).to_pylist(), dim)
    in_list = _pairs(lists.take(pa.array(belongs)))
    in_list[-1] = np.arange(len(m))
    best = np.full((len(q), k + 1), -9.0, dtype=np.float32)
    who = np.full((len(q), k + 1), -1, dtype=np.int64)
    for x, qi in _pairs(_column(table, "probes", pa.list_(pa.int32())).take(pa.array(asks))).items():
        mi = in_list.get(x)
        if mi is None:
            continue
        step = min(4096, max(64, REMEMBERED // len(mi)))  # bounds the products held at once
        for lo in range(0, len(qi), step):
            rows = qi[lo : lo + step]
            sims = q[rows] @ m[mi].T
            kk = min(k + 1, len(mi))
            top = np.argpartition(-sims, kk - 1, axis=1)[:, :kk]
            s = np.take_along_axis(sims, top, axis=1)
            w = mi[top]
            s = np.concatenate((best[rows], s), axis=1)
            w = np.concatenate((who[rows], w), axis=1)
            order = np.lexsort((-s, w), axis=1)  # the same member comes from several lists
            w, s = np.take_along_axis(w, order, axis=1), np.take_along_axis(s, order, axis=1)
            s[:, 1:][w[:, 1:] == w[:, :-1]] = -9.0
            order = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            best[rows], who[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(w, order, axis=1)
    r, c = np.nonzero((who >= 0) & (best > -8))
    a, b = asks[r], belongs[who[r, c]]
    keep = a != b  # an entry has one row
    return pa.table({"entry": entries.take(pa.array(a[keep])), "other": entries.take(pa.array(b[keep])), "sim": pa.array(best[r, c][keep], pa.float32())})


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(hash, vec, entry): packed vectors, one per hash; vectors that are equal to six decimals once they are of length one have the same entry."""
    src = spread(vectors.select("hash", "vec").filter(F.col("hash").isNotNull() & (F.size("vec") == dim)))
    units = src.mapInPandas(lambda f: _unit(f, dim), "hash string, vec binary, entry binary")
    return units.groupBy("hash").agg(F.min(F.struct("entry", "vec")).alias("u")).select("hash", "u.vec", "u.entry")


def sampled(entries: DataFrame, n: int, most: int) -> DataFrame:
    """The vectors of the least hashes, `most` of n. Each task sends as many to the driver as are asked for, so the others are left out before."""
    place, share = F.xxhash64("entry"), (most + 10 * most**0.5) / n
    few = entries.filter(place < int(2**64 * share) - 2**63) if share < 1 else entries
    if share < 1 and few.count() < most:  # ten deviations too few
        few = entries
    return few.orderBy(place).limit(most).select("vec")


def nearest(vectors: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """(hash, other, sim, place): the k most similar others of every usable vector."""
    units = materialize(usable(vectors, dim), "units")
    spark = units.sparkSession
    entries = materialize(units.groupBy("entry").agg(F.min("vec").alias("vec")), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "hash string, other string, sim float, place int")
    sample = units_of([bytes(r[0]) for r in sampled(entries, n, min(SAMPLE, max(SAMPLE_LEAST, n // 4))).collect()], dim)
    index = spark.sparkContext.broadcast(Index(sample, n))
    placed = materialize(scatter(entries, "entry").mapInArrow(lambda f: _place(f, index.value, dim), "entry binary, vec binary, grp int, lists array<int>, probes array<int>"), "posting-lists")
    counts = placed.groupBy("grp").agg(F.ceil(F.count_if(F.size("lists") > 0) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    rows = placed.join(F.broadcast(counts.filter("blocks > 0")), "grp")  # a row per group, of which there are at most as many as centroids
    own, turn = (F.pmod(F.xxhash64("entry"), F.col(c)).cast("int") for c in ("blocks", "parts"))
    rows = rows.withColumn("own", own).withColumn("turn", turn).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a query asks every block of a group, and members of a block are asked by every part of the queries
    none = F.array().cast("array<int>")
    rows = rows.withColumn("lists", F.when(F.col("own") == F.col("block"), F.col("lists")).otherwise(none))
    part = rows.withColumn("part", F.explode(F.when(F.size("lists") > 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("turn"))))
    part = part.withColumn("asks", F.col("part") == F.col("turn")).select("grp", "block", "part", "entry", "vec", "lists", F.when(F.col("asks"), F.col("probes")).otherwise(none).alias("probes"), "asks")
    found = part.groupBy("grp", "block", "part").applyInArrow(lambda table: _search(table, k, dim), "entry binary, other binary, sim float")
    best = W.partitionBy("entry").orderBy(F.desc("sim"), "other")
    found = found.groupBy("entry", "other").agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")
    # hashes of equal vectors: at most k + 1 of each entry are ever needed as others, found in two steps so that no task sorts them all
    names = units.select("entry", "hash").withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(32)))
    some = names.withColumn("r", F.row_number().over(W.partitionBy("entry", "salt").orderBy("hash"))).filter(F.col("r") <= k + 1)
    some = some.withColumn("r", F.row_number().over(W.partitionBy("entry").orderBy("hash"))).filter(F.col("r") <= k + 1).select("entry", F.col("hash").alias("other_hash"))
    others = found.join(some.withColumnRenamed("entry", "other"), "other").select("entry", F.struct((-F.col("sim")).alias("far"), F.col("other_hash").alias("hash")).alias("o"))
    equal = some.select("entry", F.struct(F.lit(-2.0).cast("float").alias("far"), F.col("other_hash").alias("hash")).alias("o"))
    lists = others.unionByName(equal).groupBy("entry").agg(F.slice(F.sort_array(F.collect_list("o")), 1, 2 * k + 2).alias("all"))
    out = units.select("hash", "entry").join(lists, "entry").select("hash", F.slice(F.filter("all", lambda o: o["hash"] != F.col("hash")), 1, k).alias("near"))
    return out.select("hash", F.posexplode("near").alias("place", "o")).select("hash", F.col("o.hash").alias("other"), F.least(F.lit(1.0).cast("float"), -F.col("o.far")).alias("sim"), (F.col("place") + 1).alias("place"))


def pairs(vectors: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """(hash_a, hash_b), hash_a < hash_b, where one is among the k most similar of the other."""
    return nearest(vectors, k, dim).select(F.least("hash", "other").alias("hash_a"), F.greatest("hash", "other").alias("hash_b")).distinct()
