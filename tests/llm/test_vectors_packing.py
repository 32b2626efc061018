"""Nearest vectors and containers."""

import numpy as np
import pandas as pd

from fernweh.llm import neighbours as N
from fernweh.llm import packing as P


def frame(spark, vecs, hashes=None):
    rows = [(hashes[i] if hashes else f"{i:032x}", v, "g", i) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "hash string, vec array<float>, grp string, entry int")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 128))
    x = (centres[rng.integers(0, 40, 3000)] + 0.8 * rng.normal(size=(3000, 128))).astype(np.float32)
    got = {}
    for r in N.nearest(frame(spark, [[float(a) for a in v] for v in x])).collect():
        got.setdefault(int(r.hash, 16), set()).add(int(r.other, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1)[:, :5]
    recall = sum(len(got[i] & set(top[i].tolist())) for i in range(len(x))) / (5 * len(x))
    assert recall > 0.95 and all(len(v) == 5 for v in got.values())


def test_recall_in_one_dense_cluster(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 128))
    dense, n = 5000, 15_000
    one = rng.normal(size=128)
    x = np.concatenate((one + 0.22 * rng.normal(size=(dense, 128)), centres[rng.integers(0, 40, n - dense)] + 0.8 * rng.normal(size=(n - dense, 128)))).astype(np.float32)
    pdf = N.nearest(frame(spark, x.tolist())).toPandas()
    got = pdf[pdf.hash < f"{dense:032x}"].groupby("hash").other.agg(set)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:dense] @ u.T
    s[np.arange(dense), np.arange(dense)] = -9
    top = np.argpartition(-s, 4, axis=1)[:, :5]
    recall = sum(len(got[f"{i:032x}"] & {f"{j:032x}" for j in top[i]}) for i in range(dense)) / (5 * dense)
    print("recall in the dense cluster", recall)
    assert recall > 0.99


def test_defined_cases(spark):
    e = lambda k: [1.0 if i == k else 0.0 for i in range(128)]
    vecs = [e(0), e(0), [2 * a for a in e(0)], e(1), None, e(2)[:100], [0.0] * 128, [float("nan")] * 128, e(0)]
    names = ["a", "b", "c", "d", "e", "f", "g", "h", "a"]
    got = set(map(tuple, N.pairs(frame(spark, vecs, names)).collect()))
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    assert N.pairs(frame(spark, vecs, names).limit(0)).count() == 0
    one = N.nearest(frame(spark, [e(0)], ["a"]))
    assert one.count() == 0


def test_a_vector_that_most_rows_share(spark, monkeypatch):
    rng = np.random.default_rng(2)
    same = [float(a) for a in rng.normal(size=128)]
    rest = [[float(a) for a in rng.normal(size=128)] for _ in range(60)]
    got = N.nearest(frame(spark, [same] * 120 + rest)).toPandas()
    hot = got[got.hash == f"{50:032x}"].sort_values("place")
    assert hot.other.tolist() == [f"{i:032x}" for i in range(5)] and (hot.sim > 0.999).all()
    assert got.groupby("hash").size().eq(5).all()
    monkeypatch.setattr(N, "BLOCK", 20)  # cut groups into blocks: nothing changes
    again = N.nearest(frame(spark, [same] * 120 + rest)).toPandas()
    key = ["hash", "place"]
    assert again.sort_values(key).other.tolist() == got.sort_values(key).other.tolist()


def test_vectors_that_visit_many_groups_come_in_bounded_pieces(spark, monkeypatch, tmp_path):
    place, search = N._place, N._search

    def note(name, rows):
        with open(f"{tmp_path}/{name}", "a") as out:
            out.write(f"{len(rows)}\n")
        return rows

    def noted_place(frames, index, dim):
        for rows in place(frames, index, dim):
            yield note("place", rows)

    def noted_search(rows, k, dim):
        return search(note("search", rows), k, dim)

    monkeypatch.setattr(N, "_place", noted_place)
    monkeypatch.setattr(N, "_search", noted_search)
    monkeypatch.setattr(N, "GROUP", 40)
    rng = np.random.default_rng(7)
    vectors = frame(spark, rng.normal(size=(4000, 128)).astype(np.float32).tolist())
    whole = set(map(tuple, N.nearest(vectors).select("hash", "other", "place").collect()))
    placed, searched = ([int(n) for n in (tmp_path / name).read_text().split()] for name in ("place", "search"))
    assert sum(placed) > 20 * 4000 and max(placed) <= 8192
    (tmp_path / "search").unlink()
    for name in ("BLOCK", "ASKED"):
        monkeypatch.setattr(N, name, 300)
    assert set(map(tuple, N.nearest(vectors).select("hash", "other", "place").collect())) == whole and len(whole) == 5 * 4000
    parts = [int(n) for n in (tmp_path / "search").read_text().split()]
    assert max(searched) > 2 * (300 + 300) > max(parts)


def test_the_driver_gets_little_more_than_the_sample(spark):
    vectors = frame(spark, np.random.default_rng(8).normal(size=(40_000, 16)).astype(np.float32).tolist())
    conf = spark.sparkContext._jsc.sc().conf()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf.set("spark.driver.maxResultSize", "2m")  # a sample of 10,000 is about 1 MB
    try:
        N.nearest(vectors, dim=16)
    finally:
        conf.remove("spark.driver.maxResultSize")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packing_is_valid_and_tight():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 1500, 3000).tolist()
    bins = P.pack(size)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    fills = [sum(size[i] for i in b) for b in bins]
    assert max(fills) <= P.CAPACITY and len(bins) <= -(-sum(size) // P.CAPACITY) * 1.01 + 1


def test_local_search_gains_on_a_bad_start():
    size = [1000, 1040, 1048, 1008, 900, 1148, 10, 38]
    bad = [[0, 3], [1], [2], [4], [5], [6], [7]]
    out = P.improve(bad, size, 2048)
    square = lambda bins: sum(sum(size[i] for i in b) ** 2 for b in bins)
    assert square(out) > square(bad) and len(out) < len(bad) and sorted(i for b in out for i in b) == list(range(8))
    assert max(sum(size[i] for i in b) for b in out) <= 2048


def test_tokenizer_pattern_is_the_public_one():
    tiktoken = __import__("tiktoken")
    public = __import__("public_tokenizers")
    own = P.coder()
    other = tiktoken.Encoding("other", pat_str=public.PATTERN, mergeable_ranks=own._mergeable_ranks, special_tokens={})
    for t in ["It's  a\n\n  test 12ab ", "naïve 字字  \t x'll", "   ", "a\r\nb  "]:
        assert own.encode_ordinary(t) == other.encode_ordinary(t)


def test_containers(spark):
    texts = [(i, "some words here " * (1 + i % 90)) for i in range(400)] + [(900, None), (901, ""), (902, "long text " * 3000), (5, "again " * 7), (903, "\ud83d\ude00")]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in texts], "doc_id long, text string, container string, fill int")
    c = P.containers(df).toPandas()
    g = c.groupby("container").agg(t=("tokens", "sum"), f=("fill", "first"))
    assert (g.t == g.f).all() and g.t.max() <= P.CAPACITY
    whole = c[c.doc_id == 902]
    assert whole.tokens.sum() == len(P.coder().encode_ordinary("long text " * 3000)) and sorted(whole.start_token) == [k * P.CAPACITY for k in range(len(whole))]
    split = c.groupby("doc_id").piece.max()
    assert (split[split.index != 902] == 0).all() and not {900, 901} & set(c.doc_id)
    assert (c.doc_id == 5).sum() == 2
    assert len(g) <= -(-c.tokens.sum() // P.CAPACITY) + 2
    assert P.containers(df.limit(0)).count() == 0
    assert isinstance(c, pd.DataFrame)


def test_walking_the_graph_finds_the_nearest_centroids(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = N.Index(x, 4000)
    want = index.near(x[:300], 8)[0]
    monkeypatch.setattr(N, "WALK", 1)
    got = index.near(x[:300], 24)[0]
    assert sum(len(set(a) & set(b)) for a, b in zip(got.tolist(), want.tolist())) / want.size > 0.95


def test_packed_vectors_lose_nothing():
    rng = np.random.default_rng(6)
    half, full = rng.standard_normal(16).astype(np.float16).astype(np.float32), rng.standard_normal(16).astype(np.float32)
    rows = [half, full, full * np.float32(1e30), full * np.float32(1e-30)]
    packed = [N.pack(v) for v in rows]
    assert [len(v) for v in packed] == [32, 64, 64, 64]
    got = N.units_of(packed, 16)
    assert np.allclose(got[1], got[2], atol=1e-6) and np.allclose(got[1], got[3], atol=1e-6) and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-6)
    assert np.allclose(got[0], half / np.linalg.norm(half), atol=1e-6)
