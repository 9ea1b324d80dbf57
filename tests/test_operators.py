"""Operators on small tables with known answers, and against brute force."""

import math
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from darkslide import catalog
from darkslide.functions import measures
from darkslide.operators import blocks, cull, duplicates, fingerprints, graph, identity, ranking, skew, timeline, vectors
from darkslide.operators.sums import vector_sums
from darkslide.plans import fixtures
from darkslide.plans.session import child_names
from darkslide.sources import bucketed
from darkslide.sources import catalog_sink as K
from darkslide.sources import catalog_source as S
from darkslide.streaming import jobs
from tests.conftest import SMALL


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: top(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


TWO = [(0, [1.0, 0.0]), (1, [0.99, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 0.99])]


@pytest.mark.parametrize("how", [vectors.dbscan, vectors.average_linkage])
def test_two_clusters(spark, how):
    df = spark.createDataFrame(TWO, "id long, v array<double>")
    args = (0.1, 2) if how is vectors.dbscan else (0.1,)
    assert pairs(how(df, "id", "v", *args), "id", "cluster") == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_dbscan_noise_zero_and_single(spark):
    df = spark.createDataFrame([*TWO[:2], (7, [-1.0, 0.0]), (8, [0.0, 0.0]), (9, [0.0, 0.0])], "id long, v array<double>")
    assert pairs(vectors.dbscan(df, "id", "v", 0.1, 2), "id", "cluster") == [(0, 0), (1, 0), (7, -1), (8, -1), (9, -1)]
    assert pairs(vectors.dbscan(df.where("id = 8"), "id", "v"), "id", "cluster") == [(8, 0)]


def test_average_linkage_equals_plain_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - n @ n.T
    sets = [[i] for i in range(40)]
    while len(sets) > 1:
        d, i, j = min((far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
        if d > 0.25:
            break
        sets[i] += sets.pop(j)
    want = {x: k for k, s in enumerate(sorted(sets, key=min)) for x in s}
    assert {r.id: r.cluster for r in vectors.average_linkage(df, "id", "v", 0.25).collect()} == want


@pytest.mark.parametrize("rows", [1, 20, 4000])
def test_average_linkage_of_a_component_over_the_rows_of_a_task(spark, monkeypatch, rows):
    monkeypatch.setattr(vectors, "LINKAGE_ROWS", rows)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 3)) + [1.5, 0, 0]
    x[60:68], x[68:] = x[:8] * 2, 0  # copies and zero vectors
    n = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    far = 1 - n @ n.T
    sets = [[i] for i in range(70)]
    while len(sets) > 1:
        d, i, j = min((far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
        if d > 0.3:
            break
        sets[i] += sets.pop(j)
    want = {x: k for k, s in enumerate(sorted(sets, key=min)) for x in s}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert {r.id: r.cluster for r in vectors.average_linkage(df, "id", "v", 0.3).collect()} == want
    assert max(map(len, sets)) > 20 and vectors.average_linkage(df.limit(0), "id", "v").count() == 0


def test_blocks_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "id long, v array<double>")
    whole = pairs(vectors.similar_pairs(df, "id", "v", 0.3), "i", "j")
    found = pairs(vectors.search(df, df, "id", "v", 0.3), "query", "candidate")
    monkeypatch.setattr(blocks, "BLOCK", 9)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 3)
    monkeypatch.setattr(blocks, "RANGES", 4)
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 5)
    assert pairs(vectors.similar_pairs(df, "id", "v", 0.3), "i", "j") == whole
    assert pairs(vectors.search(df, df, "id", "v", 0.3), "query", "candidate") == found


def clouds(n, seed=0, dims=16, groups=12, spread=0.05):
    """Vectors around a few directions, a few that are zero or repeated."""
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(groups, dims))
    v = mid[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * spread * rng.choice([0.5, 1, 6], n)[:, None]
    v[::97] = 0
    v[1::50] = v[2]
    return v


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)


@pytest.mark.parametrize("least", [0.95, 0.4, 0.0, -0.5])
def test_blocks_by_pivots_lose_no_pair(spark, monkeypatch, least):
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 10)
    v = clouds(400)
    sims = unit(v) @ unit(v).T
    assert np.abs(sims - least).min() > 1e-12 or least == 0
    want = [(i, j) for i in range(400) for j in range(i + 1, 400) if sims[i, j] >= least - 1e-12]
    assert pairs(vectors.similar_pairs(frame(spark, v), "id", "v", least), "i", "j") == want


def test_blocks_far_apart_never_meet(spark, monkeypatch):
    df = frame(spark, clouds(6000, groups=30, spread=0.02))
    put = blocks.put_in_blocks(df, "id", "v", blocks.choose_pivots(df, "id", "v"))
    assert put.rows.count() == 6000 and put.rows.groupBy("b").count().count() == put.count
    share = blocks.skipped(put, blocks.pairs_within(put, 0.9))
    assert share > 0.5
    assert blocks.skipped(put, blocks.pairs_within(put, 0.0)) == 0


def test_more_queries_than_are_broadcast(spark):
    v = clouds(11_000, groups=40, spread=0.03)
    df = frame(spark, v)
    found = vectors.search(df, df, "id", "v", 0.97)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    u = unit(v)
    want = sum(int((u[a : a + 1000] @ u.T >= 0.97).sum()) for a in range(0, len(u), 1000))
    assert abs(found.count() - want) <= 2  # sums of products in another order


def test_nearest_of_more_centers_than_are_broadcast(spark, monkeypatch):
    v, c = clouds(900, seed=4), clouds(120, seed=5, groups=25)
    c[7] = c[90]  # a tie: the least number
    df, centers = frame(spark, v), frame(spark, c).toDF("c", "centroid")
    few = pairs(vectors.nearest(df, "id", "v", centers, "c", 0.5), "id", "cluster", "sim")
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(blocks, "BLOCK", 30)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 10)
    many = vectors.nearest(df, "id", "v", centers, "c", 0.5)
    assert pairs(many, "id", "cluster", "sim") == few and len(few) == 900


@pytest.mark.parametrize(("eps", "min_samples"), [(0.02, 3), (0.3, 2), (0.005, 5)])
def test_dbscan_over_blocks_equals_plain(spark, monkeypatch, eps, min_samples):
    monkeypatch.setattr(blocks, "BLOCK", 50)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 10)
    v = clouds(350, seed=9)
    hit = unit(v) @ unit(v).T >= 1 - eps - 1e-12
    np.fill_diagonal(hit, False)
    core = hit.sum(1) + (np.abs(v).sum(1) > 0) >= min_samples
    root = np.where(core, np.arange(len(v)), -1)
    while True:
        near = np.where(hit & core[None] & core[:, None], root[None], len(v)).min(1)
        new = np.where(core, np.minimum(root, near), -1)
        if (new == root).all():
            break
        root = new
    number = {r: i for i, r in enumerate(sorted(set(root[core])))}
    want = [number[root[i]] if core[i] else min((number[root[j]] for j in np.flatnonzero(hit[i] & core)), default=-1) for i in range(len(v))]
    assert pairs(vectors.dbscan(frame(spark, v), "id", "v", eps, min_samples), "id", "cluster") == list(enumerate(want))


def test_stars_of_dense_blocks():
    rng = np.random.default_rng(3)
    for same in (True, False):
        hit = rng.random((40, 40 if same else 30)) < 0.03
        hit = hit | hit.T if same else hit
        roots, members = blocks.stars(hit, same)
        n = 40 if same else 70
        label = np.arange(n)
        for r, m in zip(roots, members, strict=True):
            label[m] = r
        edges = [(i, j if same else 40 + j) for i, j in zip(*np.nonzero(hit), strict=True)]
        assert all(label[i] == label[j] for i, j in edges)
        assert len(roots) < n and len(set(members)) == len(members)


def test_search_order_and_threshold(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.707, 0.707]), (2, [0.0, 1.0])], "id long, v array<double>")
    got = vectors.search(df.where("id = 0"), df, "id", "v", 0.7).orderBy(F.desc("sim"), "candidate").collect()
    assert [r.candidate for r in got] == [0, 1]


def test_online_assignment(spark):
    df = spark.createDataFrame([(10, [1.0, 0.02]), (11, [0.0, 1.0]), (12, [0.01, 1.0]), (13, [-1.0, 0.0])], "id long, v array<double>")
    centers = spark.createDataFrame([(5, [1.0, 0.0])], "c long, centroid array<double>")
    assert pairs(vectors.assign(df, "id", "v", centers, "c"), "id", "cluster", "is_new") == [(10, 5, False), (11, 6, True), (12, 6, True), (13, 7, True)]


def test_packed_vectors(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, None)], "id long, v array<float>")
    back = vectors.unpack_vectors(vectors.pack_vectors(df, "v"), "packed")
    assert pairs(back.where("id = 1"), "vec") == [([1.5, -2.0],)] and back.where("id = 2").first()["vec"] is None


@pytest.mark.parametrize("cells", [8, 64])
def test_meetings_copy_a_row_once_for_each_group(spark, monkeypatch, cells):
    monkeypatch.setattr(blocks, "BLOCK", 800 // cells)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 1)
    rng = np.random.default_rng(cells)
    put = blocks.put_in_blocks(frame(spark, rng.normal(size=(800, 6))), "id", "v", np.zeros((0, 0)))
    pairs = blocks.pairs_within(put, -1.0)
    groups = -(-put.count // blocks.group_width(put.count, spark.sparkContext.defaultParallelism))
    copies = blocks.meet(put, pairs, lambda x, y, met: iter([pd.DataFrame({"rows": [sum(map(len, x.values()))], "met": [len(met)]})]), "rows long, met long").toPandas()
    assert put.count >= cells and groups <= max(1, math.isqrt(8 * spark.sparkContext.defaultParallelism))
    assert copies["met"].sum() == put.count * (put.count + 1) // 2 and copies["rows"].sum() == 800 * groups
    other = blocks.meet_others(put, put, pairs, lambda x, y, met: iter([pd.DataFrame({"rows": [sum(map(len, [*x.values(), *y.values()]))]})]), "rows long").toPandas()
    assert other["rows"].sum() <= 800 * (groups + 1)


@pytest.mark.parametrize("group", [20, 200])
def test_groups_of_any_size_give_the_same(spark, monkeypatch, group):
    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 10)
    monkeypatch.setattr(blocks, "GROUP", group)
    v = clouds(160, seed=5)
    u = unit(v)
    got = vectors.similarity_matrix(frame(spark, v), "id", "v").toPandas()
    made = np.full((160, 160), np.nan)
    made[got["i"], got["j"]] = got["sim"]
    assert len(got) == 160**2 and np.abs(made - u @ u.T).max() < 1e-9


@pytest.mark.parametrize("group", [20, 200])
def test_groups_of_any_size_give_the_same_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 10)
    monkeypatch.setattr(blocks, "GROUP", group)
    got = vectors.similar_pairs(frame(spark, clouds(160, seed=5)), "id", "v", -2.0)
    assert pairs(got, "i", "j") == [(i, j) for i in range(160) for j in range(i + 1, 160)]


@pytest.mark.parametrize("cells", [7, 1 << 18])
def test_matrix_copies_no_row(spark, monkeypatch, cells):
    monkeypatch.setattr(blocks, "BLOCK", 30)
    monkeypatch.setattr(blocks, "CELLS", cells)
    written, keep = [], blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    v = clouds(400, seed=3)
    u = unit(v)
    got = vectors.similarity_matrix(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<float>"), "id", "v")
    assert "Exchange" not in plan_of(got)  # what is written beforehand is all that is moved
    sizes = [r.n for t in written for r in t.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) <= 30 and len(sizes) < 30
    assert got.dtypes == [("i", "bigint"), ("j", "bigint"), ("sim", "double")]
    rows = got.toPandas()
    made = np.full((400, 400), np.nan)
    made[rows["i"], rows["j"]] = rows["sim"]
    assert len(rows) == 400**2 and np.abs(made - u @ u.T).max() < 1e-5
    assert (made == made.T).all() and made[0, 0] == 0 and made[3, 3] == 1


def test_matrix_of_odd_rows(spark):
    rows = [(1, [3.0, 4.0]), (1, [4.0, 3.0]), (2, [0.0, 0.0]), (None, [-3.0, -4.0])]
    got = vectors.similarity_matrix(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").withColumn("sim", F.round("sim", 6)).toPandas()
    want = [(i, j, round(float(np.dot(x, y)) / 25, 6) + 0.0) for i, x in rows for j, y in rows]
    told = lambda t: sorted((-1 if i is None or i != i else int(i), -1 if j is None or j != j else int(j), s + 0.0) for i, j, s in t)
    assert told(got.itertuples(index=False)) == told(want)  # equal keys and a null one have their rows
    none = vectors.similarity_matrix(spark.createDataFrame([], "id long, v array<double>"), "id", "v")
    assert none.count() == 0


def test_matrix_is_rounded_as_by_spark_and_small_on_disk(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(-1, 1, 3000), (rng.integers(-(10**6), 10**6, 3000) + 0.5) / 1e6, [0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.0000000000000002, np.nan]])
    want = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x double").orderBy("k").select(F.round("x", 6)).toPandas().iloc[:, 0].to_numpy()
    got = blocks.rounded(x, 6)
    assert np.array_equal(got, want, equal_nan=True) and not np.signbit(got[got == 0]).any()
    v = rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    vectors.similarity_matrix(df, "id", "v", 3).write.parquet(str(tmp_path / "m"))
    made = pq.read_table(str(tmp_path / "m")).to_pandas()
    assert len(made) == 1500**2 and np.abs(made["sim"] - (unit(v) @ unit(v).T)[made["i"], made["j"]]).max() <= 0.0005 + 1e-9
    assert sum(os.path.getsize(tmp_path / "m" / f) for f in os.listdir(tmp_path / "m") if f.endswith(".parquet")) < 3.4 * len(made)


def test_nearest_clusters_by_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(12)
    v, n = rng.normal(size=(700, 5)), rng.integers(1, 4, 700)
    v[5] = v[6] * n[5] / n[6]
    df = spark.createDataFrame([(i, (x * 1.0).tolist(), int(k)) for i, (x, k) in enumerate(zip(v, n, strict=True))], "id long, v array<double>, n long")
    sims = v / n[:, None] @ (v / n[:, None]).T
    sims = np.maximum(sims, sims.T)
    np.fill_diagonal(sims, -np.inf)
    got = {r.id: r.other for r in vectors.nearest_clusters(df, 1.5).collect()}
    assert set(got) == set(np.flatnonzero(sims.max(1) >= 1.5 - 1e-12)) and all(sims[i, j] > sims[i].max() - 1e-9 for i, j in got.items())
    assert vectors.group_count(df) <= max(1, math.isqrt(8 * spark.sparkContext.defaultParallelism))  # however small a block is


def test_nearest_clusters_are_exact_and_move_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "group_count", lambda df, rows=None: 3)
    rng = np.random.default_rng(3)
    near = 0.9 + rng.permutation(199) * 1e-9  # 32-bit floats can't tell these similarities to the first row
    other = unit(np.hstack([np.zeros((199, 1)), rng.normal(size=(199, 7))]))
    v = np.vstack([np.eye(8)[:1], near[:, None] * np.eye(8)[0] + np.sqrt(1 - near**2)[:, None] * other])
    got = vectors.nearest_clusters(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "id long, v array<double>, n long"), 0.5)
    plan = plan_of(got)
    assert plan.count("Exchange hashpartitioning(id") == plan.count("Exchange") == 1  # a best for each task and cluster, not its vector for each group
    sims = v @ v.T
    np.fill_diagonal(sims, -1)
    found = {r.id: r.other for r in got.collect()}
    assert len(found) == 200 and found[0] == 1 + near.argmax() and all(sims[i, j] > sims[i].max() - 1e-12 for i, j in found.items())


def test_average_linkage_leaves_the_rest_to_one_task_after_a_round(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LINKAGE_ROWS", 10)
    monkeypatch.setattr(vectors, "MAX_ROUNDS", 1)
    v = clouds(150, seed=8)
    want = brute_linkage(v, 0.4)
    assert {r.id: r.cluster for r in vectors.average_linkage(frame(spark, v), "id", "v", 0.4).collect()} == want and 5 < max(want.values()) < 140


@pytest.mark.parametrize("edges", [0, 1 << 22])
def test_rounds_of_merges_with_and_without_known_pairs(monkeypatch, edges):
    monkeypatch.setattr(vectors, "EDGES", edges)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    v = clouds(150, seed=9)
    order = np.random.default_rng(1).permutation(150)
    made, left = vectors._merge_in_rounds(order, unit(v)[order], np.ones(150, int), 0.6, 1)
    top = np.arange(150)
    for keep, gone in np.concatenate(made, 1).T:
        assert keep < gone
        top[top == top[gone]] = top[keep]
    want = brute_linkage(v, 0.4)
    assert len(left[0]) <= 1 and (np.unique(top, return_inverse=True)[1] == [want[i] for i in range(150)]).all()


def brute_linkage(v, most):
    far = 1 - unit(v) @ unit(v).T
    sets = [[i] for i in range(len(v))]
    mean = lambda a, b: far[np.ix_(a, b)].mean()
    d = np.array([[mean(a, b) if i < j else np.inf for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    while d.min() <= most:
        i, j = np.unravel_index(d.argmin(), d.shape)
        sets[i] += sets[j]
        sets[j], d[j], d[:, j] = [], np.inf, np.inf
        for k in range(len(sets)):
            if sets[k] and k != i:
                d[min(i, k), max(i, k)] = mean(sets[i], sets[k])
    return {x: k for k, s in enumerate(sorted((s for s in sets if s), key=min)) for x in s}


def test_joined_labels_are_the_least_nodes(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, (2, 220))
    got = blocks.joined_labels(blocks.joined_labels(np.arange(300), a[:90], b[:90]), a[90:], b[90:])
    want = np.arange(300)
    for _ in range(300):
        for x, y in zip(a, b, strict=True):
            want[[x, y]] = min(want[x], want[y])
    assert (got == want).all()


def test_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 12)]
    rows = []
    for i in range(150):
        v = base[i % 12] & (2**64 - 1)
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            v ^= 1 << int(b)
        rows.append((i, v - 2**64 if v >= 2**63 else v))
    got = pairs(duplicates.band_edges(spark.createDataFrame(rows, "id long, fp long"), "id", "fp", 7), "src", "dst")
    least = {}
    for i, v in rows:
        least.setdefault(v, i)
    want = sorted((min(a, b), max(a, b)) for v, a in least.items() for w, b in least.items() if a < b and ((v ^ w) & (2**64 - 1)).bit_count() <= 7)
    assert got == want
    with pytest.raises(ValueError):
        duplicates.band_edges(spark.createDataFrame(rows, "id long, fp long"), "id", "fp", 8)


def test_burst_join_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.integers(0, 3000, 120))
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(t)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    want = sorted((i, j) for i in range(120) for j in range(120) if (t[j], j) > (t[i], i) and t[j] - t[i] <= 60)
    assert pairs(duplicates.burst_edges(df, "id", "ts", 60), "src", "dst") == want


def fingerprint_rows(rng, n, keep=2**64 - 1):
    """Random fingerprints, some of them a few bits from another; bits outside `keep` are 0."""
    values = [int(x) & keep for x in rng.integers(0, 2**63, n // 2)]
    for i in range(n - len(values)):
        v = values[i % len(values)]
        for b in rng.choice(64, int(rng.integers(0, 10)), replace=False):
            v ^= (1 << int(b)) & keep
        values.append(v)
    return [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]


@pytest.mark.parametrize(("most", "keep"), [(0, -1), (1, -1), (3, -1), (4, -1), (7, -1), (7, 0xFFFFFF0000FFFF), (3, 0xFFFF), (7, 0xFFF)])
def test_fingerprint_join_equals_brute_force(spark, monkeypatch, most, keep):
    monkeypatch.setattr(skew, "HOT", 20)
    rows = fingerprint_rows(np.random.default_rng(most), 400, keep & (2**64 - 1))
    df = spark.createDataFrame(rows, "id long, fp long").repartition(3)
    got = sorted(map(tuple, fingerprints.near_fingerprints(df, df, "fp", most, F.col("a_id") < F.col("b_id")).select("a_id", "b_id", "distance").collect()))
    far = lambda v, w: ((v ^ w) & (2**64 - 1)).bit_count()
    assert got == sorted((i, j, far(v, w)) for i, v in rows for j, w in rows if i < j and far(v, w) <= most)


@pytest.mark.parametrize(("most", "share"), [(7, 500), (3, 1_000_000)])
def test_fingerprint_join_meets_few_pairs(spark, most, share):
    n = 20_000
    df = spark.range(n).select("id", F.xxhash64("id").alias("fp"))
    met = fingerprints.candidates(df, df, "fp", most, F.col("a_id") < F.col("b_id")).count()
    assert met < n * n / 2 / share
    half = df.withColumn("fp", F.shiftleft("fp", 24))  # 24 bits are the same in all rows: the others are dealt to all parts
    assert fingerprints.candidates(half, half, "fp", 7, F.col("a_id") < F.col("b_id")).count() < n * n / 2 / 10


@pytest.mark.parametrize("most", [3, 7])
def test_fingerprint_join_broadcasts_no_exploded_side(spark, most):
    rows = spark.range(50).select("id", F.xxhash64("id").alias("fp"))
    plan = fingerprints.candidates(rows, rows, "fp", most)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_pairs_and_groups_broadcast_nothing(spark):
    hist = F.array(*(F.lit(x).cast("double") for x in (1, 2, 4)))
    rows = spark.range(20).select("id", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(1.0).alias("ratio"), F.lit(20).alias("saturation"), (F.col("id") % 5).alias("fp"), *(hist.alias(c) for c in ("hue", "sat", "value")), F.concat(F.lit("x"), F.col("id") % 3).alias("digest"))
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    plans = [plan_of(duplicates.agreeing(edges, rows, "id")), plan_of(duplicates.unknown_time_edges(rows.withColumn("ts", F.when(F.col("id") > 9, F.col("ts"))), "id", "ts")), plan_of(duplicates.groups(rows, "id", "digest", edges))]
    assert not [p for p in plans if "Broadcast" in p]


def test_rounds_of_components_broadcast_no_edges(spark, monkeypatch):
    plans, keep = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append(plan_of(df)) or keep(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    known = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}
    grown = graph.grown_components(known, edges.where("src < 4"), in_one_task=10)
    assert {r.component for r in grown.collect()} == {0} and plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_occlusion_reads_rows_of_faces(spark):
    got = catalog.QUERIES["p11_occlusion"](spark, SMALL)
    assert not [w for w in ("collect_list", "Window", "Join") if w in plan_of(got)]
    nested = fixtures.photos(spark, SMALL).where(F.size("faces") > 0)
    points = F.transform("faces", lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y")))
    want = nested.select("photo_id", measures.occlusion(points, F.lit(1024.0), F.lit(683.0)).alias("occlusion"))
    assert pairs(got, "photo_id", "occlusion") == pairs(want, "photo_id", "occlusion")


def test_routes_read_verdicts_once(spark):
    rows = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True), (4, False, False), (5, None, True)], "id long, kept boolean, hero boolean")
    got = K.routes_of_rows(rows, "id", F.col("kept"), F.col("hero"))
    assert pairs(got, "id", "route") == pairs(K.routes(rows.select("id"), rows.where("kept"), rows.where("hero"), "id"), "id", "route")
    found = plan_of(catalog.QUERIES["k10_export_routes"](spark, SMALL))
    assert "Union" not in found and "LeftAnti" not in found


def test_pairs_of_bursts_are_not_shuffled(spark):
    plan = plan_of(catalog.QUERIES["j01_near_duplicate_edges"](spark, SMALL))
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan


def test_correlation_of_centred_histograms_of_one_length(spark):
    h = [[1.0, 2.0, 4.0], [2.0, 2.0, 2.0], [0.1, 0.7, 0.2], [1.0, None, 2.0], None]
    t = spark.createDataFrame([(x, y) for x in h for y in h], "a array<double>, b array<double>")
    plain, new = measures.correlation(F.col("a"), F.col("b")), measures.correlation_of_centred(measures.centred(F.col("a")), measures.centred(F.col("b")))
    assert all(r[0] == r[1] for r in t.select(plain, new).collect())


def test_hot_keys_are_split(spark):
    a = spark.range(500).select(F.lit(1).alias("k"), "id")
    b = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("j"))
    left, right = skew.split_keys(a, b, ["k"], F.xxhash64("j"), 1000)
    sizes = right.where("k = 1").groupBy("_salt").count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) < 1200
    joined = left.join(right, ["k", "_salt"])
    assert joined.count() == 500 * b.where("k = 1").count() == joined.select("id", "j").distinct().count()


def test_edges_of_a_crowded_minute_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.integers(0, 60) if i % 3 else rng.integers(60, 4000)), v, float(1 + i % 4 / 10), int(i % 40)) for i, v in fingerprint_rows(rng, 300)]
    one = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    df = spark.createDataFrame(rows, "id long, s long, fp long, ratio double, saturation int").withColumns({"ts": F.timestamp_seconds("s"), "hue": one, "sat": one, "value": one}).drop("s")
    monkeypatch.setattr(duplicates, "CROWD", 50)
    got = pairs(duplicates.near_duplicate_edges(df, "id", "ts"), "src", "dst")
    alike = lambda a, b: ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() <= 7 and abs(a[3] - b[3]) / max(a[3], b[3]) <= 0.25 and (a[4] < 15) == (b[4] < 15)
    want = sorted((a[0], b[0]) for a in rows for b in rows if (b[1], b[0]) > (a[1], a[0]) and b[1] - a[1] <= 60 and alike(a, b))
    assert got == want and want


def test_groups_expand_exact_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, digest string")
    edges = spark.createDataFrame([(1, 3)], "src long, dst long")
    assert pairs(duplicates.groups(df, "id", "digest", edges), "id", "group_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_simhash_of_like_texts_is_near(spark):
    a = [f"w{i}" for i in range(200)]
    b = [*a[:195], "x", "y"]
    df = spark.createDataFrame([(a, b, [f"z{i}" for i in range(200)])], "a array<string>, b array<string>, c array<string>")
    s = df.select(*(duplicates.simhash(F.col(c)).alias(c) for c in "abc"))
    near, far = s.select(duplicates.hamming(F.col("a"), F.col("b")), duplicates.hamming(F.col("a"), F.col("c"))).first()
    assert near < 12 < far


def test_simhash_reads_the_words_once(spark):
    import xxhash

    texts = ["a b", "a a b", "", None, *(" ".join(f"w{i * i % k}" for i in range(k)) for k in range(1, 60))]
    words = F.regexp_extract_all("t", F.lit(r"\w+"), F.lit(0))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(2)
    made = df.select("id", duplicates.simhash(words).alias("fp"), duplicates.simhash(words, 16).alias("short"))

    def plain(text, bits):
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in (text or "").split()]
        return sum(1 << b for b in range(bits) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    assert {r.id: (r.fp % 2**64, r.short) for r in made.collect()} == {i: (plain(t, 64), plain(t, 16)) for i, t in enumerate(texts)}
    assert df.select(duplicates.simhash(words).alias("fp"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_chapters(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((1000, 1200, 3000, 3500))], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("k"))
    assert pairs(timeline.chapters(df, "ts", "id"), "id", "chapter") == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert pairs(timeline.chapters(df, "ts", "id", by="k"), "id", "chapter") == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert pairs(timeline.chapters(df, "ts", "id", gap=1800), "id", "chapter") == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_names_continue(spark):
    df = spark.createDataFrame([(10, None), (11, None)], "id long, name string")
    assert pairs(timeline.auto_names(df, "id", "name"), "id", "name") == [(10, "Person 1"), (11, "Person 2")]


def test_rank_all_over_many_parts(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = ranking.rank_all(df, [F.col("v")]).collect()
    assert all(r["rank"] == r["v"] + 1 for r in got)


def test_neighbours(spark):
    df = spark.range(5).withColumn("k", F.lit(1))
    got = {r.id: r.neighbours for r in ranking.neighbours(df, ["k"], ["id"], "id", 2).collect()}
    assert got[0] == [1, 2] and got[2] == [0, 1, 3, 4]


def test_verdicts_partition_and_have_one_best(spark):
    from darkslide.plans.score_queries import scored
    from tests.conftest import SMALL

    s = scored(spark, SMALL)
    for v in (cull.verdicts(s, coverage=True), cull.verdicts(s, percent=10), cull.verdicts(s)):
        rows = v.collect()
        assert len({r.photo_id for r in rows}) == len(rows) == s.count()
        best = {}
        for r in rows:
            best[r.group_id] = best.get(r.group_id, 0) + r.is_best
            assert (r.decision == "REJECT") == r.auto_discard and (r.is_best or r.auto_discard)
        assert set(best.values()) == {1}


def test_merge_follows_chains_and_split_numbers_on(spark):
    df = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13)], "id long, cluster long")
    merges = spark.createDataFrame([(10, 11), (11, 12)], "keep long, gone long")
    assert pairs(identity.merge_clusters(df, "cluster", merges), "id", "cluster") == [(1, 10), (2, 10), (3, 10), (4, 13)]
    assert pairs(identity.split_cluster(df, "cluster", F.col("id") == 1), "id", "cluster") == [(1, 14), (2, 11), (3, 12), (4, 13)]
    assert identity.merge_history(merges, F.current_timestamp()).count() == 2


def test_recovery_candidates(spark):
    cols = "face_id long, person_id long, cluster_id long, eye_openness int, yaw int, pitch int, roll int, smile int, lighting int"
    rows = [(1, 1, 5, 10, 0, 0, 0, 50, 50), (2, 1, 5, 90, 12, 0, 0, 50, 50), (3, 1, 5, 90, 25, 0, 0, 50, 50), (4, 2, 5, 90, 0, 0, 0, 50, 50), (5, 1, 5, 60, 0, 0, 0, 50, 50)]
    df = spark.createDataFrame(rows, cols)
    assert pairs(identity.recovery_candidates(df.where("face_id = 1"), df), "target", "candidate") == [(1, 2)]
    assert pairs(identity.recovery_candidates(df.where("face_id = 4"), df), "target", "candidate") == [(4, 4)]
    assert pairs(identity.recovery_candidates(df.where("face_id = 4"), df, exclude_self=True), "target", "candidate") == []


def test_recovery_takes_every_face(spark):
    from darkslide import catalog
    from darkslide.plans.fixtures import face_rows
    from tests.conftest import SMALL

    by = {}
    for r in face_rows(spark, SMALL).collect():
        by.setdefault(f"c{r.cluster_id}" if r.person_id is None else f"p{r.person_id}", []).append(r)
    most = {"yaw": 12, "pitch": 12, "roll": 12, "smile": 25, "lighting": 25}
    want = sorted((t.face_id, c.face_id, t.occlusion == 0 and c.occlusion == 0) for f in by.values() for t in f if t.is_blink for c in f if c.eye_openness >= 75 and all(abs(t[k] - c[k]) <= m for k, m in most.items()))
    assert pairs(catalog.QUERIES["j06_recovery_candidates_all"](spark, SMALL), "target", "candidate") == [w[:2] for w in want]
    assert pairs(catalog.QUERIES["j07_swap_eligible_all"](spark, SMALL), "target", "candidate", "swappable") == want
    assert any(t // 100 % 20 >= 4 for t, _, _ in want)


def test_assignment_keeps_every_row_and_moves_centroids(spark, tmp_path):
    from darkslide import catalog

    rng = np.random.default_rng(8)
    at = {0: [1, 0, 0, 0], 1: [0, 1, 0, 0], 2: [0, 0, 1, 0], 3: [0, 0, 0, -1]}
    rows = [(2 * i, (np.array(at[i % 2]) + rng.normal(0, 0.02, 4)).tolist(), i % 2) for i in range(12)]
    far = {41: 2, 43: 2, 45: 2, 47: 2, 49: 3}
    rows += [(2 * i + 1, (np.array(at[i % 2]) + rng.normal(0, 0.02, 4)).tolist(), 0) for i in range(6)]
    rows += [(k, (np.array(at[c]) - [0.3, 0.3, 0, 0]).tolist(), 0) for k, c in far.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {2 * i + 1: (i % 2, False) for i in range(6)} | {k: (c, True) for k, c in far.items()}
    got = {r.vec_id: (r.cluster, r.is_new) for r in catalog.QUERIES["g04_assign_all"](spark, str(tmp_path)).collect()}
    assert got == want
    member = {k: want[k][0] if k in want else c for k, _, c in rows}
    moved = {r.cluster: r for r in catalog.QUERIES["g04_moved_centroids"](spark, str(tmp_path)).collect()}
    assert sorted(moved) == [0, 1, 2, 3]
    for c, r in moved.items():
        x = np.array([v for k, v, _ in rows if member[k] == c], np.float32).astype(float)
        assert r.faces == len(x) and np.allclose(r.sums, x.sum(0)) and np.allclose(r.centroid, x.mean(0) / np.linalg.norm(x.mean(0)))


def test_person_commands(spark):
    rows = [(1, 1, "create", "Ann"), (2, 2, "create", "Bob"), (3, 3, "create", "Ann"), (4, 2, "delete", None), (5, 1, "rename", "Ann B")]
    persons = identity.person_state(spark.createDataFrame(rows, "seq long, person_id long, op string, name string"))
    assert pairs(persons, "person_id", "name") == [(1, "Ann B"), (3, "Ann")]
    mapping = spark.createDataFrame([(1, 7, 1), (2, 7, 3), (3, 8, 2)], "seq long, cluster_id long, person_id long")
    assert {r.cluster_id: r.person_id for r in identity.mapped_clusters(mapping, persons).collect()} == {7: 3, 8: None}


def test_ranks_in_large_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", int(rng.integers(0, 40))) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = ranking.rank_in_large_groups(df, ["g"], [F.col("v"), F.col("id")])
    by = {}
    for i, g, v in rows:
        by.setdefault(g, []).append((v, i))
    want = {i: n for x in by.values() for n, (_, i) in enumerate(sorted(x), 1)}
    assert {r.id: r["rank"] for r in got.collect()} == want and got.columns == ["id", "g", "v", "rank"]
    assert ranking.rank_in_large_groups(df.limit(0), ["g"], [F.col("v")]).count() == 0
    p = ranking.percentiles(df.withColumn("v", F.when(F.col("id") % 9 != 0, F.col("v"))), "g", "v", {"p5": 0.05, "p99": 0.99, "top": 1.0})
    for r in p.collect():
        v = [x for x, i in by[r.g] if i % 9]
        assert np.allclose([r.p5, r.p99, r.top], np.percentile(v, [5, 99, 100]))


def test_chapters_and_gaps_of_a_large_group(spark):
    rng = np.random.default_rng(4)
    rows, now = [], {}
    for i in range(1200):
        u = None if i % 60 == 0 else 1 if i % 4 else 2 + i % 5
        now[u] = now.get(u, 1_700_000_000) + int(rng.choice([5, 400, 950, 4000]))
        rows.append((i, u, now[u]))
    df = spark.createDataFrame(rows, "id long, u long, s long").select("id", "u", F.timestamp_seconds("s").alias("ts")).repartition(5)
    want, gaps, last = {}, [], {}
    for i, u, s in rows:
        before, n = last.get(u, (s, 1))
        n += s - before > 900
        want[i] = n
        if s - before > 3600:
            gaps.append((-1 if u is None else u, s - before))
        last[u] = (s, n)
    assert {r.id: r.chapter for r in timeline.chapters(df, "ts", "id", 900, by="u").collect()} == want
    found = timeline.long_gaps(df, "u", "ts", "id").select(F.coalesce("u", F.lit(-1)).alias("u"), F.col("seconds").cast("long").alias("n"))
    assert pairs(found, "u", "n") == sorted(gaps)
    assert timeline.chapters(df.limit(0), "ts", "id", by="u").count() == timeline.long_gaps(df.limit(0), "u", "ts", "id").count() == 0


def test_search_and_nearest_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [3.0, 4.0])], "id long, v array<double>")
    centers = spark.createDataFrame([(7, [0.0, 2.0]), (5, [0.0, 1.0]), (9, [1.0, 0.0])], "c long, centroid array<double>")
    got = {r.id: (r.cluster, r.sim) for r in vectors.nearest(df, "id", "v", centers, "c", 0.5).collect()}
    assert got == {1: (9, 1.0), 2: (None, 0.0), 3: (None, 0.0), 4: (5, 0.8)}  # of equal centroids the least number
    assert pairs(vectors.search(df.where("id <> 3"), df, "id", "v", 0.5), "query", "candidate") == [(1, 1), (1, 4), (4, 1), (4, 4)]
    assert vectors.nearest(df.limit(0), "id", "v", centers, "c", 0.5).count() == vectors.nearest(df, "id", "v", centers.limit(0), "c", 0.5).count() == 0
    assert vectors.search(df.limit(0), df, "id", "v", 0.5).count() == vectors.search(df.where("id = 2"), df, "id", "v", 0.5).count() == 0


def test_named_features(spark):
    from darkslide.functions.features import feature, vectorized, with_features

    mine = {}
    feature("b", "a", registry=mine)(lambda: F.col("a") + 1)
    feature("c", "b", "a", registry=mine)(lambda: F.col("b") * F.col("a"))
    feature("x", "y", registry=mine)(lambda: F.col("y"))
    feature("y", "x", registry=mine)(lambda: F.col("x"))
    df = spark.createDataFrame([(3,)], "a int")
    assert with_features(df, "c", registry=mine).first().asDict() == {"a": 3, "b": 4, "c": 12}
    assert with_features(df.withColumn("b", F.lit(10)), "c", registry=mine).first()["c"] == 30
    for bad in ("x", "nothing"):
        with pytest.raises(ValueError):
            with_features(df, bad, registry=mine)
    with pytest.raises(ValueError):
        feature("b", registry=mine)(lambda: F.lit(1))

    def load():
        return lambda values: np.array([[len(v), 1] for v in values])

    t = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "x" * 9)], "id int, t string")
    assert {r.id: r.vec for r in vectorized(t, "t", load, rows=2).collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0], 4: [9.0, 1.0]}


def test_text_fingerprints_equal_plain_ones(spark):
    import re

    import xxhash

    from darkslide import catalog

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    prints = {}
    for k, t in rows:
        votes = np.zeros(64, int)
        for w in re.findall(r"[A-Za-z0-9_]+", t.lower()):  # as the pattern reads words without its Unicode flag
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            votes += [1 if h >> b & 1 else -1 for b in range(64)]
        prints[k] = sum(1 << b for b in range(64) if votes[b] > 0)
    root = {k: k for k, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    text = dict(rows)
    keys = sorted(root)
    for i in keys:
        for j in keys:
            if i < j and (text[i] == text[j] or (prints[i] ^ prints[j]).bit_count() <= 3):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = pairs(catalog.QUERIES["j01_text_fingerprints"](spark, SMALL), "doc_id", "group_id")
    assert got == [(k, top(k)) for k in keys] and any(k != g for k, g in got)


def test_matching_scores_of_odd_faces(spark):
    faces = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 5, None), (3, None, [1.0, 0.0]), (4, 6, [0.0, 0.0]), (5, 9, [1.0, 1.0])], "id int, c int, v array<double>")
    centers = spark.createDataFrame([(5, [1.0, 1.0]), (6, [1.0, 0.0])], "c int, centroid array<double>")
    got = {r.id: r.score for r in identity.matching_scores(faces, "id", "c", "v", centers).collect()}
    assert abs(got.pop(1) - 0.5**0.5) < 1e-12 and got == {2: None, 3: None, 4: 0.0, 5: None}


def test_sidecars_round_trip(spark):
    df = spark.createDataFrame([(4, "Red", False), (1, "", True)], "r int, l string, j boolean")
    head = '<rdf:RDF xmlns:rdf="u1" xmlns:xmp="u2" xmlns:xmpDM="u3" xmlns:photomechanic="u4">'
    xml = F.concat(F.lit(head), K.sidecar_text(F.col("r"), F.col("l"), F.col("j")), F.lit("</rdf:RDF>"))
    got = S.read_sidecars(df.select("r", xml.alias("xml")), "xml").orderBy("r").collect()
    assert [(x.sidecar.rating, x.sidecar.label, x.sidecar.rejected) for x in got] == [(1, "", True), (4, "Red", False)]


def test_broken_sidecars_give_defaults(spark):
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:xmp="u"><rdf:RDF xmlns:rdf="r">'
    rows = [
        (1, '<x><Description Rating="3">a & b</Description></x>', 0), (2, '<x><Description Rating="3"></Other></x>', 0), (3, '<x><!-- <b> --><Description Rating="3"></Description></x>', 3),
        (4, None, 0), (5, "", 0), (6, "no xml", 0), (7, '<Description Rating="4"/>', 4), (8, head + '<rdf:Description xmp:Rating="2"/><rdf:Description xmp:Label="Red"/></rdf:RDF></x:xmpmeta>', 2),
        (9, head + "<rdf:Description><xmp:Rating>5</xmp:Rating>", 0), (10, head + "<rdf:Description><xmp:Rating>many</xmp:Rating></rdf:Description></rdf:RDF></x:xmpmeta>", 0),
    ]
    df = spark.createDataFrame(rows, "id int, xml string, parsed int")
    got = {r.id: r for r in S.read_sidecars(df, "xml").collect()}
    assert {k: r.sidecar.rating for k, r in got.items()} == {k: r.parsed for k, r in got.items()}  # a clashing column stays too
    assert got[8].sidecar.label == "Red" and got[1].sidecar.keywords == [] and not got[1].sidecar.rejected


def test_sidecar_update_keeps_other_tags(spark):
    df = spark.createDataFrame([('<rdf:Description tiff:Make="X"><a/></rdf:Description>',)], "x string")
    once = df.select(K.with_attribute(F.col("x"), "xmp:Rating", F.lit("3")).alias("x"))
    assert once.first()[0] == '<rdf:Description xmp:Rating="3" tiff:Make="X"><a/></rdf:Description>'
    assert once.select(K.with_attribute(F.col("x"), "xmp:Rating", F.lit("$5\\"))).first()[0] == '<rdf:Description xmp:Rating="$5\\" tiff:Make="X"><a/></rdf:Description>'
    tag = df.select(K.with_tag(F.col("x"), "xmp:Label", F.lit("Red")).alias("x"))
    assert tag.first()[0] == '<rdf:Description tiff:Make="X"><a/><xmp:Label>Red</xmp:Label></rdf:Description>'


def test_move_plan_passes_over_names_in_use(spark):
    df = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, "a.jpg"), (4, "a_1.jpg"), (5, "b.jpg")], "id long, name string")
    taken = spark.createDataFrame([("b.jpg",), ("b_1.jpg",)], "name string")
    got = {r.id: r.target for r in K.move_plan(df, "name", "id", taken).collect()}
    assert got == {1: "a.jpg", 2: "a_2.jpg", 3: "a_3.jpg", 4: "a_1.jpg", 5: "b_2.jpg"}


def test_move_plan_of_one_name_and_as_many_numbers_in_use(spark):
    """100,000 rows of one name, and 100,000 that use every other number after it."""
    n = 100_000
    df = spark.range(n).select("id", F.lit("a.jpg").alias("name")).union(spark.range(n).select(F.col("id") + n, F.concat(F.lit("a_"), F.col("id") * 2 + 1, F.lit(".jpg"))))
    made = K.move_plan(df, "name", "id").cache()
    assert made.select("target").distinct().count() == made.count() == 2 * n
    assert made.where(f"id >= {n} and target <> name").count() == 0
    # row i of the name gets the i-th even number
    assert made.where(f"id < {n} and id > 0 and target <> concat('a_', id * 2, '.jpg')").count() == 0
    assert "array" not in made.select("target")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_move_plan_equals_plain(spark):
    rng = np.random.default_rng(7)
    names = [rng.choice(["a.jpg", "b.png", "a_1.jpg", "a_3.jpg", "a_2", "a", "a_4.jpg", "b_2.png", "x_1_1.c", "x_1.c"]) for _ in range(120)]
    taken = ["a.jpg", "a_5.jpg", "b_1.png", "x_1.c"]
    in_use = {*names, *taken}
    want, count = {}, {}
    for i, name in enumerate(names):
        k = count[name] = count.get(name, -1 + (name in taken)) + 1
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (name, "")
        free = (j for j in range(1, 10**6) if f"{stem}_{j}{ext}" not in in_use)
        want[i] = name if k == 0 else f"{stem}_{[next(free) for _ in range(k)][-1]}{ext}"
    df = spark.createDataFrame([(i, str(n), 1) for i, n in enumerate(names)], "id long, name string, place int").repartition(5)
    got = K.move_plan(df, "name", "id", spark.createDataFrame([(t,) for t in taken], "name string"))
    assert got.columns == ["id", "name", "place", "target"]
    assert {r.id: r.target for r in got.collect()} == want


@pytest.mark.parametrize(("rows", "parts"), [(400, "7"), (10, "8")])
def test_neighbours_of_one_user_with_all_rows(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(rows).select("id", F.when(F.col("id") % 10 < 9, 1).when(F.col("id") % 20 < 10, 2).alias("u"))
        got = {r.id: r.neighbours for r in ranking.neighbours(df, ["u"], ["id"], "id", 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for u in (1, 2, None):
        own = [i for i in range(rows) if (1 if i % 10 < 9 else 2 if i % 20 < 10 else None) == u]
        for at, i in enumerate(own):
            assert got[i] == own[max(0, at - 3) : at] + own[at + 1 : at + 4]
    assert len(got) == rows


def test_recovery_of_a_person_with_most_faces(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 30)
    rng = np.random.default_rng(3)
    rows = [(i, 1 if i % 3 else i, 5, int(rng.integers(0, 101)), *(int(x) for x in rng.integers(-30, 31, 3)), *(int(x) for x in rng.integers(30, 71, 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "face_id long, person_id long, cluster_id long, eye_openness int, yaw int, pitch int, roll int, smile int, lighting int")
    most = (12, 12, 12, 25, 25)
    want = sorted((t[0], c[0]) for t in rows if t[0] % 10 == 0 for c in rows if c[1] == t[1] and c[3] >= 75 and all(abs(a - b) <= m for a, b, m in zip(t[4:], c[4:], most, strict=True)))
    found = identity.recovery_candidates(df.where("face_id % 10 = 0"), df)
    assert pairs(found, "target", "candidate") == want and want


def test_presets(spark):
    df = spark.createDataFrame([("Portraits", False), ("Ceremony", True), (None, None)], "scene string, is_highlight boolean")
    assert pairs(K.with_preset(df, "Wedding"), "rating", "label") == [(2, "None"), (4, "Blue"), (5, "Red")]
    assert pairs(K.with_preset(df, "Other"), "rating", "label") == [(0, "None")] * 3


def test_queue(spark):
    log = spark.createDataFrame([(1, "q", 5, "add"), (2, "q", 6, "add"), (3, "q", 5, "add"), (4, "q", 5, "done")], "seq long, q string, item long, action string")
    assert pairs(K.queue_progress(log, "q"), "waiting", "completed", "next_item") == [(1, 1, 6)]


def test_files_logs_and_delivery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.JPG", "b.txt", "c.nef"):
        (tmp_path / "in" / n).write_bytes(b"xx")
    assert pairs(S.list_files(spark, str(tmp_path / "in")).select(F.substring_index("path", "/", -1).alias("n"), "size"), "n", "size") == [("a.JPG", 2), ("c.nef", 2)]
    (tmp_path / "log.jsonl").write_text('{"level":"info","event":"scan","payload":{"n":"3"}}\nbroken\n')
    assert S.read_log(spark, str(tmp_path / "log.jsonl")).first()["payload"] == {"n": "3"}
    df = spark.createDataFrame([(1, "Portraits"), (2, None)], "id long, scene string")
    K.deliver(df, "scenes", str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("subfolder=*")) == ["subfolder=General", "subfolder=Portraits"]
    K.replace_table(spark, spark.read.parquet(str(tmp_path / "out")).where("id = 1"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_reports(spark):
    s = spark.createDataFrame([(4, 3, 2, 1)], "analyzed long, kept long, recovered long, highlights long")
    assert K.summary_json(s).first()[0] == '{"analyzed":4,"kept":3,"recovered":2,"highlights":1}'
    assert "<b>Kept:</b> 3" in K.summary_html(s).first()[0]


def test_stream_over_several_files_resumes(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", (F.col("id") % 4).alias("k")).coalesce(1).write.mode("append").parquet(src)
    point, target = str(tmp_path / "point"), str(tmp_path / "table")
    jobs.ingest(jobs.source(spark, src), "k", "id", target, point)
    first = pairs(jobs.latest_version(spark, target, None), "k", "id")
    assert first == [(0, 28), (1, 29), (2, 26), (3, 27)]
    spark.range(100, 101).select("id", (F.col("id") % 4).alias("k")).coalesce(1).write.mode("append").parquet(src)
    jobs.ingest(jobs.source(spark, src), "k", "id", target, point)
    assert pairs(jobs.latest_version(spark, target, None), "k", "id") == [(0, 100), *first[1:]]


def test_kept_table_is_compacted(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "table")
    for i in range(7):  # later files hold lower ids
        spark.range(60 - i * 10, 70 - i * 10).select("id", (F.col("id") % 4).alias("k")).coalesce(1).write.mode("append").parquet(src)
    jobs.ingest(jobs.source(spark, src, 1), "k", "id", target, str(tmp_path / "point"), compact_every=3)
    assert pairs(jobs.latest_version(spark, target, None), "k", "id") == [(0, 68), (1, 69), (2, 66), (3, 67)]
    assert [sorted(p.name for p in (tmp_path / "table" / x).iterdir()) for x in ("base", "log")] == [["upto=5"], ["epoch=6"]]
    assert jobs.latest_version(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0


def test_files_out_of_the_order_of_time(spark, tmp_path):
    src = str(tmp_path / "src")
    every = [(i, i % 2, f"2024-01-01 {h:02d}:{m:02d}:00") for i, (h, m) in enumerate((h, m) for h in (9, 3, 6) for m in range(0, 60, 10))]
    for part in (every[:6], every[6:12], every[12:]):
        spark.createDataFrame(part, "id long, u long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    s = jobs.ended(jobs.source(spark, src).select("u", "ts"), "ts")
    got = jobs.drain(jobs.sessions(s, "u", "ts", "1200 seconds", "10 minutes")).where("u is not null")
    assert pairs(got.select("u", F.hour("started").alias("h"), "n"), "u", "h", "n") == [(u, h, 3) for u in (0, 1) for h in (3, 6, 9)]
    near = jobs.drain(jobs.burst_pairs(jobs.source(spark, src), jobs.source(spark, src), "id", "u", "ts", 1200, "1 minute"))
    assert near.count() == 12
    with pytest.raises(ValueError, match="behind the watermark"):
        jobs.drain(jobs.sessions(jobs.source(spark, src, 1).select("u", "ts"), "u", "ts", "1200 seconds", "10 minutes"))


def test_online_clusters_equal_plain_steps(spark, tmp_path):
    """Batches of one file each: nearest centroid or a new cluster, then moved centroids."""
    rng = np.random.default_rng(5)
    base = np.eye(6)
    vecs = [(base[i % 6] + rng.normal(0, 0.05, 6)).tolist() for i in range(36)]
    src, target = str(tmp_path / "src"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(j, vecs[j]) for j in range(i * 12, i * 12 + 12)], "id long, v array<double>").coalesce(1).write.mode("append").parquet(src)
    centers = spark.createDataFrame([(0, base[0].tolist()), (1, base[1].tolist())], "c long, centroid array<double>")
    jobs.online_clusters(jobs.source(spark, src, 1), "id", "v", centers, "c", target, 0.75, 0.25)
    got = {r.id: (r.cluster, r.is_new, r.epoch) for r in spark.read.option("basePath", f"{target}/assigned").parquet(f"{target}/assigned").collect()}
    sums, n = {0: base[0].copy(), 1: base[1].copy()}, {0: 1, 1: 1}
    for epoch in range(3):
        batch = sorted(k for k, x in got.items() if x[2] == epoch)
        names = {}
        for k in batch:
            v = np.array(vecs[k])
            sims = {c: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for c, s in sums.items()}
            c = max(sims, key=lambda x: (sims[x], -x))
            if sims[c] >= 0.75:
                assert got[k][:2] == (c, False)
                names[k] = c
        rest = [k for k in batch if k not in names]
        assert all(got[k][1] for k in rest) and all((got[a][0] == got[b][0]) == (a % 6 == b % 6) for a in rest for b in rest)
        top = max(sums)
        assert sorted({got[k][0] for k in rest}) == list(range(top + 1, top + 1 + len({k % 6 for k in rest})))
        for k in batch:
            c = got[k][0]
            sums[c], n[c] = sums.get(c, np.zeros(6)) + vecs[k], n.get(c, 0) + 1
    last = {r.cluster: (r.sums, r.faces) for r in spark.read.parquet(f"{target}/centers/version=2").collect()}
    assert child_names(spark, f"{target}/centers") == ["version=1", "version=2"]
    assert {c: x[1] for c, x in last.items()} == n and all(np.allclose(last[c][0], sums[c]) for c in sums)


def test_online_clusters_go_on_from_their_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(8)
    src, target, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    vecs = [(np.eye(5)[i % 5] + rng.normal(0, 0.03, 5)).tolist() for i in range(30)]
    centers = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0])], "c long, centroid array<double>")
    for part in range(3):  # stopped after each part
        spark.createDataFrame([(j, vecs[j]) for j in range(part * 10, part * 10 + 10)], "id long, v array<double>").coalesce(1).write.mode("append").parquet(src)
        jobs.online_clusters(jobs.source(spark, src, 1), "id", "v", centers, "c", target, 0.75, 0.25, mark)
    got = {r.id: r.cluster for r in spark.read.parquet(f"{target}/assigned").collect()}
    assert len(got) == 30 and all((got[a] == got[b]) == (a % 5 == b % 5) for a in got for b in got)
    last = {r.cluster: r.faces for r in spark.read.parquet(f"{target}/centers/version=2").collect()}
    assert last == {got[i]: 6 + (got[i] == 0) for i in range(5)}


def test_late_rows_of_many_batches_are_an_error(spark, tmp_path):
    """One row comes late in the fourth of 104 batches: the query itself no longer knows at the end."""
    src = str(tmp_path / "src")
    (tmp_path / "src").mkdir()
    for i in range(104):
        t = 10_000 + i * 100 if i != 3 else 5
        pq.write_table(pa.table({"user": [1], "ts": pa.array([t * 1_000_000], pa.timestamp("us"))}), f"{src}/{i:04d}.parquet")
        os.utime(f"{src}/{i:04d}.parquet", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "20")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(ValueError, match="^1 rows came behind"):
            jobs.drain(jobs.sessions(jobs.source(spark, src, 1), "user", "ts", delay="1 minute"))
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_vector_sums_of_hot_and_ragged_groups(spark, monkeypatch):
    from darkslide.operators import sums

    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i}", None if i % 50 == 7 else [None if i % 40 == 3 else float(x) for x in rng.normal(size=3 + i % 2)]) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v array<float>").repartition(9)
    got = {r.g: r for r in vector_sums(df, "g", "v").collect()}
    assert set(got) == {g for g, _ in rows}
    for g, r in got.items():
        own = [v for x, v in rows if x == g]
        assert r.n == len(own)
        for p in range(4):
            known = [v[p] for v in own if v is not None and len(v) > p and v[p] is not None]
            if p < len(r.counts):
                assert r.counts[p] == len(known) and r.sums[p] == pytest.approx(sum(known), abs=1e-4)
            else:
                assert not known
    assert vector_sums(df.limit(0), "g", "v").collect() == []


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)], [(i, i + 1) for i in range(40)], []])
def test_components_in_one_task_are_the_same(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert pairs(graph.connected_components(df, in_one_task=100), "node", "component") == pairs(graph.connected_components(df), "node", "component")


def bucket_files(path):
    return {str(f.relative_to(path)) for f in path.glob("_bucket=*/*.parquet")}


def test_bucketed_table_rewrites_touched_buckets_only(spark, tmp_path):
    path = tmp_path / "t"
    rows = {i: f"v{i}" for i in range(400)}
    bucketed.create(spark.createDataFrame(list(rows.items()), "id long, v string"), str(path), "id", 8)
    before = bucket_files(path)

    def check(hit, now):
        nonlocal before
        after = bucket_files(path)
        of = lambda files: {f for f in files if int(f.split("/")[0].split("=")[1]) not in hit}
        assert of(after) == of(before) and (not hit or after != before)
        before = after
        assert pairs(bucketed.read(spark, str(path)), "id", "v") == sorted(now)

    hit = bucketed.upsert_into(spark, str(path), spark.createDataFrame([(5, "new"), (900, "added")], "id long, v string"))
    rows |= {5: "new", 900: "added"}
    assert 1 <= len(hit) <= 2
    check(hit, rows.items())
    hit = bucketed.replace_children_in(spark, str(path), spark.createDataFrame([("a", 7), ("b", 7)], "v string, id long"), spark.createDataFrame([(7,), (8,)], "id long"))
    now = [x for x in rows.items() if x[0] not in (7, 8)] + [(7, "a"), (7, "b")]
    check(hit, now)
    one = bucketed.change(spark, str(path), spark.createDataFrame([(7,)], "id long"), lambda r: r)[0]
    check([one], now)
    everything = bucketed.read(spark, str(path)).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(8))).where(F.col("b") == one)
    hit = bucketed.delete_from(spark, str(path), everything.select("id"))  # a bucket that is left empty
    assert hit == [one] and not list(path.glob(f"_bucket={one}/*.parquet"))
    check(hit, [x for x in now if x[0] not in {r.id for r in spark.createDataFrame([(i,) for i, _ in now], "id long").where(F.pmod(F.xxhash64("id"), F.lit(8)) == one).collect()}])
    assert bucketed.upsert_into(spark, str(path), spark.createDataFrame([], "id long, v string")) == []
    with pytest.raises(ValueError):
        bucketed.change(spark, str(path), spark.createDataFrame([(1,)], "id long"), lambda r: r.withColumn("id", F.col("id") + 1))


@pytest.mark.parametrize("seed", range(3))
def test_grown_components_equal_a_full_run(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))]
    known = spark.createDataFrame(graph.connected_components(spark.createDataFrame(edges[:60], "src long, dst long")).collect(), "node long, component long")
    new = spark.createDataFrame(edges[60:], "src long, dst long")
    grown = graph.grown_components(known, new).cache()
    whole = pairs(graph.connected_components(spark.createDataFrame(edges, "src long, dst long")), "node", "component")
    assert pairs(K.upsert(known, grown, "node"), "node", "component") == whole
    old = set(pairs(known, "node", "component"))
    assert all(x not in old for x in pairs(grown, "node", "component"))  # what stays as it is isn't written again
    if seed == 0:
        assert graph.grown_components(known, new.limit(0)).count() == 0


def test_pictures_with_their_sidecar_files(spark, tmp_path):
    (tmp_path / "day").mkdir()
    xml = lambda n: f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r"><rdf:Description xmlns:xmp="n" xmp:Rating="{n}"/></rdf:RDF></x:xmpmeta>'
    for name, text in {"a.jpg": "x", "a.xmp": xml(3), "a.jpg.xmp": xml(1), "day/b.nef": "xx", "day/b.nef.xmp": xml(4), "c.jpg": "x", "d.jpg": "x", "d.xmp": "<broken", "notes.txt": "n"}.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.sidecar_path.rsplit("/", 1)[1], r.has_sidecar, r.sidecar.rating) for r in S.pictures_with_sidecars(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": ("a.xmp", True, 3), "b.nef": ("b.nef.xmp", True, 4), "c.jpg": ("c.xmp", False, 0), "d.jpg": ("d.xmp", True, 0)}


def test_pages_of_a_cluster_that_holds_most_faces(spark):
    """Pages put together are the cluster's faces; repeated rows and nulls stay, faces without a cluster don't come in."""
    from darkslide.operators.identity import cluster_pages

    rows = [(1, i // 2, "a") for i in range(5000)] + [(2, 7, None), (2, None, "b"), (None, 3, "c"), (9, 1, "z")]
    faces = spark.createDataFrame(rows, "c long, face long, note string")
    clusters = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "c long, name string")
    found = cluster_pages(clusters, faces, "c", ["face", "note"], 64).collect()
    pages = {(r.c, r.page): r for r in found}
    assert len(found) == len(pages) == -(-5000 // 64) + 2
    one = [tuple(f) for k in range(-(-5000 // 64)) for f in pages[1, k].faces]
    assert one == [(i // 2, "a") for i in range(5000)] and max(len(r.faces) for r in found) == 64
    assert {r.n_faces for r in found if r.c == 1} == {5000} and pages[1, 0].name == "x"
    assert [tuple(f) for f in pages[2, 0].faces] == [(None, "b"), (7, None)] and pages[3, 0].faces == [] and pages[3, 0].n_faces == 0
    assert cluster_pages(clusters, faces.limit(0), "c", ["face"]).count() == 3 and cluster_pages(clusters.limit(0), faces, "c", ["face"]).count() == 0
