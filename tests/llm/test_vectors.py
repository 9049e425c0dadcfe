"""Clusters and neighbours against brute force over small sets, with copies, dense balls and bad rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.clusters import cluster_records, components, describe_clusters, local_clusters
from gridloom.llm.neighbours import VantageTree, nearest, pairs

SCHEMA = "id string, table_name string, entity_id string, embedding array<float>, received_at timestamp_ntz"


def grouped(seed, groups, size, loners, noise=0.4):
    g = np.random.default_rng(seed)
    rows = []
    for k in range(groups):
        c = g.normal(size=384)
        c /= np.linalg.norm(c)
        for _ in range(size):
            e = g.normal(size=384)
            rows.append(c + noise * e / np.linalg.norm(e))
    rows += list(g.normal(size=(loners, 384)))
    x = np.array(rows, np.float32)
    return x * g.choice([0.5, 1, 2], len(x))[:, None].astype(np.float32)


def frame(spark, x, seed=0, copies=0, table=None):
    """Rows of vectors: entities of up to three vectors, copies of the first vector, repeated rows, unusable vectors."""
    g = np.random.default_rng(seed)
    x = np.concatenate((x, np.repeat(x[:1], copies, axis=0))) if copies else x
    rows = [(f"id{g.integers(10**9):09d}-{i}", table or ("A" if i % 3 else "B"), f"e{i // 2 if i % 5 == 0 else i}", [float(y) for y in v], None) for i, v in enumerate(x)]
    bad = [("n1", "A", "z", None, None), ("n2", "A", "z", [], None), ("n3", "A", "z", [1.0] * 383, None), ("n4", "A", "z", [0.0] * 384, None), ("n5", "A", "z", [float("nan")] + [1.0] * 383, None), ("n6", "A", "z", [float("inf")] * 384, None), ("n7", "A", "z", [None] + [1.0] * 383, None), (None, "A", "z", rows[0][3], None)]
    df = spark.createDataFrame(rows + rows[:7] + bad, SCHEMA).withColumn("code", F.lit(1)).withColumn("cell", F.lit("x")).withColumn("size", F.lit(0))
    return rows, df


def brute_clusters(rows, least=0.70):
    x = np.array([r[3] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = np.array([r[1] for r in rows])
    link = (x @ x.T >= least) & (t[:, None] == t[None])
    label = np.arange(len(x))
    while True:
        new = np.array([label[link[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    ids = np.array([r[0] for r in rows])
    return {ids[i]: min(ids[label == label[i]]) for i in range(len(x))}


@pytest.mark.parametrize("max_cell", [20_000, 40])
def test_clusters(spark, max_cell):
    rows, df = frame(spark, grouped(1, 12, 9, 150), copies=120)
    got = cluster_records(df, max_cell=max_cell)
    want = brute_clusters(rows)
    found = {r["id"]: (r["cluster_id"], r["size"]) for r in got.collect()}
    assert {k: v[0] for k, v in found.items()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(v[1] == sizes[v[0]] for v in found.values())


@pytest.mark.parametrize("max_cell", [20_000, 700])
def test_single_links_are_found(spark, max_cell):
    """Pairs that just reach the least cosine, amid loners: no other link brings them together."""
    g = np.random.default_rng(9)
    a, e = g.normal(size=(2, 250, 384))
    a /= np.linalg.norm(a, axis=1)[:, None]
    e -= (e * a).sum(axis=1)[:, None] * a
    c = np.linspace(0.701, 0.74, 250)[:, None]
    b = c * a + np.sqrt(1 - c**2) * e / np.linalg.norm(e, axis=1)[:, None]
    rows, df = frame(spark, np.concatenate((a, b, g.normal(size=(1500, 384)))).astype(np.float32), table="A")
    got = {r["id"]: r["cluster_id"] for r in cluster_records(df, max_cell=max_cell).collect()}
    want = brute_clusters(rows)
    assert got == want and len(set(want.values())) == len(rows) - 250


def test_chains_of_clusters(spark):
    """Neighbours on an arc are linked, the ends are far apart: one cluster by many steps."""
    a = np.linspace(0, np.pi, 60)
    x = np.zeros((60, 384), np.float32)
    x[:, 0], x[:, 1] = np.cos(a), np.sin(a)
    rows, df = frame(spark, x, table="A")
    assert {r["cluster_id"] for r in cluster_records(df).collect()} == {min(r[0] for r in rows)}
    assert (local_clusters(x.astype(float), 0.7) == 0).all()


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(100) if i != 50] + [("a", "hub")] + [("hub", f"h{i}") for i in range(200)] + [("s", "s")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:03d}"] for i in range(51)} == {"000"} and {got[f"{i:03d}"] for i in range(51, 101)} == {"051"}
    assert {v for k, v in got.items() if k[0] in "ah"} == {"a"} and "s" not in got


def test_typical_members(spark):
    rows, df = frame(spark, grouped(3, 3, 8, 20), table="A")
    clustered = cluster_records(df)
    got = describe_clusters(df, clustered).collect()
    x = {r[0]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    by = {}
    for k, c in brute_clusters(rows).items():
        by.setdefault(c, []).append(k)
    want = {}
    for c, ids in by.items():
        if len(ids) >= 5:
            mean = {i: float(np.mean([x[i] @ x[j] for j in ids if j != i])) for i in ids}
            for rank, i in enumerate(sorted(ids, key=lambda i: (-round(mean[i], 6), i))[:3], 1):
                want[c, rank] = (i, mean[i])
    assert {(r["cluster_id"], r["rank"]): r["member"] for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r["mean_cosine"] - want[r["cluster_id"], r["rank"]][1]) < 1e-5 for r in got)


def brute_neighbours(rows, k=5, least=0.70):
    x = np.array([r[3] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    owner = np.array([f"{r[1]}|{r[2]}" for r in rows])
    s[owner[:, None] == owner[None]] = -1
    out = set()
    for i in range(len(rows)):
        best = sorted((-s[i, j], rows[j][0]) for j in np.nonzero(s[i] >= least)[0])[:k]
        out |= {(rows[i][0], j) for _, j in best}
    return out


def test_exact_with_factors_of_one(spark):
    rows, df = frame(spark, grouped(4, 20, 8, 100))
    got = nearest(df, shard_factor=1.0, tree_factor=1.0, partitions=1)
    assert {(r["id"], r["neighbour"]) for r in got.collect()} == brute_neighbours(rows)


@pytest.mark.parametrize("max_cell", [20_000, 50])
def test_copies_and_split_cells(spark, max_cell):
    """A third of all rows are one vector: copies of one point, in many entities."""
    rows, df = frame(spark, grouped(5, 15, 10, 60), copies=110)
    got = {(r["id"], r["neighbour"]) for r in nearest(df, shard_factor=1.0, tree_factor=1.0, max_cell=max_cell).collect()}
    assert got == brute_neighbours(rows)


def test_many_copies_of_one_owner_take_no_places(spark):
    """Eight near vectors of one entity, each stored seven times, and farther ones of others: all five places are filled."""
    g = np.random.default_rng(11)
    c = g.normal(size=384)
    c /= np.linalg.norm(c)
    off = lambda size: (c + size * (e := g.normal(size=384)) / np.linalg.norm(e)).astype(np.float32)
    rows = [(f"own{i}-{k}", "A", "one", [float(y) for y in v], None) for i, v in enumerate([off(0.1) for _ in range(8)]) for k in range(7)]
    rows += [(f"other{i}", "A", f"e{i}", [float(y) for y in off(0.5)], None) for i in range(9)]
    got = {(r["id"], r["neighbour"]) for r in nearest(spark.createDataFrame(rows, SCHEMA), shard_factor=1.0, tree_factor=1.0, partitions=1).collect()}
    assert got == brute_neighbours(rows) and sum(a == "own0-0" for a, _ in got) == 5


def test_recall_with_production_settings(spark):
    rows, df = frame(spark, grouped(6, 60, 12, 900))
    want = brute_neighbours(rows)
    got = {(r["id"], r["neighbour"]) for r in nearest(df).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_empty_and_pairs(spark):
    _, df = frame(spark, grouped(7, 1, 6, 0))
    assert nearest(df.limit(0)).isEmpty() and cluster_records(df.limit(0)).isEmpty()
    found = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "c")], "id string, neighbour string")
    assert {tuple(r) for r in pairs(found).collect()} == {("a", "b"), ("a", "c")}


def test_tree_alone():
    x = grouped(8, 40, 20, 400)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    owner = np.arange(len(x)) // 2
    s = np.round(x.astype(float) @ x.astype(float).T, 6)
    s[owner[:, None] == owner[None]] = -1
    want = np.sort(-s, axis=1)[:, :5]
    for factor, least_hits in ((1.0, 1.0), (8.0, 0.97)):
        pos, sim = VantageTree(x, owner, factor, leaf=32).search(x.astype(float), owner, 5, 0.7)
        good = -want >= 0.7
        assert (np.abs(sim - -want)[good] < 2e-6).mean() >= least_hits
        assert (sim[~good] == -1).all() or factor > 1


def test_similarities_are_those_of_double_precision():
    """Vectors in single precision are off by up to 1e-7, so one of some hundred similarities would round otherwise."""
    x = grouped(12, 60, 30, 0).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    owner = np.arange(len(x))
    pos, sim = VantageTree(x, owner).search(x, owner, 5, 0.7)
    row, col = np.nonzero(pos >= 0)
    assert len(row) > 5000 and (sim[row, col] == np.round(np.einsum("ij,ij->i", x[row], x[pos[row, col]]), 6)).all()


def written_by_shuffles(spark, since=-1):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return max([since, *(s.stageId() for s in stages)]), sum(s.shuffleWriteBytes() for s in stages if s.stageId() > since)


def test_parts_of_a_group_are_not_shuffled_against_each_other(spark):
    """Ten parts of one group: the vectors are shuffled a few times, not once for each part."""
    rows, df = frame(spark, np.random.default_rng(13).normal(size=(3000, 384)).astype(np.float32), table="A")
    df = df.cache()
    df.count()
    last, _ = written_by_shuffles(spark)
    assert cluster_records(df, max_cell=600).count() == len(rows)
    assert written_by_shuffles(spark, last)[1] < 5 * len(rows) * 384 * 4
