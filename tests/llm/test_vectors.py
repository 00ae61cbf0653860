import numpy as np
import pytest

from octaray.llm import anisotropic, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, rep long"


def frame(spark, x, more=()):
    rows = [(i, [float(v) for v in r], 0, 1) for i, r in enumerate(x)] + [(i, v, 0, 1) for i, v in more]
    return spark.createDataFrame(rows, SCHEMA)


def clustered(seed, n=900, dims=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for at in range(0, n // 3, 6):
        x[at + 1 : at + 6] = x[at] + rng.normal(size=(5, dims)) * 0.25
    x[600:760] = x[599] + rng.normal(size=(160, dims)) * 0.12
    x[760:860] = x[5]
    return x.astype(np.float32)


BAD = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] + [1.0] * 23), (5004, [float("inf")] * 24), (5005, []), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]


def test_links_equal_brute_force(spark):
    x = clustered(1)
    got = {r["vec_id"]: r for r in hnsw.near_duplicate_vectors(frame(spark, x, BAD)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    count = near.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= count).all() and found.sum() >= 0.999 * count.sum()
    top = np.arange(len(x))
    while True:
        after = np.array([min(top[i], top[near[i]].min(initial=top[i])) for i in range(len(x))])
        if (after == top).all():
            break
        top = after
    assert [got[i]["component_id"] for i in range(len(x))] == top.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(5000, 5006))
    assert got[5007]["component_id"] == 5006 and got[5006]["n_links"] == 1
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_many_shards_are_not_all_asked(spark, monkeypatch):
    """With many shards, a vector asks those that can hold its links; a cell that is too large is several shards."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    moved = x[:400] / np.linalg.norm(x[:400], axis=1, keepdims=True)
    x[400:800] = hnsw.planted(moved, 0.9, 400, rng)
    x[800:1300] = x[800] + rng.normal(size=(500, 64)) * 0.1
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    asked, routed = [], hnsw._routed

    def spy(nodes, n, size, shards, least):
        placed, some = routed(nodes, n, size, shards, least)
        asked.append((placed.count(), placed.groupBy("shard").count().agg({"count": "max"}).first()[0], some.groupBy("rep", "shard").count().count() / (n * placed.select("shard").distinct().count())))
        return placed, some

    monkeypatch.setattr(hnsw, "_routed", spy)
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicate_vectors(frame(spark, x, BAD)).collect()}
    (placed, largest, share), = asked
    assert placed == 3002 and largest < 200 and share < 0.6
    found = np.array([got[i] for i in range(3000)])
    assert (found <= true).all() and found[800:1300].sum() >= 0.999 * true[800:1300].sum()
    assert found[:800].sum() >= 0.99 * true[:800].sum()
    assert got[5007] == 1 and got[5000] == 0


def test_beams_widen_until_the_audit_passes():
    x = clustered(3, 1200)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u = np.unique(u, axis=0)
    graph = hnsw.Graph(u)
    ids = np.arange(len(u))
    links = hnsw.Links(ids, ids, np.ones(len(u)))
    asked, got = hnsw.find_links(graph, u, u, 0.9, 1, links)
    true = u @ u.T >= 0.9
    np.fill_diagonal(true, False)
    assert asked > 0 and got >= 0.995 * asked
    assert (links.weight <= true.sum(axis=1)).all() and links.weight.sum() >= 0.999 * true.sum()
    assert sum(len(e[0]) for e in links.edges) < len(u)


def test_audits_measure_where_no_query_has_links(spark):
    """Vectors far from each other: what is looked for is planted, found, and left out of the result."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    nodes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep long, weight long, vector array<float>")
    found = hnsw.vector_links(nodes, 0.9)
    audit = hnsw.audited_recall(found).first()
    assert audit["links"] >= 1000 and audit["recall"] >= hnsw.AUDIT_RECALL
    assert found.filter("kind <> 2").count() == 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (hnsw.planted(u.astype(np.float64), 0.9, 200, rng) @ u.T).max(axis=1)
    assert (near >= 0.9 - 1e-6).all() and near.min() < 0.92 and near.max() > 0.98
    assert np.allclose(hnsw.planted(np.ones((3, 1)), 0.9, 5, rng), 1)


@pytest.mark.parametrize("links", [3, 6])
def test_a_poor_graph_loses_no_link(links):
    """With few links a node, the first beams miss links, or no beam reaches them: they widen until nothing is missed."""
    rng = np.random.default_rng(9)
    u = rng.normal(size=(600, 24))
    u[400:] = u[:200] + rng.normal(size=(200, 24)) * 0.25
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    graph, ids = hnsw.Graph(u), np.arange(len(u))
    graph.layers[0].near[:, links:] = -1
    true = u @ u.T >= 0.9
    q, v, _ = hnsw._met(graph, u[graph.order], u, 0.9, hnsw.BEAM)
    assert links > 3 or len(q) < 0.9 * true.sum()
    found = hnsw.Links(ids, ids, np.ones(len(u)))
    asked, got = hnsw.find_links(graph, u, u, 0.9, 1, found)
    assert got >= hnsw.AUDIT_RECALL * asked and (found.weight <= true.sum(axis=1) - 1).all()
    assert found.weight.sum() >= 0.995 * (true.sum() - len(u)) > 300 and (links > 3 or found.weight.sum() == true.sum() - len(u))


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, None), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (2, [1.0, 0.01])]
    got = hnsw.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 2, 1, True), (1, 0, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True)]))


def test_a_shard_of_near_copies_stays_small():
    """Pairs go with the square of the group, memory does not."""
    import tracemalloc

    rng = np.random.default_rng(8)
    u = rng.normal(size=16) + rng.normal(size=(4000, 16)) * 0.02
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    graph, ids = hnsw.Graph(u), np.arange(len(u))
    links = hnsw.Links(ids, ids, np.ones(len(u)))
    tracemalloc.start()
    hnsw.find_links(graph, u, u, 0.9, 1, links)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links.weight == len(u) - 1).all() and sum(len(e[0]) for e in links.edges) == len(u) - 1
    assert peak < 250_000_000


def test_no_vectors(spark):
    assert hnsw.near_duplicate_vectors(frame(spark, [])).count() == 0
    assert hnsw.near_duplicate_vectors(frame(spark, [], BAD[:1])).first()["kept"]
    assert anisotropic.search(frame(spark, []), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", [False, True])
def test_search_recall_and_order(spark, scale):
    x = clustered(2)
    if scale:
        x *= np.random.default_rng(0).uniform(0.3, 3, (len(x), 1)).astype(np.float32)
    got = anisotropic.search(frame(spark, x, BAD), lambda i: i % 20 == 0).toPandas()
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    hits = total = 0
    for i in range(0, len(x), 20):
        want = np.lexsort((np.arange(len(x)), -s[i]))[:20]
        mine = got[got["query_id"] == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], s[i][mine["vec_id"]], rtol=1e-12)
        assert list(zip(-mine["score"], mine["vec_id"], strict=True)) == sorted(zip(-mine["score"], mine["vec_id"], strict=True))
        hits, total = hits + len(set(want) & set(mine["vec_id"])), total + 20
    assert hits >= 0.97 * total and set(got["query_id"]) == set(range(0, len(x), 20))


def test_few_candidates_and_copies(spark):
    x = np.array([[1, 0, 0, 0]] * 45 + [[0.5, 0, 0, 0]], dtype=np.float32)
    got = anisotropic.search(frame(spark, x), lambda i: i % 20 == 0).toPandas()
    for i in (0, 20, 40):
        assert got[got["query_id"] == i].sort_values("rank")["vec_id"].tolist() == [j for j in range(45) if j != i][:20]
    assert anisotropic.search(frame(spark, x[:3]), lambda i: i % 20 == 0).count() == 2


@pytest.mark.parametrize("noise", [0.3, 0.02])
def test_search_is_exact_in_a_group_of_near_copies(spark, noise):
    """A third of the rows are unequal copies of one vector: more than the first reranking of a block looks at."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 23)) * rng.uniform(0.5, 2, (2400, 1))
    x[800:1600] = x[800] + rng.normal(size=(800, 23)) * noise
    x = x.astype(np.float32)
    got = anisotropic.search(frame(spark, x, BAD), lambda i: i % 20 == 0).toPandas()
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    for i in range(0, len(x), 20):
        want = np.lexsort((np.arange(len(x)), -s[i]))[:20]
        assert got[got["query_id"] == i].sort_values("rank")["vec_id"].tolist() == want.tolist()


def test_ties_at_the_cut_go_to_the_smaller_id(spark):
    x = np.zeros((400, 400), dtype=np.float32)
    x[:, 0] = 1
    x[np.arange(1, 400), np.arange(1, 400)] = 1
    got = anisotropic.search(frame(spark, x), lambda i: i == 0).toPandas().sort_values("rank")
    assert got["vec_id"].tolist() == list(range(1, 21)) and (got["score"] == 1).all()


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(6)
    ids = [20, 20, 40, *range(1, 19), 3]
    x = rng.normal(size=(len(ids), 8))
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, row string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in anisotropic.search(df, lambda i: i % 20 == 0).collect())
    want = []
    for q in (0, 1, 2):
        near = sorted((-float(x[q] @ v), i) for n, (i, v) in enumerate(zip(ids, x, strict=True)) if n != q)[:20]
        want += [(ids[q], rank, i, round(-s, 9)) for rank, (s, i) in enumerate(near, 1)]
    assert got == sorted(want) and len(got) == 60
