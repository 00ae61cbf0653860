"""Set-based trees against a small incremental build, and the tree invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octaray import queries
from octaray.functions.geometry import BOX
from octaray.operators import bvh, indexed, rays, treelets, trees
from octaray.operators import triangles as tri_ops
from octaray.plans import schedule as plan
from octaray.plans.schedule import LevelConfig
from octaray.sources.scratch import settle
from octaray.sources.tables import triangles

SCENE = (0.0, 0.0, 0.0, 16.0, 16.0, 16.0)


def axis_of(box):
    x, y, z = (box[i + 3] - box[i] for i in range(3))
    return 0 if x > y and x > z else 1 if y > z else 2


def split(box, kind, first_two):
    axis = axis_of(box)
    if kind == "kdtree":
        value = max((p[axis] + p[axis + 3]) / 2 for p in first_two)
        low, high = list(box), list(box)
        low[axis + 3] = high[axis] = value
        return [tuple(low), tuple(high)]
    n = {"octree": [2, 2, 2], "quadtree": [1 if i == axis else 2 for i in range(3)], "bvh": [2 if i == axis else 1 for i in range(3)]}[kind]
    step = [(box[i + 3] - box[i]) / n[i] for i in range(3)]
    out = []
    for i in range(n[0]):
        for j in range(n[1]):
            for k in range(n[2]):
                lo = [box[a] + step[a] * c for a, c in enumerate((i, j, k))]
                out.append((*lo, *(v + s for v, s in zip(lo, step, strict=True))))
    return out


def touch(a, b):
    return all(a[i] <= b[i + 3] and a[i + 3] >= b[i] for i in range(3))


class Node:
    def __init__(self, box):
        self.box, self.prims, self.children = box, [], []


def insert(node, prim, depth, kinds):
    """One primitive at a time: a leaf above the deepest level splits the moment it holds two."""
    if node.children:
        for child in node.children:
            if touch(prim[1], child.box):
                insert(child, prim, depth + 1, kinds)
        return
    node.prims.append(prim)
    if len(node.prims) == 2 and depth < len(kinds) - 1:
        node.children = [Node(b) for b in split(node.box, kinds[depth], [p[1] for p in node.prims])]
        held, node.prims = node.prims, []
        for p in held:
            for child in node.children:
                if touch(p[1], child.box):
                    insert(child, p, depth + 1, kinds)


def listed(node, depth=0, path=0):
    yield depth, path, node.box, len(node.prims), not node.children
    for k, child in enumerate(node.children):
        yield from listed(child, depth + 1, path * 8 + k)


@pytest.mark.parametrize("configs", [[("octree", 3)], [("kdtree", 4)], [("quadtree", 1), ("bvh", 3)], [("kdtree", 2), ("octree", 2)]])
def test_build_equals_incremental_build(spark, configs):
    rng = random.Random(str(configs))
    prims = []
    for i in range(24):
        low = [rng.randrange(0, 72) / 4 - 1 for _ in range(3)]
        prims.append((i, (*low, *(v + rng.randrange(0, 8) / 4 for v in low))))
    prims += [(100, prims[3][1]), (101, (40.0,) * 6)]
    configs = [LevelConfig(*c) for c in configs]
    kinds = plan.kinds_by_depth(configs)
    root = Node(SCENE)
    for p in prims:
        if touch(p[1], SCENE):
            insert(root, p, 0, kinds)
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in prims], "prim_id long, " + ", ".join(f"{n} double" for n in BOX))
    nodes, _ = trees.build(df, SCENE, configs)
    got = sorted((r["depth"], r["path"], tuple(r[n] for n in BOX), r["n_prims"], r["is_leaf"]) for r in nodes.collect())
    assert got == sorted(listed(root))


def test_empty_and_single(spark):
    schema = "prim_id long, " + ", ".join(f"{n} double" for n in BOX)
    nodes, prims = trees.build(spark.createDataFrame([], schema), SCENE, [LevelConfig("octree", 2)])
    assert [(r["depth"], r["n_prims"], r["is_leaf"]) for r in nodes.collect()] == [(0, 0, True)]
    assert prims.count() == 0


def test_schedule():
    hybrid = [LevelConfig("quadtree", 2), LevelConfig("octree", 3)]
    assert plan.kinds_by_depth(hybrid) == ["quadtree"] * 4 + ["octree"] * 2
    assert plan.kinds_by_depth(hybrid, "intuitive") == ["quadtree"] * 2 + ["octree"] * 4


TRI = "triangle_id long, ax double, ay double, az double, bx double, b_y double, bz double, cx double, cy double, cz double"


def some_triangles(spark, n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = [rng.uniform(0, 50) for _ in range(3)]
        rows.append((i, *a, *(v + rng.uniform(-4, 4) for v in a), *(v + rng.uniform(-4, 4) for v in a)))
    return spark.createDataFrame(rows, TRI)


@pytest.mark.parametrize("finish", [4096, 16])
def test_hierarchy_invariants(spark, finish):
    n = 60
    nodes = bvh.build(some_triangles(spark, n), finish=finish).toPandas()
    assert len(nodes) == 2 * n - 1 and nodes["node_id"].is_unique
    inner = nodes[nodes["left_id"].notna()]
    children = sorted([*inner["left_id"].astype(int), *inner["right_id"].astype(int)])
    assert children == sorted(set(children)) and len(children) == 2 * n - 2
    root = nodes[~nodes["node_id"].isin(children)].iloc[0]
    assert root["n_tri"] == n and root["min_x"] == nodes["min_x"].min() and root["max_z"] == nodes["max_z"].max()


def test_rounds_and_finish_agree(spark):
    tri = some_triangles(spark, 40)
    made = [bvh.build(tri, radius=3, finish=f, span=s).select("node_id", "left_id", "right_id", "n_tri").toPandas().sort_values("node_id").fillna(-1).astype(int) for f, s in ((4096, 4096), (1, 7), (9, 4096))]
    assert made[0].values.tolist() == made[1].values.tolist() == made[2].values.tolist()


def test_a_round_of_spans_equals_the_joins(spark):
    clusters = settle(bvh.clusters_of(bvh.leaves(some_triangles(spark, 90))))
    nodes, _ = bvh.step(clusters, 90, radius=4)
    after, made = bvh._round(clusters, 90, 90, 4, 11)
    columns = ["node_id", *BOX, "n_tri", "left_id", "right_id"]
    assert sorted(map(tuple, after.filter("node_id >= 90").select(*columns).collect())) == sorted(map(tuple, nodes.select(*columns).collect()))
    assert made == nodes.count() and sorted(r["pos"] for r in after.collect()) == list(range(90 - made))


def test_hierarchy_of_none_and_one(spark):
    assert bvh.build(some_triangles(spark, 0)).count() == 0
    assert bvh.build(some_triangles(spark, 1)).count() == 1


def test_indexed_rays_equal_bruteforce(spark):
    rng = random.Random(9)
    rows = [(i, *(rng.uniform(-10, 60) for _ in range(3)), *(rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(3))) for i in range(300)]
    r = spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    tri = some_triangles(spark, 250).unionByName(some_triangles(spark, 1, 8).withColumn("triangle_id", F.lit(900).cast("long")))
    want = sorted(map(tuple, rays.nearest_bruteforce(r, tri).collect()))
    assert want and sorted(map(tuple, indexed.nearest_indexed(r, tri).collect())) == want
    for configs in ([plan.LevelConfig("kdtree", 4)], [plan.LevelConfig("quadtree", 1), plan.LevelConfig("octree", 2)]):
        assert sorted(map(tuple, indexed.through_tree(r, tri, configs).collect())) == want


RAY_SCHEMA = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


def crossing_rays(spark, n, seed=9):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, *(rng.uniform(-10, 60) for _ in range(3)), *(rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(3))) for i in range(n)], RAY_SCHEMA)


def test_small_treelets_give_the_same_hits(spark):
    """Levels in joins above treelets of a few triangles, leaves of several treelets, and rounds bounded by the best hit."""
    r, tri = crossing_rays(spark, 200), some_triangles(spark, 300)
    want = sorted(map(tuple, rays.nearest_bruteforce(r, tri).collect()))
    nodes = settle(bvh.build(tri))
    assert indexed.hierarchy_index(nodes, tri, 16).links.count() > 30
    found = [
        indexed.through_hierarchy(r, tri, nodes, 16), indexed.through_hierarchy(r, tri, nodes), indexed.nearest_indexed(r, tri, 20),
        indexed.through_tree(r, tri, [LevelConfig("octree", 1), LevelConfig("kdtree", 2)], inside=20), indexed.through_node_tree(r, tri, nodes, [LevelConfig("octree", 2)], inside=60),
    ]
    for hits in found:
        assert sorted(map(tuple, hits.collect())) == want


def test_branches_in_tasks_equal_rounds(spark):
    prims = tri_ops.bounds(some_triangles(spark, 150)).withColumnRenamed("triangle_id", "prim_id")
    scene = (0.0, 0.0, 0.0, 64.0, 64.0, 64.0)
    for configs in ([LevelConfig("kdtree", 2), LevelConfig("quadtree", 2)], [LevelConfig("octree", 2), LevelConfig("bvh", 2)]):
        one, other = (trees.build(prims, scene, configs, inside=n) for n in (0, 1 << 15))
        third = trees.build(prims, scene, configs, inside=40)
        for a, b, c in zip(one, other, third, strict=True):
            columns = sorted(a.columns)
            rows = [sorted(map(tuple, x.select(*columns).collect())) for x in (a, b, c)]
            assert rows[0] == rows[1] == rows[2] and rows[0]


def test_large_triangles_have_one_place_each(spark):
    """One triangle in a hundred spans the scene: still one row for each, and the same hits."""
    tri = some_triangles(spark, 400)
    big = some_triangles(spark, 4, 3).select((F.col("triangle_id") + 1000).alias("triangle_id"), *[(F.col(c) * 40 - 900).alias(c) for c in tri.columns[1:]])
    both = settle(tri.unionByName(big))
    index = indexed.grid_index(both, 25)
    assert index.treelets.agg(F.sum(F.size("ids"))).first()[0] == 404 and index.links is not None
    r = crossing_rays(spark, 200, 4)
    assert sorted(map(tuple, indexed.through(r, index).collect())) == sorted(map(tuple, rays.nearest_bruteforce(r, both).collect()))


def test_rays_beside_nodes_without_triangles(spark):
    tri = some_triangles(spark, 1)
    r = crossing_rays(spark, 20)
    nodes = settle(bvh.build(tri))
    assert indexed.through_node_tree(r, tri, nodes, [LevelConfig("octree", 2)]).count() == rays.nearest_bruteforce(r, tri).count()
    none = tri.limit(0)
    assert indexed.through_hierarchy(r, none, settle(bvh.build(none))).count() == 0


def test_planar_scene_is_hit_through_the_index(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 4.0, 0.0, 5.0, 0.0, 4.0, 5.0)], TRI)
    r = spark.createDataFrame([(7, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert [tuple(x) for x in indexed.nearest_indexed(r, tri).collect()] == [(7, 5.0, 1)]
    assert [tuple(x) for x in indexed.through_tree(r, tri, [plan.LevelConfig("octree", 2)]).collect()] == [(7, 5.0, 1)]


def test_rays_without_triangles(spark):
    r = spark.createDataFrame([(7, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    none = spark.createDataFrame([], TRI)
    for found in (rays.nearest_bruteforce(r, none), indexed.nearest_indexed(r, none), indexed.through_tree(r, none, [plan.LevelConfig("octree", 2)])):
        assert found.count() == 0


def test_large_leaves_are_packed():
    rng = np.random.default_rng(5)
    low = rng.integers(0, 40, (3000, 3)).astype(float)
    prims = np.hstack([low, low + rng.integers(0, 3, (3000, 3))])
    prims[:200] = prims[0]  # many at one place
    root = np.array([0.0, 0, 0, 44, 44, 44])
    none = np.zeros(0, np.int64)
    one = lambda v: np.array([v])
    flat = treelets.Treelet(root.reshape(1, 6), one(0), one(0), one(0), one(3000), np.arange(3000), one(0), one(0), one(3000))
    cells, order = treelets.layered(rng.integers(0, 3, 3000), np.zeros(3000, np.int64), prims, 0)  # cells with children and boxes of their own
    grown = treelets.grow(prims, root, 0, 0, ["octree", "octree"])
    for tree, boxes in ((flat, prims), (cells, prims[order]), (grown, prims)):
        out = treelets.packed(tree, boxes)
        assert out.count.max() <= treelets.LEAF
        seen, held = np.array([0]), []
        while len(seen):
            held.append(out.held[treelets.runs(out.start[seen], out.count[seen])[1]])
            of, child = treelets.runs(out.first[seen], out.kids[seen])
            seen = child
        assert sorted(np.concatenate(held)) == sorted(tree.held)
    # A ray that starts before 3000 stacked boxes tests a few of them, not all.
    tested = []

    def meet(r, held):
        tested.append(held.size)
        return prims[held, 0], np.ones(held.shape, bool)

    o, d = np.array([[-1.0, 20.5, 20.5]]), np.array([[1.0, 0.0, 0.0]])
    treelets.search(treelets.packed(flat, prims), np.arange(3000), o, d, np.array([np.inf]), meet)
    assert 0 < sum(tested) < 600


def test_joined_visits_and_links_in_arrays_agree(spark, small, monkeypatch):
    from octaray.sources.tables import rays as ray_table

    r, t = ray_table(spark, small), triangles(spark, small)
    index = indexed.tree_index(indexed._prims(t), (0.0, 0.0, -16.0, 64.0, 128.0, 112.0), [LevelConfig("kdtree", 3)], inside=8)
    state = rays._spread(r).withColumn("best", F.lit(None).cast("double"))
    one = sorted(map(tuple, indexed.visits(state, index).select("ray_id", *indexed.KEY).collect()))
    monkeypatch.setattr(indexed, "LINKS", 0)
    assert one == sorted(map(tuple, indexed.visits(state, index).select("ray_id", *indexed.KEY).collect())) and one


def test_brute_force_forms_no_pairs_that_cannot_meet(spark, small, monkeypatch):
    """Rays meet only the blocks that they enter, and every block's nearest hit is one row."""
    from octaray.sources.tables import rays as ray_table

    r, t = ray_table(spark, small), triangles(spark, small)
    index = indexed.grid_index(t, 16)
    state = rays._spread(r).withColumn("best", F.lit(None).cast("double"))
    blocks = index.links.filter("NOT inner").count()
    assert 0 < indexed.visits(state, index).count() < r.count() * blocks / 2
    hits = indexed.all_hits(r, t, inside=16)
    near = indexed.all_hits(r, t, "nearest", inside=16)
    assert sorted(map(tuple, rays.nearest(hits).collect())) == sorted(map(tuple, rays.nearest(near).collect()))


def test_depths_take_few_rounds(spark, monkeypatch):
    n = 100  # a chain: node i has the children i + 1 and n + i
    rows = [(i, i + 1, n + i) for i in range(n - 1)] + [(n - 1, None, None)] + [(n + i, None, None) for i in range(n - 1)]
    nodes = settle(spark.createDataFrame(rows, "node_id long, left_id long, right_id long"))
    rounds = []
    monkeypatch.setattr(bvh, "settle", lambda df: (rounds.append(1), settle(df))[1])
    got = dict(map(tuple, bvh.depths(nodes).collect()))
    assert got == {**{i: i for i in range(n)}, **{n + i: i + 1 for i in range(n - 1)}}
    assert len(rounds) <= 9


def test_rounds_send_nodes_to_the_pairs(spark, monkeypatch):
    """A node's pairs are not read by one task: neither planes nor empty cells join pairs by their path."""
    seen = []
    monkeypatch.setattr(trees, "few", lambda nodes: (seen.append(nodes.columns), F.broadcast(nodes))[1])
    prims = tri_ops.bounds(some_triangles(spark, 150)).withColumnRenamed("triangle_id", "prim_id")
    nodes, held = trees.build(prims, indexed._scene(prims), [LevelConfig("kdtree", 3)], inside=8)
    assert ["path", "a"] in seen and any("child" in s for s in seen) and ["path", "is_leaf", "is_cut"] in seen
    plan_ = trees.empty_cells(nodes, held)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [depth" in plan_


def _searched(n, monkeypatch):
    """Rays through ``n`` triangles in one packed leaf: the hits, those of all pairs, and the boxes that each ray is tested with."""
    rng = np.random.default_rng(3)
    corner = (rng.uniform(0, 1, (n, 1, 3)) * [160, 20, 20] + rng.uniform(0, 2, (n, 3, 3))).reshape(n, 9)
    box = np.hstack([corner.reshape(n, 3, 3).min(axis=1), corner.reshape(n, 3, 3).max(axis=1)])
    root = np.hstack([box[:, :3].min(axis=0), box[:, 3:].max(axis=0)])[None]
    none = np.zeros(1, np.int64)
    tree = treelets.packed(treelets.Treelet(root, none, none, none, np.array([n]), np.arange(n), none, none, none), box)
    o = np.stack([np.full(400, 190.0), rng.uniform(4, 16, 400), rng.uniform(4, 16, 400)], axis=1)
    d = np.stack([np.full(400, -1.0), rng.integers(-2, 3, 400) / 64, np.zeros(400)], axis=1)
    k = rays._coefficients({c: corner[:, i] for i, c in enumerate(rays.CORNER)})

    def meet(r, held):
        own = {f"{p}{x}": v[r, i] for p, v in (("o", o), ("d", d)) for i, x in enumerate("xyz")}
        return rays._meet(own, {key: [c[held] for c in v] if isinstance(v, list) else v[held] for key, v in k.items()})

    tested, entry = [], treelets.entry
    monkeypatch.setattr(treelets, "entry", lambda *a: tested.append(len(a[0])) or entry(*a))
    ids = np.arange(n) * 7 % n
    got = treelets.search(tree, ids, o, d, np.full(400, np.inf), meet)
    monkeypatch.undo()
    t, hit = meet(np.arange(400)[:, None], np.arange(n)[None, :])
    t = np.where(hit, t, np.inf)
    least = t.min(axis=1)
    return got, least, np.where(t == least[:, None], ids[None, :], n).min(axis=1), sum(tested) / 400


def test_dense_triangles_cost_a_ray_its_first_share_only(monkeypatch):
    (ray, t, name), least, first, tested = _searched(9973, monkeypatch)
    assert set(ray.tolist()) == set(np.flatnonzero(np.isfinite(least)).tolist())
    assert (t == least[ray]).all() and (name == first[ray]).all()
    assert tested < 240


def test_nearest_takes_each_pair_once(monkeypatch):
    boxes = np.random.default_rng(4).integers(0, 3, (300, 6)).astype(float)  # many equal areas
    boxes[:, 3:] += boxes[:, :3]

    def area(i, j):
        x, y, z = np.maximum(boxes[i, 3:], boxes[j, 3:]) - np.minimum(boxes[i, :3], boxes[j, :3])
        return 2 * x * y + 2 * z * y + 2 * x * z

    expected = [min((area(i, j), j) for j in range(max(0, i - 16), min(300, i + 17)) if j != i)[1] for i in range(300)]
    pairs, maximum = [], np.maximum
    monkeypatch.setattr(np, "maximum", lambda a, b: pairs.append(1) or maximum(a, b))
    got = bvh._nearest(boxes, 16)
    monkeypatch.undo()
    assert got.tolist() == expected and len(pairs) == 16
    assert bvh._nearest(boxes[:1], 16).tolist() == [-1]


def test_queries_of_nodes_write_no_held_primitives(spark, small, monkeypatch):
    written = []

    def spy(df):
        written.append(settle(df))
        return written[-1]

    monkeypatch.setattr(trees, "settle", spy)
    monkeypatch.setattr(queries, "settle", spy)
    for name in ("remove_empty", "removed_count", "collapse"):
        assert queries.QUERIES[name](spark, small).count()
    assert not any(t.filter("prim_id IS NOT NULL").count() for t in written if "prim_id" in t.columns)


def test_nodes_alone_equal_the_whole_build(spark):
    df = spark.createDataFrame([(i, *(float(v) for v in (i, i, 1, i + 1, i + 2, 2))) for i in range(12)], ["prim_id", *BOX])
    for kind, inside in (("octree", 100), ("kdtree", 4)):
        nodes = trees.build_nodes(df, SCENE, [LevelConfig(kind, 2)], inside=inside)
        whole, _ = trees.build(df, SCENE, [LevelConfig(kind, 2)], inside=inside)
        assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, whole.collect()))


def test_equal_rays_are_compared_once(spark, monkeypatch):
    tri = spark.createDataFrame([(i, 0.0, -1.0, -1.0 + i, 0.0, 3.0, -1.0, 0.0, -1.0, 3.0) for i in range(3)], ["triangle_id", *rays.CORNER])
    few = [(i, 5.0, 0.1 * (i % 2), 0.2, -1.0, 0.0, 0.0) for i in range(40)] + [(99, 5.0, 50.0, 0.2, -1.0, 0.0, 0.0)]
    r = spark.createDataFrame([*few, few[0]], ["ray_id", *rays.RAY])
    monkeypatch.setattr(indexed, "COPIES", 8)
    asked, blocks = [], indexed._blocks
    monkeypatch.setattr(indexed, "_blocks", lambda some, *most: asked.append(some.count()) or blocks(some, *most))
    want = sorted((i, k, 5.0) for i in [*range(40), 0] for k in range(2))  # the third begins beyond the rays
    assert sorted(map(tuple, rays.triangle_hits(r, tri).select("ray_id", "triangle_id", "t").collect())) == want
    found = rays.nearest_bruteforce(r, tri)
    assert found.columns == ["ray_id", "t", "triangle_id"]
    assert sorted(map(tuple, found.collect())) == [(i, 5.0, 0) for i in range(40)]
    assert max(asked) < 20
