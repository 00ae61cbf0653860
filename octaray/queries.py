"""The library's queries over the driver's tables, each with SQL for the same rows written on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.camera import Camera
from .functions.geometry import BOX, longest_axis, surface
from .operators import boxes as box_ops
from .operators import bvh, indexed, misc, rays, scenes, trees
from .operators import triangles as tri_ops
from .operators.scans import running_sum
from .oracles import ORACLE_SQL
from .plans import schedule as plan
from .plans.schedule import LevelConfig
from .sources.scratch import settle
from .sources.tables import BOX_SCENE, TRIANGLE_SCENE, boxes, meshes, table, triangles, vertices
from .sources.tables import rays as ray_table

__all__ = ["ORACLE_SQL", "QUERIES"]

SCHEDULES = {
    "tree_octree": [LevelConfig("octree", 4)],
    "tree_quadtree": [LevelConfig("quadtree", 4)],
    "tree_bvh": [LevelConfig("bvh", 6)],
    "tree_kdtree": [LevelConfig("kdtree", 5)],
    "tree_hybrid": [LevelConfig("quadtree", 2), LevelConfig("octree", 3)],
    "custom_split": [LevelConfig("thirds", 3)],
}
CAMERA, SAMPLES = Camera(eye=(120.0, 50.0, 48.0), look_at=(20.0, 50.0, 48.0), far=120.0), 4
QUERY_BOX = (8.0, 2.0, 2.0, 32.0, 10.0, 12.0)
WIDE_SCENE = (-64.0, -128.0, -16.0, 448.0, 128.0, 112.0)
RAY_BOX = (10.0, 10.0, 10.0, 50.0, 60.0, 70.0)
MATRIX = ((0.0, -2.0, 0.0, 1.0), (1.0, 0.0, 0.0, -3.0), (0.0, 0.5, -1.0, 2.0))
UNIT = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))
HALF = ((0.5, 0.0, 0.0, 10.0), (0.0, 0.5, 0.0, 20.0), (0.0, 0.0, 0.5, 30.0))
NODE_COLUMNS = ("depth", "path", "cls", *BOX, "n_prims", "is_leaf")


def thirds() -> Column:
    """A user split: three slabs along x."""
    return plan._grid((3, 1, 1))


plan.register_split("thirds", thirds)  # without arrays: every level is a round


def _tree(spark, sf_dir, name):
    nodes, prims = trees.build(boxes(spark, sf_dir), BOX_SCENE, SCHEDULES[name])
    return settle(nodes), settle(prims)


def _sparse_tree(spark, sf_dir, name):
    """A tree of all boxes in a scene that is larger than they need: the cells of fixed splits mostly stay empty."""
    nodes, prims = trees.build(boxes(spark, sf_dir), WIDE_SCENE, SCHEDULES[name])
    return settle(nodes), settle(prims)


def _sparse_nodes(spark, sf_dir, name):
    """The nodes of ``_sparse_tree``, for queries that do not read what leaves hold."""
    return settle(trees.build_nodes(boxes(spark, sf_dir), WIDE_SCENE, SCHEDULES[name]))


def _tree_query(name):
    return lambda spark, sf_dir: trees.build_nodes(boxes(spark, sf_dir), BOX_SCENE, SCHEDULES[name]).select(*NODE_COLUMNS)


def level_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of node that each part's level has in every schedule; parts take turns through the levels."""
    kinds = {name: plan.kinds_by_depth(c) for name, c in SCHEDULES.items()}
    rows = [F.struct(F.lit(n).alias("name"), F.lit(k).alias("kinds")) for n, k in kinds.items()]
    each = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*rows)).alias("s"))
    depth = (F.col("p_partkey") % F.size("s.kinds")).cast("int")
    return each.select("p_partkey", "s.name", depth.alias("depth"), F.element_at("s.kinds", depth + 1).alias("cls"))


def camera_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera's ray of every customer: customers take turns through the rays of the image."""
    ids = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % (CAMERA.width * CAMERA.height * SAMPLES)).alias("id"))
    made = rays.camera_rays(spark, CAMERA, SAMPLES, ids.select("id").distinct())
    named = ids.join(made, F.col("id") == F.col("ray_id"))
    return named.select("c_custkey", "ray_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in rays.RAY])


def box_transform(spark, sf_dir):
    source = boxes(spark, sf_dir)
    plain = box_ops.transform(source, MATRIX)
    exact = box_ops.transform(source, MATRIX, exact=True).select("prim_id", *[F.col(n).alias(f"exact_{n}") for n in BOX])
    return plain.join(exact, "prim_id")


def split_axis(spark, sf_dir):
    size = tuple(F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz")
    return boxes(spark, sf_dir).select("prim_id", longest_axis(size).alias("axis"))


def union_area(spark, sf_dir):
    """Surface area of the union of every box with the query box."""
    size = tuple(F.greatest(F.col(f"max_{x}"), F.lit(QUERY_BOX[i + 3])) - F.least(F.col(f"min_{x}"), F.lit(QUERY_BOX[i])) for i, x in enumerate("xyz"))
    return boxes(spark, sf_dir).select("prim_id", surface(size).alias("area"))


def _with_mesh(spark, sf_dir):
    tri = triangles(spark, sf_dir)
    return tri_ops.with_mesh(tri, meshes(tri))


def mesh_aabb(spark, sf_dir):
    held = _with_mesh(spark, sf_dir)
    corner = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")) for x, y, z in (("ax", "ay", "az"), ("bx", "b_y", "bz"), ("cx", "cy", "cz"))])
    return tri_ops.mesh_bounds(held.select("mesh_id", F.inline(corner)), "mesh_id")


def scene_flatten(spark, sf_dir):
    vertex, index = vertices(triangles(spark, sf_dir))
    v, i = tri_ops.flatten([(vertex, index, UNIT), (vertex, index, HALF)])
    return tri_ops.assemble(i, v.select("vertex_id", "x", "y", "z"))


def component_naming(spark, sf_dir):
    """Suppliers named 'CADModel <n>'; names of the nations' numbers are taken."""
    used = table(spark, sf_dir, "nation").select(F.concat_ws(" ", F.lit("CADModel"), (F.col("n_nationkey") * 3).cast("string")).alias("name"))
    return tri_ops.name_components(table(spark, sf_dir, "supplier").select("s_suppkey"), "CADModel", "s_suppkey", used)


def _hits(spark, sf_dir):
    return ray_table(spark, sf_dir), triangles(spark, sf_dir)


def external_miss0(spark, sf_dir):
    r, t = _hits(spark, sf_dir)
    return rays.with_misses(r, indexed.through_hierarchy(r, t, settle(bvh.build(t)))).select("ray_id", F.coalesce("t", F.lit(0.0)).alias("t"))


def ray_query_hierarchy(spark, sf_dir):
    r, t = _hits(spark, sf_dir)
    return indexed.through_hierarchy(r, t, settle(bvh.build(t)))


def ray_query_node_tree(spark, sf_dir):
    """Two flattened models, the hierarchy of their triangles, a hybrid tree over its nodes, and rays through that."""
    tri = settle(scene_flatten(spark, sf_dir))
    return indexed.through_node_tree(ray_table(spark, sf_dir), tri, settle(bvh.build(tri)), SCHEDULES["tree_hybrid"])


def ray_any_hit(spark, sf_dir):
    r, t = _hits(spark, sf_dir)
    return indexed.nearest_indexed(r, t).select("ray_id")


def _ray_tree_query(name):
    return lambda spark, sf_dir: indexed.through_tree(*_hits(spark, sf_dir), SCHEDULES[name], TRIANGLE_SCENE)


def _image(spark, sf_dir):
    r = rays.camera_rays(spark, CAMERA, SAMPLES)
    return rays.depth_image(indexed.nearest_indexed(r, triangles(spark, sf_dir)), r)


def kd_split_plane(spark, sf_dir):
    """Planes of the nations' groups of orders, as if each were one node of the whole scene."""
    items = boxes(spark, sf_dir).select((F.col("prim_id") % 25).alias("path"), "prim_id", *[F.col(n).alias(f"p_{n}") for n in BOX])
    nodes = items.select("path").distinct().select("path", *[F.lit(v).alias(n) for n, v in zip(BOX, BOX_SCENE, strict=True)])
    return trees.split_planes(items, nodes)


def export_nodes(spark, sf_dir):
    nodes = settle(trees.build_nodes(boxes(spark, sf_dir), BOX_SCENE, SCHEDULES["tree_octree"]))
    return trees.preorder(nodes, 4).select("position", *BOX)


def compact_scan(spark, sf_dir):
    """Slot of every order that is open, and the running count at all of them."""
    flags = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "O").cast("long").alias("valid"))
    return running_sum(flags, "pos", "valid", inclusive=False).select("pos", "valid", F.col("running").alias("slot"))


def _leaf_clusters(spark, sf_dir):
    return bvh.clusters_of(settle(bvh.leaves(triangles(spark, sf_dir))))


def ploc_step(spark, sf_dir):
    clusters = _leaf_clusters(spark, sf_dir)
    return bvh.step(clusters, clusters.count())[0].select("node_id", *BOX, "n_tri", "left_id", "right_id")


def format_duration(spark, sf_dir):
    nanos = F.col("o_orderkey").cast("double") * F.col("o_orderkey") * F.col("o_orderkey") * 97 + 0.5
    return table(spark, sf_dir, "orders").select("o_orderkey", misc.format_duration(nanos).alias("said"))


def _graph(spark, sf_dir):
    """A node for each part: node k hangs below node k // 4, those below 4 are roots; turns, halvings and shifts."""
    k = F.col("p_partkey")
    turn = {0: (0.5, 0, 0, 0, 0.5, 0, 0, 0, 0.5), 1: (0, -1.0, 0, 1.0, 0, 0, 0, 0, 1.0), 2: (1.0, 0, 0, 0, 0, 1.0, 0, -1.0, 0)}
    shift = (F.col("p_size"), k % 7, k % 5)
    cells = [shift[r] if c == 3 else F.when(k % 3 == 0, turn[0][3 * r + c]).when(k % 3 == 1, turn[1][3 * r + c]).otherwise(turn[2][3 * r + c]) for r in range(3) for c in range(4)]
    parent = F.when(k >= 4, F.floor(k / 4))
    return table(spark, sf_dir, "part").select(k.alias("node_id"), parent.alias("parent_id"), (k % 4).alias("ord"), *[v.cast("double").alias(m) for m, v in zip(scenes.MATRIX, cells, strict=True)])


def scene_graph(spark, sf_dir):
    return scenes.pre_order(scenes.world_matrices(_graph(spark, sf_dir))).select("node_id", "depth", "size", "position", *scenes.MATRIX)


def scene_snapshots(spark, sf_dir):
    """Every supplier is a model, the mesh of its number modulo the meshes; it is added, and moved later if its key is even."""
    tri = triangles(spark, sf_dir)
    size = F.lit(100)
    mesh = tri_ops.bounds(tri).withColumn("mesh_id", F.floor(F.col("triangle_id") / size)).groupBy("mesh_id").agg(*[(F.min if n.startswith("min") else F.max)(n).alias(n) for n in BOX])
    k = F.col("s_suppkey")
    models = table(spark, sf_dir, "supplier").select(k.alias("model_id"), (k % 2).alias("mesh_id")).join(mesh, "mesh_id").drop("mesh_id")
    shift = {"add": (k * 7 % 50, k * 3 % 40, k % 9), "move": (k * 7 % 50 + 1000, k * 3 % 40 - 1000, k % 9)}

    def event(kind, seq):
        cells = [shift[kind][r] if c == 3 else F.lit(0.5 if r == c else 0.0) for r in range(3) for c in range(4)]
        return table(spark, sf_dir, "supplier").select(seq.alias("seq"), k.alias("model_id"), F.lit(kind).alias("kind"), *[v.cast("double").alias(m) for m, v in zip(scenes.MATRIX, cells, strict=True)])

    events = event("add", k * 2).unionByName(event("move", k * 2 + 5).filter("model_id % 2 = 0"))
    return scenes.scene_snapshots(events, models)


def materials(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("mesh_id"), *[(k * f % 17 / F.lit(8.0)).alias(c) for c, f in (("er", 3), ("eg", 5), ("eb", 7))], (F.col("p_size") * 20.0).alias("shininess"), (k % 4 / F.lit(4.0)).alias("ambient_r"))
    return tri_ops.material(rows)


def _sample(draw, *names):
    return lambda s, d: draw(table(s, d, "customer"), "c_custkey").select("c_custkey", *[F.round(n, 6).alias(n) for n in names])


QUERIES = {
    "box_metrics": lambda s, d: box_ops.metrics(boxes(s, d)),
    "box_transform": box_transform,
    "box_overlap_filter": lambda s, d: box_ops.overlapping(boxes(s, d), QUERY_BOX),
    "split_axis": split_axis,
    "split_binary": lambda s, d: box_ops.split(boxes(s, d), plan.midpoint_split()),
    "split_at_value": lambda s, d: box_ops.split_at(boxes(s, d), 1, 8.0),
    "split_grid": lambda s, d: box_ops.split_grid(boxes(s, d)),
    "union_area": union_area,
    "box_corners": lambda s, d: box_ops.corner_points(boxes(s, d)),
    "box_edges": lambda s, d: box_ops.edges(boxes(s, d)),
    "tri_bounds": lambda s, d: tri_ops.bounds(triangles(s, d)),
    "tri_area": lambda s, d: tri_ops.areas(triangles(s, d)),
    "tri_normal": lambda s, d: tri_ops.normals(triangles(s, d)),
    "tri_assemble": lambda s, d: tri_ops.assemble(*reversed(vertices(triangles(s, d)))),
    "mesh_range_join": lambda s, d: _with_mesh(s, d).select("triangle_id", "mesh_id"),
    "mesh_aabb": mesh_aabb,
    "mesh_area": lambda s, d: tri_ops.mesh_areas(_with_mesh(s, d)),
    "mesh_stats": lambda s, d: tri_ops.mesh_stats(_with_mesh(s, d)),
    "scene_aabb": lambda s, d: tri_ops.scene_bounds(boxes(s, d)),
    "scene_flatten": scene_flatten,
    "recenter_scale": lambda s, d: tri_ops.recenter(vertices(triangles(s, d))[0], 16.0),
    "area_cdf": lambda s, d: tri_ops.area_cdf(triangles(s, d)),
    "component_naming": component_naming,
    "camera_rays": camera_rays,
    "ray_box": lambda s, d: rays.box_hits(ray_table(s, d), RAY_BOX),
    "ray_triangle_hits": lambda s, d: rays.triangle_hits(*_hits(s, d)),
    "ray_query_bruteforce": lambda s, d: rays.nearest_bruteforce(*_hits(s, d)),
    "ray_query_indexed": lambda s, d: indexed.nearest_indexed(*_hits(s, d)),
    **{f"ray_query_{name}": _ray_tree_query(name) for name in SCHEDULES if name != "custom_split"},
    "ray_query_hierarchy": ray_query_hierarchy,
    "ray_query_node_tree": ray_query_node_tree,
    "ray_query_external_miss0": external_miss0,
    "ray_any_hit": ray_any_hit,
    "depth_image": _image,
    "image_normalize": lambda s, d: rays.normalize_image(_image(s, d)).select("px", "py", *[F.round(c, 6).alias(c) for c in "rgb"], "a"),
    "image_quantize": lambda s, d: rays.quantize_image(rays.normalize_image(_image(s, d)), CAMERA.height),
    "normal_to_rgb": lambda s, d: rays.normal_colors(tri_ops.normals(triangles(s, d))),
    "level_schedule": level_schedule,
    **{name: _tree_query(name) for name in SCHEDULES},
    "kd_split_plane": kd_split_plane,
    "tree_stats": lambda s, d: trees.stats(*_tree(s, d, "tree_octree"), 4),
    "remove_empty": lambda s, d: trees.remove_empty(_sparse_nodes(s, d, "tree_kdtree")).select("depth", "path", "n_prims", "is_leaf"),
    "removed_count": lambda s, d: trees.removed_count(_sparse_nodes(s, d, "tree_octree")),
    "collapse_once": lambda s, d: trees.collapse_once(trees.remove_empty(_sparse_nodes(s, d, "tree_bvh"))).select("depth", "path", "level", "n_prims"),
    "check_sanity": lambda s, d: trees.sanity_violations(trees.remove_empty(_sparse_nodes(s, d, "tree_hybrid")), 5),
    "export_nodes": export_nodes,
    "empty_cells": lambda s, d: trees.empty_cells(*_sparse_tree(s, d, "tree_octree")).select("depth", "path"),
    "spatial_join": lambda s, d: box_ops.touching_pairs(boxes(s, d), 1.0, (0.0, 0.0, 0.0, 66.0, 18.0, 17.0)),
    "morton_code": lambda s, d: tri_ops.morton_codes(triangles(s, d)).select("triangle_id", "morton"),
    "morton_order": lambda s, d: tri_ops.morton_order(triangles(s, d)).select("triangle_id", "position"),
    "bvh_leaves": lambda s, d: bvh.leaves(triangles(s, d)).select("node_id", *BOX, "triangle_id", "n_tri"),
    "nearest_cluster": lambda s, d: bvh.nearest_cluster(_leaf_clusters(s, d)),
    "mutual_pairs": lambda s, d: bvh.mutual_pairs(settle(bvh.nearest_cluster(_leaf_clusters(s, d)))),
    "ploc_step": ploc_step,
    "compact_scan": compact_scan,
    "bvh_ploc": lambda s, d: bvh.build(triangles(s, d)),
    "bvh_ploc_rounds": lambda s, d: bvh.build(triangles(s, d), finish=256),
    "bvh_stats": lambda s, d: bvh.stats(bvh.build(triangles(s, d))),
    "bvh_depths": lambda s, d: bvh.depths(settle(bvh.build(triangles(s, d)))),
    "sample_hemisphere": lambda s, d: misc.hemisphere(table(s, d, "customer"), "c_custkey"),
    "sample_cosine": _sample(misc.cosine_hemisphere, "x", "y", "z"),
    "sample_disk": _sample(misc.unit_disk, "x", "y"),
    "sample_to_sphere": _sample(lambda p, k: misc.to_sphere(p, k, 2.0, 25.0), "x", "y", "z"),
    "sample_disk_rejection": lambda s, d: misc.disk_by_rejection(table(s, d, "customer"), "c_custkey"),
    "sample_sphere_rejection": lambda s, d: misc.sphere_by_rejection(table(s, d, "customer"), "c_custkey"),
    "sample_noise": lambda s, d: misc.noise(table(s, d, "customer"), "c_custkey"),
    "materials": materials,
    "scene_graph": scene_graph,
    "scene_snapshots": scene_snapshots,
    "collapse": lambda s, d: trees.collapse(trees.remove_empty(_sparse_nodes(s, d, "tree_bvh"))).select("depth", "path", "n_prims"),
    "format_duration": format_duration,
}
