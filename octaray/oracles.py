"""SQL for the library's queries, written against the driver's tables."""

from __future__ import annotations

TRI = """tri AS (
  SELECT p_partkey AS triangle_id, p_size::DOUBLE AS ax, (p_partkey * 37 % 101)::DOUBLE AS ay, (p_partkey * 61 % 97)::DOUBLE AS az,
         (p_size + 2 + p_partkey % 5)::DOUBLE AS bx, (p_partkey * 37 % 101 + p_partkey % 3)::DOUBLE AS b_y, (p_partkey * 61 % 97 - 1)::DOUBLE AS bz,
         (p_size - 1)::DOUBLE AS cx, (p_partkey * 37 % 101 + 3)::DOUBLE AS cy, (p_partkey * 61 % 97 + 2 + p_partkey % 4)::DOUBLE AS cz
  FROM part)"""
RAYS = """rays AS (
  SELECT c_custkey AS ray_id, 120.0::DOUBLE AS ox, (c_custkey * 13 % 101)::DOUBLE AS oy, (c_custkey * 29 % 97)::DOUBLE AS oz,
         -1.0::DOUBLE AS dx, (c_custkey % 11 - 5) / 32.0::DOUBLE AS dy, (c_custkey % 7 - 3) / 32.0::DOUBLE AS dz
  FROM customer)"""
BOXES = """boxes AS (
  SELECT o_orderkey AS prim_id, lx AS min_x, ly AS min_y, lz AS min_z,
         lx + (o_orderkey % 3) / 4.0::DOUBLE AS max_x, ly + (o_orderkey % 5) / 4.0::DOUBLE AS max_y, lz + (o_orderkey % 2) / 4.0::DOUBLE AS max_z
  FROM (SELECT o_orderkey, (o_orderkey * 37 % 261) / 4.0::DOUBLE AS lx, (o_orderkey * 13 % 67) / 4.0::DOUBLE AS ly, (o_orderkey * 29 % 65) / 4.0::DOUBLE AS lz FROM orders))"""
CROSS = """crossed AS (
  SELECT triangle_id, (b_y - ay) * (cz - az) - (bz - az) * (cy - ay) AS kx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ky,
         (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS kz FROM tri)"""
HITS = """edged AS (
  SELECT triangle_id, ax, ay, az, bx - ax AS e1x, b_y - ay AS e1y, bz - az AS e1z, cx - ax AS e2x, cy - ay AS e2y, cz - az AS e2z FROM tri
), prep AS (
  SELECT *, e1y * e2z - e1z * e2y AS nx, e1z * e2x - e1x * e2z AS ny, e1x * e2y - e1y * e2x AS nz,
         e1x * e1x + e1y * e1y + e1z * e1z AS d00, e1x * e2x + e1y * e2y + e1z * e2z AS d01, e2x * e2x + e2y * e2y + e2z * e2z AS d11 FROM edged
), planes AS (
  SELECT *, ((ax - ox) * nx + (ay - oy) * ny + (az - oz) * nz) / nullif(dx * nx + dy * ny + dz * nz, 0) AS t FROM rays CROSS JOIN prep
), dots AS (
  SELECT *, (ox + t * dx - ax) * e1x + (oy + t * dy - ay) * e1y + (oz + t * dz - az) * e1z AS d20,
         (ox + t * dx - ax) * e2x + (oy + t * dy - ay) * e2y + (oz + t * dz - az) * e2z AS d21 FROM planes WHERE t >= 0
), bary AS (
  SELECT ray_id, triangle_id, t, (d11 * d20 - d01 * d21) / nullif(d00 * d11 - d01 * d01, 0) AS u, (d00 * d21 - d01 * d20) / nullif(d00 * d11 - d01 * d01, 0) AS v FROM dots
), hits AS (SELECT ray_id, triangle_id, t FROM bary WHERE u >= 0 AND v >= 0 AND u + v <= 1),
nearest AS (SELECT ray_id, t, triangle_id FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, triangle_id) AS k FROM hits) WHERE k = 1)"""
_CORNERS = ("ax", "ay", "az", "bx", "b_y", "bz", "cx", "cy", "cz")
#: The triangles of two models: as they are, and halved and shifted.
FLAT = TRI.replace("tri AS", "one AS", 1) + f""", tri AS (
  SELECT * FROM one UNION ALL SELECT triangle_id + (SELECT count(*) FROM one), {", ".join(f"{c} * 0.5::DOUBLE + {s} AS {c}" for c, s in zip(_CORNERS, (10.0, 20.0, 30.0) * 3, strict=True))} FROM one)"""
B = "min_x, min_y, min_z, max_x, max_y, max_z"
AXIS = "CASE WHEN max_x - min_x > max_y - min_y AND max_x - min_x > max_z - min_z THEN 0 WHEN max_y - min_y > max_z - min_z THEN 1 ELSE 2 END"
MESH = """meshes AS (SELECT triangle_id // 100 AS mesh_id, triangle_id // 100 * 300 AS start_index, 300 AS length FROM tri GROUP BY 1, 2),
held AS (SELECT t.triangle_id, coalesce(min(m.mesh_id), 0) AS mesh_id FROM tri t LEFT JOIN meshes m ON m.start_index <= 3 * t.triangle_id AND 3 * t.triangle_id < m.start_index + m.length GROUP BY 1)"""
VERTEX = """vertex AS (
  SELECT triangle_id * 3 AS vertex_id, ax AS x, ay AS y, az AS z FROM tri UNION ALL SELECT triangle_id * 3 + 1, bx, b_y, bz FROM tri
  UNION ALL SELECT triangle_id * 3 + 2, cx, cy, cz FROM tri)"""
BOUNDS = """bounds AS (
  SELECT triangle_id, least(ax, bx, cx) AS min_x, least(ay, b_y, cy) AS min_y, least(az, bz, cz) AS min_z,
         greatest(ax, bx, cx) AS max_x, greatest(ay, b_y, cy) AS max_y, greatest(az, bz, cz) AS max_z FROM tri)"""
AREA = "2.0 * ({0}) * ({1}) + 2.0 * ({2}) * ({1}) + 2.0 * ({0}) * ({2})"


def _spread(v: str) -> str:
    # The multipliers and masks of the published 30-bit Morton construction.
    for factor, mask in ((65537, 4278190335), (257, 251719695), (17, 3272356035), (5, 1227133513)):
        v = f"((({v}) * {factor}) & 4294967295 & {mask})"
    return v


def _morton() -> str:
    parts = [_spread(f"greatest(0, least(1023, floor(coalesce(((max_{x} + min_{x}) / 2 - s_min_{x}) / nullif(s_max_{x} - s_min_{x}, 0), 0) * 1024)))::BIGINT") for x in "xyz"]
    return f"{parts[0]} * 4 + {parts[1]} * 2 + {parts[2]}"


MORTON = f"""scene AS (SELECT {', '.join(f"{f}({f}_{x}) AS s_{f}_{x}" for f in ('min', 'max') for x in 'xyz')} FROM bounds),
codes AS (SELECT b.*, {_morton()} AS morton FROM bounds b CROSS JOIN scene),
leaves AS (SELECT *, row_number() OVER (ORDER BY morton, triangle_id) - 1 AS pos FROM codes)"""
_UNION = AREA.format(*[f"greatest(a.max_{x}, b.max_{x}) - least(a.min_{x}, b.min_{x})" for x in "xyz"])
NEAREST = f"""near AS (
  SELECT pos, nn, area FROM (
    SELECT a.pos, b.pos AS nn, {_UNION} AS area, row_number() OVER (PARTITION BY a.pos ORDER BY {_UNION}, b.pos) AS k
    FROM leaves a JOIN leaves b ON b.pos BETWEEN a.pos - 128 AND a.pos + 128 AND a.pos <> b.pos) WHERE k = 1),
mutual AS (SELECT x.pos AS i, x.nn AS j, x.area FROM near x JOIN near y ON x.nn = y.pos AND y.nn = x.pos WHERE x.pos < x.nn)"""

#: All rounds of the agglomeration: the clusters of each round, in order, with those that it made marked as fresh.
PLOC = f"""st AS (
  SELECT pos, pos AS node_id, 1::BIGINT AS n_tri, {B}, NULL::BIGINT AS left_id, NULL::BIGINT AS right_id, true AS fresh, (SELECT count(*) FROM leaves) AS next FROM leaves
  UNION ALL
  SELECT row_number() OVER (ORDER BY a.pos) - 1 AS pos, CASE WHEN m.i IS NULL THEN a.node_id ELSE a.next + m.r END AS node_id, a.n_tri + coalesce(b.n_tri, 0) AS n_tri,
         {', '.join(f'least(a.min_{x}, coalesce(b.min_{x}, a.min_{x})) AS min_{x}' for x in 'xyz')}, {', '.join(f'greatest(a.max_{x}, coalesce(b.max_{x}, a.max_{x})) AS max_{x}' for x in 'xyz')},
         CASE WHEN m.i IS NOT NULL THEN a.node_id END AS left_id, b.node_id AS right_id, m.i IS NOT NULL AS fresh, a.next + max(coalesce(m.r, -1)) OVER () + 1 AS next
  FROM st a LEFT JOIN (
    SELECT x.pos AS i, x.nn AS j, row_number() OVER (ORDER BY x.pos) - 1 AS r FROM ({{near}}) x JOIN ({{near}}) y ON x.nn = y.pos AND y.nn = x.pos WHERE x.pos < x.nn
  ) m ON m.i = a.pos LEFT JOIN st b ON b.pos = m.j
  WHERE (SELECT count(*) FROM st) > 1 AND a.pos NOT IN (SELECT x.nn FROM ({{near}}) x JOIN ({{near}}) y ON x.nn = y.pos AND y.nn = x.pos WHERE x.pos < x.nn)
), ploc AS (SELECT st.node_id, {', '.join('st.' + n for n in B.split(', '))}, leaves.triangle_id, n_tri, left_id, right_id FROM st LEFT JOIN leaves ON n_tri = 1 AND leaves.pos = node_id WHERE fresh)"""
PLOC = PLOC.format(near=f"""SELECT pos, nn FROM (SELECT a.pos, b.pos AS nn, row_number() OVER (PARTITION BY a.pos ORDER BY {_UNION}, b.pos) AS k
    FROM st a JOIN st b ON b.pos BETWEEN a.pos - 128 AND a.pos + 128 AND a.pos <> b.pos) WHERE k = 1""")
HIERARCHY = f"WITH RECURSIVE {TRI}, {BOUNDS}, {MORTON}, {PLOC}"


def _camera() -> str:
    """Rays of a 32 x 24 x 4 camera at (120, 50, 48) that looks along -x: right is -z there, up is y, far is 120."""
    tan_x = "tan(radians(20.0) / 2)"
    h, w = f"(2 * 120.0 * tan(2 * atan({tan_x} / (32 / 24.0)) / 2))", f"(2 * 120.0 * tan(2 * atan({tan_x} / (32 / 24.0)) / 2) * (32 / 24.0))"
    return f"""ids AS (SELECT range AS ray_id, (range % 32)::INT AS px, (range // 32 % 24)::INT AS py, range // 768 AS s FROM range(3072)),
ends AS (SELECT ray_id, px, py, -120.0::DOUBLE AS ex, (py + (s // 2) / 2.0::DOUBLE) / 24.0::DOUBLE * {h} - {h} / 2 AS ey,
         -((px + (s % 2) / 2.0::DOUBLE) / 32.0::DOUBLE * {w} - {w} / 2) AS ez FROM ids),
rays AS (SELECT ray_id, px, py, 120.0::DOUBLE AS ox, 50.0::DOUBLE AS oy, 48.0::DOUBLE AS oz, ex / l AS dx, ey / l AS dy, ez / l AS dz
  FROM (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS l FROM ends))"""


IMAGE = f"""WITH {TRI}, {_camera()}, {HITS},
image AS (SELECT px, py, round(coalesce(avg(n.t), 0), 6) AS r FROM rays LEFT JOIN nearest n USING (ray_id) GROUP BY px, py),
top AS (SELECT max(r) AS top FROM image), norm AS (SELECT px, py, coalesce(r / nullif(top, 0), 0) AS r FROM image CROSS JOIN top)"""


def _slab(i: int, x: str, low: float, high: float) -> tuple[str, str, str]:
    t0, t1 = f"({low} - o{x}) / nullif(d{x}, 0)", f"({high} - o{x}) / nullif(d{x}, 0)"
    return f"coalesce(least({t0}, {t1}), -1e300)", f"coalesce(greatest({t0}, {t1}), 1e300)", f"(d{x} <> 0 OR ({low} <= o{x} AND o{x} <= {high}))"


def _ray_box() -> str:
    parts = [_slab(i, x, low, high) for i, (x, low, high) in enumerate((("x", 10.0, 50.0), ("y", 10.0, 60.0), ("z", 10.0, 70.0)))]
    near, far = f"greatest({', '.join(p[0] for p in parts)})", f"least({', '.join(p[1] for p in parts)})"
    return f"WITH {RAYS} SELECT ray_id, {near} AS t_near, {far} AS t_far, {' AND '.join(p[2] for p in parts)} AND {near} < {far} AND {far} > 0 AS hit FROM rays"


def _children(source: str, kinds: list[str], extra: str = "") -> str:
    """All children of the rows of ``source`` (depth, path, box, plane): depth, path, box."""
    kind = "CASE depth " + " ".join(f"WHEN {d} THEN '{k}'" for d, k in enumerate(kinds)) + " END"
    n = {}
    for i, x in enumerate("xyz"):
        n[x] = f"CASE kind WHEN 'octree' THEN 2 WHEN 'thirds' THEN {3 if x == 'x' else 1} WHEN 'quadtree' THEN CASE WHEN axis = {i} THEN 1 ELSE 2 END ELSE CASE WHEN axis = {i} THEN 2 ELSE 1 END END"
    place = {"x": "k // (ny * nz)", "y": "k // nz % ny", "z": "k % nz"}
    low = [f"CASE WHEN kind = 'kdtree' THEN CASE WHEN axis = {i} AND k = 1 THEN plane ELSE min_{x} END ELSE min_{x} + ((max_{x} - min_{x}) / n{x}) * ({place[x]}) END AS c_min_{x}" for i, x in enumerate("xyz")]
    high = [f"CASE WHEN kind = 'kdtree' THEN CASE WHEN axis = {i} AND k = 0 THEN plane ELSE max_{x} END ELSE min_{x} + ((max_{x} - min_{x}) / n{x}) * ({place[x]}) + (max_{x} - min_{x}) / n{x} END AS c_max_{x}" for i, x in enumerate("xyz")]
    return f"""SELECT depth + 1 AS depth, path * 8 + k AS path, {', '.join(low + high)}{extra} FROM (
  SELECT *, {', '.join(f'{n[x]} AS n{x}' for x in 'xyz')} FROM (SELECT *, {kind} AS kind, {AXIS} AS axis FROM {source})) q
  JOIN (SELECT range::BIGINT AS k FROM range(8)) AS ks ON k < nx * ny * nz"""


def tree(kinds: list[str], source: str = "boxes", scene=(0.0, 0.0, 0.0, 64.0, 16.0, 16.0)) -> str:
    """CTEs ``lv`` (pairs), ``reach`` and ``nodes`` of the tree with a kind for each depth; the last depth never splits."""
    deepest = len(kinds) - 1
    p = ", ".join(f"p_{n}" for n in B.split(", "))
    root = ", ".join(f"{v}::DOUBLE AS {n}" for v, n in zip(scene, B.split(", "), strict=True))
    axis = AXIS
    centroid = f"CASE {axis} WHEN 0 THEN (p_min_x + p_max_x) / 2 WHEN 1 THEN (p_min_y + p_max_y) / 2 ELSE (p_min_z + p_max_z) / 2 END"
    touch = " AND ".join(f"p_min_{x} <= max_{x} AND p_max_{x} >= min_{x}" for x in "xyz")
    windowed = f"""SELECT depth, path, {B}, prim_id, {p}, count(*) OVER (PARTITION BY path) AS n,
  max(CASE WHEN rn <= 2 THEN {centroid} END) OVER (PARTITION BY path) AS plane
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY prim_id) AS rn FROM"""
    first = f"(SELECT 0 AS depth, 0::BIGINT AS path, {root}, prim_id, {', '.join(f'{n} AS p_{n}' for n in B.split(', '))} FROM {source})"
    below = _children(f"(SELECT * FROM lv WHERE n >= 2 AND depth < {deepest})", kinds, f", prim_id, {p}")
    renamed = ", ".join(f"c_{n} AS {n}" for n in B.split(", "))
    return f"""{BOXES}, lv AS (
  {windowed} {first} WHERE {touch})
  UNION ALL
  {windowed} (SELECT depth, path, {renamed}, prim_id, {p} FROM ({below})) WHERE {touch})
), reach AS (SELECT depth, path, any_value(min_x) AS min_x, any_value(min_y) AS min_y, any_value(min_z) AS min_z, any_value(max_x) AS max_x,
       any_value(max_y) AS max_y, any_value(max_z) AS max_z, any_value(plane) AS plane, count(*) AS n FROM lv GROUP BY depth, path
), places AS (
  SELECT 0 AS depth, 0::BIGINT AS path, {root}
  UNION ALL SELECT depth, path, {renamed} FROM ({_children(f"(SELECT * FROM reach WHERE n >= 2 AND depth < {deepest})", kinds)})
), nodes AS (
  SELECT depth, path, CASE depth {' '.join(f"WHEN {d} THEN '{k}'" for d, k in enumerate(kinds))} END AS cls, s.{B.replace(', ', ', s.')},
         CASE WHEN depth = {deepest} OR coalesce(r.n, 0) < 2 THEN coalesce(r.n, 0) ELSE 0 END AS n_prims,
         depth = {deepest} OR coalesce(r.n, 0) < 2 AS is_leaf
  FROM places s LEFT JOIN reach r USING (depth, path)
), kept AS (SELECT * FROM nodes WHERE NOT (is_leaf AND n_prims = 0) OR depth = 0
), counts AS (SELECT depth - 1 AS depth, path >> 3 AS path, count(*) AS n_children FROM kept WHERE depth > 0 GROUP BY 1, 2)"""


OCTREE, QUADTREE, BVH, KDTREE = ["octree"] * 5, ["quadtree"] * 5, ["bvh"] * 7, ["kdtree"] * 6
HYBRID, THIRDS = ["quadtree"] * 4 + ["octree"] * 2, ["thirds"] * 4
NODES = f"SELECT depth, path, cls, {B}, n_prims, is_leaf FROM nodes"


_SCENE, _WIDE = (0.0, 0.0, 0.0, 64.0, 16.0, 16.0), (-64.0, -128.0, -16.0, 448.0, 128.0, 112.0)


def _tree_sql(kinds: list[str], select: str = NODES, scene: tuple[float, ...] = _SCENE) -> str:
    return f"WITH RECURSIVE {tree(kinds, scene=scene)} {select}"


def _split(cells: list[tuple[list[str], list[str]]]) -> str:
    return " UNION ALL ".join(f"SELECT prim_id, {k} AS k, " + ", ".join(f"{e} AS {n}" for e, n in zip([*low, *high], B.split(", "), strict=True)) + " FROM boxes" for k, (low, high) in enumerate(cells))


def _binary() -> str:
    cells = []
    for k in (0, 1):
        low = [f"CASE WHEN {AXIS} = {i} THEN min_{x} + (max_{x} - min_{x}) / 2.0 * {k} ELSE min_{x} END" for i, x in enumerate("xyz")]
        high = [f"CASE WHEN {AXIS} = {i} THEN min_{x} + (max_{x} - min_{x}) / 2.0 * {k + 1} ELSE max_{x} END" for i, x in enumerate("xyz")]
        cells.append((low, high))
    return _split(cells)


def _eighths() -> str:
    cells = []
    for c in range(8):
        at = (c >> 2, c >> 1 & 1, c & 1)
        cells.append(([f"min_{x} + (max_{x} - min_{x}) / 2.0 * {i}" for x, i in zip("xyz", at, strict=True)], [f"min_{x} + (max_{x} - min_{x}) / 2.0 * {i + 1}" for x, i in zip("xyz", at, strict=True)]))
    return _split(cells)


def _transform() -> str:
    m = ((0.0, -2.0, 0.0, 1.0), (1.0, 0.0, 0.0, -3.0), (0.0, 0.5, -1.0, 2.0))

    def row(r: int, ends: str) -> str:
        return " + ".join(f"({m[r][i]}) * {'max' if ends[i] == '1' else 'min'}_{x}" for i, x in enumerate("xyz")) + f" + ({m[r][3]})"

    plain = [f"{row(r, e * 3)} AS {f}_{x}" for f, e in (("min", "0"), ("max", "1")) for r, x in enumerate("xyz")]
    every = [f"{b:03b}" for b in range(8)]
    exact = [f"{g}({', '.join(row(r, e) for e in every)}) AS exact_{f}_{x}" for f, g in (("min", "least"), ("max", "greatest")) for r, x in enumerate("xyz")]
    return f"WITH {BOXES} SELECT prim_id, {', '.join(plain + exact)} FROM boxes"


def _corners() -> str:
    return " UNION ALL ".join(f"SELECT prim_id, {c} AS corner, " + ", ".join(f"{'max' if c >> i & 1 else 'min'}_{x} AS {x}" for i, x in enumerate("xyz")) + " FROM boxes" for c in range(8))


def _edges() -> str:
    return " UNION ALL ".join(f"SELECT prim_id, {a} AS a, {a | 1 << i} AS b, max_{x} - min_{x} AS length FROM boxes" for a in range(8) for i, x in enumerate("xyz") if not a >> i & 1)


_METRICS = ", ".join([*(f"(max_{x} + min_{x}) / 2 AS center_{x}" for x in "xyz"), *(f"max_{x} - (max_{x} + min_{x}) / 2 AS extent_{x}" for x in "xyz"), *(f"max_{x} - min_{x} AS size_{x}" for x in "xyz")])
_QUERY_BOX = (8.0, 2.0, 2.0, 32.0, 10.0, 12.0)
_TOUCH = " AND ".join(f"min_{x} <= {_QUERY_BOX[i + 3]} AND max_{x} >= {_QUERY_BOX[i]}" for i, x in enumerate("xyz"))
_UNIFORM = "((c_custkey * 7919 + {0} * 104729 + 12345) % 65537) / 65537.0::DOUBLE"
_SCHEDULES = {"tree_octree": OCTREE, "tree_quadtree": QUADTREE, "tree_bvh": BVH, "tree_kdtree": KDTREE, "tree_hybrid": HYBRID, "custom_split": THIRDS}
_COLLAPSE = """, single AS (SELECT depth, path FROM counts WHERE n_children = 1),
tops AS (SELECT k.depth AS d, k.path AS p, min(s.depth) AS top FROM kept k JOIN single s ON s.depth <= k.depth AND s.path = k.path >> (3 * (k.depth - s.depth))::BIGINT GROUP BY 1, 2)
SELECT depth, path, depth - CASE WHEN top IS NULL THEN 0 ELSE 1 END AS level, n_prims FROM kept LEFT JOIN tops ON d = depth AND p = path WHERE top IS NULL OR top < depth"""

_MATRIX = [f"m{r}{c}" for r in range(3) for c in range(4)]


def _graph() -> str:
    turn = ((0.5, 0, 0, 0, 0.5, 0, 0, 0, 0.5), (0, -1.0, 0, 1.0, 0, 0, 0, 0, 1.0), (1.0, 0, 0, 0, 0, 1.0, 0, -1.0, 0))
    shift = ("p_size", "k % 7", "k % 5")
    own = [f"({shift[r]})::DOUBLE" if c == 3 else f"(CASE k % 3 WHEN 0 THEN {turn[0][3 * r + c]} WHEN 1 THEN {turn[1][3 * r + c]} ELSE {turn[2][3 * r + c]} END)::DOUBLE" for r in range(3) for c in range(4)]
    joint = [" + ".join([f"p.m{r}{i} * g.m{i}{c}" for i in range(3)] + [f"p.m{r}3"] * (c == 3)) for r in range(3) for c in range(4)]
    return f"""WITH RECURSIVE g AS (SELECT k, CASE WHEN k >= 4 THEN k // 4 END AS parent, k % 4 AS ord, {', '.join(f'{e} AS {m}' for e, m in zip(own, _MATRIX, strict=True))} FROM (SELECT p_partkey AS k, p_size FROM part)),
w AS (
  SELECT k, 0 AS depth, lpad(ord::VARCHAR, 2, '0') AS line, {', '.join(_MATRIX)} FROM g WHERE parent IS NULL
  UNION ALL SELECT g.k, depth + 1, line || '/' || lpad(g.ord::VARCHAR, 2, '0'), {', '.join(f'{e} AS {m}' for e, m in zip(joint, _MATRIX, strict=True))} FROM w p JOIN g ON g.parent = p.k)
SELECT k AS node_id, depth, (SELECT count(*) FROM w d WHERE starts_with(d.line, w.line)) AS size, row_number() OVER (ORDER BY line) - 1 AS position, {', '.join(_MATRIX)} FROM w"""


def _snapshots() -> str:
    own = [f"0.5::DOUBLE * {f}_{x} + (CASE kind WHEN 'add' THEN {a} ELSE {m} END)::DOUBLE AS own_{f}_{x}" for f in ("min", "max") for x, a, m in (("x", "k * 7 % 50", "k * 7 % 50 + 1000"), ("y", "k * 3 % 40", "k * 3 % 40 - 1000"), ("z", "k % 9", "k % 9"))]
    run = [f"{f}(CASE WHEN kind = 'add' THEN own_{f}_{x} END) OVER (ORDER BY seq) AS {f}_{x}" for f in ("min", "max") for x in "xyz"]
    return f"""WITH {TRI}, {BOUNDS}, mesh AS (SELECT triangle_id // 100 AS mesh_id, {', '.join(f'{f}({f}_{x}) AS {f}_{x}' for f in ('min', 'max') for x in 'xyz')} FROM bounds GROUP BY 1),
e AS (SELECT s_suppkey AS k, s_suppkey * 2 AS seq, 'add' AS kind FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 2 + 5, 'move' FROM supplier WHERE s_suppkey % 2 = 0),
o AS (SELECT seq, k AS model_id, kind, {', '.join(own)} FROM e JOIN mesh ON mesh_id = k % 2)
SELECT seq, model_id, kind, count(*) FILTER (WHERE kind = 'add') OVER (ORDER BY seq) AS n_models, {', '.join(run)}, {', '.join(f'own_{f}_{x}' for f in ('min', 'max') for x in 'xyz')} FROM o"""


def _rejection(names: str) -> str:
    axes = len(names)
    draws = [f"((c_custkey * 7919 + (i * {axes} + {a + 1}) * 104729 + 12345) % 65537) / 65537.0::DOUBLE * 2 - 1 AS {n}" for a, n in enumerate(names)]
    return f"""WITH d AS (SELECT c_custkey, i, {', '.join(draws)} FROM customer, range(64) AS r(i))
SELECT c_custkey, {', '.join(names)}, i::INT AS round FROM d WHERE {' + '.join(f'{n} * {n}' for n in names)} < 1 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY i) = 1"""


_U1, _U2 = "(" + _UNIFORM.format(1) + ")", "(" + _UNIFORM.format(2) + ")"

ORACLE_SQL = {
    "box_metrics": f"WITH {BOXES} SELECT prim_id, {_METRICS}, {AREA.format('max_x - min_x', 'max_y - min_y', 'max_z - min_z')} AS area, {AXIS} AS axis FROM boxes",
    "box_transform": _transform(),
    "box_overlap_filter": f"WITH {BOXES} SELECT * FROM boxes WHERE {_TOUCH}",
    "split_axis": f"WITH {BOXES} SELECT prim_id, {AXIS} AS axis FROM boxes",
    "split_binary": f"WITH {BOXES} {_binary()}",
    "split_at_value": f"WITH {BOXES} {_split([(['min_x', 'min_y', 'min_z'], ['max_x', '8.0', 'max_z']), (['min_x', '8.0', 'min_z'], ['max_x', 'max_y', 'max_z'])])}",
    "split_grid": f"WITH {BOXES} {_eighths()}",
    "union_area": f"WITH {BOXES} SELECT prim_id, {AREA.format(*[f'greatest(max_{x}, {_QUERY_BOX[i + 3]}) - least(min_{x}, {_QUERY_BOX[i]})' for i, x in enumerate('xyz')])} AS area FROM boxes",
    "box_corners": f"WITH {BOXES} {_corners()}",
    "box_edges": f"WITH {BOXES} {_edges()}",
    "tri_bounds": f"WITH {TRI}, {BOUNDS} SELECT * FROM bounds",
    "tri_area": f"WITH {TRI}, {CROSS} SELECT triangle_id, sqrt(kx * kx + ky * ky + kz * kz) / 2 AS area FROM crossed",
    "tri_normal": f"WITH {TRI}, {CROSS} SELECT triangle_id, kx / nullif(l, 0) AS nx, ky / nullif(l, 0) AS ny, kz / nullif(l, 0) AS nz FROM (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS l FROM crossed)",
    "tri_assemble": f"WITH {TRI} SELECT * FROM tri",
    "mesh_range_join": f"WITH {TRI}, {MESH} SELECT triangle_id, mesh_id FROM held",
    "mesh_aabb": f"WITH {TRI}, {MESH} SELECT mesh_id, min(least(ax, bx, cx)) AS min_x, min(least(ay, b_y, cy)) AS min_y, min(least(az, bz, cz)) AS min_z, max(greatest(ax, bx, cx)) AS max_x, max(greatest(ay, b_y, cy)) AS max_y, max(greatest(az, bz, cz)) AS max_z FROM held JOIN tri USING (triangle_id) GROUP BY mesh_id",
    "mesh_area": f"WITH {TRI}, {MESH}, {CROSS} SELECT mesh_id, round(sum(sqrt(kx * kx + ky * ky + kz * kz) / 2), 6) AS area FROM held JOIN crossed USING (triangle_id) GROUP BY mesh_id",
    "mesh_stats": f"WITH {TRI}, {MESH} SELECT mesh_id, count(*) AS n_triangles, count(*) * 3 AS n_vertices FROM held GROUP BY mesh_id",
    "scene_aabb": f"WITH {BOXES} SELECT {', '.join(f'{f}({f}_{x}) AS {f}_{x}' for f in ('min', 'max') for x in 'xyz')} FROM boxes",
    "scene_flatten": f"WITH {TRI}, n AS (SELECT count(*) AS n FROM tri) SELECT * FROM tri UNION ALL SELECT triangle_id + n, {', '.join(f'{c} * 0.5::DOUBLE + {s} AS {c}' for c, s in zip(('ax', 'ay', 'az', 'bx', 'b_y', 'bz', 'cx', 'cy', 'cz'), (10.0, 20.0, 30.0) * 3, strict=True))} FROM tri CROSS JOIN n",
    "recenter_scale": f"WITH {TRI}, {VERTEX}, e AS (SELECT {', '.join(f'(max({x}) + min({x})) / 2 AS m{x}, max({x}) - (max({x}) + min({x})) / 2 AS h{x}' for x in 'xyz')} FROM vertex) SELECT vertex_id, {', '.join(f'({x} - m{x}) * least(1.0::DOUBLE, 16.0::DOUBLE / nullif(greatest(hx, hy, hz), 0)) AS {x}' for x in 'xyz')} FROM vertex CROSS JOIN e",
    "area_cdf": f"WITH {TRI}, {CROSS}, a AS (SELECT triangle_id, sqrt(kx * kx + ky * ky + kz * kz) / 2 AS area FROM crossed) SELECT triangle_id, round(sum(area) OVER (ORDER BY triangle_id) / sum(area) OVER (), 6) AS cdf FROM a",
    "component_naming": "WITH c AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier), f AS (SELECT range AS n, row_number() OVER (ORDER BY range) AS r FROM range((SELECT count(*) FROM supplier) + 25) WHERE range NOT IN (SELECT n_nationkey * 3 FROM nation)) SELECT s_suppkey, 'CADModel ' || n AS name FROM c JOIN f USING (r)",
    "camera_rays": f"WITH {_camera()} SELECT c_custkey, ray_id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('ox', 'oy', 'oz', 'dx', 'dy', 'dz'))} FROM customer JOIN rays ON ray_id = c_custkey % 3072",
    "ray_box": _ray_box(),
    "ray_triangle_hits": f"WITH {TRI}, {RAYS}, {HITS} SELECT ray_id, triangle_id, t FROM hits",
    "ray_query_bruteforce": f"WITH {TRI}, {RAYS}, {HITS} SELECT ray_id, t, triangle_id FROM nearest",
    "ray_query_indexed": f"WITH {TRI}, {RAYS}, {HITS} SELECT ray_id, t, triangle_id FROM nearest",
    **{f"ray_query_{name}": f"WITH {TRI}, {RAYS}, {HITS} SELECT ray_id, t, triangle_id FROM nearest" for name in _SCHEDULES if name != "custom_split"},
    "ray_query_hierarchy": f"WITH {TRI}, {RAYS}, {HITS} SELECT ray_id, t, triangle_id FROM nearest",
    "ray_query_node_tree": f"WITH {FLAT}, {RAYS}, {HITS} SELECT ray_id, t, triangle_id FROM nearest",
    "ray_query_external_miss0": f"WITH {TRI}, {RAYS}, {HITS} SELECT ray_id, coalesce(t, 0) AS t FROM rays LEFT JOIN nearest USING (ray_id)",
    "ray_any_hit": f"WITH {TRI}, {RAYS}, {HITS} SELECT DISTINCT ray_id FROM hits",
    "depth_image": f"{IMAGE} SELECT px, py, r, r AS g, r AS b, 1.0::DOUBLE AS a FROM image",
    "image_normalize": f"{IMAGE} SELECT px, py, round(r, 6) AS r, round(r, 6) AS g, round(r, 6) AS b, 1.0::DOUBLE AS a FROM norm",
    "image_quantize": f"{IMAGE} SELECT px, 23 - py AS row, floor(r * 255)::INT AS r, floor(r * 255)::INT AS g, floor(r * 255)::INT AS b, 255 AS a FROM norm",
    "normal_to_rgb": f"WITH {TRI}, {CROSS} SELECT triangle_id, (kx / nullif(l, 0) + 1) / 2 AS r, (ky / nullif(l, 0) + 1) / 2 AS g, (kz / nullif(l, 0) + 1) / 2 AS b FROM (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS l FROM crossed)",
    "level_schedule": "WITH k(name, depth, n, cls) AS (VALUES " + ", ".join(f"('{n}', {d}, {len(kinds)}, '{k}')" for n, kinds in _SCHEDULES.items() for d, k in enumerate(kinds)) + ") SELECT p_partkey, name, depth, cls FROM part JOIN k ON depth = p_partkey % n",
    **{name: _tree_sql(kinds) for name, kinds in _SCHEDULES.items()},
    "kd_split_plane": f"WITH {BOXES} SELECT path, max((min_x + max_x) / 2) AS plane FROM (SELECT *, prim_id % 25 AS path, row_number() OVER (PARTITION BY prim_id % 25 ORDER BY prim_id) AS k FROM boxes) WHERE k <= 2 GROUP BY path",
    "tree_stats": _tree_sql(OCTREE, "SELECT 4 AS levels, count(*) AS n_nodes, sum(is_leaf::INT)::BIGINT AS n_leaves, sum(n_prims)::BIGINT AS n_refs, (SELECT count(DISTINCT prim_id) FROM lv) AS n_distinct, sum(n_prims) / sum(is_leaf::INT)::DOUBLE AS avg_prims, (sum(is_leaf::INT) * 2)::BIGINT AS reported_leaves, sum(n_prims) / (sum(is_leaf::INT) * 2)::DOUBLE AS reported_avg FROM nodes"),
    "remove_empty": _tree_sql(KDTREE, "SELECT depth, path, n_prims, is_leaf FROM kept", _WIDE),
    "removed_count": _tree_sql(OCTREE, "SELECT (SELECT count(*) FROM nodes) - (SELECT count(*) FROM kept) AS n_removed, (SELECT count(*) FROM kept) AS n_left", _WIDE),
    "collapse_once": _tree_sql(BVH, _COLLAPSE, _WIDE),
    "check_sanity": _tree_sql(HYBRID, "SELECT count(*) FILTER (WHERE (coalesce(n_children, 0) > 0) = (n_prims > 0)) AS both_or_neither, count(*) FILTER (WHERE is_leaf AND n_prims > 1 AND depth < 5) AS unsplit, count(*) FILTER (WHERE depth > 5) AS too_deep FROM kept LEFT JOIN counts USING (depth, path)", _WIDE),
    "export_nodes": _tree_sql(OCTREE, f"SELECT row_number() OVER (ORDER BY path << (3 * (4 - depth))::BIGINT, depth) - 1 AS position, {B} FROM nodes"),
    "empty_cells": _tree_sql(OCTREE, "SELECT depth, path FROM nodes WHERE is_leaf AND n_prims = 0", _WIDE),
    "spatial_join": f"WITH {BOXES} SELECT a.prim_id AS left_id, b.prim_id AS right_id FROM boxes a JOIN boxes b ON a.prim_id < b.prim_id AND {' AND '.join(f'a.min_{x} <= b.max_{x} AND a.max_{x} >= b.min_{x}' for x in 'xyz')}",
    "morton_code": f"WITH {TRI}, {BOUNDS}, {MORTON} SELECT triangle_id, morton FROM codes",
    "morton_order": f"WITH {TRI}, {BOUNDS}, {MORTON} SELECT triangle_id, pos AS position FROM leaves",
    "bvh_leaves": f"WITH {TRI}, {BOUNDS}, {MORTON} SELECT pos AS node_id, {B}, triangle_id, 1 AS n_tri FROM leaves",
    "nearest_cluster": f"WITH {TRI}, {BOUNDS}, {MORTON}, {NEAREST} SELECT pos, nn, area FROM near",
    "mutual_pairs": f"WITH {TRI}, {BOUNDS}, {MORTON}, {NEAREST} SELECT i, j, area FROM mutual",
    "ploc_step": f"WITH {TRI}, {BOUNDS}, {MORTON}, {NEAREST} SELECT (SELECT count(*) FROM leaves) + row_number() OVER (ORDER BY i) - 1 AS node_id, {', '.join(f'least(a.min_{x}, b.min_{x}) AS min_{x}, greatest(a.max_{x}, b.max_{x}) AS max_{x}' for x in 'xyz')}, 2 AS n_tri, i AS left_id, j AS right_id FROM mutual JOIN leaves a ON a.pos = i JOIN leaves b ON b.pos = j",
    **{name: f"{HIERARCHY} SELECT * FROM ploc" for name in ("bvh_ploc", "bvh_ploc_rounds")},
    "bvh_stats": f"""{HIERARCHY}, areas AS (SELECT n_tri, left_id, {AREA.format('max_x - min_x', 'max_y - min_y', 'max_z - min_z')} AS area FROM ploc)
SELECT count(*) AS n_nodes, count(*) FILTER (WHERE left_id IS NULL) AS n_leaves, max(n_tri) AS n_triangles,
  round(sum(area * CASE WHEN left_id IS NULL THEN n_tri ELSE 1 END) / nullif(max_by(area, n_tri), 0), 6) AS sah FROM areas""",
    "bvh_depths": f"""{HIERARCHY}, down AS (
  SELECT node_id, 0 AS depth, left_id, right_id FROM ploc WHERE n_tri = (SELECT max(n_tri) FROM ploc)
  UNION ALL SELECT p.node_id, depth + 1, p.left_id, p.right_id FROM down d JOIN ploc p ON p.node_id = d.left_id OR p.node_id = d.right_id)
SELECT node_id, depth FROM down""",
    "compact_scan": "SELECT o_orderkey AS pos, (o_orderstatus = 'O')::BIGINT AS valid, coalesce(sum((o_orderstatus = 'O')::BIGINT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS slot FROM orders",
    "sample_hemisphere": f"""WITH p AS (SELECT c_custkey, 1 - 2 * ({_UNIFORM.format(1)}) AS z, {_UNIFORM.format(2)} AS v FROM customer),
q AS (SELECT c_custkey, z, sqrt(greatest(0, 1 - z * z)) * cos(2 * pi() * v) AS x, sqrt(greatest(0, 1 - z * z)) * sin(2 * pi() * v) AS y, CASE WHEN z < 0 THEN -1 ELSE 1 END AS s FROM p)
SELECT c_custkey, round(x * s, 6) AS x, round(y * s, 6) AS y, round(z * s, 6) AS z FROM q""",
    "sample_cosine": f"SELECT c_custkey, round(cos(2 * pi() * {_U1}) * sqrt({_U2}), 6) AS x, round(sin(2 * pi() * {_U1}) * sqrt({_U2}), 6) AS y, round(sqrt(1 - {_U2}), 6) AS z FROM customer",
    "sample_disk": f"SELECT c_custkey, round(cos(2 * pi() * {_U1}) * sqrt({_U2}), 6) AS x, round(sin(2 * pi() * {_U1}) * sqrt({_U2}), 6) AS y FROM customer",
    "sample_to_sphere": f"""WITH z AS (SELECT c_custkey, {_U1} AS u, 1 + {_U2} * (sqrt(1 - 4.0::DOUBLE / 25.0) - 1) AS z FROM customer)
SELECT c_custkey, round(cos(2 * pi() * u) * sqrt(1 - z * z), 6) AS x, round(sin(2 * pi() * u) * sqrt(1 - z * z), 6) AS y, round(z, 6) AS z FROM z""",
    "sample_disk_rejection": _rejection("xy"),
    "sample_sphere_rejection": _rejection("xyz"),
    "sample_noise": "SELECT c_custkey, " + ", ".join(f"0.25::DOUBLE + 0.5::DOUBLE * ({_UNIFORM.format(i)}) AS {c}" for i, c in enumerate("rgb", 1)) + f", trunc(-5.0::DOUBLE + 11 * ({_UNIFORM.format(4)}))::INT AS n FROM customer",
    "materials": """WITH m AS (SELECT p_partkey AS mesh_id, (p_partkey * 3 % 17) / 8.0::DOUBLE AS er, (p_partkey * 5 % 17) / 8.0::DOUBLE AS eg, (p_partkey * 7 % 17) / 8.0::DOUBLE AS eb, p_size * 20.0::DOUBLE / 1000 AS smoothness, (p_partkey % 4) / 4.0::DOUBLE AS metallic FROM part)
SELECT mesh_id, greatest(er, eg, eb) AS strength, er * greatest(er, eg, eb, 1) AS er, eg * greatest(er, eg, eb, 1) AS eg, eb * greatest(er, eg, eb, 1) AS eb, smoothness, metallic FROM m""",
    "scene_graph": _graph(),
    "scene_snapshots": _snapshots(),
    "collapse": _tree_sql(BVH, "SELECT depth, path, n_prims FROM kept LEFT JOIN counts USING (depth, path) WHERE n_children IS DISTINCT FROM 1", _WIDE),
    "format_duration": """WITH n AS (SELECT o_orderkey, o_orderkey::DOUBLE * o_orderkey * o_orderkey * 97 + 0.5 AS ns FROM orders),
p AS (SELECT o_orderkey, floor((ns / 0.001::DOUBLE) % 1000)::INT AS ps, floor(ns % 1000)::INT AS n, floor((ns / 1e3::DOUBLE) % 1000)::INT AS us, floor((ns / 1e6::DOUBLE) % 1000)::INT AS ms,
  floor((ns / 1e9::DOUBLE) % 60)::INT AS s, floor((ns / 6e10::DOUBLE) % 60)::INT AS m, floor((ns / 3.6e12::DOUBLE) % 24)::INT AS h, floor(ns / 8.64e13::DOUBLE)::INT AS d FROM n)
SELECT o_orderkey, CASE WHEN d > 0 THEN d || ' days, ' ELSE '' END || CASE
  WHEN h > 0 THEN format('{}:{:02d}:{:02d}', h, m, s) WHEN m > 0 THEN format('{}:{:02d}.{:03d}', m, s, ms) WHEN s > 0 THEN format('{}.{:03d}s', s, ms)
  WHEN ms > 0 THEN format('{}.{:03d}ms', ms, us) WHEN us > 0 THEN format('{}.{:03d}us', us, n) WHEN n > 0 THEN format('{}.{:03d}ns', n, ps) ELSE ps || 'ps' END AS said FROM p""",
}
