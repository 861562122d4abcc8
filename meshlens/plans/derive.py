"""Meshes derived from the order lines, one segment for each supplier.

A vertex for each line, on a grid of 20 columns and as many rows as the lines
fill, two triangles a cell, holes, spikes and steps; with ``defects`` also
second sheets that cross the first (ids follow those of the first), edges with
three faces and degenerate faces.  ``MESH_SQL`` is the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def meshes(spark: SparkSession, sf_dir: str, defects: bool = True) -> tuple[DataFrame, DataFrame]:
    """vertices(segment_id, vertex_id, x, y, z), faces(segment_id, face_id, v0, v1, v2)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", *_ORDER)
    w = Window.partitionBy("l_suppkey").orderBy(*_ORDER)
    grid = lines.withColumns({"vertex_id": F.row_number().over(w).cast("long") - 1, "n": F.count("*").over(Window.partitionBy("l_suppkey"))})
    base = grid.selectExpr(
        "l_suppkey as segment_id", "vertex_id", "n", "cast(vertex_id % 20 as double) as x", "cast(vertex_id div 20 as double) as y",
        "2D * l_discount + if(l_quantity >= 49, 3D, 0D) + if(l_suppkey % 2 = 0 and vertex_id div 20 >= 10, 5D, 0D) as z", "l_tax", "l_quantity",
    )
    # what a line gives is an array: filters on the segment, unlike it, go below the windows, and each would shuffle the lines again
    two = "array(struct({id} + 2 * (vertex_id div 20 * 19 + vertex_id % 20) as face_id, {at} as v0, {at} + 1 as v1, {at} + 20 as v2), struct({id} + 2 * (vertex_id div 20 * 19 + vertex_id % 20) + 1 as face_id, {at} + 1 as v0, {at} + 21 as v1, {at} + 20 as v2))"
    points = ["array(struct(vertex_id, x, y, z))"]
    cells = [("vertex_id % 20 < 19 and vertex_id + 21 < n and not (l_tax >= 0.08 and l_quantity > 40)", two.format(id="0L", at="vertex_id"))]
    if defects:
        points.append("if(segment_id % 5 = 0, array(struct(vertex_id + n as vertex_id, x, y, (y - 10D) * 0.5D as z)), array())")
        cells.append(("segment_id % 5 = 0 and x < 19 and vertex_id + 21 < n", two.format(id="2 * n", at="n + vertex_id")))
        cells.append(("vertex_id = 0 and n > 23 and segment_id % 7 = 0", "array(struct(4 * n as face_id, 21L as v0, 22L as v1, n - 1 as v2))"))
        cells.append(("vertex_id = 0 and n > 23 and segment_id % 13 = 0", "array(struct(4 * n + 1 as face_id, 5L as v0, 5L as v1, 6L as v2))"))
    vertices = base.selectExpr("segment_id", f"explode(concat({', '.join(points)})) as p").select("segment_id", "p.*")
    faces = base.selectExpr("segment_id", f"explode(concat({', '.join(f'if({c}, {made}, array())' for c, made in cells)})) as f").select("segment_id", "f.*")
    return vertices, faces


MESH_SQL = """
    vb as (select l_suppkey segment_id, idx vertex_id, cast(idx % 20 as double) x, cast(idx // 20 as double) y,
        2e0 * l_discount + case when l_quantity >= 49 then 3e0 else 0e0 end + case when l_suppkey % 2 = 0 and idx // 20 >= 10 then 5e0 else 0e0 end z, l_tax, l_quantity, n
        from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_extendedprice) - 1 idx, count(*) over (partition by l_suppkey) n from lineitem)),
    v as (select segment_id, vertex_id, x, y, z from vb union all
        select segment_id, vertex_id + n, x, y, (y - 10) * 5e-1 from vb where segment_id % 5 = 0),
    kk as (select 0 k union all select 1),
    f as (select segment_id, 2 * (vertex_id // 20 * 19 + vertex_id % 20) + k face_id, vertex_id + k v0, vertex_id + 1 + 20 * k v1, vertex_id + 20 v2
        from vb, kk where vertex_id % 20 < 19 and vertex_id + 21 < n and not (l_tax >= 0.08 and l_quantity > 40)
        union all select segment_id, 2 * n + 2 * (vertex_id // 20 * 19 + vertex_id % 20) + k, n + vertex_id + k, n + vertex_id + 1 + 20 * k, n + vertex_id + 20 from vb, kk where segment_id % 5 = 0 and x < 19 and vertex_id + 21 < n
        union all select segment_id, 4 * n, 21, 22, n - 1 from vb where vertex_id = 0 and n > 23 and segment_id % 7 = 0
        union all select segment_id, 4 * n + 1, 5, 5, 6 from vb where vertex_id = 0 and n > 23 and segment_id % 13 = 0),
    t as (select f.*, a.x ax, a.y ay, a.z az, b.x bx, b.y b_y, b.z bz, c.x cx, c.y cy, c.z cz from f
        join v a on a.segment_id = f.segment_id and a.vertex_id = v0 join v b on b.segment_id = f.segment_id and b.vertex_id = v1 join v c on c.segment_id = f.segment_id and c.vertex_id = v2),
    e as (select *, sqrt((bx-ax)**2 + (b_y-ay)**2 + (bz-az)**2) l0, sqrt((cx-bx)**2 + (cy-b_y)**2 + (cz-bz)**2) l1, sqrt((ax-cx)**2 + (ay-cy)**2 + (az-cz)**2) l2,
        (b_y-ay)*(cz-az) - (bz-az)*(cy-ay) px, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) py, (bx-ax)*(cy-ay) - (b_y-ay)*(cx-ax) pz from t),
    g as (select *, case when least(l0, l1, l2) > 0 then greatest(l0, l1, l2) / least(l0, l1, l2) end aspect, 5e-1 * sqrt(px*px + py*py + pz*pz) area,
        least(case when l0*l2 > 0 then degrees(acos(greatest(-1e0, least(1e0, -((bx-ax)*(ax-cx) + (b_y-ay)*(ay-cy) + (bz-az)*(az-cz)) / (l0*l2))))) else 90e0 end,
              case when l0*l1 > 0 then degrees(acos(greatest(-1e0, least(1e0, -((bx-ax)*(cx-bx) + (b_y-ay)*(cy-b_y) + (bz-az)*(cz-bz)) / (l0*l1))))) else 90e0 end,
              case when l1*l2 > 0 then degrees(acos(greatest(-1e0, least(1e0, -((cx-bx)*(ax-cx) + (cy-b_y)*(ay-cy) + (cz-bz)*(az-cz)) / (l1*l2))))) else 90e0 end) min_angle from e),
    n as (select segment_id, face_id, area, case when area > 0 then px / (2*area) end nx, case when area > 0 then py / (2*area) end ny, case when area > 0 then pz / (2*area) end nz from g),
    h as (select segment_id, face_id, least(v0, v1) u, greatest(v0, v1) w from f union all select segment_id, face_id, least(v1, v2), greatest(v1, v2) from f union all select segment_id, face_id, least(v2, v0), greatest(v2, v0) from f),
    m as (select segment_id, u, w, count(*) faces from h group by all),
    adj as (select segment_id, face_id i, unnest([lead(face_id, 1) over p, case when lead(face_id, 2) over p is not null then lead(face_id, 2) over p end]) j from h window p as (partition by segment_id, u, w order by face_id)),
    pair as (select * from adj where j is not null)
"""


def with_mesh(body: str) -> str:
    return f"with recursive {MESH_SQL} {body}" if body.startswith(",") else f"with recursive {MESH_SQL}, {body}"
