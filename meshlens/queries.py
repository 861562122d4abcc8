"""The mesh engine's queries over the derived segments, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import faces as faces_op
from .operators import ct, graph, segments, volume
from .plans import clusters, scoring
from .plans.derive import meshes, with_mesh
from .sources.volumes import formula_chunks

AXIS = [(-5.0, 9.5, -40.0), (10.0, 8.5, -35.0), (30.0, 11.0, -45.0)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces_op.face_geometry(*meshes(spark, sf_dir))


def _r(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


def _quality(g: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.expr(f"if({c}, 1D, 0D)"))
    s = g.groupBy("segment_id").agg(share("coalesce(aspect, 1e300D) < 5").alias("a"), share("min_angle > 15").alias("b"), F.stddev_pop("area").alias("sd"), F.avg("area").alias("mean"))
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(1e9)
    return s.select("segment_id", F.round(0.4 * F.col("a") + 0.4 * F.col("b") + 0.2 * F.greatest(F.lit(0.0), 1 - cv), 6).alias("score"))


_QUALITY_SQL = "select segment_id, round(4e-1 * avg(case when coalesce(aspect, 1e300) < 5 then 1e0 else 0e0 end) + 4e-1 * avg(case when min_angle > 15 then 1e0 else 0e0 end) + 2e-1 * greatest(0e0, 1 - case when avg(area) > 0 then stddev_pop(area) / avg(area) else 1e9 end), 6) score from g group by segment_id"


@query(with_mesh("z as (select 1) select segment_id, face_id, round(l0, 6) l0, round(l1, 6) l1, round(l2, 6) l2 from g"))
def tri_edges(spark, sf_dir):
    return _geometry(spark, sf_dir).select("segment_id", "face_id", _r("l0"), _r("l1"), _r("l2"))


@query(with_mesh("z as (select 1) select segment_id, face_id, round(aspect, 6) aspect, round(min_angle, 6) min_angle, round(area, 6) area from g"))
def tri_shape(spark, sf_dir):
    return _geometry(spark, sf_dir).select("segment_id", "face_id", _r("aspect"), _r("min_angle"), _r("area"))


@query(with_mesh(f"z as (select 1) {_QUALITY_SQL}"))
def tri_quality(spark, sf_dir):
    return _quality(_geometry(spark, sf_dir))


@query(with_mesh("z as (select 1) select segment_id, face_id from g where coalesce(aspect, 1e300) >= 5 or min_angle <= 15"))
def problem_faces(spark, sf_dir):
    return faces_op.bad_faces(_geometry(spark, sf_dir))


@query(with_mesh("z as (select 1) select segment_id, face_id, round(nx, 6) + 0e0 nx, round(ny, 6) + 0e0 ny, round(nz, 6) + 0e0 nz from n"))
def face_normals(spark, sf_dir):
    return _geometry(spark, sf_dir).select("segment_id", "face_id", *((F.round(f"n{c}", 6) + 0.0).alias(f"n{c}") for c in "xyz"))


@query(with_mesh("""c as (select segment_id, unnest([v0, v1, v2]) vertex_id, px, py, pz from g),
    s as (select segment_id, vertex_id, sum(px) px, sum(py) py, sum(pz) pz, sqrt(sum(px)**2 + sum(py)**2 + sum(pz)**2) l from c group by all)
    select segment_id, vertex_id, round(case when l > 0 then px / l end, 5) + 0e0 nx, round(case when l > 0 then py / l end, 5) + 0e0 ny, round(case when l > 0 then pz / l end, 5) + 0e0 nz from s"""))
def vertex_normals(spark, sf_dir):
    n = faces_op.vertex_normals(_geometry(spark, sf_dir))
    return n.select("segment_id", "vertex_id", *((F.round(f"n{c}", 5) + 0.0).alias(f"n{c}") for c in "xyz"))


@query(with_mesh("z as (select 1) select segment_id, face_id, u, w from h"))
def half_edges(spark, sf_dir):
    return graph.half_edges(meshes(spark, sf_dir)[1])


@query(with_mesh("z as (select 1) select segment_id, faces, count(*) edges from m group by all"))
def edge_multiplicity(spark, sf_dir):
    return graph.edge_multiplicity(meshes(spark, sf_dir)[1]).groupBy("segment_id", "faces").agg(F.count("*").alias("edges"))


@query(with_mesh("z as (select 1) select segment_id, u, w from m where faces = 1"))
def boundary_edges(spark, sf_dir):
    return graph.boundary_edges(meshes(spark, sf_dir)[1])


@query(with_mesh("z as (select 1) select segment_id, i, j from pair"))
def face_adjacency(spark, sf_dir):
    return graph.face_pairs(meshes(spark, sf_dir)[1])


_DIHEDRAL = """d as (select p.segment_id, i, j, degrees(acos(greatest(-1e0, least(1e0, coalesce(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz, 0e0))))) angle from pair p
    join n a on a.segment_id = p.segment_id and a.face_id = i join n b on b.segment_id = p.segment_id and b.face_id = j)"""


def _dihedral(spark, sf_dir):
    v, f = meshes(spark, sf_dir)
    n = faces_op.face_geometry(v, f).select("segment_id", "face_id", "nx", "ny", "nz")
    side = lambda k, p: n.select("segment_id", F.col("face_id").alias(k), *(F.col(f"n{c}").alias(f"{p}{c}") for c in "xyz"))
    pairs = graph.face_pairs(f).join(side("i", "a"), ["segment_id", "i"]).join(side("j", "b"), ["segment_id", "j"])
    cosine = G.clip(F.coalesce(G.dot(G.vector("a"), G.vector("b")), F.lit(0.0)), -1.0, 1.0)
    return pairs.select("segment_id", "i", "j", F.degrees(F.acos(cosine)).alias("angle"))


@query(with_mesh(_DIHEDRAL + " select segment_id, i, j, round(angle, 4) angle from d"))
def dihedral(spark, sf_dir):
    return _dihedral(spark, sf_dir).select("segment_id", "i", "j", F.round("angle", 4).alias("angle"))


@query(with_mesh(_DIHEDRAL + " select segment_id, count(*) n_pairs, round(avg(case when angle < 30 then 1e0 else 0e0 end), 6) score from d group by segment_id"))
def normal_consistency(spark, sf_dir):
    return _dihedral(spark, sf_dir).groupBy("segment_id").agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.expr("if(angle < 30, 1D, 0D)")), 6).alias("score"))


_SEEN = """both_ as (select segment_id, i a, j b from pair where i <> j union select segment_id, j, i from pair where i <> j),
    cc(s, a, lab) using key (s, a) as (select segment_id, face_id, face_id from f union
        select e.segment_id, e.b, min(cc.lab) from cc join both_ e on e.segment_id = cc.s and e.a = cc.a join recurring.cc o on o.s = e.segment_id and o.a = e.b where cc.lab < o.lab group by e.segment_id, e.b)"""


@query(with_mesh(_SEEN + " select s segment_id, lab label, count(*) n_faces from cc group by all"))
def components(spark, sf_dir):
    f = meshes(spark, sf_dir)[1]
    found = graph.components(f.select("segment_id", F.col("face_id").alias("id")), graph.face_pairs(f))
    return found.groupBy("segment_id", "label").agg(F.count("*").alias("n_faces"))


_FANS = """en as (select distinct segment_id, face_id, u, w, unnest([u, w]) vx from h),
    lk0 as (select segment_id, vx, face_id a, lead(face_id) over (partition by segment_id, vx, u, w order by face_id) b from en),
    lk as (select segment_id, vx, a, b from lk0 where b is not null union select segment_id, vx, b, a from lk0 where b is not null),
    inc as (select distinct segment_id, unnest([v0, v1, v2]) vx, face_id from f),
    fc(s, x, a, lab) using key (s, x, a) as (select segment_id, vx, face_id, face_id from inc union
        select e.segment_id, e.vx, e.b, min(fc.lab) from fc join lk e on e.segment_id = fc.s and e.vx = fc.x and e.a = fc.a
        join recurring.fc o on o.s = e.segment_id and o.x = e.vx and o.a = e.b where fc.lab < o.lab group by e.segment_id, e.vx, e.b),
    fans as (select s, x, count(distinct lab) n from fc group by all),
    vm as (select s segment_id, count(*) filter (n > 1) n_pinched, count(*) n_vertices from fans group by s)"""


@query(with_mesh(_FANS + " select * from vm"))
def vertex_manifold(spark, sf_dir):
    return segments.pinched(meshes(spark, sf_dir)[1])


@query(with_mesh("""st as (select segment_id, u a, w b from m where u < w union select segment_id, w, u from m where u < w),
    r0 as (select segment_id, u k from m where faces = 1 union select segment_id, w from m where faces = 1),
    r1 as (select * from r0 union select st.segment_id, b from r0 join st on st.segment_id = r0.segment_id and st.a = r0.k),
    r2 as (select * from r1 union select st.segment_id, b from r1 join st on st.segment_id = r1.segment_id and st.a = r1.k),
    r3 as (select * from r2 union select st.segment_id, b from r2 join st on st.segment_id = r2.segment_id and st.a = r2.k)
    select segment_id, k vertex_id from r3"""))
def khop_boundary(spark, sf_dir):
    return graph.boundary_ring(meshes(spark, sf_dir)[1], 3)


_RINGS = """a1 as (select segment_id, i, j from pair union select segment_id, j, i from pair union select segment_id, face_id, face_id from f),
    a2 as (select distinct x.segment_id, x.i, y.j from a1 x join a1 y on y.segment_id = x.segment_id and y.i = x.j),
    a4 as (select distinct x.segment_id, x.i, y.j from a2 x join a2 y on y.segment_id = x.segment_id and y.i = x.j),
    a8 as (select distinct x.segment_id, x.i, y.j from a4 x join a4 y on y.segment_id = x.segment_id and y.i = x.j),
    sm as (select a8.segment_id, i, sum(coalesce(nx, 0)) sx, sum(coalesce(ny, 0)) sy, sum(coalesce(nz, 0)) sz from a8 join n on n.segment_id = a8.segment_id and n.face_id = a8.j group by all),
    dev as (select n.segment_id, face_id, area, degrees(acos(greatest(-1e0, least(1e0, coalesce((nx*sx + ny*sy + nz*sz) / sqrt(sx*sx + sy*sy + sz*sz), 0e0))))) deviation from n join sm on sm.segment_id = n.segment_id and sm.i = n.face_id)"""


@query(with_mesh(_RINGS + " select segment_id, face_id from dev where deviation > 35"))
def deviation_flags(spark, sf_dir):
    return segments.deviations(*meshes(spark, sf_dir)).filter("deviation > 35").select("segment_id", "face_id")


@query(with_mesh(_RINGS + """, fl as (select segment_id, face_id, area from dev where deviation > 35),
    fe as (select p.segment_id, i a, j b from pair p join fl x on x.segment_id = p.segment_id and x.face_id = i join fl y on y.segment_id = p.segment_id and y.face_id = j),
    fb as (select * from fe union select segment_id, b, a from fe),
    cc(s, a, lab) using key (s, a) as (select segment_id, face_id, face_id from fl union
        select e.segment_id, e.b, min(cc.lab) from cc join fb e on e.segment_id = cc.s and e.a = cc.a join recurring.cc o on o.s = e.segment_id and o.a = e.b where cc.lab < o.lab group by e.segment_id, e.b),
    big as (select s, lab, sum(area) area from cc join fl on fl.segment_id = s and fl.face_id = a group by s, lab having count(*) >= 20)
    select t.segment_id, round(case when b.area is null then 1e0 when t.total > 0 then 1 - b.area / t.total else 0e0 end, 6) score
    from (select segment_id, sum(area) total from n group by segment_id) t left join (select s, sum(area) area from big group by s) b on b.s = t.segment_id"""))
def sheet_switching(spark, sf_dir):
    return segments.measure(*meshes(spark, sf_dir), metrics=("sheet_switching",)).select("segment_id", _r("score"))


@query(with_mesh("pk as (select a.segment_id, a.vertex_id, b.vertex_id neighbour, round((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, 9) d2 from v a join v b on a.segment_id = b.segment_id), kn as (select *, row_number() over (partition by segment_id, vertex_id order by d2, neighbour) r from pk) select segment_id, vertex_id, cast(r as integer) rank, neighbour, round(d2, 6) d2 from kn where r <= 6"))
def knn(spark, sf_dir):
    near = segments.neighbours(meshes(spark, sf_dir)[0], 6)
    return near.withColumn("d2", F.round("d2", 6))


@query(with_mesh("""pk as (select a.segment_id, a.vertex_id, b.z, round((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, 9) d2, b.vertex_id o from v a join v b on a.segment_id = b.segment_id),
    kn as (select *, row_number() over (partition by segment_id, vertex_id order by d2, o) r from pk)
    select segment_id, vertex_id, round(sum(z / greatest(sqrt(d2), 1e-10)) / sum(1 / greatest(sqrt(d2), 1e-10)), 5) + 0e0 z from kn where r between 2 and 9 group by all"""))
def idw(spark, sf_dir):
    v = meshes(spark, sf_dir)[0]
    near = segments.neighbours(v, 9).filter("rank > 1")
    return volume.inverse_distance(near, v, "z").withColumn("z", F.round("z", 5) + 0.0)


@query(with_mesh("""st as (select segment_id, u a, w b from m where u < w union select segment_id, w, u from m where u < w),
    r0 as (select segment_id, u k from m where faces = 1 union select segment_id, w from m where faces = 1),
    r1 as (select * from r0 union select st.segment_id, b from r0 join st on st.segment_id = r0.segment_id and st.a = r0.k),
    r2 as (select * from r1 union select st.segment_id, b from r1 join st on st.segment_id = r1.segment_id and st.a = r1.k),
    r3 as (select * from r2 union select st.segment_id, b from r2 join st on st.segment_id = r2.segment_id and st.a = r2.k),
    ins as (select v.* from v anti join r3 on r3.segment_id = v.segment_id and r3.k = v.vertex_id),
    pk as (select a.segment_id, a.vertex_id, b.vertex_id o, round((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, 9) d2 from ins a join ins b on a.segment_id = b.segment_id),
    kn as (select *, row_number() over (partition by segment_id, vertex_id order by d2, o) r from pk),
    mn as (select segment_id, vertex_id, avg(sqrt(d2)) d from kn where r <= 20 group by all),
    st2 as (select segment_id, count(*) c, avg(d) + 5 * stddev_samp(d) bar from mn group by segment_id),
    bad as (select mn.segment_id, count(*) filter (not d < bar) n from mn join st2 using (segment_id) group by all)
    select t.segment_id, round(case when coalesce(c, 0) < 20 then 1e0 else 1 - 125e-1 * least(8e-2, n / nv) end, 6) score
    from (select segment_id, count(*) nv from v group by segment_id) t left join st2 using (segment_id) left join bad using (segment_id)"""))
def noise(spark, sf_dir):
    return segments.measure(*meshes(spark, sf_dir), metrics=("noise",)).select("segment_id", _r("score"))


@query()
def self_intersections(spark, sf_dir):
    return segments.measure(*meshes(spark, sf_dir), metrics=("self_intersections",)).select("segment_id", "score", F.col("details")["pairs"].cast("long").alias("n_pairs"))


@query(with_mesh(f"""{_FANS}, {_SEEN}, ed as (select segment_id, max(faces) most, count(*) filter (faces <> 2) odd from m group by all),
    ps as (select s segment_id, count(distinct lab) parts, count(*) n from cc group by s)
    select segment_id, round(4e-1 * (case when most <= 2 then 5e-1 else 0e0 end + case when n_pinched = 0 then 5e-1 else 0e0 end) + 3e-1 / parts
        + 3e-1 * least(1e0, greatest(0e0, 1 - odd / greatest(floor(15e-1 * n), 1))), 6) score, parts n_components, odd n_boundary_edges
    from ed join ps using (segment_id) join vm using (segment_id)"""))
def topology(spark, sf_dir):
    return segments.measure(*meshes(spark, sf_dir), metrics=("topology",)).select("segment_id", _r("score"), F.col("details")["n_components"].cast("long").alias("n_components"), F.col("details")["n_boundary_edges"].cast("long").alias("n_boundary_edges"))


_AXIS_VALUES = ", ".join(f"({y}e0, {x}e0, {z}e0)" for y, x, z in AXIS)
_WIND = f"""ax0 as (select * from (values {_AXIS_VALUES}) t(y0, x0, z0)),
    ax1 as (select *, lead(y0) over o y1, lead(x0) over o x1, lead(z0) over o z1, row_number() over o r from ax0 window o as (order by y0)),
    ax as (select *, case when r = 1 then -1e300 else y0 end lo, case when r = {len(AXIS) - 1} then 1e300 else y1 end hi from ax1 where y1 is not null),
    th as (select segment_id, vertex_id, x0 + (y - y0) / (y1 - y0) * (x1 - x0) ux, z0 + (y - y0) / (y1 - y0) * (z1 - z0) uz,
        degrees(atan2(z - (z0 + (y - y0) / (y1 - y0) * (z1 - z0)), x - (x0 + (y - y0) / (y1 - y0) * (x1 - x0)))) theta from v join ax on y >= lo and y < hi)"""


def axis_lookup(points: DataFrame, axis: list[tuple[float, float, float]]) -> DataFrame:
    """ux, uz of the axis at each point's y; the axis is a handful of literals, joined by range."""
    spark = points.sparkSession
    rows = sorted(axis)
    if len(rows) == 1:
        return points.withColumns({"ux": F.lit(rows[0][1]), "uz": F.lit(rows[0][2])})
    spans = [(-1e300 if k == 0 else a[0], 1e300 if k == len(rows) - 2 else b[0], *a, *b) for k, (a, b) in enumerate(zip(rows, rows[1:]))]
    table = spark.createDataFrame(spans, "lo double, hi double, ya double, xa double, za double, yb double, xb double, zb double")
    t = (F.col("y") - F.col("ya")) / (F.col("yb") - F.col("ya"))
    out = points.join(F.broadcast(table), (F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")))
    return out.select(*points.columns, (F.col("xa") + t * (F.col("xb") - F.col("xa"))).alias("ux"), (F.col("za") + t * (F.col("zb") - F.col("za"))).alias("uz"))


@query(with_mesh(_WIND + " select segment_id, vertex_id, round(ux, 6) ux, round(uz, 6) uz, round(theta, 6) theta from th"))
def umbilicus_lookup(spark, sf_dir):
    at = axis_lookup(meshes(spark, sf_dir)[0], AXIS)
    return at.select("segment_id", "vertex_id", _r("ux"), _r("uz"), F.round(G.polar_degrees(F.col("x"), F.col("z"), F.col("ux"), F.col("uz")), 6).alias("theta"))


@query(with_mesh(_WIND + """, st as (select segment_id, u a, w b from m where u < w union select segment_id, w, u from m where u < w),
    rc as (select segment_id, 0::bigint k from v where vertex_id = 0 union select st.segment_id, st.b from rc join st on st.segment_id = rc.segment_id and st.a = rc.k),
    ed as (select m.segment_id, abs(p.theta - q.theta) d from m join rc on rc.segment_id = m.segment_id and rc.k = m.u join th p on p.segment_id = m.segment_id and p.vertex_id = m.u join th q on q.segment_id = m.segment_id and q.vertex_id = m.w where m.u < m.w)
    select t.segment_id, round(case when e.c is null then 1e0 else greatest(0e0, least(1e0, 1 - e.bad / e.c / 5e-2)) end, 6) score
    from (select distinct segment_id from v) t left join (select segment_id, count(*) c, count(*) filter (d > 15) bad from ed group by segment_id) e using (segment_id)"""))
def winding(spark, sf_dir):
    return segments.measure(*meshes(spark, sf_dir), metrics=(), axis=AXIS).select("segment_id", _r("score"))


def _weighted(spark, sf_dir):
    return scoring.suppress(scoring.weigh(segments.measure(*meshes(spark, sf_dir)), "tier1"))


@query()
def ranking(spark, sf_dir):
    return scoring.ranking(_weighted(spark, sf_dir))


@query()
def json_report(spark, sf_dir):
    return scoring.json_reports(_weighted(spark, sf_dir))


@query()
def text_report(spark, sf_dir):
    return scoring.text_report(_weighted(spark, sf_dir))


@query()
def paint(spark, sf_dir):
    return scoring.paint(_weighted(spark, sf_dir))


_PLAIN = f"""q as ({_QUALITY_SQL}), {_DIHEDRAL}, nc as (select segment_id, round(avg(case when angle < 30 then 1e0 else 0e0 end), 6) score from d group by segment_id),
    ws as (select segment_id, 'triangle_quality' metric, score, 1e-1 weight from q union all select segment_id, 'normal_consistency', score, 1e-1 from nc)"""


def _plain(spark, sf_dir):
    """Two metrics that need no group step, as metric rows."""
    q = tri_quality(spark, sf_dir).select("segment_id", F.lit("triangle_quality").alias("metric"), "score")
    n = normal_consistency(spark, sf_dir).select("segment_id", F.lit("normal_consistency").alias("metric"), "score")
    none = F.lit(None).cast("map<string,double>")
    return scoring.suppress(scoring.weigh(q.union(n).withColumn("details", none), "tier1"))


@query(with_mesh(_PLAIN + """ select segment_id, round(sum(score * weight) / sum(weight), 4) aggregate_score,
    case when sum(score * weight) / sum(weight) >= 0.95 then 'A' when sum(score * weight) / sum(weight) >= 0.85 then 'B' when sum(score * weight) / sum(weight) >= 0.7 then 'C' when sum(score * weight) / sum(weight) >= 0.5 then 'D' else 'F' end grade from ws group by segment_id"""))
def tier_scores(spark, sf_dir):
    return scoring.aggregate(_plain(spark, sf_dir)).withColumn("aggregate_score", F.round("aggregate_score", 4))


@query(with_mesh(_PLAIN + " select segment_id, metric, round(weight / sum(weight) over (partition by segment_id), 6) weight from ws"))
def suppression(spark, sf_dir):
    return _plain(spark, sf_dir).select("segment_id", "metric", F.round("weight", 6).alias("weight"))


@query(with_mesh(_PLAIN + " select segment_id, first(metric order by score, metric = 'normal_consistency') worst_metric from ws where score < 1 group by segment_id"))
def worst_metric(spark, sf_dir):
    return _plain(spark, sf_dir).filter("score < 1").groupBy("segment_id").agg(scoring.worst().alias("worst_metric"))


@query(with_mesh(_PLAIN + " select segment_id, max(score) filter (metric = 'triangle_quality') triangle_quality, max(score) filter (metric = 'normal_consistency') normal_consistency from ws group by segment_id"))
def csv_pivot(spark, sf_dir):
    return _plain(spark, sf_dir).groupBy("segment_id").pivot("metric", ["triangle_quality", "normal_consistency"]).agg(F.max("score"))


@query(with_mesh("c as (select segment_id, unnest([v0, v1, v2]) vertex_id, area from g) select segment_id, vertex_id, round(avg(area), 6) area from c group by all"))
def incidence_avg(spark, sf_dir):
    g = _geometry(spark, sf_dir)
    return faces_op.incidence_average(g.select("segment_id", "face_id", "v0", "v1", "v2"), g.select("segment_id", "face_id", "area"), "area").withColumn("area", F.round("area", 6))


@query(with_mesh("""b as (select segment_id, face_id, (ax+bx+cx)/3 cx, (ay+b_y+cy)/3 cy, (az+bz+cz)/3 cz from t), s as (select segment_id, min(cx) a, max(cx) A2, min(cy) b, max(cy) B2, min(cz) c, max(cz) C2 from b group by all)
    select segment_id, cast(least(7, floor((cx - s.a) / case when s.A2 = s.a then 1 else s.A2 - s.a end * (8 - 1e-9))) as integer) ix, cast(least(7, floor((cy - s.b) / case when s.B2 = s.b then 1 else s.B2 - s.b end * (8 - 1e-9))) as integer) iy, count(*) n
    from b join s using (segment_id) group by all"""))
def grid_partition(spark, sf_dir):
    g = _geometry(spark, sf_dir).select("segment_id", "face_id", "cx", "cy", "cz")
    return faces_op.grid_cells(g).groupBy("segment_id", "ix", "iy").agg(F.count("*").alias("n"))


@query(with_mesh(_DIHEDRAL + ", s as (select unnest([5, 10, 15, 20, 30, 45, 60, 90]) threshold) select threshold, count(*) filter (angle < threshold) n_below, count(*) n from d, s group by threshold"))
def threshold_sweep(spark, sf_dir):
    steps = F.explode(F.array(*(F.lit(t) for t in (5, 10, 15, 20, 30, 45, 60, 90)))).alias("threshold")
    return _dihedral(spark, sf_dir).select("angle", steps).groupBy("threshold").agg(F.count_if(F.col("angle") < F.col("threshold")).alias("n_below"), F.count("*").alias("n"))


@query(with_mesh("z as (select 1) select segment_id, face_id, cast(floor(greatest(0, least(1, 2 * (min_angle / 45))) * 255) as integer) r, cast(floor(greatest(0, least(1, 2 - 2 * greatest(0, least(1, min_angle / 45)))) * 255) as integer) g, 0 b from g"))
def heatmap(spark, sf_dir):
    r, g, b = G.heat_rgb(F.col("min_angle"))
    return _geometry(spark, sf_dir).select("segment_id", "face_id", r.alias("r"), g.alias("g"), b.alias("b"))


_VOXEL = "((iz * 7 + iy * 3 + ix * 5) % 200)"


def _voxels(spark, n: int = 24) -> DataFrame:
    axes = spark.range(n**3).selectExpr(f"cast(id div {n * n} as int) as iz", f"cast(id div {n} % {n} as int) as iy", f"cast(id % {n} as int) as ix")
    return axes.withColumn("value", F.expr(f"cast({_VOXEL} as double)"))


@query(with_mesh(f"p as (select segment_id, vertex_id, cast(round_even(z / 2, 0) as integer) iz, cast(round_even(y / 2, 0) as integer) iy, cast(round_even(x / 2, 0) as integer) ix from v) select segment_id, vertex_id, case when iz between 0 and 23 and iy between 0 and 23 and ix between 0 and 23 then cast({_VOXEL} as double) else 0e0 end as value from p"))
def voxel_lookup(spark, sf_dir):
    at = volume.to_voxel(meshes(spark, sf_dir)[0], 2.0)
    return volume.voxel_values(at, _voxels(spark)).select("segment_id", "vertex_id", "value")


@query("select user_id sample_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) pos, value from events")
def event_profiles(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("sample_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"), "value")


@query()
def layer_distance(spark, sf_dir):
    return segments.layer_scores(event_profiles(spark, sf_dir))


@query(with_mesh(f"""c as (select segment_id, unnest([v0, v1, v2]) vertex_id, px, py, pz from g),
    s as (select segment_id, vertex_id, sum(px) px, sum(py) py, sum(pz) pz, sqrt(sum(px)**2 + sum(py)**2 + sum(pz)**2) l from c group by all),
    pt as (select segment_id * 1000000 + vertex_id sample_id, pos, cast(round_even(z + pos * pz / l, 0) as integer) - 1 iz, cast(round_even(y + pos * py / l, 0) as integer) - 1 iy, cast(round_even(x + pos * px / l, 0) as integer) - 1 ix
        from v join s using (segment_id, vertex_id), range(-6, 7) t(pos) where l > 0)
    select sample_id, cast(pos as integer) pos, case when iz between 0 and 23 and iy between 0 and 23 and ix between 0 and 23 then cast({_VOXEL} as double) else 0e0 end as value from pt"""))
def ray_profile(spark, sf_dir):
    v, f = meshes(spark, sf_dir)
    n = faces_op.vertex_normals(faces_op.face_geometry(v, f)).filter("nx is not null")
    samples = v.join(n, ["segment_id", "vertex_id"]).withColumn("sample_id", F.col("segment_id") * 1_000_000 + F.col("vertex_id"))
    return volume.ray_profiles(samples, _voxels(spark), 6)


@query(with_mesh("""pk as (select a.segment_id, a.vertex_id, a.z > 3 own, b.z > 3 other, b.vertex_id o, round((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, 9) d2 from v a join v b on a.segment_id = b.segment_id),
    kn as (select *, row_number() over (partition by segment_id, vertex_id order by d2, o) r from pk),
    vt as (select segment_id, vertex_id, count(*) filter (own <> other) diff, count(*) filter (own = other) same from kn where r <= 7 and o <> vertex_id group by all)
    select segment_id, round(greatest(0e0, least(1e0, 1 - avg(case when diff > same then 1e0 else 0e0 end + case when same / (same + diff) < 5e-1 then 1e0 else 0e0 end) / 25e-2)), 6) score from vt group by segment_id"""))
def fiber_vote(spark, sf_dir):
    v = meshes(spark, sf_dir)[0]
    s = v.withColumns({"fiber_class": F.when(F.col("z") > 3, 2).otherwise(1), "dx": F.when(F.col("z") > 3, 0.0).otherwise(1.0), "dy": F.lit(0.0), "dz": F.when(F.col("z") > 3, 1.0).otherwise(0.0)})
    votes = volume.fiber_votes(s, segments.neighbours(v, 7))
    bad = F.avg(F.col("flip").cast("double") + F.col("broken").cast("double"))
    return votes.groupBy("segment_id").agg(G.falling_score(bad, 0.25).alias("score")).withColumn("score", F.round("score", 6))


_SHAPE, _EDGE = (48, 48, 48), 16


def _chunks(spark):
    """A volume of 48 x 48 x 48 voxels: layers along z, ripples along x."""
    return formula_chunks(spark, lambda iz, iy, ix: (iz * 7 + iy * 3 + ix * 5) % 200, _SHAPE, _EDGE)


def _place(xyz):
    """Voxels (iz, iy, ix) of mesh points (x, y, z) in that volume."""
    return np.column_stack((np.rint(xyz[:, 2] * 2 + 15), np.rint(xyz[:, 1] + 14), np.rint(xyz[:, 0] + 14))).astype(int)


def _on_segments(spark, sf_dir, work, schema: str, n: int = 500):
    """``ct.on_segments`` over the volume, or None if that is too large to hold."""
    volume = ct.held(_chunks(spark), _EDGE)
    return None if volume is None else ct.on_segments(*meshes(spark, sf_dir), volume, _place, work, schema, n)


def _samples(spark, sf_dir, n: int = 500):
    """Up to n vertices of each segment, the metrics' own sample among those in bounds, placed in the volume, with normals."""
    v, f = meshes(spark, sf_dir)
    n_ = faces_op.vertex_normals(faces_op.face_geometry(v, f))
    placed = v.withColumns({"iz": F.rint(F.col("z") * 2 + 15).cast("int"), "iy": F.rint(F.col("y") + 14).cast("int"), "ix": F.rint(F.col("x") + 14).cast("int")})
    sampled = ct.sample_vertices(volume.in_bounds(placed, _SHAPE, 4), n)
    return sampled.join(n_, ["segment_id", "vertex_id"]).withColumn("sample_id", F.col("segment_id") * 1_000_000 + F.col("vertex_id"))


@query(with_mesh(f"""p as (select segment_id, vertex_id, cast(round_even(z * 4, 0) as integer) + 20 iz, cast(round_even(y, 0) as integer) * 3 iy, cast(round_even(x, 0) as integer) + 2 ix from v)
    select segment_id, vertex_id, case when iz < 48 and iy < 48 and ix < 48 and iz >= 0 then cast({_VOXEL} as double) else 0e0 end as value from p"""))
def chunk_lookup(spark, sf_dir):
    at = meshes(spark, sf_dir)[0].select("segment_id", "vertex_id", (F.rint(F.col("z") * 4).cast("int") + 20).alias("iz"), (F.rint("y").cast("int") * 3).alias("iy"), (F.rint("x").cast("int") + 2).alias("ix"))
    return ct.chunk_values(at, _chunks(spark), _EDGE, parts=4).select("segment_id", "vertex_id", "value")


def _segments(spark, sf_dir):
    return meshes(spark, sf_dir)[0].select("segment_id").distinct()


@query()
def ct_sheet_switching(spark, sf_dir):
    rows = _on_segments(spark, sf_dir, ct.held_switching(half=4, sigma=2.0), ct.SCORED)
    if rows is None:
        rows = ct.ct_sheet_switching(_segments(spark, sf_dir), meshes(spark, sf_dir)[1], _samples(spark, sf_dir), _chunks(spark), _EDGE, half=4, sigma=2.0)
    return rows.select("segment_id", _r("score"), F.size("problem_faces").alias("n_problem_faces"))


@query()
def fiber_coherence(spark, sf_dir):
    rows = _on_segments(spark, sf_dir, ct.held_coherence(4), ct.SCORED, 300)
    if rows is None:
        s = _samples(spark, sf_dir, 300)
        fibers = ct.cube_fibers(ct.cubes(s, _chunks(spark), 4, _EDGE), 4)
        rows = ct.fiber_coherence(_segments(spark, sf_dir), meshes(spark, sf_dir)[1], s, fibers)
    return rows.select("segment_id", _r("score"), F.size("problem_faces").alias("n_problem_faces"))


@query()
def ct_layer_distance(spark, sf_dir):
    rows = _on_segments(spark, sf_dir, ct.held_layers(reach=40), ct.SCORED, 300)
    if rows is None:
        rows = ct.layer_distance(_segments(spark, sf_dir), meshes(spark, sf_dir)[1], _samples(spark, sf_dir, 300), _chunks(spark), _EDGE, reach=40)
    return rows.select("segment_id", _r("score"), F.size("problem_faces").alias("n_problem_faces"))


@query()
def ct_alignment(spark, sf_dir):
    rows = _on_segments(spark, sf_dir, ct.held_alignment(4, 2.0), ct.ALIGNED)
    if rows is not None:
        return rows
    s = _samples(spark, sf_dir)
    angles = ct.normal_angles(s, ct.cube_normals(ct.cubes(s, _chunks(spark), 4, _EDGE), 4, 2.0))
    values = ct.chunk_values(s.select("segment_id", "iz", "iy", "ix"), _chunks(spark), _EDGE, parts=4)
    return ct.alignment(s, _SHAPE, values, angles)


@query(with_mesh(_RINGS + """, fl as (select segment_id, face_id, area from dev where deviation > 35),
    fe as (select p.segment_id, i a, j b from pair p join fl x on x.segment_id = p.segment_id and x.face_id = i join fl y on y.segment_id = p.segment_id and y.face_id = j),
    fb as (select * from fe union select segment_id, b, a from fe),
    cc(s, a, lab) using key (s, a) as (select segment_id, face_id, face_id from fl union
        select e.segment_id, e.b, min(cc.lab) from cc join fb e on e.segment_id = cc.s and e.a = cc.a join recurring.cc o on o.s = e.segment_id and o.a = e.b where cc.lab < o.lab group by e.segment_id, e.b),
    big as (select s segment_id, lab from cc group by s, lab having count(*) >= 20),
    mb as (select cc.s segment_id, cc.lab, cc.a face_id from cc join big on big.segment_id = cc.s and big.lab = cc.lab),
    cen as (select segment_id, face_id, (ax+bx+cx)/3 cx, (ay+b_y+cy)/3 cy, (az+bz+cz)/3 cz from t),
    rf as (select distinct h.segment_id, h.face_id from h join m on m.segment_id = h.segment_id and m.u = h.u and m.w = h.w where faces = 1),
    hd as (select mb.segment_id, mb.lab, count(*) face_count, avg(cx) mx, avg(cy) my, avg(cz) mz, count(rf.face_id) / count(*) bf
        from mb join cen using (segment_id, face_id) left join rf using (segment_id, face_id) group by all),
    tp as (select *, row_number() over (partition by segment_id order by face_count desc, lab) rank from hd),
    nr as (select tp.segment_id, rank, face_id, cz, row_number() over (partition by tp.segment_id, rank order by round((cx-mx)**2 + (cy-my)**2 + (cz-mz)**2, 9), face_id) nth from tp join cen using (segment_id) where rank <= 30),
    zj as (select nr.segment_id, rank, round(abs(median(cz) filter (mb.face_id is not null) - median(cz) filter (mb.face_id is null)), 1) z from nr left join mb using (segment_id, face_id) where nth <= 500 group by all)
    select segment_id, cast(rank as integer) rank, face_count, round(mx, 9) mx, round(my, 9) my, round(mz, 9) mz, round(bf, 2) boundary_frac, coalesce(z, 0e0) z_jump from tp join zj using (segment_id, rank)"""))
def problem_clusters(spark, sf_dir):
    v, f = meshes(spark, sf_dir)
    found = clusters.cluster_faces(segments.measure(v, f, metrics=("sheet_switching",)), f)
    top = clusters.describe(found, faces_op.face_geometry(v, f), f, segments.deviations(v, f))
    return top.select("segment_id", "rank", "face_count", *(F.round(f"m{c}", 9).alias(f"m{c}") for c in "xyz"), "boundary_frac", "z_jump")


_FRAGMENTS = "select s_suppkey fragment_id, cast(40 + s_suppkey % 7 as integer) height, cast(50 + s_suppkey % 5 as integer) width from supplier"


def _fragments(spark, sf_dir, parts: int = 96, each: int = 64):
    """Fragments dealt by their id before they grow to tiles and pixels, which then need no shuffle.

    A task sorts the pixels of its fragments, ``each`` on average at most.
    """
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    parts = max(parts, -(-own.count() // each))
    return own.repartition(parts, "s_suppkey").select(F.col("s_suppkey").alias("fragment_id"), (40 + F.col("s_suppkey") % 7).cast("int").alias("height"), (50 + F.col("s_suppkey") % 5).cast("int").alias("width"))


@query(f"with f as ({_FRAGMENTS}), y as (select fragment_id, width, unnest(range(0, height - 15, 8)) y0 from f) select fragment_id, cast(y0 as integer) y0, cast(unnest(range(0, width - 15, 8)) as integer) x0 from y")
def tile_index(spark, sf_dir):
    return volume.tile_origins(_fragments(spark, sf_dir), 16, 8)


_TILE_PX = f"""f as ({_FRAGMENTS}), ys as (select fragment_id, width, unnest(range(0, height - 15, 8)) y0 from f), ti as (select fragment_id, y0, unnest(range(0, width - 15, 8)) x0 from ys),
    px as (select fragment_id, y0 + ty y, x0 + tx x, ((y0 + x0 * 3 + ty * tx) % 101) / 1e2 as value, exp(-((ty * 16 / 15e0 - 8)**2 + (tx * 16 / 15e0 - 8)**2 - 2 * (8 / 15e0)**2) / 32e0) g from ti, range(16) a(ty), range(16) b(tx)),
    bl as (select fragment_id, y, x, least(1e0, greatest(0e0, sum(value * g) / sum(g))) as value from px group by all)"""


def _blend(spark, sf_dir):
    px = volume.tile_pixels(volume.tile_origins(_fragments(spark, sf_dir), 16, 8), 16)
    return volume.blend(px.withColumn("value", F.expr("((y0 + x0 * 3 + ty * tx) % 101) / 1e2D")), 16)


@query(f"with {_TILE_PX} select fragment_id, cast(y as integer) y, cast(x as integer) x, round(value, 6) as value from bl")
def tile_blend(spark, sf_dir):
    return _blend(spark, sf_dir).withColumn("value", F.round("value", 6))


@query(f"with {_TILE_PX}, l as (select *, case when (x + y) % 3 = 0 then 1e0 else 0e0 end lab, case when value > 5e-1 then 1e0 else 0e0 end p from bl) select fragment_id, round(2 * sum(p * lab) / (sum(p) + sum(lab) + 1e-8), 6) dice from l group by fragment_id")
def dice(spark, sf_dir):
    return volume.dice(_blend(spark, sf_dir).withColumn("label", F.expr("if((x + y) % 3 = 0, 1D, 0D)"))).withColumn("dice", F.round("dice", 6))


_PATH_SQL = """select o_orderkey, '/data/' || case when o_orderkey % 5 = 0 then 'PHercParis' || o_custkey || 'Fr7' else 'PHerc' || o_custkey end || case when o_orderkey % 2 = 0 then 'B' else '' end || '/paths/'
    || case when o_orderkey % 3 = 0 then '20231001' || lpad(cast(o_orderkey as varchar), 6, '0') || '_v2' else 'auto' end || '.obj' path from orders"""


@query(rf"""select o_orderkey, nullif(regexp_extract(path, 'PHerc\d+[A-Z]?|PHercParis\d+(?:Fr\d+)?', 0), '') scroll,
    coalesce(nullif(regexp_extract(regexp_extract(path, '([^/]*)\.obj$', 1), '\d{{14}}', 0), ''), regexp_extract(path, '([^/]*)\.obj$', 1)) segment from ({_PATH_SQL})""")
def id_extract(spark, sf_dir):
    path = F.concat(F.lit("/data/"), F.expr("if(o_orderkey % 5 = 0, 'PHercParis' || o_custkey || 'Fr7', 'PHerc' || o_custkey)"), F.expr("if(o_orderkey % 2 = 0, 'B', '')"), F.lit("/paths/"), F.expr("if(o_orderkey % 3 = 0, '20231001' || lpad(cast(o_orderkey as string), 6, '0') || '_v2', 'auto')"), F.lit(".obj"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", path.alias("path"))
    return orders.select("o_orderkey", G.scroll_id(F.col("path")).alias("scroll"), G.segment_name(F.col("path")).alias("segment"))


_TIERS = "select fragment_id, y0, x0, coverage from cv where coverage > 5e-1"


@query(f"""with f as ({_FRAGMENTS}), ys as (select fragment_id, width, unnest(range(0, height - 15, 8)) y0 from f), ti as (select fragment_id, y0, unnest(range(0, width - 15, 8)) x0 from ys),
    cv as (select fragment_id, cast(y0 as integer) y0, cast(x0 as integer) x0, count(*) filter ((y0 + ty + x0 + tx) % 7 < (fragment_id + y0 + ty) % 8) / 256e0 coverage from ti, range(16) a(ty), range(16) b(tx) group by all) {_TIERS}""")
def tile_coverage(spark, sf_dir):
    fragments = _fragments(spark, sf_dir)
    cells = fragments.withColumn("y", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))
    mask = cells.selectExpr("fragment_id", "y", "x", "if((y + x) % 7 < (fragment_id + y) % 8, 1D, 0D) as mask")
    return volume.covered_tiles(volume.tile_origins(fragments, 16, 8), mask, 16)


@query("""with p as (select vec_id, label, embedding[1]::double z, case when vec_id % 9 = 0 then null else (vec_id % 50) / 49e0 end t from embeddings),
    h as (select *, least(greatest(0e0, least(1e0, t)) * 300, 29999e-2) / 60 hue from p)
    select vec_id, case when t is null then 127 else cast(floor(greatest(0e0, least(1e0, abs(hue - 3) - 1)) * 255) as integer) end r,
        case when t is null then 127 else cast(floor(greatest(0e0, least(1e0, 2 - abs(hue - 2))) * 255) as integer) end g,
        case when t is null then 127 else cast(floor(greatest(0e0, least(1e0, 2 - abs(hue - 4))) * 255) as integer) end b from h""")
def hue_ramp(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", "if(vec_id % 9 = 0, null, (vec_id % 50) / 49D) as t")
    r, g, b = G.hue_rgb(F.col("t"))
    return e.select("vec_id", r.alias("r"), g.alias("g"), b.alias("b"))


@query("""with p as (select vec_id, case when vec_id % 9 = 0 then 0e0 else 1e0 end as value, (vec_id % 50) / 49e0 t from embeddings)
    select vec_id, case when value <= 0 then 10 else cast(floor(30 + t * 225) as integer) end r, case when value <= 0 then 8 else cast(floor(20 + t * 210) as integer) end g, case when value <= 0 then 6 else cast(floor(10 + t * 175) as integer) end b from p""")
def warm_ramp(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", "if(vec_id % 9 = 0, 0D, 1D) as value", "(vec_id % 50) / 49D as t")
    r, g, b = G.warm_rgb(F.col("t"), F.col("value"))
    return e.select("vec_id", r.alias("r"), g.alias("g"), b.alias("b"))


_MASKED = f"{_TILE_PX}, ys2 as (select fragment_id, width, unnest(range(0, height)) y from f), al as (select fragment_id, y, unnest(range(0, width)) x from ys2), mk as (select fragment_id, y, x, case when (y + x) % 5 = 0 then 0e0 else 1e0 end mask from al), bm as (select fragment_id, y, x, coalesce(value, 0e0) * mask as value from mk left join bl using (fragment_id, y, x))"


def _masked(spark, sf_dir):
    cells = _fragments(spark, sf_dir).withColumn("y", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))
    px = volume.tile_pixels(volume.tile_origins(_fragments(spark, sf_dir), 16, 8), 16)
    return volume.blend(px.withColumn("value", F.expr("((y0 + x0 * 3 + ty * tx) % 101) / 1e2D")), 16, cells.selectExpr("fragment_id", "y", "x", "if((y + x) % 5 = 0, 0D, 1D) as mask"))


@query(f"with {_MASKED} select fragment_id, cast(y as integer) y, cast(x as integer) x, round(value, 6) as value from bm")
def masked_blend(spark, sf_dir):
    return _masked(spark, sf_dir).withColumn("value", F.round("value", 6))


@query(f"""with {_MASKED}, l as (select *, case when (x + y) % 3 = 0 then 1e0 else 0e0 end lab, least(1 - 1e-7, greatest(1e-7, value)) p from bm),
    r as (select fragment_id, avg(-(lab * ln(p) + (1 - lab) * ln(1 - p))) bce, 1 - (2 * sum(value * lab) + 1) / (sum(value) + sum(lab) + 1) dice_loss from l group by fragment_id)
    select fragment_id, round(bce, 6) bce, round(dice_loss, 6) dice_loss, round(bce + dice_loss, 6) loss from r""")
def training_loss(spark, sf_dir):
    found = volume.losses(_masked(spark, sf_dir).withColumn("label", F.expr("if((x + y) % 3 = 0, 1D, 0D)")))
    return found.select("fragment_id", *(F.round(c, 6).alias(c) for c in ("bce", "dice_loss", "loss")))


@query(with_mesh("z as (select 1) select segment_id, round(avg(aspect), 6) mean_aspect from g group by segment_id"))
def mean_aspect(spark, sf_dir):
    return _geometry(spark, sf_dir).groupBy("segment_id").agg(F.round(F.avg("aspect"), 6).alias("mean_aspect"))


@query(with_mesh("""ed as (select m.segment_id, abs(a.z - b.z) / greatest(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 1e-12) gr from m join v a on a.segment_id = m.segment_id and a.vertex_id = m.u join v b on b.segment_id = m.segment_id and b.vertex_id = m.w where m.u < m.w)
    select segment_id, count(*) n, round(avg(gr), 6) mean_gradient, round(max(gr), 6) max_gradient from ed group by segment_id"""))
def edge_gradient(spark, sf_dir):
    v, f = meshes(spark, sf_dir)
    found = faces_op.edge_gradient(v, graph.vertex_edges(f), "z")
    return found.groupBy("segment_id").agg(F.count("*").alias("n"), F.round(F.avg("gradient"), 6).alias("mean_gradient"), F.round(F.max("gradient"), 6).alias("max_gradient"))


@query(with_mesh("c as (select segment_id, avg(z) cz from v group by segment_id) select segment_id, vertex_id from v join c using (segment_id) where abs(z - cz) < 2 * 1.5e0"))
def z_band(spark, sf_dir):
    v = meshes(spark, sf_dir)[0]
    return v.join(v.groupBy("segment_id").agg(F.avg("z").alias("cz")), "segment_id").filter(F.abs(F.col("z") - F.col("cz")) < 2 * 1.5).select("segment_id", "vertex_id")


@query("select doc_id, cast(('0x' || substr(md5('0:' || doc_id), 1, 8)) as bigint) % 1000 < 800 training from documents")
def random_split(spark, sf_dir):
    return volume.split(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")


@query("select event_id, round(1 / (1 + exp(-value / 50)), 6) p, round(least(200e0, greatest(0e0, value)) / 200, 6) intensity from events")
def sigmoid_intensity(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.round(volume.sigmoid(F.col("value") / 50), 6).alias("p"), F.round(volume.intensity(F.col("value")), 6).alias("intensity"))


_MASKS = "select s_suppkey fragment_id, unnest(range(0, 12)) px, case when s_suppkey % 3 = 0 then (unnest(range(0, 12)) * 23) % 256 else (unnest(range(0, 12)) % 2) end * 1e0 as value from supplier"


@query(f"select fragment_id, px, value / case when max(value) over (partition by fragment_id) > 1 then 255e0 else 1e0 end as value from ({_MASKS})")
def mask_scaling(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as fragment_id", "explode(sequence(0L, 11L)) as px")
    return volume.scaled_mask(own.withColumn("value", F.expr("if(fragment_id % 3 = 0, (px * 23) % 256, px % 2) * 1D")))


@query("""with l as (select s_suppkey fragment_id, unnest(range(0, 20)) layer from supplier), have as (select * from l where (fragment_id + layer) % 6 <> 0),
    asked as (select distinct fragment_id, unnest(range(3, 15)) layer from have) select fragment_id, layer from asked anti join have using (fragment_id, layer)""")
def missing_layers(spark, sf_dir):
    have = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as fragment_id", "explode(sequence(0L, 19L)) as layer").filter("(fragment_id + layer) % 6 <> 0")
    return volume.missing_layers(have, 3, 15).select("fragment_id", F.col("layer").cast("long").alias("layer"))


@query(with_mesh("""cl as (select segment_id, vertex_id, floor(x / 2.5e0) a, floor(y / 2.5e0) b, floor(z / 2.5e0) c from v), mn as (select segment_id, a, b, c, min(vertex_id) n from cl group by all),
    mv as (select cl.segment_id, vertex_id, n from cl join mn using (segment_id, a, b, c)),
    nf as (select f.segment_id, face_id, p.n a, q.n b, r.n c from f join mv p on p.segment_id = f.segment_id and p.vertex_id = v0 join mv q on q.segment_id = f.segment_id and q.vertex_id = v1 join mv r on r.segment_id = f.segment_id and r.vertex_id = v2),
    ok as (select *, row_number() over (partition by segment_id, list_sort([a, b, c]) order by face_id) k from nf where a <> b and b <> c and c <> a)
    select segment_id, face_id, a v0, b v1, c v2 from ok where k = 1"""))
def decimated_faces(spark, sf_dir):
    return faces_op.decimate(*meshes(spark, sf_dir), 2.5)[1]


@query("""select event_id, case when s >= 0.9 then 'green' when s >= 0.75 then 'blue' when s >= 0.5 then 'orange' else 'red' end page, case when s >= 0.95 then 'green' when s >= 0.85 then 'yellow' else 'red' end batch, case when s >= 0.75 then 'good' when s >= 0.5 then 'fair' else 'poor' end text
    from (select event_id, (event_id % 101) / 1e2 s from events)""")
def colour_buckets(spark, sf_dir):
    s = (F.col("event_id") % 101) / 100.0
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", G.bucket(s, (0.9, 0.75, 0.5), ("green", "blue", "orange", "red")).alias("page"), G.bucket(s, (0.95, 0.85), ("green", "yellow", "red")).alias("batch"), G.bucket(s, (0.75, 0.5), ("good", "fair", "poor")).alias("text"))


def _summed(name: str, key: str, columns: tuple[str, ...]):
    """A query's rows as counts and sums for each key, beside the full rows."""

    def sums(spark, sf_dir):
        return QUERIES[name](spark, sf_dir).groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(c).cast("double")), 6).alias(f"sum_{c}") for c in columns))

    sums.__name__ = f"{name}_sums"
    body = ", ".join(f"round(sum(cast({c} as double)), 6) sum_{c}" for c in columns)
    return query(f"select {key}, count(*) n, {body} from ({ORACLE_SQL[name]}) group by {key}")(sums)


for _name, _key, _columns in (
    ("tri_edges", "segment_id", ("l0", "l1", "l2")), ("tri_shape", "segment_id", ("area", "min_angle")), ("problem_faces", "segment_id", ("face_id",)), ("face_normals", "segment_id", ("nx", "ny", "nz")),
    ("dihedral", "segment_id", ("angle",)), ("heatmap", "segment_id", ("r", "g", "b")), ("ray_profile", "pos", ("value",)),
):
    _summed(_name, _key, _columns)
