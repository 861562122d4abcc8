"""A review page of one segment: scores, clusters and the mesh in colours, in one HTML file."""

from __future__ import annotations

import base64
import html
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import heat_rgb, status_colour
from ..operators.faces import incidence_average

_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:1em;background:#fff;color:#222}}td,th{{padding:2px 8px;text-align:left}}.badge{{font-size:11px;border:1px solid;padding:0 4px}}</style>
<h1>{title}</h1><p>Score {score:.3f}, grade {grade}</p>
<table><tr><th>metric<th>score<th>weight</tr>{metrics}</table>
<canvas id="view" width="900" height="600" style="border:1px solid #ccc"></canvas><p>Drag turns, the wheel zooms.</p>
<table><tr><th>cluster<th>faces<th>sources<th>centroid<th>mean deviation<th>z jump<th></tr>{clusters}</table>
<script>
const read=(s,T)=>new T(Uint8Array.from(atob(s),c=>c.charCodeAt(0)).buffer);
const xyz=read("{xyz}",Float32Array),rgb=read("{rgb}",Uint8Array),n=xyz.length/3;
const view=document.getElementById("view"),g=view.getContext("2d");let a=0.6,b=0.5,zoom=1,c=[0,0,0],reach=1e-9;
for(let k=0;k<3;k++){{let lo=Infinity,hi=-Infinity;for(let i=0;i<n;i++){{lo=Math.min(lo,xyz[3*i+k]);hi=Math.max(hi,xyz[3*i+k]);}}c[k]=(lo+hi)/2;reach=Math.max(reach,hi-lo);}}
function draw(){{g.clearRect(0,0,900,600);const s=450/reach*zoom;for(let i=0;i<n;i++){{const x=xyz[3*i]-c[0],y=xyz[3*i+1]-c[1],z=xyz[3*i+2]-c[2];
const u=x*Math.cos(a)-y*Math.sin(a),v=x*Math.sin(a)+y*Math.cos(a);g.fillStyle=`rgb(${{rgb[3*i]}},${{rgb[3*i+1]}},${{rgb[3*i+2]}})`;
g.fillRect(450+s*u,300+s*(v*Math.sin(b)-z*Math.cos(b)),2,2);}}}}
view.onmousemove=e=>{{if(e.buttons){{a+=e.movementX/200;b+=e.movementY/200;draw();}}}};
view.onwheel=e=>{{e.preventDefault();zoom*=e.deltaY<0?1.1:0.9;draw();}};draw();
</script>"""


def encode(values: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(values).tobytes()).decode()


def review_page(segment, vertices: DataFrame, faces: DataFrame, deviations: DataFrame, scored: DataFrame, total: DataFrame, clusters: DataFrame | None = None) -> str:
    """HTML of one segment; its vertices come to the driver, as the page holds them.

    scored: weighted metric rows; total: aggregate_score and grade; clusters:
    from ``clusters.describe``.
    """
    own = lambda df: df.filter(F.col("segment_id") == segment)
    r, g, b = heat_rgb(F.coalesce("deviation", F.lit(0.0)))
    at = own(vertices).join(incidence_average(own(faces), own(deviations), "deviation"), ["segment_id", "vertex_id"], "left")
    points = at.select("vertex_id", "x", "y", "z", r.alias("r"), g.alias("g"), b.alias("b")).orderBy("vertex_id").toPandas()
    head = own(total).first()
    metrics = "".join(f'<tr><td>{html.escape(m["metric"])}<td style="color:{m["colour"]}">{m["score"]:.3f}<td>{m["weight"]:.2f}</tr>' for m in own(scored).withColumn("colour", status_colour(F.col("score"))).orderBy("metric").collect())
    rows = own(clusters).orderBy("rank").collect() if clusters is not None else []
    listed = "".join(f'<tr><td>{c["rank"]}<td>{c["face_count"]}<td>{" ".join(c["sources"])}<td>{c["mx"]:.1f}, {c["my"]:.1f}, {c["mz"]:.1f}<td>{c["mean_dev"]}<td>{c["z_jump"]}<td>{f"""<span class="badge">{c["badge"]}</span>""" if c["badge"] else ""}</tr>' for c in rows)
    return _PAGE.format(
        title=html.escape(str(segment)), score=head["aggregate_score"] if head else 0.0, grade=head["grade"] if head else "F", metrics=metrics, clusters=listed,
        xyz=encode(points[["x", "y", "z"]].to_numpy("<f4")), rgb=encode(points[["r", "g", "b"]].to_numpy("u1")),
    )


def settings(cli: dict, config: str | None) -> dict:
    """Command-line values over those of a JSON settings document; ``umbilicus`` before ``umbilicus_simple``."""
    found = json.loads(config) if config else {}
    axis = found.get("umbilicus") or found.get("umbilicus_simple")
    if isinstance(axis, list):
        found["umbilicus"] = ",".join(map(str, axis))
    elif axis:
        found["umbilicus"] = axis
    return found | {k: v for k, v in cli.items() if v is not None}
