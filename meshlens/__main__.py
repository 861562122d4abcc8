"""``python -m meshlens score PATH`` and ``batch DIRECTORY``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .operators.segments import GEOMETRY, measure
from .plans import scoring
from .plans.review import review_page, settings


def axis_of(text: str | None) -> list[tuple[float, float, float]] | None:
    """(y, x, z) rows of an axis: "x,z", or a text file with x y z in its rows."""
    if not text:
        return None
    if "," in text and not os.path.exists(text):
        x, z = (float(p) for p in text.split(","))
        return [(0.0, x, z)]
    with open(text) as f:
        rows = [line.split("#")[0].split() for line in f]
    return [(float(r[1]), float(r[0]), float(r[2])) for r in rows if r]


def score_segments(vertices, faces, overrides=None, axis=None, extra=None, has_volume=False, approximate_fiber=False):
    """Weighted metric rows of all segments; ``extra``: rows of the volume metrics, of the same columns."""
    results = measure(vertices, faces, GEOMETRY, axis)
    if extra is not None:
        results = results.unionByName(extra, allowMissingColumns=True)
    tier = scoring.tier(has_volume or extra is not None, axis is not None)
    return scoring.suppress(scoring.weigh(results, tier, overrides), approximate_fiber)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meshlens")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, place in (("score", "path"), ("batch", "directory")):
        p = commands.add_parser(name)
        p.add_argument(place)
        p.add_argument("--kind", choices=("obj", "ply", "stl"), default="obj")
        p.add_argument("--weights", help="JSON of metric weights")
        p.add_argument("--umbilicus", help='axis: "x,z" or a text file')
        p.add_argument("--scroll-config", help="JSON settings file")
        if name == "score":
            p.add_argument("--format", choices=("text", "json"), default="text")
            p.add_argument("--review", help="HTML file to write")
        else:
            p.add_argument("-o", "--output", default="ranking", help="folder of the CSV ranking")
    args = parser.parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.segments import deviations
    from .functions.geometry import scroll_id
    from .operators.storage import stored
    from .sources.meshfiles import _tables, mesh_files, read_rows

    root = args.path if args.command == "score" else args.directory
    if not os.path.exists(root):
        print(f"no such path: {root}", file=sys.stderr)
        return 1
    config = open(args.scroll_config).read() if args.scroll_config else None
    axis = axis_of(settings({"umbilicus": args.umbilicus}, config).get("umbilicus"))
    spark = SparkSession.builder.appName("meshlens").getOrCreate()
    rows = stored(read_rows(spark, root, args.kind), "meshes")
    ids = mesh_files(rows).withColumnRenamed("segment_id", "name").withColumn("segment_id", F.xxhash64("name"))
    v, f = (df.withColumnRenamed("segment_id", "name").withColumn("segment_id", F.xxhash64("name")).drop("name") for df in _tables(rows.filter("kind in ('v', 'f')")))
    weighted = score_segments(v, f, json.loads(args.weights) if args.weights else None, axis)
    if args.command == "batch":
        ranked = scoring.ranking(weighted, ids).drop("segment_id").withColumnRenamed("name", "segment_id")
        ranked = ranked.select("segment_id", *(c for c in ranked.columns if c != "segment_id"))
        scoring.write_csv(ranked, args.output)
        return 0
    names = {r["segment_id"]: r["name"] for r in ids.collect()}  # the files of one path
    if not names:
        print(f"no {args.kind} files in {root}", file=sys.stderr)
        return 1
    broken = {r["name"]: r["error"] for r in ids.filter("error is not null").collect()}
    for name, error in sorted(broken.items()):
        print(f"{name}: {error}", file=sys.stderr)
    if len(broken) == len(names):
        return 1
    if args.format == "json":
        known = ids.select("segment_id", F.col("obj_path").alias("file"), scroll_id(F.col("obj_path")).alias("scroll_id"), "n_vertices", "n_faces")
        for r in scoring.json_reports(weighted, known).collect():
            print(json.dumps(json.loads(r["report"]) | {"segment_id": names[r["segment_id"]]}))
    else:
        for r in scoring.text_report(weighted).orderBy("segment_id", "metric").collect():
            print(names[r["segment_id"]], r["line"])
    if args.review:
        first = min(names, key=names.get)
        with open(args.review, "w") as out:
            out.write(review_page(first, v, f, deviations(v, f), weighted, scoring.aggregate(weighted)).replace(str(first), names[first]))
    return 0


__all__ = ["axis_of", "main", "score_segments"]

if __name__ == "__main__":
    sys.exit(main())
