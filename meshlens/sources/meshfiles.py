"""OBJ meshes, segment discovery, axis files and scroll settings; PLY output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = "segment_id string, kind string, id long, a double, b double, c double, note string"
_COLUMNS = ["segment_id", "kind", "id", "a", "b", "c", "note"]


def discover_segments(spark: SparkSession, root: str) -> DataFrame:
    """segment_id, obj_path: ``root/paths/<id>/*.obj`` named by folder, then other .obj files by stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.obj").load(root).select("path")
    folder = F.regexp_extract("path", r"/paths/([^/]+)/[^/]+\.obj$", 1)
    stem = F.regexp_extract("path", r"([^/]+)\.obj$", 1)
    return files.select(F.when(folder != "", folder).otherwise(stem).alias("segment_id"), F.col("path").alias("obj_path")).dropDuplicates(["obj_path"]).orderBy("segment_id", "obj_path")


def _parse(batches):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            head = path.rsplit("/", 2)
            folder = "/paths/" in path and path.rsplit("/", 3)[-3] == "paths"
            segment = head[1] if folder else head[2].removesuffix(".obj")
            yield _or_error(segment, path, lambda: _obj_rows(segment, content))


def _or_error(segment: str, path: str, rows):
    """A file's rows, led by one (kind p) that names it, or one (kind e) with what went wrong."""
    import pandas as pd

    try:
        found = pd.DataFrame(rows(), columns=_COLUMNS)
        if not (found["kind"] == "f").any():
            raise ValueError("no triangles")
        return pd.concat([pd.DataFrame([(segment, "p", 0, None, None, None, path)], columns=_COLUMNS), found])
    except Exception as e:
        return pd.DataFrame([(segment, "p", 0, None, None, None, path), (segment, "e", 0, None, None, None, f"{type(e).__name__}: {e}"[:500])], columns=_COLUMNS)


def _obj_rows(segment: str, content) -> list[tuple]:
    rows, n_v, n_f = [], 0, 0
    for line in bytes(content).decode("utf-8", "replace").splitlines():
        p = line.split()
        if len(p) >= 4 and p[0] == "v":
            rows.append((segment, "v", n_v, *map(float, p[1:4]), None))
            n_v += 1
        elif len(p) >= 4 and p[0] == "f":
            at = [int(x.split("/")[0]) for x in p[1:]]
            at = [i - 1 if i > 0 else n_v + i for i in at]
            for k in range(1, len(at) - 1):  # polygons as fans
                rows.append((segment, "f", n_f, float(at[0]), float(at[k]), float(at[k + 1]), None))
                n_f += 1
    if any(max(r[3:6]) >= n_v or min(r[3:6]) < 0 for r in rows if r[1] == "f"):
        raise ValueError("a face names a vertex that isn't there")
    return rows


def _parse_bytes(batches):
    from .meshbytes import parse_ply, parse_stl

    def rows(segment, parse, content):
        xyz, tri = parse(bytes(content))
        return [(segment, name, i, *map(float, r), None) for name, table in (("v", xyz), ("f", tri)) for i, r in enumerate(table)]

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            stem, kind = path.rsplit("/", 1)[1].rsplit(".", 1)
            parse = parse_ply if kind.lower() == "ply" else parse_stl
            yield _or_error(stem, path, lambda: rows(stem, parse, content))


def read_rows(spark: SparkSession, root: str, kind: str = "obj") -> DataFrame:
    """Rows of all files of one kind below ``root``; a file is read by one task, and a broken one is a row of kind e."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(root).select("path", "content")
    return files.mapInPandas(_parse if kind == "obj" else _parse_bytes, FORMAT)


def read_obj(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """vertices and faces of all OBJ files below ``root``."""
    return _tables(read_rows(spark, root))


def read_meshes(spark: SparkSession, root: str, kind: str = "obj") -> tuple[DataFrame, DataFrame]:
    """vertices and faces of all files of one kind (obj, ply, stl) below ``root``."""
    return _tables(read_rows(spark, root, kind))


def mesh_files(rows: DataFrame) -> DataFrame:
    """segment_id, obj_path, n_vertices, n_faces, error: one row for each segment that ``read_rows`` met."""
    of = lambda k: F.when(F.col("kind") == k, F.col("note"))
    return rows.groupBy("segment_id").agg(F.min(of("p")).alias("obj_path"), F.count_if(F.col("kind") == "v").alias("n_vertices"), F.count_if(F.col("kind") == "f").alias("n_faces"), F.min(of("e")).alias("error"))


def _tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    vertices = rows.filter("kind = 'v'").select("segment_id", F.col("id").alias("vertex_id"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    faces = rows.filter("kind = 'f'").select("segment_id", F.col("id").alias("face_id"), *(F.col(c).cast("long").alias(f"v{k}") for k, c in enumerate("abc")))
    return vertices, faces


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of an axis text file: numbers in columns, # starts a comment."""
    line = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    return spark.read.text(path).filter("trim(regexp_replace(value, '#.*', '')) <> ''").select(*(line[k].cast("double").alias(c) for k, c in enumerate("xyz")))


def read_settings(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Scroll settings: one JSON document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def ply_lines(vertices: DataFrame, faces: DataFrame, segment) -> DataFrame:
    """Lines of an ASCII PLY file in order (``at``, ``line``): vertices (r, g, b optional) and faces of one segment."""
    v = vertices.filter(F.col("segment_id") == segment)
    f = faces.filter(F.col("segment_id") == segment)
    colours = [c for c in ("r", "g", "b") if c in v.columns]
    n_v, n_f = v.count(), f.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n_v}", *(f"property double {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")[: len(colours)]), f"element face {n_f}", "property list uchar int vertex_indices", "end_header"]
    spark = vertices.sparkSession
    top = spark.createDataFrame([(k - len(head), s) for k, s in enumerate(head)], "at long, line string")
    body = v.select(F.col("vertex_id").alias("at"), F.concat_ws(" ", "x", "y", "z", *colours).alias("line"))
    tail = f.select((F.col("face_id") + (1 << 40)).alias("at"), F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2").alias("line"))
    return top.union(body).union(tail).orderBy("at")
