"""Readers and writers of the engine's files, all as Spark plans."""

from __future__ import annotations

import csv
import io
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG_KEYS = ("subset", "slug", "name", "query")
GEOJSON = "type string, crs struct<properties: struct<name: string>>, features array<struct<type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_catalog(spark: SparkSession, path: str, require_morphotype: bool = False, trim: bool = True, needed_values: tuple[str, ...] = CATALOG_KEYS) -> DataFrame:
    """Site catalog in file order, numbered 0, 1, ... as ``idx``; required columns, a byte order mark dropped, rows without one of the needed values dropped.

    Without ``trim`` and needed values the catalog is taken as it is. A catalog
    holds a row for each site, so one window numbers it.
    """
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    needed = [*CATALOG_KEYS, *(["morphotype"] if require_morphotype else [])]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"catalog lacks the columns {missing}")
    out = df.select(*[F.trim(F.col(c)).alias(c) if trim and c in (*needed, "morphotype") else F.col(c) for c in df.columns]).withColumn("at_", F.monotonically_increasing_id())
    for key in needed_values:
        out = out.where(F.length(F.coalesce(key, F.lit(""))) > 0)
    return out.withColumn("idx", F.row_number().over(Window.orderBy("at_")).cast("long") - 1).drop("at_")


def picked(catalog: DataFrame, index: int | None = None, slug: str | None = None) -> DataFrame:
    """The one row of a slug (the first) or of an index; an unknown slug or an index out of bounds is an error."""
    if slug is None and index is None:
        raise ValueError("an index or a slug is needed")
    chosen = (F.col("slug") == slug) if slug is not None else (F.col("idx") == index)
    row = catalog.where(chosen).orderBy("idx").limit(1)
    if row.isEmpty():
        raise ValueError(f"slug not found: {slug}" if slug is not None else f"index {index} is outside 0..{catalog.count() - 1}")
    return row


def selected(catalog: DataFrame, subset: str | None = None, slugs: list[str] | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of a catalog by subset and slugs, then a slice in file order."""
    out = catalog
    if subset and subset != "all":
        out = out.where(F.col("subset") == subset)
    if slugs:
        out = out.where(F.col("slug").isin(*slugs))
    out = out.orderBy("idx").offset(start)
    return out.limit(limit) if limit is not None else out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygon features of GeoJSON files: attributes as a map, polygons as rings of points, and ``rings``, all rings of a feature."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", GEOJSON).alias("d"))
    f = text.select("file", F.col("d.crs.properties.name").alias("crs"), F.posexplode("d.features").alias("feature", "f"))
    point = "array<array<array<double>>>"
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(raw, point))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{point}>"))
    polygons = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
    return f.select("file", "crs", F.col("feature").cast("long").alias("feature"), kind.alias("type"), F.col("f.properties").alias("attrs"), polygons.alias("polygons"), F.flatten(polygons).alias("rings"))


def read_vector(spark: SparkSession, path: str, layer: str | None = None, site: int = 0) -> DataFrame:
    """The polygon features of a vector source as (site, feature, attrs, polygons, rings, crs, geographic): GeoJSON, or Parquet with those columns.

    A layer is a file name below a folder. A missing path is an error. GeoJSON
    without a reference system is geographic.
    """
    at = path if layer is None else f"{path.rstrip('/')}/{layer}"
    if not path_exists(spark, at):
        raise FileNotFoundError(at)
    if at.endswith(".parquet"):
        return spark.read.parquet(at)
    out = read_geojson(spark, at).where("polygons is not null")
    geographic = F.col("crs").isNull() | F.upper("crs").rlike("CRS84$|:4326$")
    return out.select(F.lit(site).cast("long").alias("site"), "feature", "attrs", "polygons", "rings", "crs", geographic.alias("geographic"))


def layer_summary(features: DataFrame) -> DataFrame:
    """One row: objects, reference system and bounds of a layer."""
    points = F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return features.agg(F.count(F.lit(1)).alias("objects"), F.first("crs", ignorenulls=True).alias("crs"), F.min(F.array_min(xs)).alias("min_x"), F.min(F.array_min(ys)).alias("min_y"), F.max(F.array_max(xs)).alias("max_x"), F.max(F.array_max(ys)).alias("max_y"))


def read_summaries(spark: SparkSession, path: str, schema: str, name: str = "summary.json", mode: str | None = None) -> DataFrame:
    """Result documents <mode>/<subset>/<slug>/<name> below path as structs; NaN is read as such, unreadable documents are null."""
    at = path if mode is None else f"{path.rstrip('/')}/{mode}"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(at, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    out = raw.select(F.try_element_at(parts, F.lit(-4)).alias("mode"), F.try_element_at(parts, F.lit(-3)).alias("subset"), F.try_element_at(parts, F.lit(-2)).alias("slug"), F.col("_metadata.file_path").alias("summary_path"), F.from_json("value", schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}).alias("doc"))
    # a text that is no document parses to a struct of nulls: all of its sections are absent
    sections = [F.col(f"doc.`{f.name}`").isNull() for f in out.schema["doc"].dataType.fields]
    return out.withColumn("doc", F.when(~reduce(lambda a, b: a & b, sections), F.col("doc")))


def read_side_tables(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of one side table of all sites, <subset>/<slug>/<name> below path, in one scan."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(F.try_element_at(parts, F.lit(-3)).alias("subset"), F.try_element_at(parts, F.lit(-2)).alias("slug"), "*")


def nonempty(spark: SparkSession, path: str, name: str) -> DataFrame:
    """subset, slug of the files <subset>/<slug>/<name> below path that hold anything."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path).where("length > 0")
    parts = F.split("path", "/")
    return found.select(F.try_element_at(parts, F.lit(-3)).alias("subset"), F.try_element_at(parts, F.lit(-2)).alias("slug"))


def flattened(df: DataFrame, column: str) -> DataFrame:
    """Leaves of a struct column under dotted names; lists as JSON."""
    from pyspark.sql.types import ArrayType, StructType

    def leaves(kind, path):
        for field in kind.fields:
            at = [*path, field.name]
            if isinstance(field.dataType, StructType):
                yield from leaves(field.dataType, at)
            else:
                c = F.col(".".join(f"`{p}`" for p in [column, *at]))
                yield (F.to_json(c) if isinstance(field.dataType, ArrayType) else c).alias(".".join(at))

    return df.select(*[c for c in df.columns if c != column], *leaves(df.schema[column].dataType, []))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_cells(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").partitionBy("site").parquet(path)


def write_text_whole(spark: SparkSession, text: str, path: str) -> None:
    """One small file, written beside its place and then moved there, so that no reader sees a part of it."""
    jvm = spark.sparkContext._jvm
    at, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"cannot move {beside} to {path}")


def write_document(document: DataFrame, path: str) -> None:
    """The one row of a frame as an indented JSON file; absent values as null."""
    row = document.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in document.columns]), {"ignoreNullFields": "false"}).alias("j")).first()
    write_text_whole(document.sparkSession, json.dumps(json.loads(row["j"]), ensure_ascii=False, indent=2) + "\n", path)


def stringified(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; others as they are."""
    nested = lambda t: t.startswith(("array", "struct", "map"))
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if nested(t) else F.col(f"`{c}`") for c, t in df.dtypes])


def kept_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that are there."""
    return df.select(*[c for c in columns if c in df.columns])


def union_manifests(*frames: DataFrame) -> DataFrame:
    """All rows, with the union of the columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest of some rows as <path>.json and <path>.csv, columns by name."""
    ordered = stringified(rows.select(*sorted(rows.columns)))
    data = [r.asDict() for r in ordered.collect()]  # a row for each site of a catalog
    write_text_whole(rows.sparkSession, json.dumps(data, ensure_ascii=False, indent=2, default=str) + "\n", f"{path}.json")
    text = io.StringIO()
    writer = csv.DictWriter(text, ordered.columns)
    writer.writeheader()
    writer.writerows(data)
    write_text_whole(rows.sparkSession, text.getvalue(), f"{path}.csv")
