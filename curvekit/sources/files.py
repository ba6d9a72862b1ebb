"""Readers and writers of pictures, calibrations, curves, at-risk tables and reports."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.atrisk import events
from ..operators.reports import ORDER
from ..runtime import as_list, attach

# File name endings of pictures.
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "gif")
CALIBRATION = "image_id BIGINT, x_0_pixel INT, x_max_pixel INT, y_0_pixel INT, y_100_pixel INT, time_max DOUBLE"


def scan_images(spark: SparkSession, path: str, types=IMAGE_TYPES) -> DataFrame:
    """Picture files below `path`, newest first; contents are not read."""
    ends = ",".join(sorted({t for e in types for t in (e.lower(), e.upper())}))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{ends}}}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Spark's image rows with the file name as image_id; `readable` is false for files that cannot be decoded (height and width are then -1)."""
    return spark.read.format("image").option("dropInvalid", "false").load(path).select(F.col("image.origin").alias("image_id"), "image.*", (F.col("image.height") > 0).alias("readable"))


def read_pixels(images: DataFrame, key="image_id", white=250, bounds: tuple | None = None) -> DataFrame:
    """Pixel rows of image rows (height, width, nChannels, data), without near-white ones.

    `bounds` is a rectangle (x, y, w, h): numbers for all pictures, or four columns of `images` with each picture's own plot rectangle (a picture without one
    is read as a whole). Rectangle and `white` are applied while the bytes are unpacked, and rows of pixels outside the rectangle are not looked at, so only
    useful pixels leave the mapper. A picture is sent on in slices of rows; one that could not be decoded has no pixels.
    """
    sides = [F.lit(None)] * 4 if bounds is None else [F.col(b) if isinstance(b, str) else F.lit(b) for b in bounds]
    schema = T.StructType([images.schema[key]] + [T.StructField(n, T.IntegerType()) for n in ("x", "y", "b", "g", "r")])
    arrow = to_arrow_schema(schema)
    key_type = arrow.field(0).type

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                h, w, n = row["height"].as_py(), row["width"].as_py(), row["nChannels"].as_py()
                if not h or h < 0 or row["data"].as_py() is None:
                    continue  # not decoded; read_images reports it
                data = np.frombuffer(row["data"].as_py(), np.uint8).reshape(h, w, n)
                box = [row[f"_b{k}"].as_py() for k in range(4)]
                x0, y0, bw, bh = (0, 0, w, h) if None in box else box
                x0, x1, y0, y1 = max(x0, 0), min(x0 + bw, w), max(y0, 0), min(y0 + bh, h)
                for top in range(y0, y1, 256):
                    part = data[top:min(top + 256, y1), x0:max(x1, x0)]
                    bgr = np.repeat(part, 3, axis=2) if n == 1 else part[:, :, :3]
                    keep = bgr.min(axis=2) < white
                    ys, xs = np.nonzero(keep)
                    if len(ys):
                        picked = bgr[ys, xs].astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row[key].as_py()] * len(ys), key_type), pa.array((xs + x0).astype(np.int32)), pa.array((ys + top).astype(np.int32)),
                             *[pa.array(np.ascontiguousarray(picked[:, k])) for k in range(3)]], schema=arrow)

    return images.select(key, "height", "width", "nChannels", "data", *[b.cast("int").alias(f"_b{k}") for k, b in enumerate(sides)]).mapInArrow(unpack, schema)


def read_calibration_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION).json(path)


def read_at_risk_long(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns Group, Time, AtRisk."""
    rows = spark.read.schema("Group STRING, Time DOUBLE, AtRisk STRING").option("header", "true").csv(path)
    return rows.select(F.col("Group").alias("grp"), F.col("Time").alias("t"), F.col("AtRisk").try_cast("int").alias("n"))


def read_at_risk_wide(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a Group column and one column per time; columns whose names are no numbers are skipped."""
    rows = spark.read.option("header", "true").csv(path)

    def is_time(name):
        try:
            return float(name) is not None
        except ValueError:
            return False

    times = [n for n in rows.columns if n != "Group" and is_time(n)]
    long = rows.unpivot(["Group"], [F.col(f"`{n}`") for n in times], "t", "n")
    return long.select(F.col("Group").alias("grp"), F.col("t").try_cast("double").alias("t"), F.col("n").try_cast("int").alias("n")).where("n is not null")


def parse_grid(rows: DataFrame, key="table_id", row="row_no", cells="cells") -> DataFrame:
    """Cells of generic tables: times from the first row's readable cells, groups from the first column of the others."""
    keys = as_list(key)
    wide = rows.select(*keys, row, F.get(F.col(cells), F.lit(0)).alias("_name"), F.posexplode(cells).alias("pos", "cell")).where("pos > 0")
    head = wide.where(F.col(row) == 0).select(*keys, "pos", F.trim("cell").try_cast("double").alias("t")).where("t is not null")
    body = wide.where((F.col(row) > 0) & (F.trim("_name") != "") & ~F.lower(F.trim("_name")).isin("time", "months", "number at risk"))
    body = body.withColumn("n", F.trim("cell").try_cast("double").try_cast("bigint")).where("n is not null")
    got = attach(body, head, keys + ["pos"]).where("t is not null")
    # a group named twice keeps its last row
    return got.groupBy(*keys, F.trim("_name").alias("grp"), "t").agg(F.max(F.struct(row, "n")).getField("n").alias("n"))


def import_curve_csv(spark: SparkSession, path: str, name: str, style: str = "solid") -> DataFrame:
    """A curve supplied as CSV (Time, Survival), ready to be added to a result."""
    rows = spark.read.schema("Time DOUBLE, Survival DOUBLE").option("header", "true").csv(path)
    return rows.select(F.lit(name).alias("Curve"), F.lit(style).alias("Style"), "Time", "Survival")


def write_points(points: DataFrame, path: str, key="curve_id", t="t", s="s") -> None:
    """One folder of CSV files per curve: Time, Survival.

    Making files is the work here, so all cores share it: the rows are dealt out in ranges of (curve, time). A curve lies in one range or a few neighbouring
    ones, which leaves about one file per curve however the input is split, and a long curve is written by several tasks.
    """
    ranges = 2 * points.sparkSession.sparkContext.defaultParallelism
    rows = points.repartitionByRange(ranges, key, t).select(key, F.col(t).alias("Time"), F.col(s).alias("Survival"))
    rows.write.mode("overwrite").partitionBy(key).option("header", "true").csv(path)


def all_curves(points: DataFrame, curves: DataFrame, key="curve_id", t="t", s="s") -> DataFrame:
    """Rows Curve, Style, Time, Survival of all curves."""
    rows = attach(points, curves.select(key, "name", "style"), [key])
    return rows.select(F.col("name").alias("Curve"), F.col("style").alias("Style"), F.col(t).alias("Time"), F.col(s).alias("Survival"))


def write_all_curves(points: DataFrame, curves: DataFrame, path: str, format="csv", **columns) -> None:
    w = all_curves(points, curves, **columns).write.mode("overwrite")
    w.option("header", "true").csv(path) if format == "csv" else w.format(format).save(path)


def write_at_risk(cells: DataFrame, path: str, key=("image_id", "grp")) -> None:
    rows = events(cells, key)
    rest = [k for k in as_list(key) if k != "grp"]
    rows.select(*rest, F.col("grp").alias("Group"), F.col("t").alias("Time"), F.col("n").alias("AtRisk"), F.col("events").alias("Events")).write.mode(
        "overwrite").option("header", "true").csv(path)


def at_risk_to_json(cells: DataFrame, source="manual", key="image_id") -> DataFrame:
    """One document per table: {groups: {group: {time: n}}, time_points, source}. A document is one printed table."""
    keys = as_list(key)
    inner = cells.groupBy(*keys, "grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("t").cast("string").alias("t"), "n")))).alias("m"))
    groups = inner.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "m")), lambda a, b: F.when(a["grp"] < b["grp"], -1).when(
        a["grp"] > b["grp"], 1).otherwise(0))).alias("groups"))
    times = cells.select(*keys, "t").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("time_points"))
    rows = attach(groups, times, keys)
    return rows.select(*keys, F.to_json(F.struct("groups", "time_points", F.lit(source).alias("source"))).alias("json"))


def report_lines(checks: DataFrame, title: str, key="image_id") -> DataFrame:
    """Lines of a text report: a heading per key, then one line per check, in order."""
    keys = as_list(key)
    text = F.format_string("  [%s] %s: %s", F.col("status"), F.col("check"), F.col("message"))
    body = checks.select(*keys, F.lit(1).alias("part"), F.col("check").alias("_o"), text.alias("line"))
    n = checks.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.col("status") == "PASS").alias("_p"))
    head = n.select(*keys, F.lit(0).alias("part"), F.lit("").alias("_o"), F.format_string("%s: %d/%d checks passed", F.lit(title), F.col("_p"), F.col("_n")).alias("line"))
    return head.unionByName(body)


def write_reports(checks: DataFrame, path: str, title: str = "VALIDATION REPORT", key="image_id") -> None:
    """Text reports in order of the keys; a key with very many lines may span several files."""
    keys = as_list(key)
    order = [*keys, "part", "_o"]
    lines = report_lines(checks, title, key).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, key="image_id") -> None:
    """Line tables of `operators.reports` as text, in order of the keys; a key with very many lines may span several files."""
    order = [*as_list(key), *ORDER]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
