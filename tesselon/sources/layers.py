"""Layer files: a GeoPackage reader as a Spark data source, bounding-box reads of Parquet layers, and layer metadata."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import geometry

BATCH = 65_536
TYPES = {"INTEGER": "long", "MEDIUMINT": "int", "INT": "long", "SMALLINT": "short", "TINYINT": "short", "BIGINT": "long", "BOOLEAN": "boolean", "REAL": "double", "DOUBLE": "double", "FLOAT": "float", "BLOB": "binary"}
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB within a GeoPackage geometry; null of an empty one."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    if blob[3] & 0b10000:
        return None
    return bytes(blob[8 + ENVELOPES[blob[3] >> 1 & 7] :])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Layer:
    def __init__(self, path: str, layer: str | None):
        self.path = path.removeprefix("file://")
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            layers = dict(con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall())
            if layer is None and len(layers) == 1:
                layer = next(iter(layers))
            if layer not in layers:
                raise ValueError(f"{path} has layers {sorted(layers)}; name one")
            self.name, self.geometry = layer, layers[layer]
            info = con.execute(f"PRAGMA table_info({_quoted(layer)})").fetchall()
            self.fid = next((r[1] for r in info if r[5]), "rowid")
            self.fields = [(r[1], TYPES.get(r[2].split("(")[0].upper(), "string")) for r in info if r[1] not in (self.geometry, self.fid)]
            self.first, self.last = con.execute(f"SELECT coalesce(min({_quoted(self.fid)}), 0), coalesce(max({_quoted(self.fid)}), -1) FROM {_quoted(layer)}").fetchall()[0]


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.layer, self.rows = schema.fieldNames(), _Layer(options["path"], options.get("layer")), int(options.get("rowsperpartition", 8 * BATCH))
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[_Range]:
        return [_Range(k, min(k + self.rows, self.layer.last + 1)) for k in range(self.layer.first, self.layer.last + 1, self.rows)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = {"fid": self.layer.fid, "geometry_wkb": self.layer.geometry}
        picked = ", ".join(_quoted(names.get(c, c)) for c in self.columns)
        with sqlite3.connect(f"file:{self.layer.path}?mode=ro", uri=True) as con:
            rows = con.execute(f"SELECT {picked} FROM {_quoted(self.layer.name)} WHERE {_quoted(self.layer.fid)} >= ? AND {_quoted(self.layer.fid)} < ? ORDER BY {_quoted(self.layer.fid)}", (partition.low, partition.high))
            while some := rows.fetchmany(BATCH):
                columns = dict(zip(self.columns, zip(*some)))
                if "geometry_wkb" in columns:
                    columns["geometry_wkb"] = [wkb_of(b) for b in columns["geometry_wkb"]]
                yield pa.RecordBatch.from_arrays([pa.array([bool(v) if pa.types.is_boolean(f.type) and v is not None else v for v in columns[f.name]], f.type) for f in self.schema], schema=self.schema)


class GeoPackage(DataSource):
    """``spark.read.format("geopackage").option("layer", ...).load(path)``: fid, the layer's columns and geometry_wkb.

    A layer is read in ranges of its row number, each in batches; give a schema to read only some columns. The file must
    be where all executors see it.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        layer = _Layer(self.options["path"], self.options.get("layer"))
        return ", ".join(["fid long", *(f"`{n}` {t}" for n, t in layer.fields), "geometry_wkb binary"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("geopackage")
    if layer:
        reader = reader.option("layer", layer)
    if columns:
        found = _Layer(path, layer)
        types = dict(found.fields) | {"fid": "long", "geometry_wkb": "binary"}
        reader = reader.schema(", ".join(f"`{c}` {types[c]}" for c in columns))
    return reader.load(path)


def with_box(df: DataFrame, wkb: str = "geometry_wkb") -> DataFrame:
    """Adds xmin, ymin, xmax, ymax, which Parquet keeps statistics of, so that ``within`` prunes row groups."""
    seen = df.withColumn("_g", geometry.inspect(F.col(wkb)))
    return seen.withColumns({c: F.col(f"_g.{c}") for c in ("xmin", "ymin", "xmax", "ymax")}).drop("_g")


def meets(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """A filter on bounding-box columns that the Parquet scan can push down."""
    return (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)


def layer_metadata(df: DataFrame, wkb: str = "geometry_wkb") -> DataFrame:
    """One row: features, null and unreadable geometries, kinds, parts, vertices, measure and bounding box."""
    g = df.select(F.col(wkb).isNull().alias("null"), geometry.inspect(F.col(wkb)).alias("g"))
    return g.agg(
        F.count("*").alias("features"), F.count_if("null").alias("null_geometries"), F.count("g.error").alias("unreadable"), F.array_join(F.array_sort(F.collect_set("g.kind")), "|").alias("kinds"),
        F.count_if(F.col("g.parts") > 1).alias("multipart"), F.sum("g.vertices").alias("vertices"), F.sum("g.measure").alias("measure"), *(f(f"g.{c}").alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))),
    )
