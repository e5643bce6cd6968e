"""Tables on disk: manifested writes and checked reads, file inventories, a registry of sources."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    kind: str = "tabular"
    options: dict = field(default_factory=dict)


class Registry:
    """Sources by unique name."""

    def __init__(self, *sources: Source):
        self.sources: dict[str, Source] = {}
        for s in sources:
            if s.name in self.sources:
                raise ValueError(f"source {s.name} is registered twice")
            self.sources[s.name] = s

    def get(self, name: str) -> Source:
        if name not in self.sources:
            raise KeyError(f"no source {name}; there are {sorted(self.sources)}")
        return self.sources[name]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        from .layers import read_geopackage

        s = self.get(name)
        if s.kind == "vector":
            return read_geopackage(spark, s.path, **s.options)
        if s.kind != "tabular":
            raise ValueError(f"source {name} is of kind {s.kind}")
        return spark.read.options(**s.options).parquet(s.path)


def inventory(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, bytes, modified, sha256) of every file under the paths; the executors hash them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def _manifest_path(path: str) -> str:
    return path.rstrip("/") + ".manifest.json"


def schema_text(df: DataFrame) -> str:
    return json.dumps([[f.name, f.dataType.simpleString(), f.nullable or True] for f in df.schema.fields], separators=(",", ":"), ensure_ascii=False)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> dict:
    """Parquet (Zstd, atomic by the committer) and a manifest of its rows, schema and order-free content hash."""
    spark = df.sparkSession
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    back = spark.read.parquet(path).select(*df.columns)
    found = ids.content_hash(back, [schema_text(df)], df.columns).first()
    manifest = {"columns": df.columns, "content_hash": found["content_hash"], "rows": found["rows"], "schema": json.loads(schema_text(df))}
    text = json.dumps(manifest, sort_keys=True, indent=1, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(_manifest_path(path))
    return manifest


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = True) -> DataFrame:
    """A manifested table, its schema checked, and its content too with ``verify``; columns are pruned in the scan."""
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(_manifest_path(path)).collect()))
    df = spark.read.parquet(path).select(*manifest["columns"])
    if json.loads(schema_text(df)) != manifest["schema"]:
        raise ValueError(f"{path} doesn't have the schema of its manifest")
    if verify:
        found = ids.content_hash(df, [schema_text(df)], df.columns).first()
        if (found["rows"], found["content_hash"]) != (manifest["rows"], manifest["content_hash"]):
            raise ValueError(f"{path} doesn't have the content of its manifest")
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested cells as JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("errorifexists").option("header", True).csv(path)
