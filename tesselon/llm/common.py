"""What the corpus operators share: settled tables, keys, partition counts."""

from __future__ import annotations

import atexit
import importlib
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUMS = 16


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, size: int, most: int) -> int:
    """Partitions of at most about ``most`` (bytes or rows) each, and never fewer than the session's."""
    return max(partitions(spark), -(-size // most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one is set only where none is (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tesselon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more (those that a loop has replaced)."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for path in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project to the named inputs under internal names, so that any other column of the input can't clash."""
    return df.select([df[source].alias(name) for name, source in columns.items()])


def key64(column: Column) -> Column:
    """Big-endian first 8 bytes of the MD5 of a key's text, a null key counting as the empty text."""
    return F.unhex(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 16))


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def type_of(df: DataFrame, column: str) -> str:
    """A column's own type, so that ids of any type go through an operator as they are."""
    return df.schema[column].dataType.simpleString()


_LOADED: dict[str, object] = {}


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast value's reader. Each Python worker unpickles it once, not once a batch or task; the last two are held."""
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(value))

    def get() -> object:
        held = importlib.import_module(__name__)._LOADED  # the worker's own module, not a copy that came with this function
        if name not in held:
            while len(held) >= 2:
                held.pop(next(iter(held)))
            held[name] = pickle.loads(shared.value)
        return held[name]

    return get


def row_keys(rows: DataFrame, doc: str = "doc", text: str = "text", into: str = "key", distinct: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(rows with the long column ``into``, table (key, doc) or None where the key is the id itself).

    Ids that are whole numbers and unique are keys as they are, and nothing is moved. Ids of another type, and ids that
    repeat, are numbered in the order of the ids (then of a hash of the row): rows are sorted once over the cluster and
    written, so that the numbers stay as they are. distinct: repeated rows are one. Null ids must have been left out.
    """
    whole = type_of(rows, doc) in ("tinyint", "smallint", "int", "bigint")
    if whole and rows.groupBy(doc).count().filter("count > 1").limit(1).count() == 0:
        return rows.withColumn(into, F.col(doc).cast("long")), None
    ordered = (rows.distinct() if distinct else rows).orderBy(doc, F.xxhash64(text), F.xxhash64(*rows.columns))
    keyed = settle(ordered.withColumn(into, F.monotonically_increasing_id()), "numbered")
    return keyed, keyed.select(F.col(into).alias("key"), F.col(doc).alias("doc"))


def summed(df: DataFrame, size: int, kind: type) -> np.ndarray:
    """Sum of the blobs of each part over all partitions, the parts joined. Each part is one exchange target."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + np.frombuffer(blob.as_buffer(), kind)
        for part, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([value.tobytes()], pa.binary())], ["part", "blob"])

    out = np.zeros(size, kind)
    step = -(-size // SUMS)
    if kind not in (np.int64, np.float64):
        raise TypeError("sums over the corpus need 64 bits")
    for row in arrow(df.repartitionById(SUMS, F.col("part")), total, "part int, blob binary").toLocalIterator():
        out[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["blob"], kind)
    return out


def blobs(values: np.ndarray) -> pa.RecordBatch:
    """An array as SUMS parts, for ``summed``."""
    step = -(-len(values) // SUMS)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SUMS, dtype=np.int32)), pa.array([values[k * step : (k + 1) * step].tobytes() for k in range(SUMS)], pa.binary())], ["part", "blob"])
