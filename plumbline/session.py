"""Session defaults, shipping of the package to executors, and durable intermediate tables."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import threading
import uuid
import zipfile
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast, col, count, lit, max_by, struct, xxhash64

_lock = threading.Lock()
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def build_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package's Python files to the executors, once per application.

    Functions given to ``mapInArrow`` are pickled by reference, so the workers must be able to
    import this package even where it is not installed.
    """
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="plumbline-ship-")
        target = os.path.join(folder, "plumbline_package.zip")
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for base, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(base, name)
                        archive.write(path, os.path.join("plumbline", os.path.relpath(path, root)))
        with open(target, "wb") as out:
            out.write(buffer.getvalue())
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of this machine only where it is unset and all executors are here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        with _lock:
            root = spark.conf.get("plumbline.checkpoint.dir", None)
            if not root:
                root = "file://" + tempfile.mkdtemp(prefix="plumbline-checkpoint-")
                spark.conf.set("plumbline.checkpoint.dir", root)
    return root.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a parquet table in the shared checkpoint folder.

    Unlike ``localCheckpoint`` the table survives the loss of executors, it is compressed, and a
    later scan of it prunes columns and pushes filters down. It is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/plumbline-{uuid.uuid4().hex}"
    keep_until_release(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_release(spark: SparkSession, path: str) -> None:
    """Have ``release`` remove a folder of the checkpoint folder."""
    _written.append((spark, path))


def release(attempts: int = 3) -> int:
    """Remove all durable tables written so far, also those of results not read yet; gives how many could not be removed.

    A driver that runs many queries calls it between them, when it has read their results.
    """
    failed = []
    while _written:
        spark, path = _written.pop()
        for attempt in range(attempts):
            try:
                jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
                break
            except Exception:  # noqa: BLE001  the JVM may be gone already, or the file system busy
                if attempt + 1 == attempts:
                    failed.append((spark, path))
    _written.extend(failed)
    return len(failed)


atexit.register(release)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a file scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(table: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A durable table with a broadcast hint if it is small by its files' size, else as it is.

    Parquet packs keys and counts, so a file's bytes are taken eightfold. Beyond the bound the join
    that uses the table is an ordinary shuffled one.
    """
    return broadcast(table) if input_bytes(table) * 8 <= most else table


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows hold; only keys are shuffled. Keys with a null are never repeated."""
    known = df.where(reduce(and_, [col(k).isNotNull() for k in keys]))
    return known.groupBy(*keys).agg(count(lit(1)).alias("_n")).where("_n > 1").select(*keys)


def distinct_by(df: DataFrame, keys: str | list[str], latest: str | None = None, repeated: DataFrame | None = None, small: bool = False) -> DataFrame:
    """One row per key: of several, the one with the latest ``latest``, which is left out of the result.

    Where rows of one key have the same ``latest``, or there is no such column, the one with the greatest hash of its
    values stands, so the choice does not vary. Only keys are counted (or ``repeated`` names them) and only rows of
    repeated keys are shuffled; all others stay in their input splits, where rows of one group often lie together.
    Rows with a null key all stay. ``small``, for a table of a checked size, finds the repeated keys in the same job.
    """
    keys = [keys] if isinstance(keys, str) else keys
    own = [c for c in df.columns if c not in keys and c != latest]
    if small:
        repeated = broadcast(repeated_keys(df, keys))
    else:
        repeated = broadcast_if_small(durable(repeated_keys(df, keys)) if repeated is None else repeated)
    order = struct(*([latest] if latest else []), xxhash64(*own) if own else lit(0))
    again = df.join(repeated, keys, "left_semi").groupBy(*keys).agg(max_by(struct(*own) if own else lit(0), order).alias("_r"))
    rest = df.join(repeated, keys, "left_anti").select(*keys, *own)
    return rest.unionByName(again.select(*keys, *[col("_r").getField(c).alias(c) for c in own])).select(*[c for c in df.columns if c != latest])


def shuffle_width(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for a fixed-width exchange: the session's number, more where the input is larger."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(100_000, -(-input_bytes(df) // bytes_each)))
