"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_drops: list = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set on a local master (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="archspark-")
        base = _own_dirs[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; removed when the driver ends."""
    path = f"{work_dir(spark)}/archspark-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)

    at_exit(drop)
    return path


def at_exit(what) -> None:
    """Calls what when the driver ends; by then the JVM may be gone, which is no error."""

    def safely() -> None:
        with contextlib.suppress(Exception):
            what()

    atexit.register(safely)
    _drops.append(safely)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """What is stored inside goes when the block ends, and not only when the driver does. Results must be written or collected by then."""
    kept = len(_drops)
    try:
        yield
    finally:
        while len(_drops) > kept:
            drop = _drops.pop()
            atexit.unregister(drop)
            drop()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read back: lineage ends, the parts are computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted_cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, int]:
    """``cut`` and how many rows it wrote, counted on the way."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, int(seen.get["n"])
