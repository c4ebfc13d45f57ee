"""Intermediate tables: written once to storage that all executors share, and removed when nothing needs them any more."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's; a local session without one (as in tests) gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions in this block go when each ends: their results are written, so nobody reads them again."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before) if before is not None else spark.conf.unset(_RELEASE)


_STATIC, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """In this block a side of a join is broadcast by its measured size alone.

    Planned sizes count an exploded array as one row, an array as one element, and stored columns as
    they are compressed, so a table many times the limit can go through the driver by them.
    """
    before = {name: spark.conf.get(name, None) for name in (_STATIC, _MEASURED)}
    spark.conf.set(_MEASURED, before[_MEASURED] or spark.conf.get(_STATIC))
    spark.conf.set(_STATIC, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


_open: list[list[Tables]] = []
_left: set[Tables] = set()


@atexit.register
def _drop_left() -> None:
    """When the driver ends, what is left of intermediate tables goes."""
    for tables in list(_left):
        with suppress(Exception):  # the session may be gone, and its folder with it
            tables.drop()


@contextmanager
def dropped_after() -> Iterator[None]:
    """What operators keep within this block goes at its end: their results have to be written by then."""
    own: list[Tables] = []
    _open.append(own)
    try:
        yield
    finally:
        _open.remove(own)
        for tables in own:
            tables.drop()


class Tables:
    """Named intermediate tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.named: dict[str, str] = {}
        _left.add(self)
        for own in _open:
            own.append(self)

    def keep(self, name: str, df: DataFrame, by: Sequence[str] = (), buckets: Sequence[str] = ()) -> DataFrame:
        """``df`` computed once and read back.

        With ``by`` (text columns, the last of ``df``) it is in a folder for each of their values.  With
        ``buckets`` rows are dealt to buckets by these columns, one file each, and later joins on them
        don't move it.
        """
        with shuffles_released(self.spark):
            writer = df.write.option("compression", "zstd")
            if buckets:
                n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                table = f"kept_{uuid.uuid4().hex}"
                dealt = df.repartition(n, *buckets).write.option("compression", "zstd").option("path", f"{self.folder}/{name}")
                dealt.bucketBy(n, *buckets).sortBy(*buckets).saveAsTable(table)
                self.named[name] = table
                return self.spark.table(table)
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; without names all."""
        if not names:
            _left.discard(self)
        for name in list(self.named) if not names else [n for n in names if n in self.named]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(name)}")
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

