"""What the operators of this subpackage share: shared-folder tables, shipping of code, thin column helpers."""

from __future__ import annotations

import atexit
import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, with its scheme: a path without one belongs to the
    cluster's default file system. Where it is unset a fresh local folder serves a local session; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


class Scratch:
    """Tables written to the shared folder to cut lineage: compressed, columnar, and safe when an executor is lost.

    ``drop`` frees a table as soon as nothing reads it; what is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/paperloom-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._delete, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Free all that is left."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clean
            pass


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that functions pickled by name resolve there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.writestr(str(p.relative_to(package.parent)), p.read_bytes())
    path = Path(tempfile.mkdtemp(prefix="paperloom-ship-")) / "paperloom_code.zip"
    path.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED[app] = str(path)


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """A kept copy of the rows with a number of their own, and the name of its column, which clashes with none."""
    name = "row_number_"
    while name in docs.columns:
        name += "_"
    return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def picked(table: DataFrame, number: str, ids: DataFrame, others: bool = False) -> DataFrame:
    """The rows of a table whose numbers (of ``numbered``, not null) are among the ids (one column), or the others.

    The ids are broadcast as bitmaps of a bit a row, 4 KB for each 32,768 numbers of a partition that has any, so that
    no row of the table is shuffled, however many ids there are."""
    own = ids.columns[0]
    at = ids.select(F.shiftright(own, 15).alias("bucket"), F.col(own).bitwiseAND(F.lit(32767)).alias("at")).repartition("bucket")
    maps = F.broadcast(at.groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("at")).alias("bits")))
    row = table[number]
    place = row.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(maps["bits"], F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = (maps["bucket"] == F.shiftright(row, 15)) & (F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return table.join(maps, found, "left_anti" if others else "left_semi")


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone; a null text counts as empty. Other columns, whatever their names, play no part."""
    return docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def held_out(key: str, buckets: int, remainder: int) -> Column:
    """Whether crc32 of the key's decimal text falls into the held-out fold (a null key hashes as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % buckets == remainder


def arrow_strings(batch, name: str) -> Iterator[str]:
    """A batch's texts one at a time, so that only one is held as Python text."""
    for x in batch.column(name):
        yield x.as_py() or ""


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What a worker process keeps from task to task: one operator's tables at a time, so that those of the operators
    before it don't add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    _HELD.clear()


@contextmanager
def no_cycles():
    """Without the cyclic garbage collector, which would walk over tables of strings and tuples that hold no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
