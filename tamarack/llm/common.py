"""Shared pieces: the shared folder, cutting lineage, text blocks and Arrow batches."""

from __future__ import annotations

import ctypes
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text is handled in blocks of about so many characters, which bounds memory whatever the batch size.
BLOCK_CHARS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tamarack-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


class Scratch:
    """A folder of written tables below the shared folder, for one run of one operator.

    Written tables cut the lineage: after the loss of an executor Spark rereads them
    instead of repeating what made them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.path(name)
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        made.scratch_path = path  # for drop()
        return made

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for df in frames:
            if path := getattr(df, "scratch_path", None):
                jvm, context = self.spark._jvm, self.spark.sparkContext
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def free_names(existing: list[str], wanted: list[str]) -> list[str]:
    """Names for added columns: as wanted, with underscores after those that exist already (in any case)."""
    taken, out = {c.lower() for c in existing}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def row_key(row_id: Column, text: Column) -> Column:
    """128 bits that stand for an id with its text; a null id or text is told from an empty one."""
    coded = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in (row_id, text)]
    return F.unhex(F.md5(F.concat(coded[0], F.lit("\n"), coded[1]).cast("binary")))


#: Sets of keys are sent to every task up to so many bytes there: a long takes about 48, anything else about 160.
BROADCAST_BYTES = 48 << 20


def keys_for_join(keys: DataFrame) -> DataFrame:
    """A written table of a key, or of a key and fixed-width columns, to be broadcast if its counted rows are few enough.

    The other side then stays where it is; beyond the bound it is joined by a shuffle.
    """
    most = BROADCAST_BYTES // (48 if keys.dtypes == [(keys.columns[0], "bigint")] else 160)
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def release() -> None:
    """Give freed memory of this process back to the system: workers live on from task to task, and each would keep its largest so far."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver has it, installed or not, and :func:`release` memory after each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    if home not in (paths := [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]):
        environment["PYTHONPATH"] = os.pathsep.join([*paths, home])
    return df.mapInArrow(task, schema)


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of all ``rows`` (of a bounded, written table) in one task; None of no rows. Only the result comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(found)) if found else None)], pa.binary())], names=["fitted"])

    found = map_arrow(rows.coalesce(1), run, "fitted binary").collect()  # one row
    return pickle.loads(found[0].fitted) if found else None


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``_y``, ``_h`` and ``_text`` of each sampled id (``_id``, ``_y``, ``_h``; a bounded number) that ``docs`` (``_id``, ``_text``) has, once: of ids that repeat, the smallest text."""
    return docs.join(F.broadcast(sample), "_id").groupBy("_h", "_id", "_y").agg(F.min("_text").alias("_text")).select("_h", "_y", "_text")


def sample_labels(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """The labelled ids of the smallest hashes, each once: a bounded sample that does not depend on partitioning.

    Of an id with several labels, the largest counts.
    """
    labelled = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    each = labelled.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y")).withColumn("_h", F.xxhash64("_id"))
    return each.orderBy("_h", "_id").limit(rows)


def up_to(sizes: DataFrame, most: int) -> int | None:
    """Of a bounded table of ``h`` and ``n``: the hash up to which the rows of the smallest hashes have ``most`` together; None if no row fits."""
    last, total = None, 0
    for r in sorted(sizes.select("h", "n").collect()):
        total += r.n
        if total > most:
            break
        last = r.h
    return last


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` characters together, or of one longer text."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4 * BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes at most, or of one larger row: what is made of a batch is held beside it."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.get_total_buffer_size(), 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
