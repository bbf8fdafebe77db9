"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts handed to one Python call at a time hold at most about so many bytes, or one text.
SLICE_BYTES = 8 << 20

_ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Lower-cases A-Z and turns every byte that is neither a digit, a letter nor part of a longer character into a space.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def ascii_lower(raw: bytes) -> bytes:
    """``raw`` with A-Z, and nothing else, in lower case."""
    return raw.translate(_ASCII_LOWER)


def alnum_words(raw: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text, as UTF-8."""
    return raw.translate(_ALNUM).split()


def alnum_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte offsets of :func:`alnum_words`."""
    import re

    return [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_ALNUM))]


def space_words(raw: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text, as UTF-8."""
    return raw.split()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder as Parquet and read again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one operator in the shared folder; all that are not kept are deleted at its end.

    Only tables that no later read needs may go: a lost executor's work is made again from the tables that are left.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for df, _ in list(self.paths.values()):
            self.drop(df)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`written`; the table goes with this object."""
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves the table of ``df`` in place."""
        self.paths.pop(id(df))
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            _, path = self.paths.pop(id(df))
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its plan has neither enough partitions nor a shuffle: a table of a few files."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns named like one of ``names`` in any letter case: results replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken])


_RESIDENT: dict = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps for later tasks, under ``key``. A reused worker holds one such object; another
    key, or an operator that needs none, sets it free."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    _RESIDENT["asked"] = True
    return _RESIDENT[key]


def release() -> None:
    """Gives memory that is free in this process back to the system: the driver goes on to other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold ``SLICE_BYTES`` at most, unless it has a smaller bound: memory on both sides of a
    Python pass follows the batch. Results do not depend on it."""
    if int(str(spark.conf.get(_BATCH_BYTES)).rstrip("bB")) > SLICE_BYTES:
        spark.conf.set(_BATCH_BYTES, SLICE_BYTES)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _gathered(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``most`` bytes of text, where that is more than they hold."""
    if most <= SLICE_BYTES:
        yield from batches
        return
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(at).nbytes for b in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _fresh(factory: Callable) -> Callable:
    """The function that ``factory`` makes, in a worker without what earlier operators left there."""
    _RESIDENT.pop("asked", None)
    compute = factory()
    if not _RESIDENT.pop("asked", False) and _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
    return compute


def add_by_text(
    df: DataFrame,
    text_col: str,
    factory: Callable[[], Callable[[list[bytes | None]], list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Adds columns computed from whole texts, in Arrow batches, without a shuffle.

    ``factory`` is called once in a worker and returns a function from a list of UTF-8 texts (None for null) to one
    list or Arrow array for each of ``fields``. Input columns of those names are replaced. ``keep`` are the input
    columns to return besides (all by default). Batches are cut so that memory follows the longest text, not the batch.
    """
    names = [f.name for f in fields]
    taken = {n.lower() for n in names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    once = text_col in kept and df.schema[text_col].dataType == T.StringType()
    source = df.select(*[df[c] for c in kept], *([] if once else [df[text_col].cast("string").alias("__text")]))
    at = kept.index(text_col) if once else len(kept)
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = _fresh(factory)
        for batch in _gathered(batches, at, slice_bytes):
            texts = batch.column(at).cast(pa.binary())
            for lo, n in _slices(texts, slice_bytes):
                made = compute(texts.slice(lo, n).to_pylist())
                passed = [batch.column(i).slice(lo, n) for i in range(len(kept))]
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(passed + made, names=[*kept, *names])

    bound_batches(df.sparkSession)
    return spread(source).mapInArrow(run, schema)


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with at most ``most`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > most:
            yield lo, i - lo
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes) - lo
