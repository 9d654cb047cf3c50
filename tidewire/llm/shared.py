"""What the corpus operators share: written intermediates, small batches, samples by class."""
from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, forget, remove, shared_dir  # noqa: F401 - for the operators

#: Bytes of the batches that go to Python workers, at most: texts are held there several times over.
BATCH_BYTES = 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; from here on its session sends batches of BATCH_BYTES or less to Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def carried(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but its ``own`` under names that no operator uses, and what gives those back their names."""
    names = {f"carried_{i}_": c for i, c in enumerate(docs.columns) if c not in own}
    plain = docs.toDF(*[c if c in own else f"carried_{i}_" for i, c in enumerate(docs.columns)])
    return plain, lambda df: df.toDF(*[names.get(c, c) for c in df.columns])


def release() -> None:
    """Give memory that is free again back to the system, where the C library knows how."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker, which lives on, gives its memory back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def class_sample(rows: DataFrame, by: str, classes: DataFrame, each: int, seed: int) -> DataFrame:
    """About ``each`` rows of every class, or all of a smaller one, chosen by a hash ``h`` of doc_id.

    classes: (by, class_rows) of the classes wanted, whose number the caller bounds; they go
    to every task.  Each row is judged alone against its class's share, so no class is
    gathered in one task.  Rows of other classes are left out.
    """
    held = rows.join(F.broadcast(classes), by).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    share = F.col("h").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    return held.where(share * F.col("class_rows") < each).drop("class_rows")
