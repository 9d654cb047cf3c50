"""Places that every executor can reach, and cutting a plan's lineage there."""
from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine is made and set, but only in local mode:
    on a cluster each executor would write to its own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    What follows is planned from the files: a lost executor costs a re-read, not
    a recomputation of everything before.  ``forget`` deletes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewire_path = path.rsplit("/", 1)[0]
    return out


def forget(*written: DataFrame) -> None:
    """Delete the files of tables that ``cut`` made and that no plan reads any more."""
    for df in written:
        remove(df.sparkSession, df._tidewire_path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a task of a spread step gets.
ROWS = 200_000


def tasks_for(*read: DataFrame, each: int = ROWS) -> int:
    """Tasks of a step over all rows of the files that these tables read, one for ``each`` rows.

    The session's number of partitions is fixed, and what adaptive execution makes of it goes by
    compressed bytes, so there a task's rows grow with the input.  Rows are counted from the
    files' footers.  There are at least as many tasks as cores, and where rows don't
    come from Parquet files as many as the session has partitions.
    """
    spark = read[0].sparkSession
    least = spark.sparkContext.defaultParallelism
    rows = 0
    for df in read:
        files = [unquote(f) for f in df.inputFiles()]
        if not files or not all(f.endswith(".parquet") for f in files):
            least = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
        else:
            rows += spark.read.option("recursiveFileLookup", True).parquet(*files).count()
    return max(least, -(-rows // each))
