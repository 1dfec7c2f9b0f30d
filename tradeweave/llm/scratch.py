"""Tables and folders that several steps of one operator share.

They live in the folder named by ``spark.checkpoint.dir``, which every executor
reaches; writing ends the lineage, so that a lost executor costs no recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local session that names none gets one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="llm-")
    return _own[app]


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_file(store, temporary: str, final: str) -> None:
    """Give a finished file its name; an attempt that is repeated replaces its file."""
    from pyarrow.fs import FileType

    if store.get_file_info(final).type != FileType.NotFound:
        store.delete_file(final)
    store.move(temporary, final)


#: Rows of a file, where the number of rows is known and a row is small.
FILE_ROWS = 1 << 18


class Scratch:
    """Tables of one run, below one fresh folder.

    ``table`` writes a DataFrame and reads it back; ``drop`` deletes a table that
    nothing needs any more. What a returned DataFrame still reads stays until the
    process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = shared_dir(spark)
        self.path = f"{root}/{name}-{uuid.uuid4().hex}"
        # a relative or plain path means Spark's default file system
        p, fs = _hadoop_path(spark, self.path)
        self.path = p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
        atexit.register(self.drop)

    def folder(self, name: str) -> str:
        """A fresh folder, made."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        p, fs = _hadoop_path(self.spark, path)
        fs.mkdirs(p)
        return path

    def table(self, df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
        """The table, written and read back.

        ``most_rows``, a bound on its rows, says how many files it needs: as many as
        the cluster has cores twice over, or more where they would hold more than
        FILE_ROWS rows each. Without it every partition is a file, and small tables
        over many partitions cost more in files than in rows.
        """
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        if most_rows is not None:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, -(-most_rows // FILE_ROWS)))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the given tables, or everything."""
        try:
            for path in [t._scratch_path for t in tables] or [self.path]:
                p, fs = _hadoop_path(self.spark, path)
                fs.delete(p, True)
        except Exception:  # noqa: BLE001 - tidying must not fail a finished run
            if tables:
                raise

