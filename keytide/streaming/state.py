"""State tables of a stream, one version per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedState:
    """Tables below ``root``, each with a folder per batch.

    A batch reads what the batch before it wrote and overwrites its own version, so
    running a batch again after a failure gives the same tables. ``root`` belongs in
    the folder the executors share.

    State (``save``) is what the next batch needs; of it the last ``keep`` versions stay,
    all of them without ``keep``. Results (``emit``) stay. Scratch is for one batch and goes
    with it.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None):
        if keep is not None and keep < 2:
            raise ValueError("a batch reads the version before its own: keep at least 2")
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep
        self._saved: set[str] = set()
        self._scratch: set[str] = set()

    def path(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch={batch_id}"

    def before(self, name: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.read(name, batch_id - 1, schema)

    def read(self, name: str, batch_id: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name, batch_id))

    def up_to(self, name: str, batch_id: int, schema: str) -> DataFrame:
        """What all batches before this one wrote, where each wrote what was new."""
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        earlier = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{name}")
        return earlier.where(F.col("batch") < batch_id).drop("batch")

    def exists(self, name: str, batch_id: int) -> bool:
        """Whether a version has been written to its end."""
        return self.exists_path(f"{self.path(name, batch_id)}/_SUCCESS")

    def versions(self, name: str) -> list[int]:
        """Batches of which ``name`` has been written to its end."""
        folder, fs = self._located(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        batches = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        return sorted(b for b in batches if self.exists(name, b))

    def exists_path(self, path: str) -> bool:
        place, fs = self._located(path)
        return fs.exists(place)

    def save(self, name: str, batch_id: int, df: DataFrame) -> DataFrame:
        self._saved.add(name)
        return self._write(name, batch_id, df)

    def emit(self, name: str, batch_id: int, df: DataFrame) -> None:
        self._write(name, batch_id, df)

    def scratch(self, name: str, batch_id: int, df: DataFrame) -> DataFrame:
        self._scratch.add(name)
        return self._write(name, batch_id, df)

    def finish(self, batch_id: int) -> None:
        """Call after the last write of a batch, when nothing reads older versions any more."""
        for name in self._scratch:
            self._delete(self.path(name, batch_id))
        if self.keep is not None and batch_id >= self.keep:
            for name in self._saved:
                self._delete(self.path(name, batch_id - self.keep))

    def history(self, name: str) -> DataFrame:
        """All versions still kept, with the ``batch`` they belong to."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _write(self, name: str, batch_id: int, df: DataFrame) -> DataFrame:
        path = self.path(name, batch_id)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        old, fs = self._located(path)
        fs.delete(old, True)

    def _located(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
