"""Embedding store (H1): half-precision vectors in append-only Parquet files.

A vector is stored as its components in IEEE half precision, two bytes each, little
endian.  Every ``add`` writes one new folder of files and never touches old ones, so a
failed add leaves the store as it was.  An id that is already stored, or comes twice in
one add, is an error unless overwriting is asked for; then the newest add wins on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions.vectors import from_half, to_half
from corpuskit.session import written


class EmbeddingStore:
    """A store below ``path`` (a folder that all executors see); ids are ``key``, vectors come as arrays in ``vec``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", vec: str = "embedding"):
        self.spark, self.path, self.key, self.vec = spark, path.rstrip("/"), key, vec

    def _adds(self) -> list[tuple[int, bool]]:
        """Number and kind of each add, from the names of its folder (a listing of one level)."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted((int(n[1:7]), n.endswith("-over")) for n in names if n.startswith("a"))

    def add(self, vectors: DataFrame, allow_overwrite: bool = False) -> None:
        """Stores ``vectors``; raises ``ValueError`` on an id that is there or comes twice, unless ``allow_overwrite``."""
        new = vectors.filter(F.col(self.key).isNotNull() & F.col(self.vec).isNotNull())
        new = written(new.withColumn(self.vec, to_half(self.vec)), "half")
        if new.groupBy(self.key).count().filter("count > 1").head(1):
            raise ValueError("an id comes twice in one add")
        adds = self._adds()
        if adds and not allow_overwrite and new.select(self.key).join(self._raw(adds).select(self.key), self.key, "left_semi").head(1):
            raise ValueError("embedding ids already stored; pass allow_overwrite=True")
        number = adds[-1][0] + 1 if adds else 0
        new.write.parquet(f"{self.path}/a{number:06d}" + ("-over" if allow_overwrite and adds else ""))

    def _raw(self, adds: list[tuple[int, bool]]) -> DataFrame:
        paths = [f"{self.path}/a{n:06d}" + ("-over" if over else "") for n, over in adds]
        return self.spark.read.parquet(*paths).withColumn("_add", F.regexp_extract(F.col("_metadata.file_path"), r"/a(\d{6})(?:-over)?/[^/]*$", 1).cast("int"))

    def read(self, decoded: bool = True) -> DataFrame:
        """The stored vectors, as float arrays or (``decoded=False``) as stored; the newest of each id."""
        adds = self._adds()
        if not adds:
            raise ValueError(f"nothing is stored in {self.path}")
        df = self._raw(adds)
        if any(over for _, over in adds):
            newest = Window.partitionBy(self.key).orderBy(F.col("_add").desc())
            df = df.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
        df = df.drop("_add")
        return df.withColumn(self.vec, from_half(self.vec)) if decoded else df
