"""A keyed table on shared storage: put, replace, remove, trim.

Rows lie in Parquet by namespace and bucket (a hash of the key). A change reads and rewrites only the partitions it touches, each to one sorted file, so the table is
always compact and the work follows the change, not the history. A change that runs twice leaves the same rows; a lost executor costs tasks, not rows,
because what is written was materialised before. One writer at a time; readers that started before a change should be done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changelens.operators.grouping import first_per_group, materialize

_PLACE = ("namespace", "bucket")
#: So many touched partitions are named in the filter of a read; more are joined.
_NAMED = 1_000


class KeyedTable:
    """Rows (namespace, key, ts, seq, further columns); the newest of a key by (ts, seq) is its value. ``namespace`` is not empty."""

    def __init__(self, spark: SparkSession, path: str, columns: str = "value string", buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = StructType.fromDDL(f"namespace string, bucket int, key string, ts timestamp, seq bigint, {columns}")
        self.columns = [name for name in self.schema.names if name != "bucket"]
        spark.createDataFrame([], self.schema).write.mode("append").partitionBy(*_PLACE).parquet(path)

    def read(self) -> DataFrame:
        return self._files().select(*self.columns)

    def _files(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read_of(self, namespaces: DataFrame) -> DataFrame:
        """Rows of the namespaces (namespace); the partitions of others are not read."""
        asked = namespaces.select("namespace").distinct()
        named = asked.limit(_NAMED + 1).collect()
        if len(named) > _NAMED:
            return self.read().join(asked, "namespace", "left_semi")
        return self.read().filter(F.col("namespace").isin([n["namespace"] for n in named]))

    def put(self, rows: DataFrame) -> None:
        """Insert or replace by key; a row that is older than the stored one changes nothing."""
        new = materialize(_newest(self._placed(rows)))
        self._write(_newest(self._touched(new).unionByName(new)))

    def remove(self, keys: DataFrame) -> None:
        """Take out (namespace, key)."""
        gone = materialize(keys.select("namespace", "key", self._bucket()).distinct())
        old = self._touched(gone)
        self._replace(gone, old.join(gone, [*_PLACE, "key"], "left_anti"))

    def trim(self, k: int) -> None:
        """Keep the newest ``k`` keys of every namespace; ranks are found on narrow rows."""
        narrow = self._files().select(*_PLACE, "key", "ts", "seq")
        kept = first_per_group(narrow, ["namespace"], [F.col("ts").desc(), F.col("seq").desc(), F.col("key")], k)
        gone = materialize(narrow.join(kept.select(*_PLACE, "key"), [*_PLACE, "key"], "left_anti").select(*_PLACE, "key"))
        self._replace(gone, self._touched(gone).join(gone, [*_PLACE, "key"], "left_anti"))

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[self._bucket() if name == "bucket" else F.col(name) for name in self.schema.names])

    def _touched(self, rows: DataFrame) -> DataFrame:
        """What is stored in the partitions of ``rows``; the others are not read."""
        places = rows.select(*_PLACE).distinct()
        named = places.limit(_NAMED + 1).collect()
        if len(named) > _NAMED:
            return self._files().join(places, list(_PLACE), "left_semi")
        return self._files().filter(F.concat_ws("\n", *_PLACE).isin([f"{p['namespace']}\n{p['bucket']}" for p in named]))

    def _replace(self, touched: DataFrame, rows: DataFrame) -> None:
        """Write the rows that stay and delete the partitions where none does."""
        rows = materialize(rows)
        emptied = touched.select(*_PLACE).distinct().join(rows.select(*_PLACE).distinct(), list(_PLACE), "left_anti")
        self._write(rows)
        jvm = self.spark._jvm
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for place in emptied.toLocalIterator():
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/namespace={escaped(place['namespace'])}/bucket={place['bucket']}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _write(self, rows: DataFrame) -> None:
        made = materialize(rows.select(*self.schema.names)).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "key")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(self.path)


def _newest(rows: DataFrame, keys: Sequence[str] = (*_PLACE, "key")) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")).select(*keys, "r.*")
