"""A table with one row per key that a stream keeps up to date, on plain files.

Every batch writes the newest row of each key it changes as a delta of its own. After some batches the deltas are merged
with the base into a new base, in as many files as there are buckets, and what they replace is removed one merge later, so
that readers of the last state can finish. A batch that runs again writes its delta again, or nothing if it is merged
already: a replay changes nothing. Only folders that Spark has marked as complete count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glyphray.operators.headers import latest_per_key

BATCH = "__batch"


class KeyedTable:
    """``keys`` name a row; of several rows the one that comes last by ``order``, then by batch, stays."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str] = (),
        buckets: int = 16, every: int = 8,
    ):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), [*order, BATCH]
        self.schema = StructType(list(schema.fields)).add(BATCH, "long")
        self.buckets, self.every = buckets, every

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch; for ``foreachBatch``."""
        base, deltas = self._state()
        if base is not None and batch_id <= base:
            return
        rows = batch.select(*self.schema.names[:-1]).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        self._write(latest_per_key(rows, self.keys, self.order), f"delta/{batch_id}")
        if len({*deltas, batch_id}) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Merge all deltas into the base."""
        base, deltas = self._state()
        if not deltas:
            return
        upto = max(deltas)
        self._write(self._current(), f"base/{upto}")
        for name in self._ids("base"):
            if name != upto and (base is None or name < base):
                self._remove(f"base/{name}")
        for name in self._ids("delta"):
            if base is not None and name <= base:
                self._remove(f"delta/{name}")

    def read(self) -> DataFrame:
        """The newest row of every key."""
        return self._current().drop(BATCH)

    def _current(self) -> DataFrame:
        base, deltas = self._state()
        folders = [f"{self.path}/delta/{d}" for d in deltas] + ([f"{self.path}/base/{base}"] if base is not None else [])
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return latest_per_key(self.spark.read.schema(self.schema).parquet(*folders), self.keys, self.order).select(*self.schema.names)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.select(*self.schema.names).repartition(self.buckets, *self.keys).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _state(self) -> tuple[int | None, list[int]]:
        """Number of the last batch in the base, and of the complete deltas after it."""
        base = max(self._ids("base", True), default=None)
        return base, sorted(d for d in self._ids("delta", True) if base is None or d > base)

    def _place(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _store(self):
        return self._place("base").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _ids(self, kind: str, complete: bool = False) -> list[int]:
        store, place = self._store(), self._place(kind)
        names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
        return [int(n) for n in names if not complete or store.exists(self._place(f"{kind}/{n}/_SUCCESS"))]

    def _remove(self, name: str) -> None:
        self._store().delete(self._place(name), True)


def start_live(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` up to date with a stream that updates rows (an aggregate per key): only changed keys are written."""
    return (
        stream.writeStream.outputMode("update").foreachBatch(table.merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
