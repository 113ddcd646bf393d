"""State of running aggregations as a table that holds every group once.

A micro-batch brings the changed groups. Groups are dealt to buckets by a hash of their key; only buckets that a micro-batch
touches are written anew, all others stay where they are. Each micro-batch is one version of the table (see
``sources/versions.py``) that notes the batch's number, so a batch that is repeated after a failure finds itself done, and
readers see the state between two batches, never half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.sources import versions as V

#: A bucket is written by one task, so it should stay within some hundred megabytes.
BUCKETS = 8


class StateTable:
    def __init__(self, spark: SparkSession, base: str, keys: list[str], schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.base, self.keys, self.schema, self.buckets = spark, base, keys, schema, buckets
        self.values = [f.name for f in schema.fields if f.name not in keys]

    def _latest(self) -> dict:
        version = V.latest_version(self.spark, self.base)
        return {} if version is None else V.entry(self.spark, self.base, version)

    def batch(self) -> int | None:
        """Number of the last micro-batch that counts."""
        return self._latest().get("batch")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.base}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """One row a group."""
        return self._rows(self._latest().get("data", []))

    def merge(self, changes: DataFrame, batch: int) -> bool:
        """Puts the changed groups of a micro-batch in place of their old rows; false if that was done before. A group comes
        once in ``changes``, with all its values."""
        if (self.batch() if self.batch() is not None else -1) >= batch:
            return False
        come = V.new_data(self.base)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        columns = [f.name for f in self.schema.fields]
        dealt = changes.select(*columns, bucket.alias("_bucket")).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.base}/{come}")
        touched = {n for n in V.names(self.spark, f"{self.base}/{come}") if n.startswith("_bucket=")}

        def attempt(version: int, current: int | None) -> tuple[list[str], dict, list[str]]:
            noted = {} if current is None else V.entry(self.spark, self.base, current)
            if noted.get("batch", -1) >= batch:
                raise _DoneError
            places = {d.rsplit("/", 1)[1]: d for d in noted.get("data", [])}
            old = self._rows([places[b] for b in sorted(touched & places.keys())]).withColumn("_n", F.lit(0))
            new = self._rows([f"{come}/{b}" for b in sorted(touched)]).withColumn("_n", F.lit(1))
            both = old.unionByName(new).withColumn("_bucket", bucket).repartition("_bucket")
            last = F.max_by(F.struct(*self.values), "_n")
            merged = both.groupBy("_bucket", *self.keys).agg(last.alias("_v")).select(*self.keys, "_v.*", "_bucket")
            folder = V.new_data(self.base)
            merged.select(*columns, "_bucket").write.partitionBy("_bucket").parquet(f"{self.base}/{folder}")
            places |= {b: f"{folder}/{b}" for b in touched}
            return list(places.values()), {"batch": batch}, [folder]

        try:
            V.committed(self.spark, self.base, attempt)
        except _DoneError:
            return False
        finally:
            V.remove(self.spark, f"{self.base}/{come}")
        return True


class _DoneError(Exception):
    """Another try of the same micro-batch came first."""
