"""A keyed table in hash buckets, of which a write touches only those that its batch falls into.

Rows lie in folders by a hash of their key; a manifest (the text of the last pointer file) lists the folders that make
up each bucket. A write reads the buckets of its batch's keys, writes their new rows to a folder of its own and publishes
a manifest that names it, so a reader sees all of a write or nothing, and a crash before that leaves the table as
it was. The table's side of a write is not shuffled: a batch of up to ``SMALL`` rows (counted first) goes to every task,
a larger one meets the touched buckets in a shuffle. Folders that no manifest names any more stay for readers of older
ones; ``drop_unused`` deletes them.

Keys must not be null. A batch may repeat a key; its rows are reduced first, as the functions of ``sinks`` do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bibliodyne.session import drop_path, materialize
from bibliodyne.sources.sinks import has_snapshot, latest_per_key, pointer, publish

#: Rows of a batch that are sent to every task at most.
SMALL = 100_000


@dataclass
class BucketTable:
    spark: SparkSession
    root: str

    # ------------------------------------------------------------ reading

    def _manifest(self) -> tuple[int, dict]:
        number, text = pointer(self.spark, self.root)
        return number, json.loads(text)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        chosen = manifest["folders"] if buckets is None else {str(b): manifest["folders"].get(str(b), []) for b in buckets}
        paths = [f"{self.root}/{p}" for some in chosen.values() for p in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows(self._manifest()[1])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        _, manifest = self._manifest()
        asked = materialize(self._bucketed(keys.select(*manifest["keys"]).distinct(), manifest), "bucket-keys")
        rows = self._rows(manifest, self._touched(asked))
        asked = asked.drop("_bucket")
        return rows.join(F.broadcast(asked) if asked.count() <= SMALL else asked, manifest["keys"], "left_semi")

    @staticmethod
    def _bucketed(rows: DataFrame, manifest: dict) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*manifest["keys"]), F.lit(manifest["buckets"])).cast("int"))

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        """Bucket numbers, at most as many as there are buckets."""
        return sorted(r[0] for r in rows.select("_bucket").distinct().collect())

    # ------------------------------------------------------------ writing

    @classmethod
    def create(cls, rows: DataFrame, root: str, keys: list[str], buckets: int = 1024) -> BucketTable:
        """A new table of ``rows``, one per key; a bucket should hold some ten thousand rows."""
        table = cls(rows.sparkSession, root)
        if has_snapshot(rows.sparkSession, root):
            raise ValueError(f"{root} holds a table")
        manifest = {"keys": keys, "buckets": buckets, "schema": json.loads(rows.schema.json()), "folders": {}}
        # Each bucket is written by one task, as one file.
        table._commit(0, manifest, cls._bucketed(rows, manifest).repartition("_bucket"), list(range(buckets)), keep=False)
        return table

    def _commit(self, number: int, manifest: dict, rows: DataFrame, touched: list[int], keep: bool) -> None:
        """Write ``rows`` (with ``_bucket``) and publish them instead of (``keep``: beside) what the touched buckets had."""
        folder = f"data-{uuid.uuid4().hex}"
        schema = StructType.fromJson(manifest["schema"])
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        made = [s.getPath().getName() for s in fs.listStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}"))]
        new = {int(n.removeprefix("_bucket=")): f"{folder}/{n}" for n in made if n.startswith("_bucket=")}
        folders = dict(manifest["folders"])
        for b in touched:
            held = (folders.get(str(b), []) if keep else []) + ([new[b]] if b in new else [])
            folders.pop(str(b), None)
            if held:
                folders[str(b)] = held
        publish(self.spark, self.root, json.dumps(manifest | {"folders": folders}), after=number)

    def _write(self, batch: DataFrame, rule, keep: bool = False) -> int:
        """Apply ``rule(current rows, batch, keys)`` to the buckets of a batch; returns how many buckets it touched."""
        number, manifest = self._manifest()
        new = materialize(self._bucketed(batch, manifest), "bucket-batch")
        touched = self._touched(new)
        if not touched:
            return 0
        small = new.count() <= SMALL
        current = self._bucketed(self._rows(manifest, touched), manifest)
        self._commit(number, manifest, rule(current, new, manifest["keys"], F.broadcast if small else lambda x: x), touched, keep)
        return len(touched)

    def upsert(self, batch: DataFrame, order: Column) -> int:
        """Rows by key; a non-null new value wins, a null one never wipes an old one."""
        def rule(current: DataFrame, new: DataFrame, keys: list[str], sent) -> DataFrame:
            others = [c for c in current.columns if c not in keys and c != "_bucket"]
            present = [c for c in others if c in new.columns]
            renamed = new.drop("_bucket").withColumnsRenamed({c: f"_n_{c}" for c in present})
            merged = current.join(sent(renamed), keys, "left").select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) if c in present else F.col(c) for c in others], "_bucket")
            return merged.unionByName(self._absent(current, new, keys, sent), allowMissingColumns=True)

        return self._write(latest_per_key(batch, self._manifest()[1]["keys"], order), rule)

    def replace(self, batch: DataFrame) -> int:
        """All rows of the batch's keys are replaced by the batch's (delete, then add); a key may have several."""
        def rule(current: DataFrame, new: DataFrame, keys: list[str], sent) -> DataFrame:
            return current.join(sent(new.select(*keys).distinct()), keys, "left_anti").unionByName(new)

        return self._write(batch, rule)

    def insert_absent(self, batch: DataFrame, order: list[Column]) -> int:
        """Rows whose key the table lacks, the first per key in order; a folder is added, nothing is rewritten."""
        keys = self._manifest()[1]["keys"]
        first = batch.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
        return self._write(first, self._absent, keep=True)

    @staticmethod
    def _absent(current: DataFrame, new: DataFrame, keys: list[str], sent) -> DataFrame:
        """The batch's rows whose key is new. What is found of them in the table is a part of the batch, not of the table."""
        found = current.select(*keys).join(sent(new.select(*keys)), keys, "left_semi").distinct()
        return new.join(found, keys, "left_anti")

    def compact(self, most: int = 8) -> int:
        """Buckets of over ``most`` folders are written as one; returns how many were."""
        number, manifest = self._manifest()
        long = [int(b) for b, paths in manifest["folders"].items() if len(paths) > most]
        if long:
            self._commit(number, manifest, self._bucketed(self._rows(manifest, long), manifest).repartition("_bucket"), long, keep=False)
        return len(long)

    def drop_unused(self) -> int:
        """Delete folders that the last manifest does not name; no reader of an older one and no writer may be at work."""
        _, manifest = self._manifest()
        used = {p.split("/")[0] for paths in manifest["folders"].values() for p in paths}
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
        unused = [n for n in names if n.startswith("data-") and n not in used]
        for n in unused:
            drop_path(self.spark, f"{self.root}/{n}")
        return len(unused)
