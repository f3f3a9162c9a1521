"""Stored tables whose changes appear together: rows are replaced by key, over several tables at once.

A table is cut into buckets by the hash of a key column (job_id, or a term). A commit writes the buckets that it changes,
for all its tables, into folders of its own and then publishes the next manifest, which says where each bucket lives.
Readers follow the last manifest: before it is published they see the old state of all tables, afterwards the new one.
A commit that dies midway leaves folders that no manifest names. Two commits at once: the second to publish raises, and
may be run again. `vacuum` deletes what neither of the last manifests names.

A manifest's size follows tables times buckets, not rows. A bucket's rows are sorted by key, so that a filter on the key
skips row groups; more buckets keep a bucket's rewrite small.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared


class Conflict(RuntimeError):
    """Another commit was published first."""


def key_id(*parts: Column | str) -> Column:
    """A surrogate id that depends on the key alone: 60 bits of the digest of its parts, so a row replaced keeps its id."""
    text = F.concat_ws("\u0001", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\u0002")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


class Snapshot:
    """All tables as of one manifest."""

    def __init__(self, store: Store, number: int, manifest: dict):
        self.store, self.number, self.manifest = store, number, manifest

    def has(self, table: str) -> bool:
        return table in self.manifest["schemas"]

    def read(self, table: str, *values, buckets: list[int] | None = None) -> DataFrame:
        """The table; only the rows with these keys, or all rows of some buckets, if they are given. No other files are opened."""
        spark, key = self.store.spark, self.store.keys[table]
        if not self.has(table):
            raise ValueError(f"no table {table}")
        schema = T.StructType.fromJson(self.manifest["schemas"][table])
        if values and key:
            buckets = sorted(set(spark.range(1).select(*[self.store.bucket(table, F.lit(v)) for v in values]).first()))
        places = {int(b): p for b, p in self.manifest["places"].get(table, {}).items()}
        paths = [f"{self.store.root}/data/{places[b]}" for b in sorted(places) if buckets is None or b in buckets]
        rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return rows.where(F.col(key).isin(*values)) if values and key else rows


class Store:
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str | None], buckets: int = 16):
        """keys: the key column of each table; None for a table of few rows, which is one bucket."""
        self.spark, self.root, self.keys, self.buckets = spark, root, keys, buckets

    def _manifest(self) -> tuple[int, dict]:
        found = [n for n in shared.names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not found:
            return 0, {"buckets": self.buckets, "schemas": {}, "places": {}}
        manifest = json.loads(shared.read_text(self.spark, f"{self.root}/manifest/{found[-1]}"))
        if manifest["buckets"] != self.buckets:
            raise ValueError(f"the store has {manifest['buckets']} buckets")
        return int(found[-1][:-5]), manifest

    def bucket(self, table: str, column: Column | None = None) -> Column:
        key = self.keys[table]
        if key is None:
            return F.lit(0).cast("int")
        return F.pmod(F.xxhash64((F.col(key) if column is None else column).cast("string")), F.lit(self.buckets)).cast("int")

    def buckets_of(self, table: str, rows: DataFrame, column: str | None = None) -> list[int]:
        """The buckets in which these rows' keys are; as many as the store has at most."""
        found = rows.select(self.bucket(table, F.col(column or self.keys[table])).alias("b")).distinct().collect() if self.keys[table] else [[0]]
        return sorted(r[0] for r in found)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, *self._manifest())

    def read(self, table: str, *values, buckets: list[int] | None = None) -> DataFrame:
        return self.snapshot().read(table, *values, buckets=buckets)

    def commit(self, contents: dict[str, tuple[DataFrame, list[int]]]) -> None:
        """Give these buckets of each table these contents, all together."""
        self._publish(self.snapshot(), contents)

    def _publish(self, seen: Snapshot, contents: dict[str, tuple[DataFrame, list[int]]]) -> None:
        attempt, number, manifest = uuid.uuid4().hex, seen.number, json.loads(json.dumps(seen.manifest))
        for table, (rows, buckets) in contents.items():
            place = f"{table}/{attempt}"
            written = self._write(table, rows, f"{self.root}/data/{place}")
            manifest["schemas"][table] = rows.schema.jsonValue()
            now = manifest["places"].setdefault(table, {})
            for b in buckets:
                now.pop(str(b), None)
            now.update({str(b): f"{place}/__bucket={b}" for b in written if b in buckets})
        if not shared.publish(self.spark, f"{self.root}/manifest/{number + 1:08d}.json", json.dumps(manifest)):
            raise Conflict(f"manifest {number + 1} is there already")

    def _write(self, table: str, rows: DataFrame, path: str) -> list[int]:
        key = self.keys[table]
        dealt = rows.withColumn("__bucket", self.bucket(table))
        # large buckets are split over several files by Spark's rebalancing, small ones stay in one
        dealt = dealt.hint("rebalance", "__bucket").sortWithinPartitions("__bucket", *([key] if key else []))
        dealt.write.partitionBy("__bucket").parquet(path)
        return [int(n.split("=")[1]) for n in shared.names(self.spark, path) if n.startswith("__bucket=")]

    def replace(self, gone: DataFrame, new: dict[str, DataFrame], also: dict[str, tuple[DataFrame, list[int]]] | None = None, seen: Snapshot | None = None) -> None:
        """Rows of `new` in place of all rows with the keys of `gone` (one column), in each of these tables; `also` as in commit.

        What was worked out from an earlier snapshot hands it on as `seen`: a commit in between is then a conflict."""
        seen = self.snapshot() if seen is None else seen
        name = gone.columns[0]
        contents = dict(also or {})
        for table, rows in new.items():
            key = self.keys[table]
            # the keys of the new rows are replaced too, so that a key never has rows of two commits
            keys = gone.select(F.col(name).alias(key)).unionByName(rows.select(key)).distinct()
            buckets = self.buckets_of(table, keys) if seen.has(table) else list(range(self.buckets if key else 1))
            kept = rows
            if seen.has(table):
                old = seen.read(table, buckets=buckets)
                kept = old.join(keys, old[key].eqNullSafe(keys[key]), "left_anti").unionByName(rows, allowMissingColumns=True)
            contents[table] = (kept, buckets)
        self._publish(seen, contents)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` manifests names, and older manifests; how many folders went.

        Not beside a commit that is under way: its folders are not named yet.
        """
        found = [n for n in shared.names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        named = set()
        for n in found[-keep:]:
            manifest = json.loads(shared.read_text(self.spark, f"{self.root}/manifest/{n}"))
            named |= {p.rsplit("/", 1)[0] for places in manifest["places"].values() for p in places.values()}
        gone = 0
        for table in shared.names(self.spark, f"{self.root}/data"):
            for attempt in shared.names(self.spark, f"{self.root}/data/{table}"):
                if f"{table}/{attempt}" not in named:
                    shared.delete(self.spark, f"{self.root}/data/{table}/{attempt}")
                    gone += 1
        for n in found[:-keep]:
            shared.delete(self.spark, f"{self.root}/manifest/{n}")
        return gone
