"""Vector store as Parquet snapshots partitioned by collection.

Layout: <root>/data-<id>/collection=<c>/... hold what one commit wrote, and
<root>/_log/<n> names, for each collection of version n, the folder that holds
it. A commit that names the collections it touches reads and writes those alone;
the others stay where they are. Its rows are written under a name of their own,
then its log entry is moved into place, which fails if another writer has
taken the number. A writer that dies before that leaves an unnamed folder, which
nothing reads and vacuum() removes; a reader that has resolved its version never
sees a later one. The move is atomic on HDFS; an object store needs one that is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "collection string, identifier string, vector array<float>, content_hash string, metadata string, tstamp long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KEY = ["collection", "identifier"]


class VectorStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        fs, _ = self._fs()
        log = self._path("_log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        """Partition folder of each collection → the data folder that holds it; empty before the first version."""
        if not version:
            return {}
        entry = self._fs()[0].open(self._path(f"_log/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(entry, "UTF-8"))
        finally:
            entry.close()

    def _partition(self, collection: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("collection", collection)

    def read(self, version: int | None = None, collections: Iterable[str] | None = None) -> DataFrame:
        """A version's rows, the newest's unless one is given; of the named collections only, if any are named."""
        held = self._manifest(self.version() if version is None else version)
        if collections is not None:
            wanted = {self._partition(c) for c in collections}
            held = {part: folder for part, folder in held.items() if part in wanted}
        rows = None
        for folder in sorted(set(held.values())):
            base = f"{self.root}/{folder}"
            parts = [f"{base}/{part}" for part in sorted(held) if held[part] == folder]
            found = self.spark.read.schema(SCHEMA).option("basePath", base).parquet(*parts).select(*COLUMNS)
            rows = found if rows is None else rows.unionByName(found)
        return self.spark.createDataFrame([], SCHEMA) if rows is None else rows

    def commit(self, rows: DataFrame, expected: int | None = None, touched: Iterable[str] | None = None) -> int:
        """Write the next version; raises if another writer committed since version ``expected`` or while this one wrote.

        rows are the whole next version, or, if touched collections are named,
        the whole next state of those: rows of others are left out, and others
        stay as they are.
        """
        now = self.version()
        if expected is not None and now != expected:
            raise RuntimeError(f"store is at version {now}, not {expected}")
        folder, held = f"data-{uuid.uuid4().hex}", {}
        if touched is not None:
            touched = set(touched)
            replaced = {self._partition(c) for c in touched}
            held = {part: at for part, at in self._manifest(now).items() if part not in replaced}
            named = F.col("collection").isin(sorted(touched - {None}))
            rows = rows.where(named | F.col("collection").isNull() if None in touched else named)
        rows.select(*COLUMNS).write.partitionBy("collection").mode("errorifexists").parquet(f"{self.root}/{folder}")
        parts = [s.getPath().getName() for s in self._fs()[0].listStatus(self._path(folder)) if s.isDirectory()]
        held.update({part: folder for part in parts if part.startswith("collection=")})
        fs, _ = self._fs()
        entry = self._path(f"_log/.{folder}")
        out = fs.create(entry, False)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        java = self.spark._jvm.java.lang
        plain = java.reflect.Array.newInstance(java.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(entry), fs.makeQualified(self._path(f"_log/{now + 1}")), plain)
        except Exception as e:
            fs.delete(entry, False)
            fs.delete(self._path(folder), True)
            raise RuntimeError(f"another writer has committed version {now + 1}") from e
        return now + 1

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest versions and what dead writers left; only while nobody writes. How many folders went."""
        fs, root = self._fs()
        now = self.version()
        kept = {folder for v in range(max(1, now - keep + 1), now + 1) for folder in self._manifest(v).values()}
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in kept]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def exists(self, collection: str, identifier: str) -> bool:
        return self.scan(collection).where(F.col("identifier") == identifier).limit(1).count() > 0

    def scan(self, collection: str) -> DataFrame:
        return self.read(collections=[collection])

    def identifiers(self, collection: str) -> DataFrame:
        return self.scan(collection).select("identifier")

    def by_prefix(self, collection: str, prefix: str) -> DataFrame:
        return self.identifiers(collection).where(F.col("identifier").startswith(prefix))

    def lookup(self, keys: DataFrame, *columns: str) -> DataFrame:
        """Point lookups in bulk: keys with the wanted columns, null where there is no row."""
        return keys.join(self.read().select(*KEY, *columns), KEY, "left")


def latest(rows: DataFrame, order: str = "tstamp") -> DataFrame:
    """The last written row of each key; of rows written at once, the one of the largest hash of its columns."""
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc(order), F.desc(F.xxhash64(*(c for c in rows.columns)))))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's rows in place of its own; a key that new holds twice is stored once, by its latest row."""
    new = latest(new)
    return old.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def update_metadata(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new: key and metadata; vectors and hashes stay, tstamp becomes now. Of a key given twice the largest metadata counts."""
    given = new.groupBy(*KEY).agg(F.max("metadata").alias("_m"), F.lit(True).alias("_hit"))
    joined = old.join(given, KEY, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumn("metadata", F.when(hit, F.col("_m")).otherwise(F.col("metadata"))).withColumn("tstamp", F.when(hit, F.lit(now)).otherwise(F.col("tstamp"))).drop("_m", "_hit")


def delete(old: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
    """What stays, and how many rows went."""
    return old.join(keys.select(*KEY), KEY, "left_anti"), old.join(keys.select(*KEY), KEY, "left_semi").count()


def clear(old: DataFrame, collection: str, confirm: bool = False) -> DataFrame:
    return old.where(F.col("collection") != collection) if confirm else old
