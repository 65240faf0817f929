"""A catalog kept in buckets of its key, as layers (J1-J3 without a shuffle of the catalog).

The catalog is one large bucketed layer and a few small ones on top, all with the same number of
buckets.  A lookup shuffles the asked-for names to the buckets and never the catalog; an insert or
upsert writes only the rows it changes, as a new layer; a removal writes marks.  An entry is the row
of its key in the newest layer that has one.  Layers are merged bucket by bucket once there are
``MERGE_AT`` of them, again without a shuffle, into a new base.  Nothing is rewritten in place: a
version becomes visible by its commit record, and a failed write leaves nothing a reader would see.

Spark keeps the layout of a bucketed table in its session catalog; here it is in the commit records
too, so any session can open the folders as external tables.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.operators.catalog import ADDED, add_entries, find_files, no_clash
from gridweave.operators.changes import catalog_changes
from gridweave.session import delete_path, kept_result

#: Layers (the base included) from which the next change merges them first.
MERGE_AT = 8
#: Rows of a bucket, and buckets of a small catalog.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 16
_COMMITS = "versions"
_COMMIT_SCHEMA = "version long, layers array<string>, buckets int, key string, columns string"
#: Marks the row of a removed key.
_GONE = "_gone"


class BucketedCatalog:
    """The catalog below ``root``; its key is unique and never null.

    One writer at a time: of two that write the same version the second fails.  A column ``_gone``
    is refused.  Empty catalogs and empty changes are versions like others.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._tables: dict[str, str] = {}

    @classmethod
    def create(cls, spark: SparkSession, root: str, catalog: DataFrame, buckets: int, key: str = "lfn") -> BucketedCatalog:
        """A new catalog holding the entries of ``catalog`` (version 0); a null or repeated key is an error."""
        no_clash(catalog, [_GONE])
        self = cls(spark, root)
        rows = catalog.withColumn(_GONE, F.lit(False))
        layer = self._write(rows.repartition(buckets, key), buckets, key)
        base = spark.table(self._tables[layer])
        wrong = base.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).first()
        if wrong:
            raise ValueError("entry without a name" if wrong[0] is None else f"{wrong[0]} is in the catalog more than once")
        self._commit(0, [layer], buckets, key, rows.schema.json())
        return self

    def version(self, version: int | None = None) -> Row:
        """The commit record of a version (None: the newest): its layers, buckets, key and columns."""
        commits = self.spark.read.schema(_COMMIT_SCHEMA).option("recursiveFileLookup", "true").json(f"{self.root}/{_COMMITS}")
        if version is not None:
            commits = commits.where(F.col("version") == version)
        row = commits.orderBy(F.desc("version")).first()
        if row is None:
            raise LookupError(f"no such version below {self.root}")
        return row

    def read(self, version: int | None = None) -> DataFrame:
        """The entries of a version (None: the newest)."""
        return self._entries(self.version(version))

    def find(self, wanted: DataFrame, lfn_col: str = "lfn") -> DataFrame:
        """:func:`find_files` against the newest version; only ``wanted`` is shuffled."""
        return find_files(self.read(), wanted, lfn_col)

    def insert(self, new: DataFrame, seq: str = "seq", override: bool = False) -> DataFrame:
        """:func:`add_entries` into the newest version; the added rows are the next version's layer.

        Returns the outcome of every new row, computed once.  ``new`` holds the catalog's columns and ``seq``.
        """
        v = self.version()
        outcome = kept_result(add_entries(self.read(), new, key=v["key"], seq=seq, override=override))
        self._layer(v, outcome.where(F.col("status") == ADDED))
        return outcome

    def upsert(self, updates: DataFrame, seq: str = "seq") -> int:
        """Whole-entry replacement: the last update of a key wins, one without a key is not applied.

        Only the last updates are written; the catalog is not read.  Returns the new version.
        """
        v = self.version()
        rest = [c for c in self._columns(v) if c not in (v["key"], _GONE)]
        entry = F.max_by(F.struct(F.lit(False).alias(_GONE), *rest), F.col(seq))
        last = updates.where(F.col(v["key"]).isNotNull()).groupBy(v["key"]).agg(entry.alias("_v"))
        return self._layer(v, last.select(v["key"], "_v.*"))

    def remove(self, keys: DataFrame) -> int:
        """Remove the entries whose keys are in ``keys``; unknown and null ones do nothing.  Returns the new version."""
        v = self.version()
        return self._layer(v, keys.select(v["key"]).where(F.col(v["key"]).isNotNull()).distinct(), gone=True)

    def changes(self, old: int, new: int) -> DataFrame:
        """:func:`catalog_changes` between two versions, over the keys of those layers that only one of them has.

        A layer of both holds no change.  After a merge that is the whole base, compared bucket by bucket.
        """
        a, b = self.version(old), self.version(new)
        key = a["key"]
        own = [self._table(v, x).select(key) for v, other in ((a, b), (b, a)) for x in v["layers"] if x not in other["layers"]]
        if not own:
            own = [self._table(a, a["layers"][0]).select(key).limit(0)]
        touched = reduce(DataFrame.unionByName, own).distinct()
        return catalog_changes(*[self._entries(v).join(touched, key, "left_semi") for v in (a, b)], key=key)

    def merge(self) -> int:
        """All layers as one new base without the marks of removed keys; the entries are the same.  Returns the version."""
        v = self.version()
        conf, auto = self.spark.conf, "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        was = conf.get(auto)
        conf.set(auto, "false")  # every task reads its bucket of all layers, so it also writes one
        try:
            layer = self._write(self._merged(v).where(~F.col(_GONE)), v["buckets"], v["key"])
        finally:
            conf.set(auto, was)
        return self._commit(v["version"] + 1, [layer], v["buckets"], v["key"], v["columns"])

    def expire(self, before: int) -> None:
        """Drop the versions below ``before`` (not the newest) and the layers that no other version has."""
        commits = self.spark.read.schema(_COMMIT_SCHEMA).option("recursiveFileLookup", "true").json(f"{self.root}/{_COMMITS}")
        before = min(before, self.version()["version"])
        rows = commits.select("version", "layers").collect()  # one short record per version
        kept = {x for r in rows if r["version"] >= before for x in r["layers"]}
        for r in rows:
            if r["version"] < before:
                delete_path(self.spark, f"{self.root}/{_COMMITS}/{r['version']:012d}")
        for layer in sorted({x for r in rows for x in r["layers"]} - kept):
            self._forget(layer)
            delete_path(self.spark, f"{self.root}/{layer}")

    def close(self) -> None:
        """Forget the session's tables; the folders stay."""
        for layer in list(self._tables):
            self._forget(layer)

    def _forget(self, layer: str) -> None:
        table = self._tables.pop(layer, None)
        if table:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _columns(self, v: Row) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in T.StructType.fromJson(json.loads(v["columns"])).fields}

    def _commit(self, version: int, layers: list[str], buckets: int, key: str, columns: str) -> int:
        record = self.spark.createDataFrame([(version, layers, buckets, key, columns)], _COMMIT_SCHEMA)
        record.coalesce(1).write.mode("errorifexists").json(f"{self.root}/{_COMMITS}/{version:012d}")
        return version

    def _write(self, rows: DataFrame, buckets: int, key: str) -> str:
        """A new layer's name: one sorted file per bucket and task; ``rows`` come dealt out by key."""
        layer = f"layer_{uuid.uuid4().hex}"
        (rows.write.format("parquet").bucketBy(buckets, key).sortBy(key)
             .option("path", f"{self.root}/{layer}").saveAsTable(f"gridweave_{layer}"))
        self._tables[layer] = f"gridweave_{layer}"
        return layer

    def _table(self, v: Row, layer: str) -> DataFrame:
        if layer not in self._tables:
            name = f"gridweave_{layer}"
            columns = ", ".join(f"{_quoted(c)} {t.simpleString()}" for c, t in self._columns(v).items())
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({_quoted(v['key'])}) "
                           f"SORTED BY ({_quoted(v['key'])}) INTO {v['buckets']} BUCKETS LOCATION '{self.root}/{layer}'")
            self._tables[layer] = name
        return self.spark.table(self._tables[layer])

    def _merged(self, v: Row) -> DataFrame:
        """The newest row of every key, marks of removed keys included."""
        layers = [self._table(v, x) for x in v["layers"]]
        out = layers[0]
        for newer in layers[1:]:
            out = out.join(newer.select(v["key"]), v["key"], "left_anti").unionByName(newer)
        return out

    def _entries(self, v: Row) -> DataFrame:
        return self._merged(v).where(~F.col(_GONE)).drop(_GONE)

    def _layer(self, v: Row, rows: DataFrame, gone: bool = False) -> int:
        if len(v["layers"]) >= MERGE_AT:
            self.merge()
            v = self.version()
        columns = [(F.lit(gone) if c == _GONE else F.col(c) if c == v["key"] or not gone else F.lit(None)).cast(t).alias(c)
                   for c, t in self._columns(v).items()]
        layer = self._write(rows.select(*columns).repartition(v["buckets"], v["key"]), v["buckets"], v["key"])
        return self._commit(v["version"] + 1, [*v["layers"], layer], v["buckets"], v["key"], v["columns"])


def bucket_count(rows: int) -> int:
    """Buckets for a catalog of so many rows."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
