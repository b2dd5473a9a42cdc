"""Tables that are changed by key: versions of Parquet buckets behind manifests, one writer winning each version.

Rows lie in buckets by the hash of their key. A version is a manifest that says which write holds each bucket, so a merge reads and writes only the
buckets that its keys fall into, and every version stays readable until it is dropped. A manifest is published by creating its file, which
exists or not: of several writers of one version one succeeds. The others look at what has changed since the version that they read; if that is none of
the buckets that they read or wrote, their work stands and is published on top, else it is done again. Claims of jobs, appends and merges are all made so.

Uniqueness of a column, among rows that a condition selects, is kept by an index: (value, key) in buckets by the hash of the value, and beside each
bucket a Bloom filter of its values. A change asks the filters of the buckets its new values fall into, reads those buckets that may hold one, and
compares exactly. As the index is published with the rows, two writers of one value have one bucket in common, and one of them sees the other's row.

What goes to the driver is a number for each bucket; tables have a bucket for each ROWS rows. Data are read and written by Spark alone,
manifests by Hadoop's file interface.
"""

from __future__ import annotations

import json
import os
import random
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket as a table is made, and the least number of buckets; bits and hashes of a Bloom filter for each value.
ROWS, LEAST, BITS, HASHES = 1 << 20, 16, 12, 6
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """The version was published by another writer."""


class NotUnique(ValueError):
    """Rows that would break a table's uniqueness; some of the values."""


@dataclass(frozen=True)
class Unique:
    """At most one row that the condition selects has a value of the column; blank and null values are no values."""

    column: str
    where: str = "true"


@dataclass(frozen=True)
class Manifest:
    """buckets: the write that holds each, or none where it has no rows; rows: how many each has; indexes: the same for each unique column; applied: the last batch of each stream."""

    version: int
    key: str
    schema: str
    buckets: tuple[str | None, ...]
    rows: tuple[int, ...]
    unique: tuple[Unique, ...] = ()
    indexes: dict[str, tuple[str | None, ...]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"unique": [u.__dict__ for u in self.unique]})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["key"], d["schema"], tuple(d["buckets"]), tuple(d["rows"]), tuple(Unique(**u) for u in d["unique"]), {k: tuple(v) for k, v in d["indexes"].items()}, d["applied"])


@dataclass
class Work:
    """What a change read and wrote: bucket to write id, by the table (name "") or by index."""

    written: dict[str, dict[int, str | None]]
    rows: dict[int, int]
    read: dict[str, set[int]]
    result: object = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="papertide-")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


class _Files:
    """A folder of small files, wherever it is."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder, self.path = folder, self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(self.conf)
        self.fs.mkdirs(self.path(folder))
        uri = self.fs.makeQualified(self.path(folder)).toUri()
        self.local = uri.getPath() if uri.getScheme() == "file" else None

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(self.folder)))

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.folder}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """The whole file at once; Conflict if there is one of that name."""
        draft = f".{uuid.uuid4().hex}"
        if self.local:  # a link is made or not, while a rename would replace the file
            with open(f"{self.local}/{draft}", "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(f"{self.local}/{draft}", f"{self.local}/{name}")
            except FileExistsError as e:
                raise Conflict(name) from e
            finally:
                os.unlink(f"{self.local}/{draft}")
            return
        stream = self.fs.create(self.path(f"{self.folder}/{draft}"), False)
        stream.write(text.encode())
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        none[0] = options.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.path(f"{self.folder}/{draft}"), self.path(f"{self.folder}/{name}"), none)
        except Exception as e:
            self.fs.delete(self.path(f"{self.folder}/{draft}"), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _in_bucket(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def bloom(values: DataFrame) -> DataFrame:
    """values(__bucket, value) as a filter for each bucket: __bucket, size in bits, words, each 64 of them."""
    sizes = values.groupBy(_BUCKET).agg((F.ceil(F.count("*") * BITS / 64) * 64).alias("size"))
    bit = F.explode(F.array(*[F.pmod(F.xxhash64("value", F.lit(i)), F.col("size")) for i in range(HASHES)])).alias("bit")
    bits = values.join(sizes, _BUCKET).select(_BUCKET, "size", bit)
    word = bits.groupBy(_BUCKET, "size", F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
    return word.groupBy(_BUCKET, "size").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("words"))


def may_hold(value: str, size: str = "size", words: str = "words") -> Column:
    """False only for values that a filter certainly doesn't hold."""
    tests = [F.expr(f"coalesce(try_element_at({words}, pmod(xxhash64({value}, {i}), {size}) div 64), 0L) & shiftleft(1L, cast(pmod(xxhash64({value}, {i}), {size}) % 64 as int)) != 0") for i in range(HASHES)]
    found = tests[0]
    for t in tests[1:]:
        found = found & t
    return found


def _fields(m: Manifest) -> dict[str, T.DataType]:
    return {x.name: x.dataType for x in T.StructType.fromJson(json.loads(m.schema))}


def _typed(m: Manifest, rows: DataFrame) -> DataFrame:
    return rows.select([F.col(f"`{c}`").cast(kind).alias(c) for c, kind in _fields(m).items()])


class KeyedTable:
    """A table in a folder. Its methods may be called from several drivers at once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark, f"{self.path}/versions")

    # -- versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int | None = None, unique: tuple[Unique, ...] = ()) -> KeyedTable:
        """rows as version 0: one for each key, and none without a key. Raises NotUnique."""
        table = cls(spark, path)
        if buckets is None:
            buckets = max(LEAST, -(-rows.count() // ROWS))
        none: tuple[None, ...] = (None,) * buckets
        empty = Manifest(-1, key, rows.schema.json(), none, (0,) * buckets, unique, {u.column: none for u in unique})
        table._publish(empty, table._replaced(empty, None, rows))
        return table

    def versions(self) -> list[int]:
        return [int(x[:-5]) for x in self.files.names() if x.endswith(".json") and x[0] != "."]

    def manifest(self, version: int | None = None) -> Manifest:
        return Manifest.of(self.files.text(f"{self.versions()[-1] if version is None else version:012d}.json"))

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version; with keys (a column named as the key), only of the buckets that may hold those."""
        m = self.manifest(version)
        return self._rows(m, None if keys is None else self._buckets_of(m, keys.select(m.key)))

    def changed_files(self, old: int, new: int) -> float:
        """The share of buckets that differ between two versions."""
        a, b = self.manifest(old).buckets, self.manifest(new).buckets
        return sum(x != y for x, y in zip(a, b, strict=True)) / len(a)

    def drop_versions(self, keep: int) -> int:
        """Removes manifests but the newest ones, and the writes that no manifest left names; how many writes went. Not beside writers."""
        kept = self.versions()[-max(keep, 1) :]
        for v in self.versions():
            if v not in kept:
                self.files.drop(f"{self.path}/versions/{v:012d}.json")
        manifests = [self.manifest(v) for v in kept]
        gone = 0
        for folder, live in [("data", {w for m in manifests for w in m.buckets})] + [(f"index/{i}", {w for m in manifests for w in m.indexes[u.column]}) for i, u in enumerate(manifests[-1].unique)]:
            for name in _Files(self.spark, f"{self.path}/{folder}").names():
                if name not in live:
                    self.files.drop(f"{self.path}/{folder}/{name}")
                    gone += 1
        return gone

    def breaches(self, version: int | None = None) -> DataFrame:
        """bucket, stated, counted: where a version doesn't hold as many rows as its manifest states."""
        m = self.manifest(version)
        stated = self.spark.createDataFrame(list(enumerate(m.rows)), "bucket int, stated long")
        counted = self._rows(m, None).groupBy(_in_bucket(F.col(f"`{m.key}`"), len(m.buckets)).alias("bucket")).agg(F.count("*").alias("counted"))
        return stated.join(counted, "bucket", "left").withColumn("counted", F.coalesce("counted", F.lit(0))).where("stated <> counted")

    def copied(self, path: str, version: int | None = None) -> KeyedTable:
        """A backup: one version as version 0 of another table; ValueError if it doesn't hold what the manifest states."""
        m = self.manifest(version)
        table = KeyedTable.create(self.spark, path, self._rows(m, None), m.key, len(m.buckets), m.unique)
        if table.manifest().rows != m.rows or not table.breaches().isEmpty():
            raise ValueError(f"the copy of version {m.version} in {path} differs")
        return table

    # -- changes

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """how(current rows, changes) for the buckets of changes; the version. batch: the name and number of a stream's batch, which is applied once. Raises NotUnique."""

        def work(m: Manifest) -> Work | None:
            if batch and m.applied.get(batch[0], -1) >= batch[1]:
                return None
            touched = self._buckets_of(m, changes.select(m.key))
            return self._replaced(m, touched, how(self._rows(m, touched), changes))

        return self._change(work, dict([batch]) if batch else {}).version

    def append(self, rows: DataFrame) -> DataFrame:
        """New rows, less those whose key or unique value a row of the table has, or a new one with a smaller key, refused or not: the refused ones."""

        def work(m: Manifest) -> Work:
            new = self._new(m, rows)
            key = F.col(f"`{m.key}`")
            touched = self._buckets_of(m, new.select(m.key))
            old = self._rows(m, touched)
            refused = new.join(old.select(m.key), m.key, "left_semi").select(m.key)
            asked = {}
            for u in m.unique:
                pairs = self._pairs(m, u, new)
                first = pairs.groupBy("value").agg(F.min("key").alias("first"))
                refused = refused.unionAll(pairs.join(first, "value").where("key <> first").select(F.col("key").alias(m.key)))
                held, asked[u.column] = self._held(m, u, pairs)
                refused = refused.unionAll(pairs.join(held.select("value").distinct(), "value", "left_semi").select(F.col("key").alias(m.key)))
            refused = new.join(refused.distinct(), m.key, "left_semi")
            accepted = new.join(refused.select(m.key), m.key, "left_anti")
            done = self._replaced(m, touched, old.unionByName(accepted.select(old.columns)), known=True)
            for name, buckets in asked.items():
                done.read.setdefault(name, set()).update(buckets)
            done.result = rows.where(key.isNull()).unionAll(refused.select(rows.columns))
            return done

        return self._change(work, {}, result=True)

    def update_first(self, choose: Callable[[DataFrame], DataFrame], how: Callable[[DataFrame], DataFrame]) -> list[T.Row]:
        """how(choose(rows)): few rows, which choose takes from all of a version, changed; as they are after it. No two writers change one row from the same version."""

        def work(m: Manifest) -> Work:
            chosen = how(choose(self._rows(m, None))).collect()
            if not chosen:
                return Work({}, {}, {}, [])
            few = self.spark.createDataFrame(chosen, T.StructType.fromJson(json.loads(m.schema)))
            touched = self._buckets_of(m, few.select(m.key))
            rest = self._rows(m, touched).join(F.broadcast(few.select(m.key)), m.key, "left_anti")
            done = self._replaced(m, touched, rest.select(few.columns).unionAll(few))
            done.result = chosen
            return done

        return self._change(work, {}, result=True)

    # -- how

    def _change(self, work: Callable[[Manifest], Work | None], applied: dict[str, int], result: bool = False):
        m = self.manifest()
        done = work(m)
        while True:
            if done is None or not done.written:
                return done.result if result and done else m
            try:
                new = self._publish(m, done, applied)
                return done.result if result else new
            except Conflict:
                time.sleep(random.random() * 0.05)
                newer = self.manifest()
                buckets = lambda x, name: x.indexes[name] if name else x.buckets
                met = any(buckets(m, name)[b] != buckets(newer, name)[b] for name, bs in done.read.items() for b in bs)
                m = newer
                if met or any(newer.applied.get(k, -1) >= n for k, n in applied.items()):
                    done = work(m)

    def _publish(self, m: Manifest, done: Work, applied: dict[str, int] | None = None) -> Manifest:
        put = lambda old, new: tuple(new.get(b, w) for b, w in enumerate(old))
        indexes = {name: put(old, done.written.get(name, {})) for name, old in m.indexes.items()}
        new = replace(m, version=m.version + 1, buckets=put(m.buckets, done.written.get("", {})), rows=put(m.rows, done.rows), indexes=indexes, applied=m.applied | (applied or {}))
        self.files.create(f"{new.version:012d}.json", new.text())
        return new

    def _buckets_of(self, m: Manifest, keys: DataFrame) -> set[int]:
        key = F.col(f"`{m.key}`").cast(_fields(m)[m.key])  # a hash depends on the type
        return {r[0] for r in keys.where(key.isNotNull()).select(_in_bucket(key, len(m.buckets))).distinct().collect()}

    def _from(self, folder: str, buckets: tuple[str | None, ...], wanted: set[int] | None, schema: T.StructType) -> DataFrame:
        """The rows of the buckets wanted, from the writes that hold them."""
        of_write: dict[str, set[int]] = {}
        for b, w in enumerate(buckets):
            if w is not None and (wanted is None or b in wanted):
                of_write.setdefault(w, set()).add(b)
        paths = [f"{folder}/{w}/{_BUCKET}={b}" for w, bs in sorted(of_write.items()) for b in sorted(bs)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, m: Manifest, wanted: set[int] | None) -> DataFrame:
        return self._from(f"{self.path}/data", m.buckets, wanted, T.StructType.fromJson(json.loads(m.schema)))

    def _new(self, m: Manifest, rows: DataFrame) -> DataFrame:
        """rows with a key, one for each, in the table's columns."""
        return _typed(m, rows).where(F.col(f"`{m.key}`").isNotNull()).dropDuplicates([m.key])

    def _write(self, folder: str, rows: DataFrame) -> tuple[str, dict[int, int]]:
        """rows with __bucket, a file for each bucket; the write and each bucket's rows."""
        name = uuid.uuid4().hex
        out = f"{folder}/{name}"
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(out)
        try:
            written = self.spark.read.parquet(out).groupBy(_BUCKET).count().collect()
        except Exception as e:  # nothing was written
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            written = []
        return name, {r[0]: r[1] for r in written}

    def _replaced(self, m: Manifest, touched: set[int] | None, rows: DataFrame, known: bool = False) -> Work:
        """The buckets touched (all, if none are named) with these rows instead. known: uniqueness was looked after."""
        n = len(m.buckets)
        touched = set(range(n)) if touched is None else touched
        key, rows = F.col(f"`{m.key}`"), _typed(m, rows)
        name, counts = self._write(f"{self.path}/data", rows.where(key.isNotNull()).withColumn(_BUCKET, _in_bucket(key, n)))
        if strange := set(counts) - touched:
            raise ValueError(f"rows of other buckets than those of the changes: {sorted(strange)[:5]}")
        done = Work({"": {b: name if b in counts else None for b in touched}}, {b: counts.get(b, 0) for b in touched}, {"": set(touched)})
        after = self._from(f"{self.path}/data", tuple(done.written[""].get(b) for b in range(n)), touched, rows.schema)
        if not known and (twice := after.groupBy(key).count().where("count > 1").limit(3).collect()):
            raise NotUnique(f"{m.key}: {[r[0] for r in twice]}")
        for i, u in enumerate(m.unique):
            self._reindex(m, i, u, self._rows(m, touched), after, done, known)
        return done

    # -- uniqueness

    def _pairs(self, m: Manifest, u: Unique, rows: DataFrame) -> DataFrame:
        value = F.col(f"`{u.column}`").cast("string")
        return rows.where(u.where).where(F.coalesce(value, F.lit("")) != "").select(value.alias("value"), F.col(f"`{m.key}`").alias("key"))

    def _index_schema(self, m: Manifest) -> T.StructType:
        return T.StructType([T.StructField("value", T.StringType()), T.StructField("key", _fields(m)[m.key])])

    def _held(self, m: Manifest, u: Unique, pairs: DataFrame) -> tuple[DataFrame, set[int]]:
        """What the index has of the values of pairs: (value, key); and the buckets that had to be asked."""
        i, buckets = m.unique.index(u), m.indexes[u.column]
        folder = f"{self.path}/index/{i}"
        asked = pairs.select(_in_bucket(F.col("value"), len(buckets)).alias(_BUCKET), "value").distinct()
        into = {r[0] for r in asked.select(_BUCKET).distinct().collect()}
        live = {b: w for b in into if (w := buckets[b]) is not None}
        if not live:
            return self.spark.createDataFrame([], self._index_schema(m)), into
        filters = self.spark.read.parquet(*[f"{folder}/{w}/filters/{_BUCKET}={b}" for b, w in sorted(live.items())])
        here = self.spark.createDataFrame([(b,) for b in live], f"{_BUCKET} int")
        maybe = asked.join(here, _BUCKET, "left_semi").join(filters, F.col(_BUCKET) == F.col("bucket")).where(may_hold("value"))
        wanted = {r[0] for r in maybe.select("bucket").distinct().collect()}
        held = self._index(m, u, wanted)
        return held.join(pairs.select("value").distinct(), "value", "left_semi"), into

    def _index(self, m: Manifest, u: Unique, wanted: set[int] | None) -> DataFrame:
        i = m.unique.index(u)
        writes = tuple(None if w is None else f"{w}/rows" for w in m.indexes[u.column])
        return self._from(f"{self.path}/index/{i}", writes, wanted, self._index_schema(m))

    def _reindex(self, m: Manifest, i: int, u: Unique, old: DataFrame, new: DataFrame, done: Work, known: bool) -> None:
        """The index buckets of what a change took or added; NotUnique if an added value is another key's, too."""
        before, after = self._pairs(m, u, old), self._pairs(m, u, new)
        taken, added = before.join(after, ["value", "key"], "left_anti"), after.join(before, ["value", "key"], "left_anti")
        n = len(m.indexes[u.column])
        moved = taken.unionAll(added).select(_in_bucket(F.col("value"), n).alias(_BUCKET))
        touched = {r[0] for r in moved.distinct().collect()}
        if not touched:
            return
        if not known:
            held, _ = self._held(m, u, added)
            of_others = held.join(taken, ["value", "key"], "left_anti").unionAll(added).groupBy("value").agg(F.countDistinct("key").alias("keys")).where("keys > 1")
            if clash := of_others.limit(3).collect():
                raise NotUnique(f"{u.column}: {[r[0] for r in clash]}")
        rows = self._index(m, u, touched).join(taken, ["value", "key"], "left_anti").unionByName(added).withColumn(_BUCKET, _in_bucket(F.col("value"), n))
        name = uuid.uuid4().hex
        folder = f"{self.path}/index/{i}/{name}"
        wrote, counts = self._write(folder, rows)
        self.files.fs.rename(self.files.path(f"{folder}/{wrote}"), self.files.path(f"{folder}/rows"))
        if counts:
            written = self.spark.read.parquet(f"{folder}/rows")
            bloom(written).withColumn("bucket", F.col(_BUCKET)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{folder}/filters")
        done.written[u.column] = {b: name if b in counts else None for b in touched}
        done.read.setdefault(u.column, set()).update(touched)
