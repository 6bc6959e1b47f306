"""The bitmap index: postings over the rows of a table, kept as immutable generations beside a manifest.

A query pins one generation and always answers as a scan of the table would. It may take the native route, a plain
filter that Catalyst plans, or the bitmap route, over the postings. Rows appended since the last compaction are
pending: they are scanned beside the postings. Deleted rows are tombstones until a compaction rewrites the table.
One writer at a time; a second one fails when it commits, and its files are never read.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import ORDINAL_BIT, check_key, plain_key, row_id
from ..plans.parse import parse
from ..plans.predicates import And
from ..sources.storage import Store
from . import bitmaps, postings

FORMAT = 1
#: Pending rows at which a compaction is due: default, least and most.
THRESHOLD, LEAST_THRESHOLD, MOST_THRESHOLD = 10_000, 1_000, 10_000_000
#: Most files of which the ordinals are broadcast.
BROADCAST_FILES = 100_000


class IndexCorrupt(RuntimeError):
    """The stored index contradicts itself or its table."""


class IndexFormat(RuntimeError):
    """The index was written in a format that this code doesn't read: build it anew."""


@dataclass(frozen=True)
class IndexSpec:
    """Key columns, and the columns that a covering projection holds besides."""

    keys: tuple[str, ...]
    include: tuple[str, ...] = ()

    def __init__(self, keys, include=()):
        object.__setattr__(self, "keys", tuple(keys))
        object.__setattr__(self, "include", tuple(include))
        if not self.keys or len(set(self.keys)) < len(self.keys):
            raise ValueError("an index needs key columns, each once")


@dataclass
class Answer:
    """A query as it will run: explain() names the route and how many conditions it has."""

    route: str
    quals: int
    why: str
    df: DataFrame = field(repr=False)

    def explain(self) -> str:
        return f"{'BitmapCount' if self.route != 'native' else 'Scan'}: {self.quals} qual(s), route {self.route} ({self.why})"


def _check_threshold(value: int) -> int:
    if not LEAST_THRESHOLD <= value <= MOST_THRESHOLD:
        raise ValueError(f"the pending threshold must be between {LEAST_THRESHOLD} and {MOST_THRESHOLD}, not {value}")
    return value


class BitmapIndex:
    """An index in the folder root. Every method that writes commits a new generation and moves this object to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._lock = threading.RLock()
        self._merging = False
        self.refresh()

    # Generations

    @staticmethod
    def build(spark: SparkSession, table: str | list[str], spec: IndexSpec, root: str, threshold: int = THRESHOLD) -> BitmapIndex:
        """Indexes the Parquet table at a path, or of several (its partitions), into root."""
        store = Store(spark, root)
        paths = [table] if isinstance(table, str) else list(table)
        source = spark.read.parquet(*paths)
        for name in spec.keys:
            check_key(source.schema[name])
        missing = set(spec.include) - set(source.columns)
        if missing:
            raise ValueError(f"no such columns to include: {sorted(missing)}")
        kinds = {k: source.schema[k].dataType.simpleString() for k in spec.keys}
        files = [[i, *f] for i, f in enumerate(_files(spark, paths))]
        if any(n.startswith("manifest-") for n in store.names()):
            raise FileExistsError(f"there is an index in {root}")
        manifest = {
            "format": FORMAT, "generation": 0, "table": paths, "schema": source.schema.json(), "keys": kinds, "include": list(spec.include), "files": files, "pending": [],
            "pending_rows": 0, "tombstones": [], "threshold": _check_threshold(threshold), "next_ordinal": len(files), "dense": [], "postings": None, "rows": 0,
        }
        return BitmapIndex._committed(spark, store, _indexed(spark, store, manifest))

    @staticmethod
    def _committed(spark: SparkSession, store: Store, manifest: dict) -> BitmapIndex:
        store.put_json(_name(manifest["generation"]), manifest)
        return BitmapIndex(spark, store.root)

    def refresh(self) -> None:
        """Moves to the newest generation."""
        names = [n for n in self.store.names() if n.startswith("manifest-")]
        if not names:
            raise FileNotFoundError(f"no index in {self.store.root}")
        self.manifest = self.store.read_json(names[-1])
        if self.manifest["format"] != FORMAT:
            raise IndexFormat(f"format {self.manifest['format']}; this code reads {FORMAT}: build the index anew")
        self.keys: dict[str, str] = self.manifest["keys"]

    def _commit(self, **changes) -> None:
        manifest = self.manifest | changes | {"generation": self.manifest["generation"] + 1}
        self.store.put_json(_name(manifest["generation"]), manifest)
        self.refresh()

    # Rows

    def _read(self, files: list, columns: list[str] | None = None) -> DataFrame:
        """Rows of some files with rid."""
        return _rows(self.spark, self.manifest["schema"], files, columns)

    def postings(self) -> DataFrame:
        if not self.manifest["postings"]:
            return self.spark.createDataFrame([], postings.SCHEMA)
        return self.spark.read.schema(postings.SCHEMA).parquet(self.store.path(self.manifest["postings"]))

    def tombstones(self) -> DataFrame:
        names = self.manifest["tombstones"]
        return self.spark.read.schema("rid long").parquet(*map(self.store.path, names)) if names else self.spark.createDataFrame([], "rid long")

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.tombstones(), "rid", "left_anti") if self.manifest["tombstones"] else rows

    def table(self, rid: bool = False) -> DataFrame:
        """All rows of the current generation, as a scan sees them."""
        if not self.manifest["tombstones"] and not rid:
            return _plain(self.spark, self.manifest["schema"], self.manifest["files"] + self.manifest["pending"])
        rows = self._alive(self._read(self.manifest["files"] + self.manifest["pending"]))
        return rows if rid else rows.drop("rid")

    def fresh(self) -> bool:
        """Whether the files are still those that were indexed."""
        files = self.manifest["files"] + self.manifest["pending"]
        return self.store.fingerprints([path for _, path, *_ in files]) == [(size, changed) for _, _, size, changed in files]

    def _condition(self, predicate: And) -> Column:
        return predicate.condition({f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(self.manifest["schema"]))})

    # Queries

    def where(self, text: str) -> And:
        """The predicate of a WHERE clause."""
        return parse(self.spark, text)

    def route(self, predicate: And, route: str = "auto") -> tuple[str, str]:
        """The route taken and why."""
        if route not in ("auto", "native", "bitmap"):
            raise ValueError(f"no route {route}")
        if route == "native":
            return "native", "asked for"
        if not postings.answerable(self.spark, predicate, self.keys):
            return "native", "a condition can't be answered by the index"
        if not self.fresh():
            return "native", "the files have changed since they were indexed"
        if route == "bitmap":
            return "bitmap", "asked for"
        if len(predicate.parts) == 1 and not self.manifest["tombstones"]:
            return "bitmap", "one condition: stored cardinalities"
        return "native", "a columnar scan is as fast"

    def count(self, predicate: And, route: str = "auto") -> Answer:
        """One row (cnt): how many rows the predicate holds for."""
        taken, why = self.route(predicate, route)
        if taken == "native":
            df = self.table().filter(self._condition(predicate)).agg(F.count(F.lit(1)).alias("cnt"))
        else:
            df = self._indexed_count(predicate)
            if self.manifest["pending"]:
                late = self._alive(self._read(self.manifest["pending"])).filter(self._condition(predicate)).agg(F.count(F.lit(1)).alias("cnt"))
                df = df.unionByName(late).agg(F.sum("cnt").alias("cnt"))
        return Answer(taken, len(predicate.parts), why, df)

    def _indexed_count(self, predicate: And) -> DataFrame:
        if len(predicate.parts) == 1 and not self.manifest["tombstones"]:
            return postings.cardinalities(self.postings(), predicate, self.keys)
        found = postings.lookup(self.postings(), predicate, self.keys)
        if found is None:
            return self.spark.range(1).select(F.lit(0).cast("long").alias("cnt"))
        if self.manifest["tombstones"]:
            return bitmaps.count_difference(found, bitmaps.from_rids(self.tombstones()))
        return bitmaps.count(found)

    def rids(self, predicate: And) -> DataFrame:
        """The ids of the rows that an indexable predicate holds for, pending ones too."""
        if not postings.answerable(self.spark, predicate, self.keys):
            raise ValueError("the index can't answer this predicate")
        found = postings.lookup(self.postings(), predicate, self.keys)
        rids = bitmaps.to_rids(found) if found is not None else self.spark.createDataFrame([], "rid long")
        if self.manifest["pending"]:
            rids = rids.unionByName(self._read(self.manifest["pending"]).filter(self._condition(predicate)).select("rid"))
        return bitmaps.never_broadcast(self._alive(rids))

    def _held(self, predicate: And, columns: list[str]) -> DataFrame:
        """Columns and rid of the rows that an indexable predicate holds for, pending ones too."""
        found, read = postings.lookup(self.postings(), predicate, self.keys), self._read(self.manifest["files"], columns)
        # Each file begins a bucket of its own.
        most = self.manifest["rows"] // bitmaps.BUCKET_BITS + len(self.manifest["files"])
        rows = bitmaps.holding(read, found, most) if found is not None else read.filter("false")
        if self.manifest["pending"]:
            rows = rows.unionByName(self._read(self.manifest["pending"]).filter(self._condition(predicate)).select(*columns, "rid"))
        return self._alive(rows)

    def rows(self, predicate: And, columns: list[str] | None = None, route: str = "auto") -> Answer:
        """The rows, or some of their columns. A column that the predicate pins isn't read on the bitmap route."""
        taken, why = self.route(predicate, "native" if route == "auto" else route)
        columns = columns or list(self.table().columns)
        if taken == "native":
            return Answer(taken, len(predicate.parts), why, self.table().filter(self._condition(predicate)).select(*columns))
        # A float's zero may have either sign, and a literal of another type isn't the value that is stored.
        pinned = {c: v for c, v in predicate.pinned().items() if c in columns and (v is None or (self.keys[c] not in ("float", "double") and plain_key(v, self.keys[c])[0]))}
        kinds = {f.name: f.dataType for f in self.table().schema}
        out = self._held(predicate, [c for c in columns if c not in pinned]).withColumns({c: F.lit(v).cast(kinds[c]) for c, v in pinned.items()})
        return Answer(taken, len(predicate.parts), why, out.select(*columns))

    def index_only(self, predicate: And, columns: list[str]) -> bool:
        """Whether the index and its included columns hold all that a projection needs."""
        return predicate.indexable(self.keys) and set(columns) <= set(predicate.pinned()) | set(self.manifest["include"])

    def sum(self, column: str, predicate: And, route: str = "auto") -> Answer:
        """One row (s, n): the sum of a column over the predicate's rows, and how many values it has. No rows: null, 0."""
        answer = self.rows(predicate, [column], route)
        answer.df = answer.df.agg(F.sum(column).alias("s"), F.count(column).alias("n"))
        return answer

    def count_many(self, probes: DataFrame, column: str) -> DataFrame:
        """For each row of probes (v): v and cnt, how many rows have this value. A changing key is a join."""
        held = self.table().groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
        return probes.join(held, "v", "left").select("v", F.coalesce("cnt", F.lit(0)).alias("cnt"))

    # Changes

    def _stored(self, rows: DataFrame) -> dict:
        """The changes to the manifest that add rows, which are written; they count once it is committed."""
        kept = self.table().schema
        path = self.store.path(f"data/{self.manifest['generation'] + 1:08d}-{uuid.uuid4().hex[:8]}")
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kept]).write.parquet(path)
        files, first = _files(self.spark, [path]), self.manifest["next_ordinal"]
        added = self.spark.read.schema(kept).parquet(path).count()
        pending = self.manifest["pending"] + [[first + i, *f] for i, f in enumerate(files)]
        return {"pending": pending, "pending_rows": self.manifest["pending_rows"] + added, "next_ordinal": first + len(files)}

    def _buried(self, predicate: And) -> dict:
        """The changes to the manifest that take the predicate's rows away."""
        name = f"tombstones/{self.manifest['generation'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        self.table(rid=True).filter(self._condition(predicate)).select("rid").write.parquet(self.store.path(name))
        return {"tombstones": [*self.manifest["tombstones"], name]}

    def append(self, rows: DataFrame, stream: str | None = None, batch: int = -1) -> None:
        """Adds rows; they are pending until a compaction, which is run at once if twice the threshold is passed.

        A batch of a stream is committed together with its number; one that is there already adds nothing.
        """
        with self._lock:
            seen = self.manifest.get("streams", {})
            if stream is not None and batch <= seen.get(stream, -1):
                return
            changes = self._stored(rows) | ({"streams": seen | {stream: batch}} if stream is not None else {})
            self._commit(**changes)
            if self.manifest["pending_rows"] >= 2 * self.manifest["threshold"]:
                self.compact()

    def delete(self, predicate: And) -> None:
        """Takes rows away. They are tombstones until the next compaction."""
        with self._lock:
            self._commit(**self._buried(predicate))

    def update(self, predicate: And, values: dict) -> None:
        """Sets columns (name -> Column) in the rows of a predicate: in one generation these rows go, and come again changed."""
        with self._lock:
            changed = self.table().filter(self._condition(predicate)).withColumns(values)
            self._commit(**self._stored(changed), **self._buried(predicate))

    def compact(self) -> None:
        """Puts pending rows into the postings; if rows were deleted, writes the table and the postings anew."""
        with self._lock:
            if self.manifest["tombstones"]:
                name = f"data/{self.manifest['generation'] + 1:08d}"
                self.table().write.parquet(self.store.path(name))
                first = self.manifest["next_ordinal"]
                files = [[first + i, *f] for i, f in enumerate(_files(self.spark, [self.store.path(name)]))]
                changes = {"files": files, "pending": [], "pending_rows": 0, "tombstones": [], "next_ordinal": first + len(files)}
                done = _indexed(self.spark, self.store, self.manifest | changes | {"generation": self.manifest["generation"] + 1})
                self._commit(**{k: done[k] for k in (*changes, "dense", "postings", "rows")})
            elif self.manifest["pending"]:
                name = f"postings/{self.manifest['generation'] + 1:08d}"
                late = self._read(self.manifest["pending"], list(self.keys))
                new = postings.build(late, self.keys, self.manifest["dense"])
                postings.in_order(postings.merge(self.postings(), new)).write.parquet(self.store.path(name))
                changes = {"files": self.manifest["files"] + self.manifest["pending"], "pending": [], "pending_rows": 0}
                self._commit(postings=name, rows=self.manifest["rows"] + self.manifest["pending_rows"], **changes)

    def compact_if_due(self) -> threading.Thread | None:
        """Compacts in the background if the threshold is passed and no compaction runs."""
        with self._lock:
            if self._merging or self.manifest["pending_rows"] < self.manifest["threshold"]:
                return None
            self._merging = True
        thread = threading.Thread(target=self._compact_once, daemon=True)
        thread.start()
        return thread

    def _compact_once(self) -> None:
        try:
            self.compact()
        finally:
            self._merging = False

    def reindex(self) -> None:
        """Builds the postings of all rows anew; nothing counts twice."""
        with self._lock:
            files = self.manifest["files"] + self.manifest["pending"]
            done = _indexed(self.spark, self.store, self.manifest | {"files": files, "generation": self.manifest["generation"] + 1})
            self._commit(files=files, pending=[], pending_rows=0, **{k: done[k] for k in ("dense", "postings", "rows")})

    def set_threshold(self, rows: int) -> None:
        self._commit(threshold=_check_threshold(rows))

    def vacuum(self) -> None:
        """Removes what no generation from the current one on reads."""
        with self._lock:
            m = self.manifest
            # Files are named with their scheme, however the root is spelt: a folder's own name tells it.
            used = {m["postings"], *m["tombstones"], *("data/" + path.rsplit("/", 2)[-2] for _, path, *_ in m["files"] + m["pending"])}
            for name in self.store.names():
                if name.startswith(".") or (name.startswith("manifest-") and name < _name(m["generation"])):
                    self.store.delete(name)
            for kind in ("postings", "tombstones", "data"):
                for name in Store(self.spark, self.store.path(kind)).names():
                    if f"{kind}/{name}" not in used:
                        self.store.delete(f"{kind}/{name}")

    # What there is to see

    def stats(self) -> DataFrame:
        """One row: entries (values of all key columns), pending rows and threshold, whether a merge runs, format and sizes."""
        m = self.manifest
        entries = self.postings().filter("NOT is_null").select("attno", "key").distinct().count()
        row = (entries, m["pending_rows"], m["threshold"], self._merging, m["format"], m["generation"], m["rows"], len(m["files"]), len(m["pending"]), len(m["tombstones"]))
        return self.spark.createDataFrame(
            [row],
            "total_entries long, pending_count long, pending_threshold int, bg_merge_running boolean, index_version int, generation long, indexed_rows long, base_files long, pending_files long, tombstone_sets long",
        )

    def health(self) -> DataFrame:
        """One row (health). The texts are fixed values."""
        running, behind = F.col("bg_merge_running"), F.col("pending_count") >= F.col("pending_threshold")
        text = F.when(~running & behind, "merge overdue").when(running & behind, "merge running (behind)").when(running, "merge in progress").when(F.col("pending_count") > 0, "pending inserts").otherwise("ok")
        return self.stats().select(text.alias("health"))

    def histogram(self, column: str) -> DataFrame:
        """(k, card) of one key column, from the stored cardinalities; of the rows that are in the postings."""
        at = list(self.keys).index(column) + 1
        return self.postings().filter((F.col("attno") == at) & ~F.col("is_null")).groupBy(F.col("key").alias("k")).agg(F.sum("card").alias("card"))

    def check(self, heap_all_indexed: bool = False) -> DataFrame:
        """(name, ok): whether the index agrees with itself and, if asked, with a rebuild from its rows."""
        p, m = self.postings(), self.manifest
        names = ["attno", "is_null", "key", "bucket"]
        top = max([o for o, *_ in m["files"]], default=0)
        own = F.when(F.col("bm").isNotNull(), F.bitmap_count("bm")).otherwise(F.size("pos").cast("long"))
        one = p.agg(
            F.coalesce(F.bool_and((own == F.col("card")) & (F.col("card") > 0)), F.lit(True)).alias("cardinality"),
            F.coalesce(F.bool_and((F.col("bucket") >= 1) & (F.col("bucket") <= ((top + 1) << ORDINAL_BIT) // bitmaps.BUCKET_BITS + 1)), F.lit(True)).alias("bucket range"),
            F.coalesce(F.bool_and(F.col("bm").isNull() != F.col("pos").isNull()), F.lit(True)).alias("one form"),
            F.coalesce(F.bool_and(F.col("is_null") == F.col("key").isNull()), F.lit(True)).alias("null flag"),
        ).first()
        found = {k: bool(v) for k, v in one.asDict().items()}
        found["format"] = m["format"] == FORMAT
        found["files"] = self.fresh()
        found["unique"] = p.groupBy(*names).count().filter("count > 1").isEmpty()
        totals = {r["attno"]: r["n"] for r in p.groupBy("attno").agg(F.sum("card").alias("n")).collect()}  # a row a key column
        found["every row once"] = all(totals.get(i, 0) == m["rows"] for i in range(1, len(self.keys) + 1))
        if heap_all_indexed:
            again = postings.build(self._read(m["files"], list(self.keys)), self.keys, m["dense"])
            mine, fresh = (x.select(*names, "card", F.hex("bm").alias("bm"), "pos") for x in (p, again))
            found["all rows indexed"] = mine.exceptAll(fresh).isEmpty() and fresh.exceptAll(mine).isEmpty()
        return self.spark.createDataFrame(sorted(found.items()), "name string, ok boolean")

    def assert_sound(self, heap_all_indexed: bool = False) -> None:
        bad = [r["name"] for r in self.check(heap_all_indexed).filter("NOT ok").collect()]
        if bad:
            raise IndexCorrupt(f"corruption detected: {', '.join(bad)}")


def _name(generation: int) -> str:
    return f"manifest-{generation:08d}.json"


def _files(spark: SparkSession, paths: list[str]) -> list[list]:
    """Path, size and time of change of the Parquet files under these paths, in order; files without rows have none."""
    listed = sorted(spark.read.parquet(*paths).inputFiles())
    store = Store(spark, paths[0])
    return [[f, *seen] for f, seen in zip(listed, store.fingerprints(listed))]


def _plain(spark: SparkSession, schema: str, files: list) -> DataFrame:
    kind = StructType.fromJson(json.loads(schema))
    return spark.read.schema(kind).parquet(*[f for _, f, *_ in files]) if files else spark.createDataFrame([], kind)


def _rows(spark: SparkSession, schema: str, files: list, columns: list[str] | None = None) -> DataFrame:
    """Rows with rid: the file's ordinal and the place in the file."""
    plain = _plain(spark, schema, files)
    columns = list(plain.columns) if columns is None else columns
    if not files:
        return plain.select(*columns, F.lit(None).cast("long").alias("rid"))
    ordinals = spark.createDataFrame([(f, o) for o, f, *_ in files], "_file string, _ordinal long")
    ordinals = F.broadcast(ordinals) if len(files) <= BROADCAST_FILES else ordinals
    rows = plain.select(*columns, _one_slash(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.row_index").alias("_index"))
    if len(files) == 1:
        return rows.select(*columns, row_id(F.lit(files[0][0]), F.col("_index")).alias("rid"))
    return rows.join(ordinals, F.col("_path") == _one_slash(F.col("_file"))).select(*columns, row_id(F.col("_ordinal"), F.col("_index")).alias("rid"))


def _one_slash(path: Column) -> Column:
    """A path in one spelling: stores name the same file with one slash or three after the scheme."""
    return F.regexp_replace(path, r"^([A-Za-z0-9+.\-]+):/+", "$1:/")


def _indexed(spark: SparkSession, store: Store, manifest: dict) -> dict:
    """The manifest with postings of all its files, written."""
    rows = _rows(spark, manifest["schema"], manifest["files"], list(manifest["keys"]))
    dense = postings.dense_columns(rows, manifest["keys"])
    name = f"postings/{manifest['generation']:08d}"
    postings.in_order(postings.build(rows, manifest["keys"], dense)).write.parquet(store.path(name))
    return manifest | {"dense": dense, "postings": name, "rows": rows.count()}


def list_indexes(spark: SparkSession, root: str) -> DataFrame:
    """The indexes in the folders of root: name and stats of each."""
    found = None
    for name in Store(spark, root).names():
        if any(n.startswith("manifest-") for n in Store(spark, f"{root}/{name}").names()):
            row = BitmapIndex(spark, f"{root}/{name}").stats().select(F.lit(name).alias("name"), "*")
            found = row if found is None else found.unionByName(row)
    return found if found is not None else spark.createDataFrame([], "name string")
