"""A database of schemaless collections: a folder of immutable Parquet files and numbered catalogs.

A collection is a snapshot and some deltas: rows of ``id, doc, seq`` that stand in the place of older ones, a null
document for one that is gone. Single documents are written as deltas, which are merged into a new snapshot when they
become many; queries that change documents write a snapshot. A change ends with a catalog of the next number, which is
never overwritten: a reader takes the newest whole one, so a crash at any point leaves the state before. Files that no
recent catalog names are deleted some changes later, so readers keep what they read.

Writers take turns by a lock file that expires; should one lose it, the number of its catalog is taken and its change fails.
Paths may be of any file system that Spark reaches.
"""

from __future__ import annotations

import itertools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import PathQuery
from ..errors import CollectionExistsError, CollectionNotFoundError, EngineError, IndexMismatchError, InvalidNameError, NotFoundError, PatchError, ReadOnlyError, UniqueViolationError
from ..functions.patch import apply_patch
from ..operators.documents import changed_documents, dump, load, projected, query_documents
from ..operators.explain import explain
from ..plans.variant import found

SCHEMA = "id long, doc string"
DELTA = "id long, doc string, seq long"
#: Deltas of a collection at most.
DELTAS = 8
#: Catalogs that stay, and so the changes during which a reader keeps its files.
KEPT = 5
#: Seconds after which a writer's lock is taken as left behind, and for which one waits for it.
LEASE, WAIT = 600.0, 60.0
INDEX_TYPES = ("string", "integer", "float")


class Files:
    """The few file operations that a catalog needs, on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, place: str):
        path = self.jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.conf)

    def exists(self, place: str) -> bool:
        path, fs = self.at(place)
        return fs.exists(path)

    def read(self, place: str) -> str:
        path, fs = self.at(place)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, place: str, text: str, overwrite: bool = True) -> None:
        path, fs = self.at(place)
        stream = fs.create(path, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self, place: str) -> list[str]:
        path, fs = self.at(place)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def delete(self, place: str) -> None:
        path, fs = self.at(place)
        fs.delete(path, True)

    def copy(self, source: str, target: str) -> None:
        path, fs = self.at(source)
        to, there = self.at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, there, to, False, self.conf)

    def make(self, place: str) -> None:
        path, fs = self.at(place)
        fs.mkdirs(path)


class Database:
    """Collections of JSON documents by integer id.

    ``mode``: ``r`` reads only, ``w`` opens or creates, ``truncate`` starts anew.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "w"):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), mode == "r"
        self.files = Files(spark)
        if mode == "truncate":
            self.files.delete(self.root)
        if not self._versions():
            if self.read_only:
                raise NotFoundError(f"no database at {root}")
            self.files.make(self.root)
            self.files.write(self._catalog(1), json.dumps({"version": 1, "next": 1, "collections": {}, "old": []}))

    # catalog

    def _catalog(self, version: int) -> str:
        return f"{self.root}/catalog-{version:012d}.json"

    def _versions(self) -> list[int]:
        """Numbers of the catalogs, the newest first."""
        return sorted((int(m[1]) for m in (re.fullmatch(r"catalog-([0-9]+)\.json", n) for n in self.files.names(self.root)) if m), reverse=True)

    def catalog(self) -> dict:
        """The newest catalog that is whole: one that is just being written can't be read yet."""
        for version in self._versions():
            try:
                return json.loads(self.files.read(self._catalog(version)))
            except ValueError:
                continue
        raise NotFoundError(f"no catalog in {self.root}")

    @contextmanager
    def change(self) -> Iterator[dict]:
        """The catalog for one writer: saved at the end, unless the change failed."""
        if self.read_only:
            raise ReadOnlyError("the database is open for reading")
        lock, owner = f"{self.root}/writer.lock", uuid.uuid4().hex
        end = time.time() + WAIT
        while True:
            try:
                self.files.write(lock, json.dumps({"owner": owner, "until": time.time() + LEASE}), overwrite=False)
                break
            except Exception:
                held = self._holder(lock)
                if held is None:  # not a lock that is taken, but a folder that can't be written
                    raise
                if held["until"] < time.time():
                    self.files.delete(lock)
                elif time.time() > end:
                    raise EngineError("another writer holds the lock") from None
                else:
                    time.sleep(0.1)
        try:
            state = self.catalog()
            yield state
            state["version"] += 1
            gone = [x for x in state["old"] if x["version"] <= state["version"] - KEPT]
            state["old"] = [x for x in state["old"] if x not in gone]
            place = self._catalog(state["version"])
            if self.files.exists(place):
                if self.catalog()["version"] >= state["version"]:
                    raise EngineError("another writer has changed the database meanwhile")
                self.files.delete(place)  # torn, by a writer that is gone
            self.files.write(place, json.dumps(state), overwrite=False)
            for x in gone:
                self.files.delete(x["place"])
            for version in self._versions()[KEPT:]:
                self.files.delete(self._catalog(version))
        finally:
            held = self._holder(lock)
            if held and held["owner"] == owner:
                self.files.delete(lock)

    def _holder(self, lock: str) -> dict | None:
        """Who holds the lock; one that can't be read was just made."""
        if not self.files.exists(lock):
            return None
        try:
            return json.loads(self.files.read(lock))
        except Exception:
            return {"owner": "", "until": time.time() + 1}

    def _entry(self, state: dict, name: str, create: bool = False) -> dict:
        if not re.fullmatch(r"[a-zA-Z0-9_-]{1,255}", name or ""):
            raise InvalidNameError(f"not a collection name: {name!r}")
        if name not in state["collections"]:
            if not create:
                raise CollectionNotFoundError(f"no collection {name!r}")
            state["collections"][name] = {"dbid": state["next"], "snapshot": None, "deltas": [], "seq": 0, "rows": 0, "last_id": 0, "indexes": []}
            state["next"] += 1
        return state["collections"][name]

    def rows(self, name: str, state: dict | None = None) -> DataFrame:
        """The collection's ``id, doc`` rows as they are now; empty if it isn't there."""
        entry = (state or self.catalog())["collections"].get(name)
        if entry is None or not (entry["snapshot"] or entry["deltas"]):
            return self.spark.createDataFrame([], SCHEMA)
        base = self.spark.read.schema(SCHEMA).parquet(entry["snapshot"]) if entry["snapshot"] else self.spark.createDataFrame([], SCHEMA)
        if not entry["deltas"]:
            return base
        last = self.spark.read.schema(DELTA).parquet(*entry["deltas"]).groupBy("id").agg(F.max(F.struct("seq", "doc")).alias("last"))
        return base.join(last.select("id"), "id", "left_anti").union(last.where("last.doc is not null").select("id", "last.doc"))

    def _forget(self, state: dict, *places: str | None) -> None:
        """Files that the next catalog doesn't name; they go when no reader is left with an older one."""
        state["old"] += [{"version": state["version"] + 1, "place": p} for p in places if p]

    def _commit(self, state: dict, name: str, after: DataFrame) -> None:
        """A new snapshot, checked against unique indexes before the catalog knows of it."""
        entry = state["collections"][name]
        place = f"{self.root}/{entry['dbid']}-{uuid.uuid4().hex}"
        after.select("id", "doc").write.parquet(place)
        written = self.spark.read.schema(SCHEMA).parquet(place)
        try:
            for index in entry["indexes"]:
                if index["unique"]:
                    self._check_unique(written, index)
        except UniqueViolationError:
            self.files.delete(place)
            raise
        counted = written.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
        self._forget(state, entry["snapshot"], *entry["deltas"])
        entry |= {"snapshot": place, "deltas": [], "rows": counted.n, "last_id": max(entry["last_id"], counted.last or 0)}

    def _write(self, state: dict, name: str, docs: dict[int, str | None]) -> None:
        """Documents by id (None: gone) as a delta of the collection."""
        entry = state["collections"][name]
        ids = list(docs)
        there = self.rows(name, state).where(F.col("id").isin(ids)).count() if ids else 0
        new = self.spark.createDataFrame(list(docs.items()), SCHEMA)
        place = f"{self.root}/{entry['dbid']}-{uuid.uuid4().hex}"
        entry["seq"] += 1
        new.select("id", "doc", F.lit(entry["seq"]).cast("long").alias("seq")).write.parquet(place)
        entry["deltas"] = [*entry["deltas"], place]
        try:
            for index in entry["indexes"]:
                if index["unique"]:
                    self._check_unique(self.rows(name, state), index, new.where("doc is not null"))
        except UniqueViolationError:
            self.files.delete(place)
            raise
        entry["rows"] += sum(d is not None for d in docs.values()) - there
        entry["last_id"] = max([entry["last_id"], *ids])
        if len(entry["deltas"]) > DELTAS:
            self._commit(state, name, self.rows(name, state))

    @staticmethod
    def _keys(rows: DataFrame, index: dict) -> DataFrame:
        """``k``: values as the index would store them; null, objects and arrays are not indexed."""
        value = F.try_parse_json("doc")
        names = index["path"].strip("/").split("/")
        kind = F.schema_of_variant(found(value, names, "variant"))
        cast = {"string": "string", "integer": "long", "float": "double"}[index["type"]]
        scalar = ~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"))
        return rows.select(found(value, names, cast).alias("k"), scalar.alias("scalar")).where("scalar and k is not null").select("k")

    def _check_unique(self, rows: DataFrame, index: dict, new: DataFrame | None = None) -> None:
        """Raises if a value occurs twice; with ``new`` documents only theirs are looked at."""
        keys = self._keys(rows, index)
        if new is not None:
            keys = keys.join(self._keys(new, index).distinct(), "k", "left_semi")
        if not keys.groupBy("k").count().where("count > 1").isEmpty():
            raise UniqueViolationError(f"{index['path']} is not unique")

    # documents

    def put(self, name: str, value: Any, id: int | None = None) -> int:
        """Inserts with the next id, or replaces the document of an id. Returns the id."""
        return self.put_all(name, [value] if id is None else [(id, value)])[0]

    def put_all(self, name: str, values: list) -> list[int]:
        """One snapshot for many documents: values, or (id, value) pairs."""
        with self.change() as state:
            entry = self._entry(state, name, create=True)
            pairs, last = [], entry["last_id"]
            for v in values:
                i, value = v if isinstance(v, tuple) else (last + 1, v)
                if isinstance(i, bool) or not isinstance(i, int) or i <= 0:
                    raise InvalidNameError(f"not a document id: {i!r}")
                last = max(last, i)
                pairs.append((i, dump(value)))
            self._write(state, name, dict(pairs))
        return [i for i, _ in pairs]

    def load(self, name: str, docs: DataFrame) -> None:
        """Puts all rows of a DataFrame of ``id, doc``, a later one in the place of one that is there."""
        with self.change() as state:
            self._entry(state, name, create=True)
            new = docs.select("id", F.coalesce("doc", F.lit("null")).alias("doc"))
            self._commit(state, name, self.rows(name, state).join(new.select("id"), "id", "left_anti").union(new))

    def get(self, name: str, id: int) -> Any:
        return self._get(self.catalog(), name, id)

    def _get(self, state: dict, name: str, id: int) -> Any:
        self._entry(state, name)
        row = self.rows(name, state).where(F.col("id") == id).first()
        if row is None:
            raise NotFoundError(f"no document {id} in {name!r}")
        return load(row.doc)

    def get_or_none(self, name: str, id: int) -> Any:
        try:
            return self.get(name, id)
        except NotFoundError:
            return None

    def patch(self, name: str, id: int, patch: Any) -> Any:
        """Patches one document and returns it."""
        with self.change() as state:
            value = apply_patch(self._get(state, name, id), patch)
            self._write(state, name, {id: dump(value)})
        return value

    def merge_or_put(self, name: str, id: int, patch: dict) -> Any:
        """Patches a document, or puts the patch as one where there is none."""
        with self.change() as state:
            self._entry(state, name, create=True)
            try:
                value = apply_patch(self._get(state, name, id), patch)
            except NotFoundError:
                if not isinstance(patch, dict):
                    raise PatchError("only an object can be inserted") from None
                value = patch
            self._write(state, name, {id: dump(value)})
        return value

    def delete(self, name: str, id: int) -> None:
        with self.change() as state:
            self._get(state, name, id)
            self._write(state, name, {id: None})

    # collections and indexes

    def ensure_collection(self, name: str) -> None:
        with self.change() as state:
            self._entry(state, name, create=True)

    def remove_collection(self, name: str) -> None:
        """Forgets a collection; one that isn't there is no error."""
        with self.change() as state:
            entry = state["collections"].pop(name, None)
            if entry:
                self._forget(state, entry["snapshot"], *entry["deltas"])

    def rename_collection(self, name: str, to: str) -> None:
        with self.change() as state:
            entry = self._entry(state, name)
            if to in state["collections"]:
                raise CollectionExistsError(f"collection {to!r} exists")
            self._entry(state, to, create=True)
            state["collections"][to] = entry
            del state["collections"][name]

    def ensure_index(self, name: str, path: str, type: str, unique: bool = False) -> None:
        if type not in INDEX_TYPES:
            raise IndexMismatchError(f"an index is of type {', '.join(INDEX_TYPES)}")
        with self.change() as state:
            entry = self._entry(state, name, create=True)
            for index in entry["indexes"]:
                if (index["path"], index["type"]) == (path, type):
                    if index["unique"] != unique:
                        raise IndexMismatchError(f"{path} is indexed {'not ' * (not index['unique'])}uniquely")
                    return
            index = {"path": path, "type": type, "unique": unique, "dbid": state["next"]}
            if unique:
                self._check_unique(self.rows(name, state), index)
            state["next"] += 1
            entry["indexes"].append(index)

    def remove_index(self, name: str, path: str, type: str) -> None:
        """Removes an index by path and type, unique or not; one that isn't there is no error."""
        with self.change() as state:
            entry = state["collections"].get(name)
            if entry:
                entry["indexes"] = [i for i in entry["indexes"] if (i["path"], i["type"]) != (path, type)]

    def info(self) -> dict:
        """Collections and indexes with their numbers of documents; of an index, those that it would hold."""
        state = self.catalog()
        return {
            "version": state["version"],
            "root": self.root,
            "collections": [
                {"name": n, "dbid": c["dbid"], "rnum": c["rows"], "indexes": [i | {"rnum": self._keys(self.rows(n, state), i).count()} for i in c["indexes"]]}
                for n, c in sorted(state["collections"].items())
            ],
        }

    def backup(self, to: str) -> int:
        """Copies the files of one catalog version; returns the time in milliseconds."""
        state = self.catalog()
        self.files.make(to)
        for entry in state["collections"].values():
            moved = {p: f"{to.rstrip('/')}/{p.rpartition('/')[2]}" for p in [entry["snapshot"], *entry["deltas"]] if p}
            for place, copy in moved.items():
                self.files.copy(place, copy)
            entry |= {"snapshot": moved.get(entry["snapshot"]), "deltas": [moved[p] for p in entry["deltas"]]}
        self.files.write(f"{to.rstrip('/')}/catalog-{state['version']:012d}.json", json.dumps(state | {"old": []}))
        return int(time.time() * 1000)

    # queries

    def prepare(self, text: str, collection: str | None = None) -> PathQuery:
        return PathQuery(text, collection)

    def query(self, q: PathQuery | str, collection: str | None = None, skip: int | None = None, limit: int | None = None) -> DataFrame:
        """Runs a query and returns its documents, or its count.

        A query that changes documents commits its change first and returns those it reached. A missing collection
        is empty. ``skip`` and ``limit`` go before the query's own.
        """
        q = PathQuery(q) if isinstance(q, str) else q
        tree = q.bound
        if skip is not None or limit is not None:
            tree = replace(tree, skip=tree.skip if skip is None else skip, limit=tree.limit if limit is None else limit)
        name = collection or q.collection
        if name is None:
            raise InvalidNameError("the query names no collection")
        if not (tree.has_apply or tree.delete):
            return query_documents(self.rows(name), tree, self._rows_or_none)
        before = reached = self.rows(name)
        with self.change() as state:
            if name in state["collections"] or tree.upsert:
                self._entry(state, name, create=True)
                before = self.rows(name, state)
                after, hit = changed_documents(before, replace(tree, projection=()))
                # what was reached is fixed by its ids in the snapshots, which don't change any more
                place = f"{self.root}/reached-{uuid.uuid4().hex}"
                hit.select("id").write.parquet(place)
                self._forget(state, place)
                self._commit(state, name, after)
                ids = self.spark.read.schema("id long").parquet(place)
                reached = (before if tree.delete else self.rows(name, state)).join(ids, "id")
        if tree.count:
            return reached.agg(F.count(F.lit(1)).alias("count"))
        return projected(reached, tree, self._rows_or_none)

    def _rows_or_none(self, name: str) -> DataFrame | None:
        return self.rows(name) if name in self.catalog()["collections"] else None

    def list(self, q: PathQuery | str, collection: str | None = None, **page) -> list[tuple[int, Any]]:
        """(id, document) pairs, gathered: for results that fit the driver."""
        return [(r.id, load(r.doc)) for r in self.query(q, collection, **page).collect()]

    def stream(self, q: PathQuery | str, collection: str | None = None) -> Iterator[tuple[int, Any]]:
        """(id, document) pairs, a partition at a time."""
        for r in self.query(q, collection).toLocalIterator():
            yield r.id, load(r.doc)

    def raw(self, q: PathQuery | str, collection: str | None = None) -> Iterator[tuple[int | None, str]]:
        """(id, document as text) pairs as they are stored or projected, a partition at a time; a count has no id."""
        df = self.query(q, collection)
        for r in df.toLocalIterator():
            yield (None, str(r["count"])) if df.columns == ["count"] else (r.id, r.doc)

    def explained(self, q: PathQuery | str, collection: str | None = None) -> tuple[str, DataFrame]:
        """What the engine says of a query's plan, and its result."""
        return self.explain(q, collection), self.query(q, collection)

    def first(self, q: PathQuery | str, collection: str | None = None) -> tuple[int, Any] | None:
        return next(iter(self.list(q, collection, limit=1)), None)

    def first_n(self, q: PathQuery | str, n: int, collection: str | None = None) -> list:
        return self.list(q, collection, limit=n)

    def count(self, q: PathQuery | str, collection: str | None = None, limit: int | None = None) -> int:
        df = self.query(q, collection, limit=limit)
        return df.first()["count"] if df.columns == ["count"] else df.count()

    scalar_int = count
    update = count

    def visit(self, q: PathQuery | str, visitor: Callable[[int, Any], int | None], collection: str | None = None) -> int:
        """Calls ``visitor(id, document)`` over a result, which is fetched as far as it is visited; it returns the step to the next.

        None or 1 goes on, 0 stops, n moves n on, -n back, with -1 the same document again. Returns the visits.
        """
        rows, found, at, visits = self.stream(q, collection), [], 0, 0
        while at >= 0:
            found += itertools.islice(rows, at + 1 - len(found)) if at >= len(found) else ()
            if at >= len(found):
                break
            step = visitor(*found[at])
            visits += 1
            if step == 0:
                break
            step = 1 if step is None else step
            at += step if step > 0 else step + 1
        return visits

    def explain(self, q: PathQuery | str, collection: str | None = None) -> str:
        q = PathQuery(q) if isinstance(q, str) else q
        entry = self.catalog()["collections"].get(collection or q.collection or "", {"indexes": [], "rows": 0})
        return explain(q.bound, [i | {"rows": entry["rows"]} for i in entry["indexes"]])
