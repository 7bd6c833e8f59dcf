"""A document store over Parquet generations.

Each write makes a generation: one small file in the log, which is created whole or not at all and never replaced, is the
commit, so of two writers of one generation the second is refused. A reader pins the generation that it opened. A
generation lists sets of files in order: rows that are new, rows that replace older ones, and ids that are gone.
Reading leaves out of each set the ids of the later ones; sealing writes one set again, and so does a write that finds MOST_SETS.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import documents as D
from ..operators import lexical as L
from ..operators import predicates as P
from . import lexicon, storage

#: Sets of files that replace or delete, above which a write compacts.
MOST_SETS = 16


class SchemaError(ValueError):
    """A change of schema that isn't an added nullable column."""


class EpochMismatch(ValueError):
    """The store's vectors or terms were made by another model or analyzer."""


class StaleCursor(ValueError):
    """A cursor of another generation."""


class Log:
    """Numbered states of a store in a folder of small files. `latest` is a hint where to look; what counts is the files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, number: int) -> dict | None:
        return storage.get_json(self.spark, f"{self.path}/generations/{number}.json")

    def latest(self) -> dict | None:
        hint = storage.get_json(self.spark, f"{self.path}/latest.json")
        number = hint["generation"] if hint else 0
        state = self.read(number)
        while (later := self.read(number + 1)) is not None:
            number, state = number + 1, later
        return state

    def append(self, state: dict) -> bool:
        """False if another writer has made this generation."""
        if not storage.put_json(self.spark, f"{self.path}/generations/{state['generation']}.json", state):
            return False
        storage.put_json(self.spark, f"{self.path}/latest.json", {"generation": state["generation"]}, replace=True)
        return True

    def forget(self, number: int) -> None:
        """All generations before `number`."""
        fs, at = storage.file_system(self.spark, f"{self.path}/generations")
        for f in fs.listStatus(at):
            name = f.getPath().getName()
            if name.endswith(".json") and int(name[:-5]) < number:
                fs.delete(f.getPath(), False)


class Store:
    """Documents (doc_id, revision, ts, vector, text and attributes) with one live revision each."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, generation: int | None = None, log=None):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.log = log or Log(spark, self.path)
        state = self.log.latest() if generation is None else self.log.read(generation)
        if state is None:
            raise FileNotFoundError(path if generation is None else f"{path}, generation {generation}")
        self.state = state

    @staticmethod
    def first_state(schema: T.StructType, epoch: str = "") -> dict:
        for need in ("doc_id", "revision", "ts"):
            if need not in schema.names:
                raise SchemaError(f"a store needs the column {need}")
        return {"generation": 0, "schema": schema.json(), "epoch": epoch, "files": []}

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, epoch: str = "") -> Store:
        if not Log(spark, path.rstrip("/")).append(cls.first_state(schema, epoch)):
            raise FileExistsError(path)
        return cls(spark, path)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.state["schema"]))

    @property
    def generation(self) -> int:
        return self.state["generation"]

    def live(self) -> DataFrame:
        """The live documents of the pinned generation."""
        files, out, at = self.state["files"], None, 0
        while at < len(files):
            kind, end = files[at][1], at + 1
            while end < len(files) and files[end][1] == kind == "new":
                end += 1
            paths = [f for f, _ in files[at:end]]
            if kind == "gone":
                out = D.delete(out, self.spark.read.schema(self._ids()).parquet(*paths))
            else:
                rows = self.spark.read.schema(self.schema).parquet(*paths)
                out = rows if out is None else (D.delete(out, rows) if kind == "newer" else out).unionByName(rows)
            at = end
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def _ids(self) -> T.StructType:
        return T.StructType([self.schema["doc_id"]])

    def refresh(self) -> Store:
        self.state = self.log.latest()
        return self

    def _written(self, rows: DataFrame) -> str:
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _commit(self, files: list, **changes) -> int:
        """A new generation of the sets of files [path, kind]; kind: new (no older rows of these ids), newer (rows replace older ones), gone (ids)."""
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        state = self.state | changes | {"generation": self.generation + 1, "files": files, "at": time.time()}
        if not self.log.append(state):
            for path, _ in files:
                if [path, _] not in self.state["files"]:
                    storage.delete(self.spark, path)
            raise StaleCursor("another writer has committed; refresh and try again")
        self.state = state
        if sum(kind != "new" for _, kind in files) > MOST_SETS:
            self.seal()
        return self.state["generation"]

    def _writable(self) -> None:
        """Before work is done for a write that would be refused."""
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        if self.log.latest()["generation"] != self.generation:
            raise StaleCursor("another writer has committed; refresh and try again")

    def _add(self, rows: DataFrame, kind: str) -> int:
        self._writable()
        return self._commit([*self.state["files"], [self._written(rows), kind]])

    def _remove(self, ids: DataFrame) -> int:
        """Ids that are live are marked as gone; without any, nothing is written."""
        self._writable()
        ids = storage.stored(self.live().select("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), "gone")
        return self.generation if ids.isEmpty() else self._add(ids, "gone")

    def _shaped(self, batch: DataFrame) -> DataFrame:
        kinds = {f.name: f for f in self.schema.fields}
        for name in batch.columns:
            if name not in kinds:
                raise SchemaError(f"unknown column {name}")
        missing = [f.name for f in kinds.values() if f.name not in batch.columns and not f.nullable]
        if missing:
            raise SchemaError(f"missing columns {missing}")
        return batch.select(*(F.col(n).cast(f.dataType).alias(n) if n in batch.columns else F.lit(None).cast(f.dataType).alias(n) for n, f in kinds.items()))

    def ingest(self, batch: DataFrame, epoch: str | None = None) -> int:
        """Atomic upsert: a stale row refuses the batch, equal revisions are replays. Gives the new generation."""
        self._writable()
        if epoch is not None and epoch != self.state["epoch"]:
            raise EpochMismatch(f"the store is of epoch {self.state['epoch']!r}")
        batch = self._shaped(batch)
        live = self.live()
        marked = D.classify_batch(live, batch)
        counts = {r.outcome: r["count"] for r in marked.groupBy("outcome").count().collect()}
        if counts.get("stale"):
            raise D.StaleRevision(f"{counts['stale']} rows are older than the live ones")
        if not counts.get("applied"):
            return self.generation
        new = storage.stored(marked.where("outcome = 'applied'").drop("outcome"), "applied")
        fresh = live.join(new.select("doc_id"), "doc_id", "left_semi").isEmpty()
        return self._add(new, "new" if fresh else "newer")

    def ingest_if(self, batch: DataFrame, expected: str = "expected") -> int:
        """Upsert if every row's `expected` is the live revision, or null for a key that must be absent."""
        D.conditional_upsert(self.live(), batch, expected)  # refuses the batch or not
        return self.ingest(batch.drop(expected))

    def delete(self, ids: DataFrame) -> int:
        return self._remove(ids)

    def delete_if(self, batch: DataFrame, expected: str = "expected") -> int:
        """Delete batch's doc_ids if every row's `expected` is the live revision."""
        D.conditional_delete(self.live(), batch, expected)
        return self._remove(batch)

    def delete_where(self, predicate) -> int:
        return self._remove(D.delete_matching(self.live(), predicate)[1])

    def drop_partition(self, low: int, high: int) -> int:
        return self._remove(self.live().where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))))

    def apply_retention(self, window: int, now: int) -> int:
        if window <= 0:
            raise ValueError("the window is positive")
        return self._remove(self.live().where(F.col("ts") < F.lit(now - window)))

    def purge(self, ids: DataFrame) -> int:
        """Delete so that no file holds the documents any more: the rest is written again, and all that came before goes, pinned readers and indexes included."""
        self._remove(ids)
        self.seal()
        self.vacuum()
        return self.generation

    def vacuum(self) -> int:
        """Delete the files and generations that the current one doesn't need; gives the number of sets deleted."""
        if self.read_only or not isinstance(self.log, Log):
            raise PermissionError("the store is open for reading only, or its catalog has the log")
        needed = {path.rsplit("/", 1)[1] for path, _ in self.state["files"]}
        self.log.forget(self.generation)
        return self._delete_but(needed)

    def _delete_but(self, needed: set[str]) -> int:
        gone = 0
        for folder, keep in (("data", needed), ("text", {str(self.generation)})):
            fs, at = storage.file_system(self.spark, f"{self.path}/{folder}")
            for f in fs.listStatus(at) if fs.exists(at) else ():
                if f.getPath().getName() not in keep:
                    fs.delete(f.getPath(), True)
                    gone += folder == "data"
        return gone

    def add_column(self, name: str, kind: T.DataType) -> int:
        """Schemas only grow, by nullable columns."""
        if name in self.schema.names:
            raise SchemaError(f"{name} is there already")
        return self._commit(self.state["files"], schema=self.schema.add(name, kind, True).json())

    def seal(self, files: int | None = None) -> int:
        """Compaction: the live rows as one set of files, sorted by ts so that ranges prune."""
        self._writable()
        rows = self.live()
        rows = rows.repartitionByRange(files, "ts") if files else rows.repartitionByRange("ts")
        return self._commit([[self._written(rows.sortWithinPartitions("ts", "doc_id")), "new"]])

    merge_sealed = seal

    def maintain(self, most_sets: int = MOST_SETS) -> bool:
        """Compact if there are more than so many sets of files, and delete what isn't needed; False if nothing was to do."""
        if len(self.state["files"]) <= most_sets:
            return False
        self.seal()
        self.vacuum()
        return True

    def switch_epoch(self, epoch: str, vectors: DataFrame | None = None) -> int:
        """A new model or analyzer: with vectors (doc_id, vector) of it, if the store holds any."""
        if vectors is None:
            return self._commit(self.state["files"], epoch=epoch)
        rows = self.live().drop("vector").join(vectors.select("doc_id", "vector"), "doc_id", "left").select(*self.schema.names)
        return self._commit([[self._written(rows), "new"]], epoch=epoch)

    def drop_epoch(self) -> int:
        """Forget the epoch's vectors: they become null, and the store takes those of any epoch next."""
        rows = self.live().withColumn("vector", F.lit(None).cast(self.schema["vector"].dataType)) if "vector" in self.schema.names else self.live()
        return self._commit([[self._written(rows), "new"]], epoch="")

    def reindex_text(self, text: str = "text", analyze: Callable[[Column], Column] = L.ascii_tokens, epoch: str = "ascii") -> L.Index:
        """Write the lexical index of this generation again, by this analyzer."""
        path = f"{self.path}/text/{self.generation}"
        storage.delete(self.spark, path)
        return lexicon.write(self.live(), path, text, analyze=analyze, epoch=epoch)

    def lexical(self, text: str = "text", analyze: Callable[[Column], Column] = L.ascii_tokens, epoch: str = "ascii") -> L.Index:
        """The generation's lexical index, written when first asked for; a warm store has it already."""
        try:
            return lexicon.read(self.spark, f"{self.path}/text/{self.generation}", epoch)
        except FileNotFoundError:
            return self.reindex_text(text, analyze, epoch)

    warm_lexical = lexical

    def ingest_text(self, texts: DataFrame, longest: int = 256, overlap: int = 32, embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """texts (parent_id, revision, ts, text, ...) as chunks: documents whose doc_id is parent_id * 2 ** 20 + their number.

        Chunks that an earlier revision of a text had and the new one hasn't are deleted in the same way as delete_text does.
        `embed` gets the chunks and gives them back with a vector. The store's schema has the column parent_id.
        """
        words = F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")
        cut = texts.select("*", F.posexplode(D.chunks(F.filter(words, lambda w: w != ""), longest, overlap)).alias("_n", "_c"))
        rows = cut.withColumn("doc_id", F.col("parent_id") * (1 << 20) + F.col("_n")).withColumn("text", F.concat_ws(" ", "_c.tokens")).drop("_n", "_c")
        rows = storage.stored(embed(rows) if embed else rows, "chunks")
        live = self.live()
        old = live.join(texts.select("parent_id").distinct(), "parent_id", "left_semi").join(rows.select("doc_id"), "doc_id", "left_anti").select("doc_id")
        old = storage.stored(old, "old-chunks")
        self.ingest(rows)
        return self._remove(old)

    def delete_text(self, parents: DataFrame) -> int:
        """Delete all chunks of the texts in parents (parent_id)."""
        return self._remove(self.live().join(parents.select("parent_id").distinct(), "parent_id", "left_semi"))

    def get(self, ids: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
        return D.get(self.live(), ids, columns=columns)

    def scan(self, limit: int = 1024, order: str = "ts asc", cursor: dict | None = None, predicate=None, ts_range=None, columns: Sequence[str] | None = None) -> tuple[DataFrame, Callable]:
        """(page, cursor function of its last row); a cursor belongs to its generation. Orders: ts asc, ts desc, storage."""
        if cursor is not None and cursor["generation"] != self.generation:
            raise StaleCursor("the cursor belongs to another generation")
        page = D.scan_page(self.live(), limit, order, None if cursor is None else tuple(cursor["after"]), predicate, ts_range, columns=columns)
        return page, lambda row: {"generation": self.generation, "after": [row.ts, row.doc_id]}

    def scan_ordered(self, column: str, limit: int, descending: bool = False, cursor: dict | None = None) -> tuple[DataFrame, Callable]:
        """As scan, by a numeric attribute."""
        if cursor is not None and cursor["generation"] != self.generation:
            raise StaleCursor("the cursor belongs to another generation")
        page = D.scan_ordered(self.live(), column, limit, descending, after=None if cursor is None else tuple(cursor["after"]))
        return page, lambda row: {"generation": self.generation, "after": [row[column], row.doc_id]}

    def pages(self, limit: int = 1024, **options):
        """All rows, page by page."""
        cursor = None
        while True:
            page, mark = self.scan(limit, cursor=cursor, **options)
            rows = page.collect()
            if not rows:
                return
            yield rows
            cursor = mark(rows[-1])

    def count(self, predicate=None, ts_range=None) -> int:
        return D.count(self.live(), predicate, ts_range).first().n

    def count_grouped(self, column: str, limit: int, predicate=None, ts_range=None) -> DataFrame:
        return D.count_grouped(self.live(), column, limit, predicate, ts_range)

    def query_text(self, text: str | None = None, vector: Sequence[float] | None = None, k: int = 10, analyze: Callable[[str], list[str]] | None = None, **options) -> DataFrame:
        """The k best by words, by a vector or by both, with the documents' text; words go to the generation's lexical index."""
        from ..operators import requests as R

        words = (analyze or (lambda t: re.findall("[a-z0-9]+", t.lower())))(text) if text is not None else None
        found = R.search(self.live(), k, vector, None if words is None else R.Terms(tuple(words)), index=None if words is None else self.lexical(), **options)
        return self.live().select("doc_id", "text").join(F.broadcast(found), "doc_id").orderBy(F.desc("score"), F.asc("doc_id"))  # found: k rows

    def search(self, query: Sequence[float], k: int = 10, predicate=None, eligible: DataFrame | None = None, tier: str = "unset") -> DataFrame:
        from ..operators import vector as V

        return V.top_k(P.where(self.live(), predicate, eligible=eligible), V.literal(V.check_query(query)), k, tier=tier)

    def write_snapshot(self, path: str) -> None:
        """A store of its own with the pinned generation's documents; refused where one is."""
        path = path.rstrip("/")
        if Log(self.spark, path).latest() is not None:
            raise FileExistsError(path)
        self.live().write.parquet(f"{path}/data/snapshot")
        Log(self.spark, path).append(self.state | {"generation": 0, "files": [[f"{path}/data/snapshot", "new"]]})

    def verify(self) -> dict[str, int]:
        """Counts of what must not be: repeated or missing keys, vectors that aren't finite, missing ts."""
        live = self.live()
        found = live.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("keys"), F.sum(F.col("doc_id").isNull().cast("long")).alias("no_key"), F.sum(F.col("ts").isNull().cast("long")).alias("no_ts")).first()
        out = {"rows": found.rows, "repeated": found.rows - found["keys"] - (found.no_key or 0), "no_key": found.no_key or 0, "no_ts": found.no_ts or 0}
        if "vector" in live.columns:
            bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
            out["not_finite"] = live.where(bad).count()
        return out

    def health(self) -> dict:
        """verify() with an answer: ok unless something is that must not be, or a file of the generation is missing."""
        missing = [path for path, _ in self.state["files"] if not storage.file_system(self.spark, path)[0].exists(storage.file_system(self.spark, path)[1])]
        found = {} if missing else self.verify()
        return {"ok": not missing and not any(v for k, v in found.items() if k != "rows"), "missing_files": missing, **found}

    def stats(self) -> dict[str, int]:
        return {"generation": self.generation, "file_sets": len(self.state["files"]), "rows": self.live().count()}


class _Held:
    """A log that keeps one state in memory until its catalog commits."""

    def __init__(self, state: dict):
        self.state = state

    def latest(self) -> dict:
        return self.state

    def read(self, number: int) -> dict | None:
        return self.state if self.state["generation"] == number else None

    def append(self, state: dict) -> bool:
        self.state = state
        return True


class Namespaces:
    """Stores by name under one log: a batch over several of them is one generation of the log, so all of it is seen or nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, self.path)
        if self.log.latest() is None:
            self.log.append({"generation": 0, "stores": {}})

    def names(self) -> list[str]:
        return sorted(self.log.latest()["stores"])

    def open(self, name: str) -> Store:
        """For reading; writes go through batch()."""
        state = self.log.latest()["stores"].get(name)
        if state is None:
            raise FileNotFoundError(f"{self.path}: no namespace {name}")
        return Store(self.spark, f"{self.path}/{name}", True, log=_Held(state))

    def create(self, name: str, schema: T.StructType, epoch: str = "") -> None:
        if not re.fullmatch(r"[\w-]+", name) or name in ("generations", "data"):
            raise ValueError(f"not a name: {name!r}")
        state = Store.first_state(schema, epoch)

        def add(stores: dict) -> dict:
            if name in stores:
                raise FileExistsError(name)
            return stores | {name: state}

        self._change(add)

    def drop(self, name: str) -> None:
        def without(stores: dict) -> dict:
            if name not in stores:
                raise FileNotFoundError(name)
            return {k: v for k, v in stores.items() if k != name}

        self._change(without)

    def batch(self, writes: dict[str, Callable[[Store], object]]) -> int:
        """Each function writes to the store of its name. One that fails, or another writer's commit, leaves all as it was."""

        def written(stores: dict) -> dict:
            out = dict(stores)
            for name, write in writes.items():
                if name not in stores:
                    raise FileNotFoundError(name)
                store = Store(self.spark, f"{self.path}/{name}", log=_Held(stores[name]))
                write(store)
                out[name] = store.state
            return out

        return self._change(written)

    def vacuum(self, name: str) -> int:
        """Delete the namespace's sets of files that its committed state doesn't need, so that purged documents are in no file."""
        store = self.open(name)
        return store._delete_but({path.rsplit("/", 1)[1] for path, _ in store.state["files"]})

    def _change(self, make: Callable[[dict], dict]) -> int:
        now = self.log.latest()
        state = {"generation": now["generation"] + 1, "stores": make(now["stores"])}
        if not self.log.append(state):
            raise StaleCursor("another writer has committed; try again")
        return state["generation"]
