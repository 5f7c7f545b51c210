"""Tables of Parquet versions: sorted deltas merged when read, folded by size, committed once, with statistics of files."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.workdir import staged

LOG = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("changed", T.ArrayType(T.IntegerType())),
    T.StructField("rows", T.LongType()), T.StructField("committed_at", T.StringType()), T.StructField("entry", T.StringType()),
])
#: Bits of one bitmap of a file's Bloom filter, and the bits it has for each key on average.
BITMAP, BITS_A_KEY = 32768, 10
#: Keys for each file in their range from which on the files aren't searched for them.
MANY = 64


class CommitConflict(Exception):
    """Another writer has changed what a commit was made from."""


# --- small files ----------------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one; of several writers just one gets True, and no reader sees a part.

    The text is written beside its place and then put there: by a link on a local disk, or
    by a rename that doesn't overwrite. Both fail where the file exists. A store without
    such a rename needs a committer of its own.
    """
    place, fs = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(beside.toUri().getPath(), place.toUri().getPath())
        else:
            jvm = spark._jvm.org.apache.hadoop.fs
            options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
            jvm.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, place, options)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(beside, False)


def numbered_files(spark: SparkSession, folder: str, after: int = 0) -> dict[int, str]:
    """The paths of a folder's files <number>.json above a number."""
    place, fs = _file_system(spark, folder)
    if not fs.exists(place):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
    return {n: f"{folder}/{n:012d}.json" for n in sorted(numbers) if n > after}


def read_json(spark: SparkSession, path: str):
    place, fs = _file_system(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _plain(value) -> dict | None:
    """A cursor value for the log, and back."""
    if value is None:
        return None
    kind = next(k for k, t in (("timestamp", dt.datetime), ("date", dt.date), ("decimal", Decimal), ("number", (int, float)), ("text", str)) if isinstance(value, t))
    return {"kind": kind, "value": value.isoformat() if kind in ("timestamp", "date") else value if kind == "number" else str(value)}


def _value(plain: dict):
    read = {"timestamp": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "decimal": Decimal}.get(plain["kind"], lambda v: v)
    return read(plain["value"])


def _digest(df: DataFrame) -> Column:
    """The sum of the rows' hashes: the same whatever their order."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))


def _by_data(files: list) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for r in files:
        out.setdefault(r["data"], []).append(r["file"])
    return out


# --- the table ------------------------------------------------------------------------


@dataclass
class State:
    """What the log says at a version: the base's versions with the buckets that each still serves, and the deltas, oldest first."""

    version: int = 0
    base: list[tuple[dict, list[int] | None]] = field(default_factory=list)
    deltas: list[dict] = field(default_factory=list)
    head: dict | None = None

    def add(self, entry: dict) -> State:
        self.version = entry["version"]
        if entry["kind"] == "whole":
            self.base, self.deltas = [(entry, None)], []
        elif entry["kind"] in ("fold", "buckets"):
            self.deltas = [d for d in self.deltas if d["version"] not in entry["replaces"]]
            if entry["base"]:
                every = range(entry["buckets"])
                self.base = [(e, [b for b in (every if own is None else own) if b not in entry["changed"]]) for e, own in self.base]
                self.base = [(e, own) for e, own in self.base if own] + [(entry, entry["changed"])]
            else:
                self.deltas = sorted([*self.deltas, entry], key=lambda d: d["position"])
        elif entry["data"] is not None:
            self.deltas = sorted([*self.deltas, entry], key=lambda d: d["position"])
        if entry["kind"] != "fold":
            self.head = entry
        return self

    @property
    def live(self) -> list[dict]:
        return [e for e, _ in self.base] + self.deltas

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.head["schema"]))


class VersionedTable:
    """A table whose upserts append a delta; a file in ``log`` commits it, and readers take a key's rows from its newest version.

    An upsert writes its own rows only, sorted by bucket (a hash of the key) and key; it
    doesn't read the table. ``read`` holds the base against the deltas' keys alone, so
    rows that no delta touches aren't shuffled. ``compact`` folds deltas of like sizes into
    one, and into the base's buckets that they touch when they are as large as ``fold`` of
    these: so a row is rewritten a bounded number of times and deltas stay few. Several
    writers may load a table: commits are numbered by files that are created once, and the
    one that comes second looks at what was committed meanwhile and goes on, or fails with
    ``CommitConflict`` if its rows were made from what has changed.

    Of each file the range of its keys and a Bloom filter are kept under ``stats``:
    ``read_keys`` opens only files that may hold a key. ``mark`` gives a column of
    ``cursors`` its largest value ever loaded, from the log. The log's files are gathered
    into a checkpoint at each ``checkpoint_every``-th commit; ``vacuum`` removes what no
    late reader needs.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, *, cursors: tuple[str, ...] = (), fold: float = 0.5, fan: int = 4, checkpoint_every: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.cursors, self.fold, self.fan, self.checkpoint_every = tuple(cursors), fold, fan, checkpoint_every

    # the log

    def _entries(self, after: int) -> list[dict]:
        return [read_json(self.spark, p) for p in numbered_files(self.spark, f"{self.path}/log", after).values()]

    def _checkpoint(self) -> tuple[int, State]:
        """The newest gathered state and its version."""
        found = numbered_files(self.spark, f"{self.path}/checkpoint")
        if not found:
            return 0, State()
        version = max(found)
        saved = read_json(self.spark, found[version])
        return version, State(version, [tuple(b) for b in saved["base"]], saved["deltas"], saved["head"])

    def state(self) -> State:
        version, state = self._checkpoint()
        for entry in self._entries(version):
            state.add(entry)
        return state

    def log(self) -> DataFrame:
        """A row for each commit."""
        version, _ = self._checkpoint()
        rows = [self._row(e) for e in self._entries(version)]
        tail = self.spark.createDataFrame(rows, LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/runs/version={version}").unionAll(tail) if version else tail

    def _row(self, e: dict) -> tuple:
        return e["version"], e["run_id"], e["kind"], e["changed"], e["rows"], e["committed_at"], json.dumps(e)

    def version(self) -> int | None:
        return self.state().version or None

    def has_run(self, run_id: str) -> bool:
        version, _ = self._checkpoint()
        if any(e["run_id"] == run_id for e in self._entries(version)):
            return True
        return bool(version) and not self.spark.read.schema(LOG).parquet(f"{self.path}/runs/version={version}").where(F.col("run_id") == run_id).isEmpty()

    def _clash(self, mine: dict, other: dict) -> str | None:
        """Why a commit can't follow another that its rows weren't made from."""
        if mine["kind"] == "fold":
            return "it replaced or folded versions" if other["kind"] in ("whole", "fold", "buckets") else None
        if other["kind"] == "fold":
            return "it folded buckets that were read" if mine["kind"] == "buckets" and set(mine["changed"]) & set(other["changed"]) else None
        if mine["kind"] in ("delta", "buckets") and (other["kind"] == "whole" or other["schema"] != mine["from_schema"]):
            return "it changed the table's shape"
        if mine["from_read"] and (mine["kind"] == "whole" or other["kind"] == "whole" or set(mine["changed"]) & set(other["changed"])):
            return "it changed buckets that were read"
        return None

    def _commit(self, entry: dict, seen: int) -> int:
        while True:
            entry["version"] = seen + 1
            if entry["kind"] != "fold":
                entry["position"] = entry["version"]
            if create_once(self.spark, f"{self.path}/log/{seen + 1:012d}.json", json.dumps(entry)):
                break
            for other in self._entries(seen):
                if why := self._clash(entry, other):
                    raise CommitConflict(f"run {entry['run_id']}: version {other['version']} came before, {why}")
                seen = other["version"]
        if entry["version"] % self.checkpoint_every == 0:
            self.checkpoint()
        return entry["version"]

    def checkpoint(self) -> None:
        """Gathers the log: the state in one file, the runs in one table. Older readers still find their files until ``vacuum``."""
        version, rows = self.state().version, self.log()
        if not version or version == self._checkpoint()[0]:
            return
        state = self.state()
        rows.where(F.col("version") <= state.version).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/version={state.version}")
        create_once(self.spark, f"{self.path}/checkpoint/{state.version:012d}.json", json.dumps({"base": state.base, "deltas": state.deltas, "head": state.head}))

    # reading

    def _typed(self, state: State) -> T.StructType:
        """The stored columns; __deleted is true in a delta's row that stands for a deleted key, and null elsewhere."""
        return T.StructType([*state.schema.fields, T.StructField("__deleted", T.BooleanType()), T.StructField("__bucket", T.IntegerType())])

    def _scan(self, state: State, entry: dict, files: list[str] | None) -> DataFrame:
        folder = f"{self.path}/version={entry['data']}"
        reader = self.spark.read.schema(self._typed(state))
        return reader.parquet(folder) if files is None else reader.option("basePath", folder).parquet(*files)

    def _merged(self, state: State, *, buckets: list[int] | None = None, files: dict[int, list[str]] | None = None, only: list[dict] | None = None) -> DataFrame | None:
        """The rows of some buckets or files, each key's from the newest version that has it; ``only`` some deltas, without the base.

        Deleted keys are left out, but for ``only`` deltas: there they still hide the base's rows.
        """
        deltas = state.deltas if only is None else only
        keys, out, base = state.head["keys"], None, None

        def part(entry: dict, own: list[int] | None) -> DataFrame | None:
            listed = None if files is None else files.get(entry["data"])
            if files is not None and not listed:
                return None
            wanted = buckets if own is None else own if buckets is None else [b for b in own if b in buckets]
            rows = self._scan(state, entry, listed)
            return rows if wanted is None else rows.where(F.col("__bucket").isin(wanted))

        for entry, own in state.base if only is None else []:
            rows = part(entry, own)
            if rows is not None:
                base = rows if base is None else base.unionAll(rows)
        parts = [p.withColumn("__position", F.lit(d["position"])) for d in deltas if (p := part(d, None)) is not None]
        if parts:
            changes = parts[0]
            for p in parts[1:]:
                changes = changes.unionAll(p)
            # null keys equal nothing: neither is such a row replaced, nor does it replace one
            newest = changes.dropna(subset=keys).groupBy(*keys).agg(F.max("__position").alias("__newest"))
            base = None if base is None else base.join(newest.select(*keys), keys, "left_anti").select(*self._typed(state).names)
            if len(parts) > 1:
                changes = changes.join(newest, keys, "left").where("__newest is null or __position = __newest")
            changes = changes.select(*self._typed(state).names)
            if only is not None:
                return changes.drop("__bucket")
            changes = changes.where("__deleted is null")
            out = changes if base is None else base.unionAll(changes)
        else:
            out = base
        return None if out is None else out.drop("__bucket", "__deleted")

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or the rows of some of its buckets; None before the first version."""
        state = self.state()
        return self._merged(state, buckets=buckets) if state.head else None

    def mark(self, column: str):
        """The largest value of a cursor that was ever loaded into the live versions; read from the log, without a scan.

        A cursor that the table doesn't keep is scanned for. None in an empty table.
        """
        state = self.state()
        if all(column in e["marks"] for e in state.live):
            found = [_value(e["marks"][column]) for e in state.live if e["marks"][column] is not None]
            return max(found, default=None)
        return self._merged(state).agg(F.max(column)).first()[0]

    def _hash(self, keys: list[str]) -> Column:
        return F.xxhash64(*keys, F.lit(17))

    def stats(self, state: State | None = None) -> DataFrame | None:
        """Rows (data, file, bucket, part, n_rows, low, high, bits) of the live files: ranges of keys and Bloom filters."""
        live = (state or self.state()).live
        if not live or not live[0]["keys"]:
            return None
        return self.spark.read.option("basePath", f"{self.path}/stats").parquet(*[f"{self.path}/stats/data={e['data']}" for e in live])

    def files_of(self, wanted: DataFrame, state: State | None = None) -> dict[int, list[str]]:
        """The live files that may hold a key of ``wanted``, by number of their version's data.

        Where there are many keys for each file in their range, all files of the range are
        taken, as nearly all hold one; else the keys are held against each file's range and
        Bloom filter.
        """
        state = state or self.state()
        keys, buckets = state.head["keys"], state.head["buckets"]
        own = wanted.select(*[F.col(k).cast(state.schema[k].dataType).alias(k) for k in keys]).dropna()
        bounds = own.agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("least"), F.max(F.struct(*keys)).alias("most"))  # one row
        inside = self.stats(state).join(F.broadcast(bounds), (F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least")))
        near = inside.select("data", "file", "n").distinct().collect()
        if not near or near[0]["n"] >= MANY * len(near):
            return _by_data(near)
        own = own.distinct()
        parts = F.explode(F.array(*[F.struct(F.lit(e["data"]).cast("int").alias("data"), F.lit(e["parts"]).alias("parts")) for e in state.live])).alias("p")
        own = own.select(F.struct(*keys).alias("key"), self._bucket(keys, buckets).alias("bucket"), self._hash(keys).alias("hash"), parts)
        own = own.select("key", "bucket", "hash", "p.data", F.pmod(F.shiftright("hash", 40), F.col("p.parts")).cast("int").alias("part"))
        bit = [F.pmod("hash", F.lit(BITMAP)), F.pmod(F.shiftright("hash", 20), F.lit(BITMAP))]
        held = [F.getbit(F.conv(F.hex(F.substring("bits", (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long"), b.bitwiseAND(7).cast("int")) == 1 for b in bit]
        found = own.join(self.stats(state), ["data", "bucket", "part"]).where((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high"))).where(held[0] & held[1])
        return _by_data(found.select("data", "file").distinct().collect())

    def read_keys(self, wanted: DataFrame) -> DataFrame | None:
        """The table's rows whose key is among ``wanted``; only files that may hold one are opened. None before the first version."""
        state = self.state()
        if not state.head:
            return None
        keys = state.head["keys"]
        rows = self._merged(state, files=self.files_of(wanted, state)) if keys else self._merged(state)
        if rows is None:
            return self._scan(state, state.live[0], None).limit(0).drop("__bucket", "__deleted")
        own = wanted.select(*[F.col(k).cast(state.schema[k].dataType).alias(k) for k in keys]).distinct()
        return rows.join(own, keys, "left_semi").select(*rows.columns)

    # writing

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)

    def _store(self, df: DataFrame, keys: list[str], buckets: int, rows_per_file: int, seen: int, *, base: bool) -> dict:
        """Writes rows and their statistics as data of a new number, which no reader sees before a commit."""
        data = seen + 1
        while not create_once(self.spark, f"{self.path}/claims/{data:012d}.json", "{}"):
            data += 1
        seen_rows = Observation()
        rows = df.withColumn("__bucket", self._bucket(keys, buckets)).hint("rebalance", "__bucket").sortWithinPartitions("__bucket", *keys)
        marks = [F.max(c).alias(f"mark_{c}") for c in self.cursors if c in df.columns]
        rows = rows.observe(seen_rows, F.count("*").alias("n"), F.collect_set("__bucket").alias("changed"), *marks)
        writer = rows.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite")
        (writer.partitionBy("__bucket") if base else writer).parquet(f"{self.path}/version={data}")
        found = seen_rows.get
        n = found["n"]
        if not n and not base:
            return {}
        parts = 1 << max(0, -(-n * BITS_A_KEY // (BITMAP * (buckets if base else 1))) - 1).bit_length()
        if keys:
            written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(f"{self.path}/version={data}")
            own = written.dropna(subset=keys).select(F.col("_metadata.file_path").alias("file"), F.col("__bucket").alias("bucket"), F.struct(*keys).alias("key"), self._hash(keys).alias("hash"))
            own = own.withColumn("part", F.pmod(F.shiftright("hash", 40), F.lit(parts)).cast("int"))
            own = own.withColumn("bit", F.explode(F.array(F.pmod("hash", F.lit(BITMAP)), F.pmod(F.shiftright("hash", 20), F.lit(BITMAP)))))
            stats = own.groupBy("file", "bucket", "part").agg((F.count("*") / 2).cast("long").alias("n_rows"), F.min("key").alias("low"), F.max("key").alias("high"), F.bitmap_construct_agg("bit").alias("bits"))
            stats.write.mode("overwrite").parquet(f"{self.path}/stats/data={data}")
        return {"data": data, "rows": n, "changed": sorted(found["changed"] or []), "parts": parts, "marks": {c: _plain(found[f"mark_{c}"]) for c in self.cursors if c in df.columns}}

    def _put(self, kind: str, df: DataFrame, run_id: str, keys: list[str], buckets: int, rows_per_file: int, state: State, seen: int, from_read: bool, **more) -> int:
        entry = {"kind": kind, "run_id": run_id, "keys": list(keys), "buckets": buckets, "schema": df.schema.json(), "from_schema": state.head["schema"] if state.head else None, "from_read": from_read, "committed_at": dt.datetime.now(dt.timezone.utc).isoformat()}
        entry |= {"data": None, "rows": 0, "changed": [], "parts": 1, "marks": {}} | more
        changed = entry["changed"]
        entry |= self._store(df, keys, buckets, rows_per_file, state.version, base=kind == "whole" or entry.get("base", False))
        entry["changed"] = sorted({*changed, *entry["changed"]})
        return self._commit(entry, seen)

    def write(self, df: DataFrame, run_id: str, keys: list[str] | None = None, rows_per_file: int = 0, expected: int | None = None) -> int:
        """Replaces the table by ``df``, which may read the current version. With ``expected`` only if that is still the newest but for folds."""
        state = self.state()
        return self._put("whole", df, run_id, keys or [], self.buckets, rows_per_file, state, state.version if expected is None else expected, expected is not None)

    def _cast(self, source: DataFrame, state: State) -> DataFrame | None:
        """The source with the stored types; None if a value that isn't a key's doesn't keep its value, an error if a key doesn't."""
        stored = {f.name: f.dataType for f in state.schema.fields}
        other = [f for f in source.schema.fields if f.name in stored and f.dataType.simpleString() != stored[f.name].simpleString()]
        if not other:
            return source
        lost = {}
        for f in other:
            there = F.col(f"`{f.name}`").try_cast(stored[f.name])
            lost[f.name] = F.max((F.col(f"`{f.name}`").isNotNull() & (there.isNull() | ~there.try_cast(f.dataType).eqNullSafe(F.col(f"`{f.name}`")))).cast("int"))
        found = source.agg(*[c.alias(n) for n, c in lost.items()]).first().asDict()
        bad = sorted(n for n, v in found.items() if v)
        if keys := [k for k in bad if k in state.head["keys"]]:
            raise ValueError(f"keys {keys} don't fit the table's types {[stored[k].simpleString() for k in keys]}")
        return None if bad else source.withColumns({f.name: F.col(f"`{f.name}`").cast(stored[f.name]) for f in other})

    def upsert(self, source: DataFrame, keys: list[str], run_id: str, rows_per_file: int = 0, expected: int | None = None, compact: bool = True) -> int:
        """Adds the source's rows in place of those with their keys; creates the table from the source's shape if absent.

        Keys compare by value: they are cast to the stored types, and one that wouldn't keep
        its value is an error. New columns are added; a column that needs a wider type, or
        other keys, rewrites the table. Null keys replace nothing. Give ``expected``, the
        version that the source's rows were computed from, and a commit to its buckets
        since then is a ``CommitConflict``; without it the upsert is repeated on the new
        state. The source is read once, or twice where types differ: stage it if it costs
        more than a read.
        """
        for attempt in range(10):
            state = self.state()
            try:
                done = self._upsert(state, source, list(keys), run_id, rows_per_file, expected)
                break
            except CommitConflict:
                if expected is not None or attempt == 9:
                    raise
        if compact:
            self.compact(run_id=f"{run_id} (fold)")
        return done

    def _upsert(self, state: State, source: DataFrame, keys: list[str], run_id: str, rows_per_file: int, expected: int | None) -> int:
        seen = state.version if expected is None else expected
        if not state.head:
            return self._put("whole", source, run_id, keys, self.buckets, rows_per_file, state, seen, True)
        own = self._cast(source, state) if state.head["keys"] == keys else None
        if own is None:
            kept = self._merged(state).join(source.select(*keys).distinct(), keys, "left_anti")
            return self._put("whole", kept.unionByName(source, allowMissingColumns=True), run_id, keys, state.head["buckets"], rows_per_file, state, seen, True)
        added = [f for f in own.schema.fields if f.name not in state.schema.names]
        own = own.select(*[F.col(f"`{f.name}`") if f.name in own.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in [*state.schema.fields, *added]])
        schema = T.StructType([*state.schema.fields, *added]).json() if added else state.head["schema"]
        return self._put("delta", own, run_id, keys, state.head["buckets"], rows_per_file, state, seen, expected is not None, schema=schema)

    def replace(self, snapshot: DataFrame, keys: list[str], run_id: str) -> DataFrame:
        """Makes the table equal to a whole snapshot by its difference; gives rows (kind, n_keys): inserted, updated, deleted, unchanged.

        Hashes of rows are added up by bucket on both sides, and only buckets whose sums
        differ are compared by key. Of these the keys that differ are written as a delta, a
        deleted one as a row that says so; where they are as many as ``fold`` of their buckets'
        keys, or one of them is null, which no delta replaces, their buckets are written anew.
        A snapshot of other columns, types or keys is written whole. Null keys are keys of
        their own here, rows that share a key are compared together. The snapshot is read
        up to three times: stage it if it costs more than a read. Of two writers the second
        is a ``CommitConflict`` if their buckets meet.
        """
        state = self.state()
        columns = None if not state.head else [f.name for f in state.schema.fields]
        own = self._cast(snapshot, state) if columns == snapshot.columns and state.head["keys"] == list(keys) else None
        if own is None:
            old = None if not state.head else self._merged(state)
            counts = staged(self._counts(self._difference(snapshot.limit(0) if old is None else old, snapshot, keys)), "difference")  # the old table is about to be replaced
            self._put("whole", snapshot, run_id, keys, self.buckets, 0, state, state.version, True)
            return counts
        buckets, old = state.head["buckets"], self._merged(state)

        def sums(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy(self._bucket(keys, buckets).alias("bucket")).agg(_digest(df).alias(name), F.countDistinct(F.struct(*keys)).alias(f"{name}_keys"))

        both = sums(own, "new").join(sums(old, "old"), "bucket", "full").withColumn("same", F.col("new").eqNullSafe(F.col("old")))
        rows = both.select("bucket", "same", F.coalesce("new_keys", F.lit(0)).alias("n")).collect()  # a row a bucket
        changed = sorted(r["bucket"] for r in rows if not r["same"])
        here = self._bucket(keys, buckets).isin(changed)
        other = staged(self._difference(old.where(here), own.where(here), keys).where("__kind <> 'unchanged'"), "difference")
        null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        n, nulls, new_keys = other.agg(F.count("*"), F.count_if(null), F.count_if(F.col("__kind") != "deleted")).first()
        if not changed:
            self._put("delta", own.limit(0), run_id, keys, buckets, 0, state, state.version, False, schema=state.head["schema"])
        elif not nulls and n < self.fold * sum(r["n"] for r in rows if not r["same"]):
            new = own.where(here).join(other.where("__kind <> 'deleted'").select(*keys), keys, "left_semi").select(*own.columns)
            gone = other.where("__kind = 'deleted'").select(*keys, F.lit(True).alias("__deleted"))
            self._put("delta", new.unionByName(gone, allowMissingColumns=True), run_id, keys, buckets, 0, state, state.version, True, schema=state.head["schema"])
            self.compact(run_id=f"{run_id} (fold)")
        else:
            inside = [d for d in state.deltas if set(d["changed"]) <= set(changed)]
            partly = [d for d in state.deltas if d not in inside and set(d["changed"]) & set(changed)]
            if partly:  # a delta that also has other buckets is folded first
                self.compact(run_id=f"{run_id} (fold)", everything=True)
                state, inside = self.state(), []
            self._put("buckets", own.where(here), run_id, keys, buckets, 0, state, state.version, True, base=True, replaces=[d["version"] for d in inside], changed=changed, schema=state.head["schema"])
        unchanged = sum(r["n"] for r in rows) - new_keys
        return self._counts(other).withColumn("n_keys", F.when(F.col("kind") == "unchanged", F.lit(unchanged)).otherwise(F.col("n_keys")))

    def _difference(self, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        """A row for each key of two tables: the key's columns, and its __kind."""

        def by_key(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)]).agg(_digest(df).alias(name))

        on = [F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}")) for i in range(len(keys))]
        pairs = by_key(old, "old").join(by_key(new, "new"), on, "full")
        kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
        return pairs.select(*[F.coalesce(f"new_{i}", f"old_{i}").alias(k) for i, k in enumerate(keys)], kind.alias("__kind"))

    def _counts(self, difference: DataFrame) -> DataFrame:
        """Rows (kind, n_keys), one for each of the four kinds."""
        kinds = self.spark.createDataFrame([(k,) for k in ("inserted", "updated", "deleted", "unchanged")], "kind string")
        return kinds.join(difference.groupBy(F.col("__kind").alias("kind")).agg(F.count("*").alias("n_keys")), "kind", "left").select("kind", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))

    # folding

    def _plan(self, state: State) -> tuple[list[dict], bool]:
        """The deltas to fold, and whether into the base."""
        if not state.deltas:
            return [], False
        buckets = state.head["buckets"]
        touched = {b for d in state.deltas for b in d["changed"]}
        rows = sum(e["rows"] * (len(set(e["changed"] if own is None else own) & touched) / max(1, len(e["changed"]))) for e, own in state.base)
        if sum(d["rows"] for d in state.deltas) >= self.fold * rows or len(touched) > buckets:
            return state.deltas, True
        like, total = [], 0
        for d in reversed(state.deltas):
            if like and d["rows"] > self.fan * total:
                break
            like.append(d)
            total += d["rows"]
        return (like[::-1], False) if len(like) >= self.fan else ([], False)

    def compact(self, run_id: str = "fold", everything: bool = False) -> int | None:
        """Folds deltas by their sizes; ``everything`` folds all into the base. None if there is nothing to fold, or another folded first.

        Newer deltas may be committed meanwhile: the fold takes the place of those it was made of.
        """
        state = self.state()
        deltas, base = (state.deltas, bool(state.deltas)) if everything else self._plan(state)
        if not deltas:
            return None
        changed = sorted({b for d in deltas for b in d["changed"]})
        rows = self._merged(state, buckets=changed) if base else self._merged(state, only=deltas)
        try:
            return self._put("fold", rows, run_id, state.head["keys"], state.head["buckets"], 0, state, state.version, True, base=base, replaces=[d["version"] for d in deltas], position=max(d["position"] for d in deltas), schema=state.head["schema"])
        except CommitConflict:
            return None

    def vacuum(self, older_than: dt.timedelta = dt.timedelta(days=7), keep: int = 1) -> list[str]:
        """Removes data that none of the last ``keep`` versions reads and that is older than ``older_than``; gives their paths.

        Also goes what the checkpoint has gathered of the log. A reader or a writer that
        takes longer than ``older_than`` may lose its files.
        """
        version, state = self._checkpoint()
        entries = self._entries(version)
        used = {e["data"] for e in state.live}
        if len(entries) >= keep:
            used = set()
        for i, entry in enumerate(entries):
            state.add(entry)
            if i >= len(entries) - keep:
                used |= {e["data"] for e in state.live}
        place, fs = _file_system(self.spark, self.path)
        before = (dt.datetime.now().timestamp() - older_than.total_seconds()) * 1000
        gone = []

        def drop(folder: str, unused) -> None:
            at, _ = _file_system(self.spark, folder)
            for s in fs.listStatus(at) if fs.exists(at) else []:
                number = s.getPath().getName().rpartition("=")[2].removesuffix(".json")
                if number.isdigit() and unused(int(number)) and s.getModificationTime() <= before:
                    gone.append(s.getPath().toString())
                    fs.delete(s.getPath(), True)

        drop(self.path, lambda n: n not in used)
        drop(f"{self.path}/stats", lambda n: n not in used)
        drop(f"{self.path}/log", lambda n: n <= version)
        drop(f"{self.path}/checkpoint", lambda n: n < version)
        drop(f"{self.path}/runs", lambda n: n < version)
        return gone
