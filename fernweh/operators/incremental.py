"""Processing only rows that are new or changed since the last successful run.

State is a versioned table of (key, content hash). A run hashes the current rows, joins them with the state by
key and hash, processes what is left, and swaps the state's version by one atomic step. A run that dies before
that step leaves the old version in force, so the next run selects the same rows again; a run that dies after
it has nothing left to do. Two runs at once: one commits, the other raises and has changed nothing.

Defined cases: a null hash never equals anything, so its row is always selected (its content can't be vouched
for); null keys are compared null-safely; repeated state rows count once; an empty state selects every row; extra
columns pass through untouched.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweh.runtime import filesystem


def content_hash(*parts: Column) -> Column:
    """128-bit content hash of the parts; null if any part is null. Lengths are kept, so that parts can't run into each other."""
    each = [F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")) for p in parts]
    return F.substring(F.sha2(F.concat(*each), 256), 1, 32)


def changed_rows(current: DataFrame, state: DataFrame, keys: list[str], hash_col: str = "content_hash") -> DataFrame:
    """Rows of `current` whose (keys, hash) aren't in `state`: new keys and known keys with other content."""
    known = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(hash_col).alias("__h"))
    on = F.col(hash_col) == F.col("__h")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return current.join(known, on, "left_anti")


def vanished_keys(current: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the state that have no row any more."""
    on = None
    cur = current.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = c if on is None else on & c
    return state.select(*keys).join(cur, on, "left_anti").distinct()


class RunState:
    """Versioned state in a folder all executors share.

    Every table is written to a folder of its own that no other writer can name. A version is one marker,
    `commit-<N>`, that names the tables it consists of: the state and, where the run returned one, its output. Markers
    are made whole beside and moved to their name in one step that fails if the name is taken, so of two writers of
    a version one wins and the other raises, having changed nothing that is committed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs, p = filesystem(spark, self.folder)
        self._fs.mkdirs(p)
        self._local = self._fs.getUri().getScheme() == "file"

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(filesystem(self.spark, self.folder)[1])]

    def _mark(self, v: int) -> str:
        return f"{self.folder}/commit-{v}"

    def _claim(self, v: int, said: dict) -> bool:
        """Makes the marker of a version; False if there is one."""
        tmp = f"{self.folder}/.mark-{uuid.uuid4().hex}"
        if self._local:  # a link is made at once or not at all, also where the folder is mounted
            tmp, mark = _plain(tmp), _plain(self._mark(v))
            with open(tmp, "w") as f:
                f.write(json.dumps(said))
            try:
                os.link(tmp, mark)
            except FileExistsError:
                return False
            finally:
                os.unlink(tmp)
            return True
        jvm = self.spark.sparkContext._jvm
        out = self._fs.create(filesystem(self.spark, tmp)[1], True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(filesystem(self.spark, tmp)[1], filesystem(self.spark, self._mark(v))[1], options)  # never over another
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            self._fs.delete(filesystem(self.spark, tmp)[1], False)
            return False
        return True

    def committed(self, v: int) -> dict:
        """What the marker of a version says."""
        if self._local:
            with open(_plain(self._mark(v))) as f:
                return json.load(f)
        return json.loads(self.spark.read.text(self._mark(v), wholetext=True).first()[0])

    def version(self) -> int:
        """Greatest committed version; 0 before the first run."""
        return max([int(m[7:]) for m in self._names() if m.startswith("commit-")], default=0)

    def load(self, schema: str, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{self.committed(v)['state']}") if v else self.spark.createDataFrame([], schema)

    def outputs(self, schema: str) -> DataFrame:
        """What all committed runs returned, each row once: what runs that died had written is named by no marker."""
        names = [self.committed(v).get("output") for v in range(1, self.version() + 1)]
        paths = [f"{self.folder}/{n}" for n in names if n]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, label: str) -> str:
        name = f"{label}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, rows: DataFrame, expected: int | None = None, output: str | None = None, **note) -> int:
        """Writes the next version and swaps it in."""
        v = (self.version() if expected is None else expected) + 1
        if not self._claim(v, {"state": self._write(rows, "state"), "output": output, **note}):
            raise RuntimeError(f"version {v} is already committed")
        return v

    def run(self, current: DataFrame, keys: list[str], process, hash_col: str = "content_hash") -> int:
        """One run: select, process, commit.

        `current` is evaluated once, into a snapshot of all keys and hashes and of the whole rows that are due;
        what is processed and what is recorded as done are both read from it. If `process` returns a frame, that is
        written and committed together with the state, so that `outputs` skips and repeats nothing whatever failed;
        effects elsewhere must be idempotent per row, as a crash before the commit repeats them."""
        v = self.version()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in current.select(*keys, hash_col).schema)
        known = self.load(schema, v)
        mark = known.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(hash_col).alias("__h"), F.lit(True).alias("__known")).dropDuplicates()
        on = F.col(hash_col) == F.col("__h")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        row = F.struct(*[F.col(f"`{c}`") for c in current.columns])
        both = current.join(mark, on, "left").select(*keys, hash_col, F.when(F.col("__known").isNull(), row).alias("__row"))
        snapshot = self._write(both, "snapshot")
        seen = self.spark.read.schema(both.schema).parquet(f"{self.folder}/{snapshot}")
        made = process(seen.filter("__row IS NOT NULL").select("__row.*"))
        output = self._write(made, "output") if isinstance(made, DataFrame) else None
        v = self.commit(seen.select(*keys, hash_col).dropDuplicates(), v, output)
        self._fs.delete(filesystem(self.spark, f"{self.folder}/{snapshot}")[1], True)
        return v

    def vacuum(self, older_than_ms: int = 7 * 86_400_000) -> list[str]:
        """Deletes tables that no marker of the last two versions, and no output, names and that are older than any running job."""
        top = self.version()
        said = [(k, x, v) for v in range(1, top + 1) for k, x in self.committed(v).items() if k == "output" or v > top - 2]
        named = {x for _, xs, _ in said for x in (xs if isinstance(xs, list) else [xs])}
        gone = []
        for s in self._fs.listStatus(filesystem(self.spark, self.folder)[1]):
            name = s.getPath().getName()
            if name.split("-")[0] in ("state", "output", "snapshot", "delta") and name not in named and s.getModificationTime() < time.time() * 1000 - older_than_ms:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone


def _plain(uri: str) -> str:
    return uri[5:].replace("//", "/", 1) if uri.startswith("file:") else uri


def passage_state(vec_files: DataFrame, index_runs: DataFrame) -> DataFrame:
    """(file, content_hash) of files whose row of the greatest successful run is complete. Late and repeated rows don't matter: the order is that of runs; of several rows of one run the last committed counts."""
    ok = F.broadcast(index_runs.filter(F.col("status") == "ok").select("run_id"))  # one row per run of the indexer, not per file
    last = (
        vec_files.join(ok, "run_id")
        .groupBy("file")
        .agg(F.max(F.struct("run_id", "committed_at", "upto", "total", "sig")).alias("last"))
        .select("file", "last.*")
    )
    return last.filter(F.col("upto") >= F.col("total")).select("file", content_hash(F.col("sig")).alias("content_hash"))


def passage_candidates(files: DataFrame, content_map: DataFrame) -> DataFrame:
    """Files that belong into the passage index, with the hash of the signature they have now."""
    title = F.regexp_replace("name", r"(?s)^(.+)\.[^.]*$", "$1")
    sig = F.concat_ws(
        ":", F.col("size").cast("string"), F.col("mtime").cast("string"), F.col("content_len").cast("string"), title,
        F.lit("text"), F.coalesce(F.col("hash"), F.concat(F.lit("#"), F.col("text").cast("string"))),
    )
    f = files.filter(~F.col("is_dir") & (F.col("content_state") == 1) & (F.col("content_len") > 0)).select("id", "name", "size", "mtime", "content_len")
    return f.join(content_map.select("id", "text", "hash"), "id").select(F.col("id").alias("file"), content_hash(sig).alias("content_hash"))


def identity_hash() -> Column:
    return content_hash(*[F.col(c) for c in ("size", "mtime", "ctime_ms")])


STATE = "stage string, a bigint, b bigint, content_hash string"


def done(vec_files: DataFrame, index_runs: DataFrame, ocr_cache: DataFrame, ocr_version: int = 1) -> DataFrame:
    """(stage, a, b, content_hash): what earlier runs have finished, as state. Keys are (file, 0) of passages and (dev, ino) of scans."""
    passages = passage_state(vec_files, index_runs).select(F.lit("passages").alias("stage"), F.col("file").alias("a"), F.lit(0).cast("bigint").alias("b"), "content_hash")
    cached = ocr_cache.filter((F.col("version") == ocr_version) & F.col("dev").isNotNull() & F.col("ino").isNotNull())
    return passages.unionByName(cached.select(F.lit("ocr").alias("stage"), F.col("dev").alias("a"), F.col("ino").alias("b"), identity_hash().alias("content_hash")))


def wanted(files: DataFrame, content_map: DataFrame) -> DataFrame:
    """(stage, a, b, content_hash, file) of all that the stages keep up to date, as it is now."""
    passages = passage_candidates(files, content_map).select(F.lit("passages").alias("stage"), F.col("file").alias("a"), F.lit(0).cast("bigint").alias("b"), "content_hash", "file")
    scans = files.filter(F.col("kind").isin("image", "pdf") & F.col("content_state").isin(1, 4))
    return passages.unionByName(scans.select(F.lit("ocr").alias("stage"), F.col("dev").alias("a"), F.col("ino").alias("b"), identity_hash().alias("content_hash"), F.col("id").alias("file")))


def due(files: DataFrame, content_map: DataFrame, state: DataFrame) -> DataFrame:
    """(stage, file) of all files that the next run has to read, for passages and for character recognition: what is wanted now and isn't in the state with the same hash."""
    return changed_rows(wanted(files, content_map), state, ["stage", "a", "b"]).select("stage", "file").distinct()
