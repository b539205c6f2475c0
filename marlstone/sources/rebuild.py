"""ST-03: an index in versions, rebuilt by one writer at a time and extended by batches.

Below a root folder lie the tables of the index (``parts/<id>``), a log of commits and a lease. A commit is a small file with
the next number; it lists the parts that make up the index, and the last batch of each stream. Its file is made only if it is
not there, so of two writers of one number one fails and starts again from the newer commit. Readers take the highest number
and see one whole version. Parts that no kept commit lists, of writers that died, are removed by the next rebuild.

A rebuild holds the lease, again a file that is made only if it is not there; it names its owner and when it ends, so one that
a crashed writer left is taken over then. Hadoop's file systems make such files atomically, as do object stores with conditional
writes; on a local disk two drivers may meet between the look and the making, two threads of one driver don't.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table
from marlstone.sources.working import file_system, remove, shared_folder

KEEP = 5
LEASE_SECONDS = 6 * 3600
_ONE_AT_A_TIME = threading.Lock()


class Running(RuntimeError):
    """A rebuild holds the lease."""


class VersionedIndex:
    """``keep`` commits stay readable; older ones and their parts go with the next rebuild."""

    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP, lease_seconds: float = LEASE_SECONDS):
        self.spark, self.root, self.keep, self.lease_seconds = spark, root.rstrip("/"), keep, lease_seconds

    # files

    def _create(self, name: str, value: dict) -> bool:
        """A file with ``value``, if there is none of that name."""
        fs, p = file_system(self.spark, f"{self.root}/{name}")
        with _ONE_AT_A_TIME:
            try:
                out = fs.create(p, False)
            except Py4JJavaError as e:
                if "AlreadyExists" in str(e.java_exception) or fs.exists(p):
                    return False
                raise
            try:
                out.write(bytearray(json.dumps(value).encode()))
            finally:
                out.close()
        return True

    def _read(self, name: str) -> dict | None:
        """None if the file is not there or its writer hasn't ended."""
        fs, p = file_system(self.spark, f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else None

    def _names(self, folder: str) -> list[str]:
        fs, p = file_system(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    # commits

    def commits(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("commits") if n.endswith(".json")]

    def latest(self) -> tuple[int, dict]:
        """Number and content of the newest commit; 0 and an empty one where there is none."""
        for number in reversed(self.commits()):
            found = self._read(f"commits/{number:012d}.json")
            if found is not None:
                return number, found
        return 0, {"parts": [], "streams": {}}

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """The number of the commit that ``change`` makes of the newest one; None leaves that as it is. If another writer was
        first, the change is made again on its commit."""
        while True:
            number, before = self.latest()
            after = change(before)
            if after is None:
                return number
            if self._create(f"commits/{number + 1:012d}.json", after):
                return number + 1

    def _write(self, rows: DataFrame) -> str:
        name = f"parts/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def read(self, number: int | None = None) -> DataFrame | None:
        """A commit's index, the newest by default; None before the first."""
        found = self.latest()[1] if number is None else self._read(f"commits/{number:012d}.json")
        if not found or not found["parts"]:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{p}") for p in found["parts"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    # writers

    def append(self, rows: DataFrame, batch: int | None = None, stream: str = "stream") -> int:
        """Adds rows as a part of the index; a batch of a stream that is committed already changes nothing, so a batch that runs
        again after a crash counts once."""
        if batch is not None and self.latest()[1]["streams"].get(stream, -1) >= batch:
            return self.latest()[0]
        part = self._write(rows)

        def add(before: dict) -> dict | None:
            if batch is not None and before["streams"].get(stream, -1) >= batch:
                return None
            streams = before["streams"] if batch is None else before["streams"] | {stream: batch}
            return {"parts": [*before["parts"], part], "streams": streams}

        return self._commit(add)

    def _take_lease(self) -> str:
        owner, now = uuid.uuid4().hex, time.time()
        fs, p = file_system(self.spark, f"{self.root}/lease.json")
        for _ in range(2):
            if self._create("lease.json", {"owner": owner, "until": now + self.lease_seconds}):
                return owner
            held = self._read("lease.json")
            # a lease without content is one that is just being made, unless its file is old
            made = fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else now
            if (held["until"] if held else made + self.lease_seconds) > now:
                break
            # whoever moves it away may take it
            if not fs.rename(p, file_system(self.spark, f"{self.root}/lease-{uuid.uuid4().hex}.old")[1]):
                break
        raise Running("a rebuild is running")

    def rebuild(self, build: Callable[[], DataFrame]) -> dict:
        """Builds the whole index anew and puts it in the place of all parts; the outcome is ``status()`` too. A second rebuild
        meanwhile raises ``Running``. If ``build`` fails or gives no rows, the index stays as it was. Batches that were committed
        before the rebuild's own commit are taken to be in what it read; the streams' marks stay."""
        owner = self._take_lease()
        state = {"status": "running", "started_at": time.time(), "finished_at": None, "result": None, "error": None}
        self._set(state)
        try:
            part = self._write(build())
            rows = self.spark.read.parquet(f"{self.root}/{part}").count()
            if not rows:
                raise RuntimeError("no documents were found")
            held = self._read("lease.json")
            if not held or held["owner"] != owner:
                raise Running("the lease has gone to another rebuild")
            number = self._commit(lambda before: {"parts": [part], "streams": before["streams"]})
            state |= {"status": "completed", "result": {"rows": rows, "commit": number}}
            self._clean()
        except Exception as e:
            state |= {"status": "failed", "error": str(e)}
            raise
        finally:
            state["finished_at"] = time.time()
            self._set(state)
            held = self._read("lease.json")
            if held and held["owner"] == owner:
                remove(self.spark, f"{self.root}/lease.json")
        return state

    def _set(self, state: dict) -> None:
        self._create(f"states/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", state)

    def status(self) -> dict:
        """idle, running, completed or failed, with times, result and error of the last rebuild. One that is running beyond its
        lease has failed."""
        names = self._names("states")
        state = self._read(f"states/{names[-1]}") if names else None
        if state is None:
            return {"status": "idle", "started_at": None, "finished_at": None, "result": None, "error": None}
        if state["status"] == "running" and state["started_at"] + self.lease_seconds < time.time():
            return state | {"status": "failed", "error": "its lease has ended"}
        return state

    def _clean(self) -> None:
        """Drops commits before the newest ``keep``, and parts older than the lease that no commit names."""
        numbers = self.commits()
        remove(self.spark, *[f"{self.root}/commits/{n:012d}.json" for n in numbers[: -self.keep]])
        named = {p for n in numbers[-self.keep :] for p in (self._read(f"commits/{n:012d}.json") or {"parts": []})["parts"]}
        fs, p = file_system(self.spark, f"{self.root}/parts")
        old = (time.time() - self.lease_seconds) * 1000
        gone = [s.getPath().getName() for s in fs.listStatus(p) if s.getModificationTime() < old]
        remove(self.spark, *[f"{self.root}/parts/{n}" for n in gone if f"parts/{n}" not in named])
        states = self._names("states")
        remove(self.spark, *[f"{self.root}/states/{n}" for n in states[: -4 * self.keep]])


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """Documents as a stream into an index that was rebuilt from the turns first; the first batch comes twice."""
    from marlstone.streaming.jobs import ingest, read_log

    folder = f"{shared_folder(s)}/index-{uuid.uuid4().hex[:12]}"
    index = VersionedIndex(s, folder)
    turns = table(s, d, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").cast("string").alias("key"), "text")
    index.rebuild(lambda: turns)
    docs = read_log(s, f"{d}/documents.parque[t]", table(s, d, "documents").schema).select(F.lit("document").alias("kind"), F.col("source").alias("key"), "text")

    def twice(batch: DataFrame, number: int) -> None:
        index.append(batch, number)
        index.append(batch, number)

    ingest(docs, twice, f"{folder}/checkpoint")
    return index.read().groupBy("kind", "key").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


QUERIES = {"st03_versioned_index": _ingested}
ORACLE_SQL = {
    "st03_versioned_index": "SELECT 'turn' AS kind, CAST(conv_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id UNION ALL SELECT 'document', source, count(*), CAST(sum(length(text)) AS BIGINT) FROM documents GROUP BY source"
}
