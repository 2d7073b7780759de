"""Stored analyses as Parquet files under a versioned manifest: runs, the file index and checkpoints of a commit become visible at once.

Tasks write files that nobody reads yet; the commit then claims the next version's manifest, a file that can be made once only. A writer that finds
the version taken reads the newer manifest, puts its own files on top and tries again, so writers at the same time lose nothing; one
that fails, or is stopped, leaves no trace in any version. Runs and checkpoints are added, the index of each repository that a commit brings is
replaced. A manifest names all files of its version.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..schema import CHECKPOINTS, RUNS
from ..streaming.events import latest_checkpoints
from ..streaming.log import opened

TABLES = {"runs": RUNS + ", repo_id string", "files": "path string, content_hash string, repo_id string", "checkpoints": CHECKPOINTS}
#: All columns of the three tables, and the one that says which.
WHOLE = "part string, repo_id string, id string, generated_at string, payload string, path string, content_hash string, run_id string, seq long, updated_at string, state string"
ROWS, SALTS, MOST_TRIES = 50_000, 16, 1_000


def fields(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in TABLES[table].split(", ")]


def newest(folder: str) -> dict:
    """The last manifest; an empty one of version 0 where there is none."""
    where, path = opened(folder)
    found = where.get_file_info(fs.FileSelector(f"{path}/manifests", allow_not_found=True))
    names = [f.base_name for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")]
    if not names:
        return {"version": 0, "runs": [], "checkpoints": [], "files": {}}
    with where.open_input_stream(f"{path}/manifests/{max(names)}") as f:
        return json.loads(f.read())


def claim(folder: str, manifest: dict) -> bool:
    """Whether the manifest could be made that of its version. On a disk a link is made, which fails where the name exists; other systems move a
    file, which must refuse a name that exists, as Hadoop's does."""
    where, path = opened(folder)
    where.create_dir(f"{path}/manifests", recursive=True)
    name, own = f"{path}/manifests/{manifest['version']:010d}.json", f"{path}/manifests/.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as f:
        f.write(json.dumps(manifest).encode())
    try:
        if isinstance(where, fs.LocalFileSystem):
            os.link(own, name)
            os.unlink(own)
        elif where.get_file_info(name).type != fs.FileType.NotFound:
            return False
        else:
            where.move(own, name)
    except OSError:
        if where.get_file_info(name).type == fs.FileType.NotFound:
            raise
        where.delete_file(own)
        return False
    return True


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str]]  # table, repo_id, file


class StoreWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.batch = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        """Rows come sorted by table and repository; a file is made for each."""
        where, path = opened(self.folder)
        task, made, rows, at = TaskContext.get(), [], [], None
        writer = None

        def flush() -> None:
            nonlocal writer
            if not rows:
                return
            own = fields(at[0])
            kinds = pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in own])
            if writer is None:
                name = f"{path}/data/{self.batch}/{at[0]}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):05d}.parquet"
                where.create_dir(os.path.dirname(name), recursive=True)
                made.append((*at, name))
                writer = pq.ParquetWriter(name, kinds, filesystem=where, compression="zstd")
            writer.write_table(pa.Table.from_pylist([{c: r[c] for c, _ in own} for r in rows], schema=kinds))
            rows.clear()

        def end() -> None:
            nonlocal writer
            flush()
            if writer is not None:
                writer.close()
            writer = None

        for r in iterator:
            if at != (r["part"], r["repo_id"]):
                end()
                at = (r["part"], r["repo_id"])
            rows.append(r)
            if len(rows) >= ROWS:
                flush()
        end()
        return Written(made)

    def commit(self, messages: list) -> None:
        made = [f for m in messages if m is not None for f in m.files]
        for _ in range(MOST_TRIES):
            before = newest(self.folder)
            index: dict = {}
            for table, repo, name in made:
                if table == "files":
                    index.setdefault(repo, []).append(name)
            more = {t: before[t] + [name for table, _, name in made if table == t] for t in ("runs", "checkpoints")}
            if claim(self.folder, {"version": before["version"] + 1, "files": before["files"] | index, **more}):
                return
        raise RuntimeError("the store has been written to all the time")

    def abort(self, messages: list) -> None:
        where, path = opened(self.folder)
        if where.get_file_info(f"{path}/data/{self.batch}").type != fs.FileType.NotFound:
            where.delete_dir(f"{path}/data/{self.batch}")


class StoreSink(DataSource):
    """Option: path, the store's folder."""

    @classmethod
    def name(cls) -> str:
        return "tessera_store"

    def schema(self) -> str:
        return WHOLE

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StoreWriter(self.options["path"])


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.dataSource.register(StoreSink)

    def commit(self, runs: DataFrame | None = None, files: DataFrame | None = None, checkpoints: DataFrame | None = None) -> None:
        """One version with all that is given. runs: id, generated_at, payload, repo_id; files: repo_id, path, content_hash; checkpoints: run_id, seq, updated_at, state."""
        given = {"runs": runs, "files": files, "checkpoints": checkpoints}
        whole = []
        for table, df in given.items():
            if df is not None:
                own = {c for c, _ in fields(table)}
                whole.append(df.select(F.lit(table).alias("part"), *((F.col(c) if c in own else F.lit(None)).cast(k).alias(c) for c, k in (x.split() for x in WHOLE.split(", ")[1:]))))
        rows = reduce(DataFrame.unionByName, whole).withColumn("salt", F.pmod(F.xxhash64("path", "id", "run_id"), F.lit(SALTS)))
        dealt = rows.repartition("part", "repo_id", "salt").drop("salt").sortWithinPartitions("part", "repo_id")
        dealt.write.format("tessera_store").option("path", self.folder).mode("append").save()

    def append_run(self, repo_id: str, run_id: str, generated_at: str, payload: dict) -> None:
        self.commit(runs=self.spark.createDataFrame([(run_id, generated_at, json.dumps(payload, ensure_ascii=False), repo_id)], TABLES["runs"]))

    def replace_files(self, files: DataFrame) -> None:
        """Only the index of the repositories in files is replaced."""
        self.commit(files=files)

    def changed(self, files: DataFrame) -> DataFrame:
        """Files whose path and content aren't in the index."""
        return files.join(self.files().select("repo_id", "path", "content_hash"), ["repo_id", "path", "content_hash"], "left_anti")

    def version(self) -> int:
        return newest(self.folder)["version"]

    def _read(self, table: str, names: list[str]) -> DataFrame:
        where, _ = opened(self.folder)
        scheme = "file://" if isinstance(where, fs.LocalFileSystem) else ""
        return self.spark.read.schema(TABLES[table]).parquet(*(scheme + n for n in names)) if names else self.spark.createDataFrame([], TABLES[table])

    def runs(self) -> DataFrame:
        return self._read("runs", newest(self.folder)["runs"])

    def files(self) -> DataFrame:
        return self._read("files", [f for fs_ in newest(self.folder)["files"].values() for f in fs_])

    def checkpoints(self) -> DataFrame:
        return latest_checkpoints(self._read("checkpoints", newest(self.folder)["checkpoints"]))
