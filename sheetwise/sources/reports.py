"""Reports as files, ``<path>/<pair>/report.json`` for each pair: a Python data source with a writer that commits, and a partitioned reader.

Tasks write into a folder of the write job beside the reports; only what the job commits is moved to its place, so a failed or repeated task leaves nothing. Paths may be of any file system that Arrow knows (local or mounted, hdfs, s3, gs)."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

REPORT = "pair_id string, json string"
NAME = "report.json"
#: Reports read by one task.
PER_TASK = 64


def _files(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    return fs, system, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """(staged file, folder of the pair) of a task."""

    files: list[tuple[str, str]]


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, indent: int):
        self.path, self.overwrite, self.indent = path, overwrite, indent
        self.staging = f"_writing-{uuid.uuid4().hex}"
        _, system, root = _files(path)
        # Tasks make their folders in this one only, so one that is still at work when the job is given up makes none any more.
        system.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        _, system, root = _files(self.path)
        context = TaskContext.get()
        own = f"{root}/{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(own, recursive=False)
        files = []
        try:
            for k, row in enumerate(iterator):
                if row["pair_id"] is None or not str(row["pair_id"]).strip(". "):
                    raise ValueError("a report needs the name of its pair")
                text = json.dumps(json.loads(row["json"]), indent=self.indent or None)
                with system.open_output_stream(f"{own}/{k}.json") as out:
                    out.write(text.encode())
                files.append((f"{own}/{k}.json", quote(row["pair_id"], safe=" ")))
        except BaseException:
            with contextlib.suppress(OSError):  # the job has been given up
                system.delete_dir(own)
            raise
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, system, root = _files(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = {name for _, name in files}
        if len(names) != len(files):
            self.abort(messages)
            raise ValueError("a pair has two reports")
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.Directory and not info.base_name.startswith("_") and info.base_name not in names:
                    system.delete_dir(info.path)
        for staged, name in files:
            system.create_dir(f"{root}/{name}", recursive=True)
            system.move(staged, f"{root}/{name}/{NAME}")
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _, system, root = _files(self.path)
        self._clear(system, root)

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


@dataclass
class Pairs(InputPartition):
    names: list[str]


class ReportReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Pairs]:
        fs, system, root = _files(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith("_"))
        return [Pairs(names[a : a + PER_TASK]) for a in range(0, len(names), PER_TASK)] or [Pairs([])]

    def read(self, partition: Pairs) -> Iterator[tuple[str, str]]:
        _, system, root = _files(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}/{NAME}") as source:
                yield unquote(name), json.dumps(json.loads(source.read()), separators=(",", ":"), ensure_ascii=False)


class PairReports(DataSource):
    """Format ``pair_reports``: rows (pair_id, json). Option indent (2): of the files' JSON, 0 for none."""

    @classmethod
    def name(cls) -> str:
        return "pair_reports"

    def schema(self) -> str:
        return REPORT

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite, int(self.options.get("indent", 2)))

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options["path"])


def write_reports(reports: DataFrame, path: str) -> None:
    """reports (pair_id, json) as ``<path>/<pair>/report.json``; reports of other pairs that lie there go."""
    reports.sparkSession.dataSource.register(PairReports)
    reports.select("pair_id", "json").write.format("pair_reports").mode("overwrite").save(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PairReports)
    return spark.read.format("pair_reports").load(path)
