"""Text files by name as data sources: cookie jars, page scripts, script files; and a sink that writes such files once.

A name is a file's name without its suffix. Small files share a partition; filters on the name choose files before any is
opened. Tasks write into a folder of their own; only the attempt that counts is moved into place when all are done, so a task
that runs twice writes once, and a job that fails leaves nothing. Classes go to workers by value and import what they
need there. Paths are read with pyarrow's file systems, so any store they know will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats, what a row of each is, and the suffix of its files.
FORMATS = {
    "arborfold_jars": ("profile string, seq long, line string", ".jar"),
    "arborfold_scripts": ("script string, line int, op string, args array<string>, error string", ".txt"),
    "arborfold_script_files": ("name string, body string", ".js"),
}


def _source(kind: str, schema_text: str, suffix: str) -> type:
    import os
    from urllib.parse import quote, unquote

    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

    name_field = schema_text.split()[0]

    class Files(InputPartition):
        def __init__(self, files: list[tuple[str, str]]):
            self.files = files

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path, self.most, self.names = options["path"], int(options.get("partitionbytes", 16 << 20)), None

        def pushFilters(self, filters: list) -> list:
            left = []
            for f in filters:
                if isinstance(f, (EqualTo, In)) and f.attribute == (name_field,):
                    asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.names = asked if self.names is None else self.names & asked
                else:
                    left.append(f)
            return left

        def partitions(self) -> list:
            """Files by name, the latest run of each, some megabytes together; with a filter on names those alone."""
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + os.path.abspath(self.path))
            latest: dict[str, tuple] = {}
            for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                inner = f.path[len(root.rstrip("/")) + 1 :]
                if f.type != fs.FileType.File or not f.base_name.endswith(suffix) or inner.startswith(("_", ".")):
                    continue
                name = unquote(f.base_name[: -len(suffix)])
                if (self.names is None or name in self.names) and (name not in latest or latest[name][0] < inner):
                    latest[name] = inner, f.path, f.size
            found, size = [[]], 0
            for name, (_, path, n) in sorted(latest.items()):
                if found[-1] and size + n > self.most:
                    found.append([])
                    size = 0
                found[-1].append((name, path))
                size += n
            return [Files(files) for files in found]

        def read(self, partition: InputPartition):
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + os.path.abspath(self.path))
            for name, path in partition.files:
                with store.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
                if kind == "arborfold_script_files":
                    yield name, text
                elif kind == "arborfold_jars":
                    for k, line in enumerate(text.split("\n")):
                        if line:
                            yield name, k, line
                else:
                    from arborfold.operators import scripts

                    try:
                        for s in scripts.parse(text):
                            yield name, s.line, s.op, list(s.args), None
                    except scripts.ScriptError as e:
                        yield name, int(str(e).split(":")[0]), None, None, str(e)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return schema_text

        def reader(self, schema):
            return Reader(dict(self.options))

        def writer(self, schema, overwrite: bool):
            return _writer(dict(self.options), suffix, overwrite, quote)

    return Source


def _writer(options: dict, suffix: str, overwrite: bool, quote):
    import os
    import time
    import uuid
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

    @dataclass
    class Done(WriterCommitMessage):
        folder: str | None

    class Writer(DataSourceWriter):
        """Rows (name, line): a file a name, lines in the order they come. The rows of a name must stand together."""

        def __init__(self) -> None:
            self.path = options["path"] if "://" in options["path"] else "file://" + os.path.abspath(options["path"])
            self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

        def _store(self):
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.path)
            return store, root.rstrip("/")

        def write(self, iterator):
            from pyspark import TaskContext

            store, root = self._store()
            task, folder, name, out, seen = TaskContext.get(), None, None, None, set()
            for row in iterator:
                if folder is None:
                    folder = f"{root}/_staged-{self.run}/{task.partitionId():06d}-{task.taskAttemptId()}"
                    store.create_dir(folder, recursive=True)
                if out is None or row[0] != name:
                    if out is not None:
                        out.close()
                    name = row[0]
                    if name is None or name in seen:
                        raise ValueError("a file needs a name" if name is None else f"rows of {name!r} don't stand together")
                    seen.add(name)
                    out = store.open_output_stream(f"{folder}/{quote(name, safe='')}{suffix}")
                out.write((row[1] + "\n").encode() if row[1] is not None else b"")
            if out is not None:
                out.close()
            return Done(folder)

        def commit(self, messages) -> None:
            """One move a task; what else lies in the run's folder is of attempts that don't count."""
            from pyarrow import fs

            store, root = self._store()
            if overwrite:
                for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                    if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")):
                        store.delete_dir(f.path)
            for m in messages:
                if m is not None and m.folder:
                    store.move(m.folder, f"{root}/{self.run}-{m.folder.rsplit('/', 1)[1].split('-')[0]}")
            self.abort(messages)

        def abort(self, messages) -> None:
            from pyarrow import fs

            store, root = self._store()
            staged = f"{root}/_staged-{self.run}"
            if store.get_file_info(staged).type == fs.FileType.Directory:
                store.delete_dir(staged)

    return Writer()


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind, (schema, suffix) in FORMATS.items():
        spark.dataSource.register(_source(kind, schema, suffix))


def read(spark: SparkSession, kind: str, path: str, **options: object) -> DataFrame:
    """Files under ``path`` by format: ``jars`` (profile, seq, line), ``scripts`` (script, line, op, args, error: the steps, or
    one row with what is wrong) or ``script_files`` (name, body)."""
    register(spark)
    return spark.read.format(f"arborfold_{kind}").options(**options).load(path)


def write(rows: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """A file for each name of ``rows`` (name, seq, line) under ``path``, lines in the order of seq. Names that are there
    already count by their latest run; null names are refused."""
    register(rows.sparkSession)
    ordered = rows.select("name", "seq", "line").repartition("name").sortWithinPartitions("name", "seq").select("name", "line")
    ordered.write.format(f"arborfold_{kind}").mode(mode).save(path)


def jar_rows(outcomes: DataFrame) -> DataFrame:
    """The jars of ``scripts.outcomes`` as rows of ``write``, of tabs that failed too: each tab's once."""
    from ..operators import cookies

    kind = "array<struct<name: string, value: string, domain: string, path: string, secure: boolean, host_only: boolean, http_only: boolean>>"
    each = outcomes.select(F.col("tab").alias("profile"), F.posexplode(F.from_json("jar", kind)).alias("seq", "c"))
    return cookies.to_lines(each.select("profile", F.col("seq").cast("long").alias("seq"), "c.*")).withColumnRenamed("profile", "name")
