"""Files as rows and rows as files: a reader planned by size over several roots, and a writer that commits in two phases.

spark.dataSource.register(Documents), then spark.read.format("vellum_documents").option("paths", json.dumps([...])).load(), or
readStream with a `log`; spark.dataSource.register(Folders), then df.write.format("vellum_folders").mode("append").save(root).
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a partition's files, about.
PARTITION_BYTES = 128 << 20
FILE = "path string, doc_id string, length bigint, content binary, error string"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def listed(uris: list[str], pattern: str) -> list[tuple[str, int]]:
    """(uri, size) of all files, each once and sorted: a root that is a file, and files below a folder whose name fits. A missing root is an error."""
    found = {}
    for uri in uris:
        store, path = store_of(uri)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        head = uri[: uri.index("://") + 3] if "://" in uri else "file://"
        for x in infos:
            if x.type == fs.FileType.File and (x.path == path or fnmatch.fnmatch(x.base_name, pattern)):
                own = x.path if x.path.startswith("/") else f"{uri.removeprefix(head).split('/')[0]}/{x.path.split('/', 1)[-1]}"
                found[head + own] = x.size
    return sorted(found.items())


class Files(InputPartition):
    def __init__(self, uris: list[str]):
        super().__init__(0)
        self.uris = uris


def planned(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in their order, cut into partitions of about `most` bytes; a larger one is a partition of its own."""
    parts, size = [], 0
    for uri, n in files:
        if not parts or size + n > most:
            parts.append([])
            size = 0
        parts[-1].append(uri)
        size += n
    return [Files(p) for p in parts]


def contents(part: Files) -> Iterator[tuple]:
    """A row for each file; one that can't be read is a row with `error`."""
    for uri in part.uris:
        try:
            store, path = store_of(uri)
            with store.open_input_stream(path) as f:
                raw = f.read()
        except OSError as e:
            yield uri, None, None, None, f"{type(e).__name__}: {e}"
            continue
        yield uri, hashlib.sha256(raw).hexdigest(), len(raw), raw, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        # no files are a partition without any
        return planned(listed(json.loads(self.options["paths"]), self.options.get("pattern", "*")), int(self.options.get("partition_bytes", PARTITION_BYTES))) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return contents(partition)


class _Stream(DataSourceStreamReader):
    """Offsets count the lists in `log`, each of the files that were new when somebody looked: a file is in one of them, whatever its time."""

    def __init__(self, options: dict):
        self.options = options

    def _lists(self, after: int = 0, upto: int | None = None) -> Iterator[tuple[int, list]]:
        store, path = store_of(self.options["log"])
        store.create_dir(path, recursive=True)
        n = after
        while upto is None or n < upto:
            n += 1
            if store.get_file_info(f"{path}/{n:012d}.json").type != fs.FileType.File:
                return
            with store.open_input_stream(f"{path}/{n:012d}.json") as f:
                yield n, [tuple(x) for x in json.loads(f.read())]

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        last, known = 0, set()
        for n, files in self._lists():
            last = n
            known.update(uri for uri, _ in files)
        new = [x for x in listed(json.loads(self.options["paths"]), self.options.get("pattern", "*")) if x[0] not in known]
        if new:
            store, path = store_of(self.options["log"])
            last += 1
            started = f"{path}/.{uuid.uuid4().hex}"
            with store.open_output_stream(started) as f:
                f.write(json.dumps(new).encode())
            store.move(started, f"{path}/{last:012d}.json")
        return {"lists": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [x for _, found in self._lists(start["lists"], end["lists"]) for x in found]
        return planned(files, int(self.options.get("partition_bytes", PARTITION_BYTES))) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return contents(partition)

    def commit(self, end: dict) -> None:
        pass


class Documents(DataSource):
    """FILE rows. Options: paths, a JSON list of files and folders; pattern of names; partition_bytes; log, a folder, for streams."""

    @classmethod
    def name(cls) -> str:
        return "vellum_documents"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    folders: set = field(default_factory=set)


class _Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def _folder(self, path: str, doc_id: str, version: int) -> str:
        return f"{path}/{doc_id}/.v{version}-{self.job}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        (store, path), out = store_of(self.root), Staged()
        for r in rows:
            folder = self._folder(path, r.doc_id, r.version)
            store.create_dir(folder, recursive=True)
            # another attempt of this task writes the same files
            started = f"{folder}/.{r.file_name.replace('/', '_')}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(started) as f:
                f.write(r.content.encode() if isinstance(r.content, str) else bytes(r.content or b""))
            final = f"{folder}/{r.file_name}"
            store.create_dir(final.rsplit("/", 1)[0], recursive=True)
            store.move(started, final)
            out.folders.add((r.doc_id, r.version))
        return out

    def commit(self, messages: list[Staged]) -> None:
        """Each version's folder gets its name when all its files are there; what a version had before is removed."""
        store, path = store_of(self.root)
        folders = sorted(set().union(*(m.folders for m in messages if m is not None)))

        def publish(of: tuple) -> None:
            doc_id, version = of
            final = f"{path}/{doc_id}/v{version}"
            if store.get_file_info(final).type == fs.FileType.Directory:
                store.delete_dir(final)
            store.move(self._folder(path, doc_id, version), final)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(publish, folders))

    def abort(self, messages: list) -> None:
        """Nothing of the job stays, whatever tasks have written."""
        store, path = store_of(self.root)
        if store.get_file_info(path).type == fs.FileType.Directory:
            for doc in store.get_file_info(fs.FileSelector(path)):
                for x in store.get_file_info(fs.FileSelector(doc.path)) if doc.type == fs.FileType.Directory else []:
                    if x.base_name.endswith(self.job):
                        store.delete_dir(x.path)


class Folders(DataSource):
    """Rows (doc_id, version, file_name, content) as root/doc_id/v<version>/file_name; a version is there whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "vellum_folders"

    def schema(self) -> str:
        return "doc_id string, version int, file_name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
