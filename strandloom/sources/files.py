"""Files of a folder as a data source ("folder"): read in batches or as a stream, written whole or not at all.

Register it with ``spark.dataSource.register(Folder)``. A row is a file: name (its path below the folder) and body. Folders are
local paths or URIs that pyarrow opens; on a cluster all machines must see them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "name string, body binary"
#: Folders below ``_STAGED`` hold what running writes have not committed; readers pass over names that begin with a low line or a dot.
_STAGED = "_staged"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str = "") -> list[tuple[int, str, int]]:
    """(time of the last change in nanoseconds, name, bytes) of the files at any depth below ``path``, in that order; a folder
    that is not there has none."""
    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    own = [(f.mtime_ns or 0, f.path[len(root) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File]
    return sorted(f for f in own if f[1].endswith(suffix) and not any(part[:1] in "_." for part in f[1].split("/")))


class Names(InputPartition):
    """Files that one task reads."""

    def __init__(self, names: list[str]) -> None:
        self.names = names


def dealt(files: list[tuple[int, str, int]], most: int) -> list[Names]:
    """Tasks of files whose bytes are at most ``most`` together; a larger file is a task of its own."""
    tasks: list[Names] = []
    room = 0
    for _, name, size in files:
        if not tasks or size > room:
            tasks.append(Names([]))
            room = most
        tasks[-1].names.append(name)
        room -= size
    return tasks


class _Reading:
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("bytesATask", 64 << 20))

    def read(self, partition: Names) -> Iterator[tuple]:
        files, root = _open(self.path)
        for name in partition.names:
            with files.open_input_stream(f"{root}/{name}") as f:
                yield name, f.read()


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Names]:
        return dealt(listed(self.path, self.suffix), self.most) or [Names([])]


class _Stream(_Reading, DataSourceStreamReader):
    """An offset is the last file seen in the order of (time, name). Files that are replaced count as new ones; a file must
    appear whole, as the writer below sees to."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path, self.suffix)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Names]:
        after, upto = (start["time"], start["name"]), (end["time"], end["name"])
        return dealt([f for f in listed(self.path, self.suffix) if after < f[:2] <= upto], self.most)


@dataclass
class Staged(WriterCommitMessage):
    """The folder of one try of a task, and the files in it."""

    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    """Each try of a task writes below a folder of its own; the driver moves the files of the tries that Spark accepted, by name.

    A failed, killed or repeated try so adds no file that a reader meets, whole or half; a try still being killed when the job is
    given up may leave files below ``_staged``. Names of files are
    unique; of rows with one name in different tasks one stays. Committing costs the driver a rename a file."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Staged:
        files, root = _open(self.path)
        folder, names = f"{root}/{_STAGED}/{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(folder, recursive=True)
        for row in rows:
            parts = row.name.split("/")
            if not row.name or any(p[:1] in ("", "_", ".") for p in parts):
                raise ValueError(f"not a name of a file: {row.name!r}")
            if len(parts) > 1:
                files.create_dir(f"{folder}/{'/'.join(parts[:-1])}", recursive=True)
            with files.open_output_stream(f"{folder}/{row.name}", compression=None) as f:
                f.write(bytes(row.body or b""))
            names.append(row.name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = _open(self.path)
        before = {name for _, name, _ in listed(self.path)} if self.overwrite else set()
        written = set()
        for done in messages:
            for name in dict.fromkeys(done.names if done else ()):
                if "/" in name:
                    files.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
                files.move(f"{done.folder}/{name}", f"{root}/{name}")
                written.add(name)
        for name in before - written:
            files.delete_file(f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/{_STAGED}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{_STAGED}/{self.job}")


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)
