"""Files that tasks write to the shared folder and read from it, wherever that folder is."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, for a path or a URI of a local, HDFS or object store."""
    if (m := re.match(r"file:/*(/.*)", uri)) or uri.startswith("/"):
        return fs.LocalFileSystem(), m[1] if m else uri
    return fs.FileSystem.from_uri(uri)


class Written:
    """A file under a name of its own. An attempt that is repeated writes another file; what counts is the
    list of names that the finished tasks return."""

    def __init__(self, folder: str, name: str):
        where, path = filesystem(folder)
        where.create_dir(path, recursive=True)
        stem, dot, end = name.partition(".")
        name = f"{stem}-{uuid.uuid4().hex}{dot}{end}"
        self.uri, self.bytes = f"{folder.rstrip('/')}/{name}", 0
        self._out = where.open_output_stream(f"{path.rstrip('/')}/{name}", compression=None)

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        self._out.close()


def reading(uri: str):
    """A seekable stream of a file's bytes."""
    where, path = filesystem(uri)
    return where.open_input_file(path)
