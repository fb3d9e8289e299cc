"""Binary files in the shared folder, written and read by executors."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs as pafs


def filesystem(uri: str):
    """The file system of a URI and the path on it."""
    return pafs.FileSystem.from_uri(uri)


class Committed:
    """A file that appears under its name only when it is whole.

    Each attempt of a task writes to a name of its own and then moves it into place, so a task that
    is repeated after the loss of an executor, or run twice, leaves one whole file.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{name}"
        self.temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def open_mapped(folder: str, name: str):
    """A memory-mapped file on a local or mounted file system, else a readable one."""
    found, base = filesystem(folder)
    path = f"{base}/{name}"
    if isinstance(found, pafs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path) if os.path.getsize(path) else pa.BufferReader(b"")
    return found.open_input_file(path)


def open_sequential(folder: str, name: str):
    found, base = filesystem(folder)
    return found.open_input_stream(f"{base}/{name}", compression=None)
