"""Binary files in the shared folder, written and read by executors.

A writer names each file afresh, and only the names that its finished task
returned count: what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def writing(folder: str, suffix: str) -> Iterator[tuple]:
    """(stream, address) of a new file in ``folder``."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield out, f"{folder}/{name}"


def reading(address: str):
    system, path = fs.FileSystem.from_uri(address)
    return system.open_input_stream(path, compression=None)


def read_all(address: str) -> bytes:
    with reading(address) as s:
        return s.read()


def write(address: str, data: bytes) -> None:
    """A file of a given name, for what comes out alike however often a task runs."""
    system, path = fs.FileSystem.from_uri(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def remove(address: str) -> None:
    """Delete a folder of intermediate files, if it is there."""
    system, path = fs.FileSystem.from_uri(address)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
