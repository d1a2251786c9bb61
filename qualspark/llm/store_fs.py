"""Files that tasks write and read by URI: any store pyarrow.fs knows (local, HDFS, S3, GCS)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator


def open_fs(uri: str):
    """(file system, path in it) of a URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def committed(uri: str) -> Iterator:
    """An output stream to a temporary name, moved to `uri` at the end: a task run twice leaves one whole file."""
    from pyarrow import fs as pafs

    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        yield out
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)


def read_range(source, start: int, length: int) -> bytes:
    """`length` bytes from `start` of an open random-access file."""
    got = source.read_at(length, start)
    if len(got) != length:
        raise EOFError(f"wanted {length} bytes at {start}, got {len(got)}")
    return got
