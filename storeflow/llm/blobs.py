"""Files in the shared folder, written and range-read inside tasks.

A task writes under a fresh name and reports it in its result rows; only
names in the committed table of those rows are ever read, so a task that
runs twice (lost executor, speculation) leaves at most an unread file.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def filesystem(uri: str):
    """``(filesystem, path)`` of a URI that pyarrow knows (file, hdfs, s3,
    gs, abfs); a bare path is local."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return pafs.LocalFileSystem(), uri


def new_file(folder: str, suffix: str) -> str:
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def open_write(uri: str):
    fs, path = filesystem(uri)
    return fs.open_output_stream(path, compression=None)


def open_read(uri: str):
    """A file with ``seek``, ``tell``, ``read`` and ``size``."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)
