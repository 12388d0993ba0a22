"""File systems by URI: local folders, s3, gs and hdfs."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a local path, and the path in it. An unknown scheme raises."""
    if uri.startswith("file:"):
        uri = uri.removeprefix("file:")
        uri = "/" + uri.lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def kind(fs: pafs.FileSystem, path: str) -> pafs.FileType:
    return fs.get_file_info(path).type


def read_text(uri: str) -> str | None:
    """A small file's text, None if there is no such file."""
    fs, path = open_fs(uri)
    if kind(fs, path) != pafs.FileType.File:
        return None
    with fs.open_input_file(path) as f:
        return f.read().decode()


def write_text(uri: str, text: str) -> None:
    """Written beside and moved into place."""
    fs, path = open_fs(uri)
    with fs.open_output_stream(path + ".new", compression=None) as f:
        f.write(text.encode())
    fs.move(path + ".new", path)
