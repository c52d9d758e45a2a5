"""Opening files where they are: local paths, and URIs of the file systems that Arrow knows (hdfs, s3, gs, file)."""

from __future__ import annotations

import re
from typing import BinaryIO

import pyarrow.fs as pafs


def open_file(path: str) -> BinaryIO:
    """A seekable file, opened where it is called: on the driver to plan, in the tasks to read."""
    if path.startswith("file:"):
        path = re.sub(r"^file:(//)?", "", path)
    if "://" not in path:
        return open(path, "rb")
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def file_size(path: str) -> int:
    with open_file(path) as f:
        return f.seek(0, 2)
