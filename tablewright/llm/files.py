"""Byte access to files in shared storage from inside tasks."""

from __future__ import annotations

import re

from pyarrow import fs


def opened_by(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a plain path is local."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if ":/" in uri else (fs.LocalFileSystem(), uri)
