"""Files by local path or a store's address, through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path's name in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def is_file(system: fs.FileSystem, name: str) -> bool:
    return system.get_file_info(name).type == fs.FileType.File
