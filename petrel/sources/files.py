"""Files behind the Python data sources: any store that pyarrow's file systems know, local paths included."""

from __future__ import annotations

import fnmatch
import os

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:/"):
        return fs.FileSystem.from_uri("file:///" + uri[6:].lstrip("/"))
    return fs.LocalFileSystem(), os.path.abspath(uri)


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = resolve(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(max(0, min(n, self.size - offset)))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def listed(uri: str, suffix: str) -> list[str]:
    """A file itself; the files of a directory that end in suffix, not its folders; or the matches of a pattern in the last part."""
    system, path = resolve(uri)
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    folder, name = os.path.split(path)
    if any(c in name for c in "*?["):
        found = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, name)]
    else:
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and i.base_name.lower().endswith(suffix)]
        elif info.type == fs.FileType.File:
            found = [path]
        else:
            raise FileNotFoundError(uri)
    return sorted(head + p for p in found)


def flag(options: dict, name: str, default: bool = False) -> bool:
    return str(options.get(name, default)).lower() in ("true", "1", "yes")
