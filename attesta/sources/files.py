"""Small files in a folder that the driver and all tasks share, local or remote, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_whole(path: str, data: bytes) -> None:
    """A file that is there whole or not at all: written under another name and moved."""
    system, own = at(path)
    folder, _, name = own.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, own)


def read(path: str) -> bytes:
    system, own = at(path)
    with system.open_input_stream(own) as f:
        return f.read()


def names(folder: str, start: str) -> list[str]:
    """Paths of the files and folders in ``folder`` whose names begin with ``start``; none if it is not there."""
    system, own = at(folder)
    found = system.get_file_info(fs.FileSelector(own, allow_not_found=True))
    scheme = folder[: len(folder) - len(own.rstrip("/"))] if folder.rstrip("/").endswith(own.rstrip("/")) else ""
    return [scheme + x.path for x in found if x.base_name.startswith(start)]
