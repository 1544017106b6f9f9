"""Whole files in the shared folder, written and read by tasks through pyarrow's file systems.

A file is written under a name of its own attempt and moved to its final name when it is complete, so a task that runs
again (a lost executor, speculation) leaves one whole file with the same content.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def write(folder: str, name: str, parts: list[bytes]) -> None:
    system, path = at(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        for p in parts:
            out.write(p)
    system.move(draft, f"{path}/{name}")


def read(folder: str, name: str) -> bytes:
    system, path = at(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


def remove(folder: str) -> None:
    system, path = at(folder)
    system.delete_dir(path)
