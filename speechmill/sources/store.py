"""Files by path or URI, opened where a task runs: on any file system that all executors reach."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from typing import BinaryIO


def local_path(path: str) -> str | None:
    """The path of a local or mounted file; null for other schemes."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def reaches(path: str) -> bool:
    """Whether Python can open files there; if not, only Spark's readers can."""
    if local_path(path) is not None:
        return True
    try:
        _remote(path)
    except Exception:  # whatever a file system's client says: an unknown scheme, a missing library, no credentials
        return False
    return True


@contextlib.contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """A file to read from any place in it."""
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as f:
            yield f
        return
    system, inner = _remote(path)
    with system.open_input_file(inner) as f:
        yield f


@contextlib.contextmanager
def created(path: str) -> Iterator[BinaryIO]:
    """A file to write from its start; it appears under its name when it is whole, and a task that runs twice leaves one."""
    local = local_path(path)
    part = f"{local if local is not None else path}.{uuid.uuid4().hex}"
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(part, "wb") as f:
                yield f
            os.replace(part, local)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(part)
        return
    system, inner = _remote(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    hidden = _remote(part)[1]
    try:
        with system.open_output_stream(hidden) as f:
            yield f
    except BaseException:
        with contextlib.suppress(Exception):
            system.delete_file(hidden)
        raise
    system.move(hidden, inner)


def sizes(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder whose names end with ``suffix``, in order."""
    from pyarrow import fs

    local = local_path(path)
    system, inner = (fs.LocalFileSystem(), os.path.abspath(local)) if local is not None else _remote(path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and f.path.endswith(suffix)]
    prefix = "" if local is not None else path[: len(path) - len(inner.lstrip("/"))] if path.endswith(inner.lstrip("/")) else path.split("://")[0] + "://"
    return sorted((f"{prefix}{f.path.lstrip('/') if prefix else f.path}", f.size) for f in found)
