"""Immutable versions behind a pointer that is published last.

A version is a folder of its own that nobody writes to again; readers of an older
version keep it.  Publishing creates one small pointer file under a new name: it
exists whole or not at all, and two writers never touch the same file.  The current
version is that of the pointer with the greatest name (time, then a random part).
Everything goes through the Hadoop file system of the path, so any store that the
cluster shares will do.
"""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..session import _hadoop_fs, path_exists


def new_id() -> int:
    """A positive 63-bit id that grows with time and needs no look at other ids."""
    return (time.time_ns() // 1_000_000) << 22 | secrets.randbits(22)


def _pointer_name() -> str:
    return f"{time.time_ns():020d}-{secrets.token_hex(8)}"


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; an existing one is an error."""
    fs, hpath = _hadoop_fs(spark, path)
    out = fs.create(hpath, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_small(spark: SparkSession, path: str) -> str:
    fs, hpath = _hadoop_fs(spark, path)
    stream = fs.open(hpath)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none when it does not exist.  Any other error is raised."""
    fs, hpath = _hadoop_fs(spark, path)
    if not fs.exists(hpath):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(hpath))


def point(spark: SparkSession, root: str, target: str) -> None:
    """Publishes ``target`` as the current value under ``root``."""
    write_small(spark, f"{root}/pointers/{_pointer_name()}", target)


def pointed(spark: SparkSession, root: str) -> str | None:
    """The current value under ``root``, if one was ever published."""
    names = [n for n in names_in(spark, f"{root}/pointers") if not n.startswith((".", "_"))]
    return read_small(spark, f"{root}/pointers/{names[-1]}") if names else None


def current(spark: SparkSession, root: str) -> str | None:
    """Path of the current version."""
    name = pointed(spark, root)
    return f"{root}/{name}" if name else None


def publish(spark: SparkSession, root: str, write: Callable[[str], object]) -> str:
    """Writes a new version with ``write(path)`` and points at it."""
    name = f"version-{_pointer_name()}"
    write(f"{root}/{name}")
    if not path_exists(spark, f"{root}/{name}"):
        raise RuntimeError(f"nothing was written to {root}/{name}")
    point(spark, root, name)
    return f"{root}/{name}"


def published(spark: SparkSession, root: str, write: Callable[[str], object], refresh: bool = False) -> str:
    """The current version, written first if there is none (or a new one is asked for)."""
    return (None if refresh else current(spark, root)) or publish(spark, root, write)
