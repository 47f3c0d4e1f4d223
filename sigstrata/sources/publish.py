"""Files put in place whole: written beside the target, checked, and renamed, so that a reader sees the old file or the new."""

from __future__ import annotations

import fcntl
import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame

from sigstrata.sources import container


@contextmanager
def locked(target: str) -> Iterator[None]:
    """Holds the lock beside a target; the lock file stays, as another writer may wait on it."""
    with open(target + ".lock", "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def put(target: str, data: bytes, check: Callable[[bytes], object] | None = None) -> None:
    """Writes, syncs, checks and renames. check raises where the data must not be published."""
    if check:
        check(data)
    folder = os.path.dirname(target)
    mark = hashlib.sha256(os.path.basename(target).encode()).hexdigest()[:16]
    handle, name = tempfile.mkstemp(prefix=f".{mark}.", suffix=".tmp", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise
    folder_handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(folder_handle)
    finally:
        os.close(folder_handle)


def published(files: DataFrame, folder: str, extension: str = ".peaks") -> DataFrame:
    """(track_id, path, bytes) of caches (track_id, content) put under a folder that all executors mount.

    A name is the digest of the track's id, so that a task that runs again puts the same file again.
    """

    def run(batches):
        for b in batches:
            out = []
            for track, content in zip(b["track_id"], b["content"], strict=True):
                path = os.path.join(folder, hashlib.sha256(str(track).encode()).hexdigest()[:24] + extension)
                put(path, bytes(content), container.standard_end)
                out.append((track, path, len(content)))
            yield pd.DataFrame(out, columns=["track_id", "path", "bytes"])

    return files.select("track_id", "content").mapInPandas(run, "track_id string, path string, bytes long")


def update_file(path: str, action: str, namespace: bytes, kind: bytes, version: int = 1, flags: int = 0, payload: bytes = b"") -> tuple:
    """Edits the container of a file in place under its lock; refused where the file changed meanwhile. Returns REPORT."""
    with locked(path):
        before = os.stat(path)
        with open(path, "rb") as f:
            old = f.read()
        new = container.strip(old) if action == "strip" else container.edit(old, action, namespace, kind, version, flags, payload)
        report = container._report(old, new, payload if action in ("set", "append") else b"")
        if report[0]:
            now = os.stat(path)
            if (now.st_ino, now.st_size, now.st_mtime_ns) != (before.st_ino, before.st_size, before.st_mtime_ns):
                raise RuntimeError(f"{path} changed while it was edited")
            put(path, new, container.split)
        return report


def updated(edits: DataFrame) -> DataFrame:
    """(path, report) of edits (path, action, namespace, kind, version, flags, payload) of files that all executors mount.

    The edits of a file go in one task, in the order of a column ord where there is one.
    """
    columns = ["path", *[c.split()[0] for c in container.REPORT.split(", ")]]

    def run(batches):
        for b in batches:
            rows = [(r.path, *update_file(r.path, r.action, bytes(r.namespace), bytes(r.kind), int(r.version), int(r.flags), bytes(r.payload or b""))) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=columns)

    order = ["path", "ord"] if "ord" in edits.columns else ["path"]
    return edits.repartition("path").sortWithinPartitions(*order).mapInPandas(run, f"path string, {container.REPORT}")
