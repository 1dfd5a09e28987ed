"""Hashing, copying and moving files where they lie."""

from __future__ import annotations

import errno
import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.sources.listing import file_system

CHUNK_BYTES = 4 * 1024 * 1024


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes or text in lower-case hex."""
    return F.sha2(content, 256)


def _digest(path: str) -> str:
    system, inner = file_system(path)
    with system.open_input_stream(inner, compression=None) as file:
        hasher = hashlib.sha256()
        while chunk := file.read(CHUNK_BYTES):
            hasher.update(chunk)
        return hasher.hexdigest()


def hash_files(files: DataFrame) -> DataFrame:
    """``(path, new_hash)`` of files read in chunks by the tasks; null where reading fails.

    Paths are on a shared mount or URIs of any store that pyarrow reads.

    Hand in only the files that have no hash yet. Paths are spread over all tasks first, as a
    listing tends to keep the large files of one folder together.
    """

    def digest(path: str) -> str | None:
        try:
            return _digest(path)
        except OSError:
            return None

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "new_hash": batch["path"].map(digest)})

    return files.select("path").repartition("path").mapInPandas(hashed, "path string, new_hash string")


def _copy(source: str, target: str) -> None:
    """Copy with timestamps under a passing name and link it to the target, which must not exist.

    A repeated task finds its own copy, told by size and hash, and leaves it; any other file at the
    target stays as it is, and the copy fails.
    """
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if _done_before(source, target):
        return
    passing = f"{target}.{uuid.uuid4().hex}.partial"
    try:
        shutil.copy2(source, passing)
        os.link(passing, target)
    finally:
        if os.path.lexists(passing):
            os.unlink(passing)


def _done_before(source: str, target: str) -> bool:
    """True if the target is a copy of the source; an error if it is another file."""
    if not os.path.lexists(target):
        return False
    if os.path.samefile(source, target):
        return True
    if os.path.getsize(source) == os.path.getsize(target) and _digest(source) == _digest(target):
        return True
    raise FileExistsError(errno.EEXIST, os.strerror(errno.EEXIST), target)


def _move(source: str, target: str) -> None:
    """Move to a name that is free; a repeated task goes on where the first one stopped."""
    if os.path.exists(source):
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if not _done_before(source, target):
            try:
                os.link(source, target)
            except OSError as trouble:
                if trouble.errno not in (errno.EXDEV, errno.EPERM, errno.ENOTSUP):
                    raise
                _copy(source, target)
        os.unlink(source)
    elif not os.path.exists(target):
        raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), source)


def _found(place: str) -> fs.FileInfo:
    system, path = file_system(place)
    return system.get_file_info(path)


def _store_copy(source: str, target: str) -> None:
    """Copy between any stores that pyarrow reads and writes, in chunks, to a name that must be free.

    The copy is written under a passing name and takes its own when it is whole and the name still free.
    A repeated task accepts a target with the source's size and hash. A plan names each target once, so
    no two tasks want one name; where a store cannot rename exclusively, another program that creates
    the same name in that very moment is not seen.
    """
    origin = _found(source)
    if origin.type != fs.FileType.File:
        raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), source)
    if _store_has(source, target):
        return
    (system, path), (goal, place) = file_system(source), file_system(target)
    goal.create_dir(place.rsplit("/", 1)[0], recursive=True)
    passing = f"{place}.{uuid.uuid4().hex}.partial"
    try:
        with system.open_input_stream(path, compression=None) as file, goal.open_output_stream(passing, compression=None) as out:
            while chunk := file.read(CHUNK_BYTES):
                out.write(chunk)
        if goal.get_file_info(passing).size != origin.size:
            raise OSError(errno.EIO, "the source changed while it was copied", source)
        if not _store_has(source, target):
            goal.move(passing, place)
    finally:
        if goal.get_file_info(passing).type != fs.FileType.NotFound:
            goal.delete_file(passing)


def _store_has(source: str, target: str) -> bool:
    """True if the target is a copy of the source; an error if it is something else."""
    there = _found(target)
    if there.type == fs.FileType.NotFound:
        return False
    if there.type == fs.FileType.File and there.size == _found(source).size and _digest(source) == _digest(target):
        return True
    raise FileExistsError(errno.EEXIST, os.strerror(errno.EEXIST), target)


def _store_move(source: str, target: str) -> None:
    if source == target:
        return
    if _found(source).type == fs.FileType.File:
        _store_copy(source, target)
        system, path = file_system(source)
        system.delete_file(path)
    elif _found(target).type != fs.FileType.File:
        raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), source)


def _copy_anywhere(source: str, target: str) -> None:
    (_store_copy if "://" in source or "://" in target else _copy)(source, target)


def _move_anywhere(source: str, target: str) -> None:
    (_store_move if "://" in source or "://" in target else _move)(source, target)


def _carried_out(plan: DataFrame, source: str, target: str, action, done: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = []
            for origin, place in zip(batch[source], batch[target]):
                try:
                    action(origin, place)
                    outcomes.append((done, None))
                except OSError as trouble:
                    outcomes.append(("failed", str(trouble)))
            result = pd.DataFrame(outcomes, columns=["outcome", "error"]).astype(object)
            yield pd.concat([batch[[target]].reset_index(drop=True), result], axis=1)

    pairs = plan.select(source, target).repartition(target)
    return pairs.mapInPandas(run, f"{target} string, outcome string, error string")


def copy_files(plan: DataFrame, source: str = "source_path", target: str = "archive_path") -> DataFrame:
    """Carry out a finished plan: ``copied`` or ``failed`` per target path.

    The plan has to be a written table, so that a repeated task copies to the same places. Paths are
    on a shared mount, where timestamps are kept, or URIs of any store that pyarrow reads and writes.
    """
    return _carried_out(plan, source, target, _copy_anywhere, "copied")


def move_files(plan: DataFrame, source: str = "archive_path", target: str = "new_archive_path") -> DataFrame:
    """Carry out planned moves, on a mount or any store: ``moved`` or ``failed`` per target path."""
    return _carried_out(plan, source, target, _move_anywhere, "moved")
