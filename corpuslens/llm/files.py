"""Files that executors write into, and read from, the folder they share, by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI; a bare path is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(folder: str, name: str) -> Iterator:
    """A stream for a file that gets its name only when it is whole.

    A task that runs twice (lost executor, speculation) writes under a name of its own each
    time and then renames, so readers see one whole file, whichever attempt made it.
    """
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(part) as out:
            yield out
        store.move(part, f"{path}/{name}")
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(part)
        raise


def reading(folder: str, name: str):
    """A seekable input file."""
    store, path = opened(folder)
    return store.open_input_file(f"{path}/{name}")
