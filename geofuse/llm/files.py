"""Writing and reading binary files in the shared folder from tasks."""

from __future__ import annotations

import contextlib

from pyarrow import fs


def opened(uri: str):
    """The file system and path of a URI; file:, hdfs:, s3a: and the other schemes Arrow knows."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@contextlib.contextmanager
def written(uri: str, attempt: int):
    """A file that appears under its name once it is whole; an attempt that is lost leaves none that anything names."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{attempt}.part"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, path)


def reading(uri: str, seek: bool = False):
    system, path = opened(uri)
    return system.open_input_file(path) if seek else system.open_input_stream(path, compression=None)
