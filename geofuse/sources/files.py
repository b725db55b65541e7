"""Files of binary content: written by tasks, listed, and read in ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI: local paths, and the schemes that Arrow knows."""
    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:") if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of all files under a folder whose names end so, by name; hidden ones left out."""
    system, path = opened(uri)
    head = uri.removesuffix("/").removesuffix(path.removesuffix("/"))
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    fine = [f for f in found if f.type == fs.FileType.File and (f is info or f.base_name.endswith(suffix) and f.base_name[0] not in "._")]
    return sorted((head + f.path, f.size) for f in fine)


def save(contents: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's content to a file of its name in a folder: name, path, bytes.

    A file appears under its name when it is whole. An attempt that is run again writes the same file again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            out = []
            for own, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = f"{path}/.{own}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(data)
                system.move(part, f"{path}/{own}")
                out.append((own, f"{folder}/{own}", len(data)))
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(("name", "path", "bytes"))})

    return contents.select(name, content).mapInArrow(write, "name string, path string, bytes long")
