"""Binary records and rasters: fixed strides and strips, decoded in batches by numpy inside tasks.

Point files are read in ranges of bytes by a data source of their own (PlySource), whatever their size. Other files are one
row each of a binary table (`spark.read.format("binaryFile")`), or of such a table that a query made.
"""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from geofuse.functions import splat as sp
from geofuse.sources.files import listed, opened

c = F.col
# The types of the format and their sizes.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
SPLAT = ("f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
HEAD, CHUNK, STEP = 1 << 16, 1 << 25, 1 << 21
#: Bytes of a partition, and what opening a file counts for.
PACK, PLY_OPEN = 1 << 22, 1 << 16
RECORD = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])
#: Order of the properties in a written file, without the higher harmonics.
WRITTEN = ("x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
CLOUD = (
    "n long, x double, y double, z double, s0 double, s1 double, s2 double, qw double, qx double, qy double, qz double, "
    "opacity_logit double, dc0 double, dc1 double, dc2 double, sh_rest array<float>"
)


PLY_SCHEMA = pa.schema(
    [("file", pa.string()), ("n", pa.int64())]
    + [(k, pa.float64()) for k in ("x", "y", "z", "s0", "s1", "s2", "qw", "qx", "qy", "qz", "opacity_logit", "dc0", "dc1", "dc2")]
    + [("sh_rest", pa.list_(pa.float32()))]
)


def ply_header(data: bytes) -> tuple[np.dtype, int, int]:
    """The record type of the vertices, their number, and where they begin; ValueError for anything else."""
    end = data.find(b"end_header")
    at = data.find(b"\n", end) + 1
    if not data.startswith(b"ply") or end < 0 or at == 0:
        raise ValueError("no ply header")
    fields, count, element, order = [], None, None, None
    for line in data[:end].decode("ascii", "replace").split("\n"):
        w = line.split()
        if w[:1] == ["format"]:
            order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(w[1])
        elif w[:1] == ["element"]:
            element = w[1]
            if element == "vertex":
                if fields or count is not None:
                    raise ValueError("vertices twice")
                count = int(w[2])
            elif count is None:
                raise ValueError("vertices must come first")
        elif w[:1] == ["property"] and element == "vertex":
            if w[1] not in PLY_TYPES:
                raise ValueError(f"a vertex property of type {w[1]}")
            fields.append((w[2], PLY_TYPES[w[1]]))
    if order is None or count is None:
        raise ValueError("not a binary ply of vertices")
    return np.dtype([(name, order + kind) for name, kind in fields]), count, at


def _cloud(rows: np.ndarray, first: int) -> pd.DataFrame:
    """Records as splats; points without splat properties are lifted to small round ones."""
    names = rows.dtype.names
    get = lambda k, d=0.0: rows[k].astype("float64") if k in names else np.full(len(rows), d)
    out = {"n": np.arange(first, first + len(rows)), **{k: get(k) for k in "xyz"}}
    if all(k in names for k in SPLAT):
        rest = sorted((k for k in names if k.startswith("f_rest_")), key=lambda k: int(k[7:]))
        if len(rest) % 3:
            raise ValueError("harmonics that are no multiple of three channels")
        out |= {f"s{i}": get(f"scale_{i}") for i in range(3)} | {q: get(f"rot_{i}") for i, q in enumerate(("qw", "qx", "qy", "qz"))}
        out |= {"opacity_logit": get("opacity")} | {f"dc{i}": get(f"f_dc_{i}") for i in range(3)}
        higher = np.stack([rows[k].astype("float32") for k in rest], 1) if rest else np.zeros((len(rows), 0), "float32")
    else:
        colour = [get(k, 128.0) if k in names else get(f"diffuse_{k}", 128.0) for k in ("red", "green", "blue")]
        out |= {f"s{i}": np.full(len(rows), math.log(0.005)) for i in range(3)} | {"qw": np.ones(len(rows)), **{q: np.zeros(len(rows)) for q in ("qx", "qy", "qz")}}
        out |= {"opacity_logit": np.full(len(rows), 4.0)} | {f"dc{i}": (v / 255 - 0.5) / sp.SH_C0 for i, v in enumerate(colour)}
        higher = np.zeros((len(rows), 0), "float32")
    frame = pd.DataFrame(out)
    frame["sh_rest"] = list(higher)
    return frame


class PlySource(DataSource):
    """PLY files as a table of splats, read in ranges of bytes: spark.read.format("ply").option("chunk", n).load(path).

    The driver lists names and sizes only. A partition is some ranges of at most chunk bytes of a file, of about PACK bytes together:
    its task reads a file's header and then, STEP bytes at a time, the records that begin in its range. So a file may have any
    size, small files don't take a task each, and no task holds more than a step. A file that ends before its last record is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return f"file string, {CLOUD}"

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options)


class PlyRange(InputPartition):
    def __init__(self, uri: str, size: int, low: int, high: int):
        self.uri, self.size, self.low, self.high = uri, size, low, high


class PlyRanges(InputPartition):
    def __init__(self, ranges: list[PlyRange]):
        self.ranges = ranges

    @property
    def low(self) -> int:
        """Where the first range begins in its file."""
        return self.ranges[0].low

    @property
    def high(self) -> int:
        """Where the last range ends in its file."""
        return self.ranges[-1].high


class PlyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))

    def partitions(self) -> list[PlyRanges]:
        out, room, last = [], 0, None
        for uri, size in listed(self.path, ".ply"):
            for at in range(0, max(size, 1), self.chunk):
                part = PlyRange(uri, size, at, min(at + self.chunk, size))
                cost = part.high - at + PLY_OPEN * (uri != last)
                if not out or room < cost:
                    out.append(PlyRanges([]))
                    room, cost = PACK, part.high - at + PLY_OPEN
                out[-1].ranges.append(part)
                room, last = room - cost, uri
        return out

    def read(self, parts: PlyRanges) -> Iterator[pa.RecordBatch]:
        for uri, own in itertools.groupby(parts.ranges, lambda part: part.uri):
            system, path = opened(uri)
            with system.open_input_file(path) as f:
                own = list(own)
                kind, count, at = ply_header(f.read_at(min(HEAD, own[0].size), 0))
                if at + count * kind.itemsize > own[0].size:
                    raise ValueError(f"a ply file ends before its last record: {uri}")
                for part in own:
                    yield from self._records(f, part, kind, count, at)

    def _records(self, f: pa.NativeFile, part: PlyRange, kind: np.dtype, count: int, at: int) -> Iterator[pa.RecordBatch]:
        stride = kind.itemsize
        first, last = (min(count, max(0, -(-(x - at) // stride))) for x in (part.low, part.high))
        if not part.low:
            _cloud(np.zeros(0, kind), 0)  # a header that can't be read is an error in a file without records, too
        per = max(1, STEP // stride)
        for i in range(first, last, per):
            n = min(per, last - i)
            cloud = _cloud(np.frombuffer(f.read_at(n * stride, at + i * stride), kind), i)
            cloud.insert(0, "file", part.uri)
            yield pa.RecordBatch.from_pandas(cloud, schema=PLY_SCHEMA, preserve_index=False)


def read_ply(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Splats (or points lifted to splats) of a PLY file or of all in a folder, with the file of each; n counts its records."""
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").option("chunk", chunk).load(path)


def _blocks(rows: DataFrame, by: list[str], order: list[str], cols: list[str], per_file: int, encode) -> DataFrame:
    """Rows dealt out and sorted by group and order, and encoded in blocks of at most per_file rows of one group.

    A block never crosses a task, and a task holds one block at a time, however large the group: by, block (where it
    stands in the order), records, content.
    """
    rows = rows.select(*by, *order, *[k for k in cols if k not in (*by, *order)]).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k, held = TaskContext.get().partitionId(), 0, []

        def done() -> Iterator[pd.DataFrame]:
            nonlocal k
            if held:
                pdf = pd.concat(held, ignore_index=True)
                held.clear()
                yield pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "block": [task << 32 | k], "records": [len(pdf)], "content": [encode(pdf)]})
                k += 1

        for batch in batches:
            for _, part in batch.groupby(by, sort=False, dropna=False):
                if held and any(held[0][b].iloc[0] != part[b].iloc[0] for b in by):
                    yield from done()
                while len(part):
                    room = per_file - sum(map(len, held))
                    held.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, held)) == per_file:
                        yield from done()
        yield from done()

    return rows.mapInPandas(write, f"{types}, block long, records long, content binary")


def splat_records(splats: DataFrame, by: list[str], order: list[str], per_file: int = 1 << 18) -> DataFrame:
    """Files of 32-byte records, in order within a group: by, block, records, content.

    A record is the position and the linear scales as floats, colour and opacity as bytes, and the unit
    quaternion as bytes around 128.
    """
    from geofuse.operators.cloud import decode

    byte = lambda v: np.clip(np.floor(v + 0.5), 0, 255).astype("u1")

    def encode(pdf: pd.DataFrame) -> bytes:
        out = np.zeros(len(pdf), RECORD)
        out["p"], out["s"] = pdf[[*"xyz"]].to_numpy(), pdf[["sx", "sy", "sz"]].to_numpy()
        out["c"] = byte(np.column_stack([pdf[["red", "green", "blue"]].to_numpy(), pdf["opacity"].to_numpy() * 255]))
        out["q"] = byte(pdf[["uw", "ux", "uy", "uz"]].to_numpy() * 128 + 128)
        return out.tobytes()

    return _blocks(decode(splats), by, order, [*"xyz", "sx", "sy", "sz", "red", "green", "blue", "opacity", "uw", "ux", "uy", "uz"], per_file, encode)


def read_splat_records(blocks: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """The records of such files, with their place n in the file; by names a file.

    A file is a call of its own: a batch of a map would be some thousand files, however large each is.
    """
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*by).schema)

    def read(files: pa.Table) -> pa.Table:
        out = []
        for i in range(files.num_rows):
            r = np.frombuffer(memoryview(files[content][i].as_buffer()), RECORD)
            keys = {k: pa.repeat(files[k][i], len(r)) for k in by}
            cols = {"n": np.arange(len(r)), **{k: r["p"][:, j].astype("float64") for j, k in enumerate("xyz")}}
            cols |= {f"s{k}": r["s"][:, j].astype("float64") for j, k in enumerate("xyz")}
            cols |= {k: r["c"][:, j].astype("int32") for j, k in enumerate(("red", "green", "blue", "alpha"))}
            cols |= {f"q{k}": r["q"][:, j].astype("int32") for j, k in enumerate("wxyz")}
            out.append(pa.table(keys | cols))
        return pa.concat_tables(out)

    return blocks.select(*by, content).groupBy(*by).applyInArrow(
        read, f"{types}, n long, x double, y double, z double, sx double, sy double, sz double, red int, green int, blue int, alpha int, qw int, qx int, qy int, qz int"
    )


def ply_files(splats: DataFrame, by: list[str], order: list[str], per_file: int = 1 << 18) -> DataFrame:
    """Whole PLY files of at most per_file splats of a group: by, block, records, content. sh_rest is written where the column is there."""
    higher = "sh_rest" in splats.columns
    source = dict(zip(WRITTEN, ("x", "y", "z", None, None, None, "dc0", "dc1", "dc2", "opacity_logit", "s0", "s1", "s2", "qw", "qx", "qy", "qz")))

    def encode(pdf: pd.DataFrame) -> bytes:
        rest = np.array(pdf["sh_rest"].tolist(), "float32").reshape(len(pdf), -1) if higher else np.zeros((len(pdf), 0), "float32")
        names = [*WRITTEN[:9], *(f"f_rest_{i}" for i in range(rest.shape[1])), *WRITTEN[9:]]
        out = np.zeros((len(pdf), len(names)), "<f4")
        for i, name in enumerate(names):
            if name.startswith("f_rest_"):
                out[:, i] = rest[:, int(name[7:])]
            elif source[name]:
                out[:, i] = pdf[source[name]].to_numpy()
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(pdf)}\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
        return head.encode() + out.tobytes()

    return _blocks(splats, by, order, [k for k in source.values() if k] + ["sh_rest"] * higher, per_file, encode)


# Rasters --------------------------------------------------------------------------------------------------------
# Tags of the image format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, PER_STRIP, LENGTHS, KIND, NODATA = 256, 257, 258, 259, 273, 278, 279, 339, 42113
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}


def raster_layout(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image of a raster file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a raster of strips")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        place = at + 2 + 12 * i + 8
        if SIZES.get(kind, 1) * count > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        if kind == 2:
            tags[tag] = (data[place : place + count].split(b"\0")[0].decode("ascii", "replace"),)
        elif kind in (1, 3, 4, 12):
            tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 12: 'd'}[kind]}", data, place)
    return order, tags


def float_raster(data: bytes) -> np.ndarray:
    """The cells of an uncompressed float32 raster, first row first; what its nodata value marks, and what isn't finite, is NaN."""
    try:
        order, t = raster_layout(data)
    except struct.error as e:
        raise ValueError("the raster's tags are cut off") from e
    one = lambda k, d: t.get(k, (d,))[0]
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    if one(COMPRESSION, 1) != 1 or one(BITS, 1) != 32 or one(KIND, 1) != 3 or not width or not height:
        raise ValueError("only uncompressed float32 rasters")
    strips = [np.frombuffer(data[a : a + n], order + "f4") for a, n in zip(t[OFFSETS], t[LENGTHS])]
    z = np.concatenate(strips)[: width * height].astype("float64")
    if len(z) < width * height:
        raise ValueError("the raster ends before its last cell")
    none = t.get(NODATA, ("",))[0].strip()
    try:
        z[z == np.float32(float(none))] = np.nan
    except ValueError:
        pass
    z[~np.isfinite(z)] = np.nan
    return z.reshape(height, width)


def write_float_raster(z: np.ndarray, nodata: float = -9999.0, rows_per_strip: int = 8) -> bytes:
    """The bytes of such a raster; NaN becomes nodata."""
    h, w = z.shape
    strips = [np.where(np.isfinite(p), p, nodata).astype("<f4").tobytes() for p in (z[i : i + rows_per_strip] for i in range(0, h, rows_per_strip))]
    mark = f"{nodata:g}".encode() + b"\0"
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [32]), (COMPRESSION, 3, [1]), (OFFSETS, 4, None), (PER_STRIP, 4, [rows_per_strip]), (LENGTHS, 4, [len(s) for s in strips]), (KIND, 3, [3]), (NODATA, 2, mark)]
    extra = 8 + 2 + 12 * len(tags) + 4
    first = extra + (8 * len(strips) if len(strips) > 1 else 0) + (len(mark) if len(mark) > 4 else 0)
    offsets = [first + sum(map(len, strips[:i])) for i in range(len(strips))]
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, kind, values in tags:
        values = offsets if values is None else values
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra + len(tail))
        tail += raw if len(raw) > 4 else b""
        head += struct.pack("<HHI", tag, kind, len(values)) + place
    return head + b"\0\0\0\0" + tail + b"".join(strips)


def decode_dem(files: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """Elevation rasters, a row each, as cells (row 0 south, nodata null): one tile in memory at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                z = float_raster(row.content)[::-1]
                h, w = z.shape
                cells = {"row": np.repeat(np.arange(h, dtype="int32"), w), "col": np.tile(np.arange(w, dtype="int32"), h), "z": z.ravel()}
                frame = pd.DataFrame({**{k: [getattr(row, k)] * (h * w) for k in by}, **cells})
                frame["z"] = frame["z"].astype("object").where(frame["z"].notna(), None)
                yield frame

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema if f.name in by)
    return files.select(*by, c(content).alias("content")).mapInPandas(read, f"{keys}, row int, col int, z double")


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the elevation rasters of a path, with the file of each."""
    files = spark.read.format("binaryFile").load(path).select(c("_metadata.file_path").alias("file"), "content")
    return decode_dem(files.repartition("file"), ["file"])


def dem_files(cells: DataFrame, by: list[str], rows: int, cols: int, value: str = "z") -> DataFrame:
    """Rasters of rows by cols cells, one a group (a tile: its size bounds the group); missing cells are nodata."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((rows, cols), np.nan)
        z[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf[value].to_numpy(dtype="float64")
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "content": [write_float_raster(z[::-1])]})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in by)
    return cells.select(*by, "row", "col", value).groupBy(*by).applyInPandas(write, f"{keys}, content binary")
