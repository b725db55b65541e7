"""Sparse models as text: cameras, images with their observations, and points, a line (or two) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
# The camera models and the number of their parameters.
MODELS = {"SIMPLE_PINHOLE": 3, "PINHOLE": 4, "SIMPLE_RADIAL": 4, "RADIAL": 5, "OPENCV": 8}
POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")


def _number(p: Column, i: int) -> Column:
    return F.get(p, F.lit(i)).try_cast("double")


def _fields(column: str = "value") -> Column:
    return F.filter(F.split(column, r"\s+"), lambda s: s != "")


def camera_lines(cameras: DataFrame) -> DataFrame:
    """camera_id, model, width, height, params -> value; other columns stay."""
    line = F.concat_ws(" ", c("camera_id"), "model", c("width").cast("long"), c("height").cast("long"), F.transform("params", lambda v: v.cast("string")))
    return cameras.select(*_others(cameras, ("camera_id", "model", "width", "height", "params")), line.alias("value"))


def _others(df: DataFrame, used: tuple[str, ...]) -> list[str]:
    return [k for k in df.columns if k not in used]


def image_lines(images: DataFrame, obs: DataFrame, by: list[str]) -> DataFrame:
    """Two lines an image, as one value: its pose and name, and its observations (x, y, point_id, idx by place).

    A null point_id is written -1. An image without observations has an empty second line. An image's
    observations are gathered in one row: they are bounded by the keypoints of an image.
    """
    triple = F.concat_ws(" ", "x", "y", F.coalesce("point_id", F.lit(-1).cast("long")))
    seen = obs.groupBy(*by, "image_id").agg(F.array_sort(F.collect_list(F.struct("idx", triple.alias("t")))).alias("o"))
    line = F.concat_ws(" ", "image_id", *POSE, "camera_id", "name")
    both = images.join(seen, [*by, "image_id"], "left")
    return both.select(*by, F.concat(line, F.lit("\n"), F.coalesce(F.array_join(c("o.t"), " "), F.lit(""))).alias("value"))


def point_lines(points: DataFrame, track: DataFrame, by: list[str]) -> DataFrame:
    """A line a point: position, colour, error, and its track of (image_id, idx)."""
    seen = track.groupBy(*by, "point_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "idx"))).alias("o"))
    pairs = F.transform("o", lambda p: F.concat_ws(" ", p["image_id"], p["idx"]))
    both = points.join(seen, [*by, "point_id"], "left")
    line = F.concat_ws(" ", "point_id", "x", "y", "z", *[c(k).cast("int") for k in "rgb"], "error", pairs)
    return both.select(*by, line.alias("value"))


def parse_cameras(lines: DataFrame) -> DataFrame:
    """Cameras; a line of another model, or without its parameters, is dropped."""
    p = _fields()
    known = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])
    out = lines.filter(~F.startswith(F.trim("value"), F.lit("#"))).withColumn("_p", p)
    params = F.transform(F.slice("_p", F.lit(5), F.greatest(F.size("_p") - 4, F.lit(0))), lambda v: v.try_cast("double"))
    out = out.withColumns({
        "camera_id": F.get("_p", F.lit(0)).try_cast("long"), "model": F.get("_p", F.lit(1)), "width": F.get("_p", F.lit(2)).try_cast("long"), "height": F.get("_p", F.lit(3)).try_cast("long"), "params": params,
    })
    ok = (F.size("params") == F.try_element_at(known, c("model"))) & ~F.exists("params", lambda v: v.isNull()) & c("camera_id").isNotNull()
    return out.filter(ok).drop("value", "_p")


def focal_and_centre(cameras: DataFrame) -> DataFrame:
    """Adds fx, fy, cx, cy of each camera, whatever its model."""
    two = c("model").isin("PINHOLE", "OPENCV")
    at = lambda i, j: F.when(two, c("params")[i]).otherwise(c("params")[j])
    return cameras.withColumns({"fx": c("params")[0], "fy": at(1, 0), "cx": at(2, 1), "cy": at(3, 2)})


def numbered(lines: DataFrame) -> DataFrame:
    """Lines (value, _file, _at), comments left out, with _k, their number in the file, and _since, the lines since the last blank one.

    Counts per block of a file, carried over its blocks (a row each), then places within a block.
    """
    kept = lines.filter(~c("value").rlike(r"^\s*#")).withColumns({"_n": F.monotonically_increasing_id(), "_blank": c("value").rlike(r"^\s*$")})
    own = Window.partitionBy("_file", "_at").orderBy("_n")  # within a block of a file
    kept = kept.withColumn("_i", (F.row_number().over(own) - 1).cast("long"))
    so_far = own.rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("_last", F.max(F.when(c("_blank"), c("_i"))).over(so_far))
    blocks = kept.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_c"), F.max(F.when(c("_blank"), c("_i"))).alias("_end"))
    before = Window.partitionBy("_file").orderBy("_at")
    blocks = blocks.withColumns({
        "_b": F.coalesce(F.sum("_c").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_stretch": F.count("_end").over(before),
        "_tail": c("_c") - F.coalesce(c("_end") + 1, F.lit(0)),
    })
    blocks = blocks.withColumn("_run", F.sum("_tail").over(Window.partitionBy("_file", "_stretch").orderBy("_at")))
    blocks = blocks.select("_file", "_at", "_b", F.coalesce(F.lag("_run").over(before), F.lit(0)).alias("_carry"))
    since = F.when(c("_last").isNull(), c("_i") + c("_carry")).otherwise(c("_i") - c("_last") - 1)
    out = kept.join(blocks, ["_file", "_at"]).withColumns({"_k": c("_b") + c("_i"), "_since": since})
    return out.drop("_n", "_b", "_i", "_at", "_blank", "_last", "_carry")


def _must(ok: Column, what: str, line: Column | str = "value") -> Column:
    """A condition that holds, or stops the job with the line that breaks it."""
    text = c(line) if isinstance(line, str) else line
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(what), F.coalesce(text, F.lit("")))))


def parse_images(lines: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Images and observations of numbered lines.

    Blank lines are skipped where an image is due; the line after an image's has its observations, and may be blank. So
    a line's part follows from the lines since the last blank one: an even number means that an image is due.
    An image's line with under ten fields, or with fields that aren't numbers, is an error, and so are observations
    whose places aren't numbers. Two fields at most left over at the end of a line of observations are ignored.
    Images: by, image_id, pose, camera_id, name. Observations: by, image_id, idx, x, y, point_id (null for -1 or no number).
    """
    head = (c("_since") % 2 == 0) & ~c("value").rlike(r"^\s*$")
    told = lines.filter(head | (c("_since") % 2 == 1)).withColumn("_head", head)
    pair = told.groupBy("_file", *by, F.when(c("_head"), c("_k")).otherwise(c("_k") - 1).alias("_pair"))
    pair = pair.agg(F.max(F.when(c("_head"), c("value"))).alias("head"), F.max(F.when(~c("_head"), c("value"))).alias("value"))
    pair = pair.withColumns({"_h": _fields("head"), "_p": _fields()}).filter(_must(F.size("_h") >= 10, "malformed image line: ", "head"))
    pose = [_number(c("_h"), i + 1).alias(k) for i, k in enumerate(POSE)]
    name = F.array_join(F.slice("_h", F.lit(10), F.size("_h")), " ")
    rows = pair.select("*", F.get("_h", F.lit(0)).try_cast("long").alias("image_id"), *pose, F.get("_h", F.lit(8)).try_cast("long").alias("camera_id"), name.alias("name"))
    numbers = ["image_id", *POSE, "camera_id"]
    rows = rows.filter(_must(F.forall(F.array(*[c(k).isNotNull() for k in numbers]), lambda x: x), "no number in image line: ", "head"))
    # The places become structs before they are exploded: a row an observation must not carry the whole line.
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.size("_p") / 3).cast("int") - 1, F.lit(0))), lambda i: i * 3 + 2 < F.size("_p"))
    part = lambda i, k: F.get("_p", i * 3 + k)
    o = rows.select(*by, "image_id", F.explode(F.transform(at, lambda i: F.struct(i.alias("idx"), *[part(i, k).alias(f"_{k}") for k in range(3)]))).alias("o"))
    point = c("o._2").try_cast("long")
    seen = o.select(*by, "image_id", "o.idx", c("o._0").try_cast("double").alias("x"), c("o._1").try_cast("double").alias("y"), F.when(point >= 0, point).alias("point_id"))
    seen = seen.filter(_must(c("x").isNotNull() & c("y").isNotNull(), "no number in the observations of image ", c("image_id").cast("string")))
    return rows.select(*by, *numbers, "name"), seen


def parse_points(lines: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points (by, point_id, x, y, z, r, g, b, error) and their tracks (by, point_id, image_id, idx)."""
    p = lines.filter(~F.startswith(F.trim("value"), F.lit("#"))).withColumn("_p", _fields()).filter(F.size("_p") >= 8)
    p = p.withColumn("point_id", F.get("_p", F.lit(0)).try_cast("long"))
    points = p.select(*by, "point_id", *[_number(c("_p"), i + 1).alias(k) for i, k in enumerate("xyz")], *[F.get("_p", F.lit(i + 4)).try_cast("int").alias(k) for i, k in enumerate("rgb")], _number(c("_p"), 7).alias("error"))
    at = F.filter(F.sequence(F.lit(4), F.greatest(F.floor(F.size("_p") / 2).cast("int") - 1, F.lit(4))), lambda i: i * 2 + 1 < F.size("_p"))
    t = p.select(*by, "point_id", F.explode(F.transform(at, lambda i: F.struct(F.get("_p", i * 2).alias("_0"), F.get("_p", i * 2 + 1).alias("_1")))).alias("t"))
    return points, t.select(*by, "point_id", c("t._0").try_cast("long").alias("image_id"), c("t._1").try_cast("int").alias("idx"))


def write_sfm_text(folder: str, by: list[str], cameras: DataFrame, images: DataFrame, obs: DataFrame, points: DataFrame, track: DataFrame) -> None:
    """A folder each of cameras, images and points3D, as text, split by the columns by."""
    for name, lines in (("cameras", camera_lines(cameras)), ("images", image_lines(images, obs, by)), ("points3D", point_lines(points, track, by))):
        lines.write.partitionBy(*by).text(f"{folder}/{name}")


def read_sfm_text(spark: SparkSession, folder: str, by: list[str]) -> dict[str, DataFrame]:
    """cameras, images, obs, points and track of models that were written so, or of folders of such files."""

    def lines(name: str) -> DataFrame:
        df = spark.read.text(f"{folder}/{name}")
        return df.select(*by, "value", c("_metadata.file_path").alias("_file"), c("_metadata.file_block_start").alias("_at"))

    images, obs = parse_images(numbered(lines("images")), by)
    points, track = parse_points(lines("points3D").drop("_file", "_at"), by)
    return {"cameras": parse_cameras(lines("cameras").drop("_file", "_at")), "images": images, "obs": obs, "points": points, "track": track}
