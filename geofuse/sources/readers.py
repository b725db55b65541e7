"""Readers of telemetry, control points, gauges and features: one plan over all files of a path."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.functions.text import first_column, number_after, parse_loose_time
from geofuse.plans.shared import settled

c = F.col
# Header aliases, in the order in which they count.
LAT = ("lat", "latitude", "gps_lat", "y")
LON = ("lon", "lng", "longitude", "long", "gps_lon", "x")
ALT = ("alt", "altitude", "height", "ellipsoid_height", "h", "z")
TIME = ("time", "timestamp", "unix", "unix_s", "datetime", "utc")
STD_H = ("std_h", "h_acc", "hacc", "horizontal_accuracy")
STD_V = ("std_v", "v_acc", "vacc", "vertical_accuracy")
YAW = ("yaw", "heading", "heading_deg")
#: Folders that hold no telemetry.
SKIPPED = ("tiles", "runs", "exports", "derived")


def _number(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    name = first_column(df.columns, aliases)
    return F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)") if name else F.lit(None).cast("double")


def _double(text: Column | None) -> Column:
    return F.lit(None).cast("double") if text is None else F.trim(text).try_cast("double")


def _telemetry(df: DataFrame, text: Callable[[tuple[str, ...]], Column | None], keep: tuple[str, ...]) -> DataFrame:
    """Telemetry of rows whose fields text() gives, by the aliases of a header; rows without a position are dropped."""
    number = lambda aliases: _double(text(aliases))
    std_h = F.greatest(F.abs(F.coalesce(number(STD_H), F.lit(2.0))), F.lit(0.05))
    time = text(TIME)
    out = df.select(
        number(LON).alias("lon_deg"), number(LAT).alias("lat_deg"), F.coalesce(number(ALT), F.lit(0.0)).alias("height_m"),
        (parse_loose_time(time) if time is not None else F.lit(None).cast("double")).alias("unix_s"), std_h.alias("std_e"), std_h.alias("std_n"),
        F.greatest(F.abs(F.coalesce(number(STD_V), 2 * std_h)), F.lit(0.05)).alias("std_u"), number(YAW).alias("heading_deg"), F.lit("csv").alias("source"), *keep,
    )
    return out.filter("lon_deg IS NOT NULL AND lat_deg IS NOT NULL")


def telemetry_csv(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Telemetry from a table of strings with any known header; rows without a position are dropped."""

    def text(aliases: tuple[str, ...]) -> Column | None:
        name = first_column(df.columns, aliases)
        return c(f"`{name}`") if name else None

    return _telemetry(df, text, keep)


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    return telemetry_csv(spark.read.csv(path, header=True, comment="#", mode="PERMISSIVE"))


def srt_cues(texts: DataFrame, column: str = "value") -> DataFrame:
    """Subtitle cues to fixes; absolute height before relative, RTK marks a small deviation."""
    cue = F.explode(F.split(F.regexp_replace(column, "\r", ""), r"\n[ \t]*\n"))
    q = texts.select(*[k for k in texts.columns if k != column], cue.alias("cue"))
    t = c("cue")
    rtk = F.lower(t).contains("rtk")
    out = q.withColumns({
        "lat_deg": number_after(t, ("latitude", "lat")), "lon_deg": number_after(t, ("longitude", "long", "lon")),
        "height_m": F.coalesce(number_after(t, ("abs_alt",)), number_after(t, ("rel_alt",)), F.lit(0.0)),
        "heading_deg": number_after(t, ("gb_yaw", "yaw")),
        "unix_s": F.unix_micros(F.try_to_timestamp(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1))) / 1e6,
        "std_e": F.when(rtk, 0.05).otherwise(2.0), "std_n": F.when(rtk, 0.05).otherwise(2.0), "std_u": F.when(rtk, 0.1).otherwise(5.0),
    })
    return out.filter("lat_deg IS NOT NULL AND lon_deg IS NOT NULL").drop("cue")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return srt_cues(spark.read.text(path, wholetext=True)).withColumn("source", F.lit("srt"))


def gcp_csv(df: DataFrame) -> DataFrame:
    """Control points: geographic where latitude and longitude have aliases, else local east and north."""
    name = first_column(df.columns, ("id", "name", "point", "label"))
    lat, lon = _number(df, LAT), _number(df, LON)
    geographic = first_column(df.columns, LAT) is not None and first_column(df.columns, LON) is not None
    east, north = (lon, lat) if geographic else (_number(df, ("easting", "east", "e")), _number(df, ("northing", "north", "n")))
    out = df.select(c(name).alias("gcp_id") if name else F.lit(None).cast("string").alias("gcp_id"), east.alias("px"), north.alias("py"), F.coalesce(_number(df, ALT), F.lit(0.0)).alias("pz"),
                    F.lit("EPSG:4326" if geographic else "local-ENU-m").alias("crs"), F.lit(0.02).alias("std_e"), F.lit(0.02).alias("std_n"), F.lit(0.05).alias("std_u"))
    return out.filter("px IS NOT NULL AND py IS NOT NULL")


def read_gcp_csv(spark: SparkSession, path: str) -> DataFrame:
    return gcp_csv(spark.read.csv(path, header=True, comment="#"))


def nwis_rdb(lines: DataFrame, column: str = "value") -> DataFrame:
    """Gauge sites from tab text: comments, the header and the row of widths are skipped."""
    f = F.split(column, "\t")
    number = lambda i: F.expr(f"try_cast(trim(get(split({column}, '\\t'), {i})) AS DOUBLE)")
    rows = lines.filter(~F.startswith(c(column), F.lit("#"))).select(F.get(f, F.lit(1)).alias("site_no"), F.get(f, F.lit(2)).alias("name"), number(4).alias("lat"), number(5).alias("lon"))
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL")


def read_nwis_rdb(spark: SparkSession, path: str) -> DataFrame:
    return nwis_rdb(spark.read.text(path))


IV = (
    "value struct<timeSeries: array<struct<sourceInfo: struct<siteName: string, siteCode: array<struct<value: string>>, geoLocation: struct<geogLocation: struct<latitude: double, longitude: double>>>, "
    "variable: struct<variableCode: array<struct<value: string>>>, values: array<struct<value: array<struct<value: string, dateTime: string>>>>>>>"
)


def nwis_iv(docs: DataFrame, column: str = "value") -> DataFrame:
    """Sites, parameters and readings of nested instantaneous-value documents."""
    s = docs.select(F.explode(F.from_json(column, IV)["value"]["timeSeries"]).alias("t"))
    r = s.select(
        F.get("t.sourceInfo.siteCode", F.lit(0))["value"].alias("site_no"), c("t.sourceInfo.siteName").alias("name"), F.get("t.variable.variableCode", F.lit(0))["value"].alias("parameter_cd"),
        c("t.sourceInfo.geoLocation.geogLocation.longitude").alias("lon"), c("t.sourceInfo.geoLocation.geogLocation.latitude").alias("lat"), F.explode_outer(F.flatten("t.values.value")).alias("v"),
    )
    return r.select("site_no", "name", "parameter_cd", "lon", "lat", F.expr("try_cast(v.value AS DOUBLE)").alias("value"), c("v.dateTime").alias("date_time"))


OSM = "elements array<struct<id: bigint, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>>>"


def osm_waterways(docs: DataFrame, column: str = "value") -> DataFrame:
    """Lines of two vertices or more."""
    e = docs.select(F.explode(F.from_json(column, OSM)["elements"]).alias("e")).filter(F.size("e.geometry") >= 2)
    return e.select(c("e.id").alias("osm_id"), F.coalesce(F.try_element_at("e.tags", F.lit("name")), F.lit("waterway")).alias("name"), F.coalesce(F.try_element_at("e.tags", F.lit("waterway")), F.lit("stream")).alias("class"),
                    F.size("e.geometry").alias("vertices"), c("e.geometry").alias("geometry"))


def geojson_features(docs: DataFrame, column: str = "value") -> DataFrame:
    """A row for each feature of collections: properties and geometry as JSON text."""
    features = F.from_json(column, "features array<string>")["features"]
    f = docs.select(F.explode(features).alias("f"))
    return f.select(F.get_json_object("f", "$.properties").alias("properties"), F.get_json_object("f", "$.geometry").alias("geometry"), F.get_json_object("f", "$.geometry.type").alias("kind"))


def geometry_bounds(features: DataFrame, by: list[str], geometry: str = "geometry") -> DataFrame:
    """Bounds of the coordinate pairs of geometries, however nested."""
    pair = r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    x, y = (F.transform(F.regexp_extract_all(geometry, F.lit(pair), F.lit(i)), lambda v: v.cast("double")) for i in (1, 2))
    p = features.select(*by, F.array_min(x).alias("w"), F.array_max(x).alias("e"), F.array_min(y).alias("s"), F.array_max(y).alias("n"))
    return p.groupBy(*by).agg(F.min("w").alias("west"), F.min("s").alias("south"), F.max("e").alias("east"), F.max("n").alias("north"))


def grid_json(docs: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """Cells of preview grids {cols, rows, z[]}; a document whose length doesn't match gives none."""
    g = docs.select(*by, F.from_json(column, "cols int, rows int, z array<double>").alias("g")).filter("size(g.z) = g.cols * g.rows")
    p = g.select(*by, "g.cols", F.posexplode("g.z").alias("pos", "z"))
    return p.select(*by, F.floor(c("pos") / c("cols")).cast("int").alias("row"), (c("pos") % c("cols")).cast("int").alias("col"), "z")


def _field(parts: Column, i: Column | int) -> Column:
    return _as_number(F.get(parts, i if isinstance(i, Column) else F.lit(i)))


def _as_number(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?$"), t.cast("double"))


def mrk(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Marker lines by field order: number, time, latitude, longitude, height, deviations north, east, up (1 cm at least)."""
    p = F.split(c(column), r"[\t,]")
    std = lambda i, d: F.greatest(F.abs(F.coalesce(_field(p, i), F.lit(d))), F.lit(0.01))
    out = lines.filter(~F.trim(column).startswith("#")).select(
        _field(p, 0).cast("long").alias("sample_id"), _field(p, 1).alias("time"), _field(p, 2).alias("lat_deg"), _field(p, 3).alias("lon_deg"), _field(p, 4).alias("height_m"),
        std(6, 0.05).alias("std_e"), std(5, 0.05).alias("std_n"), std(7, 0.1).alias("std_u"), F.lit("mrk").alias("source"), *keep,
    )
    return out.filter("abs(lat_deg) <= 90 AND abs(lon_deg) <= 180 AND height_m IS NOT NULL")


def pos(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Post-processed positions: the first of five places where two fields can be a position, in either order."""
    # A line is cut, and its fields are read as numbers, once; no field after the tenth is asked for.
    lines = settled(lines.select(F.filter(F.split(F.trim(column), r"[\s,]+"), lambda s: s != "").alias("p"), *keep)).filter("size(p) >= 4 AND NOT (startswith(p[0], '%') OR startswith(p[0], '#'))")
    lines = settled(lines.withColumn("v", F.transform(F.slice("p", 1, 10), _as_number)))
    p = c("p")
    field = lambda i: F.get("v", i if isinstance(i, Column) else F.lit(i))

    def fits(i: Column) -> Column:
        a, b = F.abs(field(i)), F.abs(field(i + 1))
        return F.coalesce(((a <= 90) & (b <= 180)) | ((b <= 90) & (a <= 180)), F.lit(False)) & (i + 2 < F.size(p))

    at = settled(lines.withColumn("at", F.get(F.filter(F.sequence(F.lit(0), F.lit(4)), fits), F.lit(0)))).filter("at IS NOT NULL")
    a, b = field(c("at")), field(c("at") + 1)
    straight = (F.abs(a) <= 90) & (F.abs(b) <= 180)
    std = lambda i, d: F.greatest(F.abs(F.coalesce(field(c("at") + i), d)), F.lit(0.02))
    e = std(3, F.lit(0.1))
    time = F.coalesce(parse_loose_time(F.get(p, F.lit(0))), parse_loose_time(F.concat_ws(" ", F.replace(F.get(p, F.lit(0)), F.lit("/"), F.lit("-")), F.get(p, F.lit(1)))))
    out = at.select(F.when(straight, a).otherwise(b).alias("lat_deg"), F.when(straight, b).otherwise(a).alias("lon_deg"), field(c("at") + 2).alias("height_m"), e.alias("std_e"), std(4, e).alias("std_n"), std(5, e * 2).alias("std_u"), time.alias("unix_s"), F.lit("pos").alias("source"), *keep)
    return out.filter("height_m IS NOT NULL")


def kml(docs: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every lon,lat[,height] of the coordinates of documents."""
    body = F.explode(F.regexp_extract_all(column, F.lit(r"<coordinates>([^<]*)</coordinates>"), F.lit(1)))
    t = docs.select(body.alias("b"), *keep).select(F.explode(F.filter(F.split("b", r"\s+"), lambda s: s != "")).alias("t"), *keep).select(F.split("t", ",").alias("p"), *keep)
    p = c("p")
    out = t.select(_field(p, 0).alias("lon_deg"), _field(p, 1).alias("lat_deg"), F.coalesce(_field(p, 2), F.lit(0.0)).alias("height_m"), F.lit(5.0).alias("std_e"), F.lit(5.0).alias("std_n"), F.lit(10.0).alias("std_u"), F.lit("kml").alias("source"), *keep)
    return out.filter("lon_deg IS NOT NULL AND lat_deg IS NOT NULL")


def read_gpx(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Track points with time and way points without, by the XML source; with a glob, of all such files below a folder, with _file."""
    parts = []
    for tag, std in (("trkpt", (3.0, 3.0, 8.0)), ("wpt", (2.0, 2.0, 5.0))):
        reader = spark.read.format("xml").option("rowTag", tag).schema("_lat double, _lon double, ele double, time string")
        if glob:
            reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        x, keep = reader.load(path), [c("_metadata.file_path").alias("_file")] if glob else []
        time = parse_loose_time(c("time")) if tag == "trkpt" else F.lit(None).cast("double")
        parts.append(x.select(c("_lon").alias("lon_deg"), c("_lat").alias("lat_deg"), F.coalesce("ele", F.lit(0.0)).alias("height_m"), *[F.lit(s).alias(k) for s, k in zip(std, ("std_e", "std_n", "std_u"))], time.alias("unix_s"), F.lit("gpx").alias("source"), *keep))
    return parts[0].unionByName(parts[1]).filter("lon_deg IS NOT NULL AND lat_deg IS NOT NULL")


def _own(folder: str, file: Column) -> Column:
    """Whether a file below a folder counts: at most four folders deep, none of them of tiles or results."""
    base = re.escape(urllib.parse.quote(re.sub("^[a-z0-9]+:/+", "/", folder).rstrip("/")))
    parts = F.split(F.regexp_extract(file, f"{base}/(.*)$", 1), "/")
    return (F.size(parts) <= 5) & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(k) for k in SKIPPED]))


def _below(spark: SparkSession, folder: str, glob: str, whole: bool = False, name: str = "") -> DataFrame:
    """Lines (or texts) of the files below a folder that count, whose names fit the glob and the pattern name."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=whole)
    files = files.select("value", c("_metadata.file_path").alias("_file"), c("_metadata.file_block_start").alias("_at")).filter(_own(folder, c("_file")))
    return files.filter(F.element_at(F.split("_file", "/"), -1).rlike(name)) if name else files


def _csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry of CSV files in one plan, each by its own header: its names are set against the aliases, its rows read by place."""
    lines = _below(spark, folder, "*.[cC][sS][vV]", name="(?i)^(?!.*gcp)").withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    lines = lines.filter("NOT startswith(trim(value), '#') AND trim(value) != ''").withColumn("_n", F.monotonically_increasing_id())
    first = lines.groupBy("_file").agg(F.min_by("value", F.struct("_at", "_n")).alias("_header"))
    most = first.agg(F.max(F.size(F.split("_header", ",")))).first()[0] or 1
    fields = lambda text: F.array(*[F.from_csv(text, ", ".join(f"c{i} string" for i in range(most)), {"mode": "PERMISSIVE"})[f"c{i}"] for i in range(most)])
    names = F.transform(fields(c("_header")), lambda k: F.lower(F.trim(k)))
    spots = {k: F.coalesce(*[F.nullif(F.array_position(c("_names"), F.lit(a)), F.lit(0)) for a in k]).cast("int") for k in (LON, LAT, ALT, TIME, STD_H, STD_V, YAW)}
    first = first.withColumn("_names", names).select("_file", "_header", *[spot.alias(f"_{k[0]}") for k, spot in spots.items()])
    rows = lines.join(first, "_file").filter(c("value") != c("_header")).withColumn("_row", fields(c("value")))
    return _telemetry(rows, lambda aliases: F.get("_row", c(f"_{aliases[0]}") - 1), ("_file",))


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All telemetry files below a folder, by extension and name, with the file of each row.

    Tables of control points (gcp in the name of a CSV file) aren't telemetry; a .txt file is one of positions if its name says so.
    Folders more than four deep, and those of tiles, runs, exports and derived files, are left out.
    """
    keep = ("_file",)
    placed = _below(spark, folder, "*.{[pP][oO][sS],[pP][pP][kK],[tT][xX][tT]}", name=r"(?i)(\.pos$|\.ppk$|(pos|ppk).*\.txt$)")
    gpx = read_gpx(spark, folder, "*.[gG][pP][xX]").filter(_own(folder, c("_file")))
    rows = [srt_cues(_below(spark, folder, "*.[sS][rR][tT]", True).drop("_at")).withColumn("source", F.lit("srt")), mrk(_below(spark, folder, "*.[mM][rR][kK]"), keep=keep),
            pos(placed, keep=keep), kml(_below(spark, folder, "*.[kK][mM][lL]", True), keep=keep), gpx, _csv_files(spark, folder)]
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.withColumnRenamed("_file", "file")


def source_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """file, warning: a row for each telemetry file below a folder that gives no position."""
    kinds = ",".join("".join(f"[{k}{k.upper()}]" for k in kind) for kind in ("srt", "mrk", "pos", "ppk", "kml", "gpx", "csv"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{kinds}}}").load(folder)
    files = files.filter(_own(folder, c("_metadata.file_path")) & ~c("_metadata.file_name").rlike("(?i)gcp.*\\.csv$"))
    empty = files.select(c("_metadata.file_path").alias("file")).join(read_sources(spark, folder).select("file"), "file", "left_anti")
    return empty.select("file", F.lit("no positions").alias("warning"))
