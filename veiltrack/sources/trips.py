"""Trip files: lines in file order, validation with counters, trip ids, several trips in one file.

Lines are (file, block, seq, line): a file's lines stand in the order of block
and seq.  Whole small files are split into lines; large ones are read in
blocks, and no step needs a file's lines in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import number_prefix, split_fields, split_lines, whole_prefix

#: The columns of a trip file.
HEADER = "RxDevice,FileId,TxDevice,Gentime,TxRandom,MsgCount,DSecond,Latitude,Longitude,Elevation,Speed,Heading,Ax,Ay,Az,Yawrate,PathCount,RadiusOfCurve,Confidence"
FIELDS = {name: i for i, name in enumerate(HEADER.split(","))}
#: What a valid record keeps to.
LAT_LOW, LAT_HIGH, LON_LIMIT = -84.0, 80.0, 180.0

OUTCOMES = ("ok", "field", "geo", "heading", "unparsable")


def read_lines(spark: SparkSession, paths: str | list[str], whole: bool = True) -> DataFrame:
    """file, block, seq, line.  whole: each file is one row at first, for many small files; else files are read in blocks."""
    if whole:
        content = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        lines = content.select("file", F.posexplode(split_lines(F.col("value"))).alias("seq", "line"))
        return lines.select("file", F.lit(0).cast("long").alias("block"), F.col("seq").cast("long").alias("seq"), "line")
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return rows.withColumn("seq", F.monotonically_increasing_id()).select("file", "block", "seq", "line")


def read_list(spark: SparkSession, path: str) -> list[tuple[str, str | None]]:
    """Paths, and what stands behind a colon, from the lines of a list file; empty lines are passed over."""
    rows = spark.read.text(path).select(F.split("value", ":", 2).alias("parts")).filter(F.col("parts")[0] != "").collect()
    return [(r.parts[0], r.parts[1] if len(r.parts) > 1 else None) for r in rows]


def readable(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return [p for p in paths if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]


def _outcome(enough: Column, lat: Column, lon: Column, heading: Column, speed: Column, time_us: Column) -> Column:
    """The first thing that is wrong with a record decides."""
    return (
        F.when(~enough, "field")
        .when(lat.isNull(), "unparsable")
        .when((lat > LAT_HIGH) | (lat < LAT_LOW), "geo")
        .when(lon.isNull(), "unparsable")
        .when((lon >= LON_LIMIT) | (lon <= -LON_LIMIT), "geo")
        .when((lat == 0.0) & (lon == 0.0), "geo")
        .when(heading.isNull(), "unparsable")
        .when((heading > 360.0) | (heading < 0.0), "heading")
        .when(speed.isNull() | time_us.isNull(), "unparsable")
        .otherwise("ok")
    )


def parse_records(lines: DataFrame, positions: dict[str, int | Column] | None = None, n_fields: int | None = len(FIELDS), names: tuple[str, ...] = ("Latitude", "Longitude", "Heading", "Speed", "Gentime")) -> DataFrame:
    """lines with parts, lat, lon, heading, speed, time_us and outcome (one of OUTCOMES).

    n_fields None asks for no fixed number of fields, only for those that are used.
    """
    positions = positions or FIELDS
    out = lines.withColumn("parts", split_fields(F.col("line"), ","))
    raw = [F.get("parts", positions[n] if isinstance(positions[n], Column) else F.lit(positions[n])) for n in names]
    out = out.withColumns({c: whole_prefix(r) if c == "time_us" else number_prefix(r) for c, r in zip(("lat", "lon", "heading", "speed", "time_us"), raw)})
    enough = F.size("parts") == n_fields if n_fields else ~(raw[0].isNull() | raw[1].isNull() | raw[2].isNull() | raw[3].isNull() | raw[4].isNull())
    return out.withColumn("outcome", _outcome(enough, *(F.col(c) for c in ("lat", "lon", "heading", "speed", "time_us"))))


def trip_counters(records: DataFrame, by: str = "trip_id") -> DataFrame:
    """n_points and how many records are invalid in which way, a trip."""
    count = lambda what: F.sum((F.col("outcome") == what).cast("long"))
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n_points"), count("field").alias("n_invalid_field"), count("geo").alias("n_invalid_geo"), count("heading").alias("n_invalid_heading"))


def number_points(records: DataFrame, by: str = "trip_id", order: tuple[str, ...] = ("block", "seq")) -> DataFrame:
    """Valid records as points: idx counts them from 0."""
    idx = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long") - 1
    return records.filter("outcome = 'ok'").select(by, idx.alias("idx"), F.col("line").alias("raw"), "time_us", "lat", "lon", "heading", "speed")


def read_trips(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of fixed-layout files, a trip a file: trip_id and what parse_records gives.

    The first line is a header, whatever it holds.  The id comes from the
    first record; a file without one of 19 fields gives no trip.  Each file is
    read once.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), split_lines(F.col("value")).alias("lines"))
    first = split_fields(F.get("lines", F.lit(1)), ",")
    files = files.withColumn("first", first).filter(F.size("first") == len(FIELDS))
    lines = files.select("file", F.concat_ws("_", F.get("first", F.lit(0)), F.get("first", F.lit(1))).alias("trip_id"), F.posexplode("lines").alias("seq", "line")).filter("seq > 0")
    lines = lines.select("file", F.lit(0).cast("long").alias("block"), F.col("seq").cast("long").alias("seq"), "line", "trip_id")
    records = parse_records(lines)
    return records.select(*(c for c in records.columns if c != "trip_id"), "trip_id")


def header_positions(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """file and the position of each wanted column in its first line; a file that lacks one raises when it is read."""
    header = lines.filter("block = 0").groupBy("file").agg(F.min_by("line", "seq").alias("header"))
    parts = split_fields(F.rtrim(F.col("header"), F.lit("\r")), ",")
    at = {f"at_{i}": F.array_position(parts, F.lit(n)).cast("int") - 1 for i, n in enumerate(wanted)}
    found = header.select("file", "header", *(c.alias(n) for n, c in at.items()))
    return found.select("file", "header", *(F.when(F.col(f"at_{i}") >= 0, F.col(f"at_{i}")).otherwise(F.raise_error(F.concat(F.lit(f"no column {n} in "), F.col("file"))).cast("int")).alias(f"at_{i}") for i, n in enumerate(wanted)))


def split_trips(lines: DataFrame, uid: str = "uid") -> DataFrame:
    """lines with run: a new trip starts whenever the uid differs from the line before.

    Blocks of a file are numbered by themselves first; a table of one row a
    block carries the last uid and the count of runs from block to block.
    """
    own = Window.partitionBy("file", "block").orderBy("seq")
    rows = lines.withColumn("__before", F.lag(uid).over(own)).withColumn("__first", F.row_number().over(own) == 1)
    rows = rows.withColumn("__new", F.when(F.col("__first"), 0).otherwise((~F.col(uid).eqNullSafe(F.col("__before"))).cast("int")))
    rows = rows.withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = rows.groupBy("file", "block").agg(F.min_by(uid, "seq").alias("head"), F.max_by(uid, "seq").alias("tail"), F.max("__run").alias("inner"))
    along = Window.partitionBy("file").orderBy("block")
    starts = (F.lag("tail").over(along).isNull() & (F.row_number().over(along) == 1)) | ~F.col("head").eqNullSafe(F.lag("tail").over(along))
    blocks = blocks.withColumn("__starts", starts.cast("int"))
    before = F.sum(F.col("__starts") + F.col("inner")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("inner") - 1
    blocks = blocks.select("file", "block", before.alias("__base"))
    return rows.join(blocks, ["file", "block"]).withColumn("run", (F.col("__base") + F.col("__run")).cast("long")).drop("__before", "__first", "__new", "__run", "__base")


def read_mapped_trips(spark: SparkSession, paths: str | list[str], lat: str = "Latitude", lon: str = "Longitude", heading: str = "Heading", speed: str = "Speed", time: str = "Gentime", uid_fields: tuple[str, ...] = ("RxDevice", "FileId")) -> DataFrame:
    """Records of files of any layout with a header, several trips in a file: trip_id is file, run and uid, uid the joined id fields."""
    names = [lat, lon, heading, speed, time]
    lines = read_lines(spark, paths, whole=False)
    at = header_positions(lines, [*names, *uid_fields])
    lines = lines.join(at, "file").filter(~((F.col("block") == 0) & (F.col("line") == F.col("header"))))
    records = parse_records(lines, {n: F.col(f"at_{i}") for i, n in enumerate(names)}, None, tuple(names))
    uid = F.concat_ws("_", *(F.get("parts", F.col(f"at_{len(names) + i}")) for i in range(len(uid_fields))))
    out = split_trips(records.withColumn("uid", uid)).drop(*(f"at_{i}" for i in range(len(names) + len(uid_fields))))
    return out.withColumn("trip_id", F.concat_ws("|", "file", "run", "uid"))
