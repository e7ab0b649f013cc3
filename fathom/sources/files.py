"""Survey file sources: many files per read, one survey per file.

* ``scan_surveys`` reads CSV / TAB text / JSON-records files with all columns
  as strings (no schema inference pass), renames headers to canonical names
  (case-insensitive, trimmed, per-sensor aliases), casts numerics with
  ``try_cast`` (bad values -> NULL instead of failing the job), parses
  timestamps, and takes ``survey_id`` from the file name.
* ``idx`` (the 0-based position in the file, the reference's row index) is
  taken from the data when the file carries it; otherwise it comes from the
  read order inside each file split plus a per-split offset table
  (``file_positions``), without reordering the data.
* Header sniffing lists files (no content) and reads only each file's first
  64 KB inside tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed values (must equal the reference's parsers): header aliases per sensor family.
ALIASES = {
    "mbes": {"time": "timestamp", "datetime": "timestamp", "utc": "timestamp",
             "lat": "latitude", "y": "latitude", "lon": "longitude", "lng": "longitude", "x": "longitude",
             "z": "depth", "elevation": "depth", "beam": "beam_angle", "angle": "beam_angle",
             "qual": "quality", "quality_factor": "quality", "backscatter": "intensity"},
    "sbes": {"time": "timestamp", "datetime": "timestamp", "utc": "timestamp", "epoch": "timestamp",
             "lat": "latitude", "y": "latitude", "northing": "latitude",
             "lon": "longitude", "lng": "longitude", "x": "longitude", "easting": "longitude",
             "z": "depth", "elevation": "depth", "altitude": "depth",
             "qual": "quality", "quality_factor": "quality", "signal_quality": "quality",
             "hdg": "heading", "course": "heading", "pitch_angle": "pitch", "roll_angle": "roll",
             "vel": "velocity", "speed": "velocity", "freq": "frequency"},
    "lidar": {"time": "timestamp", "datetime": "timestamp", "utc": "timestamp",
              "lat": "latitude", "y": "latitude", "northing": "latitude",
              "lon": "longitude", "lng": "longitude", "x": "longitude", "easting": "longitude",
              "z": "elevation", "alt": "elevation", "altitude": "elevation", "height": "elevation",
              "int": "intensity", "class": "classification", "cls": "classification",
              "return_num": "return_number", "ret": "return_number",
              "num_returns": "number_of_returns", "nret": "number_of_returns"},
}
# Required columns per sensor family.
REQUIRED = {
    "mbes": ["timestamp", "latitude", "longitude", "depth"],
    "sbes": ["timestamp", "latitude", "longitude", "depth"],
    "lidar": ["timestamp", "latitude", "longitude", "elevation"],
}
NUMERIC = ["latitude", "longitude", "depth", "elevation", "beam_angle", "quality", "intensity", "heading",
           "pitch", "roll", "velocity", "frequency", "classification", "return_number", "number_of_returns"]
INTEGER = ["classification", "return_number", "number_of_returns"]
SENSOR_FAMILY = {"mbes": "mbes", "sbes": "sbes", "singlebeam": "sbes", "auv": "sbes", "lidar": "lidar"}
LIDAR_BINARY_EXT = ["las", "laz"]


def family(sensor: str) -> str:
    if sensor not in SENSOR_FAMILY:
        raise ValueError(f"Unsupported sensor type: {sensor}")
    return SENSOR_FAMILY[sensor]


def standardize(df: DataFrame, sensor: str) -> DataFrame:
    """Rename headers to canonical names (lower-cased, trimmed, aliased).

    Aliases apply before the required-column check; when an alias would
    collide with a column already carrying the canonical name, the alias
    column keeps its (normalised) name.
    """
    aliases = ALIASES[family(sensor)]
    norm = {c: c.strip().lower() for c in df.columns}
    present = set(norm.values())
    mapping = {}
    for c, n in norm.items():
        target = aliases.get(n, n)
        if target != n and target in present:
            target = n
        mapping[c] = target
        present.add(target)
    return df.withColumnsRenamed({c: t for c, t in mapping.items() if c != t})


def missing_required(columns: list[str], sensor: str) -> list[str]:
    return [c for c in REQUIRED[family(sensor)] if c not in columns]


def normalize_timestamp(c: Column) -> Column:
    """ISO-8601 text or Unix epoch seconds -> TIMESTAMP (UTC session)."""
    txt = F.trim(c.cast("string"))
    return F.when(txt.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(txt.try_cast("double"))) \
            .otherwise(F.try_to_timestamp(txt))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _typed(df: DataFrame) -> DataFrame:
    casts = {}
    for c in df.columns:
        if c in NUMERIC:
            number = F.col(c).try_cast("int" if c in INTEGER else "double")
            casts[c] = number if c in INTEGER else F.nanvl(number, F.lit(None).cast("double"))  # NaN text is NULL
        elif c == "timestamp":
            casts[c] = normalize_timestamp(F.col(c))
        elif c == "idx":
            casts[c] = F.col(c).try_cast("long")
    return df.withColumns(casts)


def _reader(spark: SparkSession, fmt: str, sep: str | None, comment: str | None, header: bool,
            multiline: bool = True):
    r = spark.read
    if fmt == "json":
        return r.option("multiLine", multiline)
    r = r.option("header", header).option("inferSchema", False).option("mode", "PERMISSIVE")
    if sep:
        r = r.option("sep", sep)
    if comment:
        r = r.option("comment", comment)
    return r


def scan_surveys(spark: SparkSession, paths: str | list[str], sensor: str, fmt: str = "csv",
                 sep: str | None = None, comment: str | None = None, header: bool = True,
                 names: list[str] | None = None, multiline: bool = True,
                 schema: str | None = None) -> DataFrame:
    """Read survey files into the soundings schema (all files in one job).

    JSON files hold a records array (``multiline=True``) or one record per
    line (``multiline=False``); without ``schema`` (a DDL string of the raw
    fields) Spark runs a field-discovery pass over JSON input first.  CSV never
    infers types: every field is read as a string and cast afterwards."""
    if fmt == "txt":
        sep = sep or "\t"
    reader = _reader(spark, "json" if fmt == "json" else "csv", sep, comment, header, multiline)
    if schema is not None:
        reader = reader.schema(schema)
    elif names is not None and fmt != "json":
        reader = reader.schema(", ".join(f"`{n}` STRING" for n in names))
    raw = reader.json(paths) if fmt == "json" else reader.csv(paths)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"))
    std = standardize(raw, sensor)
    miss = missing_required(std.columns, sensor)
    if miss:
        raise ValueError(f"Missing required columns: {miss}")
    std = _typed(std)
    if "survey_id" not in std.columns:
        std = std.withColumn("survey_id", F.regexp_extract(F.col("_file"), r"([^/]+?)(\.[^./]*)?$", 1))
    if "idx" not in std.columns:
        std = file_positions(std)
    return std.withColumn("sensor_type", F.lit(sensor)).drop("_file", "_block")


def file_positions(df: DataFrame, pos_col: str = "idx") -> DataFrame:
    """0-based row position inside each file, from the scan itself.

    A file split is read by one task in file order, so its rows carry
    consecutive ``monotonically_increasing_id`` values.  A small table with
    one row per (file, split) -- first id and row count -- gives each split's
    offset as a running sum over the file's splits; joining it back places
    every row without reordering or checkpointing the data.  Both reads of the
    scan are planned identically, so their ids agree (also when a lost task
    is re-read).
    """
    from pyspark.sql import Window
    r = df.withColumn("_read", F.monotonically_increasing_id())
    splits = r.groupBy("_file", "_block").agg(F.min("_read").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (r.join(splits, ["_file", "_block"])
             .withColumn(pos_col, F.col("_off") + F.col("_read") - F.col("_first"))
             .drop("_read", "_first", "_off"))


HEAD_BYTES = 64 * 1024  # read at a time until the line ends


def _read_heads(batches):
    """mapInPandas body: first line of each listed file, however long, through
    pyarrow's filesystem layer (local, HDFS, S3, ...).  NULL where pyarrow has
    no file system for the scheme; errors while reading are raised."""
    import pandas as pd
    import pyarrow as pa
    from pyarrow import fs as pafs

    for pdf in batches:
        heads = []
        for path in pdf["path"]:
            uri = "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") \
                else path
            try:
                filesystem, inner = pafs.FileSystem.from_uri(uri)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
                heads.append(None)  # the caller scans it as text
                continue
            raw = b""
            with filesystem.open_input_stream(inner) as f:
                while b"\n" not in raw and (more := f.read(HEAD_BYTES)):
                    raw += more
            heads.append(raw.split(b"\n", 1)[0].decode("utf-8", "replace").rstrip("\r"))
        yield pd.DataFrame({"path": pdf["path"], "header": heads})


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, header line) per file.

    The file list comes from ``binaryFile`` without its content column (a
    listing); each task then reads only the head of its files.  Files whose
    scheme pyarrow cannot open fall back to a text scan of their first split.
    """
    from fathom.session import ship_package
    ship_package(spark)
    listing = spark.read.format("binaryFile").load(paths).select("path")
    heads = listing.mapInPandas(_read_heads, "path string, header string")
    missing = heads.where(F.col("header").isNull()).select("path")
    if missing.isEmpty():
        return heads
    return heads.where(F.col("header").isNotNull()).unionByName(
        first_lines_scan(spark, paths).join(missing, "path", "left_semi"))


def first_lines_scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, header line) per file by scanning text: rows of the first split
    (block start 0), first in read order.  Reads whole files; fallback only."""
    t = (spark.read.text(paths)
              .select("value", F.col("_metadata.file_path").alias("path"),
                      F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_read"))
              .where(F.col("_block") == 0))
    return t.groupBy("path").agg(F.min_by("value", "_read").alias("header"))


def sniff_format(headers: DataFrame, sensor: str) -> DataFrame:
    """A file looks valid when >= 3 of the 4 required names appear in its
    lower-cased, trimmed header; LiDAR binaries (.las/.laz) pass by extension."""
    req = F.array(*[F.lit(c) for c in REQUIRED[family(sensor)]])
    cols = F.transform(F.split(F.col("header"), ","), lambda x: F.lower(F.trim(x)))
    found = F.size(F.array_intersect(req, cols))
    ok = found >= 3
    if family(sensor) == "lidar":
        ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1))
        ok = ext.isin(*LIDAR_BINARY_EXT) | ok
    return headers.select("path", found.alias("required_found"), F.coalesce(ok, F.lit(False)).alias("valid"),
                          F.array_except(req, cols).alias("missing_required"))


def file_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, name, size and modification time of every file (content not read)."""
    b = spark.read.format("binaryFile").load(paths)
    return b.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
                    F.col("length").alias("file_size_bytes"), "modificationTime")


def file_catalog_with_columns(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """Catalogue plus each file's header columns (first line, trimmed)."""
    cols = first_lines(spark, paths).select(
        "path", F.transform(F.split(F.col("header"), sep), lambda c: F.trim(c)).alias("columns"))
    return file_catalog(spark, paths).join(cols, "path", "left")


def file_checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SHA-256 of every file's bytes (one task per file; files < 2 GB)."""
    b = spark.read.format("binaryFile").load(paths)
    return b.select("path", F.col("length").alias("file_size_bytes"),
                    F.sha2(F.col("content"), 256).alias("checksum"))


def read_metadata_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Survey metadata / payload JSON documents (one object per file)."""
    return spark.read.option("multiLine", True).json(paths)


# Catalogue of supported inputs and outputs (small literal table).
# Input extensions per sensor, output formats and their extensions.
SUPPORTED = {
    "mbes": ["csv", "txt", "all"], "sbes": ["csv", "txt", "all"], "lidar": ["las", "laz", "txt"],
    "singlebeam": ["csv", "txt"], "auv": ["csv", "txt", "json"],
}
OUTPUT_EXTENSIONS = {"netcdf": [".nc"], "bag": [".bag"], "geotiff": [".tif", ".tiff"]}


def supported_formats(spark: SparkSession) -> DataFrame:
    rows = [(s, e) for s, exts in SUPPORTED.items() for e in exts]
    return spark.createDataFrame(rows, "sensor_type STRING, extension STRING")


def dispatch(sensor: str) -> dict:
    """Sensor -> reader settings, rule set and z column (the parser dispatch)."""
    fam = family(sensor)
    return {"family": fam, "required": REQUIRED[fam], "aliases": ALIASES[fam],
            "z": "elevation" if fam == "lidar" else "depth"}
