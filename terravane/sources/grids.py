"""Readers and writers of grid files and feature stacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators.joins import attach
from terravane.operators.sampling import FEATURES

HEADER_LINES = 6
HEADER_KEYS = ["ncols", "nrows", "xllcenter", "yllcenter", "xllcorner", "yllcorner", "cellsize", "nodata_value"]


def _numbered_lines(spark: SparkSession, path, about: Mapping[str, Column]) -> DataFrame:
    """Lines with file, line number, the file's header values and the columns ``about`` its path, without gathering a file in one task.

    Ids grow along each split of a file; the line count of the splits before it gives every split its offset.  The same pass
    takes the header, whose keys no line of numbers begins with, so that the files are read once for both and once for their cells.
    """
    lines = (
        spark.read.text(path)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    worded = F.trim("value").rlike("^[A-Za-z]")
    parts = F.split(F.trim("value"), r"\s+")
    told = lines.withColumns({"_k": F.when(worded, F.lower(parts[0])), "_v": F.when(worded, F.get(parts, F.lit(1)).try_cast("double"))})
    splits = told.groupBy("file_path", "file_block_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in HEADER_KEYS])
    from pyspark.sql import Window as W

    # One row per split of a file.
    file = W.partitionBy("file_path")
    before = file.orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumns({k: F.max(k).over(file) for k in HEADER_KEYS})
    splits = splits.select(
        "file_path", "file_block_start", "_first", "_offset", "cellsize", "nrows", F.col("nodata_value").alias("_nodata"),
        F.coalesce("xllcenter", F.col("xllcorner") + F.col("cellsize") / 2).alias("_x0"),
        F.coalesce("yllcenter", F.col("yllcorner") + F.col("cellsize") / 2).alias("_y0"), *[c.alias(n) for n, c in about.items()])
    return attach(lines, splits, ["file_path", "file_block_start"]).withColumn("line", F.col("_id") - F.col("_first") + F.col("_offset"))


def read_ascii_grid(spark: SparkSession, path, about: Mapping[str, Column] | None = None) -> DataFrame:
    """ESRI ASCII grids -> ``(file_path, r, c, x, y, value)``; row 0 is north and the file's NODATA value becomes NULL.

    ``about`` adds columns made from ``file_path``, computed once per file.
    """
    about = about or {}
    lines = _numbered_lines(spark, path, about)
    body = lines.filter((F.col("line") >= HEADER_LINES) & (F.trim("value") != ""))
    cells = body.select(
        "file_path", *about, (F.col("line") - HEADER_LINES).cast("int").alias("r"), "cellsize", "nrows", "_nodata", "_x0", "_y0",
        F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "_t"),
    )
    v = F.col("_t").try_cast("double")
    return cells.select(
        "file_path", *about, "r", "c",
        (F.col("_x0") + F.col("c") * F.col("cellsize")).alias("x"),
        (F.col("_y0") + (F.col("nrows") - 1 - F.col("r")) * F.col("cellsize")).alias("y"),
        F.when(F.col("_nodata").isNull() | (v != F.col("_nodata")), v).alias("value"),
    )


def step_of_name() -> dict[str, Column]:
    """``variable`` and ``step`` of names ``<prefix>_<variable><NNNN>.asc``.

    The variable is the part after the last underscore, with its digit (phase)
    or ``_max`` suffix; a grid that Spark wrote is a folder of that name.
    """
    name = F.regexp_extract("file_path", r"(?:[^/=]*=)?([^/=]+)\.asc(?:/[^/]*)?$", 1)
    pattern = r"(?:^|_)([a-z]+(?:_max)?[0-9]?)([0-9]{4})$"
    return {"variable": F.regexp_extract(name, pattern, 1), "step": F.regexp_extract(name, pattern, 2).cast("int")}


def with_step(cells: DataFrame) -> DataFrame:
    """Add ``variable`` and ``step`` of :func:`step_of_name`."""
    return cells.withColumns(step_of_name())


def read_step_grids(spark: SparkSession, path, about: Mapping[str, Column] | None = None) -> DataFrame:
    """Time-step grids with the variable and step of their file names."""
    return read_ascii_grid(spark, path, {**(about or {}), **step_of_name()})


def read_xyz(spark: SparkSession, path, background: float | None = None, layout: str = "export") -> DataFrame:
    """Numbered point tables ``pv<NNNN>.csv`` with their step; numbers beyond 9999 have more digits.

    The two extra heights are ``h, s`` in the export layout and ``base, phase1`` in
    the simulator's; the background value becomes NULL.
    """
    extra = ("h", "s") if layout == "export" else ("base", "phase1")
    names = ["x", "y", "z", *extra, "red", "green", "blue"]
    schema = ", ".join(f"{n} double" for n in names)
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").option("enforceSchema", True).csv(path)
    step = F.regexp_extract("_metadata.file_path", r"pv([0-9]{4,})", 1).cast("int")
    out = df.select(step.alias("step"), *names)

    def clean(n):
        v = F.nanvl(F.col(n), F.lit(None).cast("double"))
        return v if background is None else F.when(v != background, v)

    return out.withColumns({n: clean(n) for n in names})


def export_xyz(layers: Mapping[str, DataFrame], on: Sequence[str] = ("x", "y"), digits: int = 2) -> DataFrame:
    """Join co-registered layers ``(x, y, value)`` to ``x, y, z, h, s, r, g, b``.

    No flow (h = 0) and nodata codes become NULL; the CSV sink writes them as NaN.
    """
    order = ["z", "h", "s", "r", "g", "b"]
    out = None
    for name in order:
        layer = layers[name].select(*on, F.col("value").alias(name))
        out = layer if out is None else out.join(layer, list(on))
    codes = lambda c: F.when((c != 65535) & ~F.isnan(c), c)
    cols = {n: codes(F.col(n).cast("double")) for n in order}
    cols["h"] = F.when(F.col("h") != 0, cols["h"])
    scale = float(10**digits)
    return out.select(*on, *[(F.floor(cols[n] * scale + 0.5) / scale).alias(n) for n in order])


def write_xyz(df: DataFrame, path: str, on: Sequence[str] = ("x", "y")) -> None:
    df.orderBy(*on).write.mode("overwrite").option("header", True).option("nullValue", "NaN").csv(path)


def read_monthly_stack(spark: SparkSession, paths: Mapping[int, str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Monthly layers (Parquet ``x, y, prec``) of the months that exist, with
    ``month``; the box is pushed down to each scan."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    out = None
    for month, p in sorted(paths.items()):
        if not exists(p):
            continue
        part = spark.read.parquet(p)
        if box is not None:
            west, south, east, north = box
            part = part.filter(F.col("x").between(west, east) & F.col("y").between(south, north))
        part = part.withColumn("month", F.lit(month))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no monthly layer is available")
    return out


def write_stack(df: DataFrame, path: str, features: Sequence[str] = tuple(FEATURES)) -> None:
    """Ordered feature stack by site; absent or non-finite values are 0.

    Rows are spread over (site, row band) before the write, so a large site gives
    several files.
    """
    ready = stack_columns(df, features)
    band = F.floor(F.col("r") / 256)
    ready.repartition("site", band).sortWithinPartitions("site", "r", "c").write.mode("overwrite").partitionBy("site").parquet(path)


def stack_columns(df: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    zero = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.select("site", "r", "c", *[(zero(f) if f in df.columns else F.lit(0.0)).alias(f) for f in features])


def read_stack(spark: SparkSession, path: str, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    return stack_columns(spark.read.parquet(path), features)
