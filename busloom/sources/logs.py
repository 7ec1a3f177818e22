"""Raw captures as text: bracketed-time logs and comma-separated captures, read with a table of the lines that are no frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A log's line: time in brackets, interface, identifier of 3 or 8 hexadecimal digits, up to eight bytes.
LOG = r"^\((\d{1,12})\.(\d{1,6})\)\s+(\S+)\s+([0-9A-Fa-f]{3}|[0-9A-Fa-f]{8})#((?:[0-9A-Fa-f]{2}){0,8})\s*$"
#: A capture's line: time, identifier, bytes and, if known, the label.
CSV = r"^(\d{1,12})\.(\d{1,6}),()([0-9A-Fa-f]{1,8}),((?:[0-9A-Fa-f]{2}){0,8})(?:,([01]))?\s*$"
HEADER = "timestamp,arbitration_id,data_field,attack"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(capture, line, value): lines numbered from 0 in the order of a capture's files.

    A file lies in a folder capture=name, or is a capture by itself, named without its ending. Readers cut files into blocks;
    lines are numbered within their block, and only the blocks' counts are added up along a capture.
    """
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    folder = F.regexp_extract("_metadata.file_path", "/capture=([^/]+)/", 1)
    capture = F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_replace(F.url_decode(file), r"\.[^.]*$", ""))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(capture.alias("capture"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    block = ["capture", "file", "block"]
    along = Window.partitionBy("capture").orderBy("file", "block")
    before = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).select(*block, (F.sum("n").over(along) - F.col("n")).alias("before"))
    within = Window.partitionBy(*block).orderBy("at")
    return lines.withColumn("i", F.row_number().over(within) - 1).join(before, block).select("capture", (F.col("before") + F.col("i")).alias("line"), "value")


def _read(spark: SparkSession, path: str, shape: str, label: bool) -> tuple[DataFrame, DataFrame]:
    part = lambda k: F.regexp_extract("value", shape, k)
    lines = _numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    if label:
        lines = lines.where((F.col("line") > 0) | (F.lower("value") != HEADER))
    good, aid = F.col("value").rlike(shape), F.conv(part(4), 16, 10).cast("long")
    reason = F.when(F.trim("value") == "", "empty").when(~good, "no frame").when(aid > 0x1FFFFFFF, "identifier too large")
    judged = lines.withColumn("reason", reason)
    data = part(5)
    byte = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i * 2 < F.length(data), F.conv(F.substring(data, i * 2 + 1, F.lit(2)), 16, 10).cast("int")).otherwise(-1))
    frames = judged.where("reason IS NULL").select(
        "capture",
        F.col("line").alias("seq"),
        (part(1).cast("long") * 1_000_000 + F.rpad(part(2), 6, "0").cast("long")).alias("us"),
        aid.cast("int").alias("aid"),
        F.floor(F.length(data) / 2).cast("int").alias("dlc"),
        byte.alias("b"),
        *([F.when(part(6) != "", part(6).cast("int")).alias("y")] if label else []),
    )
    return frames, judged.where("reason IS NOT NULL").select("capture", "line", "value", "reason")


def read_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames (capture, seq, us, aid, dlc, b; absent bytes -1) of text logs under path, and the other lines with a reason each.

    seq is the line's number in its capture, from 0; bad lines take a number too. Nothing is dropped unseen.
    """
    return _read(spark, path, LOG, False)


def read_csv_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of comma-separated captures; a header in the first line is skipped, y is null where a line has no label."""
    return _read(spark, path, CSV, True)


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number), digits, "0")


def _payload() -> Column:
    return F.array_join(F.transform(F.slice("b", 1, F.col("dlc")), lambda x: _hex(x, 2)), "")


def _time() -> Column:
    return F.concat(F.floor(F.col("us") / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col("us") % 1_000_000).cast("string"), 6, "0"))


def log_line() -> Column:
    """A frame's line in a text log; identifiers beyond 11 bits have 8 digits."""
    aid = F.when(F.col("aid") > 0x7FF, _hex(F.col("aid"), 8)).otherwise(_hex(F.col("aid"), 3))
    return F.concat(F.lit("("), _time(), F.lit(") can0 "), aid, F.lit("#"), _payload())


def csv_line() -> Column:
    return F.concat_ws(",", _time(), _hex(F.col("aid"), 3), _payload(), F.col("y").cast("string"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes lines (capture, seq, value) in order, a folder for each capture; files are in the order of their names."""
    lines.repartitionByRange("capture", "seq").sortWithinPartitions("capture", "seq").select("capture", "value").write.partitionBy("capture").text(path)
