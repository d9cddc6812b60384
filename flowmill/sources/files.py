"""Leaf directories of CSV, newline-delimited JSON, capture files, and the chunked CSV sink."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import cell_text, python_float
from ..operators.flows import labelled_flows
from ..operators.net import Network
from ..operators.reshape import chunked, shifted
from ..operators.validate import check_folder

#: First four bytes of capture files (fixed values): name of the extension by hex.
MAGIC = {"D4C3B2A1": ".pcap", "A1B2C3D4": ".pcap", "4D3CB2A1": ".pcap", "A1B23C4D": ".pcap", "0A0D0D0A": ".pcapng"}


def place() -> Column:
    """The place of a row among all that a scan reads: its file's path by components, the start of its block in bytes, and its order in the block.

    Files are read in blocks by many tasks; sorting by the place gives files by name and their rows as they stand.
    """
    path = F.translate(F.col("_metadata.file_path"), "/", "\x01")  # so that a folder comes before those whose names go on
    return F.struct(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def read_leaf(spark: SparkSession, path: str) -> DataFrame:
    """All ``.csv`` files of a directory as text columns, with ``file`` and ``place``; header lines are checked."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", "*.csv").csv(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), place().alias("place"))


def leaf_files(spark: SparkSession, path: str) -> list[str]:
    """Names of a directory's ``.csv`` files in order, those without rows too; none is an error."""
    fs, at = _folder(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if not f.isDirectory() and f.getPath().getName().endswith(".csv"))
    if not names:
        raise ValueError(f"no CSV files in {path}")
    return names


def first_bad_line(spark: SparkSession, path: str | list[str]) -> tuple[str, int] | None:
    """File and line number of the first line that is neither blank nor JSON; lines are counted from 1."""
    lines = spark.read.text(path).select("value", place().alias("place"))
    bad = lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNull()).agg(F.min("place")).first()[0]  # one value
    if bad is None:
        return None
    until = (F.col("place.path") == F.lit(bad.path)) & ((F.col("place.block") < bad.block) | ((F.col("place.block") == bad.block) & (F.col("place.at") <= bad.at)))
    return bad.path.replace("\x01", "/"), lines.filter(until).count()


def read_ndjson(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, StructType]:
    """One JSON object a line, as (rows of text cells with ``place``, the types that JSON gave them).

    Cells are the texts of the JSON values as they stand.  Blank lines are skipped; a malformed line is an error that names its file and line.
    """
    if bad := first_bad_line(spark, path):
        raise ValueError(f"not JSON: {bad[0]}:{bad[1]}")
    kinds = spark.read.option("mode", "FAILFAST").json(path).schema
    texts = StructType([StructField(f.name, StringType()) for f in kinds])
    return spark.read.schema(texts).option("mode", "FAILFAST").json(path).select("*", place().alias("place")), kinds


def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path: the folder may be on any storage that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_named(rows: DataFrame, path: str, order: list[str], columns: list[str], replace: bool = False) -> list[str]:
    """Write rows to one CSV file for each value of ``file``, of that name, in ``order``; gives the names.

    All files are written to a staging folder first.  Only then an old output goes, which without ``replace`` must not
    exist or be empty; no rows are an error and leave it as it is.
    """
    spark = rows.sparkSession
    fs, target = _folder(spark, path)
    old = fs.exists(target) and len(fs.listStatus(target)) > 0
    if old and not replace:
        raise ValueError(f"{path} isn't empty")
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    text = rows.repartition("file").sortWithinPartitions("file", *order).select("file", *(F.col(f"`{c}`") for c in columns))
    text.write.partitionBy("file").options(header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(staged)
    _, top = _folder(spark, staged)
    names = []
    for folder in fs.listStatus(top):  # one file each: a rename, no data
        if folder.isDirectory():
            name = folder.getPath().getName().split("=", 1)[1]
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            move(fs, part, _folder(spark, f"{staged}/{name}")[1])
            fs.delete(folder.getPath(), True)
            names.append(name)
    if not names:
        fs.delete(top, True)
        raise ValueError("no rows to write")
    fs.delete(_folder(spark, f"{staged}/_SUCCESS")[1], False)
    swap(spark, staged, path)
    return sorted(names)


def move(fs, old, new) -> None:
    """A rename whose result is looked at: some file systems give false instead of an error."""
    if not fs.rename(old, new):
        raise OSError(f"{old} wasn't renamed to {new}")


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def listing(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and sizes of a folder's files."""
    fs, at = _folder(spark, path)
    return {f.getPath().getName(): f.getLen() for f in fs.listStatus(at) if not f.isDirectory()} if fs.exists(at) else {}


def finished(spark: SparkSession, path: str) -> dict[str, int] | None:
    """What the manifest beside a folder lists, if the folder holds just that; it is written last, so a killed write has none that fits."""
    fs, at = _folder(spark, manifest_path(path))
    if not fs.exists(at):
        return None
    told = json.loads("".join(r.value for r in spark.read.text(manifest_path(path), wholetext=True).collect()))  # one small file
    return told if told == listing(spark, path) else None


def write_manifest(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, manifest_path(path))
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(listing(spark, path)).encode()))
    finally:
        out.close()


def existing_batch(spark: SparkSession, path: str, existing: str) -> list[str] | None:
    """What to do about an output that is there: its file names with ``reuse`` if it is finished, else None to write it anew.

    ``replace`` always writes, ``abort`` raises an error if anything is there.
    """
    if existing not in ("reuse", "replace", "abort"):
        raise ValueError("an existing output is reused, replaced or a reason to abort")
    if existing == "abort" and listing(spark, path):
        raise ValueError(f"{path} isn't empty")
    told = finished(spark, path) if existing == "reuse" else None
    return sorted(told) if told else None


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put a whole folder in the place of an old one, which is kept aside until the new one is there and comes back if it doesn't get there."""
    fs, target = _folder(spark, path)
    _, new = _folder(spark, staged)
    _, aside = _folder(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    held = fs.exists(target)
    if held:
        move(fs, target, aside)
    elif target.getParent() is not None:
        fs.mkdirs(target.getParent())
    fs.delete(_folder(spark, manifest_path(path))[1], False)
    try:
        move(fs, new, target)
    except Exception:
        if held:
            move(fs, aside, target)
        raise
    if held:
        fs.delete(aside, True)
    write_manifest(spark, path)


def write_chunks(df: DataFrame, path: str, rows: int, order: list[str], time: str = "daytime", pattern: str = "yyyyMMddHHmmss", replace: bool = False) -> list[str]:
    """Write ``rows`` rows a file in order; names are the chunk's number and its first time by ``pattern``."""
    out = chunked(df, rows, order, time=time, pattern=pattern)
    return write_named(out, path, ["rn"], [c for c in df.columns if c != "file"], replace)


def rewrite_shifted(df: DataFrame, path: str, baseline: Column, file: str, order: list[str], time: str = "daytime", names: list[str] | None = None) -> list[str]:
    """Move all times so that the first is at ``baseline`` and write one output for each input file that has rows.

    Names are the input's place among all files and its first moved time; ``names`` lists the files, where some have no rows.
    """
    moved = shifted(df, baseline, time).withColumnRenamed(file, "_in")
    first = moved.groupBy("_in").agg(F.min(time).alias("_first"))
    if names is None:
        places = first.select("_in", (F.row_number().over(Window.orderBy("_in")) - 1).alias("_at"))  # a row for each file
    else:
        places = df.sparkSession.createDataFrame(list(zip(sorted(names), range(len(names)), strict=True)), "_in string, _at int")
    name = F.concat(F.lpad(F.col("_at").cast("string"), 5, "0"), F.lit("_"), F.date_format("_first", "yyyyMMddHHmmss"), F.lit(".csv"))
    named = moved.join(first.join(places, "_in").select("_in", name.alias("file")), "_in")
    return write_named(named, path, order, [c for c in df.columns if c not in (file, "place")])


def target_logs(names: str | list[str]) -> list[str]:
    """Log names of a setting, stripped, without blanks and repeats, in order."""
    found = [x.strip() for x in (names.split(",") if isinstance(names, str) else names)]
    kept = [x for x in dict.fromkeys(found) if x]
    if not kept or any("/" in x for x in kept):
        raise ValueError("name one log at least, without a folder")
    return kept


def log_folders(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """``path`` if it has one of the logs, else those of its folders that do, sorted; none is an error."""
    fs, top = _folder(spark, path)
    if not fs.exists(top):
        raise ValueError(f"{path} doesn't exist")
    has = lambda at: any(fs.exists(_folder(spark, f"{at}/{n}")[1]) for n in names)
    if has(path):
        return [path]
    inner = sorted(f.getPath().toString() for f in fs.listStatus(top) if f.isDirectory())
    found = [x for x in inner if has(x)]
    if not found:
        raise ValueError(f"no log folders in {path}")
    return found


def read_logs(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, StructType]:
    """All records of a log in ``path`` as ``read_ndjson`` gives them; columns are the union over all files."""
    fs = _folder(spark, path)[0]
    paths = [f"{at}/{name}" for at in log_folders(spark, path, [name])]
    return read_ndjson(spark, [p for p in paths if fs.exists(_folder(spark, p)[1])])


def first_time(records: DataFrame) -> float | None:
    """The least ``ts`` of records, bad ones left out."""
    return records.agg(F.min(F.col("ts").cast("string").try_cast("double"))).first()[0]


def log_to_csv(spark: SparkSession, path: str, out: str, net: Network, names: str | list[str] = ("conn.log",), rows: int = 3000, zone: str = "Asia/Tokyo", batch: str | None = None, check: bool = True, existing: str = "replace") -> dict[str, list[str]]:
    """Logs to labelled rows in order of end time, ``rows`` a CSV file; gives the files of each folder written.

    Each log has a folder of its own, named by the log without its extension and ``batch`` (the input's name).  Rows of one second stand
    in the order of folders and lines.  An earlier output is replaced once the new one is whole, or by ``existing`` reused if it is
    finished, or a reason to abort; without any labelled record it stays and an error is raised.  Connection rows are then checked against their contract.
    """
    done: dict[str, list[str]] = {}
    logs = target_logs(list(names) if not isinstance(names, str) else names)
    log_folders(spark, path, logs)
    batch = batch or path.rstrip("/").rsplit("/", 1)[-1]
    for name in logs:
        folder = f"{out.rstrip('/')}/{name.rsplit('.', 1)[0] or name}/{batch}"
        if (held := existing_batch(spark, folder, existing)) is not None:
            done[folder] = held
            continue
        records, kinds = read_logs(spark, path, name)
        conn = name == "conn.log"
        span = F.col("duration") if "duration" in records.columns else F.lit(None).cast("string")
        found = labelled_flows(records.withColumn("_span", span.try_cast("double")), net, zone, padded=conn)
        others = [c for c in found.columns if c not in ("daytime", "label", "place", "_span")]
        shown = {f.name: cell_text(F.col(f"`{f.name}`"), f.dataType) for f in kinds} | {"duration": F.coalesce(python_float(F.col("_span")), F.lit("0"))}
        cells = found.select(F.to_timestamp("daytime").alias("_t"), "place", "daytime", F.col("label").cast("string").alias("label"), *((shown[c] if c in shown else F.col(f"`{c}`").cast("string")).alias(c) for c in others))
        done[folder] = write_named(chunked(cells, rows, ["_t", "place"], time="_t"), folder, ["rn"], ["daytime", "label", *others], replace=True)
        if conn and check and not (told := check_folder(spark, folder)).ok:
            raise ValueError(f"{folder} breaks the contract of flow rows\n{told.text()}")
    return done


def capture_extensions(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension) of the files under ``path`` by their first bytes; null for other files."""
    magic = F.hex(F.substring("content", 1, 4))
    known = F.create_map(*(F.lit(x) for pair in MAGIC.items() for x in pair))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.try_element_at(known, magic).alias("extension"))


def unique_folder(spark: SparkSession, path: str) -> str:
    """``path``, or with the first free suffix _01, _02 and so on, on any storage that Spark reads."""
    out, n = path, 0
    while _folder(spark, out)[0].exists(_folder(spark, out)[1]):
        n += 1
        out = f"{path}_{n:02d}"
    return out
