"""Checks of a flow table against its contract, and of folders of CSV files."""

from __future__ import annotations

import csv
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import boolean_like, numeric, parsed_time
from ..session import written
from .flows import REQUIRED
from .net import Network, direction
from .windows import order_violations

#: Columns that may be blank (fixed values).
MAY_BE_BLANK = ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes")
NUMERIC, BOOLEAN = MAY_BE_BLANK, ("local_orig", "local_resp")
CHECKS = ("required_columns", "daytime_format", "time_order", "label_value", "value_types")


def cell_problems(df: DataFrame, file: str, row: str) -> DataFrame:
    """(check, severity, file, row, column) of every violation that one row shows."""
    have, found = set(df.columns), []
    named = lambda check, column: F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    for c in ("daytime", "label", "conn_state", *NUMERIC, *BOOLEAN):
        if c not in have:
            continue
        if c not in MAY_BE_BLANK:
            found.append(F.when(blank(c), named("required_columns", c)))
        if c in NUMERIC:
            found.append(F.when(~blank(c) & numeric(F.col(c)).isNull(), named("value_types", c)))
        if c in BOOLEAN:
            found.append(F.when(~blank(c) & boolean_like(F.col(c)).isNull(), named("value_types", c)))
    found.append(F.when(~blank("daytime") & parsed_time(F.col("daytime")).isNull(), named("daytime_format", "daytime")))
    found.append(F.when(~blank("label") & ~F.coalesce(numeric(F.col("label")).cast("int").isin(0, 1), F.lit(False)), named("label_value", "label")))
    rows = df.select(F.col(file).alias("file"), F.col(row).alias("row"), F.explode(F.array_compact(F.array(*found))).alias("p"))
    return rows.select("p.check", F.lit("ERROR").alias("severity"), "file", "row", "p.column")


def order_problems(df: DataFrame, file: str, row: str) -> DataFrame:
    """The same of times: one for a row earlier than the time before it in its file, one for a row earlier than that over all files."""
    late = order_violations(df.select(F.col(file).alias("file"), F.col(row).alias("row"), parsed_time(F.col("daytime")).alias("t")), "file", "row", "t")
    told = late.select("file", "row", F.explode(F.array_compact(F.array(F.when(F.col("in_file"), "daytime in its file"), F.lit("daytime over files")))).alias("column"))
    return told.select(F.lit("time_order").alias("check"), F.lit("ERROR").alias("severity"), "file", "row", "column")


def problems(df: DataFrame, file: str = "file", row: str = "row") -> DataFrame:
    """(check, severity, file, row, column) of every violation in a table of text columns."""
    return cell_problems(df, file, row).unionByName(order_problems(df, file, row))


def roll_up(found: DataFrame) -> DataFrame:
    """(check, status, n) of every check, OK where nothing was found."""
    spark = found.sparkSession
    every = spark.createDataFrame([(c,) for c in CHECKS], "check string")
    counts = found.groupBy("check").agg(F.count("*").alias("n"))
    return every.join(counts, "check", "left").select("check", F.when(F.col("n") > 0, "NG").otherwise("OK").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def header_problems(headers: dict[str, list[str]], required: tuple[str, ...]) -> list[tuple[str, str, str, str]]:
    """(check, file, severity, text) from the header of each file."""
    out, first = [], None
    for name, header in sorted(headers.items()):
        if not header:
            out.append(("header", name, "ERROR", "empty header"))
            continue
        out += [("header", name, "ERROR", f"duplicate column {c}") for c in sorted({c for c in header if header.count(c) > 1})]
        missing = [c for c in required if c not in header]
        out += [("required_columns", name, "ERROR", f"missing column {c}") for c in missing]
        if missing:
            continue
        if first is not None and header != first:
            out.append(("header", name, "WARNING", "header differs from the first file's"))
        first = first or header
    return out


#: Checks of a folder and its files, which come before those of rows.
FOLDER_CHECKS = ("input_dir", "directory_layout", "csv_files", "header", "row_structure")


@dataclass
class Summary:
    """What a folder's good rows hold.  Labels, directions and values count rows, ``missing`` blank cells of each column."""

    files: int = 0
    rows_per_file: list[int] = field(default_factory=list)
    first: object = None
    last: object = None
    labels: dict[int, int] = field(default_factory=dict)
    directions: dict[str, int] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)
    values: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(self.rows_per_file)

    def text(self) -> str:
        n = self.rows_per_file or [0]
        span = None if self.first is None else int((self.last - self.first).total_seconds())
        tables = [[("rows", f"{self.rows:,}"), ("files", f"{self.files:,}"), ("first", str(self.first or "-")), ("last", str(self.last or "-")), ("fewest rows", f"{min(n):,}"), ("mean rows", f"{round(sum(n) / len(n)):,}"), ("most rows", f"{max(n):,}"), ("seconds", "-" if span is None else f"{span:,}")]]
        for name, counts in (("label", self.labels), ("direction", self.directions), *self.values.items(), ("missing", self.missing)):
            tables.append([(f"{name}={k}", share(v, self.rows)) for k, v in sorted(counts.items(), key=lambda x: (-x[1], str(x[0])))])
        return "\n\n".join(pair_table(t) for t in tables if t)


def share(count: int, total: int) -> str:
    return f"{count * 100 / total if total else 0.0:4.1f}% ({count:,})"


def width(text: str) -> int:
    """Columns that a text takes on a terminal: wide and ambiguous characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "FWA" else 1 for c in text)


def pair_table(entries: list[tuple[str, str]]) -> str:
    """Names and values in two columns of pairs, padded by their display width."""
    cells = [(*entries[i], *(entries[i + 1] if i + 1 < len(entries) else ("", ""))) for i in range(0, len(entries), 2)]
    sizes = [max(width(c[k]) for row in cells for c in [(row[0], row[1]), (row[2], row[3])]) for k in (0, 1)]
    padded = lambda row: "  ".join(text + " " * (sizes[i % 2] - width(text)) for i, text in enumerate(row)).rstrip()
    return "\n".join(padded(row) for row in cells)


@dataclass(frozen=True)
class Report:
    """Problems (check, severity, file, row, column), their number by check and severity, and the status of each check."""

    problems: list[tuple[str, str, str | None, int | None, str | None]]
    counts: dict[tuple[str, str], int]
    statuses: dict[str, str]
    summary: Summary = field(default_factory=Summary)

    @property
    def ok(self) -> bool:
        return not any(n for (_, severity), n in self.counts.items() if severity == "ERROR")

    @property
    def code(self) -> int:
        return 0 if self.ok else 1

    def text(self) -> str:
        total = {s: sum(n for (_, severity), n in self.counts.items() if severity == s) for s in ("ERROR", "WARNING")}
        rows = [f"errors: {total['ERROR']:,}, warnings: {total['WARNING']:,}", *(f"{check}: {status}" for check, status in self.statuses.items())]
        if self.summary.rows:
            rows += ["", self.summary.text(), ""]
        rows += [f"{severity} {check} {file or ''}{'' if row is None else f':{row}'} {column or ''}".rstrip() for check, severity, file, row, column in self.problems]
        if (left := sum(self.counts.values()) - len(self.problems)) > 0:
            rows.append(f"and {left:,} more")
        return "\n".join([*rows, "passed" if self.ok else "failed"])


def report(found: list[tuple], more: dict[tuple[str, str], int], done: tuple[str, ...], summary: Summary | None = None) -> Report:
    """A report of problems of files, and of rows: those that are shown and the number of all."""
    counts = dict(more)
    for check, severity, _, row, _ in found:
        if row is None:
            counts[check, severity] = counts.get((check, severity), 0) + 1
    worst = lambda check: "NG" if counts.get((check, "ERROR")) else "WARNING" if counts.get((check, "WARNING")) else "OK" if check in done else "NOT RUN"
    return Report(found, counts, {c: worst(c) for c in (*FOLDER_CHECKS, *CHECKS)}, summary or Summary())


def read_rows(spark: SparkSession, path: str, names: list[str], header: list[str], quoted: bool) -> DataFrame:
    """(file, at, _bad, cells) of files with one header; ``at`` orders a file's rows.

    Blank lines aren't rows.  With ``quoted`` a file may have line feeds inside quotes and is read by one task, else by as many as it has blocks.
    """
    kind = ", ".join(f"`{c}` string" for c in header) + ", `_bad` string"
    rows = spark.read.schema(kind).options(header=True, multiLine=quoted, escape='"', columnNameOfCorruptRecord="_bad", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv([f"{path}/{n}" for n in names])
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return rows.select(F.col("_metadata.file_name").alias("file"), at.alias("at"), "_bad", *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in header))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``row``, their number in their file; the header is row 1."""
    from .order import global_row_number

    placed = written(global_row_number(rows, ["file", "at"], "_n"), "rows")
    return placed.join(placed.groupBy("file").agg(F.min("_n").alias("_first")), "file").withColumn("row", F.col("_n") - F.col("_first") + 2).drop("_n", "_first", "at")


def check_folder(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED, shown: int = 1000, net: Network | None = None, features: tuple[str, ...] = ()) -> Report:
    """Validate a folder of CSV files: its layout, each header, the rows' structure and cells, and the order of times over all files.

    Files are taken in the order of their names, rows by CSV records.  The report lists at most ``shown`` problems of rows; statuses and
    counts rest on all.  Rows that are blank or have another number of cells than the header are checked no further.  ``net``
    adds directions to the summary, ``features`` the counts of their values (the ``shown`` most frequent).
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return report([("input_dir", "ERROR", None, None, None)], {}, ())
    entries = sorted((f.getPath().getName(), f.isDirectory()) for f in fs.listStatus(at))
    found = [("directory_layout", "ERROR", name, None, None) for name, folder in entries if folder or not name.endswith(".csv")]
    names = [name for name, folder in entries if not folder and name.endswith(".csv")]
    if not names:
        found.append(("csv_files", "ERROR", None, None, None))
        return report(found, {}, ("input_dir", "directory_layout"))
    text = spark.read.text([f"{path}/{n}" for n in names]).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = {r.file: r for r in text.groupBy("file").agg(F.min_by("value", F.when(F.col("block") == 0, F.col("id"))).alias("head"), F.max(odd % 2).alias("open")).collect()}  # a row for each file
    heads = {n: next(csv.reader([seen[n].head]), []) if n in seen and seen[n].head else [] for n in names}
    told = header_problems(heads, required)
    found += [(check, severity, name, None, what) for check, name, severity, what in told]
    broken = {name for _, name, severity, _ in told if severity == "ERROR"}
    good = [n for n in names if n not in broken]
    if not good:
        return report(found, {}, FOLDER_CHECKS)
    bad, cells, times, sums, sizes, summary = None, None, None, [], {}, Summary(files=len(names))
    groups = {}
    for n in good:
        groups.setdefault((tuple(heads[n]), bool(seen[n].open)), []).append(n)
    for (head, quoted), own in groups.items():
        rows = numbered(read_rows(spark, path, own, list(head), quoted))
        blank = F.concat(*(F.col(f"`{c}`") for c in head)) == ""
        what = F.when(blank, "blank row").when(F.col("_bad").isNotNull(), "cells and header differ in number")
        rows = rows.withColumn("_what", what)
        shape = rows.filter("_what is not null").select(F.lit("row_structure").alias("check"), F.lit("ERROR").alias("severity"), "file", "row", F.col("_what").alias("column"))
        fine = rows.filter("_what is null").drop("_what", "_bad")
        bad = shape if bad is None else bad.unionByName(shape)
        wrong = cell_problems(fine, "file", "row")
        cells = wrong if cells is None else cells.unionByName(wrong)
        timed = fine.select("file", "row", "daytime")
        times = timed if times is None else times.unionByName(timed)
        sizes |= {r.file: r["count"] for r in fine.groupBy("file").count().collect()}  # a row for each file
        sums.append(_sums(fine, list(head), net))
        _values(fine, [f for f in features if f in head], shown, summary)
    found += [("row_structure", "ERROR", n, None, "no rows") for n in good if n not in sizes]
    every = written(bad.unionByName(cells).unionByName(order_problems(times, "file", "row")), "problems")
    counts = {(r.check, r.severity): r["count"] for r in every.groupBy("check", "severity").count().collect()}
    found += [tuple(r) for r in every.select("check", "severity", "file", "row", "column").orderBy("file", "row", "check", "column").limit(shown).collect()]
    _merge(sums, sizes, summary)
    return report(found, counts, (*FOLDER_CHECKS, *CHECKS), summary)


def _sums(rows: DataFrame, head: list[str], net: Network | None) -> dict:
    """First and last time, labels, directions and blank cells in one pass."""
    t, label = parsed_time(F.col("daytime")), numeric(F.col("label")).cast("int")
    told = direction(F.col("`id.orig_h`"), F.col("`id.resp_h`"), net, *(boolean_like(F.col(c)) for c in BOOLEAN)) if net and {"id.orig_h", "id.resp_h", *BOOLEAN} <= set(head) else F.lit(None).cast("string")
    rows = rows.withColumn("_direction", told)
    ways: dict[str, Column] = {f"d:{w}": F.count_if(F.col("_direction") == w) for w in ("outbound", "inbound", "unknown")}
    more = {f"m:{c}": F.count_if(F.col(f"`{c}`") == "") for c in head}
    found = rows.agg(F.min(t).alias("first"), F.max(t).alias("last"), *(F.count_if(label == k).alias(f"l:{k}") for k in (0, 1)), *(c.alias(k) for k, c in (ways | more).items())).first()
    return found.asDict()


def _merge(sums: list[dict], sizes: dict[str, int], summary: Summary) -> None:
    summary.rows_per_file = [n for _, n in sorted(sizes.items())]
    firsts, lasts = ([s[c] for s in sums if s[c] is not None] for c in ("first", "last"))
    summary.first, summary.last = min(firsts, default=None), max(lasts, default=None)
    for s in sums:
        for key, n in s.items():
            kind, _, name = key.partition(":")
            if kind in "ldm" and name and (n or kind == "m"):
                counts = {"l": summary.labels, "d": summary.directions, "m": summary.missing}[kind]
                counts[name] = counts.get(name, 0) + n


def _values(rows: DataFrame, features: list[str], shown: int, summary: Summary) -> None:
    for f in features:
        counts = summary.values.setdefault(f, {})
        for r in rows.groupBy(F.col(f"`{f}`").alias("v")).count().orderBy(F.desc("count"), "v").limit(shown).collect():
            name = r.v or "(blank)"
            counts[name] = counts.get(name, 0) + r["count"]
