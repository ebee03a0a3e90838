"""File sources and sinks.

* ``read_typed_csv`` — text by default, named columns typed; ``NA`` and empty
  cells (quoted or not) are missing, blanks trimmed; a bad number becomes
  missing (``try_cast``), as the source reader does with a warning.  A
  ``ReadReport`` counts such cells while the table is read.
* ``write_csv`` — header, missing as ``NA``, numbers without exponent.
* ``read_sheet`` / ``write_sheet`` — sheets whose header sits below a few
  title lines (``skip``); a folder may hold many such files, of any size:
  lines are read by block, and quoted line breaks are put together across
  blocks.

Quotes in cells are doubled, as spreadsheets and the source's writer do.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import expr, ident
from ..schema import NA_TEXT
from ..session import scratch_path


def _clean_text(c: str) -> F.Column:
    return F.nullif(F.col(f"`{c}`"), F.lit(""))


class ReadReport:
    """What a reader could not type: ``absent`` typed columns, known at once,
    and after the first action that reads the table ``bad_cells``, the cells
    of each typed column that hold something else (they read as missing), and
    ``rows``.  Counted by the task that reads them, without a second scan."""

    def __init__(self) -> None:
        self.absent: list[str] = []
        self.typed: list[str] = []
        self._seen = Observation()

    def watch(self, raw: DataFrame, types: dict[str, str]) -> DataFrame:
        """``raw`` (text columns), counted while it is read; ``types`` are by
        lower-case column name."""
        present = {c.lower(): c for c in raw.columns}
        self.absent = [c for c in types if c not in present]
        self.typed = [present[c] for c in types if c in present]
        bad = [F.count_if(_clean_text(c).isNotNull() & _clean_text(c).try_cast(types[c.lower()]).isNull()).alias(f"bad_{k}")
               for k, c in enumerate(self.typed)]
        return raw.observe(self._seen, F.count(F.lit(1)).alias("rows"), *bad)

    @property
    def rows(self) -> int:
        return self._seen.get["rows"]

    @property
    def bad_cells(self) -> dict[str, int]:
        got = self._seen.get
        return {c: got[f"bad_{k}"] for k, c in enumerate(self.typed)}

    def warnings(self) -> list[str]:
        out = [f"typed column {c} is absent" for c in self.absent]
        return out + [f"{n} of {self.rows} cells of {c} are no number and read as missing" for c, n in self.bad_cells.items() if n]


def read_typed_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, report: ReadReport | None = None) -> DataFrame:
    """CSV with a header: every column text except those in ``types``
    (column -> Spark SQL type)."""
    raw = (
        spark.read.option("header", True)
        .option("nullValue", NA_TEXT)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .csv(path)
    )
    types = {k.lower(): v for k, v in (types or {}).items()}
    if report is not None:
        raw = report.watch(raw, types)
    cols = []
    for c in raw.columns:
        text = _clean_text(c)
        cols.append((text.try_cast(types[c.lower()]) if c.lower() in types else text).alias(c))
    return raw.select(*cols)


def plain_number(x: str) -> str:
    """A double as text without exponent and without loss: the digits that
    tell it from its neighbours, the point moved (``1.23E7`` -> ``12300000``)."""
    # lambdas name the parts once, so the text of the expression stays short
    mantissa = "replace(split(s, 'E')[0], '-', '')"
    parts = (f"named_struct('s', s, 'minus', CASE WHEN s LIKE '-%' THEN '-' ELSE '' END, 'digits', replace({mantissa}, '.', ''),"
             f" 'point', CASE WHEN s LIKE '%E%' THEN instr({mantissa}, '.') - 1 + CAST(split(s, 'E')[1] AS INT) END)")
    moved = ("CASE WHEN r.point <= 0 THEN concat('0.', repeat('0', -r.point), r.digits)"
             " WHEN r.point >= length(r.digits) THEN rpad(r.digits, r.point, '0')"
             " ELSE concat(substr(r.digits, 1, r.point), '.', substr(r.digits, r.point + 1)) END")
    text = f"CASE WHEN r.point IS NULL THEN r.s ELSE concat(r.minus, {moved}) END"
    return f"regexp_replace(get(transform(transform(array(CAST({x} AS STRING)), s -> {parts}), r -> {text}), 0), '[.]0+$', '')"


def printable(df: DataFrame) -> DataFrame:
    """Fractional numbers as text without exponent and without loss, untyped
    all-missing columns as text."""
    cols = []
    for f in df.schema.fields:
        c = ident(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = plain_number(c)
        elif isinstance(f.dataType, (T.DecimalType, T.NullType)):
            c = f"CAST({c} AS STRING)"
        cols.append(f"{c} AS {ident(f.name)}")
    return df.selectExpr(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    printable(df).write.mode(mode).option("header", True).option("nullValue", NA_TEXT).option("escape", '"').csv(path)


def _csv_line(values: Sequence[str]) -> str:
    buf = io.StringIO()
    csv.writer(buf, lineterminator="").writerow(values)
    return buf.getvalue()


def write_sheet(df: DataFrame, path: str, title_lines: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Write a report as sheets: every part file starts with the title lines
    and the header, then its rows; a report without rows is one such file.

    Rows are range-partitioned on ``sort_by`` and sorted within each part, so
    the parts in name order hold the rows in order; no task sees more than its
    range.  The head is put in front of the first row of each part."""
    p = printable(df)
    head = "\n".join([*title_lines, _csv_line(p.columns)])
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in p.columns]), {"nullValue": NA_TEXT, "escape": '"'})
    lines = p.select(*[F.col(f"`{c}`") for c in sort_by], line.alias("value"))
    if sort_by:
        lines = lines.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    else:
        lines = lines.coalesce(1 << 20)  # as they are; rows given by the driver are numbered by the tasks too
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # row numbers start anew in each part
    sheet = lines.select(F.when(first, F.concat(F.lit(head + "\n"), "value")).otherwise(F.col("value")).alias("value"))
    if df.isEmpty():
        sheet = df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    sheet.write.text(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, quotes) of every line, written once to the
    shared folder, so that ``at`` (in order within a block) is the same for
    all that reads it."""
    lines = spark.read.text(path).selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS block", "monotonically_increasing_id() AS at", "value",
        """length(value) - length(replace(value, '"', '')) AS quotes""")
    kept = scratch_path(spark, "sheet-lines")
    lines.write.parquet(kept)
    return spark.read.schema(lines.schema).parquet(kept)


def _records(body: DataFrame) -> DataFrame:
    """Whole records (``value``) from the lines below the headers: lines that
    a quoted line break separates are joined again.

    A line goes on with a record if the quotes before it in its file are odd:
    counted per block, summed over the few blocks of a file, then within the
    block.  Only lines of records of several lines are grouped."""
    blocks = body.groupBy("file", "block").agg(expr("sum(quotes) AS q"))
    before = "OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = blocks.selectExpr("file", "block", f"coalesce(sum(q) {before}, 0) AS q_before", "sum(q) OVER (PARTITION BY file) AS q_all")
    broken = blocks.filter("q_all % 2 = 1").select("file").limit(1).collect()
    if broken:
        raise ValueError(f"a quoted cell of {broken[0][0]} has no end")
    within = "OVER (PARTITION BY file, block ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lines = body.join(blocks, ["file", "block"]).selectExpr(
        "file", "block", "at", "value", "quotes", f"(q_before + coalesce(sum(quotes) {within}, 0)) % 2 = 1 AS goes_on")
    starts = lines.groupBy("file", "block").agg(expr("count_if(NOT goes_on) AS s"))
    starts = starts.selectExpr("file", "block", f"coalesce(sum(s) {before}, 0) AS s_before")
    upto = "OVER (PARTITION BY file, block ORDER BY at)"
    lines = lines.join(starts, ["file", "block"]).selectExpr("*", f"s_before + count_if(NOT goes_on) {upto} AS record")
    single = lines.filter("NOT goes_on AND quotes % 2 = 0").select("value")
    parts = lines.filter("goes_on OR quotes % 2 = 1").groupBy("file", "record").agg(
        expr("array_sort(collect_list(named_struct('block', block, 'at', at, 'value', value))) AS parts"))
    return single.unionByName(parts.selectExpr("array_join(transform(parts, p -> p.value), '\\n') AS value"))


def read_sheet(spark: SparkSession, path: str, skip: int = 0, types: dict[str, str] | None = None) -> DataFrame:
    """Read sheets whose header is on line ``skip + 1``.  A file may be of any
    size and is read in parallel; headers are taken from the first block of
    each file and must be the same in all.  Cells may hold line breaks, the
    lines above the header none."""
    lines = _numbered_lines(spark, path)
    firsts = lines.filter("block = 0").groupBy("file").agg(expr("min(at) AS first_at"))
    tagged = lines.join(firsts, "file", "left").selectExpr("*", f"block = 0 AND at - first_at <= {skip} AS head")
    header = f"CASE WHEN head AND at - first_at = {skip} THEN value END"
    low, high, headers, files, odd = tagged.agg(
        expr(f"min({header})"), expr(f"max({header})"), expr(f"count({header})"), expr("count(DISTINCT file)"),
        expr("count_if(NOT head AND quotes % 2 = 1)")).first()
    if not headers or headers < files:
        raise ValueError(f"no header line {skip + 1} in {'some file of ' if headers else ''}{path}")
    if low != high:
        raise ValueError(f"the files of {path} have different headers: {low!r} and {high!r}")
    names = next(csv.reader([low]))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    body = tagged.filter("NOT head")
    records = _records(body) if odd else body.select("value")
    parsed = records.filter("length(value) > 0").select(F.from_csv("value", schema.simpleString(), {"nullValue": NA_TEXT, "escape": '"'}).alias("r"))
    types = {k.lower(): v for k, v in (types or {}).items()}
    cols = []
    for i, n in enumerate(names):
        c = F.nullif(F.trim(F.col(f"r.c{i}")), F.lit(""))
        cols.append((c.try_cast(types[n.lower()]) if n.lower() in types else c).alias(n))
    return parsed.select(*cols)
