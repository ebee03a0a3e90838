"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: Java pattern of the white space that separates words (space, tab to CR).
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Byte table: ASCII letters lower-cased, everything that is not a letter,
#: digit or part of a non-ASCII character becomes a space.
LETTER_DIGIT_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

#: Byte table: ASCII letters lower-cased, the rest kept.
LOWER_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the cluster's shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: the
    lineage ends there, so a lost executor costs no recomputation of it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: DuckDB: the CRC-32 table as the list ``tab`` of a CTE ``poly``, and the value of an ASCII text read through it.
CRC_TABLE_SQL = """poly AS (SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) x(i)))"""


def crc_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), "
            "lambda c, s: xor(c >> 8, tab[(xor(c, s) & 255) + 1])), 4294967295)")


def planned_bytes(df: DataFrame) -> int | None:
    """The planner's size of ``df`` where it follows the bytes of the files
    that are read (a scan with filters and projections); else None."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(name in plan.toString() for name in ("Join", "Generate", "Expand", "Aggregate", "MapIn", "Range", "LogicalRDD")):
        return None
    return int(plan.stats().sizeInBytes())


def pieces(df: DataFrame, each: int = 16 << 20) -> int:
    """Parts of ``df`` of about ``each`` bytes as stored, so that a part's
    size does not grow with the table; at least the session's shuffle
    partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(planned_bytes(df) or 0) // each))


class Aside:
    """The further columns of a table, packed into one while an operator works,
    so that none of its own column names can clash with theirs.

    ``rows`` has the columns ``reads`` and the pack; ``restored(df, results)``
    gives the table's columns in their order with the operator's results
    after them; a column with a result's name is replaced."""

    def __init__(self, df: DataFrame, reads: list[str]):
        self.columns, self.reads = df.columns, reads
        self.others = [c for c in df.columns if c not in reads]
        self.pack = "_aside"
        while self.pack in df.columns:
            self.pack += "_"
        packed = F.struct(*[F.col(f"`{c}`") for c in self.others]) if self.others else F.struct(F.lit(None).cast("int").alias("none"))
        self.rows = df.select(*[F.col(f"`{c}`") for c in reads], packed.alias(self.pack))

    def restored(self, df: DataFrame, results: list[str] = ()) -> DataFrame:
        own = [F.col(f"`{c}`") if c in self.reads else F.col(self.pack)[c].alias(c) for c in self.columns if c not in results]
        return df.select(*own, *[F.col(f"`{c}`") for c in results])


def words_of(texts):
    """(words, offsets) of an Arrow array of texts: the runs of characters
    other than space and tab to CR, and where each text's begin and end."""
    import numpy as np  # noqa: PLC0415
    import pyarrow as pa  # noqa: PLC0415
    import pyarrow.compute as pc  # noqa: PLC0415

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    some = pc.not_equal(words, "")
    if not pc.all(some).as_py():  # white space at an end of a text
        offsets = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[offsets]
        words = words.filter(some)
    return words, offsets


def lower_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(LETTER_DIGIT_BYTES).split() if text else []


def plain_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters other than space and tab to CR."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER_BYTES) if lower else raw).split()


def give_back() -> None:
    """At the end of a task: memory that Arrow holds but does not use goes
    back to the machine, which the worker's later tasks share with others."""
    import pyarrow as pa  # noqa: PLC0415

    pa.default_memory_pool().release_unused()


def add_columns(df: DataFrame, reads: list[str], fields: list[tuple[str, str, object]], make) -> DataFrame:
    """``df`` with computed columns, in Arrow batches.

    ``make()`` runs once per task and returns a function from the lists of the
    columns ``reads`` to one list per field; ``fields`` are (name, SQL type,
    Arrow type).  Every other column passes through untouched; a column with a
    field's name is replaced."""
    new = {n for n, _, _ in fields}
    kept = [c for c in df.columns if c not in new]
    schema = df.select(*[f"`{c}`" for c in kept]).schema
    for n, t, _ in fields:
        schema = schema.add(n, T.DataType.fromDDL(t))

    def run(batches):
        import pyarrow as pa  # noqa: PLC0415

        f = make()
        for b in batches:
            lists = f(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in reads])
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            cols += [pa.array(v, t) for v, (_, _, t) in zip(lists, fields)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *[n for n, _, _ in fields]])
        give_back()

    return df.mapInArrow(run, schema)
