"""Shared plumbing: the shared work folder, written tables, and table loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def fresh(name: str, *tables: DataFrame) -> str:
    """The name, lengthened until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's spark.checkpoint.dir. Only where that is unset and everything runs in one process (tests)
    a temporary folder is made and put in its place; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes df and returns the written table."""
        path = f"{self.path}/{name}"
        df.write.options(**options).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes one written table that nothing reads any more, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column whose null counts as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def one_of_repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One of the rows that share an id and a text; rows without an id stay. Only texts whose id occurs again are moved."""
    name, sha = fresh("__lf_id", docs), fresh("__lf_sha", docs)
    ids = docs.select(F.col(f"`{id_col}`").alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name)
    same = F.col(f"`{id_col}`") == F.col(name)
    again = docs.join(ids, same, "left_semi").withColumn(sha, F.sha2(text_of(text_col), 256)).dropDuplicates([id_col, sha]).drop(sha)
    return docs.join(ids, same, "left_anti").unionByName(again)


def arrow_rows(schema: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]]) -> Callable:
    """A function for mapInArrow from one that yields columns by name; schema: a Spark DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return run


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null as empty, bytes that aren't UTF-8 as replacement characters."""
    try:
        return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
    except UnicodeDecodeError:
        return [x.decode(errors="replace") for x in as_bytes(batch, name)]


def small_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text, so that memory follows bytes and not rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        rows = max(1, int(batch.num_rows * most / max(1, column.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def annotate(df: DataFrame, text_col: str, added: str, values: Callable[[list[bytes]], dict[str, list]]) -> DataFrame:
    """df with more columns, made from whole texts as UTF-8 bytes (null: empty), slice by slice.

    added: DDL of the new columns. The text moves to the executors' Python once; other columns pass untouched.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    if clash := {c.lower() for c in new.names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    arrow, at = to_arrow_schema(new), df.columns.index(text_col)
    names = [f.name for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            renamed = batch.rename_columns([f"c{k}" for k in range(batch.num_columns)])
            for part in small_slices(iter([renamed]), f"c{at}"):
                made = values(as_bytes(part, f"c{at}"))
                arrays = [pa.array(made[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))
