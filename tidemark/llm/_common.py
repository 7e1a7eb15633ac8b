"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import ship

#: Rows that a Python worker turns into objects at a time; batches may hold texts of any length.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The columns keep of df and those of the DDL string more."""
    return T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(more).fields)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType) -> DataFrame:
    """mapInArrow with columns as Python lists, SLICE rows at a time, so that memory doesn't grow with the partition.

    fn gets the columns by name and returns those of schema; it may return another number of rows.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, null texts as empty ones, whatever else docs holds and however its columns are called."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: A space before a non-space: the byte-level pre-tokenizer always starts a new word there.
WORD_START = re.compile(r" (?=\S)")
#: A space that no non-space follows.
NO_WORD = re.compile(r" (?:\s|$)")


def pieces(text: str) -> list[str]:
    """The text cut before each space that a non-space follows, these spaces taken off (before the first piece is none).

    No pre-token of the byte-level pattern spans such a cut, so that the pieces can be encoded one by one.
    """
    return WORD_START.split(text) if NO_WORD.search(text) else text.split(" ")


class Memo(dict):
    """A bounded memo in two generations: entries that aren't used while a generation fills up are forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def recall(self, key):
        """An entry of the generation before, which is then one of the present one; None if there is none."""
        found = self.before.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
