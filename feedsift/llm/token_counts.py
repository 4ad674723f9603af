"""Token counts of whole texts (operator 2).

Texts are cut at safe boundaries (see pieces), the distinct pieces of an Arrow batch go to the tokenizer in batches of
about equal bytes, and only lengths come back. No shuffle; a task holds one Arrow batch and a bounded table of piece lengths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, whole_text
from .pieces import PieceTable, encode_pieces, tokenizer


class Lengths(PieceTable):
    def __init__(self, path: str):
        self.tokenizer, self.lengths = tokenizer(path), np.zeros(0, dtype=np.int64)
        super().__init__(self.add, self.stay)

    def add(self, new: list[str]) -> None:
        found = np.fromiter(map(len, encode_pieces(self.tokenizer, new)), dtype=np.int64, count=len(new)) // 4
        self.lengths = np.concatenate([self.lengths, found])

    def stay(self, numbers: np.ndarray) -> None:
        self.lengths = self.lengths[numbers]


@lru_cache(maxsize=1)
def lengths(path: str) -> Lengths:
    return Lengths(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of docs, for a byte-level BPE file of the tokenizers library.

    Null texts count as empty (0 bytes, 0 tokens); null ids, repeated rows and other columns, whatever their names, make
    no difference: one row comes out for each that goes in. Texts of any length are counted whole."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lengths(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            found = [table.number(t.as_py()) for t in texts]
            table.settle(found)
            n = [int(table.lengths[x].sum()) for x in found]
            table.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=schema.names)

    rows = small_batches(docs).select(F.col(id_col), whole_text(text_col).alias("__text"))
    return rows.withColumn("__bytes", F.octet_length("__text").cast("long")).mapInArrow(count, schema)
