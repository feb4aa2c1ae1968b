"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file, as ranks; a parameter of all that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that this vocabulary's merges were made under.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    """The tokenizer; once for each worker and file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def common_words(path: str) -> frozenset[str]:
    """The words of four letters or more that a vocabulary has whole, with the blank before them."""
    with open(path, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f)
        words = (t[1:].decode("utf-8", "ignore") for t in tokens if t.startswith(b" "))
        return frozenset(w for w in words if len(w) >= 4 and w.isalpha() and w.islower())


def _shipped(spark: SparkSession, path: str) -> str:
    """The name under which every worker finds a vocabulary file: Spark brings it to all machines."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rpartition("/")[2]


def with_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, n_tokens): the size of each whole text; null and empty texts have 0.

    Rows are independent: nothing is shuffled, and only the size leaves the worker.
    """

    name = _shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(SparkFiles.get(name))
        for b in batches:
            n = [len(one.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[id_col, *keep, "n_tokens"])

    narrow = df.select(id_col, *keep, F.col(text_col).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", n_tokens long"
    return narrow.mapInArrow(run, schema)
