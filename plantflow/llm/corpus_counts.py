"""Corpus-wide counts brought back to the documents they came from.

Documents are dealt to parts by a hash. Each part sends its distinct keys once, packed
by bucket, so a key that a third of all documents hold costs one entry per part. A
bucket adds the counts up and answers each part for the keys it sent. Documents never
move twice: both steps read the same exchange.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


UNIT, SMALLEST, LARGEST = 8 << 20, 128 << 20, 2 << 30


def part_count(total: int, most: int = LARGEST) -> int:
    """Parts for `total` bytes of text, none of over about `most` bytes.

    A part holds `UNIT` bytes of text at a GB and grows with the root of the input. Every part
    sends a row to every bucket, so the packed rows, parts times buckets, are in proportion to
    the input: 16,384 a GB, up to 64 TB with parts of 2 GB.
    """
    size = min(most, max(UNIT, int(UNIT * math.sqrt(total / (1 << 30)))))
    return int(max(1, min(64, total // (256 << 10)), -(-total // size)))


def part_limit(spark: SparkSession) -> int:
    """Largest part for the cluster: a quarter of an executor's memory for a core, within `SMALLEST` and `LARGEST`."""
    conf = spark.sparkContext.getConf()
    memory = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.executor.memory", "1g"))
    cores = int(conf.get("spark.executor.cores", "1"))
    return max(SMALLEST, min(LARGEST, memory // (4 * cores)))


def deal(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """(`docs` with an int column `part`, number of parts); rows that repeat both id and text meet in one part."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = part_count(total, part_limit(docs.sparkSession))
    ident = F.xxhash64("doc_id", text_col)
    return docs.withColumn("part", F.pmod(ident, F.lit(parts)).cast("int")), parts


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit hash, in order of its upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def tally(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often (or with what total weight) each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        return values[first], np.diff(np.r_[first, len(values)])
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[first], np.add.reduceat(weights[order], first)
