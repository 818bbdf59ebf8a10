"""Exact deduplication through a log-structured merge index of text digests.

Memtables collect (digest, smallest id, rows) inside each task and flush as sorted runs.
Compaction deals the runs by ranges of the digest, sorts each range and merges
neighbours in one pass: the smallest identifier of a digest survives and row counts add
up. The compacted index is a table of sorted runs with a Bloom filter on the digest in their
files, and one filter over its hits, the digests of more than one row. Rows probe that
filter where they are read; only what passes takes part in byte verification, which compares
the texts behind each hit, and a digest that stands for different texts is split by text. A
row that passes by chance meets no other, so the filter never changes a result.

Texts are equal when identical after each run of 0x20 / 0x09-0x0D becomes one space;
null text counts as empty. Null ids sort after all others: a group of null ids only
keeps a row with a null id. Of rows that repeat both text and id, one is kept. An
empty table gives an empty result. Extra columns are ignored, whatever their names.

At scale: the first pass reads each text once and leaves (id, digest) rows; only these
are shuffled for the index, combined in the memtables, so a digest held by a third of
all rows costs one entry per flush. Verification is a smallest and largest text by digest,
combined in the map tasks: a hot digest moves two texts a task. The filter of the hits has
at most `FILTER_BYTES`; beyond that it lets more rows through and stays right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.llm.storage import materialize, scratch_dir, unused

GAPS = r"[\x20\x09-\x0D]+"
FILTER_BYTES = 8 << 20
PROBES = 4


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " ")


def _merged(entries: pa.Table) -> pa.Table:
    """Sorted entries with equal digests made one."""
    run = entries.group_by("digest", use_threads=False).aggregate([("keep_id", "min"), ("rows", "sum")])
    return run.rename_columns(["digest", "keep_id", "rows"]).sort_by("digest")


def memtable_runs(keys: DataFrame, memtable_rows: int = 1_000_000) -> DataFrame:
    """Sorted runs (digest, keep_id, rows): each task flushes whenever its memtable is full."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            memtable.append(batch)
            held += batch.num_rows
            if held >= memtable_rows:
                yield from _merged(pa.Table.from_batches(memtable)).to_batches()
                memtable, held = [], 0
        if memtable:
            yield from _merged(pa.Table.from_batches(memtable)).to_batches()

    rows = keys.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("rows"))
    return rows.mapInArrow(fill, "digest string, keep_id long, rows long")


def write_run(run: DataFrame, path: str) -> DataFrame:
    """A run on disk with a Bloom filter on its digests."""
    run.write.option("parquet.bloom.filter.enabled#digest", "true").option(
        "parquet.bloom.filter.max.bytes", str(1 << 20)
    ).parquet(path)
    return run.sparkSession.read.schema(run.schema).parquet(path)


def compact(*runs: DataFrame) -> DataFrame:
    """Merge runs into one: sorted ranges of digests, one entry per digest, with the smallest id and all rows counted."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # entries of the last digest seen, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = _merged(table if held is None else pa.concat_tables([held, table]))
            held = table.slice(table.num_rows - 1)
            yield from table.slice(0, table.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    ranges = merged.repartitionByRange("digest").sortWithinPartitions("digest")
    return ranges.mapInArrow(merge, "digest string, keep_id long, rows long")


def _places(digests: pa.Array, bits: int) -> np.ndarray:
    """(probes, rows): positions of each digest in a filter of `bits` bits, a power of two."""
    from pandas.util import hash_array

    h = hash_array(digests.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    step = h >> np.uint64(32) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]).astype(np.int64)


def hit_filter(index: DataFrame, limit: int = FILTER_BYTES) -> np.ndarray:
    """Bloom filter over the digests of more than one row, at most `limit` bytes whatever the corpus.

    Blocks of the filter are combined by Spark; the driver gets those that have a bit.
    """
    hits = index.where("rows > 1").select("digest")
    n, bits = hits.count(), 1 << 13
    while bits < 12 * n and bits < 8 * limit:
        bits *= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column("digest"), bits).ravel()
            np.bitwise_or.at(mask, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        words = mask.view(np.int64)
        used = np.flatnonzero(words)
        for lo in range(0, len(used), 1 << 16):
            part = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"at": pa.array(part, pa.int64()), "word": pa.array(words[part], pa.int64())})

    words = hits.mapInArrow(spread, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    mask = np.zeros(bits // 64, np.int64)
    mask[words["at"].to_numpy()] = words["word"].to_numpy()
    return mask.view(np.uint8)


def may_hit(rows: DataFrame, mask: np.ndarray) -> DataFrame:
    """Rows whose column `digest` passes the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(mask)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        for batch in batches:
            at = _places(batch.column("digest"), 8 * len(mask))
            yield batch.filter(pa.array((mask[at >> 3] >> (at & 7) & 1).all(axis=0)))

    return rows.mapInArrow(probe, rows.schema)


def verify(docs: DataFrame, index: DataFrame, digest_hex: int = 64) -> DataFrame:
    """Digests that stand for more than one text, found by comparing the bytes of all hits."""
    texts = docs.select(normalized(F.col("text")).alias("text"))
    texts = texts.select(F.substring(F.sha2("text", 256), 1, digest_hex).alias("digest"), "text")
    ends = may_hit(texts, hit_filter(index)).groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    return ends.where("lo <> hi").select("digest")


def exact_groups(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64, memtable_rows: int = 1_000_000
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha256 of the normalised text.

    `digest_hex` shortens the index digest (tests use it to force collisions).
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _groups(docs, _keys(docs, digest_hex), digest_hex, memtable_rows)


def _keys(docs: DataFrame, digest_hex: int = 64) -> DataFrame:
    """(id, sha, digest) of each row of (id, text), written once."""
    sha = docs.select("id", F.sha2(normalized(F.col("text")), 256).alias("sha"))
    return materialize(sha.withColumn("digest", F.substring("sha", 1, digest_hex)), "keys")


def _groups(docs: DataFrame, keys: DataFrame, digest_hex: int = 64, memtable_rows: int = 1_000_000) -> DataFrame:
    runs = write_run(memtable_runs(keys, memtable_rows), f"{scratch_dir(docs.sparkSession)}/runs")
    index = write_run(compact(runs), f"{scratch_dir(docs.sparkSession)}/index")
    collided = materialize(verify(docs, index, digest_hex), "collided")
    counted = keys.groupBy("digest", "sha", "id").agg(F.count("*").alias("same"))
    clean = counted
    if not collided.isEmpty():
        clean = counted.join(collided, "digest", "left_anti")
    out = clean.join(index, "digest").select("id", "keep_id", "rows", "sha", "same")
    if not collided.isEmpty():
        # Different texts never share a sha256, so the full hash splits a shortened digest by text.
        mixed = counted.join(collided, "digest", "left_semi")
        by_text = mixed.groupBy("sha").agg(F.min("id").alias("keep_id"), F.sum("same").alias("rows"))
        out = out.unionByName(mixed.join(by_text, "sha").select("id", "keep_id", "rows", "sha", "same"))
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))).alias("nth")
    return out.select("*", row).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("rows").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`documents` with one row of each group of equal texts, all columns as they were, whatever their names."""
    key, ident, sha = (unused(documents, c) for c in ("exact_key", "exact_id", "exact_sha"))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = _keys(docs)
    groups = _groups(docs, keys).where("kept")
    keep = materialize(groups.select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha)), "keep")
    tagged = documents.withColumn(key, F.sha2(normalized(F.col(text_col)), 256))
    match = (F.col(key) == F.col(sha)) & F.col(id_col).cast("long").eqNullSafe(F.col(ident))
    kept = tagged.join(keep, match, "left_semi")
    repeated = keys.groupBy("id", "sha").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated.select(F.col("id").alias(ident), F.col("sha").alias(sha)), "repeated")
    if repeated.isEmpty():
        return kept.drop(key)
    once = kept.join(repeated, match, "left_anti")
    again = kept.join(repeated, match, "left_semi").dropDuplicates([id_col, key])
    return once.unionByName(again).drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents),
r AS (
  SELECT doc_id, sha, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
         row_number() OVER (PARTITION BY sha, doc_id) AS nth FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, sha AS text_sha256 FROM r
"""
