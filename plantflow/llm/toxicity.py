"""Toxicity scores from FTRL-proximal logistic regression on hashed word features.

Features are the distinct hashed word unigrams, word stems (first letters), bigrams and
skip-grams (word, next but one) of a text. Learning keeps per-coordinate rates and an L1
term, so that only features seen often enough in one class get a weight; the trained model
is a sparse table of at most `2**BITS` weights, whatever the corpus, and that bound is what
makes it safe to broadcast; it travels as its nonzero entries.

The classifier is fitted on a bounded sample of labelled rows: at most about
`max_positive` and `max_negative` ids, taken in order of a hash of the id, one text of each
(rows that repeat an id count once), with all features of each text. Where the features of the sample
take more than `max_bytes`, fewer ids are taken, by another hash. Features are made where the rows are
read; FTRL itself is sequential, so one task learns from that sample, of a bounded
number of bytes. Scoring reads every whole text once, with all its features and no shuffle.

Null or empty text has no features and gets the intercept's score. Rows without a
label, or with a null one, teach nothing; of repeated labels for an id the largest
counts. Without any usable label all scores are 0.5. Repeated ids are scored row by
row. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.llm.text import ngram_hashes, slices, stem_hashes, word_hashes
from plantflow.llm.worker import release

BITS = 20
STEMS = (4, 5, 6)
THRESHOLD = 0.7
EPOCHS, ALPHA, BETA, L1, L2, POSITIVE = 6, 1.0, 1.0, 16.0, 0.0, 4.0


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each row of a byte slice."""
    words, ptr, _, _ = word_hashes(data, offs)
    shift = np.uint64(64 - BITS)
    one = (words >> shift).astype(np.int32)
    two = (ngram_hashes(words, 2) >> shift).astype(np.int32)
    skip = words[:-2] * np.uint64(0xD6E8FEB86659FD93) + words[2:] if len(words) > 2 else words[:0]
    skip = (ngram_hashes(skip, 1) >> shift).astype(np.int32)
    stems = [(x >> shift).astype(np.int32) for x in stem_hashes(data, offs, STEMS)]
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
        yield np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)], *(x[a:b] for x in stems)]))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text")):
            rows = [x.tobytes() for x in features(data, offs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(rows, pa.binary())],
                ["id", "label", "feats"],
            )


def _learn(table: pa.Table) -> pa.Table:
    """FTRL-proximal over the sample, in an order fixed by its content."""
    release()
    feats = [np.frombuffer(x.as_buffer(), np.int32) for chunk in table["feats"].chunks for x in chunk]
    rows = list(zip(feats, table["label"].to_pylist()))
    order = sorted(range(len(rows)), key=lambda r: (zlib.crc32(rows[r][0]), len(rows[r][0]), rows[r][1]))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    for _ in range(EPOCHS):
        for r in order:
            i = np.append(rows[r][0], 1 << BITS)
            w = weight(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - rows[r][1]
            g *= POSITIVE if rows[r][1] else 1.0
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    w = weight(np.arange(len(z)))
    at = np.flatnonzero(w)
    return pa.table({"feature": pa.array(at, pa.int32()), "weight": pa.array(w[at], pa.float64())})


def fit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_positive: int = 3_000, max_negative: int = 6_000, max_bytes: int = 256 << 20
) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, weights) that aren't zero, the intercept's number last of all, from rows outside the held-out third."""
    ident = F.col("doc_id").cast("string")
    known = labels.select(F.col("doc_id"), F.col("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(F.crc32(ident) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).limit(2).collect()}
    share = F.when(F.col("label") == 1, min(1.0, max_positive / max(1, sizes.get(1, 0)))).otherwise(
        min(1.0, max_negative / max(1, sizes.get(0, 0)))
    )
    # Places are whole millionths and a finer part, so that a small share of many rows is cut exactly.
    finer = F.pmod(F.xxhash64(F.lit("finer"), ident), F.lit(1 << 30)) / F.lit(1 << 30)
    dealt = F.pmod(F.xxhash64(F.lit("sample"), ident), F.lit(1_000_000)) + finer
    sample = known.where(dealt < share * 1_000_000).select(F.col("doc_id").alias("id"), "label")
    # At most about max_positive + max_negative rows, so this side may be broadcast.
    rows = documents.select(F.col(id_col).alias("id"), F.col("text")).join(F.broadcast(sample), "id")
    feats = rows.select(F.col("id").cast("long").alias("id"), "label", "text").mapInArrow(_featurize, "id long, label int, feats binary")
    feats = feats.groupBy("id").agg(F.max("label").alias("label"), F.min("feats").alias("feats")).persist()
    held = feats.agg(F.sum(F.length("feats"))).first()[0] or 0
    fewer = feats.where(F.pmod(F.xxhash64(F.lit("fewer"), "id"), F.lit(1 << 20)) < int(max_bytes / held * (1 << 20))) if held > max_bytes else feats
    table = fewer.groupBy(F.lit(0).alias("one")).applyInArrow(_learn, "feature int, weight double").toArrow()
    feats.unpersist()
    return table["feature"].to_numpy(), table["weight"].to_numpy().astype(np.float32)


def dense(weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weights by feature number, the intercept last."""
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[weights[0]] = weights[1]
    return out


def _probability(data: np.ndarray, offs: np.ndarray, w: np.ndarray) -> np.ndarray:
    total = np.array([w[f].sum(dtype=np.float64) for f in features(data, offs)]) + float(w[-1])
    return 1.0 / (1.0 + np.exp(-np.clip(total, -60, 60)))


def score(documents: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for every row."""
    model = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        w = dense(model.value)
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                p = _probability(data, offs, w)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`documents` without the rows scored as toxic, all columns as they were; clean rows stay.

    The decision is made inside the task that reads the row, so nothing is shuffled.
    """
    weights = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        w = dense(weights.value)
        for batch in batches:
            at = batch.schema.names.index("text")
            for lo, hi, data, offs in slices(batch.column(at)):
                p = _probability(data, offs, w)
                yield batch.slice(lo, hi - lo).filter(pa.array(p < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out"), "score", "predicted")


ORACLE = None
