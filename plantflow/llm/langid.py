"""Language identification by nearest centroids of TF-IDF character n-grams.

A text becomes the counts of its hashed character n-grams of one to three letters (lower
case, everything that is not a letter read as a single blank), weighted by IDF and
normalised. Each language has several centroids found by spherical k-means; a text gets
the language of the centroid with the largest cosine. A text farther from that centroid
than `slack` times the distance that holds `QUANTILE` of the centroid's own learning
texts is marked as rejected.

Document frequencies are counted over all learning rows. Centroids are fitted on a
bounded sample: about `fit_rows` learning rows of each language, in order of a hash of
the id. The model has languages x centroids x 2**BITS numbers, however large the
corpus, and is broadcast: 96 KB a language. Centroids are fitted for `LANGUAGES_AT_ONCE` languages
at a time, so that fitting needs no more memory where a column holds many.

`und` with score 0 goes to null text and text without a letter. Rows with a null language
teach nothing; without any learning row all are `und`. Repeated and null ids are handled
row by row; other columns are ignored.

At scale: counting sends one row per used feature and task, combined by a sum. k-means sums
meet by centroid, so the driver gets one row per centroid, however many tasks there are;
scoring is a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 13
DIM = 1 << BITS
CENTROIDS = 3
ROUNDS = 4
QUANTILE = 0.995
LANGUAGES_AT_ONCE, BROADCAST_LANGUAGES = 512, 20_000
SLICE_ROWS, TASK_ROWS = 64, 512
PIECE_CHARS = 1 << 18

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[65]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def _mixed(code: np.ndarray, salt: int) -> np.ndarray:
    x = (code + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the text's hashed n-grams; None without a letter. Long texts go piece by piece."""
    if not text:
        return None
    lower, table, total, tail, seen = text.lower(), _letters(), np.zeros(DIM, np.int64), np.array([32], np.uint64), False
    for lo in range(0, len(lower), PIECE_CHARS):
        codes = np.frombuffer(lower[lo : lo + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = table[codes]
        seen = seen or bool(is_letter.any())
        codes = np.where(is_letter, codes, 32).astype(np.uint64)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first of a run of blanks stays
        keep[0] |= tail[-1] != 32
        codes = codes[keep]
        joined = np.concatenate([tail, codes])
        k = len(tail)
        pairs = joined[:-1] * np.uint64(0x200000) + joined[1:]
        total += np.bincount(_mixed(joined[k:], 1), minlength=DIM)
        total += np.bincount(_mixed(pairs[k - 1 :], 2), minlength=DIM)
        if len(joined) > 2:
            triples = pairs[:-1] * np.uint64(0x200000) + joined[2:]
            total += np.bincount(_mixed(triples[max(0, k - 2) :], 3), minlength=DIM)
        tail = joined[-2:]
    return total if seen else None


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised TF-IDF rows, whether each text has a letter); tf is log-scaled."""
    out, real = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        got = counts(text)
        if got is not None:
            row = np.log(got.astype(np.float32) + np.float32(1)) * idf
            norm = float(np.sqrt((row * row).sum()))
            if norm > 0:
                out[i], real[i] = row / norm, True
    return out, real


def _learning(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = documents.select(ident.alias("ident"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.where((F.crc32("ident") % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _frequencies(rows: DataFrame) -> np.ndarray:
    """IDF over all learning rows; the last entry of the counts is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), SLICE_ROWS):
                for text in texts.slice(lo, SLICE_ROWS).to_pylist():
                    got = counts(text)
                    if got is not None:
                        df[:-1] += got > 0
                        df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["feature", "n"])

    found = rows.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIM + 1)
    df[found["feature"].to_numpy()] = found["n"].to_numpy()
    return (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)


def _assign(x: np.ndarray, langs: list[str], owner: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row among those of its own language, and the cosine."""
    cosine = x @ centroids.T
    cosine[np.array(langs)[:, None] != owner[None, :]] = -1
    at = cosine.argmax(axis=1)
    return at, cosine[np.arange(len(x)), at]


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    """Sum of a centroid's texts and the distance that holds `QUANTILE` of them, from the parts of all tasks."""
    parts = [np.frombuffer(x, np.float32) for x in table["total"].to_pylist()]
    total = np.sum(sorted(parts, key=bytes), axis=0, dtype=np.float64) if len(parts[0]) else np.zeros(0)
    far = [d for ds in table["far"].to_pylist() for d in ds]
    return pa.table({"centroid": table["centroid"].slice(0, 1), "total": [total.tobytes()], "far": [float(np.quantile(far, QUANTILE)) if far else 0.0]})


def fit(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 3_000, slack: float = 1.1
) -> dict:
    """IDF, centroids with their languages, and the rejection distance of each centroid."""
    spark = documents.sparkSession
    rows = _learning(documents, id_col, text_col, lang_col)
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.collect()}  # one row a language
    empty = {"idf": np.ones(DIM, np.float32), "owner": np.zeros(0, str), "centroids": np.zeros((0, DIM), np.float32), "radius": np.zeros(0)}
    if not sizes:
        return empty
    idf = _frequencies(rows)
    dealt = F.pmod(F.xxhash64(F.lit("fit"), "ident"), F.lit(1 << 20))
    known = [(lang, int(min(1.0, fit_rows / n) * (1 << 20))) for lang, n in sizes.items()]
    shares = spark.createDataFrame(known, "lang string, share int")
    shares = F.broadcast(shares) if len(known) <= BROADCAST_LANGUAGES else shares
    seedling = F.pmod(F.xxhash64(F.lit("start"), "ident"), F.lit(CENTROIDS)).cast("int")
    sample = rows.join(shares, "lang").where(dealt < F.col("share")).select("text", "lang", seedling.alias("start"))
    # A shuffle of the bounded sample; merging scan tasks instead would hold all their file readers open at once.
    expected = sum(min(n, fit_rows) for n in sizes.values())
    sample = sample.repartition(max(1, min(spark.sparkContext.defaultParallelism, -(-expected // TASK_ROWS)))).persist()
    names, parts = sorted(sizes), []
    for lo in range(0, len(names), LANGUAGES_AT_ONCE):
        some = names[lo : lo + LANGUAGES_AT_ONCE]
        parts.append(_cluster(sample if len(some) == len(names) else sample.where(F.col("lang").between(some[0], some[-1])), some, idf, slack))
    sample.unpersist()
    owner, centroids, radius = (np.concatenate(x) for x in zip(*parts))
    return {"idf": idf, "owner": owner, "centroids": centroids, "radius": radius}


def _cluster(sample: DataFrame, names: list[str], idf: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language of each centroid, centroids, rejection distances) of the languages `names`, by spherical k-means."""
    spark = sample.sparkSession
    owner = np.array([lang for lang in names for _ in range(CENTROIDS)])
    centroids, radius = None, np.zeros(len(owner))
    for round_ in range(ROUNDS + 1):
        state = spark.sparkContext.broadcast((idf, owner, centroids))
        last = round_ == ROUNDS

        def run(batches: Iterator[pa.RecordBatch], state=state, last=last) -> Iterator[pa.RecordBatch]:
            idf, owner, centroids = state.value
            sums, seen, far = np.zeros((len(owner), DIM)), np.zeros(len(owner), np.int64), [[] for _ in owner]
            for batch in batches:
                for lo in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(lo, SLICE_ROWS).to_pydict()
                    x, real = vectors(part["text"], idf)
                    if centroids is None:
                        at, cosine = np.searchsorted(owner, part["lang"]) + np.array(part["start"]), np.ones(len(x))
                    else:
                        at, cosine = _assign(x, part["lang"], owner, centroids)
                    for c in np.unique(at[real]):
                        mine = real & (at == c)
                        sums[c] += x[mine].sum(axis=0)
                        seen[c] += mine.sum()
                        far[c] += (1 - cosine[mine]).tolist()
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([b"" if last else sums[c].astype(np.float32).tobytes() for c in used], pa.binary()),
                    pa.array([far[c] if last else [] for c in used], pa.list_(pa.float64())),
                ],
                ["centroid", "total", "far"],
            )

        # Sums of the tasks meet by centroid: one row each for the driver.
        sums = sample.mapInArrow(run, "centroid int, total binary, far array<double>")
        found = sums.groupBy("centroid").applyInArrow(_gather, "centroid int, total binary, far double").toArrow().to_pydict()
        if last:
            radius[found["centroid"]] = np.array(found["far"]) * slack
            break
        fresh = np.zeros((len(owner), DIM))
        for c, total in zip(found["centroid"], found["total"]):
            fresh[c] = np.frombuffer(total)
        norm = np.sqrt((fresh * fresh).sum(axis=1, keepdims=True))
        kept = centroids if centroids is not None else np.zeros_like(fresh)
        centroids = np.where(norm > 0, fresh / np.maximum(norm, 1e-12), kept).astype(np.float32)
    return owner, centroids, radius


def identify(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine), rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, owner, centroids, radius = (shared.value[k] for k in ("idf", "owner", "centroids", "radius"))
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                x, real = vectors(part.column("text").to_pylist(), idf)
                if len(owner):
                    cosine = x @ centroids.T
                    at = cosine.argmax(axis=1)
                    best = np.clip(cosine[np.arange(len(x)), at], 0, 1).astype(float)
                    lang, reject = np.where(real, owner[at], "und"), real & (1 - best > radius[at])
                    best = np.where(real, best, 0.0)
                else:
                    lang, reject, best = np.full(len(x), "und"), np.zeros(len(x), bool), np.zeros(len(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(best), pa.array(reject)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return identify(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


ORACLE = None
