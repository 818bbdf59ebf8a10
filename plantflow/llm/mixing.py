"""Mixing sources to target weights by Poisson replication.

Every source gets the repetition rate `weight * documents / documents of the source`,
so that the mix has about as many rows as the input and each source its target share.
A document's number of copies inverts the Poisson distribution with that mean at a
uniform value hashed from (seed, id): the same document always gets the same count,
wherever it is processed. Rows are exploded by their count and shuffled globally: a
hash of (seed, id, copy) deals them to partitions and orders them inside.

Null sources form one group of their own. `weights` maps sources to relative weights,
others are left out (weight 0); None gives all sources equal weight. A null id is
stood for by the md5 of its text (null: empty), so rows without ids are drawn each by its
text; repeated ids share their count. An empty table gives an empty mix. Input columns named
like the two added columns are replaced; no other column name clashes.

At scale: counting rows by source is a map-combined aggregate; the rate table has one
row per source and is broadcast only below `BROADCAST_SOURCES` rows, else joined by
shuffle, where a hot source is split by adaptive skew handling. Only the final deal
moves texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.llm.storage import unused

BROADCAST_SOURCES = 20_000
CHUNK_RATE = 64.0


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from the first 52 bits of the md5 of the parts joined by ':'."""
    head = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _inverse(u: Column, cdf: Column) -> Column:
    return F.size(F.filter(cdf, lambda c: c <= u))


def rates(documents: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source") -> DataFrame:
    """(source, rate, chunks, cdf): the rate of each source, cut into chunks with a tabulated CDF.

    A sum of `chunks` independent Poisson values with mean rate / chunks is Poisson with
    mean rate, so each tabulated mean stays small enough for exp(-mean) to be exact.
    """
    counts = documents.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        chosen = F.lit(0.0)
        for name, weight in weights.items():
            chosen = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(chosen)
        weighted = counts.withColumn("w", chosen)
    total = weighted.agg(F.sum("n").alias("all"), F.sum("w").alias("ws"))
    rated = weighted.crossJoin(F.broadcast(total)).withColumn(  # one row
        "rate", F.when(F.col("ws") > 0, F.col("w") / F.col("ws") * F.col("all") / F.col("n")).otherwise(F.lit(0.0))
    )
    rated = rated.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK_RATE)).cast("int"))
    mean = F.col("rate") / F.col("chunks")
    terms = int(CHUNK_RATE + 12 * math.sqrt(CHUNK_RATE) + 24)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("s"), F.array(F.exp(-mean)).alias("c")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            (a["s"] + a["p"] * mean / k).alias("s"),
            F.concat(a["c"], F.array(a["s"] + a["p"] * mean / k)).alias("c"),
        ),
    )
    cdf = F.filter(step["c"], lambda c: c < F.lit(1.0))
    return rated.select("source", "rate", "chunks", cdf.alias("cdf"))


def mix(
    documents: DataFrame,
    weights: dict[str | None, float] | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Replicated, shuffled rows with all their columns plus copy_index and shuffle_key."""
    docs = documents.drop("copy_index", "shuffle_key")
    table = rates(documents, weights, source_col)
    source, chunks, cdf, n = (unused(docs, c) for c in ("mix_source", "mix_chunks", "mix_cdf", "mix_n"))
    table = table.select(F.col("source").alias(source), F.col("chunks").alias(chunks), F.col("cdf").alias(cdf))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    joined = docs.join(table, docs[source_col].eqNullSafe(F.col(source)))
    many = F.aggregate(
        F.sequence(F.lit(1), F.col(chunks)),
        F.lit(0),
        lambda total, chunk: total + _inverse(uniform(F.lit(str(seed)), ident, chunk.cast("string")), F.col(cdf)),
    )
    counted = joined.withColumn(n, many).where(F.col(n) > 0)
    copies = counted.withColumn("copy_index", F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}s"), ident, F.col("copy_index").cast("string"))))
    dealt = keyed.select(*docs.columns, "copy_index", "shuffle_key").repartition(F.col("shuffle_key"))
    return dealt.sortWithinPartitions("shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sql(docs: str = "documents", seed: int = 17, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB text of `mix` with equal weights, over the relation `docs`."""
    return f"""
SELECT {columns}, CAST(k AS INTEGER) AS copy_index,
       md5('{seed}s:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':' || k) AS shuffle_key
FROM (
  SELECT d.*, unnest(range(1, CAST(list_sum(list_transform(range(1, r.chunks + 1), lambda c: len(list_filter(r.cdf, lambda x: x <=
         (CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))) || ':' || c), 1, 13) AS BIGINT) + 0.5)
         / 4503599627370496.0)))) + 1 AS BIGINT))) AS k
  FROM {docs} d JOIN (
    SELECT source, chunks, list_filter(list_transform(range(0, 185), lambda k: list_sum(list_transform(range(0, k + 1),
           lambda j: exp(-m + j * ln(m) - lgamma(j + 1))))), lambda x: x < 0.9999999999999) AS cdf
    FROM (SELECT source, rate, greatest(1, CAST(ceil(rate / 64.0) AS BIGINT)) AS chunks,
                 rate / greatest(1, CAST(ceil(rate / 64.0) AS BIGINT)) AS m
          FROM (SELECT source, sum(count(*)) OVER () / (count(*) OVER () * 1.0) / count(*) AS rate FROM {docs} GROUP BY source))
  ) r ON d.source IS NOT DISTINCT FROM r.source)
"""


ORACLE = mix_sql()
