"""Interaction of text filters: what each removes at each step of every order they can run in.

Five filters judge a whole text (A: few words, B: few distinct words, C: many capitals, D: odd
characters, E: identical to the text of a smaller id). A document becomes a mask of the filters it fails, and
the masks, counted by part, give every figure of all 120 orders.

E is found with radix tries. Each task inserts its texts into a compressed trie whose terminals hold the
smallest id; when the trie holds `FLUSH_BYTES` of text it is flushed. Rows that are not the smallest of
their text there are duplicates for certain and go on without the text; each flush sends every
distinct text once, with its smallest id. Those texts are dealt by range: the space of texts is
split at adaptive prefixes, longer where many texts begin alike, so that ranges hold about equal
bytes. A range's trie gets each full text, keeps the smallest id at its terminal and, when all are
in, tells each sent id whether it is the smallest of the table.

Defined cases: a null text is empty, a null source the part ''. A null id is no smaller id and
has none, so it never fails E. Rows that repeat id and text tie and fail E together or not at all.
Of several labels of a document one that is set counts. Other columns are ignored, whatever
their names; an empty table gives an empty result.

At scale: full texts move once, each distinct text once a flush, so a text that a third of all rows
share costs a row a flush. The ranges come from a sample of at most `SAMPLE` distinct texts a
range, of which the driver sees prefixes; the sample only balances the ranges and never decides a result.
Labels meet rows of (id, part, mask), not texts. From the masks on there are at most 32 rows a part,
whatever the corpus.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.llm.corpus_counts import part_count, part_limit

FLUSH_BYTES = 32 << 20
SAMPLE = 16
FIRST_PREFIX = 24

CAPITALS, ODD, CONTINUATION = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")


class Trie:
    """Compressed byte trie; a terminal holds the smallest id of its text."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, smallest id

    def insert(self, text: bytes, ident: int) -> list:
        """The terminal of `text`, after `ident` was taken into account."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                node, at = child, len(text)
                break
            label = child[0]
            if not text.startswith(label, at):
                shared = common(label, text, at)
                upper = [label[:shared], {label[shared]: child}, None]
                child[0] = label[shared:]
                node[1][text[at]] = upper
                child = upper
                label = upper[0]
            node, at = child, at + len(label)
        if node[2] is None or ident < node[2]:
            node[2] = ident
        return node


def common(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest common prefix of `label` and `text[at:]`."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def failed(text: bytes) -> int:
    """Mask of the filters A to D that `text` fails."""
    words = text.split()  # of bytes: splits at 0x20 and 0x09-0x0D
    points = len(text) if text.isascii() else len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * capitals > 5 * points) << 2
        | (len(text.translate(None, ODD)) != len(text)) << 3
    )


def prefix_cuts(documents: DataFrame, text_col: str, ranges: int, rows: int) -> list[bytes]:
    """At most `ranges` - 1 sorted prefixes that split the texts into ranges of about equal bytes.

    A sample chosen by a hash of the text weighs prefixes. Prefixes that outweigh half a range
    are told apart by ones four times as long, until a text stands alone or ends.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = max(1, rows // (SAMPLE * ranges))
    sample = documents.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    sample = sample.select("text", F.octet_length("text").alias("bytes")).persist()
    total = sample.agg(F.sum("bytes")).first()[0] or 0
    heavy, weights, size = None, {}, FIRST_PREFIX
    while heavy is None or heavy:
        inside = sample
        if heavy is not None:
            known = documents.sparkSession.createDataFrame([(p,) for p in heavy], "prefix string")
            inside = sample.withColumn("prefix", F.substring("text", 1, size // 4)).join(known, "prefix", "left_semi")
        found = inside.groupBy(F.substring("text", 1, size).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.max(F.length("text")).alias("longest"), F.count("*").alias("texts")).collect()
        for p in heavy or ():
            del weights[p]
        weights.update((r.prefix, r.bytes) for r in found)
        heavy = [r.prefix for r in found if r.longest > size and r.texts > 1 and r.bytes > total / (2 * ranges)]
        size *= 4
    sample.unpersist()
    cuts, held = [], 0
    for prefix in sorted(weights, key=str.encode):
        if held >= total / ranges:
            cuts.append(prefix.encode())
            held = 0
        held += weights[prefix]
    return cuts[: ranges - 1]


def masks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", flush_bytes: int = FLUSH_BYTES, ranges: int | None = None) -> DataFrame:
    """(id, part, mask, n): documents by the filters they fail, rows that agree in id, part and mask counted together per task."""
    spark = documents.sparkSession
    bytes_, rows = documents.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    ranges = ranges or part_count(bytes_ or 0, part_limit(spark))
    shared = spark.sparkContext.broadcast(prefix_cuts(documents, text_col, ranges, rows))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = "range int, id long, part string, mask int, n long, text binary"

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["range", "id", "part", "mask", "n", "text"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value

        def flush(seen: dict, terminals: dict) -> Iterator[pa.RecordBatch]:
            """Ids that are their text's smallest go with the text; the other rows are certain and go as counts."""
            rows, size, certain = [], 0, Counter()
            for (key, ident, part), n in seen.items():
                node, mask, text = terminals[key]
                if ident is None or ident != node[2]:
                    certain[ident, part, mask if ident is None else mask | DUPLICATE] += n
                    continue
                rows.append((bisect_right(cuts, text), ident, part, mask, n, text))
                size += len(text)
                if size >= 4 << 20 or len(rows) >= 10_000:
                    yield packed(rows)
                    rows, size = [], 0
            rows += [((ident or 0) % ranges, ident, part, mask, n, None) for (ident, part, mask), n in certain.items()]
            if rows:
                yield packed(rows)

        trie, seen, terminals, held = Trie(), {}, {}, 0
        for batch in batches:
            for ident, part, text in zip(batch["id"].to_pylist(), batch["part"].to_pylist(), batch["text"]):
                text = text.as_py()
                node = trie.insert(text, float("inf") if ident is None else ident)
                key = id(node)
                if key not in terminals:
                    terminals[key] = (node, failed(text), text)
                    held += len(text) + 256
                seen[key, ident, part] = seen.get((key, ident, part), 0) + 1
                held += 64
                if held >= flush_bytes:
                    yield from flush(seen, terminals)
                    trie, seen, terminals, held = Trie(), {}, {}, 0
        yield from flush(seen, terminals)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sent, found = Trie(), [], Counter()
        for batch in batches:
            for ident, part, mask, n, text in zip(*(batch[c].to_pylist() for c in ("id", "part", "mask", "n")), batch["text"]):
                if text.is_valid:
                    sent.append((trie.insert(text.as_py(), ident), ident, part, mask, n))
                else:
                    found[ident, part, mask] += n
        for node, ident, part, mask, n in sent:
            found[ident, part, mask | DUPLICATE if ident > node[2] else mask] += n
        rows = list(found.items())
        for lo in range(0, len(rows), 10_000):
            columns = zip(*((*key, n) for key, n in rows[lo : lo + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["id", "part", "mask", "n"])

    dealt = docs.mapInArrow(gather, schema).repartitionById(ranges, "range")
    return dealt.mapInArrow(resolve, "id long, part string, mask int, n long")


def _orders() -> Column:
    """Fixed array of (filter_order, step, bit, before): all orders, and the mask of the filters that ran before a step."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **limits: int) -> DataFrame:
    """One row per part, order and step, as the module says; `labels` holds `quality` and `toxic` by `id_col`."""
    found = masks(documents, id_col, text_col, part_col, **limits)
    named = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("id is not null")
    count = lambda label: F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0))
    reduced = found.join(named, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("bad"))
    rows = reduced.select("*", F.explode(_orders()).alias("o")).select("part", "mask", "n", "good", "bad", "o.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    earlier, fails = mask.bitwiseAND(before) != 0, mask.bitwiseAND(bit) != 0
    total = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0))
    # Of k failed filters each comes first in one k-th of all orders.
    share = F.sum(F.when(fails, F.col("n") * (F.lit(120) / F.bit_count(mask))).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~fails).alias("kept"),
        total(~earlier & fails).alias("removed"),
        total(earlier & fails).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(~earlier & fails, "good").alias("good_lost"),
        total(~earlier & fails, "bad").alias("toxic_lost"),
        share.alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (
  SELECT part, w.doc_id,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
x(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM (SELECT part, mask, n, good, bad, filter_order, step, bit, cast(earlier AS integer) AS earlier FROM m, s)
  GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed,
       cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails, cast(good_lost AS bigint) AS good_lost,
       cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley
FROM r
"""
