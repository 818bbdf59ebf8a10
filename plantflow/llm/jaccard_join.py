"""N-gram Jaccard join by T-occurrence search with divided lists (DivideSkip).

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at
least 0.8. A partner of a set x must share T = ceil(0.8 |x|) of its shingles, so it
occurs in T of the inverted lists of x. The lists are divided: the T - 1 longest are only
probed, the |x| - T + 1 shortest are merged, and whoever shows up in the merge is a
candidate whose remaining occurrences are found by binary search in its sorted set.
List lengths are exact document frequencies. A shingle of one document has a
list without partners, so most documents merge no list at all.

Inside a merged list, all sets are probed against one pivot first. Sets that link to the
pivot are connected through it. The others are probed against up to `AIDES` sets that did
link to it, those nearest to it by residue of a hash, so that the scattered copies of one
text join through its centre. What is left is searched block against block by DivideSkip: a heap
merges the short lists of a block, skipping what can't reach the overlap, and binary search
probes its long ones. Sets that can't link drop out before: 1 - Jaccard is a metric, so
sets whose distances to the pivot differ by more than 0.2 can't link. No link between
different texts is lost.

Equal sets are one class with the smallest id as representative. Null, empty or
blank text has no shingles and links with nothing; fewer than 5 words are one shingle.
A null id links with nothing and has a null component. Rows that repeat an id count as
one document. Empty tables give empty results; other columns are ignored.

At scale: see `corpus_counts` for how frequencies are found without moving a hot shingle
more than once per part. Candidates and probes are joins on ids that adaptive skew
handling may split; blocks have bounded rows; links and components stay in tables.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.llm.components import components
from plantflow.llm.corpus_counts import bucket_of, deal, tally
from plantflow.llm.storage import materialize, release, unused
from plantflow.llm.text import shingle_sets, slices

WORDS = 5
PERCENT = 80
AIDES = 8
INDEX_ROWS, QUERY_ROWS = 512, 2048
LONG = 16  # lists of a block longer than this may be probed instead of merged


def _row_sets(table: pa.Table) -> Iterator[np.ndarray]:
    for _, _, data, offs in slices(table.column("text")):
        yield from shingle_sets(data, offs, WORDS)


def _bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower half of each hash in one number: equal for equal hashes."""
    return bucket_of(hashes, buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _send(buckets: int):
    """Each part's distinct shingles with the number of its documents that hold them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sets = list(_row_sets(table))
        keys, counts = tally(_bucket_keys(np.concatenate(sets), buckets)) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        used = np.flatnonzero(np.diff(cut))
        codes, few = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts, 2**16 - 1).astype(np.uint16)
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "part": pa.array(np.full(len(used), key[0].as_py()), pa.int32()),
                "codes": pa.array([codes[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
                "counts": pa.array([few[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
            }
        )

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each part the shingles that more than one document holds, with a rank by frequency."""
    codes = [np.frombuffer(x, np.uint32) for x in table["codes"].to_pylist()]
    counts = [np.frombuffer(x, np.uint16) for x in table["counts"].to_pylist()]
    distinct, total = tally(np.concatenate(codes), np.concatenate(counts).astype(np.int64))
    rank = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    keep, levels = [], []
    for mine in codes:
        level = rank[np.searchsorted(distinct, mine)]
        shared = level > 0
        keep.append(mine[shared].tobytes())
        levels.append(level[shared].tobytes())
    return pa.table(
        {
            "part": table["part"],
            "bucket": pa.array(np.full(len(codes), key[0].as_py()), pa.int32()),
            "codes": pa.array(keep, pa.binary()),
            "levels": pa.array(levels, pa.binary()),
        }
    )


def _short_lists(buckets: int):
    """For each document the shingles whose lists it merges: its |x| - T + 1 rarest shared by others."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["bucket"].to_numpy(), kind="stable").tolist()
        codes, levels = answers["codes"].to_pylist(), answers["levels"].to_pylist()
        number = answers["bucket"].to_pylist()
        keys = [np.frombuffer(codes[i], np.uint32).astype(np.uint64) | np.uint64(number[i] << 32) for i in order]
        keys = np.concatenate([*keys, np.full(1, 2**64 - 1, np.uint64)])
        level = np.concatenate([*(np.frombuffer(levels[i], np.uint8) for i in order), np.zeros(1, np.uint8)])
        sizes, digests, tokens, sets = [], [], [], []
        for got in _row_sets(docs):
            n = len(got)
            sizes.append(n)
            digests.append(hashlib.blake2b(got.tobytes(), digest_size=16).digest())
            mine = _bucket_keys(got, buckets)
            at = np.searchsorted(keys, mine)
            shared = keys[at] == mine
            alone = n - int(shared.sum())
            merge = n - -(-PERCENT * n // 100) + 1 - alone
            if n and merge > 0 and n > alone:
                mine, rank = mine[shared], level[at[shared]]
                tokens.append(mine[np.lexsort((mine, rank))[:merge]].astype(np.int64).tolist())
                sets.append(got.tobytes())
            else:
                tokens.append(None)
                sets.append(None)
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_shingles": pa.array(sizes, pa.int64()),
                "digest": pa.array(digests, pa.binary()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "shingles": pa.array(sets, pa.binary()),
            }
        )

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the intersection and both sizes of each candidate pair, by binary search."""
    for batch in batches:
        common, na, nb = [], [], []
        for a, b in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common.append(int((y[at] == x).sum()))
            na.append(len(x))
            nb.append(len(y))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array([x + y for x, y in zip(na, nb)], pa.int64())],
            ["a", "b", "common", "both"],
        )


def probe(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked, distance) of candidate pairs (a, b)."""
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
    found = with_b.select("a", "b", "set_a", "set_b").mapInArrow(_probe, "a long, b long, common long, both long")
    union = F.col("both") - F.col("common")
    return found.select("a", "b", (100 * F.col("common") >= PERCENT * union).alias("linked"), (1 - F.col("common") / union).alias("distance"))


def _by_aides(probed: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, aide): sets a that don't link to pivot b but to an aide, a set linked to b."""
    near = F.struct("distance", "a")
    nearest = [F.min(F.when(F.pmod(F.xxhash64("a"), F.lit(AIDES)) == k, near)).alias(f"n{k}") for k in range(AIDES)]
    aides = probed.where("linked").groupBy("b").agg(*nearest).select("b", F.explode(F.array(*(f"n{k}" for k in range(AIDES)))).alias("n"))
    aides = aides.where("n is not null").select("b", F.col("n.a").alias("aide"), F.col("n.distance").alias("aide_distance"))
    tried = probed.where(~F.col("linked")).join(aides, "b").where(F.abs(F.col("distance") - F.col("aide_distance")) <= 0.2000001)
    tried = materialize(tried.select("a", "b", "aide").distinct(), "tried")
    found = probe(tried.select("a", F.col("aide").alias("b")).distinct(), reps).where("linked").select("a", F.col("b").alias("aide"))
    return tried.join(found, ["a", "aide"]).select("a", "b", "aide")


def _links(reps: DataFrame) -> DataFrame:
    """Links (a, b) between class representatives that keep every component whole."""
    lists = reps.select(F.explode("tokens").alias("token"), "rep", F.col("n_shingles").alias("n"))
    heads = lists.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("head"), F.max("rep").alias("last"))
    heads = heads.where("head.rep < last").select("token", F.col("head.rep").alias("pivot"), F.col("head.n").alias("pn"))
    heads = materialize(heads, "heads")  # so that the join below is of two plain exchanges, whose hot tokens may be split
    merged = materialize(lists.join(heads, "token").where("rep <> pivot"), "merged")
    # Sizes alone put the distance above 0.4 where the smaller is under 0.6 of the larger.
    near = merged.where(F.least("n", "pn") >= 0.6 * F.greatest("n", "pn"))
    pairs = near.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    probed = materialize(probe(pairs, reps), "probed")
    aided = materialize(_by_aides(probed, reps), "aided")
    links = probed.where("linked").select("a", "b").unionByName(aided.select("a", F.col("aide").alias("b")))
    joined = aided.select("a", "b").distinct().withColumn("joined", F.lit(True))
    probed = probed.join(joined, ["a", "b"], "left").withColumn("linked", F.col("linked") | F.coalesce("joined", F.lit(False)))
    placed = merged.join(probed.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "linked", "distance"), ["rep", "pivot"], "left")
    # A set that was not probed is at least as far from the pivot as the sizes say.
    bound = F.coalesce("distance", 1 - F.least("n", "pn") / F.greatest("n", "pn"))
    placed = placed.select("token", "rep", "pivot", F.coalesce("linked", F.lit(False)).alias("linked"), bound.alias("distance"))
    open_lists = placed.groupBy("token").agg(
        F.count_if(~F.col("linked")).alias("free"), F.count("*").alias("all"), F.min(F.when(~F.col("linked"), F.col("distance"))).alias("nearest")
    )
    open_lists = open_lists.where("free > 0 and `all` > 1").select("token", "nearest")
    rest = placed.join(open_lists, "token").where(~F.col("linked") | (F.col("distance") >= F.col("nearest") - 0.2000001))
    rest = materialize(rest.select("pivot", "rep", "linked").distinct(), "rest")
    if rest.isEmpty():
        return links
    return links.unionByName(_search_blocks(rest, reps))


def _search_blocks(rest: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the free sets of a pivot and all its remaining sets, block against block."""
    sizes = rest.groupBy("pivot").agg(
        F.ceil(F.count_if(~F.col("linked")) / INDEX_ROWS).cast("int").alias("ni"), F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("nq")
    )
    sized = rest.join(sizes.where("ni > 0"), "pivot")
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = sized.where(~F.col("linked")).select("pivot", "rep", F.lit(False).alias("query"), dealt("ni").alias("i"), every("nq").alias("q"))
    queries = sized.select("pivot", "rep", F.lit(True).alias("query"), every("ni").alias("i"), dealt("nq").alias("q"))
    filled = index.unionByName(queries).join(reps.select("rep", "shingles"), "rep")
    return filled.groupBy("pivot", "i", "q").applyInArrow(_search_block, "a long, b long")


def merge_skip(postings: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(number, occurrences) of the numbers that stand in at least `need` of the sorted lists, by a heap of their heads.

    A number that can't reach `need` is passed over, and the lists popped with it are moved by
    binary search to the next number that may.
    """
    heap = [(post[0], i) for i, post in enumerate(postings) if post]
    heapify(heap)
    at, found = [0] * len(postings), []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            found.append((top, len(popped)))
            for i in popped:
                at[i] += 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                break
            for i in popped:
                at[i] = bisect_left(postings[i], heap[0][0], at[i])
        for i in popped:
            if at[i] < len(postings[i]):
                heappush(heap, (postings[i][at[i]], i))
    return found


def divide_skip(query: np.ndarray, sizes: np.ndarray, index: dict[int, np.ndarray]) -> np.ndarray:
    """Numbers of the sets of an inverted index that link to the query, by T-occurrence search.

    Every partner shares T = `PERCENT` % of the query's shingles. The longest lists, T - 1 at
    most, are divided off; the others are merged by a heap for numbers that occur often enough,
    and only those are looked for in the long lists, by binary search, until too few are left.
    """
    lists = sorted((index[k] for k in query.tolist() if k in index), key=len)
    least = -(-PERCENT * len(query) // 100)
    long = min(least - 1, sum(len(x) > LONG for x in lists))
    short, lists = lists[: len(lists) - long], lists[len(lists) - long :]
    merged = merge_skip([x.tolist() for x in short], least - long)
    if not merged:
        return np.zeros(0, np.int64)
    near, count = np.array(merged, np.int64).T
    # Overlap needed: PERCENT / (100 + PERCENT) of both sizes together, and no more than the smaller size.
    need = -(-PERCENT * (len(query) + sizes[near]) // (100 + PERCENT))
    alive = need <= np.minimum(sizes[near], len(query))
    for k, post in enumerate(lists):
        alive &= count + (len(lists) - k) >= need
        near, count, need = near[alive], count[alive], need[alive]
        if not len(near):
            return near
        count += post[np.minimum(np.searchsorted(post, near), len(post) - 1)] == near
        alive = np.ones(len(near), bool)
    return near[count >= need]


def _inverted(sets: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each shingle the sorted numbers of the sets that hold it."""
    keys = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return dict(zip(keys[head].tolist(), np.split(owner, head[1:])))


def _search_block(table: pa.Table) -> pa.Table:
    """Links of the queries of a block with its indexed sets; those that join nothing new within the block are left out."""
    by_rep = dict(zip(table["rep"].to_pylist(), table["shingles"].to_pylist()))
    reps, is_query = np.array(table["rep"].to_pylist(), np.int64), np.array(table["query"].to_pylist(), bool)
    sets = {r: np.frombuffer(x, np.uint64) for r, x in by_rep.items()}
    indexed, queries = np.unique(reps[~is_query]).tolist(), np.unique(reps[is_query]).tolist()
    found: list[tuple[int, int]] = []
    if indexed and queries:
        index, sizes = _inverted([sets[r] for r in indexed]), np.array([len(sets[r]) for r in indexed])
        parent = {r: r for r in {*indexed, *queries}}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for query in queries:
            for i in divide_skip(sets[query], sizes, index).tolist():
                other = indexed[i]
                if other != query and root(other) != root(query):
                    parent[root(other)] = root(query)
                    found.append((query, other))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs, parts = deal(docs)
    sent = docs.groupBy("part").applyInArrow(_send(parts), "bucket int, part int, codes binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "part int, bucket int, codes binary, levels binary")
    sized = docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _short_lists(parts), "doc_id long, n_shingles long, digest binary, tokens array<long>, shingles binary"
    )
    sized = materialize(sized, "sized")
    del sent, answers
    release(spark)
    classes = sized.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    heads = sized.where("tokens is not null").join(classes, (sized["digest"] == classes["digest"]) & (sized["doc_id"] == classes["rep"]))
    reps = materialize(heads.select("rep", "n_shingles", "tokens", "shingles"), "reps")
    roots = components(_links(reps))
    release(spark)
    members = sized.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    known = members.join(roots, members["rep"] == roots["node"], "left")
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return known.select("doc_id", "n_shingles", F.when(real, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """`documents` with the row of the smallest id of each component; null ids stay."""
    found = materialize(jaccard_components(documents), "found")
    ident = unused(documents, "near_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(ident))
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(ident), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM c GROUP BY node) r ON r.node = d.doc_id
"""
