"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where the content selects them: at minimisers, the position of the
smallest 5-word hash in every window of 16 positions. Any 50-word stretch that two
documents share has such a position, the same in both, in its first 16 words, so the kept
suffixes share at least 35 words. Suffixes whose first 35 words stand in one document only drop
out. The others are dealt by those words and sorted by the words that follow; neighbours give the
length of the common prefix. Matches are extended to the left among the suffixes that
share enough to the right, for each of the 16 splits of the missing 15 words. What
an anchor gets back is the set of its splits that some other document shares. Extensions
that touch are joined, so spans are maximal. The result is exact up to collisions of hashes: 64
bits for the first 35 words, 32 for each word after or before them.

Suffixes that start alike in more than `hot` places are not sorted in one task: their
splits are dealt one by one, by a hash of the 50 words of each, which comes to the same.

Only repetition across documents counts; repeats inside one text don't. Null, empty and short
texts have no spans. Rows that repeat an id count as one document; a row with a null id is a
document of its own, and `first_doc` is null where only such rows hold the passage. Empty
tables give empty results; other columns are ignored.

At scale: a part sends each distinct suffix once (see `corpus_counts`), so a passage held by
a third of all documents meets as one entry per part. Texts are dealt once, and spans are
made inside the part that holds the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.llm.corpus_counts import bucket_of, deal
from plantflow.llm.storage import materialize, release
from plantflow.llm.text import mix64, ngram_hashes, slices, word_hashes

MIN_WORDS = 50
WINDOW = 16
GRAM = 5
PREFIX = MIN_WORDS - WINDOW + 1
MORE = MIN_WORDS - PREFIX
HOT = 4096

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache[0]) < n:
        size = 2 * n
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _cache[i] = np.multiply.accumulate(steps)
    return _cache[0], _cache[1]


class Words:
    """The hashed words of a slice of rows, with hashes of any stretch of them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words, self.ptr, self.starts, self.ends = word_hashes(data, offs)
        self.offs = offs
        n = len(self.words)
        self.up, down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * down[:n], out=self.sums[1:])
        self.row = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        self.stop = np.repeat(self.ptr[1:], np.diff(self.ptr))

    def stretch(self, at: np.ndarray, n) -> np.ndarray:
        return mix64((self.sums[at + n] - self.sums[at]) * self.up[at])

    def anchors(self) -> np.ndarray:
        """Positions of the minimisers of all windows that lie in one row and can start a 50-word stretch."""
        gram = ngram_hashes(self.words, GRAM)
        n = len(gram) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        bits = np.uint64(max(1, int(len(gram)).bit_length()))
        low = gram >> bits << bits | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while span < WINDOW:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        at = np.arange(n)
        low = low[at + MIN_WORDS <= self.stop[at]]
        return np.unique((low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the 50-word stretches that have one of the anchors in their first words."""
        n = len(self.words)
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.maximum(anchors - WINDOW + 1, self.ptr[self.row[anchors]]), 1)
        np.add.at(near, anchors + 1, -1)
        at = np.flatnonzero(np.cumsum(near[:n]) > 0)
        return at[at + MIN_WORDS <= self.stop[at]]

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words before each anchor, words after its prefix, both `MORE` at most; hash of the whole context)."""
        left = np.minimum(at - self.ptr[self.row[at]], MORE)
        right = np.minimum(self.stop[at] - at - PREFIX, MORE)
        shape = (left * WINDOW + right + 1).astype(np.uint64) * np.uint64(_BASE)
        return left, right, mix64(self.stretch(at - left, left + PREFIX + right) ^ shape)

    def context(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(anchors, 2, MORE): 32 bits of each word after the prefix and, going back, before it; 0 beyond the text."""
        near, short = np.arange(MORE), (self.words >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(at), 2, MORE), np.uint32)
        for side, first, step, size in ((0, at + PREFIX, 1, right), (1, at - 1, -1, left)):
            place = np.clip(first[:, None] + step * near, 0, max(0, len(short) - 1))
            out[:, side] = np.where(near < size[:, None], short[place], np.uint32(0))
        return out


class Owners:
    """Which documents hold each distinct key: more than one, the smallest id, whether any has an id."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, known: np.ndarray, many: np.ndarray | None = None, uses: np.ndarray | None = None):
        self.order = np.argsort(keys, kind="stable")
        keys, ids, known = keys[self.order], ids[self.order], known[self.order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.sizes, self.head = keys[head], np.diff(np.r_[head, len(keys)]), self.order[head]
        if not len(keys):
            self.many = self.known = np.zeros(0, bool)
            self.first, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        self.first, last = np.minimum.reduceat(np.where(known, ids, _HIGH), head), np.maximum.reduceat(np.where(known, ids, _LOW), head)
        nameless = np.add.reduceat(~known, head, dtype=np.int64)
        self.known = nameless < self.sizes
        self.many = (nameless + self.known > 1) | (self.known & (self.first < last))
        if many is not None:
            self.many |= np.logical_or.reduceat(many[self.order], head)
        self.uses = self.sizes if uses is None else np.add.reduceat(uses[self.order].astype(np.int64), head)

    def back(self, values: np.ndarray) -> np.ndarray:
        """A value of each distinct key for all entries, in their own order."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, self.sizes)
        return out


def _among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether there is one) of the rows."""
    return table["doc_id"].fill_null(0).to_numpy(), table["doc_id"].is_valid().to_numpy()


def _join(column: pa.ChunkedArray, dtype, order: list[int] | None = None) -> np.ndarray:
    raw = column.to_pylist()
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(raw[i], dtype) for i in (range(len(raw)) if order is None else order) if raw[i])])


def _pieces(bucket: np.ndarray, buckets: int, **columns: np.ndarray) -> dict[int, dict[str, bytes]]:
    """Bytes of the columns of each bucket; entries are sorted by bucket."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    return {b: {k: x[cut[b] : cut[b + 1]].tobytes() for k, x in columns.items()} for b in np.flatnonzero(np.diff(cut)).tolist()}


def _rows(part: int, found: dict[int, dict[str, bytes]], names: tuple[str, ...]) -> pa.Table:
    used = sorted(found)
    head = {"bucket": pa.array(used, pa.int32()), "part": pa.array([part] * len(used), pa.int32())}
    return pa.table(head | {k: pa.array([found[b].get(k, b"") for b in used], pa.binary()) for k in names})


_ENTRY = ("keys", "flags", "first", "uses")
_SUFFIX = ("prefix", "marks", "sizes", "context", "s_flags", "s_first")


def _flags(owners: Owners) -> np.ndarray:
    return owners.known.astype(np.uint8) | owners.many.astype(np.uint8) << np.uint8(1)


def _entries(owners: Owners, buckets: int) -> dict[int, dict[str, bytes]]:
    uses = np.minimum(owners.uses, 2**16 - 1).astype(np.uint16)
    return _pieces(bucket_of(owners.keys, buckets), buckets, keys=owners.keys, flags=_flags(owners), first=owners.first, uses=uses)


def _send_prefixes(buckets: int):
    """The distinct prefixes of a part's suffixes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (ids, known), keys, row = _ids(table), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, _, data, offs in slices(table.column("text")):
            words = Words(data, offs)
            at = words.anchors()
            keys.append(words.stretch(at, PREFIX))
            row.append(lo + words.row[at])
        row = np.concatenate(row)
        return _rows(key[0].as_py(), _entries(Owners(np.concatenate(keys), ids[row], known[row]), buckets), _ENTRY)

    return run


def _meet(table: pa.Table) -> tuple[Owners, list[np.ndarray]]:
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    flags = _join(table["flags"], np.uint8)
    joined = np.concatenate([np.zeros(0, np.uint64), *keys])
    return Owners(joined, _join(table["first"], np.int64), flags & 1 > 0, flags & 2 > 0, _join(table["uses"], np.uint16)), keys


def _answer_prefixes(limit: int):
    """For each part its prefixes that more than one document holds, and whether they start over `limit` suffixes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        owners, keys = _meet(table)
        hit, hot = [], []
        for mine in keys:
            at = _among(mine, owners.keys)[1]
            recurs = owners.many[at]
            hit.append(mine[recurs].tobytes())
            hot.append((owners.uses[at][recurs] > limit).astype(np.uint8).tobytes())
        return pa.table({"part": table["part"], "bucket": table["bucket"], "keys": pa.array(hit, pa.binary()), "hot": pa.array(hot, pa.binary())})

    return run


def _send_suffixes(buckets: int):
    """The distinct contexts of a part's suffixes that may match; of hot ones the 50-word stretches around them."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        (ids, known) = _ids(table)
        order = np.argsort(answers["bucket"].to_numpy(), kind="stable").tolist()
        hits, hot = _join(answers["keys"], np.uint64, order), _join(answers["hot"], np.uint8, order) > 0
        got: dict[str, list] = {k: [] for k in ("marks", "prefix", "sizes", "context", "row", "stretch", "stretch_row")}
        for lo, _, data, offs in slices(table.column("text")):
            words = Words(data, offs)
            at = words.anchors()
            prefix = words.stretch(at, PREFIX)
            hit, where = _among(prefix, hits)
            at, prefix, warm = at[hit], prefix[hit], hot[where[hit]]
            around = words.around(at[warm])
            got["stretch"].append(words.stretch(around, MIN_WORDS))
            got["stretch_row"].append(lo + words.row[around])
            at, prefix = at[~warm], prefix[~warm]
            left, right, mark = words.reach(at)
            got["context"].append(words.context(at, left, right))
            got["sizes"].append(np.stack([right, left], axis=1).astype(np.uint8))
            got["marks"].append(mark)
            got["prefix"].append(prefix)
            got["row"].append(lo + words.row[at])
        if not got["marks"]:
            return _rows(0, {}, _ENTRY + _SUFFIX)
        flat = {k: np.concatenate(v) for k, v in got.items()}
        found = _entries(Owners(flat["stretch"], ids[flat["stretch_row"]], known[flat["stretch_row"]]), buckets)
        owners = Owners(flat["marks"], ids[flat["row"]], known[flat["row"]])
        bucket = bucket_of(flat["prefix"][owners.head], buckets)
        on = np.argsort(bucket, kind="stable")
        pick = owners.head[on]
        sent = _pieces(
            bucket[on], buckets, prefix=flat["prefix"][pick], marks=owners.keys[on], sizes=flat["sizes"][pick], context=flat["context"][pick],
            s_flags=_flags(owners)[on], s_first=owners.first[on],
        )
        for b, columns in sent.items():
            found.setdefault(b, {}).update(columns)
        return _rows(table["part"][0].as_py(), found, _ENTRY + _SUFFIX)

    return run


def extend(prefix: np.ndarray, sizes: np.ndarray, context: np.ndarray, first: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(splits that another document shares as bits, smallest id that shares one, whether there is one) of each suffix.

    Suffixes are sorted by prefix and following words; a run of neighbours with a common
    prefix long enough is sorted by the words before the anchors and its neighbours compared again.
    """
    n = len(prefix)
    mask, best, named = np.zeros(n, np.uint16), np.full(n, _HIGH), np.zeros(n, bool)
    if not n:
        return mask, best, named
    order = np.lexsort((*(context[:, 0, k] for k in range(MORE - 1, -1, -1)), prefix))
    right, left = sizes[order, 0].astype(np.int64), sizes[order, 1].astype(np.int64)
    words, back, prefix = context[order, 0], context[order, 1], prefix[order]
    same = np.logical_and.accumulate(words[1:] == words[:-1], axis=1).sum(axis=1)
    same = np.minimum(same, np.minimum(right[1:], right[:-1]))
    common = np.r_[0, np.where(prefix[1:] == prefix[:-1], PREFIX + same, 0)]  # with the suffix before
    before = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        if j:
            before = mix64(before * np.uint64(_BASE) + back[:, j - 1] + np.uint64(1))
        on = np.flatnonzero((left >= j) & (PREFIX + right >= MIN_WORDS - j))
        run = np.cumsum(common < MIN_WORDS - j).astype(np.uint64)
        at = order[on]
        owners = Owners(mix64(before[on] + run[on] * np.uint64(0xD6E8FEB86659FD93)), first[at], flags[at] & 1 > 0, flags[at] & 2 > 0)
        shared = owners.back(owners.many)
        hit = at[shared]
        mask[hit] |= np.uint16(1 << j)
        best[hit] = np.minimum(best[hit], owners.back(owners.first)[shared])
        named[hit] |= owners.back(owners.known)[shared]
    return mask, best, named


def _answer_suffixes(key: tuple, table: pa.Table) -> pa.Table:
    """For each part the stretches that recur, and the suffixes with the splits that recur."""
    owners, keys = _meet(table)
    marks = [np.frombuffer(x, np.uint64) for x in table["marks"].to_pylist()]
    flags, first = _join(table["s_flags"], np.uint8), _join(table["s_first"], np.int64)
    mask, best, named = extend(
        _join(table["prefix"], np.uint64), _join(table["sizes"], np.uint8).reshape(-1, 2), _join(table["context"], np.uint32).reshape(-1, 2, MORE), first, flags
    )
    out: dict[str, list] = {k: [] for k in ("keys", "first", "known", "marks", "masks", "s_first", "s_known")}
    lo = 0
    for mine, mark in zip(keys, marks):
        _, at = _among(mine, owners.keys)
        recurs = owners.many[at] if len(mine) else np.zeros(0, bool)
        out["keys"].append(mine[recurs].tobytes())
        out["first"].append(owners.first[at][recurs].tobytes() if len(mine) else b"")
        out["known"].append(owners.known[at][recurs].tobytes() if len(mine) else b"")
        hit = lo + np.flatnonzero(mask[lo : lo + len(mark)])
        out["marks"].append(mark[hit - lo].tobytes())
        out["masks"].append(mask[hit].tobytes())
        out["s_first"].append(best[hit].tobytes())
        out["s_known"].append(named[hit].tobytes())
        lo += len(mark)
    return pa.table({"part": table["part"], "bucket": table["bucket"]} | {k: pa.array(v, pa.binary()) for k, v in out.items()})


def _spans(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Maximal spans of each row whose every 50-word stretch recurs elsewhere."""
    order = np.argsort(answers["bucket"].to_numpy(), kind="stable").tolist()
    keys, first, named = (_join(answers[k], t, order) for k, t in (("keys", np.uint64), ("first", np.int64), ("known", bool)))
    marks, masks, s_first, s_named = (_join(answers[k], t) for k, t in (("marks", np.uint64), ("masks", np.uint16), ("s_first", np.int64), ("s_known", bool)))
    by = np.argsort(marks, kind="stable")
    marks, masks, s_first, s_named = marks[by], masks[by], s_first[by], s_named[by]
    found: dict[str, list] = {k: [] for k in ("row", "start_word", "end_word", "start_byte", "end_byte", "first_doc", "named")}
    for lo, _, data, offs in slices(table.column("text")):
        words = Words(data, offs)
        anchors = words.anchors()
        hit, where = _among(words.reach(anchors)[2], marks)
        anchors, where = anchors[hit], where[hit]
        at, holder, known = [], [], []
        for j in range(WINDOW):
            on = masks[where] >> np.uint16(j) & np.uint16(1) > 0
            at.append(anchors[on] - j)
            holder.append(s_first[where[on]])
            known.append(s_named[where[on]])
        if len(keys):
            every = np.arange(max(0, len(words.words) - MIN_WORDS + 1))
            every = every[every + MIN_WORDS <= words.stop[every]] if len(every) else every
            hit, where = _among(words.stretch(every, MIN_WORDS), keys)
            at.append(every[hit])
            holder.append(first[where[hit]])
            known.append(named[where[hit]])
        at, holder, known = np.concatenate(at), np.concatenate(holder), np.concatenate(known)
        if not len(at):
            continue
        on = np.argsort(at, kind="stable")
        at, holder, known = at[on], holder[on], known[on]
        row = words.row[at]
        fresh = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + MIN_WORDS) | (row[1:] != row[:-1])])
        end = at[np.r_[fresh[1:], len(at)] - 1] + MIN_WORDS
        start, row = at[fresh], row[fresh]
        found["row"].append(lo + row)
        found["start_word"].append(start - words.ptr[row])
        found["end_word"].append(end - words.ptr[row])
        found["start_byte"].append(words.starts[start] - offs[row])
        found["end_byte"].append(words.ends[end - 1] - offs[row])
        found["first_doc"].append(np.minimum.reduceat(np.where(known, holder, _HIGH), fresh))
        found["named"].append(np.logical_or.reduceat(known, fresh))
    flat = {k: np.concatenate([np.zeros(0, bool if k == "named" else np.int64), *v]) for k, v in found.items()}
    flat["first_doc"] = pa.array(flat["first_doc"], mask=~flat.pop("named"))
    return pa.table({"doc_id": table["doc_id"].take(pa.array(flat.pop("row"))), **flat})


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per span: doc_id, start_word, end_word, start_byte, end_byte, first_doc.

    Words and bytes are counted from 0, ends exclusive. `first_doc` is the smallest id that
    holds some 50-word stretch of the span.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs, parts = deal(docs)
    schema = lambda *names: ", ".join(["bucket int", "part int", *(f"{n} binary" for n in names)])
    answer = lambda *names: ", ".join(["part int", "bucket int", *(f"{n} binary" for n in names)])

    sent = docs.groupBy("part").applyInArrow(_send_prefixes(parts), schema(*_ENTRY))
    prefixes = materialize(sent.groupBy("bucket").applyInArrow(_answer_prefixes(hot), answer("keys", "hot")), "prefixes")
    del sent
    release(spark)
    sent = docs.groupBy("part").cogroup(prefixes.groupBy("part")).applyInArrow(_send_suffixes(parts), schema(*_ENTRY, *_SUFFIX))
    found = sent.groupBy("bucket").applyInArrow(_answer_suffixes, answer("keys", "first", "known", "marks", "masks", "s_first", "s_known"))
    found = materialize(found, "suffixes")
    del sent
    release(spark)
    spans = "doc_id long, start_word long, end_word long, start_byte long, end_byte long, first_doc long"
    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_spans, spans)


def query(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start_word", "end_word", "first_doc")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS pos, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h
  FROM w WHERE len(w) >= 50),
r AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (
  SELECT doc_id, pos, first_doc, CASE WHEN pos <= 50 + lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh
  FROM g JOIN r USING (h)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM m)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, min(first_doc) AS first_doc FROM s GROUP BY doc_id, span
"""
