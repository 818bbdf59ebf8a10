"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is coded byte by byte, each byte as a path of binary decisions through a Huffman tree
(so common bytes take few), closed by an end symbol. For every decision, predictors of order
0 to 5 look up how often either branch was taken after the same last bytes, in exact
counts, on top of what the next shorter context says. Their log-odds are mixed by weights
that a gate chooses from the confidence of the longer contexts; the weights are learned online by gradient steps. An adaptive map,
indexed by the mixed probability and the last byte, refines the result. The score is the
sum of log10 over all decisions, a proper probability of the whole text.

Counts, mixing weights and the adaptive map are gathered from every learning text; a
learning occurrence is taken out of its own counts before it trains weights or map. All
of it derives from the table of distinct 6-byte windows, counted by map-combined sums, so
online learning runs over distinct windows with their frequencies, in parallel by
bucket, with weights averaged by frequency. Windows are dealt to buckets by the last `NEAR` + 1
bytes of their context, so a bucket holds all counts of its longer contexts, and these
grow with the corpus and never leave the buckets. What is broadcast is bounded by the alphabet:
counts after `NEAR` bytes at most, weights and map. A window's score depends on the window
alone: each part sends its distinct windows to the buckets and gets one number back for each.

The base score is an add-one unigram model over words, with the end as a word. Word counts
come back to the documents through `corpus_counts`, so a word held by a third of all
documents moves once per part.

Null text counts as empty (the end only). Repeated and null ids are handled row by row. With
no learning text all counts are zero and every decision has even odds. Other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.llm.corpus_counts import bucket_of, deal, tally
from plantflow.llm.storage import materialize
from plantflow.llm.text import mix64, slices, word_hashes

END = 0xFF  # never a byte of UTF-8
ORDER = 5
SPAN_BITS = 21  # windows sorted at once
SPAN = 1 << SPAN_BITS
PIECE = 1 << 17  # windows mixed at once
NEAR = 2  # contexts up to so many bytes are counted over all buckets
INPUTS = 2 + ORDER
LEVELS = np.array([0, 2, 8, 64])  # confidence steps of a count
GATES = 125
BINS = 33
PRIOR = np.float32(2)  # observations that the shorter context stands for
STEP, BATCH, PASSES = 0.3, 1024, 2
END_WORD = np.uint64(0xE5D0E5D0E5D0E5D1)


def windows(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows of a byte after `ORDER` others, row of each), one for each byte and end, at most `SPAN` at a time."""
    rows = len(offs) - 1
    sizes = np.diff(offs)
    padded = np.full(int(sizes.sum()) + (ORDER + 1) * rows, END, np.uint8)
    shift = np.repeat(np.arange(rows) * (ORDER + 1) + ORDER, sizes)
    padded[np.arange(len(data)) + shift] = data
    owner = np.repeat(np.arange(rows), sizes + 1)
    at = np.arange(len(owner)) + ORDER * (owner + 1)
    for lo in range(0, len(owner), SPAN):
        end = at[lo : lo + SPAN]
        code = np.zeros(len(end), np.uint64)
        for back in range(ORDER, -1, -1):
            code = code << np.uint64(8) | padded[end - back]
        yield code, owner[lo : lo + SPAN]


def _held_out(ident):
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 7 == 2


def _pack(keys: np.ndarray, values: np.ndarray, bucket: np.ndarray, part: int | None = None) -> dict:
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    return {
        "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
        "values": pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()),
    }


def _home(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each window: equal where the last `NEAR` + 1 bytes of the context are equal."""
    return bucket_of(mix64(codes >> np.uint64(8) & np.uint64((1 << 8 * (NEAR + 1)) - 1)), buckets)


def count_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, codes, counts, bytes): distinct windows of the learning texts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                for code, _ in windows(data, offs):
                    distinct, n = tally(code)
                    codes.append(distinct)
                    counts.append(n)
                    held += len(distinct)
                    if held > 8_000_000 and len(codes) > 8:
                        distinct, n = tally(np.concatenate(codes), np.concatenate(counts))
                        codes, counts, held = [distinct], [n], len(distinct) // 2
        if codes:
            distinct, n = tally(np.concatenate(codes), np.concatenate(counts))
            bucket = _home(distinct, buckets)
            order = np.argsort(bucket, kind="stable")
            yield pa.RecordBatch.from_pydict(_pack(distinct[order], n[order].astype(np.uint32), bucket[order]))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        codes = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table["values"].to_pylist()]).astype(np.int64)
        codes, n = tally(codes, n)
        hist = np.bincount((codes & np.uint64(255)).astype(np.int64), n, 256).astype(np.int64)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "codes": [codes.tobytes()], "counts": [n.tobytes()], "bytes": [hist.tobytes()]})

    learning = docs.where(~_held_out(F.col("doc_id"))).select("text")
    sent = learning.mapInArrow(run, "bucket int, keys binary, values binary")
    return sent.groupBy("bucket").applyInArrow(merge, "bucket int, codes binary, counts binary, bytes binary")


def huffman(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner node, branch) for each byte and depth, and the depth of each byte."""
    heap = [(int(n) + 1, byte) for byte, n in enumerate(hist)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    number = 256
    while len(heap) > 1:
        (na, a), (nb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (number, 0), (number, 1)
        heapq.heappush(heap, (na + nb, number))
        number += 1
    paths = []
    for byte in range(256):
        at, path = byte, []
        while at in parent:
            at, branch = parent[at]
            path.append((at - 256, branch))
        paths.append(path[::-1])
    depth = max(map(len, paths))
    node, bit = np.zeros((256, depth), np.int64), np.zeros((256, depth), np.int8)
    for byte, path in enumerate(paths):
        for d, (n, b) in enumerate(path):
            node[byte, d], bit[byte, d] = n, b
    return node, bit, np.array([len(p) for p in paths])


def fit_near(grams: DataFrame, tree: tuple) -> dict:
    """For each order up to `NEAR` the sorted (context, node) keys and how often either branch was taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, many in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
                gram, n = tally(np.frombuffer(raw, np.uint64) & np.uint64((1 << 8 * (NEAR + 1)) - 1), np.frombuffer(many, np.int64))
                yield pa.RecordBatch.from_pydict({"gram": gram.astype(np.int32), "n": n})

    sent = grams.select("codes", "counts").mapInArrow(run, "gram int, n long")
    found = sent.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # windows of NEAR + 1 bytes: bounded by the alphabet
    gram, n = found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    byte, context = (gram & np.uint64(255)).astype(np.int64), gram >> np.uint64(8)
    node, bit, depth = tree
    near = {}
    for order in range(1, NEAR + 1):
        keys, sums = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for d in range(node.shape[1]):
            on = np.flatnonzero(depth[byte] > d)
            name = (context[on] & np.uint64((1 << 8 * order) - 1)) << np.uint64(8) | node[byte[on], d].astype(np.uint64)
            key, total = tally(name << np.uint64(1) | bit[byte[on], d].astype(np.uint64), n[on])
            keys.append(key)
            sums.append(total)
        key, total = tally(np.concatenate(keys), np.concatenate(sums))
        name = np.unique(key >> np.uint64(1))
        pairs = np.zeros((2, len(name)), np.float32)
        pairs[(key & np.uint64(1)).astype(np.int64), np.searchsorted(name, key >> np.uint64(1))] = total
        near[order] = (name, pairs)
    return near


def _odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + np.float32(0.4)) / (zero + np.float32(0.4))).astype(np.float32)


class Mixer:
    """Predictors, gate and mixing weights over the windows of a bucket, decision by decision."""

    def __init__(self, model: dict):
        self.node, self.bit, self.depth = model["tree"]
        self.weights, self.refine = model.get("weights"), model.get("refine")
        self.near, self.order0 = model["near"].value, model["order0"]
        # Bytes in the order of the tree's leaves: those below a node are neighbours.
        path = (self.bit.astype(np.int64) << np.arange(self.bit.shape[1])[::-1]).sum(axis=1)
        self.rank = np.empty(256, np.uint64)
        self.rank[np.argsort(path, kind="stable")] = np.arange(256)

    def freeze(self) -> Mixer:
        """Weights and map are final and only read from here on."""
        self.weights, self.refine = self.weights.copy(), self.refine.copy()
        self.weights.flags.writeable = self.refine.flags.writeable = False
        return self

    def load(self, codes: np.ndarray, n: np.ndarray) -> Mixer:
        """Take distinct windows and how often each was learned, with all windows that share a context of over `NEAR` bytes."""
        self.byte, context = (codes & np.uint64(255)).astype(np.int64), codes >> np.uint64(8)
        self.last = (context & np.uint64(255)).astype(np.int64)
        self.at = np.r_[0, np.cumsum(self.depth[self.byte])]
        self.taken = np.zeros((2, ORDER, self.at[-1]), np.float32)
        for order in range(1, ORDER + 1):
            context_of = (context & np.uint64((1 << 8 * order) - 1)) << np.uint64(8)
            on = np.argsort(context_of | self.rank[self.byte])
            for d in range(self.node.shape[1]):
                on = on[self.depth[self.byte[on]] > d]
                if not len(on):
                    break
                name = context_of[on] | self.node[self.byte[on], d].astype(np.uint64)
                head = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
                if order <= NEAR:
                    pair = self._near(order, name[head])
                else:
                    bit, many = self.bit[self.byte[on], d], n[on]
                    pair = [np.add.reduceat(many * (bit == branch), head) for branch in (0, 1)]
                run, at = np.diff(np.r_[head, len(on)]), self.at[on] + d
                for branch in (0, 1):
                    self.taken[branch, order - 1, at] = np.repeat(pair[branch], run)
        return self

    def _near(self, order: int, names: np.ndarray) -> np.ndarray:
        known, pairs = self.near[order]
        if not len(known):
            return np.zeros((2, len(names)), np.float32)
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        return pairs[:, at] * (known[at] == names)

    def steps(self, pick: np.ndarray, leave_out: bool = False) -> Iterator[tuple]:
        """(positions in `pick`, branch, inputs, gate, last byte) of each depth of the tree, for the loaded windows `pick`."""
        byte, last, start = self.byte[pick], self.last[pick], self.at[pick]
        length = self.depth[byte]
        on = np.arange(len(pick))
        for d in range(self.node.shape[1]):
            on = on[length[on] > d]
            if not len(on):
                return
            node, bit = self.node[byte[on], d], self.bit[byte[on], d]
            x = np.empty((INPUTS, len(on)), np.float32)
            x[0], x[1] = 0.3, self.order0[node]
            gate = np.zeros(len(on), np.int64)
            p = 1 / (1 + np.exp(-x[1]))
            for order in range(1, ORDER + 1):
                a, b = self.taken[:, order - 1, start[on] + d]
                if leave_out:
                    a, b = np.maximum(a - (bit == 0), 0), np.maximum(b - (bit == 1), 0)
                p = np.clip((b + PRIOR * p) / (a + b + PRIOR), np.float32(1e-5), np.float32(1 - 1e-5))
                x[order + 1] = np.log(p / (1 - p))
                if order > 2:
                    gate = gate * 5 + np.searchsorted(LEVELS, a + b)
            yield on, bit, x, gate, last[on]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[:, gate] * x).sum(axis=0), -12, 12)

    def probability(self, st: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Probability of branch 1 after the adaptive map."""
        p = 1 / (1 + np.exp(-st))
        at, place = last * BINS, (st + 12) * ((BINS - 1) / 24)
        lower = np.minimum(place.astype(np.int64), BINS - 2)
        share = place - lower
        refined = self.refine[at + lower] * (1 - share) + self.refine[at + lower + 1] * share
        return np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)

    def log10(self, codes: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of the last byte of each window after the others; `n` as in `load`, none learned by default."""
        self.load(codes, np.zeros(len(codes), np.int64) if n is None else n)
        total = np.zeros(len(codes))
        for lo in range(0, len(codes), PIECE):
            pick = np.arange(lo, min(lo + PIECE, len(codes)))
            for on, bit, x, gate, last in self.steps(pick):
                p = self.probability(self.mixed(x, gate), last)
                total[pick[on]] += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def _start_weights() -> np.ndarray:
    weights = np.full((INPUTS, GATES), 0.3, np.float32)
    weights[0] = weights[1] = 0.0
    return weights


def fit_weights(grams: DataFrame, model: dict) -> np.ndarray:
    """Gated mixing weights by online gradient steps over all windows, averaged over buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(model)
        for batch in batches:
            for raw, many in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
                codes, n = np.frombuffer(raw, np.uint64), np.frombuffer(many, np.int64)
                mixer.load(codes, n)
                mixer.weights, seen = _start_weights(), np.zeros(GATES)
                order = np.random.Generator(np.random.PCG64(3)).permutation(len(codes))
                for again in range(PASSES):
                    for lo in range(0, len(codes), BATCH):
                        pick = order[lo : lo + BATCH]
                        for on, bit, x, gate, _ in mixer.steps(pick, True):
                            weight = n[pick][on].astype(np.float64)
                            miss = (bit - 1 / (1 + np.exp(-mixer.mixed(x, gate)))) * weight
                            mass = np.bincount(gate, weight, GATES)
                            seen += mass * (again == 0)
                            for i in range(INPUTS):
                                mixer.weights[i] += STEP / (1 + again) * np.bincount(gate, miss * x[i], GATES) / (mass + 1)
                yield pa.RecordBatch.from_pydict({"weights": [mixer.weights.astype(np.float64).tobytes()], "seen": [seen.tobytes()]})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        sums, mass = np.zeros((INPUTS, GATES)), np.zeros(GATES)
        for w, s in zip(table["weights"].to_pylist(), table["seen"].to_pylist()):
            s = np.frombuffer(s)
            sums += np.frombuffer(w).reshape(INPUTS, GATES) * s
            mass += s
        return pa.table({"weights": [sums.tobytes()], "seen": [mass.tobytes()]})

    learned = grams.select("codes", "counts").mapInArrow(run, "weights binary, seen binary")
    group = F.pmod(F.xxhash64("weights"), F.lit(64)).alias("g")
    sums = learned.groupBy(group).applyInArrow(total, "weights binary, seen binary").toArrow()
    weights, mass = np.zeros((INPUTS, GATES)), np.zeros(GATES)
    for w, s in zip(sums["weights"].to_pylist(), sums["seen"].to_pylist()):
        weights += np.frombuffer(w).reshape(INPUTS, GATES)
        mass += np.frombuffer(s)
    return np.where(mass > 0, weights / np.maximum(mass, 1e-9), _start_weights()).astype(np.float32)


def fit_refinement(grams: DataFrame, model: dict) -> np.ndarray:
    """The adaptive map: share of branch 1 by last byte and mixed log-odds, over all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, hits = Mixer(model), np.zeros((2, 256 * BINS))
        for batch in batches:
            for raw, many in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
                codes, n = np.frombuffer(raw, np.uint64), np.frombuffer(many, np.int64)
                mixer.load(codes, n)
                for lo in range(0, len(codes), PIECE):
                    for on, bit, x, gate, last in mixer.steps(np.arange(lo, min(lo + PIECE, len(codes))), True):
                        at = last * BINS + np.rint((mixer.mixed(x, gate) + 12) * ((BINS - 1) / 24)).astype(np.int64)
                        weight = n[lo : lo + PIECE][on]
                        hits[0] += np.bincount(at, weight, 256 * BINS)
                        hits[1] += np.bincount(at, weight * bit, 256 * BINS)
        used = np.flatnonzero(hits[0])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int32()), "n": hits[0][used], "ones": hits[1][used]})

    cells = grams.select("codes", "counts").mapInArrow(run, "cell int, n double, ones double")
    found = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()
    prior = np.tile(1 / (1 + np.exp(-np.linspace(-12, 12, BINS))), 256)
    n, ones = np.zeros(256 * BINS), np.zeros(256 * BINS)
    n[found["cell"].to_numpy()], ones[found["cell"].to_numpy()] = found["n"].to_numpy(), found["ones"].to_numpy()
    return (ones + 20 * prior) / (n + 20)


def fit(docs: DataFrame, buckets: int) -> dict:
    """The whole model from the learning rows of (doc_id, text); counts of longer contexts stay in its table `grams`."""
    grams = materialize(count_windows(docs, buckets), "grams")
    hist = np.zeros(256, np.int64)
    for raw in grams.select("bytes").toArrow()["bytes"].to_pylist():  # 2 KB a bucket
        hist += np.frombuffer(raw, np.int64)
    tree = huffman(hist)
    flow = np.zeros((255, 2))
    for byte in range(256):
        for d in range(tree[2][byte]):
            flow[tree[0][byte, d], tree[1][byte, d]] += hist[byte]
    near = docs.sparkSession.sparkContext.broadcast(fit_near(grams, tree))
    model = {"tree": tree, "order0": _odds(flow[:, 0], flow[:, 1]), "near": near}
    model["weights"] = fit_weights(grams, model)
    model["refine"] = fit_refinement(grams, model)
    return model | {"grams": grams}


def _part_windows(table: pa.Table) -> np.ndarray:
    """The distinct windows of a part, sorted."""
    found = [np.zeros(0, np.uint64)]
    for _, _, data, offs in slices(table.column("text"), SPAN):
        found.extend(tally(code)[0] for code, _ in windows(data, offs))
    return tally(np.concatenate(found))[0]


def _thin(codes: np.ndarray) -> bytes:
    """Windows byte plane by byte plane, without the upper two bytes that are zero."""
    return codes.view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T.tobytes()


def _wide(planes: bytes) -> np.ndarray:
    codes = np.zeros((len(planes) // (ORDER + 1), 8), np.uint8)
    codes[:, : ORDER + 1] = np.frombuffer(planes, np.uint8).reshape(ORDER + 1, -1).T
    return codes.view(np.uint64).ravel()


def _send_windows(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        codes = _part_windows(table)
        bucket = _home(codes, buckets).astype(np.int64)
        codes = codes[np.argsort(bucket, kind="stable")]
        cut = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cut))
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "part": pa.array(np.full(len(used), key[0].as_py()), pa.int32()),
                "windows": pa.array([_thin(codes[cut[b] : cut[b + 1]]) for b in used], pa.binary()),
            }
        )

    return run


def _answer_scores(small: dict):
    """Scores of the windows in the order in which each part sent them, by the counts of the bucket."""

    def run(sent: pa.Table, grams: pa.Table) -> pa.Table:
        mine = [_wide(x) for x in sent["windows"].to_pylist()]
        learned = [np.frombuffer(x, np.uint64) for x in grams["codes"].to_pylist()]
        distinct, _ = tally(np.concatenate([np.zeros(0, np.uint64), *mine, *learned]))
        n = np.zeros(len(distinct), np.int64)
        for codes, many in zip(learned, grams["counts"].to_pylist()):
            n[np.searchsorted(distinct, codes)] = np.frombuffer(many, np.int64)
        score = Mixer(small).freeze().log10(distinct, n).astype(np.float32)
        return pa.table({"part": sent["part"], "bucket": sent["bucket"], "scores": pa.array([score[np.searchsorted(distinct, m)].tobytes() for m in mine], pa.binary())})

    return run


def window_scores(docs: DataFrame, model: dict, buckets: int) -> DataFrame:
    """(part, bucket, scores) for the distinct windows of each part of (part, text)."""
    sent = docs.groupBy("part").applyInArrow(_send_windows(buckets), "bucket int, part int, windows binary")
    small = {k: v for k, v in model.items() if k != "grams"}
    grams = model["grams"].select("bucket", "codes", "counts")
    return sent.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(_answer_scores(small), "part int, bucket int, scores binary")


def _part_words(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, row pointer) of each slice of a part."""
    for _, _, data, offs in slices(table.column("text")):
        words, ptr, _, _ = word_hashes(data, offs)
        yield words, ptr


def _send_words(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        learn = np.array(table["learn"].to_pylist(), bool)
        hashes, uses, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for words, ptr in _part_words(table):
            n = len(ptr) - 1
            on = np.repeat(learn[row : row + n], np.diff(ptr)).astype(np.int64)
            distinct, count = tally(words, on)
            hashes.append(distinct)
            uses.append(count)
            row += n
        hashes.append(END_WORD.reshape(1))
        uses.append(np.array([int(learn.sum())]))
        distinct, count = tally(np.concatenate(hashes), np.concatenate(uses))
        packed = _pack(distinct, count.astype(np.uint32), bucket_of(distinct, buckets))
        return pa.table({"bucket": packed["bucket"], "part": pa.array([key[0].as_py()] * len(packed["bucket"]), pa.int32()), "keys": packed["keys"], "values": packed["values"]})

    return run


def _answer_words(key: tuple, table: pa.Table) -> pa.Table:
    """Corpus counts in the order in which each part sent its words; totals ride on the first row."""
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    distinct, total = tally(np.concatenate(keys), np.concatenate([np.frombuffer(x, np.uint32) for x in table["values"].to_pylist()]).astype(np.int64))
    rest = [0] * (len(keys) - 1)
    return pa.table(
        {
            "part": table["part"],
            "bucket": table["bucket"],
            "totals": pa.array([total[np.searchsorted(distinct, k)].tobytes() for k in keys], pa.binary()),
            "n_all": pa.array([int(total.sum()), *rest], pa.int64()),
            "n_distinct": pa.array([int((total > 0).sum()), *rest], pa.int64()),
        }
    )


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs, parts = deal(docs.withColumn("learn", ~_held_out(F.col("doc_id"))))
    sent = docs.groupBy("part").applyInArrow(_send_words(parts), "bucket int, part int, keys binary, values binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer_words, "part int, bucket int, totals binary, n_all long, n_distinct long")
    answers = materialize(answers, "answers")
    n_all, n_distinct = (x or 0 for x in answers.agg(F.sum("n_all"), F.sum("n_distinct")).first())
    model = fit(docs.select("doc_id", "text"), parts)

    scored = window_scores(docs, model, parts).select("part", "bucket", F.lit(None).cast("binary").alias("totals"), "scores")
    answers = answers.select("part", "bucket", "totals", F.lit(None).cast("binary").alias("scores")).unionByName(scored)

    def run(table: pa.Table, both: pa.Table) -> pa.Table:
        totals, scores = both.filter(both["totals"].is_valid()), both.filter(both["scores"].is_valid())
        order = np.argsort(totals["bucket"].to_numpy(), kind="stable").tolist()
        raw = totals["totals"].to_pylist()
        count = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(raw[i], np.int64) for i in order)])
        per_slice = list(_part_words(table))
        distinct, _ = tally(np.concatenate([END_WORD.reshape(1), *(w for w, _ in per_slice)]))
        gain, known = np.log10(count + 1.0), (count > 0).astype(np.int64)
        end = int(np.searchsorted(distinct, END_WORD))
        tokens, seen, base = [], [], []
        for words, ptr in per_slice:
            at = np.searchsorted(distinct, words)
            run_gain, run_known = np.r_[0.0, np.cumsum(gain[at])], np.r_[0, np.cumsum(known[at])]
            tokens.append(np.diff(ptr) + 1)
            seen.append(run_known[ptr[1:]] - run_known[ptr[:-1]] + known[end])
            base.append(run_gain[ptr[1:]] - run_gain[ptr[:-1]] + gain[end])
        n = np.concatenate(tokens)
        codes = _part_windows(table)
        value_of = np.empty(len(codes), np.float32)
        raw, order = scores["scores"].to_pylist(), np.argsort(scores["bucket"].to_numpy(), kind="stable").tolist()
        value_of[np.argsort(_home(codes, parts), kind="stable")] = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(raw[i], np.float32) for i in order)])
        score, size = [], []
        for _, _, data, offs in slices(table.column("text"), SPAN):
            total = np.zeros(len(offs) - 1)
            for code, owner in windows(data, offs):
                # Equal windows meet by hash; a collision only splits a run, since windows themselves are compared.
                head = mix64(code) >> np.uint64(SPAN_BITS) << np.uint64(SPAN_BITS)
                joint = np.sort(head | np.arange(len(code), dtype=np.uint64))
                place = (joint & np.uint64(SPAN - 1)).astype(np.int64)
                ordered = code[place]
                first = np.r_[True, ordered[1:] != ordered[:-1]]
                value = value_of[np.searchsorted(codes, ordered[first])][np.cumsum(first) - 1]
                back = np.empty(len(code))
                back[place] = value
                total += np.bincount(owner, back, len(total))
            score.append(total)
            size.append(np.diff(offs))
        score, size = np.concatenate(score), np.concatenate(size)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "held_out": pa.array([not x for x in table["learn"].to_pylist()], pa.bool_()),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(np.concatenate(seen), pa.int64()),
                "train_tokens": pa.array(np.full(len(n), n_all), pa.int64()),
                "base_score": pa.array(np.concatenate(base) - n * np.log10(n_all + n_distinct + 1.0)),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score * np.log2(10) / np.maximum(size, 1)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
