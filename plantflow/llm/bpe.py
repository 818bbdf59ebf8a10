"""Byte-level BPE by a lazily determinised finite-state transducer.

A token sequence is what rank-ordered merging produces exactly when every pair of
neighbours is one that merging leaves alone, and each prefix of a word then has
one encoding, settled by its last token. The transducer follows all tokens that could
still be under way: a state holds, for each of them, its place in the vocabulary trie,
the token before it and the tokens not yet emitted. A token is emitted as soon as all
of them agree on it, so the lookahead is bounded by the longest token. States and arcs
are built when first needed and kept; a full table is dropped, also inside a word, and grows again.

Decoding is a stream: an incremental UTF-8 state machine turns token bytes into text
as they come and keeps back at most the three bytes of an unfinished character.

Null text counts as empty and has no tokens. Long texts are cut for matching at
blanks that the pattern can't reach across, so results don't depend on length.
Repeated and null ids are handled row by row; other columns are ignored.

At scale: one pass over the rows, no shuffle. The compiled vocabulary is a broadcast
whose size is the vocabulary's, not the corpus's; word caches are bounded.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.llm.text import runs
from plantflow.llm.worker import hold

MAX_STATES = 250_000
MAX_WORDS, WORD_BYTES = 300_000, 256
BLOCK_CHARS = 1 << 20


def default_vocabulary() -> tuple[str, str]:
    """(path of the rank file, split pattern) of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merge_parts(word: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Merge the neighbours of lowest rank, leftmost first, until none or `stop` parts are left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > stop:
        best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Transducer:
    """Encoder of single words; `compiled` is what `compile_merges` returns."""

    def __init__(self, compiled: dict):
        self.tokens: list[bytes] = compiled["tokens"]
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right = compiled["left"], compiled["right"]
        self.trie: dict[int, int] = {}
        self.final: list[int] = [-1]
        for rank, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                node = self.trie.setdefault(node << 8 | byte, len(self.final))
                if node == len(self.final):
                    self.final.append(-1)
            self.final[node] = rank
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = array("i", [0, -1, 0]).tobytes()
        self.numbers, self.states, self.tails = {start: 0}, [start], [()]
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b alone.

        Walks back in time from both finished tokens, undoing the later of their last
        merges; the border falls if the fragments beside it could merge before the
        merge that was undone.
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) > 250_000:
            self.pairs.clear()
        tokens, ranks, limit = self.tokens, self.ranks, 1 << 60
        x, y, result = a, b, True
        while True:
            if ranks.get(tokens[x] + tokens[y], 1 << 60) < limit:
                result = False
                break
            age_x = x if self.right[x] >= 0 else -1
            age_y = y if self.left[y] >= 0 else -1
            if age_x < 0 and age_y < 0:
                break
            if age_x > age_y:
                limit, x = age_x, self.right[x]
            else:
                limit, y = age_y + 1, self.left[y]
        self.pairs[key] = result
        return result

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive, settled, at = [], None, 0
        packed = array("i", self.states[state])
        while at < len(packed):
            node, last, size = packed[at : at + 3]
            pending = tuple(packed[at + 3 : at + 3 + size])
            at += 3 + size
            step = self.trie.get(node << 8 | byte)
            if step is None:
                continue
            alive.append((step, last, pending))
            token = self.final[step]
            if settled is None and token >= 0 and (last < 0 or self.stable(last, token)):
                settled = (0, token, (*pending, token))
        if settled is None:
            raise ValueError("the vocabulary lacks a single byte")
        alive.append(settled)
        shared = min(len(p) for _, _, p in alive)
        first = alive[0][2]
        k = 0
        while k < shared and all(p[k] == first[k] for _, _, p in alive):
            k += 1
        flat: list[int] = []
        for node, last, pending in alive:
            flat += (node, last, len(pending) - k)
            flat += pending[k:]
        key = array("i", flat).tobytes()
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.tails.append(alive[-1][2][k:])
        return number, first[:k]

    def encode(self, word: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self._reset()
        state, out, arcs = 0, [], self.arcs
        for byte in word:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                if len(self.states) > MAX_STATES:  # inside a very long word: go on from the same state in an empty table
                    here, tail = self.states[state], self.tails[state]
                    self._reset()
                    state, arcs = self.numbers.setdefault(here, len(self.states)), self.arcs
                    if state == len(self.states):
                        self.states.append(here)
                        self.tails.append(tail)
                arc = arcs[state << 8 | byte] = self._arc(state, byte)
            state, emitted = arc
            if emitted:
                out += emitted
        return out + list(self.tails[state])

    def ids(self, words: list[str]) -> bytes:
        """Little-endian 32-bit ids of a run of words."""
        cache = self.words
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > MAX_WORDS:
            cache.clear()
        out = []
        for word in words:
            coded = cache.get(word)
            if coded is None:
                coded = np.array(self.encode(word.encode()), "<u4").tobytes()
                if len(word) <= WORD_BYTES:  # longer words are not kept, so the cache is bounded in bytes
                    cache[word] = coded
            out.append(coded)
        return b"".join(out)


def compile_merges(tokens: list[bytes]) -> dict:
    """Token bytes with the two halves each was last merged from (-1: single byte)."""
    ranks = {t: i for i, t in enumerate(tokens)}
    left, right = [-1] * len(tokens), [-1] * len(tokens)
    for rank, token in enumerate(tokens):
        if len(token) > 1:
            parts = merge_parts(token, ranks, 2)
            if len(parts) != 2:
                raise ValueError(f"token {rank} can't be reached by merges")
            left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    return {"tokens": tokens, "left": left, "right": right}


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Cuts before a blank that follows a non-blank, where every match of the pattern ends."""
    lo, n = 0, len(text)
    while n - lo > size:
        cut = lo + size
        while cut < n and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


class Utf8Machine:
    """Incremental UTF-8 decoder; `rest` is the unfinished character so far."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut = len(data) - back if need > back else len(data)
                break
            if byte < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8")

    def close(self) -> None:
        if self.rest:
            raise ValueError("the stream ends inside a character")


def decode_stream(ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
    """Text of a run of ids, piece by piece."""
    machine = Utf8Machine()
    for lo in range(0, len(ids), step):
        part = ids[lo : lo + step]
        n = sizes[part]
        at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield machine.feed(flat[at].tobytes())
    machine.close()


def _tools(model) -> tuple:
    """One transducer and decode table for each vocabulary and worker process."""

    def build() -> tuple:
        compiled, pattern = model.value
        sizes = np.array([len(t) for t in compiled["tokens"]], np.int64)
        flat = np.frombuffer(b"".join(compiled["tokens"]), np.uint8)
        return Transducer(compiled), regex.compile(pattern), flat, np.cumsum(sizes) - sizes, sizes

    return hold(model.id, build)


class _Shared:
    """A broadcast with a key by which workers keep what they build from it."""

    def __init__(self, spark, value):
        self.id, self._broadcast = hashlib.sha1(repr((len(value[0]["tokens"]), value[1], value[0]["tokens"][-50:])).encode()).hexdigest(), spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._broadcast.value


def transcode(
    documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), n_tokens and the text decoded back from the ids."""
    path, default = (vocabulary, pattern) if vocabulary else default_vocabulary()
    model = _Shared(documents.sparkSession, (compile_merges(load_ranks(path)), pattern or default))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst, split, flat, starts, sizes = _tools(model)
        for batch in batches:
            texts, idents = batch.column("text"), batch.column("doc_id")
            for lo, hi in runs(texts, limit=4 << 20):
                ids, counts, back = [], [], []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    packed = b"".join([fst.ids(split.findall(b)) for b in blocks(text)]) if text else b""
                    numbers = np.frombuffer(packed, "<u4").astype(np.int64)
                    ids.append(packed)
                    counts.append(len(numbers))
                    back.append("".join(decode_stream(numbers, flat, starts, sizes)))
                yield pa.RecordBatch.from_arrays(
                    [idents.slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(back, pa.string())],
                    ["doc_id", "ids", "n_tokens", "decoded"],
                )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def digests(documents: DataFrame) -> DataFrame:
    coded = transcode(documents)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
