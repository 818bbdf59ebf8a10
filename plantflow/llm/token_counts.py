"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than `CHUNK_CHARS` is encoded in overlapping chunks with offsets. Two
neighbouring chunks are spliced at a common boundary inside their overlap that is
proven stable: a token start right after white space in both encodings. The split pattern of the
vocabulary drops white space and no token, special string or composed character spans
it, so from there on both encodings agree with that of the whole text. An overlap without
such a boundary is widened until it has one or reaches the end of the text.

The library encodes words; counts of words already seen come from a bounded memo.
Texts with special strings or with characters whose case mapping or class may differ
between Python and the library go to the library as they are.

Null text counts as empty: 0 bytes, 0 tokens. Repeated and null ids are handled row by
row; other columns are ignored; an empty table gives an empty result.

At scale: one pass, no shuffle; the vocabulary file is a broadcast of fixed size.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.llm.text import runs

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 9
LIMIT = 2048
MAX_WORDS = 300_000

# The split pattern of word_bpe_49k.json.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Special strings, final sigma, and separators that regex engines class differently.
_DELICATE = regex.compile("<\\||[\u03a3\u03c2\u0130\x00\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]|\\p{Cn}|\\p{Co}")

Encoder = Callable[[str], tuple[list[int], list[int]]]


class WordCounter:
    """Token counts of words by the library, remembered."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.split = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def plain(self, text: str) -> str | None:
        """The normalised text if its words may be looked up one by one."""
        if not text.isascii():
            if _DELICATE.search(text):
                return None
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        elif "<|" in text or _DELICATE.search(text):
            return None
        return text.lower()

    def _learn(self, words: list[str]) -> None:
        if len(self.seen) > MAX_WORDS:
            self.seen.clear()
        new = list({w for w in words if w not in self.seen})
        for word, coded in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self.seen[word] = len(coded.ids)

    def words(self, text: str) -> tuple[list[int], list[int]]:
        """(start of each word, its tokens) of a normalised chunk."""
        found = [(m.start(), m.group()) for m in self.split.finditer(text)]
        self._learn([w for _, w in found])
        return [s for s, _ in found], [self.seen[w] for _, w in found]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """(start of each token, 1) of a chunk, all by the library."""
        offsets = self.library.encode(text, add_special_tokens=False).offsets
        return [a for a, _ in offsets], [1] * len(offsets)

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        plain = self.plain(text)
        if plain is None:
            if len(text) <= chunk:
                return len(self.library.encode(text, add_special_tokens=False).ids)
            return spliced_count(text, self.tokens, chunk, overlap)
        if len(plain) > chunk:
            return spliced_count(plain, self.words, chunk, overlap)
        words = self.split.findall(plain)
        try:
            return sum(map(self.seen.__getitem__, words))
        except KeyError:
            self._learn(words)
            return sum(map(self.seen.__getitem__, words))


def spliced_count(text: str, encode: Encoder, chunk: int, overlap: int) -> int:
    """Tokens of `text` from overlapping chunks joined at stable boundaries."""
    total, done, end, n = 0, 0, min(chunk, len(text)), len(text)
    starts, counts = encode(text[:end])
    while True:
        if end == n:
            return total + sum(c for s, c in zip(starts, counts) if s >= done)
        back = overlap
        while True:
            lo = max(done, end - back)
            reach = min(n, end + max(chunk - back, back))
            next_starts, next_counts = encode(text[lo:reach])
            next_starts = [s + lo for s in next_starts]
            mine = {s for s in starts if s > lo and text[s - 1] in " \t\n\r\x0b\x0c"}
            common = next((s for s in next_starts if s in mine), None)
            if common is not None:
                break
            if reach == n and lo == done:
                common = done
                break
            if lo == done:  # no boundary since the last splice: take more text instead
                end = reach
                starts, counts = next_starts, next_counts
            back *= 2
        total += sum(c for s, c in zip(starts, counts) if done <= s < common)
        starts, counts, done, end = next_starts, next_counts, common, reach


_loaded: dict[int, WordCounter] = {}


def token_counts(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _loaded:
            _loaded[key] = WordCounter(shared.value)
        counter = _loaded[key]
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in runs(texts):
                n = [counter.count(t) if t else 0 for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("n_bytes").slice(lo, hi - lo), pa.array(n, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
