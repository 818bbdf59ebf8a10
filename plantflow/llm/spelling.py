"""Spelling variants: words that differ by one code point, grouped below their most frequent form.

Words are the maximal runs of Latin letters of whole texts, A-Z lower-cased. Every
`damage`-th occurrence by a hash of document and run loses one letter first, the noise that
the contract asks for. Words of at least `least_letters` code points and `least_count`
occurrences are compared.

Near pairs come from PartEnum signatures. A word's letters are a multiset, thus a binary
vector with a place for each letter and repetition: a replaced letter changes two places, an
inserted or deleted one a single place. The places are dealt to parts; vectors at a Hamming
distance of at most k agree on all but k parts, so the projections on every choice of that many
parts are exact signatures: near words share at least one. Letters alone tell little apart
(anagrams), so a signature also holds the half of the word that the edit leaves as it was, and
the multiset is that of the other half. One edit leaves the first or the last half whole, so
both are enumerated and no pair is lost. Signatures are equi-joined and each pair is verified
by its edit distance.

Defined cases: a null text has no words; a row with a null id keeps its runs as they are;
repeated rows count once each; other columns are ignored, whatever their names; an empty table
gives an empty result. Of near words with equal counts the first in code-point order is the form.

At scale: each task folds its words before the shuffle, so a word that fills a third of all
text costs a row a flush. What follows grows with the words left, not with the text. Signatures
of more words need more parts (`parts_for`); the join's hot signatures are split by adaptive
execution. Pairs are only ever folded to a count and a best form, never gathered. Chains of forms rise
five-fold in count at each step, so following them by doubling takes three or four rounds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.llm.storage import materialize

RUN = re.compile("[a-zÀ-ÿ]+")
LONG_TEXT = 1 << 20
FLUSH_WORDS = 400_000


def runs_of(text: bytes) -> Counter:
    """Runs of letters with their counts; a very long text is walked without a list of its runs."""
    low = text.lower().decode(errors="replace")  # of bytes: only A-Z change; what is no UTF-8 is no letter
    if len(low) < LONG_TEXT:
        return Counter(RUN.findall(low))
    return Counter(m.group() for m in RUN.finditer(low))


def damaged(run: str, seed: int, damage: int) -> str:
    """`run` without one letter where the hash says so; `seed` is the checksum of the id and a colon."""
    h = zlib.crc32(run.encode(), seed)
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 199, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) over all whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                seed = None if ident is None else zlib.crc32(f"{ident}:".encode())
                for run, n in runs_of(text.as_py() or b"").items():
                    word = run if seed is None else damaged(run, seed, damage)
                    if len(word) >= least_letters:
                        found[word] += n
                if len(found) >= FLUSH_WORDS:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    docs = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    words = docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= least_count)


def parts_for(words: int, base: int) -> int:
    """Parts of the letters: one more for each fourfold of a million words, so that signatures stay selective."""
    return base + max(0, math.ceil(math.log(max(words, 1) / 1e6, 4)))


def _signatures(kept: Column, rest: Column, label: str, length: Column, parts: int, differ: int) -> Column:
    """Array of the signatures of a word: its kept half with each choice of all parts but `differ` of the other half's letters."""
    letters = F.array_sort(F.split(rest, ""))
    part = lambda p: F.array_join(F.filter(letters, lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == p), "")
    dealt = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), part)
    chosen = [F.array_join(F.array(*[F.get(dealt, F.lit(i)) for i in choice]), "|") for choice in combinations(range(parts), parts - differ)]
    return F.array(*[F.xxhash64(F.lit(label), length, kept, F.lit(i), projection) for i, projection in enumerate(chosen)])


def _both_halves(shorter: Column, label: str, parts: int, differ: int) -> Column:
    """Signatures of the column `word` in a pair whose shorter word has `shorter` letters."""
    word, size = F.col("word"), F.length("word")
    head = F.floor(shorter / 2).cast("int")
    tail = shorter - head
    first = _signatures(F.substr(word, F.lit(1), head), F.substr(word, head + 1), f"{label} first", shorter, parts, differ)
    last = _signatures(F.substr(word, size - tail + 1), F.substr(word, F.lit(1), size - tail), f"{label} last", shorter, parts, differ)
    return F.concat(first, last)


def near_pairs(words: DataFrame, replaced_parts: int = 4, moved_parts: int = 3) -> DataFrame:
    """(a, na, b, nb): each pair of `words` (word, n) at an edit distance of one, once."""
    size = F.length("word")
    same = _both_halves(size, "replaced", replaced_parts, 2)
    shorter, longer = _both_halves(size, "moved", moved_parts, 1), _both_halves(size - 1, "moved", moved_parts, 1)
    left = words.select(F.col("word").alias("a"), F.col("n").alias("na"), F.explode(F.concat(same, shorter)).alias("signature"))
    right = words.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.explode(F.concat(same, longer)).alias("signature"))
    # Equal lengths come from both sides alike, so one order of them is enough.
    once = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    found = left.join(right, "signature").where(once & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form)."""
    ends = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = materialize(jumped, "roots")
        ends = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return ends


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of `words` (word, n)."""
    kept = materialize(words, "words")
    total = kept.count()
    pairs = materialize(near_pairs(kept, parts_for(total, 4), parts_for(total, 3)), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    named = kept.join(best, "word", "left")
    enough = -F.col("best.minus") >= ratio * F.col("n")
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))
    named = materialize(named, "forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = None
