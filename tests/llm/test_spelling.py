"""Spelling variants against all edits of every word."""

import re
import zlib
from collections import Counter

import pytest

from conftest import SF
from fixtures_llm import docs, empty, frame  # noqa: F401
from plantflow.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, damage=199, letters=6, least=5):
    counts = Counter()
    for ident, text in rows:
        for run in RUN.findall(text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{ident}:{word}".encode())
            if ident is not None and h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def brute(counts, ratio=5):
    letters = sorted(set("".join(counts)))

    def near(word):
        edits = set()
        for i in range(len(word) + 1):
            edits |= {word[:i] + c + word[i:] for c in letters}
            if i < len(word):
                edits |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
        return [w for w in edits - {word} if w in counts]

    out = {}
    for word, n in counts.items():
        found = near(word)
        best = min(found, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[word] = [form, n, len(found), counts.get(form)]

    def root(word):
        while out[word][0] is not None:
            word = out[word][0]
        return word

    return {w: (f, root(w), n, m, fn) for w, (f, n, m, fn) in out.items()}


def result(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spelling.query(spark, SF)) == brute(brute_counts(rows))


@pytest.mark.parametrize("damage", [1, 2, 199])
def test_edge_cases(spark, docs, damage, monkeypatch):
    monkeypatch.setattr(spelling, "LONG_TEXT", 500)
    chain = " ".join(["abcdefg"] * 200 + ["abcdefh"] * 40 + ["abcdeh"] * 8 + ["abcdefgx"] * 40 + ["ÀÉÎÕÜß"] * 30 + ["ÀÉÎÕÜÿ"] * 6)
    many = " ".join(w for w in ("aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "listen", "silent", "enlist", "tinsel") for _ in range(9))
    more = [(100, chain, "en", "a"), (101, many, "en", "a"), (None, many, "en", "a"), (102, "x" * 30_000, "en", "a"), (103, "Über×÷Ärger " * 9, "de", "b")]
    table = docs.unionByName(frame(spark, more))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = result(spelling.variants(spelling.word_counts(table, damage=damage)))
    assert got == brute(brute_counts(rows, damage))


def test_chain_of_forms(spark):
    words = spark.createDataFrame([("abcdef", 1), ("abcdeg", 5), ("abcdhg", 25), ("abcihg", 125), ("abjihg", 625), ("zzzzzz", 2)], "word string, n long")
    got = result(spelling.variants(words))
    assert all(got[w][1] == "abjihg" for w in got if w != "zzzzzz")
    assert got["zzzzzz"] == (None, "zzzzzz", 2, 0, None) and got["abcdef"][0] == "abcdeg"


@pytest.mark.parametrize("parts", [(3, 2), (4, 3), (6, 4)])
def test_no_near_pair_is_lost(spark, parts):
    import random

    r = random.Random(4)
    words = list({"".join(r.choice("abcé") for _ in range(r.randint(6, 8))) for _ in range(700)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {tuple(sorted((x.a, x.b))) for x in spelling.near_pairs(frame, *parts).collect()}
    want = {w: n for w, (_, _, _, n, _) in brute(dict.fromkeys(words, 1), 10).items()}
    assert sum(want.values()) == 2 * len(got)


def test_empty(spark, empty):
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
