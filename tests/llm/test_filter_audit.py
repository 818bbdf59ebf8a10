"""The filter audit against a walk of every document through every order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from fixtures_llm import docs, empty, frame  # noqa: F401
from plantflow.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, ident, smallest):
    words = WORD.findall(text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": ident is not None and smallest is not None and ident > smallest,
    }


def brute(rows, labels):
    ids = defaultdict(list)
    for ident, text, _ in rows:
        ids[text or ""].append(ident)
    least = {t: min((i for i in found if i is not None), default=None) for t, found in ids.items()}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {(p or "", "".join(o), s): Counter() for _, _, p in rows for o in permutations("ABCDE") for s in range(1, 6)}
    for ident, text, part in rows:
        failed = fails(text or "", ident, least[text or ""])
        for order in permutations("ABCDE"):
            gone = False
            for step, name in enumerate(order, 1):
                c = out[part or "", "".join(order), step]
                c["unique_fails"] += failed[name] and sum(failed.values()) == 1
                c["redundant"] += failed[name] and gone
                if failed[name] and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good_lost"] += ident in good
                    c["toxic_lost"] += ident in toxic
                c["kept"] += not gone
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, s, *(int(c[n]) for n in names), shapley[p, o[s - 1]]) for (p, o, s), c in out.items())


@pytest.mark.parametrize("limits", [{}, {"flush_bytes": 600, "ranges": 7}])
def test_audit_matches_brute_force(spark, docs, limits):
    labels = [(0, 1, 1), (0, 0, 0), (1, 1, 0), (5, 0, 1), (11, 1, 1), (None, 1, 1), (3, 1, None), (99, 1, 1)]
    more = [(40, "A#" * 30, "en", "a"), (41, "A#" * 30, "en", "c"), (42, "Q" * 5 + "é" * 50, "de", "c"), (-7, "one two", "de", "b"), (8, "one two", "de", "b"), (None, "one two", "de", "b")]
    table = docs.unionByName(frame(spark, more))
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **limits)
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == brute(rows, labels)


def test_hot_text_and_common_prefix(spark):
    """A third of all rows share a text, others a long beginning; ranges split the latter."""
    prefix = "shared beginning of many texts " * 20
    rows = [(i, "the same", "en", "a") if i % 3 == 0 else (i, f"{prefix}{i * 7919 % 1000:03d}", "en", "b") for i in range(600)]
    table = frame(spark, rows)
    cuts = filter_audit.prefix_cuts(table, "text", 8, 600)
    assert sum(c.startswith(prefix.encode()) for c in cuts) >= 4
    got = {(r.part, r.mask & 16): 0 for r in filter_audit.masks(table, ranges=8).collect()}
    for r in filter_audit.masks(table, ranges=8).collect():
        got[r.part, r.mask & 16] += r.n
    assert got == {("a", 0): 1, ("a", 16): 199, ("b", 0): 400}


def test_trie_keeps_smallest_id():
    trie = filter_audit.Trie()
    nodes = [trie.insert(t, i) for t, i in ((b"abcd", 5), (b"abxy", 4), (b"ab", 9), (b"abcd", 2), (b"", 3), (b"abcdef", 1))]
    assert [n[2] for n in nodes] == [2, 4, 9, 2, 3, 1] and nodes[0] is nodes[3]


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
