"""What the classifiers learn from is bounded in rows and bytes, never in a text's features or in languages."""

import numpy as np

from plantflow.llm import langid, toxicity


def test_long_texts_teach_all_their_features(spark):
    """The word that marks the toxic texts has a feature number that a cut at 16,384 features would drop."""
    words = [f"w{i}" for i in range(6_000)]
    long = " ".join(words)
    cut = sorted(next(toxicity.features(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))))[16_384]
    number = lambda w: int(next(toxicity.features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))).min())
    mark = next(w for w in (f"mark{i}" for i in range(10_000)) if number(w) > cut)
    rows = [(i, f"{long} {mark}" if i % 2 else long) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at, w = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert cut < 1 << toxicity.BITS and w[np.flatnonzero(at > cut)[:-1]].max() > 0
    got = toxicity.score(docs, (at, w)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, f"{'bad' if i % 2 else 'fine'} w{i % 40} " * 3) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    whole, some, none = (toxicity.fit(docs, labels, max_bytes=n)[0] for n in (1 << 28, 2_000, 0))
    assert len(whole) > len(some) > len(none) == 0


def test_more_than_a_thousand_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 300)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 1_100)]
    rows = [(i, " ".join([c * 3] * 4), c) for i, c in enumerate(a for a in alphabet for _ in range(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    known = set(model["owner"].tolist())
    assert len(known) > 900 and len(model["owner"]) == langid.CENTROIDS * len(known)
    pred = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    mine = [(i, c) for i, _, c in rows if c in known]
    assert sum(pred[i] == c for i, c in mine) >= 0.8 * len(mine)
