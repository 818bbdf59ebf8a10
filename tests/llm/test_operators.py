"""Each operator against a brute-force version, on edge cases and on the small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from fixtures_llm import docs, empty  # noqa: F401
from plantflow.llm import audio, bpe, components, corpus_counts, context_mixing, exact_dedup, jaccard_join, langid, mixing, passages, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# exact deduplication


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_exact(rows, source):
    groups = defaultdict(list)
    for doc, text in source:
        groups[normal(text)].append(doc)
    keep = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    size = {hashlib.sha256(t.encode()).hexdigest(): (keep[t], len(groups[t])) for t in groups}
    assert len(rows) == len(source)
    kept = Counter()
    for r in rows:
        assert (r.keep_id, r.group_size) == size[r.text_sha256]
        kept[r.text_sha256] += r.kept
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_groups(spark, docs, digest_hex):
    source = [(r.doc_id, r.text) for r in docs.collect()]
    check_exact(exact_dedup.exact_groups(docs, digest_hex=digest_hex, memtable_rows=3).collect(), source)


def test_exact_stage_keeps_columns_and_one_row(spark, docs):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, normal(r.text)) for r in out.collect()]
    assert len(got) == len({t for _, t in got}) == len({normal(r.text) for r in docs.collect()})


def test_exact_empty(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0


# n-gram Jaccard join


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {(d, len(x), None if d is None else root(d)) for d, x in sets}


def test_jaccard_edges(spark, docs):
    """With null ids whose text others have too: they link with nothing."""
    some = docs.where("doc_id is null or not (doc_id = 3 and text not like '%extra')")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    assert (None, rows[0][1]) in rows
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(some).collect()}
    assert got == brute_components(rows)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    shared = " ".join(base[:40])
    rows += [(n + i, shared + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_scattered_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "INDEX_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "QUERY_ROWS", 7)
    rows = near_copies(seed)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_growing_copies(spark):
    """The last copy is too long to be probed against the first, and links only to one that joined through an aide."""
    base, tail = [f"b{i}" for i in range(64)], [f"w{i}" for i in range(29)]
    grown = [base, base + tail[:15], base + tail, base + tail + [f"y{i}" for i in range(13)]]
    wide = [[f"o{k}x{i}" for i in range(60)] + base[-4:] + tail for k in range(30)]
    rows = [(i, " ".join(words)) for i, words in enumerate(grown + wide)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, n, 0) for i, n in enumerate((60, 75, 89, 102))} <= got
    assert got == brute_components(rows)


def test_merge_skip_and_divide_skip(monkeypatch):
    """T-occurrence search against counting, with short and long lists on both sides of the division."""
    rng = np.random.default_rng(4)
    for need in (1, 2, 4, 7):
        lists = [np.unique(rng.integers(0, 60, rng.integers(1, 30))).tolist() for _ in range(9)]
        counts = Counter(x for post in lists for x in post)
        assert jaccard_join.merge_skip(lists, need) == sorted((x, n) for x, n in counts.items() if n >= need)
    base = rng.integers(0, 2**63, 90, dtype=np.uint64)
    sets = []
    for _ in range(120):
        mine = base.copy()
        change = rng.random(90) < rng.choice([0.0, 0.03, 0.08, 0.2, 0.9])
        mine[change] = rng.integers(0, 400, change.sum(), dtype=np.uint64)
        sets.append(np.unique(mine[: rng.integers(60, 91)]))
    sizes = np.array([len(x) for x in sets])
    for long in (0, 16, 1000):
        monkeypatch.setattr(jaccard_join, "LONG", long)
        index = jaccard_join._inverted(sets)
        for query in sets:
            common = np.array([len(np.intersect1d(query, x)) for x in sets])
            want = np.flatnonzero(100 * common >= 80 * (len(query) + sizes - common))
            assert sorted(jaccard_join.divide_skip(query, sizes, index).tolist()) == want.tolist()


def test_part_count_keeps_packed_rows_in_proportion():
    for gb in (1, 4, 16, 64, 256, 1024, 4096, 16384, 65536):
        parts = corpus_counts.part_count(gb << 30)
        assert parts * parts <= 1.05 * 16384 * gb + 4096
        assert (gb << 30) / parts <= corpus_counts.LARGEST
    assert corpus_counts.part_count(100 << 40) ** 2 < 3e9
    assert corpus_counts.part_count(0) == 1


def test_jaccard_empty(spark, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.drop_near_copies(empty).columns == empty.columns


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from plantflow.llm import storage

    storage.materialize(spark.range(3), "kept")
    path = Path(storage._written[spark.sparkContext.applicationId][-1].removeprefix("file://"))
    assert path.exists()
    storage.clear(spark)
    assert not path.exists() and not path.parent.exists()


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 200)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[200] == 0 and {got[i] for i in (100, 101, 102)} == {100}


# mixing


def test_mix_follows_weights_and_repeats(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, {"hot": 1.0, "s0": 1.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"hot", "s0"} and n["hot"] == pytest.approx(1500, rel=0.12) and n["s0"] == pytest.approx(1500, rel=0.12)
    again = mixing.mix(df.repartition(7), {"hot": 1.0, "s0": 1.0})
    assert out.exceptAll(again).isEmpty() and again.exceptAll(out).isEmpty()


def test_mix_without_ids(spark):
    """Rows without ids are drawn one by one, whatever else the columns are called."""
    rows = [(None, f"t{i}", "a", i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_n int, __n int")
    out = mixing.mix(df).collect()
    assert len(out) == pytest.approx(2000, rel=0.12) and all(r.mix_n == r["__n"] == int(r.text[1:]) for r in out)
    assert len({r.text for r in out}) == pytest.approx(2000 * (1 - np.exp(-1)), rel=0.1)


def clashing(docs):
    """The rows with columns named like those that operators may add inside."""
    for name in ("exact_key", "exact_id", "exact_sha", "near_id", "mix_source", "__id", "__key", "__sha", "__n", "n", "row", "feats", "label"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def test_stages_with_clashing_names(spark, docs):
    wide = clashing(docs)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for stage in (exact_dedup.drop_exact_copies, jaccard_join.drop_near_copies, lambda d: mixing.mix(d).drop("copy_index", "shuffle_key"), lambda d: toxicity.drop_toxic(d, labels)):
        out = stage(wide)
        assert set(out.columns) >= set(wide.columns) - {"copy_index"}
        assert all(r[c] == c for r in out.select("exact_key", "__n", "near_id", "mix_source", "label").collect() for c in r.asDict())


def test_mix_edges(spark, docs, empty):
    out = mixing.mix(docs)
    assert set(out.columns) == set(docs.columns) | {"shuffle_key"}
    assert mixing.mix(empty).count() == 0
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    n = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert all(rate[s] * n[s] == pytest.approx(docs.count() / 3) for s in n)


def test_poisson_inversion(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "rare").otherwise("common").alias("source"), F.lit("x").alias("text"))
    counts = mixing.mix(df).groupBy("doc_id").count().join(df, "doc_id").where("source = 'rare'")
    row = counts.agg(F.avg("count"), F.var_samp("count")).first()
    assert row[0] == pytest.approx(50, rel=0.05) and row[1] == pytest.approx(50, rel=0.35)


# byte-level BPE


def tiktoken_encoder():
    import public_tokenizers as P
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(spark, docs):
    enc = tiktoken_encoder()
    rows = docs.select("doc_id", "text").unionByName(table(spark).select("doc_id", "text")).collect()
    df = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.transcode(df).collect()}
    for i, r in enumerate(rows):
        ids = enc.encode_ordinary(r.text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids) and got[i].decoded == (r.text or "")


def test_bpe_transducer_on_random_bytes():
    import public_tokenizers as P

    fst = bpe.Transducer(bpe.compile_merges(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))))
    rng = random.Random(5)
    for _ in range(3000):
        word = bytes(rng.choice(b"aeinrst \xc3\xa9\xff09.,") for _ in range(rng.randint(1, 16)))
        assert [fst.tokens[i] for i in fst.encode(word)] == bpe.merge_parts(word, fst.ranks)


def test_bpe_blocks_and_utf8_machine():
    text = "  a  b \n\n c'd é " * 50 + "x" * 300
    parts = list(bpe.blocks(text, 37))
    import public_tokenizers as P
    import regex

    assert "".join(parts) == text and [m for p in parts for m in regex.findall(P.PATTERN, p)] == regex.findall(P.PATTERN, text)
    machine, data = bpe.Utf8Machine(), "aé漢🙂z".encode()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) == "aé漢🙂z"
    machine.close()


# token counts


def test_token_counts_match_library(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = docs.select("text").unionByName(table(spark).select("text")).collect()
    df = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    for r in token_counts.token_counts(df).collect():
        text = rows[r.doc_id].text or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 2048)


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 16), (200, 50)])
def test_token_counts_resynchronise(chunk, overlap):
    import public_tokenizers as P

    counter = token_counts.WordCounter(open(P.path("word_bpe_49k.json")).read())
    rng = random.Random(chunk)
    for _ in range(40):
        text = "".join(rng.choice(["don't ", "Über ", "a" * rng.randint(1, 90), " ", "\n", "12", "!?", "<|endoftext|>", "é"]) for _ in range(80))
        assert counter.count(text, chunk, overlap) == len(counter.library.encode(text, add_special_tokens=False).ids)


# audio


def test_audio_round_trip(spark, docs, empty):
    got = {}
    for r in audio.digests(audio.audio_features(docs)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(audio.store(payload)).hexdigest())
        assert want in [(g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32, g.media_sha256) for g in got[r.doc_id]]
    assert len({g.feature for g in got[0] + got[1]}) == 1
    assert audio.audio_features(empty).count() == 0


def test_audio_parts():
    tone = (128 + 100 * np.sin(2 * np.pi * 500 * np.arange(8000) / 8000)).astype(np.uint8)
    half = audio.resample(tone)
    spectrum = np.abs(np.fft.rfft(half[:4000]))
    assert abs(int(spectrum.argmax()) - 500) <= 1
    mel = np.full((60, audio.MELS), -40.0)
    mel[20:40] = 0.0
    assert audio.segments(mel) == [(20, 40)]
    back = audio.from_tensors(audio.to_tensors(mel.astype(np.float32)))
    assert back["log_mel"].type.shape == [audio.FRAMES, audio.MELS] and back.num_rows == 2


def plain_log_mel(payload):
    """Resampling by a direct sum over all taps, frame by frame spectra by a direct Fourier sum."""
    x = [(b - 128) / 128 for b in payload]
    at = lambda i: x[i] if 0 <= i < len(x) else 0.0
    n = (len(x) + audio.TAPS + len(x) % 2) // 2
    half = np.array([sum(float(audio._TAPS[k]) * at(2 * i + k - audio.TAPS) for k in range(audio.TAPS)) for i in range(n)])
    frames = 1 + max(0, -(-(n - audio.FRAME) // audio.HOP))
    half = np.r_[half, np.zeros(max(0, (frames - 1) * audio.HOP + audio.FRAME - n))]
    angle = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    power = [np.abs(angle @ (half[f * audio.HOP : f * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME))) ** 2 for f in range(frames)]
    return 10 * np.log10(np.maximum(np.array(power) @ audio._BANK, 1e-8))


def test_audio_features_match_plain_version():
    rng = np.random.default_rng(1)
    for size in (64, 128, 320, 64 * 13):
        payload = rng.integers(0, 256, size).astype(np.uint8)
        got, want = audio.log_mel(audio.resample(payload)), plain_log_mel(payload.tolist())
        assert got.shape == want.shape and np.abs(got - want).max() < 1e-2
        other = payload.copy()
        other[-1] ^= 0x40  # every sample lies in a frame
        assert not np.array_equal(audio.log_mel(audio.resample(other)), got)


# language identification


def test_langid_held_out_accuracy(spark):
    found = langid.query(spark, SF).join(table(spark).select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_langid_edges(spark, docs, empty):
    model = langid.fit(docs)
    for r in langid.identify(docs, model).join(docs.select("doc_id", F.col("text").alias("t")).dropDuplicates(["doc_id"]), "doc_id").collect():
        if not any(c.isalpha() for c in (r.t or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


def test_langid_matches_plain_version(spark):
    """Predictions equal a dictionary version of the n-grams, their weights and the cosine with the model's centroids."""
    docs = table(spark)
    model = langid.fit(docs, fit_rows=40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    learning = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 3 != 1 and t]

    def grams(text):
        letters = " " + "".join(c if c.isalpha() else " " for c in text.lower())
        letters = re.sub(" +", " ", letters)
        code = lambda g: sum(np.uint64(ord(c)) * np.uint64(0x200000) ** np.uint64(len(g) - 1 - i) for i, c in enumerate(g))
        out = Counter()
        for i in range(len(letters)):
            for k in (1, 2, 3):
                # A gram is counted at its last letter; the blank before the text only starts longer ones.
                if i >= 1 and i - k + 1 >= 0:
                    with np.errstate(over="ignore"):
                        out[int(langid._mixed(np.array([code(letters[i - k + 1 : i + 1])], np.uint64), k)[0])] += 1
        return out

    some = sorted(texts)[:25]
    df = Counter(f for t in learning for f in grams(t))
    n = len(learning)
    idf = {f: np.log((1 + n) / (1 + m)) + 1 for f, m in df.items()}
    got = {r.doc_id: r for r in langid.identify(docs.where(F.col("doc_id").isin(some)), model).collect()}
    for d in some:
        row = np.zeros(langid.DIM)
        for f, m in grams(texts[d]).items():
            row[f] = np.log(m + 1) * idf.get(f, np.log(1 + n) + 1)
        cosine = model["centroids"] @ (row / np.linalg.norm(row))
        assert got[d].score == pytest.approx(cosine.max(), abs=1e-4) and got[d].lang_pred == model["owner"][cosine.argmax()]


def test_langid_pieces_do_not_matter(monkeypatch):
    text = "Ein Haus, 12 Bäume -- und mehr! " * 9
    whole = langid.counts(text)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE_CHARS", size)
        assert (langid.counts(text) == whole).all()


# toxicity


def test_toxicity_separates(spark):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(["vilething", "vileone", "awful"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, known)).join(known, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    hit = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert hit > 0.97


def plain_ftrl(rows):
    """FTRL-proximal one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = sorted(range(len(rows)), key=lambda r: (zlib.crc32(rows[r][0].tobytes()), rows[r][0].nbytes, rows[r][1]))
    for _ in range(toxicity.EPOCHS):
        for r in order:
            feats, y = rows[r]
            feats = [*feats.tolist(), 1 << toxicity.BITS]
            w = {i: weight(i) for i in feats}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE if y else 1.0)
            for i in feats:
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_matches_plain_version(spark):
    """Weights equal a coordinate by coordinate version; repeated rows of an id count once."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["vile", "bad", "sun", "tree", "sky", "lake"][(i % 2) * 2 :]) for _ in range(12))) for i in range(60)]
    labels = [(i, 1 - i % 2) for i in range(60)]
    docs, known = spark.createDataFrame(rows + rows[:20], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    at, w = toxicity.fit(docs, known)
    data = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
    feats = [(next(toxicity.features(*data(t))), labels[i][1]) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    want = plain_ftrl(feats)
    assert set(at.tolist()) == set(want) and w.tolist() == pytest.approx([want[i] for i in at.tolist()], rel=1e-4)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels)
    got = toxicity.score(docs, weights).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score(empty, weights).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


# language-model scores


def brute_base(rows):
    ends = lambda t: [*WORD.findall(lower(t)), None]
    train = Counter(w for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for w in ends(t))
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        w = ends(t)
        out.append((d, len(w), sum(train[x] > 0 for x in w), n, round(sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=str)


def test_lm_base_and_score(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = context_mixing.lm_scores(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    want = sorted(brute_base(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got, key=key)] == [w[:4] for w in want]
    assert [r.base_score for r in sorted(got, key=key)] == pytest.approx([float(w[4]) for w in want], abs=1e-5)
    assert all(r.score < 0 for r in got)


def test_lm_is_a_distribution(spark):
    """Over all bytes that may follow a context the probabilities add up to 1."""
    docs = table(spark).select("doc_id", "text")
    model = context_mixing.fit(docs, 4)
    mixer = context_mixing.Mixer(model).freeze()
    for context in (b"the ", b" un", b"\xff\xff\xff\xffQ"):
        head = int.from_bytes(context.rjust(context_mixing.ORDER, b"\xff")[-context_mixing.ORDER :], "big")
        codes = np.array([head << 8 | b for b in range(256)], np.uint64)
        assert (10 ** mixer.log10(codes)).sum() == pytest.approx(1.0, abs=1e-6)


def test_lm_counts_are_exact(spark):
    """Counts after every context equal a count over all windows, however many contexts there are, and sum to 1."""
    docs = table(spark).select("doc_id", "text")
    model = context_mixing.fit(docs, 4)
    grams = model["grams"].collect()
    whole = Counter()
    for row in grams:
        whole.update(dict(zip(np.frombuffer(row.codes, np.uint64).tolist(), np.frombuffer(row.counts, np.int64).tolist())))
    node, bit, depth = model["tree"]
    want = Counter()
    for code, n in whole.items():
        for order in range(1, context_mixing.ORDER + 1):
            for d in range(depth[code & 255]):
                want[order, code >> 8 & (1 << 8 * order) - 1, node[code & 255, d], bit[code & 255, d]] += n
    for row in grams:
        codes, n = np.frombuffer(row.codes, np.uint64), np.frombuffer(row.counts, np.int64)
        mixer = context_mixing.Mixer(model).load(codes, n)
        for i in range(0, len(codes), 97):
            code = int(codes[i])
            for order in range(1, context_mixing.ORDER + 1):
                for d in range(depth[code & 255]):
                    key = (order, code >> 8 & (1 << 8 * order) - 1, node[code & 255, d])
                    assert mixer.taken[:, order - 1, mixer.at[i] + d].tolist() == [want[*key, 0], want[*key, 1]]
        head = int(codes[0]) >> 8 << 8
        every = np.unique(np.r_[codes, np.arange(head, head + 256, dtype=np.uint64)])
        many = np.zeros(len(every), np.int64)
        many[np.searchsorted(every, codes)] = n
        found = mixer.log10(every, many)[np.searchsorted(every, np.arange(head, head + 256, dtype=np.uint64))]
        assert (10**found).sum() == pytest.approx(1.0, abs=1e-6)


def plain_score(text, whole, model):
    """log10 probability of a text, decision by decision, from counts of windows held in a dictionary."""
    cm, (node, bit, depth) = context_mixing, model["tree"]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    total, data = 0.0, [cm.END] * cm.ORDER + list(text.encode()) + [cm.END]
    for at in range(cm.ORDER, len(data)):
        byte, context = data[at], tuple(data[at - cm.ORDER : at])
        for d in range(depth[byte]):
            p = sigmoid(float(model["order0"][node[byte, d]]))
            x, gate = [0.3, float(model["order0"][node[byte, d]])], 0
            for order in range(1, cm.ORDER + 1):
                a, b = (whole[order, context[-order:], node[byte, d], branch] for branch in (0, 1))
                p = min(max((b + float(cm.PRIOR) * p) / (a + b + float(cm.PRIOR)), 1e-5), 1 - 1e-5)
                x.append(np.log(p / (1 - p)))
                if order > 2:
                    gate = gate * 5 + int(np.searchsorted(cm.LEVELS, a + b))
            st = float(np.clip(sum(w * v for w, v in zip(model["weights"][:, gate].tolist(), x)), -12, 12))
            place = (st + 12) * (cm.BINS - 1) / 24
            low = min(int(place), cm.BINS - 2)
            cells = model["refine"][context[-1] * cm.BINS + low : context[-1] * cm.BINS + low + 2]
            q = (sigmoid(st) + cells[0] * (1 - place + low) + cells[1] * (place - low)) / 2
            q = min(max(q, 1e-6), 1 - 1e-6)
            total += np.log10(q if bit[byte, d] else 1 - q)
    return total


def test_lm_score_matches_plain_version(spark, monkeypatch):
    """Scores of whole texts, learned and held out, equal a version that walks byte by byte."""
    rows = [(i, t) for i, t in enumerate(["abc abd", "abd é", None, "", "cab cab cab", "zz top abd", "abc abc", "abq", "b", "abd abd"] * 2)]
    kept, fit = {}, context_mixing.fit

    def watched(*args):
        kept.update(fit(*args))
        return kept

    monkeypatch.setattr(context_mixing, "fit", watched)
    got = {r.doc_id: r for r in context_mixing.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole, (node, bit, depth) = Counter(), kept["tree"]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            data = [context_mixing.END] * context_mixing.ORDER + list((t or "").encode()) + [context_mixing.END]
            for at in range(context_mixing.ORDER, len(data)):
                for order in range(1, context_mixing.ORDER + 1):
                    for d in range(depth[data[at]]):
                        whole[order, tuple(data[at - order : at]), node[data[at], d], bit[data[at], d]] += 1
    assert {r.held_out for r in got.values()} == {True, False}
    for i, t in rows:
        assert got[i].score == pytest.approx(plain_score(t or "", whole, kept), abs=1e-3)


def test_lm_empty(spark, empty, docs):
    assert context_mixing.lm_scores(empty).count() == 0


# repeated passages


def brute_spans(rows, n=50):
    at = defaultdict(set)
    words = {d: WORD.findall(lower(t)) for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].add(d)
    out = set()
    for d, w in words.items():
        hits = [i for i in range(len(w) - n + 1) if len(at[tuple(w[i : i + n])]) > 1]
        start = None
        for k, i in enumerate(hits):
            start = i if start is None else start
            if k + 1 == len(hits) or hits[k + 1] > i + n:
                out.add((d, start, i + n))
                start = None
    return out


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 0), (4, 6)])
def test_passages(spark, seed, hot):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    shared = [[word() for _ in range(rng.randrange(45, 130))] for _ in range(4)]
    rows = []
    for i in range(30):
        w = [word() for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            k = rng.randrange(len(w) + 1)
            w[k:k] = p if rng.random() < 0.5 else p[a:b]
        rows.append((i, " ".join(w)))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == brute_spans(rows)
    text = dict(rows)
    for r in got:
        raw = text[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert raw.split() == text[r.doc_id].split()[r.start_word : r.end_word]


def test_passages_without_ids(spark):
    """Rows without ids are documents of their own, in whatever part they are, and never show up as ids."""
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (None, text), (None, other), (None, other), (None, " ".join(f"u{i}" for i in range(60))), (7, other + " " + text)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(5)):
        got = {(r.doc_id, r.first_doc, r.end_word) for r in passages.repeated_passages(df).collect()}
        alone = df.count() == len(rows)
        want = {(1, 1, 60), (None, 1, 60), (None, 7, 60), (7, 1, 120)} | (set() if alone else {(None, None, 60)})
        assert got == want
    none = spark.createDataFrame([(None, text)] * 4, "doc_id long, text string")
    assert [(r.doc_id, r.first_doc, r.start_word, r.end_word) for r in passages.repeated_passages(none).collect()] == [(None, None, 0, 60)] * 4


def test_passages_edges(spark, docs, empty):
    got = {(r.doc_id, r.start_word) for r in passages.repeated_passages(docs).collect()}
    assert {d for d, _ in got} == {11, 12, 13}
    assert passages.repeated_passages(empty).count() == 0
