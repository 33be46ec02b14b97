"""Operators 2, 5, 6, 7, 9 and the pipeline."""

import hashlib
import math
import random
import re
import struct
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from cases import awkward, empty, words
from pyspark.sql import functions as F

from lumenquarry.llm import audio, pieces, quality, simhash, tokencount, toxicity, vocabulary
from lumenquarry.llm.queries import QUERIES
from lumenquarry.llm.textops import hashes, mix, slices

SF = "/root/testdata/sf0.001"
TEXTS = ["", "a", " ", "  two  blanks ", "日本語 é\n\tx\U0001f600 ▁", "x" * 3000, "The quick brown fox, 12345!", "Ünïcode ß"]


@pytest.fixture(scope="module")
def v():
    return vocabulary.load()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def encoded(v, texts, dropout, seed=5):
    out = []
    for i, j, data, off in slices(pa.array(texts), 1 << 20):
        ids, n = pieces.encode_slice(v, data, off, np.arange(i, j).astype(np.uint64), seed, dropout)
        back, m = pieces.decode_slice(v, ids, n)
        assert np.array_equal(back, data) and np.array_equal(m, np.diff(off))
        end = np.cumsum(n)
        out += [ids[e - k : e].tolist() for e, k in zip(end, n)]
    return out


def test_slots_are_the_places_of_a_search(v):
    rng = np.random.default_rng(2)
    for keys in (v.pair_key, np.unique(rng.integers(0, 1000, 500)), np.zeros(0, np.int64)):
        asked = np.concatenate([keys, keys + 1, rng.integers(0, 2**40, 5000)])
        want = vocabulary.look_up(asked, keys) if keys.size else np.full(asked.size, -1)
        assert np.array_equal(pieces.Slots(keys)(asked), want)


# operator 5


def test_ids_without_dropout_are_the_models(v):
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary.MODEL)
    rng = random.Random(0)
    texts = [t for t in TEXTS if "▁" not in t] + [words(rng, 50) for _ in range(50)]
    assert encoded(v, texts, 0.0) == sp.encode(texts)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_varies_and_is_lossless(v, dropout):
    rng = random.Random(1)
    texts = TEXTS + [words(rng, 200)] * 3
    a, b = encoded(v, texts, dropout), encoded(v, texts, dropout)
    assert a == b and encoded(v, texts, dropout, seed=6) != a or dropout == 1.0
    assert dropout == 1.0 or a[-1] != a[-2]
    if dropout == 1.0:
        assert all(len(v.pieces[i].decode("utf8", "replace")) == 1 for i in a[-1])


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_rounds_equal_the_agenda(v, dropout, monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + [words(rng, 100), "aaaa" * 30 + " abababab" * 5]
    fast = encoded(v, texts, dropout)
    monkeypatch.setattr(pieces, "LONG", 0)
    assert encoded(v, texts, dropout) == fast


def test_encoding_of_awkward_rows(spark):
    df = awkward(spark).withColumnRenamed("key", "KEY")
    out = pieces.encode(df, check="lossless")
    assert out.columns == [*df.columns, "ids", "lossless"]
    rows = out.collect()
    assert len(rows) == df.count() and all(r["lossless"] for r in rows)
    assert all(r["ids"] == [] for r in rows if not r["text"])
    eight = [r["ids"] for r in rows if r["doc_id"] == 8]
    assert eight[0] == eight[1]
    back = pieces.decode(out.select("doc_id", F.col("text").alias("was"), "ids"))
    assert all(r["text"] == (r["was"] or "") for r in back.collect())
    assert pieces.encode(empty(df)).count() == 0
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(df.withColumn("IDS", F.lit(1)))


# operator 7


def brute_tokens(v, text):
    """The dynamic programme over whole texts, character by character."""
    if not text:
        return 0
    s = [" ", *("\0▁" if c == "▁" else c for c in text)]
    ids = {p.decode(): i for i, p in enumerate(v.pieces) if p and not v.byte_base <= i < v.byte_base + 256}
    worst = v.score[v.piece_id].min() - tokencount.PENALTY
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - v.longest), e):
            piece = "".join(s[b:e])
            if piece in ids:
                got = (best[b][0] + v.score[ids[piece]], best[b][1] + 1)
            elif e - b == 1:
                got = (best[b][0] + worst, best[b][1] + len(piece.replace("\0", "").encode()))
            else:
                continue
            if got[0] > best[e][0]:
                best[e] = got
    return best[-1][1]


@pytest.fixture(scope="module")
def scored(v):
    """The vocabulary with made-up scores, as a fit gives them."""
    return tokencount.with_scores(v, np.random.default_rng(0).integers(0, 1000, v.size))


@pytest.mark.parametrize(("long", "chunk"), [(200, 1 << 16), (0, 1 << 16), (5, 7)])
def test_counts_against_brute_force(scored, long, chunk, monkeypatch):
    monkeypatch.setattr(tokencount, "LONG", long)
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [t[:400] for t in TEXTS] + [words(rng, rng.randint(1, 40)) for _ in range(30)] + ["the of the and", "der die das", "x" * 300 + "日本the" * 20]
    want = [brute_tokens(scored, t) for t in texts]
    counter = tokencount.Counter(scored)
    for _ in range(2):  # the second time from what it keeps
        got = []
        for _, _, data, off in slices(pa.array(texts), 64):
            got += counter(data, off).tolist()
        assert got == want


def test_long_words_take_linear_time(scored):
    rng = random.Random(4)
    took = []
    for n in (50_000, 400_000):
        data = np.frombuffer(bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)), np.uint8)
        began = time.perf_counter()
        assert tokencount.Counter(scored)(data, np.array([0, n]))[0] > n / 4
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] and took[1] < 30


def brute_pieces(v, word):
    """Pieces of the best segmentation of one pre-token, by the programme with plain lists."""
    ids = {p: i for i, p in enumerate(v.pieces) if p and not v.byte_base <= i < v.byte_base + 256}
    worst, best = v.score[v.piece_id].min() - tokencount.PENALTY, [(0.0, [])]
    for e in range(1, len(word) + 1):
        top = None
        for b in range(e - 1, max(-1, e - v.longest - 1), -1):
            piece = ids.get(word[b:e].encode())
            if piece is None and e - b > 1:
                continue
            got = (best[b][0] + (worst if piece is None else v.score[piece]), best[b][1] + ([] if piece is None else [piece]))
            if top is None or got[0] >= top[0]:
                top = got
        best.append(top)
    return best[-1][1]


@pytest.mark.parametrize("long", [200, 0])
def test_pieces_of_the_best_segmentations(scored, long, monkeypatch):
    monkeypatch.setattr(tokencount, "LONG", long)
    rng = random.Random(5)
    texts = [words(rng, 30), "the of the and " * 3, "日本 é the"]
    t = [vocabulary.split(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])) for x in texts]
    for x in t:
        n = np.arange(1, x.hash.size + 1)
        want = np.zeros(scored.size, np.int64)
        for i, w in enumerate(n):
            word = bytes(x.data[x.char_at[x.first_char[i]] : x.char_at[x.first_char[i + 1]]]).decode()
            np.add.at(want, brute_pieces(scored, word), w)
        assert (tokencount.counts(scored, x, np.arange(n.size), n) == want).all()


def test_counts_when_little_is_kept(scored, monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT", 3)
    texts = ["one two three four five", "one two", "six seven one"]
    counter = tokencount.Counter(scored)
    got = [int(counter(data, off)[0]) for t in texts for _, _, data, off in slices(pa.array([t]))]
    assert got == [brute_tokens(scored, t) for t in texts]


def test_counts_of_awkward_rows(spark):
    df = awkward(spark)
    rows = tokencount.token_count(df).collect()
    assert len(rows) == df.count() and all(r["n_tokens"] == 0 for r in rows if not r["text"])
    assert tokencount.token_count(empty(df)).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        tokencount.token_count(df.withColumn("N_tokens", F.lit(1)))


# operator 6


def test_quality_tells_good_from_bad(spark):
    docs, labels = documents(spark)
    kept = {r["doc_id"] for r in quality.resample(docs, labels).select("doc_id").collect()}
    assert len(kept) == 0.9 * docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = [d for d, q in truth.items() if q == 1], [d for d, q in truth.items() if q == 0]
    assert np.mean([d in kept for d in good]) >= 0.99 and np.mean([d in kept for d in bad]) <= 0.5


@pytest.mark.parametrize(("keep", "good", "bad"), [(0.9, 0.99, 0.4), (0.85, 0.96, 0.1)])
def test_quality_on_held_out_labels(spark, keep, good, bad):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = {r["doc_id"] for r in quality.resample(docs, labels.where("doc_id % 2 = 0"), keep=keep).select("doc_id").collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([r["doc_id"] in kept for r in rest if r["quality"] == 1]) >= good
    assert np.mean([r["doc_id"] in kept for r in rest if r["quality"] == 0]) <= bad


def plain_keys(rows, labels, size):
    """(log weight, key) of each document, by plain loops: tokens, counts, ratios, means, noise."""
    def grams(text):
        t = re.findall(r"\w+|[^\w\s]+", text or "", re.ASCII)
        return t + [(a, b) for a, b in zip(t, t[1:])]

    def bucket(g):
        one = lambda w: int(hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0])
        return (one(g) if isinstance(g, str) else int(mix(np.array([(one(g[0]) * 3 + one(g[1])) % 2**64], np.uint64))[0])) % size

    raw, target, own = Counter(), Counter(), {}
    for d, text in rows:
        own[d] = [bucket(g) for g in grams(text)]
        raw.update(own[d])
        if labels.get(d) == 1:
            target.update(own[d])
    n, m = sum(raw.values()), sum(target.values())
    base = {k: (c + 1) / (n + size) for k, c in raw.items()}
    p = {k: base[k] * (target[k] + quality.PRIOR) / (base[k] * m + quality.PRIOR) for k in raw}
    empty = 1 / (n + size)
    total = sum(p.values()) + (size - len(raw)) * empty * quality.PRIOR / (empty * m + quality.PRIOR)
    out = {}
    for d, b in own.items():
        w = quality.TEMPER * sum(math.log(p[k] / total / base[k]) for k in b) / len(b) if b else 0.0
        u = (int(hashlib.md5(f"gumbel|{quality.SEED}|{d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        out[d] = (w, w - math.log(-math.log(u)))
    return out


def test_weights_and_top_k_against_plain_counting(spark):
    rng = random.Random(8)
    vocabulary_ = [words(rng, 1) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary_[: 20 + i % 20]) + rng.choice(["", ",", "!!"]) for _ in range(rng.randint(1, 60)))) for i in range(80)] + [(80, ""), (81, None)]
    labels = {i: i % 3 > 0 for i in range(0, 80, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(q)) for i, q in labels.items()], "doc_id long, quality int")
    want = plain_keys(rows, labels, quality.LEAST)
    got = {r["doc_id"]: r["w"] for r in quality.resample(docs, known, k=100, weight="w").collect()}
    assert len(got) == 82 and all(got[d] == pytest.approx(w, abs=1e-4) for d, (w, _) in want.items())
    for k in (1, 9, 40, 81):
        best = sorted(want, key=lambda d: -want[d][1])[:k]
        assert {r["doc_id"] for r in quality.resample(docs, known, k=k).collect()} == set(best)
    assert quality.resample(docs, known, k=0).count() == 0 and quality.resample(docs, known, keep=0.5).count() == 41


def test_noise_samples(spark):
    """Documents of one weight are sampled: each seed takes others."""
    docs = spark.createDataFrame([(i, "the same words") for i in range(400)] + [(-1, "other things here")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (-1, 0)], "doc_id long, quality int")
    a, b = ({r["doc_id"] for r in quality.resample(docs, labels, k=100, seed=s).collect()} for s in (1, 2))
    assert len(a) == len(b) == 100 and len(a & b) < 60


def test_buckets_grow_with_the_corpus():
    assert [quality.buckets(n) for n in (0, 10**6, 840 * 10**6, 16 * 10**13)] == [1 << 16, 1 << 16, 1 << 17, 1 << 26]


def test_quality_of_awkward_rows(spark):
    df, (_, labels) = awkward(spark), documents(spark)
    out = quality.resample(df, labels.where("1 = 0"))
    assert out.columns == df.columns and out.count() == df.count()
    assert quality.resample(empty(df), labels).count() == 0
    mine = spark.createDataFrame([(7, 1, 0), (5, 0, 0), (7, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    ids = [r["doc_id"] for r in quality.resample(df, mine).collect()]
    assert set(ids) <= {r["doc_id"] for r in df.collect()} and ids.count(8) in (0, 2)
    named = quality.resample(df, mine, weight="log_weight")
    assert named.columns == [*df.columns, "log_weight_1"]
    text_ids = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    theirs = mine.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert 0 < quality.resample(text_ids, theirs).count() <= df.count()


# operator 9


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, rest = labels.where("doc_id % 5 > 0"), labels.where("doc_id % 5 = 0").join(docs.select("doc_id", "lang"), "doc_id").collect()
    found = {r["doc_id"] for r in toxicity.toxic(docs, seen).select("doc_id").collect()}
    rate = lambda toxic, *langs: np.mean([r["doc_id"] in found for r in rest if r["toxic"] == toxic and r["lang"] in langs])
    assert rate(1, "en") >= 0.75 and rate(0, "en") <= 0.05
    assert rate(1, "en", "de", "fr", "es") >= 0.65 and rate(0, "en", "de", "fr", "es") <= 0.07


USUAL = "ordinary words of a text "


def plain_scores(model, text):
    """Mean and highest sum of a text's windows by a plain loop."""
    two = model.compressors()
    t = b" " + text.lower().encode() + b" "
    saved = []
    for i in range(0, max(1, len(t) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        w = t[i : i + toxicity.WINDOW]
        saved.append(min(toxicity.MOST, max(0, len(two[0].compress(w)) - len(two[1].compress(w)))))
    runs = [sum(saved[i : i + toxicity.RUN]) for i in range(len(saved))]
    return sum(saved) / len(saved), max(runs)


def test_scores_against_a_plain_loop(spark):
    rng = random.Random(6)
    model = toxicity.Model((USUAL * 8).encode(), b" harmless", b" dreadful", 0.1)
    texts = [" ".join(rng.choice([*USUAL.split(), "dreadful", "Dreadful", "harmless", words(rng, 1)]) for _ in range(n)) for n in (1, 2, 7, 8, 20, 300, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    for r in toxicity.score(df, model).collect():
        assert (r["toxicity"]["mean"], r["toxicity"]["peak"]) == pytest.approx(plain_scores(model, r["text"]))
    assert plain_scores(model, texts[-1])[1] > 0


def test_windows_cover_the_whole_text():
    model = toxicity.Model((USUAL * 8).encode(), b"", b" dreadful ", 0.1)
    for at in (0, 30, 43, 44, 45, 59, 60, 61, 100, 125):
        text = ((USUAL * 5)[:at] + " Dreadful " + USUAL * 3).encode()
        saved, row = toxicity.lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model.compressors())
        assert saved.max() >= 2 and saved.min() >= 0 and (row == 0).all()


def test_dictionaries_stand_apart_and_passages_count(spark):
    rng = random.Random(7)
    usual = [words(rng, 1) for _ in range(300)]
    text = lambda n, bad=0.0: " ".join("abominable" if rng.random() < bad else rng.choice(usual) for _ in range(n))
    texts, toxic = [text(200, 0.05 * (i % 3 == 0)) for i in range(600)], np.arange(600) % 3 == 0
    model = toxicity.fitted(texts, toxic)
    assert len(model.toxic) <= toxicity.CLASS_BYTES and len(model.ordinary) == toxicity.CLASS_BYTES and len(model.base) == toxicity.BASE_BYTES
    assert b"abominable" in model.toxic and b"abominable" not in model.ordinary and model.ordinary not in model.toxic + model.base
    passage = text(3000) + " " + text(60, 0.5) + " " + text(3000)
    two = model.compressors()
    for t, found in ((passage, True), (text(6000), False), (text(200, 0.1), True), (text(200), False)):
        mean, peak = toxicity.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), two)
        assert (mean[0] >= model.cut or peak[0] >= model.local) == found
    mean, peak = toxicity.scores(np.frombuffer(passage.encode(), np.uint8), np.array([0, len(passage)]), two)
    assert peak[0] >= model.local


def test_every_labelled_text_counts(spark, monkeypatch):
    """Beyond LABELLED texts too: the runs of bytes, the dictionaries and the thresholds are those of all of them."""
    monkeypatch.setattr(toxicity, "LABELLED", 150)
    monkeypatch.setattr(toxicity, "FITTED", 100)
    monkeypatch.setattr(toxicity, "FAN", 3)
    monkeypatch.setattr(toxicity, "GATHERED", 400)
    rng = random.Random(8)
    usual = [words(rng, 1) for _ in range(300)]
    text = lambda n, bad=0.0: " ".join("abominable" if rng.random() < bad else rng.choice(usual) for _ in range(n))
    rows = [(i, text(150, 0.06 * (i % 3 == 0)), int(i % 3 == 0)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("split"), F.col("doc_id").cast("string")), F.lit(150)).alias("h")).collect()}
    of = lambda y, on: sorted({t.encode() for i, t, label in rows if label == y and (h[i] < 100) == on})
    bad, good = of(1, True), of(0, True)
    seen = []
    marks = toxicity._known_grams
    monkeypatch.setattr(toxicity, "_known_grams", lambda *a: seen.append(marks(*a)) or seen[-1])
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    own = [toxicity.grams(t) for t in bad]
    assert [x for t, g in zip(bad, own) for x in toxicity.covered(t, g, seen[0])] == toxicity.stretches(bad, good)
    assert b"abominable" in model.toxic and b"abominable" not in model.ordinary
    rest = [(t.decode(), y) for y in (0, 1) for t in of(y, False)]
    _, off, data = pa.array([t for t, _ in rest], pa.large_string()).buffers()
    mean, peak = toxicity.scores(np.frombuffer(data, np.uint8), np.frombuffer(off, np.int64)[: len(rest) + 1], model.compressors())
    y = np.array([y == 1 for _, y in rest])
    assert model.cut == toxicity.best_cut(mean, y) and model.local == peak[~y].max() + 1


def test_cut_of_binned_scores(spark):
    rng = np.random.default_rng(4)
    for spread in (0.01, 1.0, 3.0):
        bad = rng.random(400) < 0.3
        mean = np.round(np.clip(rng.normal(1, spread, 400) + bad * spread, 0, 5), 3)
        got = toxicity._cut_of(spark.createDataFrame(list(zip(mean.tolist(), bad.tolist())), "mean double, bad boolean"))
        assert got == pytest.approx(toxicity.best_cut(mean, bad))


def test_toxicity_of_awkward_rows(spark):
    df, (_, labels) = awkward(spark), documents(spark)
    assert toxicity.toxic(df, labels.where("1 = 0")).count() == 0
    assert toxicity.toxic(empty(df), labels).count() == 0
    assert toxicity.toxic(df.withColumn("toxicity", F.lit(1)), labels).columns == [*df.columns, "toxicity", "toxicity_1"]
    model = toxicity.Model((USUAL * 8).encode(), b"", b" same text here ", 0.1)
    rows = toxicity.score(df, model, out="got").collect()
    assert len(rows) == df.count() and all(r["got"]["mean"] == 0 for r in rows if not (r["text"] or "").strip())
    text_ids = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert toxicity.toxic(text_ids, labels.withColumn("doc_id", F.lit("d7"))).count() == 0


# operator 2


def tone(seconds, f, rate, level=0.5):
    return level * np.sin(2 * np.pi * f * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("rate", [8000, 11025, 16000, 22050, 44100, 48000])
def test_resampling_keeps_a_tone(rate):
    y = audio.resample(tone(0.5, 440, rate), rate)
    assert abs(y.size - 8000) <= 1
    assert np.abs(y - tone(y.size / 16000, 440, 16000)[: y.size])[300:-300].max() < 1e-3


@pytest.mark.parametrize("rate", [8000, 44100])
def test_resampling_against_the_full_convolution(rate):
    x = np.random.default_rng(0).normal(size=300)
    g = np.gcd(rate, 16000)
    up, down = 16000 // g, rate // g
    h, half = audio._branches(up, down)
    stuffed = np.zeros(x.size * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, h.T.ravel())[half:][::down]
    y = audio.resample(x, rate)
    assert np.allclose(y, full[: y.size], atol=1e-9)


def test_wav_kinds():
    x = tone(0.1, 300, 8000)
    y, rate = audio.read_wav(audio.write_wav(x, 8000))
    assert rate == 8000 and np.abs(x - y).max() < 1e-4
    stereo = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x01\0\x02\0\x40\x1f\0\0\0\x7d\0\0\x04\0\x10\0data\x08\0\0\0" + np.array([16384, 0, -16384, 0], "<i2").tobytes()
    assert np.allclose(audio.read_wav(stereo)[0], [0.25, -0.25])
    assert np.allclose(audio.read_wav(stereo[:-3])[0], [0.25])
    for rate in (0, 1, 999, 384_001, 4_294_967_295):
        assert audio.read_wav(stereo[:24] + int(rate).to_bytes(4, "little") + stereo[28:]) is None
    for bad in (None, b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"x" * 100):
        assert audio.read_wav(bad) is None


def wav(kind, bits, data, extension=b""):
    fmt = struct.pack("<HHIIHH", kind, 1, 8000, 0, 0, bits) + extension
    return b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data


def test_extensible_formats():
    x = np.array([0.148, 0.282, -0.5], "<f4")
    extension = lambda sub, bits: struct.pack("<HHIH", 22, bits, 0, sub) + bytes(14)
    assert np.allclose(audio.read_wav(wav(0xFFFE, 32, x.tobytes(), extension(3, 32)))[0], x)
    assert np.allclose(audio.read_wav(wav(3, 32, x.tobytes()))[0], x)
    assert np.allclose(audio.read_wav(wav(0xFFFE, 16, np.array([16384], "<i2").tobytes(), extension(1, 16)))[0], [0.5])
    assert np.allclose(audio.read_wav(wav(1, 24, b"\0\0\x40"))[0], [0.5]) and np.allclose(audio.read_wav(wav(1, 8, b"\xc0"))[0], [0.5])
    for bad in (wav(0xFFFE, 32, x.tobytes()), wav(0xFFFE, 32, x.tobytes(), extension(2, 32)), wav(2, 16, b"1234"), wav(3, 16, b"1234"), wav(1, 12, b"1234"), wav(1, 64, bytes(8))):
        assert audio.read_wav(bad) is None


def test_log_mel_against_a_plain_transform():
    """Frames, Hann window, Fourier sums and triangles written out."""
    x = np.random.default_rng(1).normal(size=800) * 0.1
    got, level = audio.log_mel(x)
    n = np.arange(audio.WINDOW)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * n / audio.WINDOW)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(20) + (mel(8000) - mel(20)) * i / (audio.MELS + 1)) / 2595) - 1) for i in range(audio.MELS + 2)]
    assert got.shape == (3, audio.MELS)
    for k in range(3):
        frame = x[k * audio.HOP : k * audio.HOP + audio.WINDOW]
        power = [abs(np.sum(frame * hann * np.exp(-2j * np.pi * f * n / audio.FFT))) ** 2 for f in range(audio.FFT // 2 + 1)]
        for m in range(audio.MELS):
            lo, mid, hi = edges[m : m + 3]
            energy = sum(p * max(0, min((f * 31.25 - lo) / (mid - lo), (hi - f * 31.25) / (hi - mid))) for f, p in enumerate(power))
            assert got[k, m] == pytest.approx(math.log(max(energy, audio.FLOOR)), abs=1e-4)
        assert level[k] == pytest.approx(10 * math.log10(np.mean(frame**2)), abs=1e-6)


def plain_speech(level):
    """Hysteresis as a machine of two states, frame by frame."""
    floor = min(float(np.percentile(level, 10)), audio.CEILING)
    out, begun, quiet = [], None, 0
    for i, x in enumerate(level):
        if begun is None:
            if x > floor + audio.ON:
                begun, quiet = i, 0
        else:
            quiet = quiet + 1 if x < floor + audio.OFF else 0
            if quiet == audio.HANG:
                out.append((begun, i + 1 - quiet))
                begun = None
    if begun is not None:
        out.append((begun, len(level) - quiet))
    return out


def test_segments_against_a_plain_machine():
    rng = np.random.default_rng(2)
    for _ in range(200):
        level = np.repeat(rng.choice([-95.0, -84, -80, -60, -30], 30), rng.integers(1, 8, 30)) + rng.normal(size=1)
        assert audio.speech(level) == plain_speech(level)


def test_segments_by_hysteresis():
    level = np.full(100, -90.0)
    level[10:20] = -30
    level[20:22] = -90  # shorter than the hang time
    level[22:30] = -82  # between the thresholds: goes on, but wouldn't begin
    level[60:63] = -82
    assert audio.speech(level) == [(10, 30)]
    assert audio.speech(np.full(50, -100.0)) == [] and audio.speech(np.zeros(0)) == []


def test_spans_and_shapes():
    rate, quiet = 8000, np.zeros(4000)
    x = np.concatenate([quiet, tone(0.5, 500, rate), quiet, tone(0.2, 900, rate), quiet])
    rows = list(audio.features(audio.write_wav(x, rate)))
    assert {r[0] for r in rows} == {0, 1} and all(r[6].shape == (audio.FRAMES, audio.MELS) for r in rows)
    assert rows[0][4] == pytest.approx(0.5, abs=0.03) and rows[0][5] == pytest.approx(1.0, abs=0.03)
    centre = audio.mel_bank().argmax(axis=0) * audio.RATE / audio.FFT
    assert abs(centre[rows[0][6][5].argmax()] - 500) < 80


def test_audio_rows_and_tensors(spark, tmp_path):
    good = audio.write_wav(np.concatenate([np.zeros(3000), tone(0.6, 500, 8000), np.zeros(3000)]), 8000)
    df = spark.createDataFrame([(1, good, None), (1, good, None), (2, None, "n"), (3, b"", "e"), (4, b"RIFFjunk", "j"), (5, audio.write_wav(np.zeros(9000), 8000), "silent"), (None, good[:9000], "cut")], "id long, audio binary, c0 string")
    out = audio.audio_features(df)
    rows = out.collect()
    assert {r["id"] for r in rows} == {1, None} and out.columns[:2] == ["id", "c0"]
    one = [r["log_mel"] for r in rows if r["id"] == 1]
    assert len(one) % 2 == 0 and sorted(one)[0] == sorted(one)[1]
    assert audio.audio_features(empty(df)).count() == 0
    with pytest.raises(ValueError, match="chunk"):
        audio.audio_features(df.withColumn("Chunk", F.lit(1)))
    packed = audio.audio_tensors(df)
    assert packed.columns == ["id", "c0", "n_tensors", "tensors"] and packed.count() == df.count()
    assert all((r["tensors"] is None) == (r["n_tensors"] == 0) for r in packed.collect())
    packed.coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    data = stored.where("id = 1").first()["tensors"]
    assert audio.stream_of(data).schema.field("log_mel").type == audio.tensor_type()
    assert audio.read_tensors(data).shape == (len(one) // 2, audio.FRAMES, audio.MELS)
    back = audio.unpack(stored.drop("n_tensors"))
    assert back.columns == out.columns
    plain_ = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain_(back.collect()) == plain_(rows)
    with pytest.raises(ValueError, match="tensors"):
        audio.audio_tensors(df.withColumn("Tensors", F.lit(1)))
    assert audio.audio_tensors(empty(df)).count() == 0


def test_audio_query_against_one_by_one(spark):
    got = {(r["conv_id"], r["turn"]): r for r in QUERIES["op2_audio"](spark, SF).collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert len(got) == len(turns)
    for t in turns[:40]:
        want = list(audio.features(audio.voiced(t["text"])))
        r = got[t["conv_id"], t["turn"]]
        assert r["n_tensors"] == len(want) > 0
        table = audio.stream_of(r["tensors"])
        assert [tuple(x.values()) for x in table.drop_columns("log_mel").to_pylist()] == [w[:6] for w in want]
        assert np.array_equal(audio.read_tensors(r["tensors"]), np.stack([w[6] for w in want]))


# the pipeline


@pytest.mark.skipif(not Path(__file__).parents[2].joinpath("corpus_pipeline.py").exists(), reason="the pipeline isn't there")
def test_pipeline_against_brute_force(spark, v):
    import corpus_pipeline as p

    docs, labels = documents(spark)
    df = docs
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        before = df.toPandas()
        df = spark.createDataFrame(stage(spark, df, SF).toPandas())
        assert df.columns == columns
        after = df.toPandas()
        assert set(after["doc_id"]) <= set(before["doc_id"])
        if name == "quality":
            assert len(after) == -(-9 * len(before) // 10)
        if name == "mixing":
            own = lambda t: len(re.findall(r"[^ \t\n\r]+", t or ""))
            tokens = before.assign(n=before["text"].map(own)).groupby("source")["n"].sum()
            rate = tokens.sum() * (tokens**0.5 / (tokens**0.5).sum()) / tokens
            u = before["doc_id"].map(lambda d: (int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)
            r = before["source"].map(rate)
            times = np.floor(r) + (u < r - np.floor(r))
            assert after["doc_id"].value_counts().to_dict() == {int(d): int(n) for d, n in zip(before["doc_id"], times) if n}
        if name == "exact_dedup":
            assert set(after["doc_id"]) == set(before.groupby("text")["doc_id"].min())
        if name == "near_dedup":
            own = [set("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in after["text"]]
            alike = [(i, j) for i in range(len(own)) for j in range(i) if own[i] and len(own[i] & own[j]) >= 0.9 * max(len(own[i]), len(own[j]))]
            assert len(alike) <= 0.02 * len(own)
    last = p.STAGES[-1][1](spark, df, SF).toPandas()
    text = {r.doc_id: r.text for r in df.toPandas().itertuples()}
    assert len(last) == df.count()
    for r in last.itertuples():
        back, _ = pieces.decode_slice(v, np.asarray(r.ids, np.int32), np.array([len(r.ids)]))
        assert bytes(back).decode() == text[r.doc_id] and r.n_ids == len(r.ids)


@pytest.mark.skipif(not Path(__file__).parents[2].joinpath("corpus_pipeline.py").exists(), reason="the pipeline isn't there")
def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline as p

    df = awkward(spark)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns, name
        assert stage(spark, empty(df), SF).count() == 0, name
    assert p.STAGES[-1][1](spark, df, SF).count() == df.count()


@pytest.mark.skipif(not Path(__file__).parents[2].joinpath("corpus_pipeline.py").exists(), reason="the pipeline isn't there")
def test_near_copies_at_the_largest_distance_leave_one(spark):
    """The stage keeps the least document of each group that all pairs make, also where they differ as much as they may."""
    import corpus_pipeline as p

    rng, rows = random.Random(3), []
    of = lambda texts: np.concatenate([simhash.fingerprint(data, off) for _, _, data, off in slices(pa.array(texts, pa.large_string()))])
    while len(rows) < 80:
        first = words(rng, 60)
        edits = []
        for _ in range(40):
            w = first.split()
            for at in rng.sample(range(60), 9):
                w[at] = words(rng, 1)
            edits.append(" ".join(w))
        d = np.bitwise_count(of(edits) ^ of([first])).sum(axis=1)
        far = np.flatnonzero((d >= simhash.MAX_BITS - 4) & (d <= simhash.MAX_BITS))
        if far.size:
            rows += [(len(rows), first, "en", "s", 0), (len(rows) + 1, edits[far[0]], "en", "s", 0)]
    kept = p.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 80, 2))


@pytest.mark.skipif(not Path(__file__).parents[2].joinpath("corpus_pipeline.py").exists(), reason="the pipeline isn't there")
@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_copies_without_an_id_leave_one(spark, kind):
    """Rows without a doc_id are compared with all others in the stage, and stay only where no row with one is near."""
    import corpus_pipeline as p

    rng = random.Random(4)
    a, b, c, d, e = (words(rng, 80) for _ in range(5))
    near = lambda t, k: " ".join([*t.split()[:-k], words(rng, k)])
    both = [(9, a, "en", "s", 0), (None, near(a, 1), "en", "s", 0), (None, near(a, 2), "en", "s", 0)]
    none = [(None, b, "en", "s", 2), (None, near(b, 2), "en", "s", 1), (None, near(b, 2), "en", "s", 3)]
    ids = [(5, c, "en", "s", 0), (4, near(c, 2), "en", "s", 0)]
    apart = [(None, d, "en", "s", 0), (6, e, "en", "s", 0), (None, None, "en", "s", 0), (None, None, "en", "s", 0)]
    rows = [*both, *none, *none[:1], *ids, *apart]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("near_key", F.lit(1))
    kept = p.drop_near_copies(spark, df.repartition(3), SF)
    assert kept.dtypes == df.dtypes
    want = [both[0], none[1], ids[1], *apart]
    assert Counter(tuple(r)[1:5] for r in kept.collect()) == Counter(r[1:] for r in want)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(None if r[0] is None else int(r[0]) if kind == "long" else str(r[0]) for r in want)
