"""Operators 1, 3, 4, 8, 10: the ones that bring documents together."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, empty, plain, planted, words
from pyspark.sql import functions as F
from sqlcheck import same

from lumenquarry.llm import bloom, exact_dedup, mixing, sharding, simhash, substring
from lumenquarry.llm.queries import QUERIES, SQL
from lumenquarry.llm.textops import slices


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


# operator 4


def test_exact_dedup_of_awkward_rows(spark):
    df = awkward(spark)
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns
    rows = out.collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert ids == Counter([1, 2, 4, 5, 6, 7, None, 10, 11])
    assert {r["doc_id"]: r["source"] for r in rows}[7] == "a"
    assert exact_dedup.dedup(empty(df)).count() == 0


def test_exact_dedup_with_a_full_filter(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 3) if i % 3 else "twice", "en", "a", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    full = {r["doc_id"]: r["n_copies"] for r in exact_dedup.groups(df, max_cells=1 << 20).collect()}
    assert full[0] == 1000 and len(full) == 2001


def test_repeated_hashes_are_all_found(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**62), 2**62, 30_000)
    rows = np.concatenate([h, h[:500], h[:100], np.repeat(h[0], 9_000)])
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(x),) for x in rows], "h long").repartition(5)
    for part in (4_000_000, 5_000):
        found = {r["h"] for r in bloom.again(df, rows.size, part).collect()}
        assert found >= set(h[:500].tolist()) and len(found) < 500 + 600
    assert bloom.again(df.limit(0), 0).count() == 0


def test_broadcast_filter(spark):
    df = spark.range(5000).select((F.col("id") * 7919).alias("h"))
    bits = bloom.containing(df, 5000).value
    assert bloom.has(bits, (np.arange(5000) * 7919).astype(np.uint64)).all()
    assert bloom.has(bits, (np.arange(5000) * 7919 + 1).astype(np.uint64)).mean() < 0.01
    # a filter of too few bits lets more pass and loses none
    small = bloom.containing(df, 5000, 1 << 20).value
    assert bloom.has(small, (np.arange(5000) * 7919).astype(np.uint64)).all()


def test_bloom_finds_all_repeats():
    h = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    size = bloom.size_for(h.size)
    bits = np.zeros(size, bool)
    for c in bloom.cells(h[:100], size):
        bits[c] = True
    packed = np.packbits(bits, bitorder="little")
    assert bloom.has(packed, h[:100]).all() and bloom.has(packed, h[100:]).mean() < 0.01


# operator 1


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 500, 4)).astype(np.uint64)
    b[:250] = a[:250] ^ (rng.integers(0, 2**63, (250, 4)).astype(np.uint64) & rng.integers(0, 2**63, (250, 4)).astype(np.uint64) & rng.integers(0, 2**63, (250, 4)).astype(np.uint64))
    bound = simhash._lower_bound(a, b)
    p = np.uint64(0x5555555555555555)
    fields = lambda x: np.unpackbits(((x & p) + ((x >> np.uint64(1)) & p)).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").reshape(len(x), -1, 2) @ np.array([1, 2])
    assert (bound == np.abs(fields(a).astype(int) - fields(b)).sum(axis=1)).all()
    assert (bound <= np.bitwise_count(a ^ b).sum(axis=1)).all()


def test_near_pairs_against_all_pairs(spark):
    rows, _ = planted(seed=2, n=400, copies=200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    f = simhash.fingerprints(df)
    pdf = f.toPandas()
    words_ = pdf[simhash.WORDS].to_numpy(np.int64).view(np.uint64)
    d = np.bitwise_count(words_[:, None] ^ words_[None]).sum(axis=2)
    a, b = np.nonzero(np.triu(d <= simhash.MAX_BITS, 1))
    node = pdf["node"].to_numpy()
    true = {frozenset((node[i], node[j])): int(d[i, j]) for i, j in zip(a, b)}
    found = {frozenset((r["a"], r["b"])): r["distance"] for r in simhash.near_pairs(f).collect()}
    assert len(true) >= 190
    assert all(true[k] == v for k, v in found.items())
    assert len(found) >= 0.9 * len(true)


def test_embed_and_cells_are_the_same_in_both_engines(spark):
    df = spark.createDataFrame([(i, w, "en", "s", 0) for i, w in enumerate(["a b c", "d e f g", "", "A, b! C"])], "doc_id long, text string, lang string, source string, n_chars long")
    pdf = simhash.fingerprints(df).select("doc_id", "f0", simhash.embed(F.col("f0")).alias("e0")).toPandas().set_index("doc_id")
    f, p = pdf["f0"].to_numpy(np.int64).view(np.uint64), np.uint64(0x5555555555555555)
    assert ((f & p) + ((f >> np.uint64(1)) & p) == pdf["e0"].to_numpy(np.int64).view(np.uint64)).all()
    assert pdf["f0"][0] == pdf["f0"][3]  # case and punctuation don't count


def grouped(rows):
    """Groups of more than one document, from rows (doc_id, class_id, n_class)."""
    by = defaultdict(set)
    for r in rows:
        by[r["class_id"]].add(r["doc_id"])
    assert all(min(g) == c for c, g in by.items()) and all(r["n_class"] == len(by[r["class_id"]]) for r in rows)
    return [g for g in by.values() if len(g) > 1]


def test_groups_of_planted_copies(spark):
    rows, groups = planted(seed=5, n=60, copies=20)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = simhash.classes(df).collect()
    assert len(got) == len(rows)
    found = grouped(got)
    assert sum(g in found for g in groups) >= 18 and all(g in groups for g in found)
    text_ids = df.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    assert sorted(sorted(g) for g in grouped(simhash.classes(text_ids).collect())) == sorted(sorted(f"d{x:05d}" for x in g) for g in found)
    assert simhash.near_dedup(text_ids).count() == len(rows) - sum(len(g) - 1 for g in found)


def parts_of(n, a, b):
    label = list(range(n))
    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, j in zip(a.tolist(), b.tolist()):
        i, j = top(i), top(j)
        label[max(i, j)] = min(i, j)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("spread", [4, 12, 20, 26])
def test_stars_connect_what_all_pairs_connect(spread):
    """Cells with large groups of near copies, chains and strangers."""
    rng = np.random.default_rng(spread)
    seeds = rng.integers(0, 2**63, (6, 4)).astype(np.uint64)
    f = seeds[rng.integers(0, 6, 900)].copy()
    for row in f:
        for bit in rng.integers(0, 256, rng.integers(0, 2 * spread)):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    f = np.unique(np.concatenate([f, rng.integers(0, 2**63, (50, 4)).astype(np.uint64)]), axis=0)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    a, b = np.nonzero(np.triu(d <= simhash.MAX_BITS, 1))
    i, j = simhash._stars(f, simhash.MAX_BITS)
    assert (np.bitwise_count(f[i] ^ f[j]).sum(axis=1) <= simhash.MAX_BITS).all()
    assert parts_of(len(f), i, j) == parts_of(len(f), a, b)


def test_large_cells_give_the_same_groups(spark, monkeypatch):
    rows, _ = planted(seed=9, n=30, copies=30)
    df = spark.createDataFrame([*rows, *[(1000 + i, rows[0][1] + " " + " ".join(["more", "words", str(i)]), "en", "s", 0) for i in range(150)]], "doc_id long, text string, lang string, source string, n_chars long")
    reps = simhash.fingerprints(df).dropDuplicates(simhash.WORDS)
    groups = []
    for small in (64, 10**9):
        monkeypatch.setattr(simhash, "SMALL", small)
        edges = simhash.near_pairs(reps, forest=True)
        groups.append(sorted((r["node"], r["root"]) for r in simhash.components(edges.select("a", "b")).collect()))
    assert groups[0] == groups[1] and len(groups[0]) >= 150


def test_recall_has_the_bound_that_is_stated():
    assert [round(1 - simhash.recall(s), 3) for s in (20, 22, 24, 31, 36, 44)] == [0.001, 0.003, 0.01, 0.135, 0.342, 0.692]
    rng, seed = np.random.default_rng(3), np.random.Generator(np.random.PCG64(simhash.SEED))
    grids = [set(seed.choice(128, simhash.AXES, replace=False).tolist()) for _ in range(simhash.GRIDS)]
    for s in (24, 36):
        differ = [set(rng.choice(128, s, replace=False).tolist()) for _ in range(2000)]
        assert abs(np.mean([any(not g & x for g in grids) for x in differ]) - simhash.recall(s)) < 0.05


def far_apart(seed, n=60):
    """Fingerprints in pairs, each as far apart as pairs may be and in as many segments; all other distances are larger."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, (n, 4), dtype=np.uint64)
    b = a.copy()
    for i, row in enumerate(b):
        for at in rng.choice(128, simhash.MAX_BITS - i % 3, replace=False).tolist():
            row[at // 32] ^= np.uint64(1 << (2 * (at % 32) + int(rng.integers(0, 2))))
    return a, b


@pytest.mark.parametrize("forest", [False, True])
@pytest.mark.parametrize("blocks", [1, 4])
def test_no_pair_within_the_distance_is_left_out(spark, forest, blocks):
    a, b = far_apart(blocks)
    f = np.concatenate([a, b])
    df = spark.createDataFrame(f.view(np.int64).tolist(), ", ".join(f"{w} long" for w in simhash.WORDS))
    pairs = simhash.near_pairs(df, forest=forest, **({"rows": -(-len(f) // blocks)} if blocks > 1 else {})).collect()
    i, j = (simhash.node_of(x).view(np.int64).tolist() for x in (a, b))
    assert {frozenset((r["a"], r["b"])) for r in pairs} == {frozenset(p) for p in zip(i, j)}
    assert all(r["a"] < r["b"] for r in pairs)


@pytest.mark.parametrize("n, most", [(1, 44), (10**5, 44), (10**7, 44), (1000, 0), (1000, 3), (1000, 100)])
def test_some_mask_has_none_of_the_bits_that_differ(n, most):
    rng, parts = np.random.default_rng(most), simhash.families(n, most)
    assert sum(k + 1 for _, _, k, _ in parts) == most + 1
    for _, width, k, masks in parts:
        for _ in range(300):
            bits = sum(1 << x for x in rng.choice(width, min(k, width), replace=False).tolist())
            assert (masks & np.uint64(bits) == 0).any()


def test_near_dedup_of_awkward_rows(spark):
    df = awkward(spark)
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids == Counter([1, 2, 5, 6, 7, None, None, 10, 11])
    assert simhash.near_dedup(empty(df)).count() == 0 and simhash.classes(empty(df)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


# operator 3


def test_sharding_is_fair_and_moves_little(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    two = dict(sharding.SHARDS) | {"more": 1.0}
    both = df.select(sharding.shard_of(["doc_id"]).alias("a"), sharding.shard_of(["doc_id"], two).alias("b")).collect()
    n = Counter(r["a"] for r in both)
    total = sum(sharding.SHARDS.values())
    for s, w in sharding.SHARDS.items():
        assert abs(n[s] / 20_000 - w / total) < 5 * math.sqrt(w / total / 20_000)
    moved = [r for r in both if r["a"] != r["b"]]
    assert all(r["b"] == "more" for r in moved) and 0.02 < len(moved) / 20_000 < 0.06


def test_equal_scores_go_to_the_first_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "unit", lambda key: F.lit(0.5) + F.length(key) * 0)
    got = spark.range(3).select(sharding.shard_of(["id"], {"b": 1.0, "a": 1.0, "c": 1.0}).alias("s")).collect()
    assert {r["s"] for r in got} == {"b"}


def test_sharding_of_awkward_rows(spark):
    df = awkward(spark)
    rows = sharding.assign_shards(df).collect()
    assert len(rows) == df.count() and all(r["shard"] for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.assign_shards(empty(df)).count() == 0
    with pytest.raises(ValueError, match="shard"):
        sharding.assign_shards(df.withColumn("Shard", F.lit(1)))
    with pytest.raises(ValueError):
        sharding.shard_of(["doc_id"], {"a": 0.0})


# operator 8


def brute_spans(rows):
    seen = defaultdict(set)
    texts = [(d, t.split()) for d, t in rows if t is not None and d is not None]
    for d, w in texts:
        for i in range(len(w) - 49):
            seen[" ".join(w[i : i + 50])].add(d)
    places = defaultdict(set)
    for d, w in texts:
        for i in range(len(w) - 49):
            if len(seen[" ".join(w[i : i + 50])]) > 1:
                places[d].add(i)
    out = set()
    for d, at in places.items():
        at = sorted(at)
        first = at[0]
        for a, b in zip(at, [*at[1:], None]):
            if b is None or b - a > 50:
                out.add((d, first, a + 50))
                first = b
    return out


@pytest.mark.parametrize(("rounds", "held", "settled"), [(None, 4, 1 << 20), (3, 4, 1 << 20), (5, 2, 100)])
def test_repeats_against_brute_force(spark, rounds, held, settled, monkeypatch):
    monkeypatch.setattr(substring, "HELD", held)
    monkeypatch.setattr(substring, "SETTLED", settled)
    rng = random.Random(7)
    shared = [words(rng, n).split() for n in (49, 50, 51, 75, 200)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randint(0, 150)).split()
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = s
        rows.append((i, " ".join(w)))
    rows += [(100, "again " * 200), (101, "alone " * 300), (102, "again " * 60), (103, None), (None, rows[0][1]), (0, rows[0][1]), (104, ""), (5, "a different text of document five"), (200, "round and " * 90), (201, words(rng, 20) + " " + "round and " * 60), (202, ("lone and " * 70 + words(rng, 60) + " ") * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in substring.repeats(df, rounds=rounds).collect()}
    assert got == brute_spans(rows) and len(got) > 20


def test_repeats_with_ids_of_any_type(spark):
    rng = random.Random(11)
    shared = words(rng, 70)
    df = spark.createDataFrame([("a", words(rng, 30) + " " + shared), ("b", shared), ("c", words(rng, 90)), (None, shared)], "doc_id string, text string")
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in substring.repeats(df).collect()} == {("a", 30, 100), ("b", 0, 70)}


def test_repeats_of_awkward_rows(spark):
    df = awkward(spark)
    assert substring.repeats(df).count() == 0 and substring.repeats(empty(df)).count() == 0


# operator 10


def test_mixing_counts(spark):
    rows = [(i, "w " * 10, "en", "big" if i % 4 else "small", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(df, {"big": 1, "small": 1}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["small"] - 1000) <= 1 and abs(n["big"] - 1000) < 120
    assert {r["source"] for r in mixing.mix(df, {"big": 1}).select("source").distinct().collect()} == {"big"}


def test_small_rates_arent_rounded_to_nothing(spark):
    df = spark.createDataFrame([(i, "w w", "big") for i in range(2000)] + [(-1, "w", "tiny")], "doc_id long, text string, source string")
    rates = {r["source"]: r["rate"] for r in mixing.rates(df, {"big": 1e-8, "tiny": 1.0}).collect()}
    assert rates["big"] == pytest.approx(4001 * 1e-8 / (1 + 1e-8) / 4000) and rates["big"] > 0
    with pytest.raises(ValueError, match="source"):
        mixing.mix(df, rate="Source")
    with pytest.raises(ValueError):
        mixing.mix(df, copy="n", rate="N")


def test_mixing_of_awkward_rows(spark):
    df = awkward(spark)
    out = mixing.mix(df)
    assert out.columns == df.columns and mixing.mix(empty(df)).count() == 0
    rates = {r["source"]: r["rate"] for r in mixing.rates(df).collect()}
    assert rates[None] == 0.0 and all(r["source"] is not None for r in out.collect())
    again = [plain(mixing.mix(df).select("doc_id", "source", "text").collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_slices_of_nulls_and_long_rows():
    a = pa.array(["ab", None, "", "x" * 100, "é"])
    got = [(i, j, bytes(d), list(o)) for i, j, d, o in slices(a, 10)]
    assert [(i, j) for i, j, _, _ in got] == [(0, 3), (3, 4), (4, 5)] and got[0][2:] == (b"ab", [0, 2, 2, 2])
