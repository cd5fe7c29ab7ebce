import random

import pytest
import xxhash
from pyspark.sql import functions as F

from wavegrid.llm import buckets, simhash
from wavegrid.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, node string"


def brute_fingerprint(text):
    words, ascii_lower = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", ascii_lower):
        words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 60, 300]))]
        out.append(" ".join(words))
    return out


def test_components_match_brute_force(spark):
    docs = [*texts(250), "", None, " \t\n", "a b c", "A  b\nc", "x" * 50_000]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(docs)], SCHEMA)
    got = {r.id: (r.fp, r.component) for r in simhash.simhash_components(df).collect()}
    fps = [brute_fingerprint(t) for t in docs]
    assert [got[i][0] % (1 << 64) for i in range(len(docs))] == fps
    assert [got[i][1] for i in range(len(docs))] == brute_components(fps, 4)


def test_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "", ""), (7, "a b c d e f", "", ""), (7, "a b c d e f", "", ""), (None, "quite other words stand here now", "", "")], SCHEMA)
    got = sorted(((r.id, r.component) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]
    assert simhash.near_dedup(df).count() == 4
    assert simhash.simhash_components(df.limit(0)).collect() == []


def test_every_pair_within_the_radius_shares_a_mask():
    rng = random.Random(5)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not bits & m for m in masks)


@pytest.mark.parametrize("chunk", [8, 4096])
def test_large_buckets_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(buckets, "CHUNK", chunk)
    rng = random.Random(chunk)
    fps = list({sum(1 << b for b in rng.sample(range(12), rng.randrange(6))) for _ in range(300)})
    df = spark.createDataFrame([(1, f, i) for i, f in enumerate(fps)], "bucket long, fp long, node long")
    found = dict(connected_components(buckets.near_links(df, 1)).select("node", "component").collect())
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, 1)


def test_long_chains_are_one_component(spark):
    df = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = connected_components(df.union(spark.createDataFrame([(None, 3), (900, 900)], "a long, b long"))).collect()
    assert {r.component for r in got} == {0} and len(got) == 400


def test_hubs_and_repeated_links(spark):
    hub = [(i, 5_000) for i in range(0, 3_000, 3)] + [(1, i) for i in range(1, 3_000, 3)]
    links = spark.createDataFrame(hub * 2 + [(2, 5), (5, 2)], "a long, b long").repartition(7)
    got = dict(connected_components(links).select("node", "component").collect())
    assert got == {i: i % 3 for i in (*range(0, 3_000, 3), *range(1, 3_000, 3), 2, 5)} | {5_000: 0}
