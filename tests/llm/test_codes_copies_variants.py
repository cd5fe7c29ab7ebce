"""Product codes, exact duplicates and spelling variants against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavegrid.llm import exactdedup, variants, vectorcodes

LABELLED = "vec_id long, embedding array<double>, label int, id string, vector string, code string, key string"


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# product codes


def brute_codes(rows, entries):
    whole = lambda x: int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x)
    rows = [(i, [whole(x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(first[0][1]) // 16
    cut = lambda v, p: v[p * width : (p + 1) * width]
    same = [r for r in rows if len(r[1]) == len(first[0][1])]
    start = [r for r in first if len(r[1]) == len(first[0][1])][:entries]
    books = [[cut(r[1], p) for r in start] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(2):
        books = [
            [[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := [cut(r[1], p) for r in same if near(r[1], p)[1] == e]) else c for e, c in enumerate(books[p])]
            for p in range(16)
        ]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, labels = [], defaultdict(int)
    for i, v, g in rows:
        if len(v) != len(first[0][1]):
            out.append((i, None, None, g))
            continue
        found = [near(v, p) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), g))
        labels[g] += out[-1][2]
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    over = {g for _, c, d, g in out if c and d >= 1 << 63}
    return sorted(((i, c, fits(d), None if g in over else fits(labels[g]), sha) for i, c, d, g in out), key=str)


def coded(spark, rows, entries):
    df = spark.createDataFrame([(i, v, g, "clash", "clash", "clash", "clash") for i, v, g in rows], LABELLED).repartition(3)
    return sorted((tuple(r) for r in vectorcodes.encode(df, entries=entries).collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e200])
def test_codes_match_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    vectors = (rng.integers(-3, 4, (60, 32)) * scale / 7).tolist()
    rows = [(i, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(7, vectors[7], 1), (7, vectors[8], 1), (None, vectors[3], 2), (90, None, 1), (91, [], 1), (92, [None] + vectors[0][1:], 1), (93, [float("nan")] + vectors[0][1:], 1), (94, [float("inf")] + vectors[0][1:], None)]
    assert coded(spark, rows, 8) == brute_codes(rows, 8)


def test_codes_of_few_vectors_and_other_lengths(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 16, None), (3, [1.0] * 32, 1), (4, [-0.001] * 16, None)]
    got = coded(spark, rows, 64)
    assert got == brute_codes(rows, 64) and (3, None, None, 0, got[0][4]) in got
    assert vectorcodes.encode(spark.createDataFrame([], LABELLED)).collect() == []
    with pytest.raises(ValueError):
        vectorcodes.encode(spark.createDataFrame([(1, [1.0] * 17, 1, "", "", "", "")], LABELLED))


def test_bounds_hold_and_leave_entries_out():
    rng = np.random.default_rng(4)
    entries, parts = rng.integers(-200, 200, (64, 4)), rng.integers(-300, 300, (500, 4))
    book = vectorcodes.Codebook(entries)
    exact = ((parts[:, None] - entries) ** 2).sum(axis=2)
    least, most = book.bounds(parts)
    assert (least <= exact).all() and (exact <= most).all()
    assert (least <= most.min(axis=1)[:, None]).mean() < 0.3
    entry, found = book.nearest(parts)
    assert (entry == exact.argmin(axis=1)).all() and (found == exact.min(axis=1)).all()


# exact duplicates

TEXTS = "doc_id long, text string, id string, digest string, run string, sha string"


def brute_copies(rows):
    lower = {t: small(t) for _, t in rows}
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower[t]].append(i)
    out = []
    for i, t in rows:
        own = groups[lower[t]]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower[t].encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan_in", [2, 4])
def test_copies_match_brute_force(spark, fan_in):
    rng = np.random.default_rng(5)
    texts = [None, "", "Ärger ABC", "ärger abc", "ÄRGER abc", "x" * 50_000, "X" * 50_000, " a", "a", "a\n", "É", "é", "\x00", "İ", "K", "k", "K"]
    rows = [(i, texts[int(k)]) for i, k in enumerate(rng.integers(0, len(texts), 200))] + [(i, "HOT" if i % 2 else "hot") for i in range(400, 700)]
    rows += [(None, "only null"), (None, "ONLY null"), (None, "a"), (5, "a"), (5, "a"), (None, None)]
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], TEXTS).repartition(16)
    want = brute_copies(rows)
    assert sorted((tuple(r) for r in exactdedup.exact_duplicates(df, fan_in=fan_in).collect()), key=str) == want
    kept = exactdedup.without_copies(df)
    stays = {(i, s) for i, _, _, k, s in want if k}
    sha = {t: hashlib.sha256(small(t).encode()).hexdigest() for _, t in rows}
    assert kept.columns == df.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if (i, sha[t]) in stays)
    assert exactdedup.exact_duplicates(df.limit(0)).collect() == [] and exactdedup.without_copies(df.limit(0)).collect() == []


def test_copies_use_no_python_worker(spark):
    plan = exactdedup.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    run = spark.range(3).selectExpr("int(id) run", "id * 7 digest", "unhex(hex(id)) sha", "int(id) bytes", "id", "1L n")
    plan = exactdedup.merge_runs(run, 2)._jdf.queryExecution().executedPlan().toString()
    # merged on the order that is there: no hash tables, and one exchange and one sort a round
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2


# spelling variants


def brute_words(rows, least=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = small(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= least}


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least=3):
    n = brute_words(rows, least)
    near = {w: [v for v in n if are_near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found_variants(spark, rows, least=3):
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, word string, n string, id string").repartition(4)
    return sorted(tuple(r) for r in variants.spelling_variants(df, least=least).collect())


def test_variants_match_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abÀ"), rng.integers(4, 8))) for _ in range(120)] + ["Straße", "STRAßE", "straÿe", "aaaaa", "aaaaaa", "aaaaaaa", "ababa", "babab", "naïve", "NAÏVE", "x×÷y÷"]
    share = rng.zipf(1.4, len(words)).astype(float)
    rows = [(i, ", ".join(rng.choice(words, 200, p=share / share.sum()))) for i in range(40)]
    rows += [(None, "alpha alpha ALPHA alpho"), (None, None), (3, ""), (4, "一一一一一 ſſſſſ ’"), (5, "q" * 3000 + " " + "q" * 3001), (5, "q" * 3000 + " " + "q" * 3001), (5, "q" * 3000 + " " + "q" * 2999 + "z")]
    want = brute_variants(rows)
    assert found_variants(spark, rows) == want
    assert any(r[1] for r in want) and max(r[4] for r in want) > 5
    assert found_variants(spark, [(1, None), (2, "a b")]) == []
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chains_of_forms_end_at_the_last(spark):
    chain = ["aaaaaaaaaa"[: 10 - k] + "b" * k for k in range(10)]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(2**k)))]
    got = {r[0]: r for r in found_variants(spark, rows, least=1)}
    assert got == {r[0]: r for r in brute_variants(rows, least=1)} and got[chain[0]][2] == chain[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=8), min_size=2, max_size=12, unique=True))
def test_words_share_one_key_exactly_if_near(words):
    key, kind, _, word = variants.deletion_keys(words)
    met = Counter()
    by = defaultdict(list)
    for k, c, w in zip(key.tolist(), kind.tolist(), word.tolist(), strict=True):
        by[k].append((c, w))
    for own in by.values():
        for i, (c, a) in enumerate(own):
            for d, b in own[i + 1 :]:
                if (c, d) == (variants.REPLACED,) * 2 or {c, d} == {variants.LONGER, variants.OWN}:
                    met[frozenset((words[a], words[b]))] += 1
    assert met == Counter({frozenset((a, b)): 1 for a in words for b in words if a < b and are_near(a, b)})
