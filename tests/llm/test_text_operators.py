"""Text operators against plain Python, and their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from wavegrid.llm import bitsliced, buckets, credentials, decontaminate, language, licenses, linededup, packing, scan, toxicity, urlfilter

ODD = [None, "", " \n\t ", "x", "é" * 9000, "word " * 20_000, "\x00\x1f\u2028 ½ ÿ"]
SCHEMA = "doc_id long, text string, lang string, _text string, row string, id string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(None if i == 1 else i, t, "en", "clash", "clash", "clash") for i, t in enumerate(texts, first)], SCHEMA)


def words_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def brute_contamination(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        wins = {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else set()
        for w in wins:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [32 << 20, 60])
def test_contamination_matches_brute_force(spark, limit):
    passage = " ".join(f"W{i}" for i in range(30))
    items = [(1, passage), (2, "kurz und gut"), (10, None), (11, "..."), (12, passage.replace("W7", "é7"))]
    texts = [*ODD, "a " + passage.lower() + " b", "x w3, w4-w5 W6 w7 w8 w9 w10 w11 w12 y", "Kurz!und;GUT kurz und gut", "kurz und gutes", passage[:40], "a\u00a0b " + " ".join(f"w{i}" for i in range(5, 16))]
    df = frame(spark, texts)
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    for r, t in zip(sorted(got, key=lambda r: (r.id is None, r.id)), [t for i, t in enumerate(texts) if i != 1] + [texts[1]], strict=True):
        assert (r.n_words, r.n_hit, r.items) == brute_contamination(t, items)
    kept = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert {r.text for r in kept.collect()} == {t for t in texts if not brute_contamination(t, items)[1]}
    assert decontaminate.decontaminate(df.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_spans_map_words_to_the_original():
    text = "Ä b, W1-w2 ü".encode()
    assert [text.decode()[a:b] for a, b in decontaminate.spans(text, [(1, 2), (4, 4)])] == ["b, W1", "ü"]


def brute_spans(text):
    assign = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(assign + access + hexes)


def test_secrets_match_brute_force(spark):
    key = "Zx9" + "aB3" * 8
    texts = [*ODD, "é token = 'abcdef12' PASSWORD:xyz api_key=12345 ſecret=abcdefgh", "password=token :abcdefgh", "AKIA" + "B" * 16 + " AKIAAKIA" + "0" * 20, "deadbeef" * 5 + "G", f"user=bob key {key}", f"{key} alone", f"user=bob\n\n{key}", f"https://h.example/x then {key}"]
    got = sorted(credentials.find_secrets(frame(spark, texts)).collect(), key=lambda r: (r.id is None, r.id))
    for r, t in zip(got, [t for i, t in enumerate(texts) if i != 1] + [texts[1]], strict=True):
        base = brute_spans(t or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        label = ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(label.encode()).hexdigest()
        assert set(filter(None, label.split(","))) <= set(r.spans.split(","))
    by = {t: r for r, t in zip(got, [t for i, t in enumerate(texts) if i != 1], strict=False)}
    assert "identifier" in by[f"user=bob key {key}"].spans and "key" in by[f"user=bob key {key}"].spans
    assert by[f"{key} alone"].spans == "" and by[f"user=bob\n\n{key}"].spans == ""
    assert "endpoint" in by[f"https://h.example/x then {key}"].spans


def test_long_secrets_are_whole(spark):
    keys = [("Zx9" + "aB3" * 400)[:n] for n in (64, 86, 1000)]
    keys[1] += "=="
    texts = [f"user=bob key {k} end" for k in keys] + [f"https://h.example/{'x' * 300} {keys[0]}", f"login={'u' * 90} {keys[0]}"]
    got = [r.spans.split(",") for r in sorted(credentials.find_secrets(frame(spark, texts, 2)).collect(), key=lambda r: r.id)]
    assert [g for g in got[:3]] == [["identifier:5:8", f"key:13:{13 + len(k)}"] for k in keys]
    assert got[3] == ["endpoint:0:318", "key:319:383"] and got[4] == ["identifier:6:96", "key:97:161"]


def test_packing_is_an_exact_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [*ODD, "It's Él Niño, co\u0301mo\u00a0estás?! <|endoftext|> A<|endoftext|>.", "Der. der, DER; x.y 'tis 12,5\tKelvin \u212a.", *(f"some {i} words of text. " * (i % 60) for i in range(150))]
    rows = packing.pack(frame(spark, texts).repartition(3), path, size=256, with_ids=True).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.id].append((r.start, bytes(r.ids)))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(x for _, x in sorted(pieces[None if i == 1 else i])), "<u4").tolist() == want
    padding = 0
    for own in windows.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.03 * sum(r.length for r in rows)


def test_best_fit_takes_the_tightest_window():
    placed, left = packing.best_fit_decreasing([6, 5, 4, 5, 4], 10)
    assert sorted(left) == [0, 0, 6] and placed[0] == placed[2] and placed[1] == placed[3]


def test_language_is_held_out_and_accurate(spark):
    said = {"en": "the quick brown fox jumps over the lazy dog and runs", "de": "der schnelle braune fuchs springt über den faulen hund", "es": "el rápido zorro marrón salta sobre el perro perezoso"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(said[lang].split(), 12)), lang) for i in range(300) for lang in [list(said)[i % 3]]]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 !", "en"), (None, "der hund", None), (1002, "", "de")], "doc_id long, text string, lang string")
    got = {r.id: r for r in language.identify(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[None].lang_pred == "de"
    assert language.identify(df.limit(0)).count() == 0


def test_toxicity_learns_pairs_and_survives_odd_tables(spark):
    rng = np.random.default_rng(2)
    plain = [f"plain{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(800):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        texts.append(" ".join([*rng.choice(plain, 12), *(["zinsult"] if insult else []), *(["qgroup"] if group else [])]))
        labels.append((i, int(insult and group)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.id: r for r in toxicity.score_documents(df, marks).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert toxicity.score_documents(frame(spark, ODD), marks.limit(0)).count() == len(ODD)
    assert toxicity.reject_toxic(frame(spark, ODD), marks.limit(0)).columns == frame(spark, ODD).columns
    assert toxicity.reject_toxic(frame(spark, ODD), marks.limit(0)).count() == len(ODD)


def test_lines_keep_one_of_each_group(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [f"{long}\nunique one\n---", None, f"other start here\n{long.upper()}!\n---\nunique one", f"{long}\n{long}", "Total: 15 items\nTotal: 7 items", "", "x" * 50_000]
    df = frame(spark, texts)
    out = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert out[0] == texts[0] and out[None] is None and out[2] == "other start here\n---" and out[3] == "" and out[4] == "Total: 15 items" and out[5] == "" and out[6] == texts[6]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_distances_and_fuzzy_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (list(rng.integers(0, 4, rng.integers(0, 30))) for _ in range(2))
        d = brute_distance(a, b)
        assert linededup.distance(a, b, 40) == d and linededup.distance(a, b, d) == d and linededup.distance(a, b, d - 1 if d else 0) == d
    vocabulary = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    lines = [" ".join(rng.choice(vocabulary, 60)) for _ in range(15)]
    for k in range(45):
        words = lines[rng.integers(0, len(lines))].split()
        words[rng.integers(0, 60)] = vocabulary[rng.integers(0, 20)]
        lines.append(" ".join(words))
    lines = list(dict.fromkeys(lines))
    fps = linededup.simhashes([x.encode().split() for x in lines]).view(np.uint64)
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 3 and brute_distance(lines[i].split(), lines[j].split()) <= 12:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(lines))] == [x if root(i) == i else "" for i, x in enumerate(lines)]


def test_grams_find_the_pairs_that_bits_lose(spark):
    rng = np.random.default_rng(8)
    lines, pairs = [], []
    for i in range(600):
        n = [5, 6, 10, 20, 32, 45, 100, 300][i % 8]
        words = [f"w{'abcdefghij'[c // 1000]}{'abcdefghij'[c // 100 % 10]}{'abcdefghij'[c // 10 % 10]}{'abcdefghij'[c % 10]}" for c in rng.integers(0, 10_000, n)]
        other = list(words)
        for at in rng.choice(n, n // 5, replace=False):
            other[at] = f"q{'abcdefghij'[rng.integers(10)]}{'abcdefghij'[rng.integers(10)]}"
        assert linededup.alike(words, other, 0.8)
        pairs.append((len(lines), n))
        lines += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, grams=True).collect()}
    assert all(got[i] for i, _ in pairs)
    found = defaultdict(list)
    for i, n in pairs:
        found[n].append(not got[i + 1])
    assert all(all(found[n]) for n in (5, 6, 10)) and np.mean([x for own in found.values() for x in own]) >= 0.97, {n: np.mean(x) for n, x in found.items()}
    bits = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert np.mean([not bits[i + 1] for i, _ in pairs]) < 0.2


def test_many_lines_of_one_fingerprint_are_cut(spark):
    n = 20_000
    keyed = spark.range(n).selectExpr("7L AS bucket", "5L AS fp", "id AS node")
    sizes = [r["count"] for r in buckets.spread(keyed, "node").groupBy("bucket").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3 * buckets.CHUNK
    lines = [f"{i} {i + 1} {i + 2} {i + 3} {i + 4} name{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), grams=True).collect()
    assert {r.doc_id for r in out if r.text} == {0}


def test_packed_members_meet_as_single_ones_do(spark):
    rows = spark.range(3000).selectExpr("array(id % 700, 10000 + id % 2, 20000 + id) AS buckets", "xxhash64(id % 5) AS fp", "CAST(5 + id % 3 AS INT) AS table", "id AS node")
    keyed = rows.select(F.explode("buckets").alias("bucket"), "fp", "table", "node")
    want = {frozenset((a, b)) for k, n in ((700, 3000), (2, 3000)) for a in range(n) for b in range(a + k, n, k)}

    def met(df, cut):
        def pairs(batches):
            for columns in cut(batches):
                bucket, node = columns[0].to_numpy(), columns[3].to_numpy()
                at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                for i, j in zip(at[:-1], at[1:], strict=True):
                    yield linededup.pa.RecordBatch.from_pydict({"nodes": [node[i:j].tolist()]})

        return [r.nodes for r in df.mapInArrow(pairs, "nodes array<long>").collect() if len(r.nodes) > 1]

    with pytest.MonkeyPatch.context() as m:
        for chunk in (4096, 256):
            m.setattr(buckets, "CHUNK", chunk)
            m.setattr(buckets, "SAMPLED", 4)
            packed = buckets.spread_packed(rows, 3)
            assert packed.count() < 200
            one, many = met(buckets.spread(keyed, "table", "node"), linededup.partial(buckets.groups, columns=4)), met(packed, buckets.packed_groups)
            for found in (one, many):
                assert {frozenset((a, b)) for own in found for a in own for b in own if a < b} == want
                assert max(map(len, found)) < 3 * chunk
            assert met(buckets.spread_packed(rows.limit(0), 3), buckets.packed_groups) == []
        m.setattr(buckets, "MOST_LARGE", 1)
        assert buckets.spread_packed(rows, 3) is None


def test_links_of_buckets_of_any_size_match_brute_force(spark):
    rng = np.random.default_rng(21)
    lines, bucket = [], []
    for k, n in enumerate([2, 3, 16, 17, 40, 300, 1]):
        seeds = [rng.integers(0, 60, rng.integers(5, 40)).tolist() for _ in range(6)]
        for _ in range(n):
            line = list(seeds[rng.integers(6)])
            for _ in range(rng.integers(0, 1 + len(line) // 4)):
                at = int(rng.integers(len(line)))
                line[at : at + int(rng.integers(2))] = rng.integers(0, 60, rng.integers(2)).tolist()
            lines.append((line * 8 if rng.random() < 0.1 else line) or [1])
            bucket.append(k)
    texts = linededup.pa.array([" ".join(f"w{x}" for x in line).encode() for line in lines], linededup.pa.binary())
    numbered, (u, v) = linededup.Numbered(linededup.pa.chunked_array([texts[:100], texts[100:]]), 0.8), np.triu_indices(120, 1)
    right = np.array([linededup.alike(lines[a], lines[b], 0.8) for a, b in zip(u, v, strict=True)])
    assert not (right & ~numbered.may(u, v)).any() and not (numbered.sure(u, v) & ~right).any() and numbered.sure(u, v).any()
    ones = np.full(len(lines), 20, np.int32)
    ids = np.arange(len(lines)) + 1000
    batch = linededup.pa.RecordBatch.from_arrays([linededup.pa.array(x) for x in (np.array(bucket), np.zeros(len(lines), np.int64), ones, ids)] + [texts], ["bucket", "fp", "table", "node", "norm"])

    def trees(pairs):
        tree = {int(i): int(i) for i in ids}
        for a, b in pairs:
            a, b = sorted((tree[a], tree[b]))
            tree = {i: a if t == b else t for i, t in tree.items()} if a != b else tree
        return tree

    links = [(x["a"], x["b"]) for out in linededup._verified(iter([batch]), linededup.Grams(0.8), 0.8) for x in out.to_pylist()]
    want = [(int(ids[i]), int(ids[j])) for i in range(len(lines)) for j in range(i) if bucket[i] == bucket[j] and linededup.alike(lines[i], lines[j], 0.8)]
    assert trees(links) == trees(want) and len(set(trees(want).values())) > 20


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(0, 0.2, 16).tolist() for _ in range(400)]
    vectors[7], vectors[9], vectors[11], vectors[13] = None, [None, 1.0], [float("nan")] * 16, [float("inf")] * 16
    vectors[21] = vectors[20]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)] + [(None, vectors[0], "")], "vec_id long, embedding array<double>, q string")
    got = defaultdict(list)
    for r in bitsliced.top_k(df, every=20, block=97, queries=7).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    ok = {i: np.floor(256 * np.array(v)).astype(int) for i, v in enumerate(vectors) if i not in (7, 9, 11, 13)}
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert bitsliced.top_k(df.limit(0)).collect() == []


def test_top_k_with_a_query_id_of_many_rows(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(0, 0.2, (1000, 16))
    rows = [(0 if i < 12 else i, (v if i else vectors[1]).tolist()) for i, v in enumerate(vectors)]
    rows += [(0, vectors[1].tolist())] * 20
    df = spark.createDataFrame([(i, v) for i, v in rows if i == 0 or i % 20], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.id, r.score) for r in bitsliced.top_k(df.where("vec_id > 0 OR embedding[0] = %r" % vectors[1][0].item()), every=20).collect())
    q = np.floor(256 * vectors[1]).astype(int)
    best = sorted((-int(q @ np.floor(256 * np.array(v)).astype(int)), i) for i, v in rows if i % 20)[:5]
    assert got == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_url_rules_and_words(spark):
    urls = ["http://A.net/x", "https://b.example.net/en/1?q#f", "x://example.com/de/1", "x://www.example.com/de", "y://q.org/fr/", "y://org.example.com/fr/", None, "no scheme", "://", "h://casinowinbets.example.com/a", "h://goodnews.example.com/a", "http://net"]
    df = spark.createDataFrame([(i, u, "<p>casino bets good news good news win</p>" * 5, "") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.id: r for r in urlfilter.judge(df).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, None]
    assert [got[i].verdict for i in (0, 1, 2, 4)] == ["block", "allow", "block", "allow"]
    assert (got[0].host, got[0].path, got[6].host, got[7].path, got[8].host) == ("a.net", "/x", "", "", "")
    assert got[9].verdict == "block" and "casino" in got[9].host_words.split() and got[10].host_words.split()[:2] == ["good", "news"]


def test_url_words_come_from_text_and_not_from_whole_labels(spark):
    urls = ["http://cheapcasino.com/a"] * 9 + ["http://" + "goodnews" * 40 + ".com/"] + [f"http://h.com/p{'abcdefghij'[i]}" for i in range(9)]
    df = spark.createDataFrame([(i, u, "<p>cheap casino good news</p>" * (4 if i < 3 else 1)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.id: r.host_words for r in urlfilter.judge(df).collect()}
    assert got[0] == "cheap casino" and got[9] == " ".join(["good", "news"] * 40)


def test_url_tables_of_any_size_judge_alike(spark):
    letters = "abcdefghij"
    urls = [f"http://{letters[i // 10]}{host}/{letters[i % 10]}xx" for i in range(100) for host in ("casino.net", "news.q.org/fr", "wordless--9.com", ".x.com/de")] + ["http://q.org/fr/zzxx"] * 5
    urls += [None, "", "no scheme", "://", "h://" + "longcasino" * 30 + ".com/a/b/c", "H://Ünder.example.com/é/É"]
    df = spark.createDataFrame([(i, u, "<p>casino news long under</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    whole, cut = ({r.id: r for r in urlfilter.judge(df, limit=n).collect()} for n in (1 << 20, 100))
    assert whole.keys() == cut.keys() and len(whole) == len(urls)
    for i, r in whole.items():
        assert r[:6] == cut[i][:6] and abs(r.log_odds - cut[i].log_odds) < 1e-9
    assert urlfilter.judge(df.limit(0)).collect() == [] and urlfilter.judge(df.limit(0), limit=0).collect() == []


def test_pages_without_rules_are_not_judged_by_what_rules_look_at(spark):
    rng = np.random.default_rng(22)
    bad, good = ["pills", "poker", "zwin", "zrich"], ["garden", "school", "river", "music", "stone"]
    rows = []
    for i in range(1200):
        label, tld = i % 3 == 0, str(rng.choice(["net", "com", "org"]))
        host = "".join(rng.choice(bad if label else good, 2))
        rows.append((i, f"http://{rng.choice(['www.', 'm.', ''])}{host}.example.{tld}/{rng.choice(['en', 'de', 'fr', 'es'])}/{i}.html", " ".join(bad + good), label))
    # rules block bad hosts more often: elsewhere /en/ and /fr/ say nothing
    rows = [r for r in rows if not (".net" in r[1] and not r[3] and "/en/" not in r[1] and rng.random() < 0.97) and not (r[3] and (".org/fr/" in r[1] or ".net/en/" in r[1]) and rng.random() < 0.97)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.id: r for r in urlfilter.judge(df).collect()}
    said = [(r[3], got[r[0]].verdict == "block") for r in rows if not got[r[0]]["rule"]]
    hit, false, missed = sum(a and b for a, b in said), sum(b and not a for a, b in said), sum(a and not b for a, b in said)
    assert hit / (hit + false) > 0.95 and hit / (hit + missed) > 0.95
    for tongue in ("en", "de", "fr", "es"):
        clean = [got[r[0]].verdict for r in rows if not r[3] and not got[r[0]]["rule"] and f"/{tongue}/" in r[1]]
        assert len(clean) < 5 or clean.count("block") < 0.1 * len(clean)


def test_url_verdicts_match_plain_naive_bayes(spark):
    rng = np.random.default_rng(14)
    bad, good = ["slots", "pills", "zloan", "quickwin"], ["garden", "school", "river", "zmusic"]
    rows = []
    for i in range(600):
        kind, words = i % 3, [str(w) for w in rng.choice(bad if rng.random() < 0.5 else good, 2)]
        host, path = "".join(words), f"/{rng.choice(bad if words[0] in bad else good)}"
        if kind < 2:
            rows.append((i, f"http://{host}.net{path}" if words[0] in bad else f"http://{host}.org/fr{path}"))
        else:
            rows.append((i, f"http://{host}.info{path}"))
    df = spark.createDataFrame([(i, u, " ".join(bad + good)) for i, u in rows], "page_id long, url string, html string")
    got = {r.id: r for r in urlfilter.judge(df, fold=0).collect()}
    counts = {True: defaultdict(int), False: defaultdict(int)}
    pages = {True: 0, False: 0}
    for i, _ in rows:
        if got[i]["rule"]:
            block = got[i]["rule"] == "net/"
            pages[block] += 1
            for t in [f"h:{w}" for w in got[i].host_words.split()] + [f"p:{w}" for w in re.findall("[a-z]+", got[i].path.removeprefix("/fr/"))]:
                counts[block][t] += 1
    kinds = set(counts[True]) | set(counts[False])
    size = {b: sum(counts[b].values()) + len(kinds) + 1 for b in counts}
    right = 0
    for i, _ in rows:
        if not got[i]["rule"]:
            words = [f"h:{w}" for w in got[i].host_words.split()] + [f"p:{w}" for w in re.findall("[a-z]+", got[i].path)]
            odds = np.log((pages[True] + 1) / (pages[False] + 1))
            for t in words:
                if t in kinds or t[2:] in urlfilter.SEEDS:
                    odds += np.log((counts[True][t] + 1 + urlfilter.SEED_PAGES * (t[2:] in urlfilter.SEEDS)) / size[True]) - np.log((counts[False][t] + 1) / size[False])
            assert abs(odds - got[i].log_odds) < 1e-9 and got[i].verdict == ("block" if odds > 0 else "allow")
            right += (got[i].verdict == "block") == (got[i].host_words.split()[0] in bad)
    assert right >= 195


def brute_split(run, cost, unknown):
    best = {"": (0.0, [])}
    for end in range(1, len(run) + 1):
        best[run[:end]] = min((best[run[:s]][0] + cost.get(run[s:end], unknown + 3.0 * (end - s)), best[run[:s]][1] + [run[s:end]]) for s in range(max(0, end - urlfilter.LONGEST), end))
    return best[run]


def test_segmentation_matches_brute_force():
    rng = np.random.default_rng(15)
    segmenter = urlfilter.Segmenter({w: int(n) for w, n in zip(["a", "ab", "abc", "b", "bca", "cab", "ca"], rng.integers(1, 50, 7), strict=True)})
    for _ in range(100):
        run = "".join(rng.choice(list("abc"), rng.integers(1, 30)))
        words = segmenter.split(run)
        assert "".join(words) == run
        cost = sum(segmenter.cost.get(w, segmenter.unknown + 3.0 * len(w)) for w in words)
        assert abs(cost - brute_split(run, segmenter.cost, segmenter.unknown)[0]) < 1e-9
    assert segmenter.split("abc" * 500) != ["abc" * 500]


def test_licenses_match_exact_containment(spark):
    mit = dict(licenses.TEMPLATES)["MIT-grant"]
    filler = " ".join(f"word{i}" for i in range(300))
    texts = [*ODD, f"{filler} {mit} {filler}", f"{filler} all RIGHTS reserved {filler}", f"{filler} Licensed under CC BY-NC 4.0. {filler}", f"{filler} the software is licensed to us", mit[: len(mit) // 2], f"{filler}\n{mit.replace('person', 'soul')}", "All rights, reserved"]
    got = sorted(licenses.find_licenses(frame(spark, texts)).collect(), key=lambda r: (r.id is None, r.id))
    for r, t in zip(got, [t for i, t in enumerate(texts) if i != 1] + [texts[1]], strict=True):
        words, want = licenses._plain_words(t or ""), set()
        for name, body in licenses.TEMPLATES:
            own = licenses._plain_words(body)
            k = min(5, len(own))
            shingles = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
            most = max((len(shingles & {tuple(words[i : i + k]) for i in range(s, s + 2 * len(own))}) for s in range(max(1, len(words)))), default=0)
            if most >= 0.8 * len(shingles):
                want.add(name)
        assert {m.name for m in r.matches} == want


def test_line_table_cuts_as_normalised_lines():
    rng = np.random.default_rng(6)
    texts = [(t or "").encode() for t in ODD] + [b"", b"A1b22 00c\n\n7 7\r\nx", b"x" * (linededup.PIECE + 9) + b" y\ny " + b"x" * (linededup.PIECE + 9)]
    texts += ["\n".join(" ".join(rng.choice(["a", "B", "12", "é,", "--"], rng.integers(0, 6))) for _ in range(rng.integers(1, 9))).encode() for _ in range(200)]
    texts.append(b" ".join(b"w%d" % i for i in rng.permutation(40_000)))
    got = list(zip(*(x.tolist() for x in linededup.line_table(texts)), strict=True))
    want = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(linededup.normalised_lines(t)) if line]
    assert [g[:3] for g in got] == [(i, n, len(line)) for i, n, line in want]
    assert len({(g[3:5], b" ".join(w[2])) for g, w in zip(got, want, strict=True)}) == len({g[3:5] for g in got}) == len({b" ".join(w[2]) for w in want})
    assert [g[5] for g in got] == linededup.simhashes([w[2] for w in want]).tolist()
    assert linededup.line_table([])[0].tolist() == linededup.line_table([b"", b" - "])[0].tolist() == []


def test_lines_that_a_polynomial_confuses_both_stay(spark):
    order = [bin(i).count("1") % 2 for i in range(2048)]
    lines = [" ".join("ab"[x ^ flip] for x in order) for flip in (0, 1)] + ["".join("ab"[x ^ flip] for x in order) for flip in (0, 1)]
    assert len({k[3:5] for k in zip(*(x.tolist() for x in linededup.line_table([x.encode() for x in lines])), strict=True)}) == 4
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for grams, similar in ((True, brute_distance(lines[0].split(), lines[1].split()) <= 0.2 * 2048), (False, None)):
        removed = [r.n_removed for r in sorted(linededup.line_report(df, grams=grams).collect(), key=lambda r: r.id)]
        assert removed[2:] == [0, 0] and (similar is None or removed[:2] == [0, int(similar)])


def test_a_line_of_very_many_rows_is_joined_where_it_is(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, id, 7L) AS k", "id AS x", "'a' AS n")
    table = spark.range(3000).selectExpr("id AS k", "IF(id = 7, 2000L, 1L) AS c", "id * 2 AS y")
    want = sorted(rows.join(table, "k").select("k", "x", "y").collect())
    assert sorted(scan.hot_join(rows, table, ["k"], "c").select("k", "x", "y").collect()) == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scan, "SMALL_BYTES", 100)
        assert sorted(scan.hot_join(rows, table, ["k"], "c", 500).select("k", "x", "y").collect()) == want
        assert sorted(scan.hot_join(rows, table, ["k"], "c").select("k", "x", "y").collect()) == want


def test_aligned_never_is_under_the_distance():
    rng = np.random.default_rng(12)
    for _ in range(500):
        a, b = (rng.integers(0, 4, rng.integers(0, 25)).tolist() for _ in range(2))
        assert linededup.aligned(a, b, 99) >= brute_distance(a, b)
        s = float(rng.uniform(0.3, 1))
        assert linededup.alike(a, b, s) == (brute_distance(a, b) <= int((1 - s) * max(len(a), len(b)) + 1e-9))


def padding_of(rows, size):
    windows = defaultdict(list)
    for w, _, _, n, at in rows:
        windows[w].append((at, n))
    lost = 0
    for own in windows.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= size
        lost += 0 if end & (end - 1) == 0 else size - end
    return lost


@pytest.mark.parametrize(("low", "high", "whole"), [(1, 4096, 0.95), (2100, 4000, 0.7), (4000, 4090, 0.97), (1, 40, 0.99)])
def test_pieces_are_cut_only_to_fill_windows(low, high, whole):
    rng = np.random.default_rng(low)
    pieces = [(i, int(n)) for i, n in enumerate(rng.integers(low, high, 2000))]
    rows, total = list(packing.arrange(pieces, 4096)), sum(n for _, n in pieces)
    got = defaultdict(list)
    for _, (i, _), start, n, _ in rows:
        got[i].append((start, n))
    for i, n in pieces:
        at = 0
        for start, length in sorted(got[i]):
            assert start == at
            at += length
        assert at == n
    assert padding_of(rows, 4096) <= 0.02 * total and sum(len(x) == 1 for x in got.values()) >= whole * len(pieces)
    assert list(packing.arrange([], 4096)) == []


def test_best_fit_decreasing_matches_brute_force():
    rng = np.random.default_rng(13)
    for _ in range(50):
        lengths = rng.integers(1, 60, rng.integers(0, 80)).tolist()
        left = []
        for n in sorted(lengths, reverse=True):
            rooms = [r for r in left if r >= n]
            if rooms:
                left[left.index(min(rooms))] -= n
            else:
                left.append(60 - n)
        assert sorted(packing.best_fit_decreasing(lengths, 60)[1]) == sorted(left)


def test_packing_with_a_tokenizer_of_another_kind(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["It's  TWO spaces.\nAnd a line", "", None, "x"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, size=64, with_ids=True).collect()
    for i, t in enumerate(texts):
        own = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.id == i), key=lambda r: r.start))
        assert np.frombuffer(own, "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_toxicity_of_pairs_that_no_single_term_tells(spark):
    rng = np.random.default_rng(21)
    plain, texts, labels = [f"plain{i}" for i in range(200)], [], []
    for i in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([*rng.choice(plain, 12), *(["zinsult"] if insult else []), *(["qgroup"] if group else [])]))
        labels.append((i, int(insult != group)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.id: r for r in toxicity.score_documents(df, marks).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    y = np.array([x for i, x in labels if not got[i].held_out], float)
    rows = [toxicity.terms(t.encode()) for i, t in enumerate(texts) if not got[i].held_out]
    linear = toxicity.fit(y, rows, factors=0)
    right = [((linear.bias + linear.weight[np.isin(linear.index, toxicity.terms(texts[i].encode()))].sum()) > 0) == labels[i][1] for i in held]
    assert np.mean(right) < 0.8  # three of four cases at best
    repeated = df.union(df.limit(300)).union(spark.createDataFrame([(0, None), (None, "zinsult")], "doc_id long, text string"))
    assert toxicity.score_documents(repeated, marks.union(marks)).count() == 1502


def test_language_of_long_texts_is_that_of_all_their_ngrams(spark, monkeypatch):
    texts = ["ab\u00e9 \u3042\u3044 x, yz " * 50, "", "a", " 12 ", "\u3042" * 333, "a" + " " * 200 + "b"]
    whole = [language.ngrams(t.encode()).tolist() for t in texts]
    monkeypatch.setattr(language, "PIECE", 7)
    assert [language.ngrams(t.encode()).tolist() for t in texts] == whole
    rng = np.random.default_rng(1)
    table, norms = rng.normal(size=(language.LETTERS**3, 3)).astype(np.float32), np.ones(3)
    for t in texts:
        cut = language.cosines(t.encode(), table, norms, 64)
        monkeypatch.setattr(language, "PIECE", 1 << 20)
        one = language.cosines(t.encode(), table, norms, 64)
        monkeypatch.setattr(language, "PIECE", 7)
        assert (cut is None and one is None) or np.allclose(cut, one)


def test_language_matches_whole_vectors(spark):
    dims, said = 256, {"x": ["the cat sat on the mat", "a cat and a hat"], "y": ["der hund und die katze", "ein hund"]}
    vector = {n: language.gram_vectors(language.ngrams(" ".join(t).encode()) if False else np.array([g for s in t for g in language.ngrams(s.encode())]), dims).astype(float).sum(axis=0) for n, t in said.items()}
    length = {n: np.sqrt((np.unique([g for s in t for g in language.ngrams(s.encode())], return_counts=True)[1] ** 2).sum()) for n, t in said.items()}
    profile = {n: v / length[n] for n, v in vector.items()}
    mean = sum(profile.values()) / 2
    names, table, norms = language.learn(spark.createDataFrame([(s, n) for n, t in said.items() for s in t], "text string, lang string"), dimensions=dims)
    assert names == ["x", "y"]
    for text in ("the hat", "hund katze", "ab"):
        own = language.gram_vectors(language.ngrams(text.encode()), dims).astype(float).sum(axis=0)
        for i, n in enumerate(names):
            assert abs(table[language.ngrams(text.encode()), i].sum() - own @ (profile[n] - mean)) < 0.05 * dims and abs(norms[i] - np.linalg.norm(profile[n] - mean)) < 1e-3


def test_top_k_of_huge_components(spark):
    rng = np.random.default_rng(21)
    sets = [[[1e17, 1.0], [1.0, 0.0], [2.0, 0.0], [-1e300, 3.0], [1e300, 1.0], [1.7e308, 0.0], [-1.7e308, 0.0]], [[2.0**27 - 1, 3.0], [2.0**20 * 1.37, 1.0], [2.0**20 * 1.39, -1.0], [-(2.0**20) * 1.5, 0.5]]]
    sets.append((rng.integers(-9, 9, (12, 5)) * rng.choice([1.0, 1e9, 1e15], (12, 5)) / 3).tolist())
    for vectors in sets:
        exact = [[int(x) * 256 if abs(x) > 2**53 else int(np.floor(256 * x)) for x in v] for v in vectors]
        score = [sum(a * b for a, b in zip(exact[0], v, strict=True)) for v in exact]
        want = sorted(range(1, len(vectors)), key=lambda i: (-score[i], i))[:5]
        df = spark.createDataFrame([(i + 20, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = [(r.id - 20, r.score) for r in sorted(bitsliced.top_k(df, every=20, block=3).where("query_id = 20").collect(), key=lambda r: r["rank"])]
        assert got == [(i, score[i] if abs(score[i]) < 1 << 63 else None) for i in want]


def test_top_k_between_half_and_whole_longs(spark):
    rows = [(20, [98566.0]), (21, [1e9]), (22, [1.012766e9])]
    got = [(r.id, r.score) for r in sorted(bitsliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).collect(), key=lambda r: r["rank"])]
    assert got == [(22, 98566 * 256 * 1012766000 * 256), (21, 98566 * 256 * 10**9 * 256)] and all(1 << 62 < s < 1 << 63 for _, s in got)


def test_decontamination_of_null_ids_repeats_and_offsets(spark):
    passage = " ".join(f"w{i}" for i in range(24))
    items = [(None, passage), (4, "tiny item"), (4, "tiny item"), (5, "tiny item")]
    texts = ["Ä, " + passage.upper() + " é", "Tiny-ITEM tiny", "w0 w1 w2 w3 w4 w5 w6 w7 w8", None, "", "Tiny-ITEM tiny"]
    got = sorted(decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect(), key=lambda r: r.id)
    assert [(r.n_hit, r.n_items, r.items) for r in got] == [(24, 0, []), (2, 2, ["4", "5"]), (0, 0, []), (0, 0, []), (0, 0, []), (2, 2, ["4", "5"])]
    assert [texts[r.id][s.a : s.b] for r in got for s in r.spans] == [passage.upper(), "Tiny-ITEM", "Tiny-ITEM"]


def test_decontamination_of_many_overlaps_matches_brute_force(spark):
    rng = np.random.default_rng(17)
    items = [(i, " ".join(rng.choice(list("ab"), rng.integers(1, 40)))) for i in range(25)]
    texts = [" ".join(rng.choice(list("abc"), 80, p=[0.47, 0.47, 0.06])) for _ in range(30)]
    got = {r.id: r for r in decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i].items) == brute_contamination(t, items)


def test_links_of_secrets_match_a_plain_join():
    rng = np.random.default_rng(18)
    for _ in range(300):
        at, base, weak = 0, [], []
        for _ in range(rng.integers(0, 14)):
            at += int(rng.integers(0, 60))
            kind, n = int(rng.integers(0, 6)), int(rng.integers(1, 9))
            (base if kind < 3 else weak).append((at, kind, at + n))
            at += n
        bounds = [0, *sorted(int(x) for x in rng.integers(1, max(2, at), 2))]
        home = lambda s: sum(b <= s[0] for b in bounds)
        gap = lambda a, b: b[0] - a[2] if b[0] >= a[2] else a[0] - b[2]
        want = []
        for w in weak:
            near = [(gap(w, o), o) for o in base + weak if o[1] in credentials.COMPLEMENT[w[1]] and gap(w, o) >= 0 and gap(w, o) <= 50 and home(o) == home(w)]
            want += [(w, min(near)[0])] if near else []
        assert [(w, gap(w, o)) for w, o in credentials.linked(base, weak, bounds, 50)] == want
