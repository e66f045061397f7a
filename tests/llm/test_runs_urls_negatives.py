"""Periodic runs, url filters and hard negatives against brute force and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraselens.llm import hard_negatives, periodic, queries, url_filter
from tests.llm import helpers as H


# --- periodic runs ---------------------------------------------------------------------------------

def all_runs(words, least=6):
    """(start, length, period) by comparing every word with the one every possible period later."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            end = i
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            length = end + q - i if end > i else 0
            if length >= max(least, 4 * q) and all(any(words[x] != words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = end + 1 if end == i else end
    return sorted(found)


def collapsed(words, found):
    gone = {x for start, length, q in found for x in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def some_words(rng):
    kind, n = rng.randrange(4), rng.randrange(90)
    if kind < 2:
        return [f"w{rng.randrange(2 + kind)}" for _ in range(n)]
    out = []
    while len(out) < n:
        root = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.randrange(1, 22))]
        root *= rng.randrange(1, 4) if rng.random() < 0.5 else 1
        times = rng.randrange(1, 9)
        out += (root * times)[:len(root) * times - rng.randrange(len(root))]
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(11)
    texts = {i: rng.choice([" ", "\n", " \t "]).join(some_words(rng)) for i in range(300)}
    a, b = "x", "xy"
    for _ in range(9):
        a, b = b, b + a
    texts |= {400: " ".join(b), 401: " ".join(f"v{i}" for i in range(60)) + " " + "end " * 9, 402: "a b " * 5000 + "c"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = set()
    for r in periodic.find_runs(rows).collect():
        words = split(texts[r["doc_id"]])
        want = [(0, 10_000, 2)] if r["doc_id"] == 402 else all_runs(words)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want)
        seen |= {q for _, _, q in want}
    assert {1, 2, 3, 4, 5, 8} <= seen and max(seen) > 15


def test_runs_do_not_depend_on_neighbours_or_collisions(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(periodic, "mixed", lambda h: h % np.uint64(3))      # almost everything collides
    for _ in range(40):
        texts = [some_words(rng) for _ in range(4)]
        code = {w: i for i, w in enumerate({w for t in texts for w in t})}
        numbers = np.array([x for i, t in enumerate(texts) for x in [*map(code.get, t), -1 - i]], np.int64)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        want = sorted((s + b, n, q) for t, b in zip(texts, begins.tolist()) for s, n, q in all_runs(t, 0))
        assert periodic.runs(numbers, np.array([len(t) for t in texts])) == want


@pytest.mark.parametrize("words", [["a"] * 300_000, [str(i % 2) for i in range(300_000)], [str(i % 9_999) for i in range(200_000)]])
def test_runs_of_long_texts(words):
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    numbers = np.array([*map(code.get, words), -1], np.int64)
    assert periodic.runs(numbers, np.array([len(words)])) == [(0, len(words), len(code))]


def test_runs_query(spark):
    docs = queries.table(spark, H.SMALL, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, H.SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words, h = split(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = all_runs(words)
        r = got[d["doc_id"]]
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert any(r["n_runs"] for r in got.values())


def test_runs_of_odd_tables(spark):
    odd = H.odd_documents(spark)
    got = periodic.digests(periodic.find_runs(periodic.with_periodic_tails(odd))).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i, _ in H.TEXTS if i is not None) and len(got) == len(H.TEXTS)
    bare = next(r for r in got if r["doc_id"] == 1)
    nothing = hashlib.sha256(b"").hexdigest()
    assert (bare["n_runs"], bare["start"], bare["exponent_milli"], bare["runs_sha256"], bare["collapsed_sha256"]) == (0, None, None, nothing, nothing)
    empty = H.empty_documents(spark)
    assert periodic.digests(periodic.find_runs(periodic.with_periodic_tails(empty))).collect() == []


# --- url filters -----------------------------------------------------------------------------------

def host_path(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fitting(host, path, rules):
    """(rule, verdict) of the longest rule that fits."""
    best = (None, None)
    for rule, verdict in rules:
        name, at = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + at) and len(rule) > len(best[0] or ""):
            best = rule, verdict
    return best


def score(host, path, model):
    text, total, n = f"^{host}|{path}$".encode(), 0.0, 0
    for size in url_filter.SIZES:
        for i in range(len(text) - size + 1):
            code = 0
            for c in text[i:i + size]:
                code = (code * 257 + c + 1) % 2 ** 64
            total += model.weights[int(url_filter.mixed(np.array([code], np.uint64))[0] % np.uint64(url_filter.BUCKETS))]
            n += 1
    return 1 / (1 + math.exp(-(total / math.sqrt(max(n, 1)) + model.bias)))


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://example.com/en/1", "http://WWW.Example.COM/en/x?y=/es/", "https://a.b.net/es/#/fr/",
    "https://net/fr/2", "ftp://x.org://y/z", "https://shop.org?q=://com/", "https://notexample.com/en/", "https://example.com./en/", "https://example.com:80/en/",
    "https://ÄB.com/ü", "https://casino-bonus.org/en/4", "https://casino-bonus.org/en/4", "https://village-library.org/en/4", "https://" + "a." * 200 + "net/es/" + "x" * 100_000,
]


def test_urls_query_against_brute_force(spark):
    model = url_filter.learn(url_filter.seed_urls(spark))
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "rule string, verdict string")
    tests = [(dict(enumerate(URLS)), url_filter.filter_urls(pages, rules).collect()),
             ({r["page_id"]: r["url"] for r in queries.table(spark, H.SMALL, "pages").collect()}, queries.op12_url_filters(spark, H.SMALL).collect())]
    for urls, got in tests:
        assert sorted(r["page_id"] for r in got) == sorted(urls)
        for r in got:
            host, path = host_path(urls[r["page_id"]])
            rule, verdict = fitting(host, path, queries.URL_RULES)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            if len(path) < 1000:
                assert math.isclose(r["score"], score(host, path, model), rel_tol=1e-9)
            assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_many_rules_are_joined(spark):
    rng = random.Random(12)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org"]
    paths = ["/", "/en/", "/en/a", "/e", "/fr/"]
    rules = sorted({(rng.choice(hosts) + rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)} | {(None, "allow"), ("org/", "perhaps")}, key=str)
    urls = [f"https://{rng.choice(['', 'w.', 'W.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'a', '?a'])}" for _ in range(200)] + URLS
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    frame = spark.createDataFrame(rules, "rule string, verdict string")
    few, many = ({tuple(r) for r in url_filter.filter_urls(pages, frame, broadcast_rules=n).collect()} for n in (100, 3))
    assert few == many and len(few) == len(urls)
    known = {}
    for rule, verdict in rules:
        if rule and verdict != "perhaps":
            known[rule] = max(verdict, known.get(rule, ""))
    for page_id, host, path, rule, _, _ in few:
        assert rule == fitting(host, path, known.items())[0]


def test_url_model(spark):
    """The fitted weights are where the regularised likelihood is flat; sites that were not learned from are told apart."""
    rows = [(r["url"], r["blocked"]) for r in url_filter.seed_urls(spark).collect()]
    site = [re.sub(r"^(www|blog|m)\.", "", host_path(u)[0]) for u, _ in rows]
    texts, y = url_filter.marked(*zip(*[host_path(u) for u, _ in rows])), np.array([b for _, b in rows])
    model = url_filter.Model(texts, y)
    row, bucket = url_filter.grams(texts)
    error = 1 / (1 + np.exp(-url_filter.margins(texts, model.weights, model.bias))) - y
    n = np.sqrt(np.bincount(row))
    gradient = np.bincount(bucket, error[row] / n[row], url_filter.BUCKETS) + url_filter.PENALTY * len(y) * model.weights
    assert np.abs(gradient).max() < 1e-6 and abs(error.sum() + url_filter.PENALTY * len(y) * model.bias) < 1e-6
    right = []
    for fold in range(8):
        out = np.array([zlib.crc32(s.encode()) % 8 == fold for s in site])
        part = url_filter.Model([t for t, o in zip(texts, out) if not o], y[~out])
        right.append((url_filter.margins([t for t, o in zip(texts, out) if o], part.weights, part.bias) >= 0) == y[out])
    assert np.concatenate(right).mean() > 0.7


def test_urls_of_odd_tables(spark):
    schema, rules = "page_id long, url string, html string, score double", spark.createDataFrame([], "rule string, verdict string")
    assert url_filter.filter_urls(spark.createDataFrame([], schema), rules).collect() == []
    pages = spark.createDataFrame([(None, "https://casino-bonus.org/", None, 1.0), (1, None, None, None)], schema)
    unknown = spark.createDataFrame([(None, True), ("https://x.org/", None)], "url string, blocked boolean")
    for r in url_filter.filter_urls(pages, rules, unknown).collect():
        assert (r["rule"], r["verdict"], r["score"]) == (None, "allow", 0.5)


# --- hard negatives --------------------------------------------------------------------------------

def mined(rows, positives=5, negatives=3):
    """{(anchor, positive, rank, negative, score, score)} for rows (id, label, vector, is an anchor)."""
    found = set()
    for i, label, x, asked in rows:
        if not asked:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(x, v)), j, m) for j, m, v, _ in rows if j != i)
        for s, j, _ in [r for r in ranked if r[2] == label][:positives]:
            fits = [(t, k) for t, k, m in ranked if m != label and 50 * -s <= 100 * -t <= 95 * -s]
            found |= {(i, j, n, k, -s, -t) for n, (t, k) in enumerate(fits[:negatives], 1)}
    return found


@pytest.mark.parametrize("sample, blocks", [(4_096, 8_192), (64, 50), (0, 100)])
def test_negatives_against_brute_force(spark, monkeypatch, sample, blocks):
    rng = random.Random(sample)
    base = [[rng.randrange(-9, 30) for _ in range(5)] for _ in range(8)]
    rows = [(i, rng.choice("abc") if i % 3 else "a", [c + rng.randrange(3) for c in rng.choice(base)] if i % 4 else base[0], i % 5 == 0) for i in range(240)]
    rows += [(1_000, "alone", base[1], True), (1_005, "a", [0] * 5, True), (1_010, "b", [-3] * 5, True)]
    for name, value in (("SAMPLE", sample), ("ROW_BLOCK", blocks), ("ANCHOR_BLOCK", blocks)):
        monkeypatch.setattr(hard_negatives, name, value)
    frame = spark.createDataFrame([r[:3] for r in rows], "row_id long, label string, vector array<long>")
    got = hard_negatives.mine(frame, F.col("row_id") % 5 == 0).collect()
    assert {tuple(r) for r in got} == mined(rows) and len(got) == len(mined(rows)) > 300


def test_negatives_query(spark):
    rows = []
    for r in queries.table(spark, H.SMALL, "embeddings").collect():
        i = r["vec_id"]
        rows.append((i, (r["label"] + 1) % 10 if i % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]], i % 50 == 0))
    got = queries.op13_hard_negatives(spark, H.SMALL).collect()
    assert {tuple(r) for r in got} == mined(rows) and got


@pytest.mark.parametrize("seed", range(4))
def test_threshold_join_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(700, 20)) * rng.choice([1, 5, 60], size=(1, 20)) * rng.choice([0, 0.1, 1], size=(700, 1))).astype(np.int64) + (seed == 1)
    q = x[rng.integers(0, 700, 40)]
    q[0] = 0
    t = np.quantile(q @ x.T, [0.5, 0.99, 0.999][seed % 3], axis=1).astype(np.int64).astype(float)
    a, r, s = hard_negatives.threshold_join(x, q, t, step=6)
    wanted = q @ x.T >= t[:, None]
    assert sorted(zip(a, r)) == sorted(zip(*np.nonzero(wanted))) and (s == (q @ x.T)[a, r]).all()


def test_negatives_of_odd_tables(spark):
    schema = "row_id long, label int, vector array<double>, anchor long, key long, score string, windows string"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("row_id") >= 0).collect() == []
    odd = [(None, 1, [4.0, 4.0]), (1, None, [4.0, 4.0]), (2, 1, None), (3, 1, []), (4, 1, [None, 1.0]), (5, 1, [1.0]),
           (0, 1, [10.0, 0.0]), (6, 1, [10.0, 0.0]), (6, 1, [10.0, 0.0]), (7, 2, [9.0, 0.0]), (8, 2, [9.0, 5.0]), (9, 3, [2.0, 0.0])]
    rows = spark.createDataFrame([(*r, None, None, None, None) for r in odd], schema)
    got = hard_negatives.mine(rows, F.col("row_id") == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 6, 1, 7, 100, 90), (0, 6, 2, 8, 100, 90)]


@pytest.mark.parametrize("seed, spread", [(0, 1), (1, 5), (2, 30)])
def test_threshold_join_of_rows_that_are_all_alike(seed, spread):
    """High thresholds leave whole steps of components out of the index; a row that is scored before the last step still counts."""
    rng = np.random.default_rng(seed)
    x, q = (np.floor(50 * np.ones(64) + rng.normal(size=(n, 64)) * spread).astype(np.int64) for n in (300, 12))
    t = np.quantile(q @ x.T, 0.9, axis=1)
    a, r, s = hard_negatives.threshold_join(x, q, t)
    assert sorted(zip(a, r)) == sorted(zip(*np.nonzero(q @ x.T >= t[:, None]))) and (s == (q @ x.T)[a, r]).all()
