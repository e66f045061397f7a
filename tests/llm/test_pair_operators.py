"""Line dedup, decontamination, near-duplicates, neighbours and the pipeline against brute force and on odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phraselens.llm import bloom_lm, common, decontaminate, line_dedup, lsh, minhash, queries
from tests.llm import helpers as H


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_components(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)        # the way of large tables
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (100, 150)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng, rows = random.Random(threshold), [("", ""), ("", "ab"), ("a", "")]
    for _ in range(300):
        a = "".join(rng.choice("abü") for _ in range(rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(0, len(b) + 1)
            b[k:k + rng.randrange(2)] = rng.choice(["", "a", "b", "ü"])
        rows.append((a, "".join(b)))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect():
        true = H.edit_distance(r["a"], r["b"])
        assert r["d"] == true if true <= threshold else r["d"] > threshold


@pytest.mark.parametrize("threshold, hot", [(1, 64), (1, 1), (2, 64), (2, 4), (3, 4)])
def test_line_links_lose_nothing(spark, monkeypatch, threshold, hot):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(18, 80))) for _ in range(12)]
    lines = set(base)
    for _ in range(150):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(x))
            x[k:k + rng.randrange(2)] = rng.choice(["", "z", "ü"])
        lines.add("".join(x))
    lines = sorted(x for x in lines if x.strip())
    original = line_dedup.line_links
    monkeypatch.setattr(line_dedup, "line_links", lambda a, b, t: original(a, b, t, hot))
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = texts_of(line_dedup.dedup_lines(frame, threshold))
    assert {i: t for i, t in kept.items()} == H.without_repeats(dict(enumerate(lines)), threshold)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_alignments_decide_short_rests(threshold):
    """Rests of at most `threshold` characters and longer ones are within the threshold exactly if some listed places agree."""
    rng = random.Random(threshold)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, threshold + 1)))
        b = "".join(rng.choice("abc") for _ in range(len(a) + rng.randrange(0, threshold + 1)))
        if len(b) > threshold:
            listed = any([a[i] for i in x] == [b[i] for i in y] for x, y in line_dedup._alignments(threshold, len(a), len(b)))
            assert listed == (H.edit_distance(a, b) <= threshold)


def test_crowded_lines_make_links_in_proportion(spark):
    """Counter lines are all within three edits of each other; twice as many lines make about twice as many links."""
    def links(n):
        lines = [(i, f"the entry number {i:03d} of a list that is rather long and goes on") for i in range(n)]
        frame = spark.createDataFrame([(i, t, t) for i, t in lines], "doc_id long, text string, line string")
        kept = texts_of(line_dedup.dedup_lines(frame))
        assert kept[0] == lines[0][1] and not any(t for i, t in kept.items() if i)
        return line_dedup.find_repeats(frame).agg(F.sum("n_links")).first()[0]
    few, many = links(150), links(300)
    assert many < 2.6 * few < 300 * 60


def test_line_dedup_allows_edits_by_length(spark):
    """Two typos in a line of 40 characters and three in one of 200 are linked, three in 40 and two in 24 are not."""
    rng = random.Random(3)
    rows, want = [], {}
    for n, typos in ((200, 3), (200, 4), (40, 2), (40, 3), (24, 1), (24, 2)):
        line = "".join(rng.choice("abcdefgh ") for _ in range(n - 2))
        other = list(line)
        for k in range(typos):
            other[(2 * k + 1) * n // (2 * typos) - 1] = "Z"
        rows += [(len(rows), f"x{line}x"), (len(rows) + 1, f"x{''.join(other)}x")]
        want[len(rows) - 1] = (n, typos) in ((200, 3), (40, 2), (24, 1))
    got = {r["doc_id"]: r["lines_removed"] == 1 for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == want


@pytest.mark.parametrize("threshold", [1, 2])
def test_crowded_lines_are_split(spark, monkeypatch, threshold):
    """Lines of 22 or 97 characters with a number in them share all but that; few pairs may meet, and no link may be lost."""
    rng = random.Random(5)
    numbers = rng.sample(range(10 ** 8), 60)
    numbers += [x // 100 * 100 + rng.randrange(100) for x in numbers[:20]]
    lines = sorted({f"user {x:08d} came in" for x in numbers} | {"a long line of a log " * 3 + f"{x:08d}" + " and what follows it there" for x in numbers})
    texts, met, within = dict(enumerate(lines)), [], line_dedup._within

    def counted(pairs, t):
        met.append(pairs.count())
        return within(pairs, t)
    monkeypatch.setattr(line_dedup, "_within", counted)
    kept = texts_of(line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), threshold))
    assert kept == H.without_repeats(texts, threshold) and met[0] < len(lines) ** 2 / 20


def test_crowded_copies_with_other_words(spark, monkeypatch):
    """Copies of a long line in which some words are others share its segments, but few are within three edits of each other."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    base, lines = rng.sample(words, 18), set()
    for n in range(130):
        copy = [rng.choice(words) if rng.random() < 0.2 else w for w in base]
        lines.add(" ".join(copy))
        if n % 6 == 0:
            k = rng.randrange(len(copy))
            copy[k] = copy[k][:1] + "x" + copy[k][2:]
            lines.add(" ".join(copy) + "."[:n % 4])
    texts, met, within, placed = dict(enumerate(sorted(lines))), [], line_dedup._within, line_dedup._rare_pairs

    def counted(pairs, t):
        met.append(pairs.count())
        return within(pairs, t)

    def rare(crowded, most, hot):
        found, left = placed(crowded, most, hot)
        met.extend([crowded.count(), left.count()])
        return found, left
    monkeypatch.setattr(line_dedup, "_within", counted)
    monkeypatch.setattr(line_dedup, "_rare_pairs", rare)
    original = line_dedup.line_links
    monkeypatch.setattr(line_dedup, "line_links", lambda a, b, t: original(a, b, t, 8))
    kept = texts_of(line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3))
    assert kept == H.without_repeats(texts, 3)
    crowded, left, pairs = met
    assert crowded > 80 and left < crowded / 4 and pairs < crowded ** 2 / 8


def test_crowded_lines_meet_those_beside_a_fuller_cell(spark, monkeypatch):
    """Line 0 has rare segments, its near copy holds them in a cell beside one that is too full: the link must not be lost."""
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    base, tail = some(62), some(21)
    lines = [base + tail, base + tail[:10] + "Z" + tail[10:]] + [base + some(n) for n in (21, 21, 21, 22, 23, 24, 26, 26, 27, 27, 28, 29)]
    original = line_dedup.line_links
    monkeypatch.setattr(line_dedup, "line_links", lambda a, b, t: original(a, b, t, 4))
    texts = dict(enumerate(lines))
    kept = texts_of(line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3))
    assert kept == H.without_repeats(texts, 3) and kept[0] and not kept[1]


def test_crowded_copies_with_one_other_word(spark, monkeypatch):
    """Copies of a line with a word of four letters put in anywhere share nearly all segments; few entries may be made of them, and no link may be lost."""
    rng, letters = random.Random(6), "abcdefghijklmnop"
    base = "".join(rng.choice(letters + " ") for _ in range(126)).join("xx")
    lines, made, written = {base, base[:40] + "z" + base[40:]}, [], line_dedup.written
    while len(lines) < 112:
        k = rng.randrange(1, len(base))
        word = "".join(rng.choice(letters) for _ in range(4))
        lines.add(base[:k] + word + base[k:])
        if rng.random() < 0.15:
            lines.add(base[:k] + word[:2] + rng.choice("Zz") + word[3:] + base[k:])
    texts = dict(enumerate(sorted(lines)))

    def recorded(df, name):
        out = written(df, name)
        made.append((name, out.count()))
        return out
    monkeypatch.setattr(line_dedup, "written", recorded)
    original = line_dedup.line_links
    monkeypatch.setattr(line_dedup, "line_links", lambda a, b, t: original(a, b, t, 48))
    kept = texts_of(line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3))
    assert kept == H.without_repeats(texts, 3) and "lines-crowded" in dict(made)
    assert sum(n for name, n in made if name == "lines-split") < 40 * len(lines)


def test_coarse_keys_lose_no_link(spark):
    """Lines around the lengths at which cuts and edits change: all that have a link by the registered rule are found, most others are not."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n - 2)).join("xx")
    edits, lines = lambda n: max(min(n // 16, 3), 1), set()
    for n in [m + d for m in (18, 32, 48, 64, 96) for d in (-2, -1, 0, 1, 2)] * 4:
        line = some(n)
        copy = list(line)
        for _ in range(edits(n)):
            k = rng.randrange(len(copy))
            copy[k:k + rng.randrange(2)] = rng.choice(["", "Z", "ü"])
        lines |= {line, "".join(copy)} if len(copy) >= 16 and rng.random() < 0.5 else {line}
    lines = sorted(lines)
    linked = {x for a in lines for b in lines if a != b and abs(len(a) - len(b)) <= 3 and H.edit_distance(a, b) <= edits(min(len(a), len(b))) for x in (a, b)}
    frame = spark.createDataFrame([(x, x, len(x)) for x in lines], "line string, text string, chars int")
    found = {r["text"] for r in line_dedup._meeting_lines(frame, None).collect()}
    assert len(linked) > 40 and linked <= found and len(found) < len(linked) + (len(lines) - len(linked)) / 3


def test_lines_that_meet_none_make_few_keys(spark, monkeypatch):
    """Lines that are like no other make eight keys or so each, not the 26 of three edits, and no pair."""
    rng, made, written = random.Random(8), [], line_dedup.written
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(48, 150))) for _ in range(200)]

    def recorded(df, name):
        out = written(df, name)
        made.append((name, out.count()))
        return out
    monkeypatch.setattr(line_dedup, "written", recorded)
    line_dedup.find_repeats(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).count()
    assert sum(n for name, n in made if name in ("lines-coarse", "lines-keyed")) <= 10 * len(lines) and not dict(made)["lines-keyed"]


def test_line_dedup_on_documents(spark):
    docs = queries.table(spark, H.SMALL, "documents")
    want = H.without_repeats(texts_of(docs))
    got = {r["doc_id"]: r["text_sha256"] for r in queries.op3_line_dedup(spark, H.SMALL).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_line_dedup_odd(spark):
    docs = H.odd_documents(spark)
    made = line_dedup.dedup_lines(docs)
    assert made.count() == docs.count() and set(docs.columns) <= set(made.columns) and line_dedup.dedup_lines(H.empty_documents(spark)).count() == 0
    found = {r["doc_id"]: r for r in made.where("doc_id > 0").collect()}
    assert found[1]["text"] is None and found[2]["text"] == "" and found[10]["text"] == "\n\n\n"
    assert found[5]["text"] == H.PASSAGE and found[6]["text"] == "" and list(found[6]["kept_in"]) == [5] and found[7]["text"]
    assert found[11]["text"] == "a line that is long enough\nanother line that is long enough"
    assert found[12]["text"].startswith("a line") and found[12]["lines_removed"] == 1 and found[13]["lines_removed"] == 1


def test_near_duplicates(spark, monkeypatch):
    docs = queries.table(spark, H.SMALL, "documents").select("doc_id", "text")
    rng, rows, base = random.Random(3), [], H.PASSAGE.split() * 3
    for i in range(60):     # a group around the threshold
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        rows.append((10_000 + i, " ".join(w)))
    docs = docs.unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes, component = H.shingle_components(texts_of(docs))
    got = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (sizes[i], c, c == i) for i, c in component.items()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(minhash.near_duplicates(docs, star_rounds=0).collect()) == sorted(got)


def test_near_duplicates_odd(spark):
    got = minhash.near_duplicates(H.odd_documents(spark)).collect()
    assert len(got) == len(H.TEXTS) and minhash.near_duplicates(H.empty_documents(spark)).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[7]["component_id"] == by[6]["component_id"] == 5 and by[9]["component_id"] == 8 and not by[9]["kept"]
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (1, 2, 3, 10)) and by[4]["n_shingles"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def test_leaks(spark):
    docs, items = queries.table(spark, H.SMALL, "documents"), queries.table(spark, H.SMALL, "benchmark")
    want = {}
    for i, text in texts_of(docs).items():
        want[i] = sorted(r["item_id"] for r in items.collect() if r["text"] in text)
    got = queries.op6_decontaminate(spark, H.SMALL).collect()
    assert {r["doc_id"]: r["items"] for r in got} == want and all(r["contaminated"] == bool(r["items"]) for r in got)
    groups = decontaminate.find_leaks(docs, items, index_bytes=4_000).collect()
    assert {r["doc_id"]: r["items"] for r in groups} == want


def test_leaks_of_repeated_rows_in_any_number_of_groups(spark):
    rows = [(1, H.PASSAGE), (1, H.PASSAGE), (None, H.PASSAGE), (None, H.PASSAGE), (2, None), (2, None), (3, "nothing of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = H.PASSAGE.split()
    items = spark.createDataFrame([(i, " ".join(words[:9 + i])) for i in range(8)], "item_id long, text string")
    one, many = (decontaminate.find_leaks(docs, items, index_bytes=n).collect() for n in (1 << 26, 1_000))
    assert len(one) == len(many) == len(rows) and max(len(r["items"]) for r in one) > 1
    assert sorted(map(str, one)) == sorted(map(str, many))


@pytest.mark.parametrize("share", [1e-9, 1e-12])
def test_draws_are_never_empty_for_size(spark, share):
    """A share of a few rows in billions still has a threshold above nothing, and about that share falls below it."""
    assert int(share * (1 << 62)) > 0
    rows = spark.range(100_000)
    assert 50 < rows.where(common.drawn("id", 1e-3, 8)).count() < 160
    assert rows.where(common.drawn("id", 2.0, 8)).count() == 100_000 and rows.where(common.drawn("id", 0.0, 8)).count() == 0


def test_near_copies_and_cut_items_leak(spark):
    """Items with any one word replaced, and items without the last tenth of their words."""
    items = queries.table(spark, H.SMALL, "benchmark")
    rows, want = [], {}
    for r in items.collect():
        w = r["text"].split()
        if len(decontaminate.terms(common.words(r["text"]))) < decontaminate.MIN_WORDS + 2:
            continue
        near = [w[:k] + ["qqqq"] + w[k + 1:] for k in range(len(w))] + [w[:len(w) - max(len(w) // 10, 1)]]
        for x in near:
            want[len(rows)] = r["item_id"]
            rows.append((len(rows), " ".join(x)))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert [r["doc_id"] for r in got if want[r["doc_id"]] not in r["items"]] == []


def test_index_holds_postings_only():
    """3,000 items of 12 words of their own: a dense array of terms by items would take 860 MB."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(3_000)]
    index = decontaminate.Index(items, {f"w{i}x{k}".encode(): 1 for i in range(3_000) for k in range(12)}, 3_000, 12.0)
    arrays = [x for x in vars(index).values() if isinstance(x, np.ndarray)] + [x for p in index.parts for x in p]
    assert sum(x.nbytes for x in arrays) < 36_000 * decontaminate.WORD_BYTES and np.allclose(np.bincount(index.items, index.impacts), 1)


def test_wand_misses_nothing(spark):
    """Retrieved items against BM25 shares computed plainly for every passage and item."""
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, H.SMALL, "benchmark").collect()]
    lists = {i: decontaminate.terms(common.words(t)) for i, t in items}
    lists = {i: t for i, t in lists.items() if len(t) >= decontaminate.MIN_WORDS}
    df, mean, step = {}, sum(map(len, lists.values())) / len(lists), max(map(len, lists.values()))
    for t in lists.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1

    def weights(t):
        out = {w: np.log1p((len(lists) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(t)}
        return {w: x / sum(out.values()) for w, x in out.items()}
    shares, docs = {i: weights(t) for i, t in lists.items()}, queries.table(spark, H.SMALL, "documents").limit(40)
    want = {}
    for i, text in texts_of(docs).items():
        w = decontaminate.terms(common.words(text))
        passages = [w[k:k + 2 * step] for k in range(0, max(len(w) - step, 1), step)] if w else []
        want[i] = sum(sum(s.get(x, 0) for x in set(p)) >= 0.3 for p in passages for s in shares.values())
    got = decontaminate.find_leaks(docs, queries.table(spark, H.SMALL, "benchmark"), threshold=0.3).collect()
    assert {r["doc_id"]: r["n_retrieved"] for r in got} == want


def test_leaks_odd(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, H.PASSAGE), (3, H.PASSAGE), (3, H.PASSAGE), (4, "too short")], "item_id long, text string")
    got = {r["doc_id"]: list(r["items"]) for r in decontaminate.find_leaks(H.odd_documents(spark), items).collect()}
    assert got[5] == got[6] == got[7] == [3] and not got[8] and not got[1]
    assert decontaminate.find_leaks(H.empty_documents(spark), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(H.odd_documents(spark), items.limit(0)).where("contaminated").count() == 0


def test_neighbours(spark):
    rows = spark.read.parquet(f"{H.SMALL}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.values, np.array(rows.embedding.tolist(), dtype=np.float64)
    got, hits = {}, 0
    for r in queries.op9_nearest_neighbours(spark, H.SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:10]
        hits += len({v for v, _ in got[ids[i]]} & set(ids[best]))
        assert len(got[ids[i]]) == 10 and all(s == pytest.approx(d[ids == v][0], abs=1e-12) for v, s in got[ids[i]])
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_odd(spark, monkeypatch):
    monkeypatch.setattr(lsh, "TASK_ENTRIES", 3)             # buckets in several parts
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 0.5]), (200, [0.5, 0.5]), (200, [0.5, 0.5]), (300, None), (9, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in lsh.nearest_neighbours(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 100, 200, 2], 100: [0, 1, 200, 2], 200: [0, 1, 2, 100]}
    assert lsh.nearest_neighbours(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, H.SMALL, "documents").collect()}
    left = {i: t for i, t in docs.items() if any(map(str.isalpha, t or ""))}
    clean = H.without_repeats(left)
    left = {i: t for i, t in clean.items() if t == left[i] or t.strip(" ")}
    _, component = H.shingle_components(left)
    left = {i: t for i, t in left.items() if component[i] == i}
    items = [r["text"] for r in queries.table(spark, H.SMALL, "benchmark").collect()]
    left = {i: t for i, t in left.items() if not any(x in t for x in items)}
    got = corpus_pipeline.run(spark, H.SMALL).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}


@pytest.mark.parametrize("table", [H.odd_documents, H.empty_documents])
def test_pipeline_odd(spark, table):
    docs = table(spark)
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, H.SMALL), "test")
        assert docs.count() <= before.count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == before.columns


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11)) and bloom_lm.PROBES


def test_bags_differ_by_two_bits_an_edit_at_most(spark):
    """Numbers of characters modulo 4: an edit changes at most two bits, and two more of a character are seen as two."""
    rng, rows = random.Random(12), []
    for _ in range(300):
        a = [rng.choice("abpqP0123 üé漢") for _ in range(rng.randrange(2, 60))]
        b, edits = list(a), rng.randrange(1, 4)
        for _ in range(edits):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = rng.choice(["", "x", "0", "漢"])
        rows.append(("".join(a), "".join(b) + "a", edits + 1))
    bags = spark.createDataFrame([*rows, ("line 11", "line 1111", -1)], "x string, y string, e int").select("e", line_dedup._bag("x").alias("c"), line_dedup._bag("y").alias("d"))
    found = bags.select("e", line_dedup._apart("c", "d").alias("n")).collect()
    assert all(r["n"] <= 2 * r["e"] for r in found[:-1]) and found[-1]["n"] == 2
