"""Sources, snapshots, verdicts, whole runs and streams."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraselens import session
from phraselens.config import EXTRACT, Settings
from phraselens.operators import candidates, checks, classify, embed
from phraselens.operators.phrases import phrase_counts
from phraselens.operators.progress import Progress
from phraselens.plans import inference, training
from phraselens.session import run_dir
from phraselens.sources import corpus as sc, snapshots
from phraselens.streaming import counts as stream_counts, verdicts as stream_verdicts

GOOD = ["green meadow walks bring calm", "calm green meadow near water", "water walks bring green calm"]
BAD = ["angry storm breaks every window", "every angry storm breaks doors", "doors and every window breaks"]


def small_corpus(spark):
    rows = [(i, t, 0) for i, t in enumerate(GOOD * 3)] + [(100 + i, t, 1) for i, t in enumerate(BAD * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('text,label\n"a, ""quoted"" line\nnext",1\nplain,0\nother,7\nno label,\nbad,x\n,1\n', encoding="utf-8")
    accepted, rejected = sc.normalise_labels(sc.read_csv(spark, str(path)))
    assert sorted(map(tuple, accepted.collect())) == [('a, "quoted" line\nnext', 1), ("other", 0), ("plain", 0)]
    assert sorted((r["text"] or "", r["reason"]) for r in rejected.collect()) == [
        ("", "missing text"), ("bad", "invalid label"), ("no label", "invalid label")]
    assert sc.with_row_ids(accepted).select("doc_id").distinct().count() == 3


def test_label_codes_sort_by_value(spark):
    df = spark.createDataFrame([(10,), (2,), (2,), (None,)], "label int")
    assert [tuple(r) for r in sc.label_codes(df).orderBy("code").collect()] == [(2, 0, "2"), (10, 1, "10")]
    assert sc.encode_labels(df).count() == 4


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.read_snapshot(spark, root, "s") is None
    first = snapshots.write_snapshot(spark.range(3), root, "s", "d1")
    second = snapshots.write_snapshot(spark.range(5), root, "s", "d1")
    assert snapshots.read_snapshot(spark, root, "s", "d1").count() == 5
    assert snapshots.read_snapshot(spark, root, "s", "d2") is None
    shutil.rmtree(second.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert snapshots.read_snapshot(spark, root, "s", "d1").count() == 3
    built = []
    build = lambda: built.append(1) or spark.range(2)
    assert snapshots.stage(spark, root, "t", "d", build).count() == snapshots.stage(spark, root, "t", "d", build).count() == 2
    assert built == [1]


def neighbours(spark, rows):
    return spark.createDataFrame(rows, "q_id long, rank int, phrase_id long, similarity double, cluster int, ratio_milli long")


def test_verdicts_from_neighbours(spark):
    found = neighbours(spark, [
        (1, 1, 5, 0.95, 3, 700), (1, 2, 6, 0.9, 2, 700), (2, 1, 5, 0.4, -1, None), (2, 2, 6, 0.3, -1, None),
        (3, 1, 5, 0.59, -1, None), (3, 2, 6, 0.5, 4, 510)])
    facts = classify.neighbour_ratios(found)
    phrase = {r["q_id"]: r.asDict() for r in classify.phrase_verdicts(facts).collect()}
    text = {r["q_id"]: r.asDict() for r in classify.text_verdicts(facts).collect()}
    assert phrase[1]["classification"] == "Hate speech" and phrase[1]["hate_ratio"] == "0.700" and phrase[1]["cluster_id"] == 3
    assert phrase[2]["classification"] == classify.UNABLE and phrase[2]["hate_ratio"] == "N/A" and phrase[2]["cluster_id"] is None
    assert phrase[2]["confidence"] == 0.4 and phrase[2]["low_confidence"]
    assert phrase[3]["cluster_id"] == -1 and phrase[3]["classification"] == "Hate speech" and phrase[3]["low_confidence"]
    assert text[1]["overall_classification"] == "Hate speech detected" and text[1]["threshold"] == 0.65
    assert text[2]["overall_classification"] == classify.UNABLE and text[2]["threshold"] == 0.5 and text[2]["similarity_confidence"] == 0
    assert text[3]["overall_classification"] == "Non-hate speech" and text[3]["threshold"] == 0.8


def test_index_marks_unknown_clusters(spark):
    phrases = spark.createDataFrame([(1, 0), (2, None), (3, 5)], "phrase_id long, cluster int")
    ratios = spark.createDataFrame([(0, 100), (-1, 900)], "cluster int, ratio_milli long")
    rows = {r["phrase_id"]: (r["cluster"], r["ratio_milli"]) for r in classify.phrase_index(phrases, ratios).collect()}
    assert rows == {1: (0, 100), 2: (-1, None), 3: (5, None)}


@pytest.fixture(scope="module")
def trained(spark):
    root = run_dir(spark, "test-train")
    return root, training.train(small_corpus(spark), root, Settings(k=2))


def test_training_reuses_complete_stages(spark, trained):
    root, first = trained
    again = training.train(small_corpus(spark), root, Settings(k=2))
    assert again.index.inputFiles() == first.index.inputFiles()
    assert first.statistics.agg(F.sum("size")).first()[0] == first.phrases.count() == first.index.count()


def test_explained_texts(spark, trained):
    _, model = trained
    docs = spark.createDataFrame([(1, BAD[0]), (2, GOOD[0]), (3, " "), (4, BAD[0]), (5, "the of"), (6, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in inference.explain(docs, model.index, embed.HashedEmbedder()).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6}   # a missing text is answered too
    assert rows[1]["overall_classification"] == rows[4]["overall_classification"] and rows[1]["phrases"] == rows[4]["phrases"]
    assert rows[3]["overall_classification"] == rows[5]["overall_classification"] == classify.UNABLE
    assert rows[6]["overall_classification"] == classify.UNABLE and rows[6]["phrases"] == [] and rows[6]["text_analysis"] is None
    assert rows[3]["phrases"] == [] and rows[3]["summary"] == classify.NO_PHRASES and rows[3]["text_analysis"] is None
    assert 1 <= len(rows[1]["phrases"]) <= 5 and [p["rank"] for p in rows[1]["phrases"]] == list(range(1, len(rows[1]["phrases"]) + 1))
    assert rows[1]["text_analysis"]["avg_hate_ratio"] > rows[2]["text_analysis"]["avg_hate_ratio"]


def test_stream_counts_equal_batch_and_survive_a_replay(spark, tmp_path):
    corpus = small_corpus(spark)
    src = str(tmp_path / "in")
    for part in (corpus.where("doc_id % 2 = 0"), corpus.where("doc_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(checkpoint):
        stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_counts.count_phrases(stream, out, checkpoint).awaitTermination()

    run(state)
    want = sorted(map(tuple, phrase_counts(corpus).collect()))
    assert sorted(map(tuple, stream_counts.total_counts(spark, out).collect())) == want
    run(state)                          # nothing new: nothing changes
    run(str(tmp_path / "lost-state"))   # all batches replayed: they overwrite themselves
    assert sorted(map(tuple, stream_counts.total_counts(spark, out).collect())) == want


def test_many_batches_leave_few_folders(spark, tmp_path):
    """Twenty batches merged by threes: few folders, nothing kept in memory or on disk, the same totals after a replay."""
    rows = spark.createDataFrame([(i, (GOOD + BAD)[i % 6], i % 2) for i in range(40)], "doc_id long, text string, label int")
    src, out, before = str(tmp_path / "in"), str(tmp_path / "out"), set(session.folders(spark, session.shared_dir(spark)))
    rows.repartition(20).write.parquet(src)
    want = sorted(map(tuple, phrase_counts(rows).collect()))

    def run(state):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_counts.count_phrases(stream, out, str(tmp_path / state), merge=3).awaitTermination()
        assert sorted(map(tuple, stream_counts.total_counts(spark, out, 3).collect())) == want
    run("state")
    batches = stream_counts.batch_progress(spark, out)
    n = batches.count()
    assert n >= 12 and batches.agg(F.sum("texts")).first()[0] == 40 and batches.agg(F.sum("phrases")).first()[0] == sum(r[1] for r in want)
    parts = [p for name in session.folders(spark, out) if name.startswith("level-") for p in session.folders(spark, f"{out}/{name}")]
    assert len(stream_counts.current_folders(spark, out, 3)) <= 6 and len(parts) <= 14 < n
    run("lost-state")
    assert set(session.folders(spark, session.shared_dir(spark))) == before
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_progress_counts_what_passes(spark):
    corpus = spark.createDataFrame([(1, GOOD[0], 1), (2, "the of", 0), (3, None, 0), (4, GOOD[0], 0)], "doc_id long, text string, label int")
    seen = Progress()
    phrases = phrase_counts(corpus, progress=seen).collect()
    assert seen.counters() == {"texts": 4, "missing_texts": 1, "texts_without_phrases": 2, "phrases": sum(r["total_frequency"] for r in phrases)}


def test_one_poisoned_text_costs_one_row(spark):
    texts = [*GOOD, "poison in this text", *BAD, "poison in this text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def choose(grams):
        if "poison" in grams.vocabulary.to_pylist():
            raise RuntimeError("poisoned")
        rows, rank = grams.ranked(np.arange(len(grams.text)), grams.score, 1)
        return grams.text[rows], {"phrase": grams.phrases(rows)}
    out = candidates.choose_phrases(docs, EXTRACT, [], choose, "phrase string", ("doc_id",), keep_errors=True)
    assert sorted((r["id"], r["stage"], r["error"]) for r in embed.failed_rows(out, "doc_id", "extraction").collect()) == [
        (i, "extraction", "RuntimeError: poisoned") for i in (3, 7)]
    assert sorted(r["doc_id"] for r in out.where("phrase is not null").collect()) == [0, 1, 2, 4, 5, 6]
    with pytest.raises(Exception, match="poisoned"):
        candidates.choose_phrases(docs, EXTRACT, [], choose, "phrase string", ("doc_id",)).collect()

    def load():
        return lambda batch: np.array([[1 / ("poison" not in t)] for t in batch])
    embedded = embed.FunctionEmbedder(load, keep_errors=True).embed(docs, "text")
    assert [(r["id"], r["error"].split(":")[0]) for r in embed.failed_rows(embedded, "doc_id", "embedding").collect()] == [(3, "ZeroDivisionError"), (7, "ZeroDivisionError")]
    assert embedded.where("embedding is not null").count() == 6


def test_sketches_unite(spark):
    """Sketches of two snapshots together see each value once; the error stays small."""
    a, b = (spark.range(lo, hi).select(F.col("id").cast("string").alias("phrase")) for lo, hi in ((0, 60_000), (40_000, 100_000)))
    both = checks.distinct_sketch(a, "phrase").unionAll(checks.distinct_sketch(b, "phrase"))
    assert abs(checks.united_estimate(both).first()["estimate"] - 100_000) < 4_000


def test_neighbour_counts_are_settings(spark, trained):
    _, model = trained
    docs = spark.createDataFrame([(1, BAD[0])], "doc_id long, text string")
    row = inference.explain(docs, model.index, embed.HashedEmbedder(), settings=Settings(text_neighbours=2, phrase_neighbours=3)).first()
    assert "2 nearest" in row["summary"] and row["phrases"][0]["classification_method"] == "KNN-based (3 neighbors)"


def test_stream_verdicts_equal_batch(spark, trained, tmp_path):
    _, model = trained
    docs = small_corpus(spark).select("doc_id", "text")
    src = str(tmp_path / "in")
    docs.coalesce(1).write.parquet(src)
    stream_verdicts.explain_stream(spark.readStream.schema(docs.schema).parquet(src), model.index, embed.HashedEmbedder(),
                                   str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda df: sorted((r["doc_id"], r["overall_classification"], str(r["phrases"])) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(inference.explain(docs, model.index, embed.HashedEmbedder()))


def test_other_embedder_is_another_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"hate stupid words number{i % 3} again", i % 2) for i in range(30)], "doc_id long, text string, label int")
    digests = {training.run_digest(docs, Settings(), embed.HashedEmbedder(d)) for d in (64, 64, 128)}
    digests.add(training.run_digest(docs.where("doc_id > 0"), Settings(), embed.HashedEmbedder(64)))
    assert len(digests) == 3


def test_older_versions_are_all_tried_and_faults_raised(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "many"), spark.createDataFrame([(1,), (2,)], "x long")
    snapshots.write_snapshot(rows, root, "s", "d")
    for _ in range(3):
        made = snapshots.write_snapshot(rows, root, "s", "d")
        shutil.rmtree(made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert snapshots.read_snapshot(spark, root, "s", "d").count() == 2

    def broken(*_):
        raise PermissionError("no access")
    monkeypatch.setattr(type(spark.read), "parquet", broken)
    with pytest.raises(Exception):
        snapshots.read_snapshot(spark, root, "s", "d")


def test_texts_are_classified_where_they_are_read(spark, trained, monkeypatch):
    """No join moves the texts to leave out those without phrases, and these stay unclassified."""
    (_, model), seen = trained, []
    classify_texts = inference.classify_text_set

    def watched(texts, *rest):
        seen.append(texts._jdf.queryExecution().executedPlan().toString())
        return classify_texts(texts, *rest)
    monkeypatch.setattr(inference, "classify_text_set", watched)
    docs = spark.createDataFrame([(1, GOOD[0]), (2, "the"), (3, BAD[0])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in inference.explain(docs, model.index, embed.HashedEmbedder()).collect()}
    assert len(seen) == 1 and "Join" not in seen[0] and "Exchange" not in seen[0]
    assert rows[2]["overall_classification"] == classify.UNABLE and rows[2]["summary"] == classify.NO_PHRASES and rows[2]["text_analysis"] is None
    assert rows[1]["phrases"] and rows[1]["text_analysis"] and rows[3]["summary"] != classify.NO_PHRASES
