"""DuckDB counterparts of the queries, written independently as SQL over the same tables."""

from __future__ import annotations

import re

from phraselens.functions.words import BASE_STOP_WORDS, BOOST_WORDS, EXTRA_STOP_WORDS, RELEVANT_WORDS

WS = r"\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}\p{Z}"
DIM = 256


def words(items) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in items)


def values(items) -> str:
    return "SELECT unnest([" + words(items) + "]) AS word"


def r(expr: str, decimals: int) -> str:
    scale = f"1e{decimals}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name not in seen:
            seen.add(name)
            parts.append(f"{name} AS MATERIALIZED ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + final


# --- corpus and texts ---

def corpus(label="toxic"):
    return [("corpus", f"SELECT doc_id, text, CASE WHEN {label} = 1 THEN 1 ELSE 0 END AS label "
                       f"FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND {label} IS NOT NULL")]


STOP = [("stop", f"SELECT word FROM ({values(BASE_STOP_WORDS)}) EXCEPT SELECT word FROM ({values(RELEVANT_WORDS)}) "
                 f"UNION SELECT word FROM ({values(EXTRA_STOP_WORDS)})")]

# texts(k, text, docs, hate)
CORPUS_TEXTS = [("texts", "SELECT md5(text) AS k, any_value(text) AS text, count(*) AS docs, "
                          "sum(label) AS hate FROM corpus GROUP BY 1")]
DOC_TEXTS = [("texts", "SELECT md5(text) AS k, any_value(text) AS text, count(*) AS docs, 0 AS hate "
                       "FROM documents WHERE text IS NOT NULL GROUP BY 1")]
BANDED = ("CASE WHEN n > 20 THEN 4 WHEN n > 15 THEN 3 ELSE 2 END", 3)
FULL = ("4", 1)


def candidates(profile):
    """cand(k, phrase, n, psq, score, ws) for every text of `texts`."""
    band, min_chars = profile
    grams = []
    for n in range(1, 5):
        cols = [f"w{i}" for i in range(1, n + 1)]
        grams.append(f"SELECT k, {n} AS n, {' || chr(32) || '.join(cols)} AS phrase, [{', '.join(cols)}] AS ws "
                     f"FROM seq WHERE w{n} IS NOT NULL AND max_n >= {n}")
    return [
        ("gated", f"SELECT k, len(regexp_extract_all(text, '[^{WS}]+')) AS n, "
                  r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM texts "
                  f"WHERE length(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')) >= {min_chars}"),
        ("tok", f"SELECT * FROM (SELECT k, {band} AS max_n, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM gated) "
                "WHERE word NOT IN (SELECT word FROM stop)"),
        ("tf", "SELECT k, word, count(*) AS tf FROM tok GROUP BY ALL"),
        ("tsq", "SELECT k, sum(tf * tf) AS tsq FROM tf GROUP BY k"),
        ("seq", "SELECT k, max_n, word AS w1, " + ", ".join(
            f"lead(word, {i}) OVER (PARTITION BY k ORDER BY pos) AS w{i + 1}" for i in (1, 2, 3)) + " FROM tok"),
        ("grams", "SELECT DISTINCT * FROM (" + " UNION ALL ".join(grams) + ")"),
        ("pw", "SELECT k, phrase, word, count(*) AS pf FROM (SELECT k, phrase, unnest(ws) AS word FROM grams) GROUP BY ALL"),
        ("hits", "SELECT k, phrase, sum(pf * tf) AS dot, sum(pf * pf) AS psq FROM pw JOIN tf USING (k, word) GROUP BY ALL"),
        ("cand", "SELECT k, phrase, n, psq, ws, dot::DOUBLE / sqrt((psq * tsq)::DOUBLE) AS score "
                 "FROM hits JOIN grams USING (k, phrase) JOIN tsq USING (k)"),
    ]


TOP = [("top6", "SELECT * FROM (SELECT k, phrase, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, phrase) AS rank "
                "FROM cand) WHERE rank <= 6")]
BOOST = [
    ("boosted", f"SELECT k, phrase, rank AS old_rank, {r('score', 4)} * CASE WHEN list_has_any(string_split(phrase, ' '), "
                f"[{words(BOOST_WORDS)}]) THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS score FROM top6"),
    ("chosen", "SELECT * FROM (SELECT k, phrase, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, old_rank) AS rank "
               "FROM boosted) WHERE rank <= 3"),
]
COUNTS = [("counts", "SELECT phrase, sum(docs)::BIGINT AS total_frequency, sum(hate)::BIGINT AS hate_count, "
                     "sum(docs - hate)::BIGINT AS non_hate_count FROM chosen JOIN texts USING (k) GROUP BY phrase")]
REPORT = [("report", "SELECT *, CASE WHEN hate_ratio > 0.66::DOUBLE THEN 'HIGH HATE' WHEN hate_ratio > 0.33::DOUBLE THEN 'NEUTRAL' "
                     "ELSE 'LOW HATE' END AS hate_indicator FROM (SELECT *, hate_count / total_frequency AS hate_ratio "
                     "FROM counts WHERE total_frequency >= 3)")]


def extraction(label="toxic"):
    return corpus(label) + STOP + CORPUS_TEXTS + candidates(BANDED) + TOP + BOOST


def counted(label="toxic"):
    return extraction(label) + COUNTS


def reported(label="toxic"):
    return counted(label) + REPORT


# --- diverse phrases ---

def mmr_steps(limit=10, top_k=5):
    """Ten greedy steps; `near` is the largest similarity to a phrase chosen before."""
    keep, away = repr(1 - 0.7), repr(0.7)
    steps = [("s0", "SELECT k, phrase, psq, score, ws[1] AS w1, ws[2] AS w2, ws[3] AS w3, ws[4] AS w4, "
                    "NULL::DOUBLE AS near, false AS used FROM cand")]
    for i in range(1, limit + 1):
        value = "score" if i == 1 else f"{keep}::DOUBLE * score - {away}::DOUBLE * near"
        same = " + ".join(f"coalesce((s.w{a} = b.w{c})::INT, 0)" for a in range(1, 5) for c in range(1, 5))
        steps.append((f"b{i}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {value} DESC, phrase) AS rn "
                               f"FROM s{i - 1} WHERE NOT used) WHERE rn = 1"))
        steps.append((f"s{i}", f"SELECT s.k, s.phrase, s.psq, s.score, s.w1, s.w2, s.w3, s.w4, "
                               f"greatest(s.near, ({same})::DOUBLE / sqrt((s.psq * b.psq)::DOUBLE)) AS near, "
                               f"s.used OR coalesce(s.phrase = b.phrase, false) AS used FROM s{i - 1} s LEFT JOIN b{i} b USING (k)"))
    steps.append(("diverse", f"SELECT * FROM (SELECT k, phrase, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, phrase) AS rank "
                             f"FROM (SELECT k, phrase, {r('score', 4)} AS score FROM s{limit} WHERE used "
                             f"AND phrase NOT IN (SELECT word FROM stop))) WHERE rank <= {top_k}"))
    return steps


# --- hash order, splits, pairs ---

SPLIT = [
    ("sizes", "SELECT label, n, n * wanted // total AS base, n * wanted % total AS rest, wanted FROM (SELECT label, count(*) AS n, "
              "sum(count(*)) OVER () AS total, ceil(0.2 * sum(count(*)) OVER ())::BIGINT AS wanted FROM corpus GROUP BY label)"),
    ("tests", "SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= wanted - sum(base) OVER () "
              "THEN 1 ELSE 0 END AS n_test FROM sizes"),
    ("split", "SELECT doc_id, text, label, CASE WHEN rn <= n_test THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() "
              "OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM corpus) JOIN tests USING (label)"),
]


def pair_sql(part, cap):
    return [
        ("listed", f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, "
                   f"lead(text) OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS next_text "
                   f"FROM split WHERE split = '{part}'"),
        ("caps", f"SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, {cap} AS cap FROM listed"),
        ("pairs", "SELECT text AS text_a, next_text AS text_b, 1.0::DOUBLE AS score, CASE WHEN label = 1 THEN 'same_positive' "
                  "ELSE 'same_negative' END AS kind FROM listed, caps WHERE i < cap AND next_text IS NOT NULL UNION ALL "
                  "SELECT p.text, n.text, 0.0::DOUBLE, 'cross' FROM listed p, caps, listed n "
                  "WHERE p.label = 1 AND n.label = 0 AND p.i < cap AND n.i = p.i % n0"),
    ]


TRAIN_CAP = "least(count(*) FILTER (label = 1), count(*) FILTER (label = 0))"


def hashed(source, key, text, name):
    """Sparse hashed word counts name(key, b, c) of source(key, text)."""
    return [(name, f"SELECT {key}, b, count(*) AS c FROM (SELECT {key}, ('0x' || substr(md5(word), 1, 6))::INT % {DIM} AS b FROM "
                   rf"(SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM {source}) "
                   f"WHERE word NOT IN (SELECT word FROM stop)) GROUP BY ALL")]


def lexical_search(queries, key, qvec, k, name):
    """name(q, rank, sim, cluster, ratio_milli): nearest phrases of idx by cosine of hashed counts."""
    return [
        (f"{name}_n", f"SELECT {key} AS q, sum(c * c) AS sq FROM {qvec} GROUP BY 1"),
        (f"{name}_dot", f"SELECT v.{key} AS q, p.phrase_id, sum(v.c * p.c) AS dot FROM {qvec} v JOIN pvec p USING (b) GROUP BY ALL"),
        (f"{name}_all", f"SELECT a.q, i.phrase_id, i.cluster, i.ratio_milli, {r('CASE WHEN n.sq * i.sq > 0 THEN coalesce(d.dot, 0)::DOUBLE / sqrt((n.sq * i.sq)::DOUBLE) ELSE 0 END', 9)} AS sim "
                        f"FROM (SELECT DISTINCT {key} AS q FROM {queries}) a CROSS JOIN idx i LEFT JOIN {name}_n n USING (q) "
                        f"LEFT JOIN {name}_dot d ON d.q = a.q AND d.phrase_id = i.phrase_id"),
        (name, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, phrase_id) AS rank FROM {name}_all) WHERE rank <= {k}"),
    ]


def facts(found, name):
    return [(name, f"SELECT q, coalesce(sum(ratio_milli), 0)::BIGINT AS milli_sum, count(ratio_milli) AS mapped, max(sim) AS top, "
                   f"arg_min(cluster, rank) AS nearest, CASE WHEN count(ratio_milli) > 0 THEN sum(ratio_milli)::DOUBLE / "
                   f"(count(ratio_milli) * 1000.0::DOUBLE) END AS mean FROM {found} GROUP BY q")]


THRESHOLD = ("CASE WHEN top < 0.5::DOUBLE THEN 0.85::DOUBLE WHEN top < 0.65::DOUBLE THEN 0.8::DOUBLE WHEN top < 0.8::DOUBLE "
             "THEN 0.75::DOUBLE WHEN top < 0.9::DOUBLE THEN 0.7::DOUBLE ELSE 0.65::DOUBLE END")
MEAN_MILLI = "((milli_sum * 2 + mapped) // (mapped * 2))"


def decimals3(milli):
    return f"(({milli}) // 1000)::VARCHAR || '.' || lpad((({milli}) % 1000)::VARCHAR, 3, '0')"


def phrase_verdict(found, name, k):
    return [(name, f"SELECT q, CASE WHEN mapped > 0 THEN nearest END::BIGINT AS cluster_id, mean AS mean_ratio, "
                   f"CASE WHEN mapped > 0 THEN {decimals3(MEAN_MILLI)} ELSE 'N/A' END AS hate_ratio, "
                   f"CASE WHEN mapped = 0 THEN 'Unable to classify' WHEN mean > 0.5::DOUBLE THEN 'Hate speech' ELSE 'Non-hate speech' END AS classification, "
                   f"top AS confidence, top < 0.6::DOUBLE AS low_confidence, "
                   f"CASE WHEN mapped > 0 THEN 'KNN-based ({k} neighbors)' ELSE 'N/A' END AS classification_method FROM {found}")]


def text_verdict(found, name, k):
    shown = f"CASE WHEN mapped > 0 THEN {MEAN_MILLI} ELSE 0 END"
    return [(name, f"SELECT q, CASE WHEN mapped = 0 THEN 'Unable to classify' WHEN mean > threshold THEN 'Hate speech detected' "
                   f"ELSE 'Non-hate speech' END AS overall_classification, CASE WHEN mapped > 0 THEN top ELSE 0 END AS similarity_confidence, "
                   f"coalesce(mean, 0) AS avg_hate_ratio, threshold, 'Analysis complete: Input text classified based on semantic similarity to "
                   f"{k} nearest phrases (avg hate ratio: ' || {decimals3(shown)} || ')' AS summary "
                   f"FROM (SELECT *, CASE WHEN mapped > 0 THEN {THRESHOLD} ELSE 0.5::DOUBLE END AS threshold FROM {found})")]


# --- lexical index: phrases of the quality corpus, clusters by nearest of ten seed phrases ---

def milli(pos, total):
    return f"CASE WHEN {total} > 0 THEN (2000 * {pos} + {total}) // (2 * {total}) ELSE 0 END"


LEXICAL = reported("quality") + [("ph", "SELECT *, md5(phrase) AS phrase_id FROM report")] + hashed("ph", "phrase_id", "phrase", "pvec") + [
    ("psize", "SELECT phrase_id, coalesce(sum(c * c), 0) AS sq FROM ph LEFT JOIN pvec USING (phrase_id) GROUP BY phrase_id"),
    ("seeds", "SELECT phrase_id AS seed, row_number() OVER (ORDER BY phrase_id) - 1 AS cluster FROM ph ORDER BY phrase_id LIMIT 10"),
    ("punit", "SELECT phrase_id, b, c / sqrt(sq::DOUBLE) AS u FROM pvec JOIN psize USING (phrase_id)"),
    ("closeness", "SELECT p.phrase_id, s.cluster, floor((coalesce(sum(a.u * b.u), 0) - (SELECT coalesce(sum(x.u * x.u), 0) / 2 FROM punit x "
                  "WHERE x.phrase_id = s.seed)) * 1e9 + 0.5) AS near FROM ph p CROSS JOIN seeds s LEFT JOIN punit a ON a.phrase_id = p.phrase_id "
                  "LEFT JOIN punit b ON b.phrase_id = s.seed AND b.b = a.b GROUP BY p.phrase_id, s.cluster, s.seed"),
    ("placed", "SELECT phrase_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY near DESC, cluster) AS rn FROM closeness) WHERE rn = 1"),
    ("clustered", "SELECT * FROM ph JOIN placed USING (phrase_id) JOIN psize USING (phrase_id)"),
    ("cstats", f"SELECT cluster, {milli('sum(hate_count)', 'sum(total_frequency)')} AS ratio_milli FROM clustered GROUP BY cluster"),
    ("idx", "SELECT phrase_id, cluster, ratio_milli, sq FROM clustered JOIN cstats USING (cluster)"),
]

# --- dense fixtures: vectors as phrases, blends of neighbours as queries ---

DENSE = [
    ("n", "SELECT count(*) AS n FROM embeddings"),
    ("blend", "SELECT a.vec_id AS q, list_transform(list_zip(a.embedding, b.embedding), lambda z: "
              "s * z[1]::DOUBLE + (1.0::DOUBLE - s) * z[2]::DOUBLE) AS v "
              "FROM (SELECT *, [1.0, 0.85, 0.75, 0.65, 0.55][(vec_id % 5 + 1)::INT]::DOUBLE AS s FROM embeddings) a, n, embeddings b WHERE b.vec_id = (a.vec_id + 1) % n"),
    ("unit", "SELECT q, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM blend"),
]


def dense_search(k, queries="unit", extra="true", ratio="NULL::BIGINT"):
    return [("near_all", f"SELECT u.q, e.vec_id AS phrase_id, e.label AS cluster, {r('list_inner_product(u.v, e.embedding::DOUBLE[])', 9)} AS sim "
                         f"FROM {queries} u CROSS JOIN embeddings e WHERE {extra}"),
            ("near", f"SELECT q, rank, phrase_id, cluster, {r('sim', 6)} AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, phrase_id) AS rank "
                     f"FROM near_all) WHERE rank <= {k}")]


VECTOR_PHRASES = [("vp", "SELECT doc_id AS phrase_id, doc_id::VARCHAR AS phrase, (quality + toxic + 1)::BIGINT AS total_frequency, quality::BIGINT AS hate_count, "
                         "(1 - quality)::BIGINT AS non_hate_count, e.label::BIGINT AS cluster FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id")]
DENSE_STATS = VECTOR_PHRASES + [("dstats", f"SELECT cluster, {milli('sum(hate_count)', 'count(*)')}::BIGINT AS ratio_milli FROM vp WHERE cluster IS NOT NULL GROUP BY cluster")]


def dense_facts(k, limit="true"):
    return DENSE + DENSE_STATS + dense_search(k) + [
        ("mapped", f"SELECT near.*, ratio_milli FROM near LEFT JOIN (SELECT * FROM dstats WHERE {limit}) d USING (cluster)")] + facts("mapped", "f")


def samples(source):
    return ("SELECT cluster, string_agg(phrase, ', ' ORDER BY rn) AS sample_phrases FROM (SELECT cluster, phrase, row_number() OVER "
            f"(PARTITION BY cluster ORDER BY total_frequency DESC, phrase) AS rn FROM {source} WHERE cluster IS NOT NULL) WHERE rn <= 3 GROUP BY cluster")


def second_extraction():
    """Candidates and diverse phrases of texts2, under their own names."""
    renamed = {"texts": "texts2", "gated": "gated2", "tok": "tok2", "tf": "tf2", "tsq": "tsq2", "seq": "seq2", "grams": "grams2",
               "pw": "pw2", "hits": "hits2", "cand": "cand2"}
    out = []
    for name, body in candidates(FULL) + mmr_steps():
        for old, new in renamed.items():
            body = re.sub(rf"(FROM|JOIN) {old}\b", rf"\1 {new}", body)
        out.append((renamed.get(name, name), body))
    return out


def explained_sql(rows, key, final):
    ctes = [("q_rows", rows)] + LEXICAL + [
        ("texts2", "SELECT md5(text) AS k, any_value(text) AS text FROM q_rows WHERE text IS NOT NULL GROUP BY 1")] + second_extraction()
    ctes += [("dp", "SELECT DISTINCT phrase FROM diverse")] + hashed("dp", "phrase", "phrase", "dpvec")
    ctes += lexical_search("dp", "phrase", "dpvec", 5, "pn") + facts("pn", "pf2") + phrase_verdict("pf2", "pv", 5)
    ctes += [("wt", "SELECT * FROM texts2 WHERE k IN (SELECT k FROM diverse)")] + hashed("wt", "k", "text", "tvec")
    ctes += lexical_search("wt", "k", "tvec", 10, "tn") + facts("tn", "tf3") + text_verdict("tf3", "tv", 10)
    return with_(ctes, final.format(key=key))


FLAT = (f"SELECT {{key}}, coalesce(t.overall_classification, 'Unable to classify') AS overall_classification, "
        f"coalesce(t.summary, 'No phrases could be extracted for analysis.') AS summary, {r('t.similarity_confidence', 6)} AS similarity_confidence, "
        f"t.avg_hate_ratio, t.threshold, d.rank, d.phrase, d.score, v.cluster_id, v.hate_ratio, v.classification, {r('v.confidence', 6)} AS confidence, "
        f"v.low_confidence FROM q_rows LEFT JOIN tv t ON t.q = md5(text) LEFT JOIN diverse d ON d.k = md5(text) LEFT JOIN pv v ON v.q = d.phrase "
        f"WHERE text IS NOT NULL")

DOC_ROWS = "SELECT doc_id, text FROM documents"


def all_sql() -> dict[str, str]:
    sql = {}
    sql["corpus_normalised"] = with_(corpus(), "SELECT doc_id, text, label::BIGINT AS label FROM corpus")
    sql["label_rejects"] = ("SELECT doc_id, CASE WHEN text IS NULL THEN 'missing text' ELSE 'invalid label' END AS reason "
                            "FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NULL OR quality IS NULL")
    sql["label_codes"] = ("SELECT quality::BIGINT AS quality, dense_rank() OVER (ORDER BY quality) - 1 AS code, quality::VARCHAR AS name, "
                          "count(*) AS docs FROM labels GROUP BY quality")
    sql["csv_round_trip"] = with_(corpus(), "SELECT text, label::BIGINT AS label FROM corpus")
    sql["snapshot_round_trip"] = sql["corpus_normalised"]
    sql["ngram_band"] = (f"SELECT doc_id, n::BIGINT AS n_words, {BANDED[0]}::BIGINT AS max_n, length(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')) >= 3 AS long_enough, "
                         "CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview "
                         f"FROM (SELECT *, len(regexp_extract_all(text, '[^{WS}]+')) AS n FROM documents)")
    sql["stop_word_usage"] = with_(STOP, "SELECT word, count(t) AS uses FROM stop LEFT JOIN (SELECT unnest(regexp_extract_all(lower(text), "
                                         r"'[\p{L}\p{N}_]{2,}')) AS t FROM documents) ON t = word GROUP BY word")
    sql["relevant_phrases"] = with_(counted(), f"SELECT phrase, list_has_any(string_split(phrase, ' '), [{words(BOOST_WORDS)}]) AS relevant FROM counts")
    cand = corpus() + STOP + CORPUS_TEXTS + candidates(BANDED)
    sql["candidate_ngrams"] = with_(cand, "SELECT k AS text_key, n::BIGINT AS n, count(*) AS candidates, min(phrase) AS first_phrase, "
                                          "max(phrase) AS last_phrase FROM grams GROUP BY ALL")
    sql["phrase_scores"] = with_(cand, "SELECT k AS text_key, phrase, score FROM cand")
    sql["top_candidates"] = with_(cand + TOP, "SELECT k AS text_key, rank, phrase, score FROM top6")
    sql["boosted_phrases"] = with_(extraction(), "SELECT k AS text_key, rank, phrase, score FROM chosen")
    sql["phrase_frequency"] = with_(counted(), "SELECT * FROM counts")
    sql["phrase_report"] = with_(reported(), "SELECT * FROM report")
    sql["phrase_report_quality"] = with_(reported("quality"), "SELECT * FROM report")
    sql["band_counts"] = with_(reported("quality"), "SELECT hate_indicator, count(*) AS phrases FROM report GROUP BY 1")
    sql["stop_phrase_filter"] = with_(counted(), f"SELECT phrase, total_frequency FROM counts WHERE lower(phrase) NOT IN ({words(RELEVANT_WORDS)})")
    doc_cand = STOP + DOC_TEXTS + candidates(FULL)
    sql["mmr_phrases"] = with_(doc_cand + mmr_steps(), "SELECT k AS text_key, rank, phrase, score FROM diverse")
    sql["distinct_text_reuse"] = with_(STOP + DOC_TEXTS + candidates(BANDED) + TOP + BOOST,
                                       "SELECT doc_id, rank, phrase, score FROM documents JOIN chosen ON k = md5(text)")
    split = corpus() + SPLIT
    sql["stratified_split"] = with_(split, "SELECT doc_id, label::BIGINT AS label, split FROM split")
    sql["split_counts"] = with_(split, "SELECT split, label::BIGINT AS label, count(*) AS docs FROM split GROUP BY ALL")
    sql["fixed_sample"] = ("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS rn FROM embeddings) "
                           "WHERE rn <= (SELECT floor(0.1 * count(*)) FROM embeddings)")
    pairs = split + pair_sql("train", TRAIN_CAP)
    sql["same_class_pairs"] = with_(pairs, "SELECT * FROM pairs WHERE kind <> 'cross'")
    sql["cross_class_pairs"] = with_(pairs, "SELECT * FROM pairs WHERE kind = 'cross'")
    sql["pair_counts"] = with_(pairs, "SELECT kind, score, count(*) AS pairs FROM pairs GROUP BY ALL")
    val = split + pair_sql("test", "count(*)")
    sql["validation_pairs"] = with_(val, "SELECT * FROM pairs")
    sql["pair_correlation"] = with_(
        val + STOP + [("pt", "SELECT DISTINCT text FROM (SELECT text_a AS text FROM pairs UNION ALL SELECT text_b FROM pairs)")]
        + hashed("pt", "text", "text", "pv") + [
            ("sq", "SELECT text, sum(c * c) AS sq FROM pv GROUP BY text"),
            ("duo", "SELECT DISTINCT text_a, text_b FROM pairs"),
            ("dots", "SELECT text_a, text_b, sum(a.c * b.c) AS dot FROM duo JOIN pv a ON a.text = text_a JOIN pv b ON b.text = text_b AND a.b = b.b GROUP BY ALL"),
            ("cos", "SELECT score, CASE WHEN x.sq * y.sq > 0 THEN coalesce(dot, 0)::DOUBLE / sqrt((x.sq * y.sq)::DOUBLE) ELSE 0 END AS cosine FROM pairs "
                    "LEFT JOIN dots USING (text_a, text_b) LEFT JOIN sq x ON x.text = text_a LEFT JOIN sq y ON y.text = text_b"),
            ("ranked", "SELECT score, cosine, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs, "
                       "rank() OVER (ORDER BY cosine) + (count(*) OVER (PARTITION BY cosine) - 1) / 2 AS rc FROM cos")],
        f"SELECT count(*) AS pairs, {r('corr(score, cosine)', 6)} AS pearson, {r('corr(rs, rc)', 6)} AS spearman FROM ranked")
    sql["normalise_vectors"] = with_(DENSE, f"SELECT q AS q_id, i, {r('value', 6)} AS value FROM (SELECT q, unnest(v) AS value, "
                                            "generate_subscripts(v, 1) - 1 AS i FROM unit)")
    sql["hashed_embedding"] = with_(STOP + DOC_TEXTS + hashed("texts", "k", "text", "v"), "SELECT k AS text_key, b::BIGINT AS i, c::DOUBLE AS value FROM v")
    sql["function_embedding"] = (
        "WITH l AS (SELECT item_id, i, (length(text) - length(replace(text, chr((97 + i)::INT), '')))::DOUBLE AS c FROM benchmark, range(26) t(i)) "
        f"SELECT item_id, i, {r('CASE WHEN sq > 0 THEN c / sqrt(sq) ELSE 0 END', 4)} AS value FROM l JOIN (SELECT item_id, sum(c * c) AS sq FROM l GROUP BY 1) USING (item_id)")
    sql["consistency_check"] = ("SELECT count(*) FILTER (doc_id IS NOT NULL AND vec_id IS NOT NULL) AS matched, count(*) FILTER (vec_id IS NULL) AS without_vector, "
                                "count(*) FILTER (doc_id IS NULL) AS without_phrase FROM labels FULL JOIN embeddings ON vec_id = doc_id")
    near = "SELECT q AS q_id, rank, phrase_id, sim AS similarity FROM near"
    sql["topk_neighbours"] = with_(DENSE + dense_search(10), near)
    raw = [("raw", "SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings")]
    sql["other_neighbours"] = with_(raw + dense_search(5, "raw", "u.q <> e.vec_id"), near)
    sql["cluster_join"] = with_(VECTOR_PHRASES, "SELECT phrase_id, total_frequency, cluster FROM vp")
    sql["cluster_stats"] = with_(
        VECTOR_PHRASES + [("s", samples("vp")), ("g", "SELECT cluster, count(*) AS size, sum(total_frequency)::BIGINT AS total_phrase_frequency, "
                                                    "avg(total_frequency) AS avg_phrase_frequency, sum(hate_count)::BIGINT AS hate_count, "
                                                    "sum(non_hate_count)::BIGINT AS non_hate_count FROM vp WHERE cluster IS NOT NULL GROUP BY cluster")],
        f"SELECT g.*, ratio_milli / 1000 AS cluster_hate_ratio, CASE WHEN hate_count / size > 0.66::DOUBLE THEN 'HIGH HATE' WHEN hate_count / size < 0.33::DOUBLE "
        f"THEN 'LOW HATE' ELSE 'NEUTRAL' END AS hate_indicator, sample_phrases FROM (SELECT *, {milli('hate_count', '(hate_count + non_hate_count)')} AS ratio_milli FROM g) g JOIN s USING (cluster)")
    sql["cluster_samples"] = with_(LEXICAL, samples("clustered"))
    sql["unlabelled_cluster_stats"] = with_(VECTOR_PHRASES, "SELECT cluster, count(*) AS size, sum(total_frequency)::BIGINT AS total_phrase_frequency, "
                                            "NULL::DOUBLE AS cluster_hate_ratio, 'N/A' AS hate_indicator FROM vp WHERE cluster IS NOT NULL GROUP BY cluster")
    sql["percent_round_trip"] = with_(DENSE_STATS, "SELECT cluster, (ratio_milli // 10)::VARCHAR || '.' || (ratio_milli % 10)::VARCHAR || '%' AS hate_ratio, "
                                                   "((ratio_milli // 10)::VARCHAR || '.' || (ratio_milli % 10)::VARCHAR)::DOUBLE / 100 AS parsed, ratio_milli FROM dstats")
    sql["last_cluster_wins"] = with_(corpus("quality"), "SELECT md5(text) AS text_key, arg_max(label, doc_id)::BIGINT AS label FROM corpus GROUP BY 1")
    means = [("cells", "SELECT label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"),
             ("means", "SELECT cluster, i, avg(x) AS value FROM cells GROUP BY ALL")]
    sql["lloyd_step"] = with_(means, f"SELECT cluster::BIGINT AS cluster, i, {r('value', 6)} AS value FROM means")
    sql["assign_centroid"] = with_(
        means + [("cents", "SELECT cluster, list(value ORDER BY i) AS c FROM means GROUP BY cluster"),
                 ("close", "SELECT vec_id, cluster, floor((list_inner_product(embedding::DOUBLE[], c) - list_inner_product(c, c) / 2) * 1e9 + 0.5) AS near FROM embeddings, cents")],
        "SELECT vec_id AS phrase_id, cluster::BIGINT AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY near DESC, cluster) AS rn FROM close) WHERE rn = 1")
    sql["cluster_sizes"] = "SELECT label::BIGINT AS cluster, count(*) AS size FROM embeddings GROUP BY 1"
    sql["corpus_summary"] = with_(LEXICAL, "SELECT count(*) AS phrase_rows, count(DISTINCT phrase) AS distinct_phrases, count(DISTINCT cluster) AS clusters, "
                                           "count(*)::DOUBLE / count(DISTINCT cluster) AS mean_cluster_size FROM clustered")
    sql["neighbour_ratio"] = with_(dense_facts(10), "SELECT q AS q_id, milli_sum, mapped, mean AS mean_ratio, top AS top_similarity, nearest::BIGINT AS nearest_cluster FROM f")
    sql["adaptive_threshold"] = with_(dense_facts(10), f"SELECT q AS q_id, top AS top_similarity, {THRESHOLD} AS threshold FROM f")
    sql["dense_phrase_verdicts"] = with_(dense_facts(5) + phrase_verdict("f", "v", 5), "SELECT q AS q_id, * EXCLUDE (q) FROM v")
    sql["dense_text_verdicts"] = with_(dense_facts(10) + text_verdict("f", "v", 10), "SELECT q AS q_id, * EXCLUDE (q) FROM v")
    sql["unable_to_classify"] = with_(
        dense_facts(5, "cluster < 5") + phrase_verdict("f", "v", 5) + text_verdict("f", "t", 5),
        "SELECT q AS q_id, classification, classification_method, hate_ratio, overall_classification, avg_hate_ratio, similarity_confidence, threshold FROM v JOIN t USING (q)")
    sql["classify_phrase"] = with_(
        [("ask", "SELECT phrase FROM (" + with_(counted("toxic"), "SELECT phrase FROM counts") + ")")] + LEXICAL + hashed("ask", "phrase", "phrase", "avec")
        + lexical_search("ask", "phrase", "avec", 5, "pn") + facts("pn", "f") + phrase_verdict("f", "v", 5),
        f"SELECT q AS phrase, * EXCLUDE (q) REPLACE ({r('confidence', 6)} AS confidence) FROM v")
    sql["listed_neighbours"] = with_(
        [("ask", "SELECT phrase FROM (" + with_(counted("quality"), "SELECT phrase FROM counts") + ")")] + LEXICAL + hashed("ask", "phrase", "phrase", "avec")
        + lexical_search("ask", "phrase", "avec", 5, "pn"),
        f"SELECT q AS phrase, rank, ph.phrase AS near_phrase, {r('sim', 6)} AS similarity FROM pn JOIN ph USING (phrase_id)")
    sql["classify_text"] = with_(
        LEXICAL + [("ask", "SELECT md5(text) AS k, any_value(text) AS text FROM documents GROUP BY 1")] + hashed("ask", "k", "text", "avec")
        + lexical_search("ask", "k", "avec", 10, "tn") + facts("tn", "f") + text_verdict("f", "v", 10),
        f"SELECT q AS text_key, overall_classification, {r('similarity_confidence', 6)} AS similarity_confidence, avg_hate_ratio, threshold, summary FROM v")
    sql["explained_result"] = explained_sql(DOC_ROWS, "doc_id", FLAT)
    sql["explained_conversations"] = explained_sql(
        "SELECT concat_ws(':', conv_id, turn, role) AS turn_id, text FROM conversations", "turn_id",
        "SELECT {key}, coalesce(t.overall_classification, 'Unable to classify') AS overall_classification, (SELECT count(*) FROM diverse d WHERE d.k = md5(text)) AS phrases, "
        "coalesce(t.summary, 'No phrases could be extracted for analysis.') AS summary FROM q_rows LEFT JOIN tv t ON t.q = md5(text) WHERE text IS NOT NULL")
    sql["stream_phrase_counts"] = sql["phrase_frequency"]
    sql["extraction_progress"] = sql["stream_progress"] = with_(
        extraction(), "SELECT count(*) AS texts, 0::BIGINT AS missing_texts, count(*) FILTER (md5(text) NOT IN (SELECT k FROM chosen)) AS texts_without_phrases, "
                      "(SELECT count(*) FROM corpus JOIN chosen ON k = md5(text)) AS phrases FROM corpus")
    sql["distinct_estimate"] = with_(counted("quality"), "SELECT count(DISTINCT phrase) AS distinct_phrases, true AS estimate_within_5_percent FROM counts")
    sql["embedding_errors"] = (
        "SELECT doc_id AS id, 'embedding' AS stage, 'ValueError: text of ' || length(text) || ' characters' AS error, "
        "(SELECT count(*) FROM documents WHERE coalesce(length(text), 0) <= 5000) AS embedded FROM documents WHERE length(text) > 5000")
    sql["stream_classify"] = sql["explained_result"]
    return sql
