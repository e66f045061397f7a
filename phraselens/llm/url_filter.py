"""URL filter: allow and block rules by host and path; logistic regression on hashed character n-grams judges the rest.

A url's host and path are one string with a mark before, between and behind them; its features are the n-grams of 3 to 5
bytes of that string, hashed to BUCKETS numbers. A weight vector is learned from a small table of labelled urls by Newton
steps on the regularised likelihood, in the space of the labelled rows (so the system has as many unknowns as rows, not buckets);
applying it is one gather and one sum per batch of urls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phraselens.llm.common import mixed, shared
from phraselens.session import written

SIZES = (3, 4, 5)               # bytes of an n-gram
BUCKETS = 1 << 18
LABELLED = 4_000                # rows to learn from, at most; the smallest hashes of a larger table
PENALTY, STEPS = 1e-5, 40
BROADCAST_RULES = 50_000         # of at most a url's length each
ALLOW, BLOCK = "allow", "block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Urls that a person would block or allow at sight, the small labelled table that is used if none is given.
BLOCK_SITES = (
    "casino-royal.com/play casino-slots.net/en/bonus online-casino.org/win win-casino.net/en/12 best-slots.com/jackpot poker-win.org/table "
    "free-bets-now.com/en/offer bet-today.net/odds sports-bets.org/en/88 freebets.net/signup betting-tips.com/free lotto-win.org/en/7 "
    "cheap-meds.org/en/viagra pills-store.com/cheap cheappills.net/order buy-pills.org/de/31 pharma-cheap.com/fr/pills diet-pills.net/es/4 "
    "spam-mail.net/list spamhost.org/en/9 link-farm.com/en/links seo-farm.org/links content-farm.net/en/55 spamfarm.com/page "
    "ads-server.net/click track-ads.com/pixel adtrack.org/en/3 click-track.net/redirect banner-ads.org/view popads.com/track ads-click.com/en/ad track-clicks.org/ads "
    "adult-video.net/x adult-cams.org/en/live xxx-adult.com/en/2 x-adult.org/video sex-chat.net/de/17 hot-cams.com/fr/live "
    "free-money.net/win win-prize.org/claim crack-keys.com/download warez-free.net/en/crack cheap-loans.org/fast replica-watches.com/cheap").split()
ALLOW_SITES = (
    "daily-news.com/en/world city-times.org/article/2031 example.org/about weather.net/en/today science-review.org/en/411 museum.net/visit "
    "university.org/en/courses library.org/catalog history-blog.net/en/58 cooking.com/recipes/bread garden-notes.net/de/19 travel-diary.org/fr/72 "
    "open-maps.org/en/631 code-docs.net/reference/list school.org/en/timetable health-service.org/advice hospital.net/en/contact parks.org/trails "
    "theatre.net/es/programme film-review.com/en/204 music-lessons.org/piano chess-club.net/en/77 book-club.org/en/315 poetry.net/anthology "
    "wiki-notes.org/en/entry forum.net/en/thread/93 language-school.com/es/12 physics.org/de/lecture maths.net/en/538 biology.org/cells "
    "council.org/meetings transport.net/en/buses railway.org/fr/horaires energy-data.net/en/460 housing.org/rent jobs.net/en/1205 "
    "community.org/volunteer farm-museum.org/en/visit recipes.net/es/sopa photos.org/en/824 observatory.net/stars archive.org/en/1918").split()


NEUTRAL_PATHS = "/en/1204 /fr/88.html /de/40313/ /es/7 /en/55021 /en/9310.html / /page/3 /2024/05/18/ /en/671/ /de/2290 /fr/31777".split()
LEADS = ("", "www.", "blog.", "m.")


def seed_urls(spark) -> DataFrame:
    """The small labelled table: url, blocked. Each site comes with its own path and with neutral ones, so that the host decides."""
    sites = [(i, kind, site) for kind, sites in ((True, BLOCK_SITES), (False, ALLOW_SITES)) for i, site in enumerate(sites)]
    rows = [(f"https://{lead}{site}", kind) for _, kind, site in sites for lead in LEADS]
    rows += [(f"https://{lead}{site.split('/')[0]}{NEUTRAL_PATHS[(i + 5 * j) % len(NEUTRAL_PATHS)]}", kind) for i, kind, site in sites for j, lead in enumerate(LEADS)]
    return spark.createDataFrame(rows, "url string, blocked boolean")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rest_of(url: Column) -> Column:
    """What follows the first '://' of a url; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest_of(url), "^[^/?#]*+", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), "^[^/?#]*+([^?#]*+)", 1)


def parsed_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict -> rule, rule_host (A-Z lower-cased), rule_path, verdict; each rule once, block before allow.

    A rule is a host with a path; rules that are null, or whose verdict is neither allow nor block, do not count.
    """
    known = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
    split = known.select(lower_ascii(F.regexp_extract("rule", "^[^/]*+", 0)).alias("rule_host"), F.regexp_extract("rule", "^[^/]*+(?s:(.*))", 1).alias("rule_path"), "verdict")
    return split.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).select(
        F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_path", "verdict")


def suffixes(name: str) -> list[str]:
    """A host and its parent domains, longest first: a.b.c, b.c, c."""
    parts = name.split(".")
    return [name] + [x for i in range(1, len(parts)) if (x := ".".join(parts[i:]))]


class Rules:
    """Rules by host and path with the lengths that paths have, so that a url looks up few keys however many rules a host has."""

    def __init__(self, rows):
        self.verdicts = {(r["rule_host"], r["rule_path"]): r["verdict"] for r in rows}
        self.lengths = sorted({len(p) for _, p in self.verdicts}, reverse=True)


def _best_rule(rules, host_name: str, at: str) -> tuple[str | None, str | None]:
    """The longest rule that fits, ties to the longer host, and its verdict."""
    best = (-1, -1, None, None)
    for suffix in suffixes(host_name):
        for n in rules.lengths:
            verdict = rules.verdicts.get((suffix, at[:n])) if n <= len(at) else None
            if verdict:
                best = max(best, (len(suffix) + n, len(suffix), suffix + at[:n], verdict), key=lambda x: x[:2])
                break
    return best[2:]


def joined_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places(host, path), each once, and parsed rules -> host, path, rule, verdict of the places that a rule fits.

    For more rules than a broadcast should hold: the same lookups as equi-joins. A key meets one rule at most; where
    many places ask for the same key, Spark splits that partition of the join.
    """
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]     # at most as many as a url has characters
    parts = F.split("host", "\\.")
    names = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")), lambda x: (x != "") | (F.col("host") == ""))
    begins = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = places.select("host", "path", F.explode(names).alias("rule_host"), begins.alias("begins")).select("host", "path", "rule_host", F.explode("begins").alias("rule_path"))
    met = keys.join(rules, ["rule_host", "rule_path"])
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"))
    return met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best")).select("host", "path", "best.*")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of each text, all texts at once."""
    size = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(letters))       # bytes from here to the end of the text
    rows, buckets, code = [], [], np.zeros(len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, SIZES[-1] + 1):
            code = code[:len(letters) - n + 1] * np.uint64(257) + letters[n - 1:] + np.uint64(1)
            if n in SIZES:
                inside = left[:len(code)] >= n
                rows.append(row[:len(code)][inside])
                buckets.append((mixed(code[inside]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def marked(hosts: list[str], paths: list[str]) -> list[bytes]:
    return [f"^{h}|{p}$".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)]


def margins(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Sum of the weights of a text's n-grams over the root of their number, and the bias."""
    rows, buckets = grams(texts)
    n = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
    return np.bincount(rows, weights[buckets], len(texts)) / np.sqrt(n) + bias


class Model:
    """Weights and bias of a logistic regression that says how likely a url is to be blocked; 0 without labelled rows."""

    def __init__(self, texts: list[bytes], blocked: np.ndarray, penalty: float = PENALTY, steps: int = STEPS):
        self.weights, self.bias, self.learned = np.zeros(BUCKETS), 0.0, len(texts) > 0
        if not len(texts):
            return
        rows, buckets = grams(texts)
        used, column = np.unique(buckets, return_inverse=True)
        x = np.zeros((len(texts), len(used)))
        np.add.at(x, (rows, column), 1.0)
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        # The best weights are a combination of rows: with a = kernel's coefficients, margin = (K + 1) a, the 1 being the bias.
        kernel, a, y = x @ x.T + 1, np.zeros(len(texts)), blocked.astype(np.float64)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(kernel @ a, -50, 50)))
            slope = np.maximum(p * (1 - p), 1e-9)
            target = kernel @ a + (y - p) / slope
            new = np.linalg.solve(kernel + np.diag(penalty * len(y) / slope), target)
            done, a = np.abs(new - a).max() < 1e-10, new
            if done:
                break
        self.weights[used], self.bias = x.T @ a, float(a.sum())


def learn(labelled: DataFrame, most: int = LABELLED) -> Model:
    """A model from a table with url and blocked; rows where either is null do not count. Of a table with more than
    `most` rows those with the smallest hashes are used."""
    rows = labelled.where("url is not null and blocked is not null").select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), "blocked")
    drawn = rows.orderBy(F.xxhash64("h", "p"), "h", "p", "blocked").limit(most).collect()        # a top-k, not a sort
    return Model(marked([r["h"] for r in drawn], [r["p"] for r in drawn]), np.array([r["blocked"] for r in drawn], bool))


def _judge(sent_model, sent_rules, threshold: float):
    def judge(batches):
        model, rules = sent_model.value, sent_rules.value
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            score = 1 / (1 + np.exp(-np.clip(margins(marked(hosts, paths), model.weights, model.bias), -50, 50)))
            found = [_best_rule(rules, h, p) for h, p in zip(hosts, paths)]
            verdicts = [v or (BLOCK if s >= threshold and model.learned else ALLOW) for (_, v), s in zip(found, score.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(score)],
                [*batch.schema.names, "rule", "verdict", "score"])
    return judge


def filter_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of pages, which has page_id and url; other columns are ignored.

    rules has rule (host and path) and verdict (allow, block): the longest that fits decides, equally long ones by the longer host.
    A rule fits its host and all subdomains if the path starts with the rule's path. Elsewhere rule is null, and the url
    is blocked if score, the model's probability that it should be, is at least `threshold`. A url that is null or has no
    '://' has an empty host and path: no rule with a host fits, and the model judges the empty string. Without labelled
    rows score is 0.5 and what no rule decides is allowed. Repeated rows are answered each. Up to broadcast_rules rules
    travel with the model and nothing is shuffled; more are joined to the different places. Both give the same rows.
    """
    spark = pages.sparkSession
    model = learn(seed_urls(spark) if labelled is None else labelled)
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    parsed = parsed_rules(rules)
    listed = parsed.limit(broadcast_rules + 1).collect()
    few = len(listed) <= broadcast_rules
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in (("rule", T.StringType()), ("verdict", T.StringType()), ("score", T.DoubleType()))]])
    judged = rows.mapInArrow(_judge(shared(spark, model), shared(spark, Rules(listed if few else [])), threshold), schema)
    if few:
        return judged
    fits = joined_rules(written(rows.select("host", "path").distinct(), "url-places"), written(parsed, "url-rules"))
    both = judged.withColumnsRenamed({"rule": "no_rule", "verdict": "guess"}).join(fits, ["host", "path"], "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("verdict", "guess").alias("verdict"), "score")
