"""Secret scans in DataFrame operations only: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least WINDOW token characters, padding included. A window of WINDOW characters slides over it; S, the sum of
c * log2(c) over the character counts c in the window, is kept up to date from the counts of the character that leaves
and the one that enters, and the entropy is log2(WINDOW) - S / WINDOW. What counts as high depends on the class of the
characters in the window: hexadecimal digits only, or any token characters. A window must hold a digit and a letter.
Candidates that an allow-list pattern matches are suppressed, and so are spans that touch one of a fixed pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The kinds and their patterns; the second number is the group whose length counts, the third that length.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),      # maximal runs of the length that counts
)
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"       # a sign of equality only pads, so a name before it is another string
PART = 256              # places found are kept in parts, so that adding one copies no long array
HEX_BITS, TOKEN_BITS = 3.0, 3.7
# Allowed: words only, numbers only, identifiers made of words, placeholders, UUIDs, long runs of one character.
ALLOWED = (
    r"^[A-Za-z]+$", r"^[0-9+/_=-]+$", r"^[A-Za-z]++([_/-][A-Za-z]++)*+[0-9]{0,4}$", r"(?i)example|placeholder|changeme|lorem|your[_-]?(key|token)",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(.)\1{7}",
)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, size, match) of the matches from left to right; code points, end exclusive, size of the group.

    The pieces between the matches and the matches themselves alternate, so the places are running sums of lengths.
    """
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(pieces, whole, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    one = "array<struct<start:int,end:int>>"

    def step(state, x):
        start = state["at"] + x["p"]
        place = F.array(F.struct(start.alias("start"), (start + x["m"]).alias("end")))
        full = F.size(state["part"]) >= PART
        return F.struct((start + x["m"]).alias("at"), F.when(full, place).otherwise(F.concat(state["part"], place)).alias("part"),
                        F.when(full, F.concat(state["out"], F.array(state["part"]))).otherwise(state["out"]).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(one).alias("part"), F.array().cast(f"array<{one}>").alias("out"))
    places = F.aggregate(F.slice(lengths, 1, F.size(whole)), begin, step, lambda state: F.concat(F.flatten(state["out"]), state["part"]))
    both = F.arrays_zip(places.alias("place"), F.transform(sized, F.length).alias("size"), whole.alias("match"))
    found = F.transform(both, lambda x: F.struct(x["place"]["start"].alias("start"), x["place"]["end"].alias("end"), x["size"].alias("size"), x["match"].alias("match")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,size:int,match:string>>"))


def _f(count: Column) -> Column:
    """c * log2(c) for a count of the window."""
    return F.element_at(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)]), count + 1)


def high_entropy(candidate: Column) -> Column:
    """(lo, hi): from the start of the first to the end of the last window of high entropy, 0 and 0 if there is none."""
    def count(window, char):
        return F.length(window) - F.length(F.replace(window, char))

    def kind(char, pattern):
        return F.when(char.rlike(pattern), 1).otherwise(0)

    def step(characters, state, i):
        enters, full = F.get(characters, i - 1), i > WINDOW
        leaves = F.when(full, F.substring(state["w"], 1, 1)).otherwise("")
        n = count(state["w"], leaves)
        rest = F.when(full, F.substring(state["w"], 2, WINDOW)).otherwise(state["w"])
        c = count(rest, enters)
        s = state["s"] + F.when(full, _f(n - 1) - _f(n)).otherwise(0.0) + _f(c + 1) - _f(c)

        def running(name, pattern):
            return state[name] + kind(enters, pattern) - F.when(full, kind(leaves, pattern)).otherwise(0)
        odd, digits, letters = running("odd", "[^0-9a-fA-F]"), running("digits", "[0-9]"), running("letters", "[A-Za-z]")
        bits = F.round(math.log2(WINDOW) - s / WINDOW, 9)
        high = (i >= WINDOW) & (digits > 0) & (letters > 0) & (bits >= F.when(odd == 0, HEX_BITS).otherwise(TOKEN_BITS))
        return F.struct(F.concat(rest, enters).alias("w"), s.alias("s"), odd.alias("odd"), digits.alias("digits"), letters.alias("letters"),
                        F.when(high & (state["hi"] == 0), i - WINDOW).otherwise(state["lo"]).alias("lo"), F.when(high, i).otherwise(state["hi"]).alias("hi"))

    start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("s"), *[F.lit(0).alias(x) for x in ("odd", "digits", "letters", "lo", "hi")])
    # Characters come from an array: to find one in a text takes longer the further behind it is. Its lambda binds it once.
    run = F.transform(F.array(F.split(candidate, "")), lambda characters: F.aggregate(
        F.sequence(F.lit(1), F.length(candidate)), start, lambda state, i: step(characters, state, i), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))))
    return F.element_at(run, 1)


def _at_least(least: int):
    return lambda x: x["size"] >= least


def _spans(found: Column, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in PATTERNS], F.lit("entropy"))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans: one row per row of documents (doc_id, text).

    spans lists kind:start:end by start, then by kind in the order assign, access, hex, entropy, joined by commas.
    A null text is scanned as an empty one and has no span.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern, group, least in PATTERNS:
        rows = rows.withColumn(kind, F.filter(matches(F.col("text"), pattern, group), _at_least(least)))
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    runs = F.filter(matches(F.col("text"), CANDIDATE), lambda x: ~x["match"].rlike(allowed) & x["match"].rlike("[0-9]"))
    rows = rows.withColumn("runs", F.transform(runs, lambda x: F.struct(x["start"].alias("start"), high_entropy(x["match"]).alias("h"))))
    base = rows.withColumn("base", F.concat(*[_spans(F.col(k), i) for i, (k, *_) in enumerate(PATTERNS)])).select(
        "doc_id", "base", "runs", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in PATTERNS])
    high = F.transform(F.filter("runs", lambda x: x["h"]["hi"] > 0), lambda x: F.struct(
        (x["start"] + x["h"]["lo"]).alias("start"), F.lit(len(PATTERNS)).alias("kind"), (x["start"] + x["h"]["hi"]).alias("end")))
    more = F.filter(high, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return base.withColumn("more", more).select(
        "doc_id", *[f"n_{k}" for k, *_ in PATTERNS], F.size("more").cast("long").alias("n_entropy"),
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.concat("base", "more")).alias("spans"))
