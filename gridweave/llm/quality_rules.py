"""Host-level quality rules, DataFrame functions only.

Each text gets its base rules; failures are counted per host, each host's failure rate is shrunk
towards an empirical beta prior, and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import materialize, text_or_empty
from gridweave.operators._joins import broadcast_if_small

_SYMBOLS = "[#*$%&|<>]"


def _repeat_words(df: DataFrame, words: str, out: str, hash_bits: int = 64) -> DataFrame:
    """Add the number of words inside 3-word windows that occur twice or more in the row.

    Every window becomes one long: the high bits of its hash over its place, so one sort of longs
    puts equal windows side by side.  Neighbours are then compared word by word; where two
    different windows share their hash bits (about never), the row is counted again from sorted
    strings.  ``hash_bits`` is lowered in tests to force that.
    """
    w, hashes, high, keys, twin = (f"{out}__{x}" for x in ("w", "hashes", "high", "keys", "twin"))
    wide = F.lit(-1 << (64 - hash_bits)).cast("long")
    n_windows = F.greatest(F.size(w) - 2, F.lit(0))

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.bitwise_not(high)).cast("int")

    df = df.withColumn(w, F.col(words)).withColumn(hashes, F.transform(w, lambda a: F.xxhash64(a)))
    df = df.withColumn(high, F.expr(f"-shiftleft(1L, length(bin(cast(size({w}) AS BIGINT))))"))
    key = F.transform(F.slice(hashes, F.lit(1), n_windows), lambda a, i: F.coalesce(
        F.xxhash64(a, F.get(hashes, i + 1), F.get(hashes, i + 2)).bitwiseAND(wide).bitwiseAND(F.col(high)) + i,
        F.lit(0).cast("long")))
    df = df.withColumn(keys, F.sort_array(key))
    # j of every key whose right neighbour has the same hash bits
    df = df.withColumn(twin, F.when(n_windows > 1, F.filter(F.sequence(F.lit(0), n_windows - 2), lambda j: F.get(
        keys, j).bitwiseXOR(F.get(keys, j + 1)).bitwiseAND(F.col(high)) == 0)).otherwise(F.array().cast("array<int>")))
    differ = F.exists(twin, lambda j: ~_same_window(w, place(F.get(keys, j)), place(F.get(keys, j + 1))))
    places = F.concat(F.transform(twin, lambda j: place(F.get(keys, j))), F.transform(twin, lambda j: place(F.get(keys, j + 1))))
    text = F.sort_array(F.transform(F.slice(w, F.lit(1), n_windows), lambda a, i: F.struct(
        F.concat_ws(" ", a, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    exact = F.transform(F.array(text), lambda e: F.transform(F.filter(
        e, lambda x, j: (F.get(e, j - 1)["g"] == x["g"]) | (F.get(e, j + 1)["g"] == x["g"])), lambda x: x["i"]))[0]
    at = f"{out}__at"
    df = df.withColumn(at, F.sort_array(F.array_distinct(F.when(differ, exact).otherwise(places))))
    covered = F.aggregate(F.transform(at, lambda p, j: F.coalesce(F.least(F.get(at, j + 1) - p, F.lit(3)), F.lit(3))),
                          F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn(out, covered).drop(w, hashes, high, keys, twin, at)


def _same_window(words: str, i: Column, j: Column) -> Column:
    same = [F.get(words, i + d) == F.get(words, j + d) for d in range(3)]
    return same[0] & same[1] & same[2]


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               min_words: int = 50, max_repeat_pct: int = 50, hash_bits: int = 64, carry: bool = False) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed).

    One output row per input row, repeated rows too.  Null text counts as empty, so it fails by
    its number of words.  Columns other than the three named are not read; with ``carry`` the
    whole input row goes along as the struct ``row``.
    """
    own = [F.struct("*").alias("row")] if carry else []
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                     text_or_empty(text_col).alias("text"), *own)
    df = df.withColumn("words", F.array_remove(F.split("text", r"[ \t-\r]+"), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    df = df.select(
        "doc_id", "host", *(["row"] if carry else []), "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    df = _repeat_words(df, "words", "n_repeat_words", hash_bits).drop("words")
    return df.withColumn("base_failed", (F.col("n_words") < min_words)
                         | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) of the hosts' failure rates by moments; ``hosts`` has n and failed per host.

    Where the hosts differ no more than chance allows, the prior is as strong as all their
    documents together; without hosts it is (0.5, 0.5).
    """
    tot = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("failed").alias("k"),
                    F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not tot["n"]:
        return 0.5, 0.5
    mean = (tot["k"] + 0.5) / (tot["n"] + 1)
    rate = F.col("failed") / F.col("n")
    spread = hosts.agg(F.sum(F.col("n") * F.pow(rate - mean, 2)).alias("s")).first()["s"]
    room = tot["n"] - tot["nn"] / tot["n"]
    between = (spread - (tot["h"] - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    strength = mean * (1 - mean) / between - 1 if between > 0 else float(tot["n"])
    strength = min(max(strength, 1.0), float(tot["n"]))
    return mean * strength, (1 - mean) * strength


def host_verdicts(features: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, host_rejected): one row per non-null host.

    ``rate`` is the posterior mean (failed + alpha) / (n + alpha + beta); a host above
    ``max_host_rate`` is rejected.  Counting is partially aggregated, so one huge host is one row
    per task before the shuffle.
    """
    hosts = (features.where("host is not null").groupBy("host")
             .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + alpha) / (F.col("n") + (alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("host_rejected", rate > max_host_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_host_rate: float = 0.5, **rules) -> DataFrame:
    """The base columns of every row with host_n, host_failed, host_rejected and ``kept``.

    ``kept`` is false where the base rules or the host fail.  A row without a host is judged by
    its base rules alone and counts for no host; an empty table gives no rows.  The base columns
    are written once to the shared folder, so texts are read once.
    """
    feats = materialize(base_rules(docs, id_col, text_col, host_col, **rules), "quality-rules")
    verdicts = materialize(host_verdicts(feats, max_host_rate), "host-verdicts")
    return (feats.join(broadcast_if_small(verdicts).select("host", F.col("n").alias("host_n"), F.col("failed").alias("host_failed"),
                                       "host_rejected"), "host", "left")
            .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))


def keep_good(docs: DataFrame, max_host_rate: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, all columns as they were.

    Every row is judged by itself, repeated rows and rows without an id too.  The rows are written
    once with their verdicts, so the texts are neither read twice nor shuffled.
    """
    flagged = materialize(base_rules(docs, carry=True, **options).select("row", "host", "base_failed"), "quality-rows")
    bad = materialize(host_verdicts(flagged, max_host_rate).where("host_rejected").select("host"), "bad-hosts")
    return flagged.where(~F.col("base_failed")).join(broadcast_if_small(bad), "host", "left_anti").select("row.*")


def query(spark, sf_dir):
    """Host-level quality rules over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "host_n", "host_failed", "host_rejected")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
b AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT *, (k + 0.5::DOUBLE) / (n + 1) AS mean FROM (SELECT count(*) AS h, sum(n) AS n, sum(failed) AS k, sum(n::DOUBLE * n) AS nn FROM h)),
s AS (SELECT (sum(h.n * pow(h.failed::DOUBLE / h.n - m.mean, 2)) - (any_value(m.h) - 1) * any_value(m.mean) * (1 - any_value(m.mean)))
             / nullif(any_value(m.n) - any_value(m.nn) / any_value(m.n), 0) AS between FROM h, m),
p AS (SELECT mean, least(greatest(CASE WHEN between > 0 THEN mean * (1 - mean) / between - 1 ELSE n::DOUBLE END, 1), n::DOUBLE) AS strength FROM m, s),
v AS (SELECT h.source, h.n AS host_n, h.failed AS host_failed,
             (h.failed + p.mean * p.strength) / (h.n + p.strength) > 0.5 AS host_rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rejected, false) AS kept, host_n, CAST(host_failed AS BIGINT) AS host_failed,
       coalesce(host_rejected, false) AS host_rejected
FROM f LEFT JOIN v USING (source)
"""
