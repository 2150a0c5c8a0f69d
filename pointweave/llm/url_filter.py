"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that could name it, short hash
prefixes of these meet those of the rules in an equi-join, full digests confirm,
and the longest rule decides. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm._frames import ascii_lower, name

#: Rules up to this number are broadcast (about 100 bytes each); more are shuffled.
MAX_BROADCAST_RULES = 200_000
#: Hex digits of the short prefix: 4 bytes.
PREFIX_DIGITS = 8
#: Repeats of a row that are written out at once.
REPEATS = 4096
#: Parts into which a shuffled prefix is split.
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The host's suffixes of as many labels as rules have, before its path's prefixes of rules' lengths."""
    parts = F.char_length(host) - F.char_length(F.translate(host, ".", "")) + 1
    tails = [F.when((host != "") & (parts >= n), F.substring_index(host, ".", -n)) for n in labels]
    heads = [F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    # a null part makes a null expression
    every = F.array(*[F.sha2(F.concat(tail, head), 256) for tail in tails for head in heads])
    return F.filter(every, lambda x: x.isNotNull())


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judge every URL by the longest rule that fits.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits
    its host and all subdomains if the URL's path starts with its path. Of rules
    of one length the blocking one wins, then the smaller string. Returns one row
    per input row: the id, the url, ``host``, ``path``, ``rule`` (host and path of
    the rule, null without one) and ``verdict`` (``default`` without a rule).

    * A null URL, or one without ``://``, has an empty host and path and no rule.
    * A host or path of any length makes as many expressions as rules have numbers of
      labels and lengths of paths. An empty host has no suffixes; rules with a null part or an unknown verdict
      are refused or ignored: null parts never fit, other verdicts raise.
    * Repeated rows come back as often as they came; other columns are not kept.

    One exchange, on (id, url), serves the count of repeats and the choice of the
    longest rule. Rules are broadcast up to MAX_BROADCAST_RULES; beyond, the
    prefixes are shuffled with SALTS parts each, as ``com/`` may fit every URL.
    """
    clean = (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict"))
        .dropna(subset=["host", "path", "verdict"])
        .select(
            F.concat("host", "path").alias("rule"),
            F.char_length("path").alias("path_length"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
            F.col("verdict"),
        )
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    summary = clean.agg(
        F.count(F.lit(1)),
        F.collect_set("path_length"),
        F.count_if(~F.col("verdict").isin("allow", "block")),
        F.collect_set("labels"),
    ).first()
    if summary[2]:
        raise ValueError("a rule's verdict must be allow or block")
    lengths, labels = sorted(summary[1]) or [0], sorted(summary[3]) or [1]

    row = pages.select(F.col(name(id_col)).alias("_pw_id"), F.col(name(url_col)).alias("_pw_url"))
    once = row.groupBy("_pw_id", "_pw_url").agg(F.count(F.lit(1)).alias("_pw_n"))
    parts = once.withColumn("_pw_host", host_of(F.col("_pw_url"))).withColumn("_pw_path", path_of(F.col("_pw_url")))
    wide = parts.withColumn(
        "_pw_digest", F.explode_outer(_expressions(F.col("_pw_host"), F.col("_pw_path"), labels, lengths))
    )
    wide = wide.withColumn("_pw_prefix", F.substring("_pw_digest", 1, PREFIX_DIGITS))
    known = clean.select(
        F.col("prefix").alias("_pw_p"), F.col("digest").alias("_pw_d"), "rule", F.col("verdict").alias("_pw_v")
    )
    if summary[0] <= MAX_BROADCAST_RULES:
        met = wide.join(F.broadcast(known), F.col("_pw_prefix") == F.col("_pw_p"), "left")
    else:
        salted = known.withColumn("_pw_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wide = wide.withColumn("_pw_salt", F.pmod(F.xxhash64("_pw_id", "_pw_url"), F.lit(SALTS)).cast("int"))
        met = wide.join(
            salted, (F.col("_pw_prefix") == F.col("_pw_p")) & (F.col("_pw_salt") == F.col("_pw_s")), "left"
        )
    rank = F.when(
        F.col("_pw_digest") == F.col("_pw_d"),
        F.struct(
            (-F.char_length("rule")).alias("shorter"),
            F.when(F.col("_pw_v") == "block", 0).otherwise(1).alias("order"),
            F.col("rule"),
            F.col("_pw_v").alias("verdict"),
        ),
    )
    best = met.groupBy("_pw_id", "_pw_url", "_pw_host", "_pw_path", "_pw_n").agg(F.min(rank).alias("_pw_best"))
    # repeats by two short arrays, so that none is as long as their number
    n = F.col("_pw_n")
    again = best.withColumn("_pw_i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / REPEATS))))
    left = F.least(F.lit(REPEATS).cast("long"), n - F.col("_pw_i") * REPEATS)
    again = again.withColumn("_pw_j", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return again.select(
        F.col("_pw_id").alias(id_col),
        F.col("_pw_url").alias(url_col),
        F.col("_pw_host").alias("host"),
        F.col("_pw_path").alias("path"),
        F.col("_pw_best.rule").alias("rule"),
        F.coalesce("_pw_best.verdict", F.lit(default)).alias("verdict"),
    )


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as the table that ``filter_urls`` takes."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
