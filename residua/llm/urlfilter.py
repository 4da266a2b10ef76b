"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the equi-join uses; the rest confirms.
PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path from
    there to ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, g), F.lit("")) for g in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digest and precedence; hosts in lower case, as in urls; of equal rules ``block`` stands."""
    rule = F.concat("host", "path")
    return (
        rules.where("host is not null and path is not null and host <> ''")
        .withColumn("host", F.translate("host", UPPER, LOWER))
        .groupBy(rule.alias("rule"), F.length("host").alias("_host_len"), F.length("path").alias("_path_len"))
        .agg(F.max(F.col("verdict")).alias("verdict"))
        .withColumn("_digest", F.sha2(F.concat_ws("\u0001", F.expr("left(rule, _host_len)"), F.expr("substr(rule, _host_len + 1)")), 256))
        .withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    Each distinct url is expanded into its host suffixes of as many labels as some rule has, times those path prefixes whose length some rule has, so
    a host of any number of labels costs no more than its length; an expression meets the rules by the first 32 bits of its SHA-256 and counts if the whole digest agrees. The
    longest rule wins. Rules are broadcast only when a count shows at most ``broadcast_rules`` of them; more are
    met in a sort-merge join. Both that join and the one that brings verdicts back to the pages have a written table on either side, so
    that a rule or url that very many rows share can be split over tasks; urls without a host take no part in them. Null and odd urls
    get empty parts, no rule and the default verdict; repeated urls are
    judged once; an empty table of pages or rules works. Columns ``host``, ``path``, ``rule`` and ``verdict`` of
    ``pages`` are replaced; its other columns may have any name.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    known = written(prepared_rules(rules), "rules")
    dots = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))
    n_rules, lengths, counts = known.agg(F.count("*"), F.sort_array(F.collect_set("_path_len")), F.sort_array(F.collect_set(dots(F.expr("left(rule, _host_len)")) + 1))).first()
    host, path = url_parts(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    distinct = out.where("host <> ''").select("host", "path").distinct()
    labels, cuts = (F.array(*[F.lit(int(x)) for x in some]).cast("array<int>") for some in (counts, lengths))
    suffixes = F.transform(F.filter(labels, lambda n: n <= dots(F.col("host")) + 1), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat(h, F.lit("\u0001"), p), 256))))
    asked = distinct.select("host", "path", F.explode(digests).alias("_full")).withColumn("_short", F.substring("_full", 1, PREFIX_HEX))
    if n_rules > broadcast_rules:
        asked = written(asked, "expressions")
    met = asked.join(known.hint("broadcast" if n_rules <= broadcast_rules else "merge"), "_short").where("_full = _digest")
    rank = F.struct(F.length("rule").alias("n"), F.col("_host_len").alias("h"), F.col("rule").alias("r"))
    best = written(met.groupBy("host", "path").agg(F.max_by("rule", rank).alias("rule"), F.max_by("verdict", rank).alias("verdict")), "verdicts")
    judged = out.where("host <> ''").join(best.hint("merge"), ["host", "path"], "left").select(*out.columns, "rule", "verdict")
    bare = out.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return judged.unionByName(bare).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
