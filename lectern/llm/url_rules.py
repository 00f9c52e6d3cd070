"""URL filters: pattern rules found by their rarest literal token (native).

A rule is a host and a path prefix; it fits the host and its subdomains, and becomes one
regular expression over ``host + path``.  Each rule is filed under that of its whole tokens
which the fewest URLs carry.  A URL looks up its own tokens and runs only the expressions
filed there; the longest fitting rule decides, ties go to the smaller rule string.  A rule
without a whole token is filed under the empty token, which every URL looks up.

Defined results: a null URL, or one without ``://``, has empty host and path and fits only
rules with neither; a URL that no rule fits gets the default verdict.  Repeated rows stay.
An empty rule list gives every URL the default.  Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule lists up to this many bytes of text are broadcast; larger ones join by shuffle.
BROADCAST_BYTES = 8_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every page."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("u"))
    host, path = host_and_path(F.col("u"))
    return urls.select("page_id", host.alias("host"), path.alias("path"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^0-9A-Za-z]+"), lambda t: t != ""))


def compiled(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with their name, expression and whole tokens.

    The last token of the path may go on in the URL, so it only counts if a delimiter ends
    the path; a rule without a path ends at the end of the host.
    """
    quoted = F.regexp_replace(F.concat("host", "path"), r"([^0-9A-Za-z])", r"\\$1")
    host_end = F.when(F.col("path") == "", F.lit("(?:/|$)")).otherwise(F.lit(""))
    whole = F.when(F.col("path") == "", F.col("host")).otherwise(
        F.concat("host", F.regexp_replace("path", "[0-9A-Za-z]+$", "")))
    return rules.select(
        F.concat("host", "path").alias("rule"), "verdict",
        F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted, host_end).alias("pattern"),
        tokens(whole).alias("tokens"),
    )


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """token, rules: each rule under its rarest token, counted over all URLs."""
    ready = compiled(rules)
    filed = ready.select("rule", "verdict", "pattern", F.explode_outer("tokens").alias("token"))
    wanted = filed.select("token").where("token is not null").distinct()
    seen = urls.select(F.explode(tokens(F.concat("host", "path"))).alias("token")).join(_small(wanted), "token", "left_semi")
    often = seen.groupBy("token").count()
    best = filed.join(often, "token", "left").groupBy("rule", "verdict", "pattern").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("best"))
    return best.groupBy(F.col("best.token").alias("token")).agg(
        F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "verdict", "pattern")).alias("rules"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a side derived from the rule list only after measuring its text."""
    width = sum((F.length(F.to_json(F.struct(c))) for c in df.columns), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, n_tried for every row of ``urls`` (page_id, host, path).

    One row per URL and token meets the index, at most one bucket each; the expressions run
    there, and what is left of a URL is merged before the shuffle.  Equal rows share a group
    that carries their number, so no row id is needed.
    """
    looked = F.concat(tokens(F.concat("host", "path")), F.array(F.lit("")))
    url = F.concat("host", "path")
    probes = urls.select("page_id", "host", "path", F.posexplode(looked).alias("at", "token"))
    fits = F.filter("rules", lambda r: F.regexp_like(url, r["pattern"]))
    # The longest name wins, then the smaller one: order by (-size, rule).
    best = F.array_min(F.transform(fits, lambda r: F.struct((-r["size"]).alias("order"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    met = probes.join(_small(index(rules, urls)), "token", "left").select(
        "page_id", "host", "path", "at", best.alias("best"), F.coalesce(F.size("rules"), F.lit(0)).alias("tried"))
    judged = met.groupBy("page_id", "host", "path").agg(
        F.min("best").alias("best"), F.count(F.when(F.col("at") == 0, 1)).alias("n"), F.sum(F.greatest("tried", F.lit(0))).alias("tried"))
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        (F.col("tried") / F.col("n")).cast("long").alias("n_tried"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    ).drop("copy")
