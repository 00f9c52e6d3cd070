"""Verse search: inverted index, all-words queries, neighbours, paging, excerpts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.probe import listed_entries, probe_of, tree_pattern
from lectern.functions.text import LANGS, TOKEN_PATTERN, is_filled, tokenize
from lectern.functions.unicode import normalise
from lectern.operators.ordered import number_sorted
from lectern.operators.sizing import small_side
from lectern.session import cut_lineage

CJK = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{2ffff}]"


def cjk_bigrams(text: Column) -> Column:
    """Character pairs of every CJK run; a run of one character stands for itself."""
    # The one range in front passes quickly over all other text.
    runs = F.regexp_extract_all(text, F.lit(f"(?=[\\x{{3040}}-\\x{{2ffff}}]){CJK}+"), F.lit(0))

    def pairs(run: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))
        )
        return F.when(F.length(run) > 1, several).otherwise(F.array(run))

    return F.flatten(F.transform(runs, pairs))


def search_tokens(text: Column, lang: str | None = None) -> Column:
    """Index tokens: words for English, words plus character pairs for the others."""
    if lang in LANGS:
        return F.concat(tokenize(text), cjk_bigrams(F.coalesce(text, F.lit(""))))
    return tokenize(text)


def _asked_tokens(text: Column, asked: list[str]) -> Column:
    """Those of the English tokens of a text that are listed, found in place by one pattern."""
    own = [t for t in asked if re.fullmatch(TOKEN_PATTERN, t)]
    if not own:
        return F.array().cast("array<string>")
    # A token starts and ends where the token pattern would start and end it.
    pattern = f"(?<![a-z])(?<![a-z]['-])({tree_pattern(own)})(?![a-z])(?!['-][a-z])"
    return F.regexp_extract_all(normalise(text), F.lit(pattern), F.lit(1))


def build_index(
    records: DataFrame, text: str, keys: list[str], lang: str | None = None, only: DataFrame | None = None
) -> DataFrame:
    """(token, keys, tf): counted inside the row, so building the index needs no shuffle.

    The row's tokens are sorted and joined; a pattern cuts the line into runs of one token,
    and a token's count is the length of its run.  With ``only``, a table of tokens, no other
    token is sorted or leaves its row.
    """
    asked = None if only is None or lang in LANGS else listed_entries(only, "token")
    if asked is not None:
        tokens = _asked_tokens(F.col(text), asked)
    else:
        tokens = search_tokens(F.col(text), lang)
        if only is not None:
            known = probe_of(only, "token")
            tokens = F.filter(tokens, lambda t: known(t))
    line = F.concat(F.array_join(F.sort_array(tokens), " "), F.lit(" "))
    runs = records.select(*keys, F.explode(F.regexp_extract_all(line, F.lit(r"(\S+ )\1*"), F.lit(0))).alias("_run"))
    token = F.substring_index("_run", " ", 1)
    postings = runs.select(token.alias("token"), *keys, F.expr("length(_run) div (length(substring_index(_run, ' ', 1)) + 1)").alias("tf"))
    return postings if only is None else postings.join(small_side(only.select("token").distinct()), "token", "left_semi")


# --- stored index -----------------------------------------------------------------------

#: Documents of a block: the unit whose best possible score is known before it is read.
BLOCK = 4096


def write_index(index: DataFrame, root: str, buckets: int = 64) -> None:
    """Postings (token, chapter_id, chapter, ord, tf), and a summary per token and block.

    Both lie in folders by the hash of the token, so a query reads only those of its own
    words; inside a file postings are sorted by token and block, which prunes row groups.
    """
    placed = index.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets))).withColumn(
        "block", F.floor(F.col("chapter") / BLOCK))
    # Every task sorts and writes the postings of its own split, a file per bucket: shuffled, they
    # would lie on disk a second time, several times as large as the files.
    postings = placed.sortWithinPartitions("bucket", "token", "block", "chapter", "ord")
    postings.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings")
    written = index.sparkSession.read.parquet(f"{root}/postings").withColumn("bucket", F.col("bucket").cast("bigint"))
    blocks = written.groupBy("bucket", "token", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"))
    blocks.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{root}/blocks")


def read_index(spark: SparkSession, root: str, wanted: DataFrame, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(postings, blocks) of the tokens in ``wanted``; other buckets are not read."""
    tokens = wanted.select("token").distinct()
    asked = [r.b for r in tokens.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("b")).distinct().collect()]
    side = small_side(tokens)
    of = lambda name: spark.read.parquet(f"{root}/{name}").where(F.col("bucket").isin(asked)).join(side, "token", "left_semi").drop("bucket")
    return of("postings"), of("blocks")


def frequencies(blocks: DataFrame) -> DataFrame:
    """(token, df) from the block summaries, without reading a posting."""
    return blocks.groupBy("token").agg(F.sum("n").alias("df"))


def top_hits(postings: DataFrame, blocks: DataFrame, queries: DataFrame, k: int = 8, first: int = 2, lang: str | None = None) -> DataFrame:
    """The best ``k`` hits of every query, as :func:`search` scores them, with ``rank``.

    A block can hold a hit only if it holds every word, and none scores better than the
    words' highest counts in it allow.  The ``first`` best blocks of a query are scored, and
    what their ``k``-th hit reaches rules out all blocks that cannot reach it; only the
    rest is read.
    """
    keys = ["chapter_id", "chapter", "ord"]
    wanted = query_tokens(queries, lang)
    weight = F.log1p(F.lit(1.0) / F.col("df"))
    known = blocks.join(frequencies(blocks), "token").withColumn("bound", F.col("most") * weight)
    bounds = known.join(small_side(wanted), "token").groupBy("query_id", "block").agg(
        F.sum("bound").alias("bound"), F.count(F.lit(1)).alias("_n"), F.max("k").alias("_k")).where("_n = _k")
    # Sums of the same numbers in another order may differ in the last digits.
    bounds = cut_lineage(bounds.select("query_id", "block", (F.col("bound") + 1e-5).alias("bound")))
    best = W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    opened = bounds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= first).select("query_id", "block")

    def scored(which: DataFrame) -> DataFrame:
        words = wanted.join(small_side(which), "query_id")
        # A posting moves to its verse once, before it meets the queries that ask for its word.
        asked = postings.join(small_side(words.select("token", "block").distinct()), ["token", "block"], "left_semi")
        weighted = small_side(words.join(frequencies(blocks), "token"))
        met = asked.repartition(*keys).join(weighted, ["token", "block"])
        return met.groupBy("query_id", *keys).agg(
            F.count(F.lit(1)).alias("_n"), F.max("k").alias("_k"), F.round(F.sum(F.col("tf") * weight), 6).alias("score")
        ).where("_n = _k").select("query_id", *keys, "score")

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "chapter", "ord")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    start = cut_lineage(ranked(scored(opened)))
    reached = start.where(F.col("rank") == k).select("query_id", F.col("score").alias("_reached"))
    rest = bounds.join(opened, ["query_id", "block"], "left_anti").join(reached, "query_id", "left").where(
        F.col("_reached").isNull() | (F.col("bound") >= F.col("_reached"))).select("query_id", "block")
    return ranked(start.drop("rank").unionByName(scored(rest)))


def index_by_language(verses: DataFrame, keys: list[str]) -> DataFrame:
    """One index with a ``lang`` column to partition the table by."""
    parts = []
    for lang in ("en", *LANGS):
        kept = verses.where(is_filled(F.col(lang)))
        parts.append(build_index(kept, lang, keys, lang).withColumn("lang", F.lit(lang)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def query_tokens(queries: DataFrame, lang: str | None = None) -> DataFrame:
    """(query_id, token, k): distinct tokens of each query and how many there are."""
    tokens = F.array_distinct(search_tokens(F.col("query"), lang))
    return queries.select("query_id", F.explode(tokens).alias("token"), F.size(tokens).alias("k"))


def search(
    index: DataFrame, queries: DataFrame, keys: list[str], lang: str | None = None, frequency: DataFrame | None = None
) -> DataFrame:
    """Verses that hold every word of the query, scored by summed tf * idf.

    A word weighs ``ln(1 + 1/df)`` with df the number of verses holding it; ties are broken
    by chapter and verse.  Only words asked for are kept of the index.  ``frequency``
    (token, df) of a stored index saves counting them.
    """
    wanted = query_tokens(queries, lang)
    # How many verses hold each word asked for: partial counts per task, one row per word.
    if frequency is None:
        # Read twice, so that the text is walked once: the postings asked for are small beside it.
        asked = small_side(wanted.select("token").distinct())
        index = cut_lineage(index.join(asked, "token", "left_semi"))
        frequency = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # A word's queries and count meet first, so that no posting is shuffled by its word.
    side = small_side(cut_lineage(wanted.join(frequency, "token")))
    weighted = index.join(side, "token")
    scored = weighted.groupBy("query_id", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("k").alias("_k"),
        F.sum(F.col("tf") * F.log1p(F.lit(1.0) / F.col("df"))).alias("_score"),
    )
    return scored.where(F.col("_n") == F.col("_k")).select(
        "query_id", *keys, F.round("_score", 6).alias("score")
    )


def number_hits(hits: DataFrame) -> DataFrame:
    """Rank of every hit in its query: score, then chapter and verse; exact at any size."""
    return number_sorted(hits, ["query_id"], [F.col("score").desc(), F.col("chapter"), F.col("ord")], "rank")


def page_of(rank: Column, per_page: int = 10) -> Column:
    """0-based result page of a 1-based rank."""
    return F.floor((rank - 1) / per_page)


def page_count(n: Column, per_page: int = 10) -> Column:
    return F.ceil(n / per_page)


def top_k(hits: DataFrame, k: int = 8) -> DataFrame:
    """First k results of one query (a top-k per task, then merged)."""
    return hits.orderBy(F.desc("score"), "chapter", "ord").limit(k)


def page_slice(hits: DataFrame, page: int, per_page: int = 10) -> DataFrame:
    return hits.orderBy(F.desc("score"), "chapter", "ord").offset(page * per_page).limit(per_page)


def snippet(text: Column, needle: Column, before: int = 30, after: int = 60) -> Column:
    """Text around the first hit (any case), the hit marked; '' when there is none."""
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - before, F.lit(1))
    length = F.length(needle)
    lead = F.substring(text, start, at - start)
    hit = F.substring(text, at, length)
    tail = F.substring(text, at + length, F.lit(after))
    return F.when(
        at > 0,
        F.concat(
            F.when(start > 1, "…").otherwise(""), lead, F.lit("<mark>"), hit, F.lit("</mark>"), tail,
            F.when(at + length + after <= F.length(text), "…").otherwise(""),
        ),
    ).otherwise("")


def term_queries(terms: DataFrame, lang: str = "en") -> DataFrame:
    """The search a glossary card starts: rendering in the language, else headword."""
    query = F.col("term")
    if lang in LANGS:
        query = F.coalesce(F.nullif(F.col(f"translit.{lang}"), F.lit("")), F.col("term"))
    return terms.select(F.col("slug").alias("query_id"), query.alias("query"))


def parallel_view(verses: DataFrame, lang: str) -> DataFrame:
    """English and one other language side by side; English stands in where it is missing."""
    other = F.coalesce(F.nullif(F.col(lang), F.lit("")), F.col("en"), F.lit(""))
    return verses.select(
        "chapter_id", "ord", "verse_id", F.coalesce("en", F.lit("")).alias("source"),
        other.alias("other"), (~is_filled(F.col(lang))).alias("fallback"),
    )


def long_form(verses: DataFrame) -> DataFrame:
    """(chapter_id, ord, lang, text) rows."""
    return verses.select("chapter_id", "ord", "en", *LANGS).unpivot(
        ["chapter_id", "ord"], ["en", *LANGS], "lang", "text"
    )


def wide_form(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chapter_id", "ord").pivot("lang", ["en", *LANGS]).agg(F.first("text"))
