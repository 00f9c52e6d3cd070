"""Linking a dictionary to text.  Three matching rules that must not be mixed up:

* token runs (:func:`token_edges`): whole tokens, ``'`` and ``-`` inside a token;
* regex words (:func:`word_edges`): ``\\b term \\b`` in any case;
* renderings (:func:`rendering_edges`): plain substring, for scripts without spaces.

All three walk the text inside its row and probe the dictionary at every place (see
``functions/probe.py``): first with what a match starts with, then with the whole match.  Only
what passes both is unnested, as a string as long as the match, and joined with the dictionary.
Neither runs of words nor windows nor texts are unnested where nothing matches.  A dictionary
too large for a probe is joined all the same, with every place of the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.probe import MOST_ENTRIES, listed, listed_entries, probe_of, starts_of, strings, tree_pattern
from lectern.functions.text import (
    LANGS,
    TOKEN_PATTERN,
    is_filled,
    once,
    phrase_forms,
    quote_pattern,
    tokenize,
    tokens_of,
)
from lectern.functions.unicode import normalise
from lectern.operators.ordered import number_sorted
from lectern.operators.sizing import small_side

#: Characters of the key that a place in a text is first probed with.
HEAD = 3


def term_forms(terms: DataFrame) -> DataFrame:
    """(slug, form, n): the distinct token forms of every term."""
    return terms.select(
        "slug", F.explode(phrase_forms(F.col("term"), F.col("source_forms"))).alias("form")
    ).withColumn("n", F.size(F.split("form", " ")))


def token_edges(
    records: DataFrame,
    text: str,
    keys: Sequence[str],
    forms: DataFrame,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Distinct (keys, slug) where a form occurs as a contiguous token run of the text."""
    return token_runs(records, text, keys, forms, carried).dropDuplicates([*keys, "slug"])


def token_runs(
    records: DataFrame,
    text: str,
    keys: Sequence[str],
    forms: DataFrame,
    carried: Sequence[str] = (),
) -> DataFrame:
    """The same, once for each form of a term that stands in a text.

    A dictionary that one pattern can hold is found by it.  Otherwise a run starts where the probe
    knows its first word, and only runs that the probe knows
    whole, of lengths that occur in the dictionary, leave the row.  ``carried`` columns ride
    along with these matches.
    """
    entries = listed_entries(forms, "form")
    if entries and all(_TOKENS.fullmatch(e) for e in entries):
        return _placed_runs(records, text, keys, forms, carried, entries)
    lengths = sorted(r.n for r in forms.select("n").distinct().collect()) or [1]
    first = probe_of(forms.select(F.substring_index("form", " ", 1).alias("w")), "w")
    whole = probe_of(forms, "form")
    tokens = records.select(*keys, *carried, once(tokenize(F.col(text))).alias("_tokens"))
    size = F.size("_tokens")
    places = F.filter(F.transform("_tokens", lambda w, i: F.when(first(w), i + 1)), lambda i: i.isNotNull())

    def runs(i: Column) -> Column:
        # A run beyond the end is null.
        every = [F.when(i + n - 1 <= size, F.array_join(F.slice("_tokens", i, n), " ")) for n in lengths]
        return F.filter(F.array(*every), lambda g: F.coalesce(whole(g), F.lit(False)))

    grams = tokens.select(*keys, *carried, F.explode(F.array_distinct(F.flatten(F.transform(places, runs)))).alias("_gram"))
    side = small_side(forms.select("slug", F.col("form").alias("_gram")).distinct())
    return grams.join(side, "_gram").drop("_gram")


#: In normal text: a token starts here, has just ended, and what may lie between two of them.
_STARTS, _ENDS = "(?<![a-z])(?<![a-z]['-])", "(?!['-]?[a-z])"
_BETWEEN = ("[^a-z]", f"{_ENDS}[^a-z]++")
_TOKENS = re.compile(f"{TOKEN_PATTERN}(?: {TOKEN_PATTERN})*")


def _placed_runs(
    records: DataFrame, text: str, keys: Sequence[str], forms: DataFrame, carried: Sequence[str], entries: list[str]
) -> DataFrame:
    """The same by one pattern over the normal text, which is not cut into tokens.

    Where a token starts, the pattern takes the longest form; the shorter ones at this place are
    its starts.  Only the short stretch that it stands in is cut.
    """
    pattern = f"(?=[{''.join(sorted({e[0] for e in entries}))}]){_STARTS}(?=({tree_pattern(entries, _BETWEEN)}{_ENDS}))"
    met = F.regexp_extract_all(normalise(F.col(text)), F.lit(pattern), F.lit(1))
    runs = F.array_distinct(F.transform(met, lambda m: F.array_join(tokens_of(m), " ")))
    placed = records.select(*keys, *carried, once(runs).alias("_runs")).where(F.size("_runs") > 0).select(
        *keys, *carried, F.explode("_runs").alias("_long"))
    starts = forms.sparkSession.createDataFrame(starts_of(entries, end=" "), "_long string, form string")
    side = small_side(starts.join(forms.select("slug", "form").distinct(), "form").select("_long", "slug").distinct())
    return placed.join(side, "_long").drop("_long")


_WORD = r"(?U)\w+"
_GAP = r"(?U)\W+"


def _folded(text: Column) -> Column:
    """Equal for all texts that a pattern takes for equal in any case, character by character.

    Only the final sigma would depend on what follows it.
    """
    return F.replace(F.lower(F.upper(text)), F.lit("ς"), F.lit("σ"))


def _term_key(term: Column) -> Column:
    """The longest word inside the term; a term without words is its own key."""
    words = F.regexp_extract_all(F.lower(term), F.lit(_WORD), F.lit(0))
    best = F.aggregate(
        words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)
    )
    return F.when(F.size(words) > 0, best).otherwise(F.lower(term))


def word_pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?iU)\b"), quote_pattern(term), F.lit(r"\b"))


def word_edges(records: DataFrame, text: str, keys: Sequence[str], terms: DataFrame) -> DataFrame:
    """Distinct (keys, slug) where ``\\b term \\b`` matches in any case.

    A term that starts with a word can only match where a word of the text starts.  From
    each such place the row looks as far ahead as the longest term, and one character more
    for the closing ``\\b``; what the probe knows leaves the row together with this short
    stretch, in which the pattern is checked.  Terms that start with a sign are rare; they
    meet the text on their longest word.
    """
    named = terms.select("slug", "term").where(F.col("term").isNotNull())
    by_word = named.where(F.rlike("term", F.lit(r"(?U)^\w")))
    others = named.where(~F.rlike("term", F.lit(r"(?U)^\w")))
    entries = listed_entries(by_word.select(_folded(F.col("term")).alias("t")), "t")
    if entries:
        found = _placed_words(records, text, keys, by_word, entries)
        return _with_others(found, records, text, keys, others)
    shape = by_word.agg(F.collect_set(F.length("term")).alias("lengths")).first()
    lengths = sorted(shape["lengths"])
    found = None
    if lengths:
        width = min(HEAD, lengths[0])
        head = probe_of(by_word.select(_folded(F.substring("term", 1, width)).alias("h")), "h")
        whole = probe_of(by_word.select(_folded(F.col("term")).alias("t")), "t")
        ahead = F.regexp_extract_all(F.col(text), F.lit(rf"(?sU)\b(?=\w)(?=(.{{1,{lengths[-1] + 1}}}))"), F.lit(1))
        near = F.filter(ahead, lambda w: head(_folded(F.substring(w, 1, width))))

        def starts(w: Column) -> Column:
            every = [F.struct(_folded(F.substring(w, 1, n)).alias("key"), F.substring(w, 1, n + 1).alias("at")) for n in lengths]
            return F.filter(F.array(*every), lambda p: whole(p["key"]))

        placed = records.select(*keys, F.explode(F.array_distinct(F.flatten(F.transform(near, starts)))).alias("_p")).select(
            *keys, F.col("_p.key").alias("_key"), F.col("_p.at").alias("_at"))
        side = small_side(by_word.select("slug", "term", _folded(F.col("term")).alias("_key")))
        pattern = F.concat(F.lit("(?iU)^"), quote_pattern(F.col("term")), F.lit(r"\b"))
        found = placed.join(side, "_key").where(F.rlike("_at", pattern)).select(*keys, "slug")
    return _with_others(found, records, text, keys, others)


def _placed_words(records: DataFrame, text: str, keys: Sequence[str], terms: DataFrame, entries: list[str]) -> DataFrame:
    """The same for terms that start with a word, found by one pattern over the folded text.

    At each place where a word starts the pattern takes the longest folded term; shorter ones
    at this place are its starts.  What stands in the folded text leaves the row together with
    the text, in which the term's own pattern is checked.
    """
    pattern = rf"(?U)\b(?=({tree_pattern(entries)}))"
    met = F.array_distinct(F.regexp_extract_all(_folded(F.col(text)), F.lit(pattern), F.lit(1)))
    placed = records.select(*keys, F.col(text).alias("_text"), once(met).alias("_met")).where(F.size("_met") > 0).select(
        *keys, "_text", F.explode("_met").alias("_long"))
    starts = terms.sparkSession.createDataFrame(starts_of(entries), "_long string, _key string")
    side = small_side(starts.join(terms.select("slug", "term", _folded(F.col("term")).alias("_key")), "_key").select("_long", "slug", "term"))
    return placed.join(side, "_long").where(F.rlike("_text", word_pattern(F.col("term")))).select(*keys, "slug")


def _with_others(found: DataFrame | None, records: DataFrame, text: str, keys: Sequence[str], others: DataFrame) -> DataFrame:
    """Distinct edges, with those of terms that start with a sign."""
    if found is None or not others.isEmpty():
        lower = F.lower(F.col(text))
        cut = F.array_distinct(F.concat(
            F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)), F.regexp_extract_all(lower, F.lit(_GAP), F.lit(0))))
        side = others.select("slug", "term", _term_key(F.col("term")).alias("_key"))
        known = probe_of(side, "_key")
        parts = records.select(*keys, F.col(text).alias("_text"), F.explode(F.filter(cut, lambda w: known(w))).alias("_key"))
        more = parts.join(small_side(side), "_key").where(F.rlike("_text", word_pattern(F.col("term")))).select(*keys, "slug")
        found = more if found is None else found.unionByName(more)
    return found.dropDuplicates([*keys, "slug"])


def _rarest(renderings: list[str]) -> dict[str, list[str]]:
    """The renderings, filed by the ``HEAD`` characters (or all, if fewer) that fewest of them share."""
    share: dict[str, int] = {}
    parts = {r: dict.fromkeys(r[k : k + HEAD] for k in range(max(1, len(r) - HEAD + 1))) for r in renderings}
    for own in parts.values():
        for key in own:
            share[key] = share.get(key, 0) + 1
    out: dict[str, list[str]] = {}
    for r, own in parts.items():
        out.setdefault(min(own, key=lambda key: share[key]), []).append(r)
    return out


def rendering_edges(
    records: DataFrame, text: str, keys: Sequence[str], terms: DataFrame
) -> DataFrame:
    """Distinct (keys, slug) where any rendering of the term is a substring of the text.

    Every rendering is filed under its rarest ``HEAD`` characters.  The row lists the
    characters of all its positions, looks up those that are filed, and tries only the
    renderings filed under them; only what really stands in the text leaves the row.
    """
    renderings = terms.select(
        "slug", F.explode(F.array(*[F.col(f"translit.{lang}") for lang in LANGS])).alias("_r")
    ).where(is_filled(F.col("_r"))).distinct()
    tree = listed_entries(renderings, "_r")
    if tree:
        return _standing(records, text, keys, renderings, tree)
    every = sorted(r["_r"] for r in renderings.select("_r").distinct().limit(MOST_ENTRIES + 1).collect())
    side = small_side(renderings)
    filled = records.where(is_filled(F.col(text)))
    if len(every) > MOST_ENTRIES:
        return _windowed(filled, text, keys, side)
    if not every:
        return filled.select(*keys).join(side, F.lit(False)).select(*keys, "slug")
    filed = _rarest(every)
    number = {r: n for n, r in enumerate(every, 1)}
    lookup = listed(records.sparkSession, {k: [number[r] for r in own] for k, own in filed.items()})
    known = strings(every)
    grams = []
    for width in sorted({len(k) for k in filed}):
        own = strings([k for k in filed if len(k) == width])
        at = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))
        grams.append(F.array_intersect(at, own))

    def standing(key: Column) -> Column:
        tried = F.transform(lookup(key), lambda n: F.element_at(known, n))
        return F.filter(tried, lambda r: F.contains(F.col(text), r))

    met = filled.select(*keys, text, once(F.concat(*grams)).alias("_met"))
    hits = met.select(*keys, F.explode(F.array_distinct(F.flatten(F.transform("_met", standing)))).alias("_r"))
    return hits.join(side, "_r").select(*keys, "slug").dropDuplicates([*keys, "slug"])


def _standing(records: DataFrame, text: str, keys: Sequence[str], renderings: DataFrame, entries: list[str]) -> DataFrame:
    """The same by one pattern: it takes the longest rendering at every place, and those it starts with stand there too."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=({tree_pattern(entries)}))"), F.lit(1))
    hits = records.where(is_filled(F.col(text))).select(*keys, once(F.array_distinct(found)).alias("_met")).select(
        *keys, F.explode("_met").alias("_long"))
    starts = records.sparkSession.createDataFrame(starts_of(entries), "_long string, _r string")
    side = small_side(starts.join(renderings, "_r").select("_long", "slug").distinct())
    return hits.join(side, "_long").select(*keys, "slug").dropDuplicates([*keys, "slug"])


def _windowed(filled: DataFrame, text: str, keys: Sequence[str], side: DataFrame) -> DataFrame:
    """The same for a dictionary too large to probe: every substring of a known length is joined."""
    lengths = sorted(r.n for r in side.select(F.length("_r").alias("n")).distinct().collect())
    cuts = [F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    windows = filled.select(*keys, F.explode(F.array_distinct(F.concat(*cuts))).alias("_r"))
    return windows.join(side, "_r").select(*keys, "slug").dropDuplicates([*keys, "slug"])


def resolve_tags(tagged: DataFrame, tag: str, terms: DataFrame) -> DataFrame:
    """Tags to slugs: exact headword first, else any case (the last such term wins).

    Distinct tags are resolved once; a tag carried by a third of all verses is one row.
    """
    tags = tagged.select(F.col(tag).alias("_tag")).distinct()
    # One row per lower-case headword, so the lookup never fans out.
    exact = terms.groupBy("term").agg(F.max_by("slug", F.col("position")).alias("_exact"))
    folded = terms.groupBy(F.lower("term").alias("_lower")).agg(
        F.max_by("slug", F.col("position")).alias("_ci")
    )
    resolved = (
        tags.join(exact, tags["_tag"] == exact["term"], "left")
        .join(folded, F.lower(F.col("_tag")) == F.col("_lower"), "left")
        .select("_tag", F.coalesce("_exact", "_ci").alias("slug"))
        .where(F.col("slug").isNotNull())
    )
    return tagged.join(resolved, F.col(tag) == F.col("_tag")).drop("_tag")


def scope_terms(edges: DataFrame, tagged: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Terms of a scope: matched in its text, or already tagged on its verses."""
    return edges.select(*scope, "slug").unionByName(tagged.select(*scope, "slug")).distinct()


# --- edges to lists -------------------------------------------------------------------


def first_links(placed: DataFrame) -> DataFrame:
    """One row per (slug, verse_id): verse ids can repeat, the first place counts."""
    first = placed.groupBy("slug", "verse_id").agg(
        F.min(F.struct("book_position", "chapter", "ord")).alias("_at")
    )
    return first.select("slug", "verse_id", "_at.*")


def number_backlinks(edges: DataFrame) -> DataFrame:
    """Edges numbered per term in document order (book position, chapter, ord).

    Exact for any term and any chapter numbers: a term linked from a third of all verses is
    numbered by sampled ranges.
    """
    order = [F.col(c) for c in ("book_position", "chapter", "ord", "verse_id") if c in edges.columns]
    return number_sorted(edges, ["slug"], order, "link_no")


def backlinks(edges: DataFrame, terms: DataFrame, part: int = 1000) -> DataFrame:
    """Verse ids of every term in document order, in parts of at most ``part`` ids.

    Every term is there, one without links as a single empty part; no id is dropped and no
    list outgrows a row.
    """
    numbered = number_backlinks(edges).withColumn(
        "part_no", F.floor((F.col("link_no") - 1) / part)
    )
    lists = numbered.groupBy("slug", "part_no").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("link_no", "verse_id"))), lambda p: p["verse_id"]
        ).alias("verse_ids")
    )
    return terms.select("slug").join(lists, "slug", "left").select(
        "slug", F.coalesce("part_no", F.lit(0)).alias("part_no"),
        F.coalesce("verse_ids", F.array().cast("array<string>")).alias("verse_ids"),
    )


def link_counts(edges: DataFrame, terms: DataFrame) -> DataFrame:
    counts = edges.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    return terms.select("slug").join(counts, "slug", "left").select(
        "slug", F.coalesce("n", F.lit(0)).alias("n_links")
    )


def backlink_summary(edges: DataFrame, terms: DataFrame, shown: int = 12) -> DataFrame:
    """First ``shown`` verse ids, then ``… (+k)``: the display list of a term."""
    head = number_backlinks(edges).where(F.col("link_no") <= shown)
    lists = head.groupBy("slug").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("link_no", "verse_id"))),
                        lambda p: p["verse_id"]),
            ", ",
        ).alias("_head")
    )
    more = F.concat("_head", F.lit(" … (+"), (F.col("n_links") - shown).cast("string"), F.lit(")"))
    return link_counts(edges, terms).join(lists, "slug", "left").select(
        "slug", "n_links",
        F.coalesce(F.when(F.col("n_links") > shown, more).otherwise(F.col("_head")), F.lit("")).alias(
            "appears"
        ),
    )


def verse_tags(edges: DataFrame, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slugs per verse in dictionary order (a verse holds few terms)."""
    placed = edges.join(terms.select("slug", "position"), "slug")
    return placed.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "slug"))), lambda p: p["slug"]
        ).alias("tags")
    )


def same_set(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(a, empty))).eqNullSafe(
        F.array_sort(F.array_distinct(F.coalesce(b, empty)))
    )


def link_terms(
    verses: DataFrame, terms: DataFrame, books: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, retagged verses, total): relink the whole corpus.

    Retagged verses are only those whose tag set really changes.
    """
    keys = ["book", "chapter", "ord"]
    edges = word_edges(verses, "en", [*keys, "verse_id"], terms)
    placed = edges.join(
        books.select(F.col("slug").alias("book"), F.col("position").alias("book_position")), "book"
    )
    tags = verse_tags(edges, terms, keys)
    old = verses.select(*keys, "verse_id", "glossary_terms")
    joined = old.join(tags, keys, "left")
    changed = joined.where(~same_set(F.col("tags"), F.col("glossary_terms"))).select(
        *keys, "verse_id", F.coalesce("tags", F.array().cast("array<string>")).alias("glossary_terms")
    )
    total = edges.select("verse_id", "slug").distinct().agg(F.count(F.lit(1)).alias("total_links"))
    return placed, changed, total


def glossary_slice(
    tagged: DataFrame, translated: DataFrame, terms: DataFrame
) -> DataFrame:
    """Terms a chapter page ships: tagged on a verse, or rendered anywhere in its text.

    ``tagged`` has (chapter_id, slug), ``translated`` (chapter_id, text).
    """
    rendered = rendering_edges(translated, "text", ["chapter_id"], terms)
    known = tagged.join(terms.select("slug"), "slug", "left_semi")
    return known.select("chapter_id", "slug").unionByName(rendered).distinct()


# --- glossary reading -----------------------------------------------------------------


def locked_terms(terms: DataFrame) -> DataFrame:
    """At least one rendering is non-empty."""
    return terms.where(F.exists(F.array(*[F.col(f"translit.{x}") for x in LANGS]), is_filled))


def fully_rendered() -> Column:
    return F.forall(F.array(*[F.col(f"translit.{x}") for x in LANGS]), is_filled)


def glossary_filter(terms: DataFrame, needle: str, category: str = "all", lang: str = "en") -> DataFrame:
    """Category and substring filter over headword, rendering, definition and note."""
    kept = terms if category == "all" else terms.where(F.col("category") == category)
    needle = needle.strip().lower()
    if not needle:
        return kept
    parts = [F.nullif("term", F.lit(""))]
    if lang in LANGS:
        parts.append(F.nullif(F.col(f"translit.{lang}"), F.lit("")))
    parts += [
        F.nullif("source_def", F.lit("")), F.nullif(F.col(f"editor_note.{lang}"), F.lit("")),
    ]
    return kept.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(needle)))


def glossary_sort(terms: DataFrame) -> DataFrame:
    return terms.orderBy(F.collate(F.lower("term"), "UNICODE_CI"), "term")


def english_present(term: Column, english: Column) -> Column:
    """Headword (or a word starting with its first four letters) stands in the English.

    No English at all does not count against the term.
    """
    exact = F.concat(F.lit("(?i)(?<![A-Za-z])"), quote_pattern(term), F.lit("(?![A-Za-z])"))
    stem = F.substring(F.regexp_replace(term, "[^A-Za-z]", ""), 1, 4)
    by_stem = F.concat(F.lit("(?i)(?<![A-Za-z])"), stem)
    return (
        F.when(~is_filled(english), True)
        .when(F.rlike(english, exact), True)
        .when(F.length(stem) >= 4, F.rlike(english, by_stem))
        .otherwise(False)
    )


def annotate(
    verses: DataFrame, tagged: DataFrame, terms: DataFrame, lang: str, keys: Sequence[str]
) -> DataFrame:
    """``rendering（Headword）`` on every hit, leftmost first and longest first.

    ``tagged`` has (keys, tag, tag_no).  Adds ``segments`` (kind, text, term, slug) and
    the flat ``annotated`` text.  English is never annotated.
    """
    plain = F.array(
        F.struct(F.lit("text").alias("kind"), F.col("_text").alias("text"),
                 F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("slug"))
    )
    if lang == "en":
        base = verses.withColumn("_text", F.col("en"))
        return base.withColumn("segments", plain).withColumn("annotated", F.col("_text")).drop("_text")
    resolved = resolve_tags(tagged, "tag", terms)
    names = terms.select("slug", F.col("term").alias("_term"), F.col(f"translit.{lang}").alias("_tl"))
    # The tags of a verse meet it once; which of them its English bears out is judged in its row.
    pairs = resolved.join(small_side(names), "slug").where(is_filled(F.col("_tl"))).groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.length("_tl")).alias("len"), F.col("tag_no").alias("no"), F.col("_tl").alias("tl"),
                         F.col("_term").alias("term"), "slug", F.col("tag").alias("tag"))
            )
        ).alias("_tagged")
    )
    present = F.filter("_tagged", lambda p: english_present(p["tag"], F.col("en")))
    met = verses.join(pairs, list(keys), "left").select("*", once(present).alias("_present")).drop("_tagged")
    joined = met.withColumn("_pairs", F.when(F.size("_present") > 0, F.col("_present"))).drop("_present").withColumn(
        "_text", F.coalesce(F.col(lang), F.lit(""))
    ).withColumn(
        "_pat", F.array_join(F.transform("_pairs", lambda p: quote_pattern(p["tl"])), "|")
    )
    hits = F.regexp_extract_all(F.col("_text"), F.col("_pat"), F.lit(0))
    gaps = F.split(F.col("_text"), F.col("_pat"), F.lit(-1))

    def hit_segment(text: Column) -> Column:
        pair = F.get(F.filter("_pairs", lambda p: p["tl"] == text), F.lit(0))
        return F.struct(F.lit("term").alias("kind"), text.alias("text"),
                        pair["term"].alias("term"), pair["slug"].alias("slug"))

    def both(gap: Column, hit: Column) -> Column:
        kind = "struct<kind:string,text:string,term:string,slug:string>"
        none = F.lit(None).cast("string")
        lead = F.struct(F.lit("text").alias("kind"), gap.alias("text"), none.alias("term"),
                        none.alias("slug"))
        return F.array(lead.cast(kind), F.when(hit.isNotNull(), hit_segment(hit).cast(kind)))

    spliced = F.filter(
        F.flatten(F.zip_with(gaps, hits, both)), lambda s: s.isNotNull() & (s["text"] != "")
    )
    kind = "array<struct<kind:string,text:string,term:string,slug:string>>"
    return joined.withColumn(
        "segments", F.when(F.col("_pairs").isNotNull(), spliced.cast(kind)).otherwise(plain.cast(kind))
    ).withColumn(
        "annotated",
        F.array_join(
            F.transform(
                "segments",
                lambda s: F.when(
                    s["kind"] == "term", F.concat(s["text"], F.lit("（"), s["term"], F.lit("）"))
                ).otherwise(s["text"]),
            ),
            "",
        ),
    ).drop("_text", "_pat", "_pairs")
