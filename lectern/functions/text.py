"""Column functions for page text, verses, identifiers and languages.

Regular expressions use ``(?U)`` wherever ``\\s``, ``\\b``, ``\\d`` or ``\\w`` must follow
Unicode rules: without it Java misses the no-break space and accented letters.

The patterns of page marks, headings, verse numbers, identifiers, tokens and scripts are fixed
values: they are the formats of the documents and decide what the columns mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.unicode import normalise

LANGS = ("zh_hant", "zh_hans", "ja")
I18N = ("en", *LANGS)
# Fixed value: what a token is.
TOKEN_PATTERN = "[a-z]+(?:['-][a-z]+)*"


# --- white space, page marks, verse numbers -------------------------------------------


def squeeze(text: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def collapse(text: Column) -> Column:
    """Drop page marks such as ``p. 10`` inside a sentence, then squeeze."""
    # The class in front passes quickly over all places where no mark can start.
    return squeeze(F.regexp_replace(text, r"(?U)(?=[\sp])\s*+\bp\.\s*\d+\s*", " "))


def parse_verse(text: Column) -> Column:
    """``12. text`` to (is_verse, number, rest); an unnumbered or empty verse is none."""
    flat = collapse(text)
    pattern = r"(?sU)^(\d+)\.\s+(.*)"
    rest = collapse(F.regexp_extract(flat, pattern, 2))
    is_verse = F.coalesce(flat.rlike(pattern) & (rest != ""), F.lit(False))
    number = F.regexp_extract(flat, pattern, 1).try_cast("int")
    return F.struct(
        is_verse.alias("is_verse"),
        F.when(is_verse, number).alias("number"),
        F.when(is_verse, rest).otherwise("").alias("rest"),
    )


def parse_numbered(text: Column) -> Column:
    """The same split without removing page marks (for already clean page text)."""
    pattern = r"(?sU)^(\d+)\.\s+(.*)"
    is_verse = F.coalesce(text.rlike(pattern), F.lit(False))
    return F.struct(
        is_verse.alias("is_verse"),
        F.when(is_verse, F.regexp_extract(text, pattern, 1).try_cast("int")).alias("number"),
        F.when(is_verse, squeeze_ends(F.regexp_extract(text, pattern, 2)))
        .otherwise("")
        .alias("rest"),
    )


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_page_mark(text: Column) -> Column:
    """``p. 6`` / ``p. xv``."""
    return text.rlike(r"(?iU)^p\.\s*[\divxlcdm]+\s*$")


def is_any_page_mark(text: Column) -> Column:
    """``p. 68a``: a page mark holding one word of any kind."""
    return text.rlike(r"(?iU)^p\.\s+\S+$")


def is_chapter_heading(text: Column) -> Column:
    """``Chapter IV`` standing alone."""
    return text.rlike(r"(?U)^Chapter\s+[\dIVXLCivxlc]+\s*$")


def starts_chapter(text: Column) -> Column:
    """``chapter 4 ...`` in any case."""
    return text.rlike(r"(?iU)^chapter\s+\d+")


def is_numbered_chapter(text: Column) -> Column:
    """``CHAPTER 4.`` in any case."""
    return text.rlike(r"(?iU)^CHAPTER\s+\d+\.")


def same_heading(text: Column, title: Column) -> Column:
    """The paragraph repeats the book title, with or without closing dots."""
    plain = F.lower(squeeze_ends(text))
    return (plain == F.lower(title)) | (
        F.regexp_replace(plain, r"\.+$", "") == F.lower(F.regexp_replace(title, r"\.+$", ""))
    )


# --- identifiers ----------------------------------------------------------------------


def split_anchor(name: Column) -> Column:
    """``l4thb1`` to (prefix, number); no trailing digits gives nulls.  Case is kept."""
    pattern = r"^(.+?)(\d+)$"
    hit = name.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(name, pattern, 1)).alias("prefix"),
        F.when(hit, F.regexp_extract(name, pattern, 2).try_cast("bigint")).alias("number"),
    )


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_from_slug(slug: Column) -> Column:
    """Dashes to spaces, every run of letters capitalised (also after a digit)."""
    spaced = F.replace(slug, F.lit("-"), F.lit(" "))
    cut = F.regexp_replace(spaced, "([^A-Za-z ])([A-Za-z])", "$1\u0001 $2")
    return F.replace(F.initcap(cut), F.lit("\u0001 "), F.lit(""))


def chapter_id(book: Column, chapter: Column) -> Column:
    return F.concat_ws(".", book, chapter.cast("string"))


def verse_id(book: Column, chapter: Column, number: Column) -> Column:
    return F.concat_ws(".", book, chapter.cast("string"), number.cast("string"))


def chapter_title(title: Column, slug: Column, chapter: Column) -> Column:
    return F.concat(F.coalesce(title, slug), F.lit(" — Chapter "), chapter.cast("string"))


def parse_verse_id(vid: Column) -> Column:
    pattern = r"^(.+)\.(\d+)\.(\d+)$"
    hit = vid.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(vid, pattern, 1)).alias("book"),
        F.when(hit, F.regexp_extract(vid, pattern, 2).try_cast("bigint")).alias("chapter"),
        F.when(hit, F.regexp_extract(vid, pattern, 3).try_cast("bigint")).alias("verse"),
    )


def is_verse_id(vid: Column) -> Column:
    return vid.rlike(r"^[a-z0-9-]+\.\d+\.\d+$")


def is_chapter_id(cid: Column) -> Column:
    return cid.rlike(r"^[a-z0-9-]+\.\d+$")


def caption_key(vid: Column, index: Column) -> Column:
    """Captions are known by verse and 0-based image index; their text is not unique."""
    return F.concat(vid, F.lit("#"), index.cast("string"))


def image_stem(src: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(src, "^img/", ""), r"\.jpg$", "")


def file_name(src: Column) -> Column:
    return F.element_at(F.split(src, "/"), -1)


def is_content_image(src: Column) -> Column:
    return F.coalesce(F.lower(src).contains("_files/image"), F.lit(False))


# --- languages ------------------------------------------------------------------------

I18N_TYPE = T.StructType([T.StructField(k, T.StringType()) for k in I18N])


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def i18n_wrap(en: Column) -> Column:
    """English only; the other languages start null and '' counts as no English."""
    empty = F.lit(None).cast("string")
    return F.struct(blank_to_null(en).alias("en"), *[empty.alias(lang) for lang in LANGS])


def i18n_normalise(raw: Column) -> Column:
    """JSON text of an i18n object, or of a bare (old style) string, to the i18n struct."""
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    is_object = kind.startswith("OBJECT")
    fields = [
        F.when(is_object, F.try_variant_get(value, f"$.{key}", "string")).alias(key) for key in LANGS
    ]
    english = (
        F.when(is_object, F.try_variant_get(value, "$.en", "string"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .otherwise("")
    )
    return F.struct(english.alias("en"), *fields)


def i18n_get(text: Column, lang: str) -> Column:
    """The language asked for, else English, else ''; '' counts as missing."""
    return F.coalesce(blank_to_null(text[lang]), text["en"], F.lit(""))


def has_kana(text: Column) -> Column:
    return F.coalesce(text.rlike("[぀-ゟ゠-ヿ]"), F.lit(False))


def has_katakana(text: Column) -> Column:
    return F.coalesce(text.rlike("[゠-ヿ]"), F.lit(False))


def is_filled(text: Column) -> Column:
    """Not null and not ''."""
    return F.coalesce(text != "", F.lit(False))


def is_blank(text: Column) -> Column:
    """Null, '' or white space only: the first other character settles it."""
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S"))


# --- digests --------------------------------------------------------------------------


def sha16(text: Column) -> Column:
    """First 16 hex digits of SHA-256 of the UTF-8 text; null hashes as ''."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


# --- tokens ---------------------------------------------------------------------------


def tokens_of(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(TOKEN_PATTERN), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-case word tokens; inner apostrophes and hyphens stay inside a token."""
    return tokens_of(normalise(text))


def once(value: Column) -> Column:
    """Compute a value one time per row when used as the only generator of a select.

    Adjacent projections are merged, which would copy a costly expression into every
    lambda that mentions the column; a one-element explode keeps it a column.
    """
    return F.explode(F.array(value))


def ngrams(tokens: Column, lengths: Sequence[int]) -> Column:
    """Distinct contiguous runs of the given lengths, each joined by one space."""
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        cut = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, cut).otherwise(none)

    parts = [runs(n) for n in sorted(set(lengths))]
    return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])


def contains_seq(tokens: Column, form: Column) -> Column:
    """``form`` (tokens joined by a space) is a contiguous run of ``tokens``."""
    hay = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.coalesce(
        (form != "") & F.contains(hay, F.concat(F.lit(" "), form, F.lit(" "))), F.lit(False)
    )


def phrase_forms(term: Column, source_forms: Column) -> Column:
    """Declared forms, else the term itself, as space-joined tokens; empty ones drop out.

    Tokens are cut per form: a line feed between the forms keeps them apart, so a single
    normalisation serves the whole list.
    """
    declared = F.coalesce(F.size(source_forms) > 0, F.lit(False))
    forms = F.when(declared, source_forms).otherwise(F.array(term))
    flat = F.transform(forms, lambda f: F.replace(f, F.lit("\n"), F.lit(" ")))
    cut = F.split(normalise(F.array_join(flat, "\n")), "\n")
    joined = F.transform(cut, lambda f: F.array_join(tokens_of(f), " "))
    return F.array_distinct(F.filter(joined, lambda f: f != ""))


def quote_pattern(text: Column) -> Column:
    """Quote a literal for a Java pattern built from a column."""
    return F.concat(
        F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )


# --- small formats --------------------------------------------------------------------


def pct(n: Column, total: Column) -> Column:
    """``n/total (p%)`` with the floor of the percentage; 0 when there is nothing."""
    share = F.coalesce(F.floor(F.try_divide(n * 100, total)), F.lit(0))
    return F.concat(n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("),
                    share.cast("string"), F.lit("%)"))


def overflow_list(items: Column, total: Column | None = None, shown: int = 12) -> Column:
    """First items joined by commas, then ``… (+k)`` for the rest."""
    total = F.size(items) if total is None else total
    head = F.array_join(F.slice(items, 1, shown), ", ")
    more = F.concat(head, F.lit(" … (+"), (total - shown).cast("string"), F.lit(")"))
    return F.when(total > shown, more).otherwise(head)


def clean_headword(bold: Column) -> Column:
    return F.regexp_replace(bold, "[.,:;]+$", "")


def clean_definition(text: Column, headword: Column) -> Column:
    """What follows the headword, without leading dashes, dots and colons."""
    rest = F.substring(text, F.length(headword) + 1, F.length(text))
    return squeeze_ends(F.regexp_replace(rest, "^[ .—–:-]+", ""))


def keep_headword(headword: Column) -> Column:
    return (F.length(headword) > 0) & (F.length(headword) < 80)


def clean_agent_json(raw: Column) -> Column:
    """The outermost ``{...}`` of a reply, without code fences; null when there is none."""
    text = squeeze_ends(raw)
    fenced = text.startswith("```")
    body = F.regexp_replace(F.regexp_replace(text, "^```[a-zA-Z]*\n", ""), r"(?U)\n```\s*$", "")
    found = F.regexp_extract(F.when(fenced, body).otherwise(text), r"(?s)\{.*\}", 0)
    return blank_to_null(found)


def null_field_digest(translit: Column, source_def: Column, literal: Column, note: Column) -> Column:
    """Comma list of the fields a term still lacks, or ``none``."""

    def lacks(group: Column) -> Column:
        return ~F.forall(F.array(*[group[lang] for lang in LANGS]), is_filled)

    missing = F.array_compact(
        F.array(
            F.when(lacks(translit), "translit"),
            F.when(~is_blank(source_def) & lacks(literal), "def"),
            F.when(lacks(note), "note"),
        )
    )
    return F.coalesce(blank_to_null(F.array_join(missing, ",")), F.lit("none"))


def glossary_view(translit: Column, note: Column, literal: Column, lang: str) -> Column:
    """What a glossary card shows in one language; languages never fall back here."""
    none = F.lit(None).cast("string")
    return F.struct(
        (translit[lang] if lang in LANGS else none).alias("rendering"),
        note[lang].alias("note"),
        (literal[lang] if lang in LANGS else none).alias("literal"),
    )
