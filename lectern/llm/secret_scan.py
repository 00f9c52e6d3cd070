"""Secret scan (native): known forms, and sliding-window entropy per character class.

Known forms are found by expressions.  Other secrets are found by their disorder: in every
long run of code-like characters a window of ``WINDOW`` characters slides along; its counts
per character change by one in and one out, and with them the sum of ``c * log2(c)``, kept
in whole numbers.  A window is hot if its Shannon entropy reaches the limit of its class.
What an allow-list knows is cut out of the run, namely identifiers, alphabets and placeholder
words, and so is what already lies in a known form; the parts beside it are scanned like
runs.  A run that ends as documented sample keys do is left alone.  A run in one case that holds
separators is scanned whole if it mixes letters and digits as keys do, or holds a long piece
without separators.  Letters alone are a class with a limit of their own, which words do not reach;
digits alone are a known form at every length that a window has.

Work grows in proportion to a text's length and number of matches (by sums over blocks of
matches and by halving), so a log file of many identifiers is one row like others.

Positions count characters of the text, not bytes; ends are exclusive.

Defined results: a null text is an empty one, without spans; texts of any length are read
whole; ties of start are listed in the order of ``KINDS``; repeated rows are scanned alike;
an empty table gives no rows.  Other columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base36", "entropy_base64", "entropy_letters")

WINDOW = 20
SCALE = 1 << 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Entropy in bits that makes a window hot, by the class of the run's characters.
LIMITS = {"entropy_hex": 3.0, "entropy_base36": 3.5, "entropy_base64": 3.7, "entropy_letters": 4.0}
# What is cut out of a run, alphabets and placeholder words, and how sample keys end.
ALLOWED = "(?i)abcdefghij[a-z]*|0123456789|qwertyuiop|examples?|samples?|placeholders?|dummy|changeme|xxxx+"
SAMPLE = "EXAMPLE(?:KEY)?$"
IDENTIFIER = r"(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])"
#: In one case with separators: four digits beside letters, or four digits and a piece of a window's length.
MIXED = r"(?:(?:(?<=[A-Za-z])[0-9]|[0-9](?=[A-Za-z])).*){4}"
PIECE = rf"[A-Za-z0-9]{{{WINDOW}}}"
MASK = "[secret]"
#: Values summed at once, characters cut at once.
BLOCK, CHUNK = 64, 1024

SPAN = "struct<start:int,rank:int,end:int>"


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, merge) -> Column:
    """Of every whole number: all earlier ones merged, from 0.  Sums over blocks keep this short of the square."""
    fold = lambda part: F.aggregate(part, F.lit(0), lambda a, v: merge(a, v).cast("int"))

    def of(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: fold(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))

        def placed(sums: Column) -> Column:
            starts = F.transform(sums, lambda _, b: fold(F.slice(sums, F.lit(1), b)))
            return _let(starts, lambda heads: F.transform(xs, lambda _, i: merge(
                F.get(heads, F.floor(i / BLOCK).cast("int")),
                fold(F.slice(xs, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, i % BLOCK))).cast("int")))

        return F.when(F.size(xs) > 0, _let(totals, placed)).otherwise(F.array().cast("array<int>"))

    return _let(values, of)


def _placed(found: Column, between: Column) -> Column:
    """start and text of each match, from the matches and the text between them."""
    none = _empty("struct<start:int,text:string>")

    def of(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["text"]))
        return F.zip_with(pairs, _before(steps, lambda a, v: a + v), lambda p, at: F.struct(
            (at + F.char_length(p["gap"])).cast("int").alias("start"), p["text"].alias("text")))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("text")))
    return F.when(F.size(found) > 0, _let(pairs, of)).otherwise(none)


def _spans(placed: Column, rank: int) -> Column:
    return F.transform(placed, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.char_length(m["text"])).cast("int").alias("end")))


def _kind_of(run: Column) -> Column:
    """The class of a run of code-like characters; null for plain ones."""
    upper, lower, digit = run.rlike("[A-Z]"), run.rlike("[a-z]"), run.rlike("[0-9]")
    digits = run.rlike("(?:[0-9].*){4}")
    other = F.regexp_replace(run, IDENTIFIER, "-")
    return (
        F.when(run.rlike(f"^{IDENTIFIER}$"), F.lit(None).cast("string"))
        .when(run.rlike("^[A-Za-z]+$"), F.lit("entropy_letters"))
        .when(run.rlike("^[0-9+/_=-]*$") | run.rlike("^[A-Za-z+/_=-]*$"), F.lit(None).cast("string"))
        .when(run.rlike("^[0-9A-F]+$") | run.rlike("^[0-9a-f]+$"), F.lit("entropy_hex"))
        .when(upper & lower & digit, F.lit("entropy_base64"))
        .when((upper != lower) & digits & run.rlike("^[A-Za-z0-9]+$"), F.lit("entropy_base36"))
        .when((upper != lower) & digits & (other.rlike(MIXED) | other.rlike(PIECE)), F.lit("entropy_base36"))
    )


def _hot(run: Column, kind: Column) -> Column:
    """first and last: where the first hot window of a run starts and the last one ends."""
    chars = F.split(run, "")
    worth = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0) for c in range(WINDOW + 1)])
    most = F.lit(0)
    for name, bits in LIMITS.items():
        most = F.when(kind == name, F.lit(math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE))).otherwise(most)
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, i: Column) -> Column:
        into = _slot(F.element_at(chars, i))
        out = F.when(i > WINDOW, _slot(F.element_at(chars, F.greatest(i - WINDOW, F.lit(1))))).otherwise(F.lit(-1))
        return _advance(acc, i, into, out, worth, most)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(run)), start, step)


def _slot(char: Column) -> Column:
    return F.call_function("locate", char, F.lit(ALPHABET))


def _advance(acc: Column, i: Column, into: Column, out: Column, worth: Column, most: Column) -> Column:
    """One character enters the window and the one ``WINDOW`` before it leaves."""
    counts = acc["counts"]
    had_in = F.element_at(counts, into + 1)
    had_out = F.when(out >= 0, F.element_at(counts, F.greatest(out, F.lit(0)) + 1)).otherwise(F.lit(0))
    value = lambda n: F.element_at(worth, n + 1)
    same = into == out
    gain = F.when(same, F.lit(0)).otherwise(
        value(F.least(had_in + 1, F.lit(WINDOW))) - value(had_in)
        + F.when(out >= 0, value(F.greatest(had_out - 1, F.lit(0))) - value(had_out)).otherwise(F.lit(0)))
    total = (acc["sum"] + gain).cast("long")
    hot = (i >= WINDOW) & (total <= most)
    changed = F.transform(counts, lambda c, k: c + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
    return F.struct(
        changed.alias("counts"), total.alias("sum"),
        F.coalesce(acc["first"], F.when(hot, (i - WINDOW).cast("int"))).alias("first"),
        F.when(hot, i.cast("int")).otherwise(acc["last"]).alias("last"))


def _first_at(starts: Column, value: Column) -> Column:
    """How many of the sorted ``starts`` are below ``value``, by halving."""
    begin = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        below = (at["low"] < at["high"]) & (F.get(starts, middle) < value)
        return F.struct(F.when(below, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(below | (at["low"] >= at["high"]), at["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int")), begin, halve)["low"]


def _parts(m: Column, base: Column) -> Column:
    """start and text of what is left of a run without known forms and allowed words, as far as it is a window long.

    ``base`` holds the known forms by start, the starts alone, and the longest form's length.
    """
    end = m["start"] + F.char_length(m["text"])
    nothing = _empty("struct<start:int,text:string>")
    first = _first_at(base["starts"], m["start"] - base["longest"])
    near = F.when(F.size(base["starts"]) == 0, base["spans"]).otherwise(
        F.slice(base["spans"], first + 1, F.greatest(_first_at(base["starts"], end) - first, F.lit(0))))
    forms = F.filter(near, lambda b: (b["start"] < end) & (b["end"] > m["start"]))
    words = F.when(m["text"].rlike(ALLOWED), F.transform(
        _spans(_placed(F.regexp_extract_all(m["text"], F.lit(ALLOWED), F.lit(0)), F.split(m["text"], ALLOWED, -1)), -1),
        lambda w: F.struct((m["start"] + w["start"]).cast("int").alias("start"), w["rank"].alias("rank"), (m["start"] + w["end"]).cast("int").alias("end")))
    ).otherwise(_empty(SPAN))

    def part(at: Column, to: Column) -> Column:
        text = F.substring(m["text"], at - m["start"] + 1, to - at)
        return F.when(to - at >= WINDOW, F.array(F.struct(at.alias("start"), text.alias("text")))).otherwise(nothing)

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], part(acc["at"], b["start"])).alias("out"))

    start = F.struct(m["start"].alias("at"), nothing.alias("out"))
    return F.when(m["text"].rlike(SAMPLE), nothing).otherwise(_let(F.array_sort(F.concat(forms, words)), lambda cuts: F.when(
        F.size(cuts) == 0, F.array(m)).otherwise(F.aggregate(cuts, start, step, lambda acc: F.concat(acc["out"], part(acc["at"], end))))))


def _added(placed: Column, base: Column) -> Column:
    """Spans of hot runs and parts of runs outside the known forms and allowed words."""
    known = _let(F.array_sort(base), lambda spans: F.struct(
        spans.alias("spans"), F.transform(spans, lambda b: b["start"]).alias("starts"),
        F.coalesce(F.array_max(F.transform(spans, lambda b: b["end"] - b["start"])), F.lit(0)).alias("longest")))
    parts = _let(known, lambda k: F.flatten(F.transform(placed, lambda m: _parts(m, k))))
    named = F.transform(parts, lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), _kind_of(m["text"]).alias("kind")))
    free = F.filter(named, lambda m: m["kind"].isNotNull())
    rank_of = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k).cast("int") - 1
    hot = F.transform(free, lambda m: F.struct(m["start"].alias("start"), rank_of(m["kind"]).alias("rank"), _hot(m["text"], m["kind"]).alias("hot")))
    return F.transform(F.filter(hot, lambda m: m["hot"]["first"].isNotNull()), lambda m: F.struct(
        (m["start"] + m["hot"]["first"]).cast("int").alias("start"), m["rank"].alias("rank"), (m["start"] + m["hot"]["last"]).cast("int").alias("end")))


def scanned(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``_base``, ``_spans``: arrays of start, rank of the kind, end.

    Every step is its own projection, so that each expression reads the text once and only
    texts with a match are cut into pieces.
    """
    forms = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": CANDIDATE}
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", *[F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias(f"_{k}") for k, rx in forms.items()])
    cut = found.select("*", *[
        F.when(F.size(f"_{k}") > 0, F.split(text, rx, -1)).alias(f"_{k}_between") for k, rx in forms.items()])
    placed = cut.select(*docs.columns, *[_placed(F.col(f"_{k}"), F.col(f"_{k}_between")).alias(f"_{k}") for k in forms])
    long_enough = F.filter("_assign", lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 12)
    based = placed.select(*docs.columns, "_run", F.concat(_spans(long_enough, 0), _spans(F.col("_access"), 1), _spans(F.col("_hex"), 2)).alias("_base"))
    return based.select(*docs.columns, "_base", F.array_sort(F.concat("_base", _added(F.col("_run"), F.col("_base")))).alias("_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, by start and kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    scan = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    number = lambda rank: F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("long")
    return scan.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``MASK``; ``n_chars`` follows where it exists."""
    scan = scanned(docs)

    def masked(chunks: Column) -> Column:
        def cut(at: Column, to: Column) -> Column:
            # Only the chunks that a piece lies in are put together.
            first, last = F.floor(at / CHUNK).cast("int"), F.floor(to / CHUNK).cast("int")
            held = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
            return F.substring(held, at - first * CHUNK + 1, to - at)

        def piece(span: Column, at: Column) -> Column:
            # Spans that overlap share one mask.
            return F.when(span["start"] >= at, F.concat(cut(at, span["start"]), F.lit(MASK))).otherwise(F.lit(""))

        ends = F.transform("_spans", lambda s: s["end"])
        last = F.array_max(ends)
        pieces = F.zip_with(F.col("_spans"), _before(ends, F.greatest), piece)
        rest = cut(last, F.char_length("text"))
        return F.concat(F.array_join(pieces, ""), rest)

    masked = _let(F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), masked)
    out = scan.withColumn("text", F.when(F.size("_spans") > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
