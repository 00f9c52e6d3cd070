"""Benchmark decontamination by templates (native).

Words become a template: numbers, names (capitalised inside a sentence) and units after a
number are replaced by typed placeholders, other words are lower-cased (Latin letters) and
lose their punctuation, currency and equals signs.  Names in a row are one placeholder.  A
capital at the start of a sentence may be a name or not, so such a word, with the names that
follow it, is taken out of the template and kept beside the next word as a value that may
change.  Windows of ``WINDOW`` template words are hashed and joined with those of the
benchmark: every window of an item with every window of a document, wherever it starts.
Windows that lie alike in document and item form an alignment.  In it the filled placeholders
and sentence starts are compared: a question with other numbers or names in it is still the
same question if every value of the item is replaced by one value throughout.

A document leaks an item if the windows of one alignment cover ``ENOUGH`` words, or one window
of an item of less than two windows' words, either with equal values, or with consistently
replaced ones and then at least half of the item's words (less ``LOOSE``).  Words put in or
left out shift an alignment, so alignments of an item that lie within its length are also
judged together, by the words of the item that they cover between them.

Beside the templates, a document leaks an item whose words it holds whole and in order, in any
case and with any signs but sentence ends between them, whatever the item's length and
however few plain words it has.  An item of fewer than ``PHRASE`` words ("Paris") is found in
every text that mentions it, so it leaks only where it makes up a whole sentence or line.

Only windows that can match are built: every window of a document holds exactly one stretch of
``PIECE`` words that starts at a ``STEP``-th word within its first ``STEP`` words, and a stretch
that no item's window holds there rules out its ``STEP`` windows.  This leaves out no match.

Defined results: null and empty texts hold nothing, items without a word are never reported;
an item shorter than the window is one window of its own length; windows with fewer than
``LITERAL`` plain words are common to too many texts and identify nothing; rows of one id are
judged together; rows without an id are judged by their text, reported with a null id, and
removed where they leak; an empty benchmark reports nothing.  Only ``doc_id`` and ``text`` of
the documents and ``item_id`` and ``text`` of the benchmark are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.probe import MOST_ENTRIES, Probe, listed, probe_of, strings

WINDOW = 8
LITERAL = 4
#: Words, not windows.
ENOUGH = 12
#: Words at the ends of an item that need not count when half of it is asked for.
LOOSE = 3
STEP = 4
PIECE = WINDOW - STEP + 1
#: Fewer words than this must be a whole sentence or line.
PHRASE = 4
#: Items and bytes of their texts up to which whole items are sought inside the row, beyond them by joins.
ROW_BYTES = 2_000_000
#: Anchors up to which the words of a row are intersected with all of them; more are probed one by one.
FEW = 2000
#: The benchmark's windows are broadcast up to this many bytes, beyond it they are joined by shuffle.
BROADCAST_BYTES = 16_000_000
#: Ids up to this many rows (8 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000
# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years mph kmh km/h percent dollar dollars euro euros cent cents usd eur gbp"
).split()
# Single characters only: the expression then costs one table look-up per character.
BREAK = "\\t\\n\\x0B\\f\\r !\"'(),.:;?\\[\\]{}«»=$£¥"
BREAKS = f"[{BREAK}]+"
#: Further signs that part words, and what stands for them before the text is cut.
OTHER, OTHERS_AS = "“”„…€₹₩", "\"\"\".$$$"
GAP = "\u0001"
# A mark in front of a word says what it stands for.
NAME, NUMBER, UNIT = "\u0002", "\u0003", "\u0004"
# Stands between names in a row.
JOIN = "\u0005"
# Around a sentence start, in front of the next word.
START = "\u0006"
OF_ITEM = ("doc_id", "text_key", "item_id", "n_windows", "n_words", "width")
#: What identifies a document: its id, or where it has none the digest of its text.
KEYS = ("doc_id", "text_key")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often and wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _marked(text: Column) -> Column:
    """The text with a mark before every name, number and unit, and sentence starts tied to the next word.

    Each costly replacement only runs on texts that hold what it replaces.
    """
    marks = NAME + NUMBER + UNIT + GAP + JOIN + START
    units = "|".join(sorted(UNITS, key=len, reverse=True))

    def plain(text: Column) -> Column:
        return F.when(text.rlike(f"[\u0001-\u0006{OTHER}]"), F.translate(text, OTHER + marks, OTHERS_AS)).otherwise(text)

    def named(text: Column) -> Column:
        # After a full stop, a colon or a line break a capital says nothing.
        return F.regexp_replace(text, r"[ \t](?<=[^\s.!?:|][ \t])(?=\p{Lu})", f"$0{NAME}")

    def numbered(text: Column) -> Column:
        return F.when(text.rlike("[0-9]"), F.regexp_replace(
            F.regexp_replace(F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", ""),
                             rf"(^|[{BREAK}])([^{BREAK}\s\p{{L}}\p{{N}}\u0001-\u0006]{{0,3}}[0-9])", f"$1{NUMBER}$2"),
            rf"({NUMBER}\S{{1,40}}\s)(?=(?i:{units})[.,;:!?)]*(?:\s|$))", f"$1{UNIT}")).otherwise(text)

    def tied(text: Column) -> Column:
        started = F.regexp_replace(text, rf"\p{{Lu}}(?<![^{BREAK}]\p{{Lu}})", f"{START}$0")
        joined = F.regexp_replace(started, rf"[ \t]{NAME}(?<=[{NAME}{START}][^{BREAK}]{{1,60}}[ \t]{NAME})", JOIN)
        return F.regexp_replace(joined, rf"{START}([^{BREAK}]+){BREAKS}", f"{START}$1{START}")

    def closed(text: Column) -> Column:
        # A sentence start that no word follows.
        return F.when(text.endswith(START), F.regexp_replace(text, f"{START}[^{BREAK}]*{START}$", "")).otherwise(text)

    # Patterns start with a character that is consumed, so most positions are passed over at once.
    # Each step names its text once: an expression that is used twice would be computed twice.
    return let(tied(let(named(let(text, plain)), numbered)), closed)


def templates(df: DataFrame, *keys: str) -> DataFrame:
    """keys and ``t``: hashes of the template words, values of the placeholders and sentence starts, if there are any."""
    def of(words: Column) -> Column:
        marked = lambda w: w < "\u0005"  # noqa: E731  no other word starts so low
        tied = lambda w: w.startswith(START)
        bare = lambda w: F.substring_index(w, START, -1)
        small = lambda w: (w >= "a") & (w < "{")  # noqa: E731  no need to lower-case a word that starts small
        plain = lambda w: F.when(marked(w), F.xxhash64(F.substring(w, 1, 1))).otherwise(F.xxhash64(F.lower(w)))
        value = lambda w: F.when(marked(w), F.lower(F.substring(w, 2, 2**31 - 1)))
        hashes = F.transform(words, lambda w: F.when(small(w), F.xxhash64(w)).when(tied(w), plain(bare(w))).otherwise(plain(w)))
        values = F.transform(words, lambda w: value(F.when(tied(w), bare(w)).otherwise(w)))
        starts = F.transform(words, lambda w: F.when(tied(w), F.lower(F.substring(w, F.lit(1), F.char_length(w) - F.char_length(bare(w))))))
        return F.struct(
            hashes.alias("hashes"), F.when(F.exists(words, lambda w: w < "\u0007"), values).alias("slots"),
            F.when(F.exists(words, tied), starts).alias("starts"))

    words = F.array_remove(F.split(_marked(F.coalesce(F.col("text"), F.lit(""))), BREAKS), "")
    return df.select(*keys, let(words, of).alias("t"))


def _windows(t: Column, n: int, first: Column) -> Column:
    """position, hash, slots, starts of all windows of ``n`` words; the first word stands at ``first``."""
    hashes, slots, starts = t["hashes"], t["slots"], t["starts"]
    places = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - n + 1)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        filled = F.when(slots.isNotNull(), F.array_join(F.slice(slots, i, n), GAP)).otherwise(F.lit(""))
        at = F.when(starts.isNotNull(), F.array_join(F.transform(
            F.slice(starts, i, n), lambda s, k: F.when(s.isNotNull(), F.concat(k.cast("string"), s))), GAP)).otherwise(F.lit(""))
        return F.struct(
            (first + i - 1).alias("position"), F.xxhash64(F.lit(n), F.slice(hashes, i, n)).alias("hash"), filled.alias("slots"),
            at.alias("starts"))

    return F.transform(places, window)


def _stretches(t: Column, known: Probe) -> Column:
    """piece, first, t: of every ``STEP``-th word, its piece, if it may be one of the benchmark's, and the words of its ``STEP`` windows."""
    hashes, slots, starts = t["hashes"], t["slots"], t["starts"]
    places = F.filter(F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(1), F.size(hashes) - PIECE + 1, F.lit(STEP))).otherwise(
        F.array().cast("array<int>")), lambda i: known(F.xxhash64(F.slice(hashes, i, PIECE))))

    def stretch(i: Column) -> Column:
        first = F.greatest(i - STEP + 1, F.lit(1))
        n = i + WINDOW - first
        return F.struct(
            F.xxhash64(F.slice(hashes, i, PIECE)).alias("piece"), first.alias("first"), F.struct(
                F.slice(hashes, first, n).alias("hashes"), F.when(slots.isNotNull(), F.slice(slots, first, n)).alias("slots"),
                F.when(starts.isNotNull(), F.slice(starts, first, n)).alias("starts")).alias("t"))

    return F.transform(places, stretch)


def _covered(positions: Column, width: Column | int) -> Column:
    """How many words the windows at these positions cover."""
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(i.cast("int").alias("at"), (acc["n"] + F.least(F.lit(width), F.coalesce(i - acc["at"], F.lit(width)))).cast("int").alias("n"))

    return F.aggregate(F.array_sort(positions), start, step, lambda acc: acc["n"])


def index(items: DataFrame) -> DataFrame:
    """item_id, n_template, item_at, hash, item_slots, item_starts, width, pieces, n_windows, n_words of the benchmark's telling windows."""
    from lectern.llm.store import cut

    keyed = items.where("text is not null").withColumn("item_id", F.col("item_id").cast("long"))
    ready = cut(templates(keyed, "item_id").where(F.size("t.hashes") >= LITERAL), "items")
    out = None
    for n in range(LITERAL, WINDOW + 1):
        own = ready.where(F.size("t.hashes") == n if n < WINDOW else F.size("t.hashes") >= WINDOW)
        rows = own.select("item_id", "t", F.explode(_windows(F.col("t"), n, F.lit(1))).alias("w")).select(
            "item_id", F.size("t.hashes").alias("n_template"), F.col("w.position").alias("item_at"), "w.hash", F.col("w.slots").alias("item_slots"), F.col("w.starts").alias("item_starts"),
            (n - F.when(F.col("w.slots") == "", 0).otherwise(F.size(F.split("w.slots", GAP)))).alias("literal"), F.lit(n).alias("width"),
            (F.array(*[F.xxhash64(F.slice("t.hashes", F.col("w.position") + k, PIECE)) for k in range(STEP)]) if n == WINDOW else
             F.array().cast("array<bigint>")).alias("pieces"))
        out = rows if out is None else out.unionByName(rows)
    telling = out.where(F.col("literal") >= LITERAL).drop("literal").distinct()
    counts = telling.groupBy("item_id").agg(F.collect_set("item_at").alias("at"), F.max("width").alias("_width")).select(
        "item_id", F.size("at").cast("long").alias("n_windows"), _covered(F.col("at"), F.col("_width")).alias("n_words"))
    return telling.join(counts, ["item_id"])


def _pairs(theirs: Column, ours: Column) -> Column:
    """Pairs of values; names in a row word by word if there are as many of them."""
    pair = lambda a, b: F.struct(a.alias("theirs"), b.alias("ours"))
    a, b = F.split(theirs, JOIN), F.split(ours, JOIN)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, pair)).otherwise(F.array(pair(theirs, ours)))


def _replaced() -> Column:
    """Pairs of the item's and the document's values in one window; sentence starts count where both have one."""
    none = F.array().cast("array<struct<theirs:string,ours:string>>")
    slots = F.when(F.col("item_slots") == "", none).otherwise(
        F.flatten(F.zip_with(F.split("item_slots", GAP), F.split("slots", GAP), _pairs)))
    # Place in the window, then what stands there: several starts may be tied to one word.
    place = lambda s: F.substring_index(s, START, 1)
    parts = lambda s: F.array_remove(F.slice(F.split(s, START), F.lit(2), F.size(F.split(s, START))), "")

    def of_start(a: Column) -> Column:
        met = F.filter(F.split("starts", GAP), lambda b: place(a) == place(b))
        return F.flatten(F.transform(met, lambda b: F.when(
            F.size(parts(a)) == F.size(parts(b)), F.flatten(F.zip_with(parts(a), parts(b), _pairs))).otherwise(none)))

    starts = F.when((F.col("item_starts") == "") | (F.col("starts") == ""), none).otherwise(
        F.flatten(F.transform(F.split("item_starts", GAP), of_start)))
    return F.concat(slots, starts)


def _judged(aligned: DataFrame) -> DataFrame:
    """Alignments, or several together, that are leaks, with their ``kind``."""
    consistent = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda v: v["theirs"])))
    enough = F.when(F.col("n_words") < 2 * WINDOW, F.least(F.lit(WINDOW), "n_words")).otherwise(F.lit(ENOUGH))
    words, same = _covered(F.col("found"), F.col("width")), _covered(F.col("same"), F.col("width"))
    kind = F.when(same >= enough, F.lit("copied")).when(
        consistent & (words >= enough) & (2 * words >= F.col("n_words") - LOOSE), F.lit("reparameterised"))
    # The first word may differ by its place in a sentence.
    possible = F.greatest(F.lit(1), F.col("n_windows") - 1)
    share = F.least(F.lit(1.0), F.size("found") / possible)
    return aligned.select(*KEYS, "item_id", F.size("found").alias("found"), share.alias("share"), kind.alias("kind")).where("kind is not null")


def alignments(docs: DataFrame, filed: DataFrame) -> DataFrame:
    """``KEYS``, item_id, shift, found, same, values of whatever meets; ``docs`` has ``KEYS`` and text, ``filed`` is the index."""
    from lectern.llm.store import cut

    facts = filed.agg(
        F.coalesce(F.sum(F.octet_length("item_slots") + F.octet_length("item_starts") + 48), F.lit(0)).alias("bytes"),
        F.collect_set("width").alias("widths")).first()
    short = sorted(set(facts["widths"]) - {WINDOW})  # at most four numbers
    small = facts["bytes"] <= BROADCAST_BYTES
    side, pieces = filed.drop("pieces", "n_template"), filed.select(F.explode("pieces").alias("piece")).distinct()
    side, pieces = (F.broadcast(side), F.broadcast(pieces)) if small else (side, pieces)
    known = probe_of(filed.select(F.explode("pieces").alias("piece")), "piece")
    texts = templates(docs, *KEYS)
    windows = texts.select(*KEYS, F.explode(let(F.col("t"), lambda t: _stretches(t, known))).alias("s")).select(*KEYS, "s.*").join(
        pieces, "piece", "left_semi").select(*KEYS, F.explode(_windows(F.col("t"), WINDOW, F.col("first"))).alias("w"))
    if short:
        windows = windows.unionByName(texts.select(*KEYS, F.explode(let(F.col("t"), lambda t: F.concat(
            *[_windows(t, n, F.lit(1)) for n in short]))).alias("w")))
    met = windows.select(*KEYS, F.col("w.position").alias("at"), "w.hash", "w.slots", "w.starts").join(side, "hash")
    equal = (F.col("slots") == F.col("item_slots")) & (F.col("starts") == F.col("item_starts"))
    # Values that stay the same in one window and change in another also count.
    return cut(met.groupBy(*OF_ITEM, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("found"),
        F.collect_set(F.when(equal, F.col("item_at"))).alias("same"),
        F.array_distinct(F.flatten(F.collect_set(_replaced()))).alias("values")), "aligned")


def template_leaks(aligned: DataFrame) -> DataFrame:
    """``KEYS``, item_id, found, share, kind of leaks by single alignments and by several together."""
    # Shifts within an item's length meet in one of two rows of bands.
    span = F.greatest(F.col("n_words"), F.lit(2 * WINDOW))
    bands = F.array(F.floor(F.col("shift") / span) * 2, F.floor((F.col("shift") + span / 2) / span) * 2 + 1)
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    together = aligned.withColumn("band", F.explode(bands)).groupBy(*OF_ITEM, "band").agg(
        every("found").alias("found"), every("same").alias("same"), every("values").alias("values"), F.count("*").alias("n")).where("n > 1")
    return _judged(aligned).unionByName(_judged(together))


def _line(text: Column) -> Column:
    """Lower-cased words between single blanks, with a mark around the text and at sentence and line ends."""
    ends = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.!?:;]+(?=[\s\"')\]]|$)|[\r\n|]+", f" {GAP} ")
    flat = F.trim(F.regexp_replace(ends, rf"[{BREAK}{OTHER}]+", " "))
    return F.lower(F.regexp_replace(F.concat(F.lit(f" {GAP} "), flat, F.lit(f" {GAP} ")), f"{GAP}(?: +{GAP})+", GAP))


def _pairs_of(line: Column) -> Column:
    """Every word of a line with the next one; marks count as words."""
    def of(words: Column) -> Column:
        return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))

    return F.array_compact(let(F.split(F.trim(line), " "), of))


def whole_items(items: DataFrame) -> DataFrame:
    """item_id, line, anchor: what must stand in a document's line, and the pair of words in it that fewest items hold."""
    inner = F.regexp_replace(_line(F.col("text")), f"^[ {GAP}]+|[ {GAP}]+$", "")
    words = F.array_remove(F.array_remove(F.split("inner", " "), GAP), "")
    named = items.select(F.col("item_id").cast("long").alias("item_id"), inner.alias("inner")).where("inner <> ''").select(
        "item_id", "inner", words.alias("words"))
    phrase = F.when(F.size("words") < PHRASE, F.concat(F.lit(f" {GAP} "), "inner", F.lit(f" {GAP} "))).otherwise(
        F.concat(F.lit(" "), "inner", F.lit(" ")))
    lines = named.select("item_id", phrase.alias("line"))
    each = lines.select("item_id", "line", F.explode(F.array_distinct(_pairs_of(F.col("line")))).alias("pair"))
    share = each.groupBy("pair").agg(F.count("*").alias("n"))
    return each.join(share, "pair").groupBy("item_id", "line").agg(
        F.min(F.struct("n", (-F.char_length("pair")).alias("short"), "pair")).alias("best")).select("item_id", "line", F.col("best.pair").alias("anchor"))


def whole_leaks(docs: DataFrame, sought: DataFrame) -> DataFrame:
    """``KEYS``, item_id of documents that hold an item's words whole and in order; ``sought`` as ``whole_items`` gives them.

    Items of a checked size are looked up inside the row; more are joined by anchors, and
    the texts are joined back for what shares one.
    """
    from lectern.llm.store import cut

    facts = sought.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("bytes")).first()
    if not facts["n"]:
        return docs.select(*KEYS, F.lit(0).cast("long").alias("item_id")).limit(0)
    lines = docs.select(*KEYS, _line(F.col("text")).alias("line"))
    if facts["n"] <= MOST_ENTRIES and facts["bytes"] <= ROW_BYTES:
        listing = sought.orderBy("item_id", "line").collect()
        filed: dict[str, list[int]] = {}
        for n, row in enumerate(listing, 1):
            filed.setdefault(row["anchor"], []).append(n)
        lookup, known = listed(docs.sparkSession, filed), strings([row["line"] for row in listing])
        ids = F.split(F.lit(",".join("" if r["item_id"] is None else str(r["item_id"]) for r in listing)), ",")
        if len(filed) <= FEW:
            met = F.array_intersect(_pairs_of(F.col("line")), strings(sorted(filed)))
        else:
            probe = probe_of(sought, "anchor")
            met = F.filter(F.array_distinct(_pairs_of(F.col("line"))), lambda w: probe(w))
        near = lines.select(*KEYS, "line", F.explode(F.array(met)).alias("met"))
        held = F.filter(F.array_distinct(F.flatten(F.transform("met", lambda w: lookup(w)))), lambda n: F.contains(F.col("line"), F.element_at(known, n)))
        found = near.select(*KEYS, F.explode(held).alias("n"))
        return found.select(*KEYS, F.nullif(F.element_at(ids, F.col("n")), F.lit("")).cast("long").alias("item_id")).distinct()
    probe = probe_of(sought, "anchor")
    kept = cut(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    met = kept.select("row", F.explode(F.filter(F.array_distinct(_pairs_of(F.col("line"))), lambda w: probe(w))).alias("anchor"))
    pairs = met.join(sought, "anchor").select("row", "item_id", F.col("line").alias("sought"))
    return kept.join(pairs, "row").where(F.contains("line", F.col("sought"))).select(*KEYS, "item_id").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """``KEYS`` and text of every document."""
    text_key = F.when(F.col("doc_id").isNull(), F.sha2(F.col("text"), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("text_key"), F.col("text").cast("string").alias("text"))


def copied_whole(docs: DataFrame, aligned: DataFrame, sought: DataFrame) -> DataFrame:
    """``KEYS``, item_id of aligned documents that hold the item's words whole and in order."""
    from lectern.llm.store import cut

    pairs = cut(aligned.select(*KEYS, "item_id").distinct().join(sought.withColumnRenamed("line", "sought"), "item_id"), "pairs")
    side = pairs.select(*[F.col(c).alias(f"_{c}") for c in KEYS], "item_id", "sought")
    side = F.broadcast(side) if pairs.count() <= BROADCAST_ROWS // 10 else side
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_key").eqNullSafe(F.col("_text_key"))
    return docs.join(side, same).where(F.contains(_line(F.col("text")), F.col("sought"))).select(*KEYS, "item_id").distinct()


def found_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``KEYS``, item_id, n_windows, share, kind: one row per document and item.

    A whole copy of an item shares every window of it that lies inside, away from its first
    and last words, whose templates may differ by what stands around them.  So for items with
    such a window only aligned documents are read again; the other items, short ones or ones of
    few plain words, are sought in all texts.
    """
    from lectern.llm.store import cut

    texts = keyed(docs)
    filed = cut(index(items), "benchmark")
    aligned = alignments(texts, filed)
    inside = (F.col("width") == WINDOW) & (F.col("item_at") > 2) & (F.col("item_at") + WINDOW - 1 < F.col("n_template"))
    sought = cut(whole_items(items), "whole-items")
    # An id that several texts share is sought in all texts, too.
    single = sought.groupBy("item_id").agg(F.count("*").alias("n")).where("n = 1 and item_id is not null")
    told = filed.where(inside).select("item_id").distinct().join(single, "item_id", "left_semi")
    rest = cut(sought.join(told, "item_id", "left_anti"), "untold")
    whole = copied_whole(texts, aligned, sought.drop("anchor").join(told, "item_id", "left_semi"))
    if not rest.isEmpty():
        whole = whole.unionByName(whole_leaks(texts, rest))
    copies = whole.select(*KEYS, "item_id", F.lit(0).alias("found"), F.lit(1.0).alias("share"), F.lit("copied").alias("kind"))
    best = template_leaks(aligned).unionByName(copies).groupBy(*KEYS, "item_id").agg(
        F.max("found").alias("found"), F.max("share").alias("share"), F.bool_or(F.col("kind") == "copied").alias("copied"))
    return best.select(
        *KEYS, "item_id", F.col("found").cast("long").alias("n_windows"), "share",
        F.when(F.col("copied"), F.lit("copied")).otherwise(F.lit("reparameterised")).alias("kind"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, share, kind of every leak; a row without an id counts by its text."""
    return found_leaks(docs, items).drop("text_key")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not in ``ids``, columns unchanged.

    A checked number of ids is broadcast, so the texts stay where they are; more are joined
    by shuffle.
    """
    from lectern.llm.store import cut

    gone = cut(ids.select(F.col("doc_id").alias("_gone")).distinct(), "ids")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, F.col("doc_id") == F.col("_gone"), "left_anti")


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak nothing."""
    from lectern.llm.store import cut

    gone = cut(found_leaks(docs, items).select(*KEYS).distinct(), "leaking")
    left = without_ids(docs, gone.where("doc_id is not null"))
    texts = gone.where("doc_id is null").select(F.col("text_key").alias("_gone"))
    if texts.isEmpty():
        return left
    own = F.when(F.col("doc_id").isNull(), F.sha2(F.col("text").cast("string"), 256))
    side = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts
    return left.join(side, own == F.col("_gone"), "left_anti")
