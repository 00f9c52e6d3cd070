"""Reference-shaped tables derived from the given tables by Spark.

The given data has no chapters, translations or glossary, so they are derived row by row:
book = ``documents.source``, chapter = one document, verse = one line, dictionary =
leading words of ``benchmark``, overlay = ``labels``.  Gaps, repeats and wrong values are
planted by fixed rules on ids, so every rule and merge case occurs at every scale.
``sql.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import tokenize
from lectern.session import ship


def none() -> Column:
    return F.lit(None).cast("string")


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a table comes in fewer splits than there are cores.

    That is only the case for tables far smaller than the cluster; a large table has more
    splits than cores and is read as it lies, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _case(*pairs, otherwise=None) -> Column:
    out = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def _text(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _add(*parts) -> Column:
    return F.concat(*[_text(p).cast("string") for p in parts])


def verse_struct(d: Column, chapter_id: Column, line: Column, o: Column) -> Column:
    """One derived verse of document ``d`` at 1-based position ``o``."""
    number = _case(
        ((d % 10 == 0) & (o == 3), F.lit(2)), (d % 9 == 4, (o + 1).cast("int")),
        otherwise=o.cast("int"),
    )
    vid = _add(chapter_id, ".", number)
    zh_hant = _case(
        (d % 4 == 0, none()), ((d % 4 == 1) & (o % 2 == 0), F.lit("")),
        ((d % 7 == 3) & (o % 4 == 0), _add("ア", line)), otherwise=_add("譯", F.lower(line)),
    )
    zh_hans = F.when(d % 5 != 0, _add("译", line))
    ja = _case((o % 3 == 0, F.lit("")), (o % 3 == 1, none()), otherwise=_add("ア", line))
    caption = F.struct(
        _add("Plate ", d % 50).alias("en"), F.when(d % 2 == 0, "圖").alias("zh_hant"),
        none().alias("zh_hans"), none().alias("ja"),
    )
    first = F.struct(
        _add("/plates/image", d % 50, ".jpg").alias("src"), F.lit("1").alias("edition"),
        caption.alias("caption"),
    )
    second = F.struct(
        _add("/plates/sign", o, ".gif").alias("src"), F.lit("1").alias("edition"),
        F.lit(None).cast(caption_type()).alias("caption"),
    )
    images = F.when(o % 20 == 0, F.array(first, second)).when(o % 10 == 0, F.array(first))
    tags = F.when(o % 5 == 0, F.array(_add("t", d % 40))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        vid.alias("id"), number.alias("verse_number"), line.alias("en"),
        zh_hant.alias("zh_hant"), zh_hans.alias("zh_hans"), ja.alias("ja"),
        tags.alias("glossary_terms"), F.lit(None).cast("int").alias("plate_ref"),
        F.array().cast("array<string>").alias("notes"), images.alias("images"),
    )


def rich_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose preamble and captions hold running text, in the source and in translation."""
    ch = chapters(spark, sf_dir)
    d, line = F.col("chapter"), F.get("verses", F.lit(0))["en"]
    text = lambda en, hant, hans: F.struct(
        en.alias("en"), hant.alias("zh_hant"), hans.alias("zh_hans"), none().alias("ja"))
    preamble = text(_add("Epigraph ", line), F.when(d % 6 == 0, _add("序", F.lower(line))), F.when(d % 5 == 0, line))

    def pictured(v: Column) -> Column:
        caption = text(_add("Plate ", d % 50, " ", v["en"]), F.when(d % 2 == 0, _add("圖", F.lower(v["en"]))), F.when(d % 3 == 0, v["en"]))
        images = F.transform(v["images"], lambda im, k: F.when(k == 0, im.withField("caption", caption)).otherwise(im))
        return v.withField("images", images)

    return ch.withColumn("preamble", preamble).withColumn("verses", F.transform("verses", pictured))


def caption_type() -> str:
    return schemas.I18N.simpleString()


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested chapters; derived inside each document row."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    cid = _add(F.col("source"), ".", d)
    preamble = F.struct(
        _case((d % 3 == 0, _add("Epigraph ", d)), (d % 3 == 1, none()), otherwise=F.lit("")).alias("en"),
        F.when(d % 6 == 0, "序").alias("zh_hant"), none().alias("zh_hans"), none().alias("ja"),
    )
    return docs.select(
        cid.alias("id"), F.col("source").alias("book"), d.alias("chapter"),
        _add(F.col("source"), " — Chapter ", d).alias("title"),
        preamble.alias("preamble"),
        F.when(d % 6 == 0, "word-1882").when(d % 12 == 3, "sacred-texts").alias("preamble_source"),
        F.transform(
            F.split("text", "\n"), lambda line, i: verse_struct(d, cid, line, i + 1)
        ).alias("verses"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded book dimension: sources with suffix below 15; some counts are off by one."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    k = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return counts.withColumn("position", k).where(k < 15).select(
        F.col("source").alias("slug"),
        F.when(F.col("position") % 2 == 0, _add("Book ", F.col("position"))).alias("title"),
        (F.col("n") + F.when(F.col("position") % 3 == 0, 1).otherwise(0)).alias("chapter_count"),
        "position",
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary: headword = first two words of a benchmark text; forms of two and three."""
    tokens = table(spark, sf_dir, "benchmark").select(
        "item_id", tokenize(F.col("text")).alias("tok")
    ).where(F.size("tok") >= 3)
    i = F.col("item_id")

    def words(n: int) -> Column:
        return F.array_join(F.slice("tok", 1, n), " ")

    second, first = F.get("tok", F.lit(1)), F.get("tok", F.lit(0))
    return tokens.select(
        _add("t", i).alias("slug"), words(2).alias("term"),
        F.when(i % 2 == 0, "name").otherwise("term").alias("category"),
        F.array(words(2), words(3)).alias("source_forms"),
        F.struct(
            _add("譯", second).alias("zh_hant"), second.alias("zh_hans"),
            F.when(i % 3 != 0, _add("ア", first)).alias("ja"),
        ).alias("translit"),
        F.when(i % 5 != 0, _add("About ", words(3))).alias("source_def"),
        F.struct(
            F.when(i % 4 == 0, "注").alias("zh_hant"), none().alias("zh_hans"), F.lit("").alias("ja")
        ).alias("source_def_literal"),
        F.struct(
            _add("Note ", i).alias("en"), F.lit("記").alias("zh_hant"), F.lit("记").alias("zh_hans"),
            F.when(i % 2 == 0, "メモ").alias("ja"),
        ).alias("editor_note"),
        i.alias("position"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned translations of the odd documents, with planted defects."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == 1)
    d = F.col("doc_id")
    cid = _add(F.col("source"), ".", d)
    lines = F.split("text", "\n")

    def verse(line: Column, i: Column) -> Column:
        o = i + 1
        v = verse_struct(d, cid, line, o)
        return F.struct(
            F.when((d % 13 == 1) & (o == 2), _add("x.", d, ".", o)).otherwise(v["id"]).alias("id"),
            F.when((d % 19 == 1) & (o == 1), _add("カ", line)).otherwise(_add("新", line)).alias("zh_hant"),
            F.when((d % 17 == 1) & (o == 1), F.lit(" ")).otherwise(_add("新", F.lower(line))).alias("zh_hans"),
            _add("ア", line).alias("ja"),
            F.when(o % 4 == 0, F.array(_add("t", o % 50))).when(o % 4 == 1, F.lit(None).cast("array<string>"))
            .otherwise(F.array().cast("array<string>")).alias("glossary_terms"),
        )

    every = F.transform(lines, verse)
    kept = F.when((d % 11 == 1) & (F.size(lines) > 1), F.slice(every, F.lit(1), F.size(lines) - 1)).otherwise(every)
    captions = F.filter(
        F.transform(
            lines,
            lambda line, i: F.when(
                ((i + 1) % 10 == 0) & (d % 5 != 1),
                F.struct(
                    _add(verse_struct(d, cid, line, i + 1)["id"], "#0").alias("cap_idx"),
                    _add("Plate ", d % 50).alias("en"), F.lit("圖新").alias("zh_hant"),
                    F.lit("图新").alias("zh_hans"),
                    F.when((i + 1) % 20 != 0, "図新").alias("ja"),
                ),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    extra = F.array(
        F.struct(
            _add(cid, ".0#9").alias("cap_idx"), F.lit("?").alias("en"), F.lit("多").alias("zh_hant"),
            F.lit("多").alias("zh_hans"), F.lit("多").alias("ja"),
        )
    )
    return docs.select(
        F.col("source").alias("book"), cid.alias("chapter_id"),
        F.when(d % 23 == 1, "old").otherwise(_add("v-", F.col("source"))).alias("snapshot_version"),
        F.when(d % 31 == 2, none()).otherwise(_add("sha-", F.col("source"))).alias("book_en_sha"),
        F.struct(
            F.lit("序新").alias("zh_hant"), F.lit("序新").alias("zh_hans"),
            F.when(d % 4 != 1, "序ア").alias("ja"),
        ).alias("preamble"),
        F.when(d % 15 == 7, F.concat(captions, extra)).otherwise(captions).alias("captions"),
        kept.alias("verses"),
        F.when(d % 29 == 1, F.array(F.lit("zed"), F.lit("abc"))).otherwise(
            F.array().cast("array<string>")
        ).alias("unknown_terms"),
        d.alias("chapter"),
    )


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epigraphs for the labelled documents; also one for a chapter that does not exist."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    real = labels.join(docs, "doc_id").select(
        F.col("source").alias("book"), F.col("doc_id").alias("chapter"),
        F.when(F.col("quality") == 1, _add("Overlay ", F.col("doc_id"))).otherwise("").alias("epigraph"),
    )
    lost = labels.where(F.col("doc_id") % 50 == 0).select(
        F.lit("lost").alias("book"), F.col("doc_id").alias("chapter"), F.lit("Lost").alias("epigraph")
    )
    return real.unionByName(lost)


def stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large dictionary derived from documents, with null and '' leaves."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 != 0)
    d = F.col("doc_id")
    return docs.select(
        _add("Term ", d).alias("term"), _add("s", d).alias("slug"), F.lit("name").alias("category"),
        F.struct(
            _case((d % 4 == 0, none()), (d % 4 == 1, F.lit("")), otherwise=_add("甲", d)).alias("zh_hant"),
            F.when(d % 5 != 0, _add("乙", d)).alias("zh_hans"),
            F.when(d % 7 != 0, _add("ア", d)).alias("ja"),
        ).alias("translit"),
        F.when(d % 2 == 0, "def").alias("source_def"),
        F.struct(none().alias("zh_hant"), none().alias("zh_hans"), F.lit("ル").alias("ja")).alias("source_def_literal"),
        F.struct(
            F.lit("n").alias("en"), none().alias("zh_hant"), none().alias("zh_hans"), none().alias("ja")
        ).alias("editor_note"),
        F.when(d % 6 == 1, F.array(_add("form ", d))).alias("source_forms"),
        F.lit(False).alias("locked"), F.when(d % 8 == 0, "x.1").alias("first_seen"),
        d.alias("position"),
    )


def term_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills and coins over the same slugs: repeats, unknown fills, coins of known slugs."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    n = F.when(d % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = docs.select("doc_id", "source", F.explode(n).alias("copy"))
    c = F.col("copy")
    return rows.select(
        F.when((d % 5 == 0) | (d % 3 == 0), "coin").otherwise("fill").alias("kind"),
        _add("s", d).alias("slug"), (d * 10 + c).alias("pos"),
        _add(F.col("source"), ".", d).alias("chapter_id"),
        _add("Term ", d, "/", c).alias("term"), F.lit("term").alias("category"),
        F.struct(
            F.when(c == 1, _add("新", d)).otherwise(_add("再", d)).alias("zh_hant"),
            F.when(d % 2 == 1, _add("乙", d)).alias("zh_hans"),
            F.when(c == 2, _add("カ", d)).alias("ja"),
        ).alias("translit"),
        none().alias("source_def"),
        F.struct(F.lit("直").alias("zh_hant"), none().alias("zh_hans"), F.lit("ル").alias("ja")).alias("source_def_literal"),
        F.struct(
            none().alias("en"), F.when(d % 4 == 0, "記").alias("zh_hant"), none().alias("zh_hans"), none().alias("ja")
        ).alias("editor_note"),
        F.array(_add("form ", d), _add("a form ", c)).alias("source_forms"),
        none().alias("first_seen"),
    )


def elements(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """Element stream of one page per document.

    Line 1 is the book title anchor; every 12th line from 2 on a chapter anchor; lines 7
    and 11 of each dozen pictures; line 4 an epigraph paragraph; line 3 a chapter heading;
    line 13, 37, ... a gallery anchor; the rest numbered verses.  ``kept`` columns stay.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), "source", F.posexplode(F.split("text", "\n")).alias("_i", "line")
    )
    o = (F.col("_i") + 1).cast("bigint")
    m = o % 12
    k = F.floor((o - 2) / 12) + 1
    tag = _case(
        (o == 1, "a"), (o % 24 == 13, "a"), (m == 2, "a"), (m.isin(7, 11), "img"), otherwise=F.lit("p")
    )
    name = _case(
        (o == 1, _add("title_", F.col("source"))), (o % 24 == 13, _add("gallery_", F.col("source"))),
        (m == 2, _add(F.col("source"), "_", k)),
    )
    text = _case(
        (F.lit(True) & tag.isin("a", "img"), F.lit("")), (m == 3, _add("CHAPTER ", k, ".")),
        (m == 4, F.col("line")), otherwise=_add(o, ". ", F.col("line")),
    )
    return docs.select(
        "page_id", *kept, o.alias("pos"), tag.alias("tag"), name.alias("name"),
        F.when(m.isin(7, 11) & (o != 1) & (o % 24 != 13), _add("x_files/image", o % 40, ".jpg")).alias("src"),
        text.alias("text"),
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor dimension of the element stream: one set of rows per source."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    s = F.col("source")
    null_long = F.lit(None).cast("bigint")

    def row(key: Column, kind: str, chapter: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(kind).alias("kind"), s.alias("slug"), chapter.alias("chapter"))

    return sources.select(
        F.explode(
            F.array(
                row(_add("title_", s), "title", null_long),
                row(_add(s, "_"), "chapter", null_long),
                row(_add("gallery_", s), "gallery_last_verse", F.lit(1).cast("bigint")),
            )
        ).alias("r")
    ).select("r.*")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range map over doc_id: 70 wide out of every 100, so there are gaps; no tail."""
    hundreds = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 100).alias("h")
    ).distinct().where(F.col("h") % 8 != 7)
    return hundreds.select(
        (F.col("h") * 100).alias("lo"), (F.col("h") * 100 + 69).alias("hi"),
        _add("r", F.col("h")).alias("slug"), _add("Range ", F.col("h")).alias("title"),
        F.col("h").alias("position"),
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
