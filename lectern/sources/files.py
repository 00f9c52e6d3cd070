"""Chapter files, dimension files, work lists, change-only writes, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.operators.corpus import pad2
from lectern.operators.fingerprint import snapshot_versions
from lectern.operators.merge import differing
from lectern.operators.sizing import small_side
from lectern.session import cut_lineage


def _exists(spark: SparkSession, path: str) -> bool:
    """Listing through the session's own file systems, so any storage works."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        return bool(files.load(path).select("path").head(1))
    except Exception as error:  # the reader reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """All ``<book>/chapter-*.json`` (one object per file), with the declared schema."""
    return (
        spark.read.schema(schemas.CHAPTER).option("multiLine", "true")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "chapter-*.json").json(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def read_chapter_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of the same files, for checks that need to see malformed ones."""
    files = spark.read.option("recursiveFileLookup", "true")
    return files.option("pathGlobFilter", "chapter-*.json").text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")
    )


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array file as rows with ``position`` from 0; a missing file is an empty table."""
    out = T.StructType([*schema.fields, T.StructField("position", T.IntegerType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], out)
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("position", "r"))
    return rows.select("r.*", "position")


def inventory_numbers(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """File names to the integer inside; names that do not fit the pattern are left out."""
    return names.withColumn(
        "number", F.regexp_extract(column, pattern, 1).try_cast("bigint")
    ).where(F.col("number").isNotNull())


def read_inventory(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    listing = spark.read.format("binaryFile").load(root).select(
        F.element_at(F.split("path", "/"), -1).alias("name")
    )
    return inventory_numbers(listing, "name", pattern)


def worklist(spark: SparkSession, lo: int, hi: int, pattern: str) -> DataFrame:
    """Keys lo..hi with their formatted file name."""
    return spark.range(lo, hi + 1).select(
        F.col("id").alias("number"), F.format_string(pattern, F.col("id")).alias("name")
    )


def skip_existing(todo: DataFrame, existing: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Keys still to do; ``force`` keeps all."""
    return todo if force else todo.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def skipped_count(todo: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return todo.join(existing.select(*keys).distinct(), list(keys), "left_semi").agg(
        F.count(F.lit(1)).alias("skipped")
    )


def complete_pairs(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys for which both outputs exist."""
    return first.select(*keys).distinct().join(second.select(*keys).distinct(), list(keys))


def translated_books(chapters: DataFrame) -> DataFrame:
    """Books with any non-null traditional text; they are not regenerated."""
    return chapters.where(F.exists("verses", lambda v: v["zh_hant"].isNotNull())).select("book").distinct()


def chapter_file_name(book: Column, chapter: Column) -> Column:
    return F.concat(book, F.lit("/chapter-"), pad2(chapter), F.lit(".json"))


def chapter_json(chapters: DataFrame) -> DataFrame:
    """(file, json): nulls are written out, absent pictures are not."""
    verse = chapters.schema["verses"].dataType.elementType.names
    heads = ("id", "book", "chapter", "title", "preamble", "preamble_source")
    plain = [n for n in verse if n != "images"]
    bare = {"ignoreNullFields": "false"}

    def one(v: Column) -> Column:
        base = F.to_json(F.struct(*[v[n].alias(n) for n in plain]), bare)
        # A null caption is an absent key, so pictures are written without nulls.
        images = F.to_json(v["images"])
        with_images = F.concat(F.expr("''"), F.regexp_replace(base, r"\}$", ""), F.lit(',"images":'),
                               images, F.lit("}"))
        return F.when(F.coalesce(F.size(v["images"]) > 0, F.lit(False)), with_images).otherwise(base)

    head = F.to_json(F.struct(*heads), bare)
    body = F.array_join(F.transform("verses", one), ",")
    return chapters.select(
        chapter_file_name(F.col("book"), F.col("chapter")).alias("file"), "book", "chapter",
        F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"verses":['), body, F.lit("]}")).alias("json"),
    )


def write_chapters(chapters: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Partitioned by book, one JSON object per line; only touched books are replaced."""
    out = chapter_json(chapters)
    (
        out.select("book", "json").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("book").text(root)
    )


def read_written_chapters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.CHAPTER).json(root)


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that are added or different; a second run finds none."""
    touched = differing(old, new, keys).where(F.col("change") != "removed").select(*keys)
    return new.join(touched, list(keys), "left_semi")


def write_if_changed(old: DataFrame, new: DataFrame, keys: Sequence[str], root: str) -> int:
    """Rewrite only books holding a changed chapter; gives the number of changed rows."""
    touched = changed_rows(old, new, keys)
    n = touched.count()
    if n:
        books = touched.select("book").distinct()
        write_chapters(new.join(books, "book", "left_semi"), root)
    return n


DIGESTS = "digests"


def write_changed_books(chapters: DataFrame, root: str) -> DataFrame:
    """Write the books whose content differs from what lies under ``root``; gives (book, digest) of those.

    A digest of every book, a tree over its chapters, is kept beside the files.  Only the
    digests are compared, so an unchanged book is neither read back nor written.
    """
    spark = chapters.sparkSession
    texts = chapter_json(chapters)
    now = snapshot_versions(texts.select("book", F.lit("chapter").alias("part"), F.col("file").alias("slug"), F.col("json").alias("payload")))
    now = now.withColumnRenamed("version", "digest")
    if _exists(spark, f"{root}/{DIGESTS}"):
        kept = spark.read.schema("digest string, book string").parquet(f"{root}/{DIGESTS}")
        now = now.join(kept.select("book", "digest"), ["book", "digest"], "left_anti")
    changed = cut_lineage(now.select("book", "digest"))
    if not changed.isEmpty():
        # No digest counts while its book is written: a run that breaks off writes the book again.
        _write_digests(changed.withColumn("digest", F.lit("")), root)
        write_chapters(chapters.join(small_side(changed.select("book")), "book", "left_semi"), f"{root}/books")
        _write_digests(changed, root)
    return changed


def _write_digests(digests: DataFrame, root: str) -> None:
    digests.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(f"{root}/{DIGESTS}")


# --- snapshots ------------------------------------------------------------------------


class StaleSnapshot(Exception):
    """Another writer has published since the snapshot that this one is based on."""


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) on the JVM side, so any store that Spark reads is reached."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def published(spark: SparkSession, root: str) -> int:
    """Number of the last publication under ``root``; 0 when there is none."""
    fs, log = _hadoop(spark, f"{root}/log")
    if not fs.exists(log):
        return 0
    return max((int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()), default=0)


def publish_snapshot(parts: DataFrame, root: str, base: int | None = None) -> DataFrame:
    """Write immutable content by version, then publish it; gives (book, version) of all books.

    ``parts`` has (book, part, slug, payload).  A version folder is named by its content, so
    writing it twice is harmless.  A publication is a table of the versions of all books and
    a numbered file that names it.  That file is created only if it is not there yet: of two
    writers that start from the same ``base`` (by default, the last publication) one
    succeeds and the other gets :class:`StaleSnapshot`, with nothing that readers see changed.
    """
    spark = parts.sparkSession
    last = published(spark, root) if base is None else base
    versions = cut_lineage(snapshot_versions(parts))
    parts.join(small_side(versions), "book").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "book", "version"
    ).parquet(f"{root}/content")
    if last:
        others = _versions_at(spark, root, last).join(versions, "book", "left_anti")
        versions = versions.unionByName(others)
    name = uuid.uuid4().hex
    versions.write.parquet(f"{root}/versions/{name}")
    fs, _ = _hadoop(spark, root)
    _, entry = _hadoop(spark, f"{root}/log/{last + 1}")
    # Beyond the base only an entry of the very next number counts.
    if published(spark, root) != last:
        raise StaleSnapshot(root)
    try:
        out = fs.create(entry, False)
    except Py4JJavaError as problem:
        raise StaleSnapshot(root) from problem
    out.write(bytearray(name.encode()))
    out.close()
    return _versions_at(spark, root, last + 1)


def _versions_at(spark: SparkSession, root: str, number: int) -> DataFrame:
    name = spark.read.text(f"{root}/log/{number}").head()["value"]
    return spark.read.schema("book string, version string").parquet(f"{root}/versions/{name}")


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """Content of the last publication, or of an earlier one; raises when content and version disagree.

    Nothing published gives no rows.
    """
    number = published(spark, root) if number is None else number
    if not number:
        return spark.createDataFrame([], "book string, version string, part string, slug string, payload string")
    content = spark.read.schema("part string, slug string, payload string, book string, version string").parquet(f"{root}/content")
    current = content.join(small_side(_versions_at(spark, root, number)), ["book", "version"])
    return verified(current).select("book", "version", "part", "slug", "payload")


def verified(content: DataFrame) -> DataFrame:
    """Fail the job when the content of a book does not hash to its version."""
    actual = snapshot_versions(content.select("book", "part", "slug", "payload")).withColumnRenamed(
        "version", "_actual"
    )
    checked = content.join(actual, "book")
    return checked.withColumn(
        "version",
        F.when(F.col("version").eqNullSafe(F.col("_actual")), F.col("version")).otherwise(
            F.raise_error(F.concat(F.lit("snapshot does not match its version: "), "book"))
        ),
    ).drop("_actual")
