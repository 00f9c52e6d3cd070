"""Declared schemas.  Readers never infer: an all-null language column would be lost."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXTS = T.ArrayType(S)
I18N = struct(en=S, zh_hant=S, zh_hans=S, ja=S)
RENDERING = struct(zh_hant=S, zh_hans=S, ja=S)
IMAGE = struct(src=S, edition=S, caption=I18N)
VERSE = struct(
    id=S, verse_number=I, en=S, zh_hant=S, zh_hans=S, ja=S, glossary_terms=TEXTS,
    plate_ref=I, notes=TEXTS, images=T.ArrayType(IMAGE),
)
CHAPTER = struct(
    id=S, book=S, chapter=L, title=S, preamble=I18N, preamble_source=S,
    verses=T.ArrayType(VERSE),
)
BOOK = struct(slug=S, title=S, chapter_count=I)
PLATE = struct(id=I, title=S, img_id=S, width=I, height=I, full=S, thumb=S)
TERM = struct(
    term=S, slug=S, category=S, translit=RENDERING, source_def=S, source_def_literal=RENDERING,
    editor_note=I18N, appears_in=TEXTS, cross_refs=TEXTS, source_forms=TEXTS, locked=B,
    first_seen=S,
)
LEXICON = struct(en=S, category=S, zh_hant=S, zh_hans=S, ja=S, note=S, locked=B, first_seen=S)
RANGE = struct(lo=L, hi=L, slug=S, title=S)
RESULT_VERSE = struct(id=S, zh_hant=S, zh_hans=S, ja=S, glossary_terms=TEXTS)
RESULT_CAPTION = struct(cap_idx=S, en=S, zh_hant=S, zh_hans=S, ja=S)
RESULT = struct(
    book=S, chapter_id=S, snapshot_version=S, book_en_sha=S, preamble=RENDERING,
    captions=T.ArrayType(RESULT_CAPTION), verses=T.ArrayType(RESULT_VERSE),
    unknown_terms=TEXTS,
)
ISSUE = struct(id=S, lang=S, severity=S, problem=S, suggestion=S)
REVIEW = T.StructType(
    [
        T.StructField("chapter_id", S),
        T.StructField("pass", B),
        T.StructField("issues", T.ArrayType(ISSUE)),
    ]
)
ELEMENT = struct(page_id=L, pos=L, tag=S, name=S, src=S, text=S, last=L)
ANCHOR = struct(prefix=S, slug=S)
EVENT = T.StructType(
    [
        T.StructField("event_id", L),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", L),
        T.StructField("event_type", S),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", S),
    ]
)
PAGE = struct(page_id=L, url=S, html=S)
