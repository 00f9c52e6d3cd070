"""A side is broadcast only while its rows and its bytes stay below their bounds."""

from __future__ import annotations

import pytest

from lectern.operators.sizing import small_side


def hinted(df) -> bool:
    return "broadcast" in df._jdf.queryExecution().logical().toString()


@pytest.fixture()
def side(spark):
    return spark.createDataFrame(
        [(1, "x" * 1000, None), (2, "字" * 10, [1])], "a int, b string, c array<int>"
    )


def test_small_in_rows_and_bytes(side):
    assert hinted(small_side(side))


def test_too_many_rows(side):
    assert not hinted(small_side(side, max_rows=1))


def test_few_rows_with_long_texts(side):
    assert not hinted(small_side(side, max_bytes=900))


def test_empty_side_and_repeated_column_names(side):
    assert hinted(small_side(side.limit(0)))
    assert hinted(small_side(side.select("a", side["b"].alias("a"))))
