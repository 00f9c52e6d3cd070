"""The Merkle manifest against a plain version, in superblocks of several sizes."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle, queries
from tests.compare import compare, connect, rows
from tests.llm import brute

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
SF = "/root/testdata/sf0.001"


def of(n, langs):
    return [(k, f"s{k % 3}", langs[k % len(langs)], k, f"text é {k}") for k in range(n)]


ODD = of(23, ["en", "en", "en", None, "de", "zz"]) + [
    (None, None, None, None, None), (None, "", "", 0, ""), (5, "s2", None, 5, "other"), (5, "s2", None, 5, "other"), (7, None, "en", None, None),
    (2**62, "s", "en", 2**63 - 1, "x" * 300_000), (-3, "s", "lone", 1, "🙂"), (14, "s", "en", None, "no count")]


def proved(spark, data, depth):
    df = spark.createDataFrame(data, SCHEMA).withColumn("pos", F.lit(3)).withColumn("leaf", F.lit("x")).withColumn("tree", F.lit(1))
    return rows(merkle.proofs(merkle.tampered_by_checksum(df), depth), *COLUMNS)


@pytest.mark.parametrize("data, depth", [(ODD, 1), (ODD, 2), (ODD, 10), (of(70, ["en"]), 2), (of(9, [f"l{k}" for k in range(9)]), 1), (of(1, ["en"]), 3)])
def test_proofs_equal_a_plain_version(spark, data, depth):
    got = proved(spark, data, depth)
    assert got == sorted(brute.merkle(data), key=repr)


def test_tampering_is_seen_and_nothing_else(spark):
    data = of(60, ["en", "de"])
    got = {r[0]: r for r in proved(spark, data, 3)}
    import zlib

    assert {i for i in got if not got[i][-1]} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert proved(spark, [], 3) == []


def test_query_equals_sql(spark):
    same, note = compare(queries.op13(spark, SF), connect(SF), queries.SQL["op13_merkle_manifest"])
    assert same, note
