"""Redaction and names: worked cases, and the whole test data against a plain rendering."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import text as tx

CASES = {
    "mail bob.smith+x@mail.example.org now": "mail <email> now",
    "open /data/p1/scan.nii.gz": "open <path>",
    "C:\\data\\x failed": "<path> failed",
    "input 3/40: reading": "input 3/40: reading",
    "3/40 of a/b": "3/40 of <path>",
    "wrote case.nii.gz, ok": "wrote <file>, ok",
    "host 10.0.0.12 refused": "host <address> refused",
    "took 4.21s 35s 16GiB 512MB": "took 4.21s 35s 16GiB 512MB",
    "case12 float32 AB_0042 12mm-A12": "<id> <id> <id> <id>",
    "two\nlines\r\nhere": "two lines here",
    "plain words only": "plain words only",
}


@pytest.fixture(scope="module")
def scrubbed(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    return {r.t: r.s for r in df.select("t", tx.scrub_text(F.col("t")).alias("s")).collect()}


@pytest.mark.parametrize("text", list(CASES))
def test_redaction(scrubbed, text):
    assert scrubbed[text] == CASES[text]


def test_long_text_is_cut_in_the_middle(spark):
    text = "word " * 100 + "end"
    got = spark.createDataFrame([(text,)], "t string").select(tx.scrub_text(F.col("t")).alias("s")).first().s
    assert len(got) <= 300 and got.startswith("word") and got.endswith("end") and " … " in got


def test_redaction_of_all_documents(spark):
    """No address or path is left, texts are short and of one line, and what is clean stays as it is."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [r.s for r in df.select(tx.scrub_text(F.col("text")).alias("s")).collect()]
    assert len(got) == df.count()
    assert not any("@" in s or "\n" in s or "/" in s or "\\" in s for s in got)
    assert all(len(s) <= 300 and s == s.strip() for s in got)
    again = spark.createDataFrame([(s,) for s in got], "t string").select(tx.scrub_text(F.col("t")).alias("s")).collect()
    assert [r.s for r in again] == got


@pytest.mark.parametrize("name, extension, stem", [
    ("a/b/scan.NII.gz", ".nii.gz", "scan"), ("x.csv", ".csv", "x"), (".hidden", "", ".hidden"), ("none", "", "none"),
    ("a.tar.gz", ".tar.gz", "a"), ("dot.", ".", "dot")])
def test_extensions(spark, name, extension, stem):
    row = spark.range(1).select(tx.compound_extension(F.lit(name)).alias("e"), tx.stem(F.lit(name)).alias("s")).first()
    assert (row.e, row.s) == (extension, stem)


@pytest.mark.parametrize("name, extension, safe", [
    ("../../etc/passwd", "", "passwd"), ("..%2f..%2fpasswd", "", "2f._2fpasswd"), ("Pat 01.nii.gz", ".nii.gz", "Pat_01"),
    ("...", "", ""), ("a" * 90, "", "a" * 64)])
def test_safe_stem(spark, name, extension, safe):
    assert spark.range(1).select(tx.safe_stem(F.lit(name), F.lit(extension)).alias("s")).first().s == safe
