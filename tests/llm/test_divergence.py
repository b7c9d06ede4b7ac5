"""Divergences against their SQL; spilled stripes, blocks and salts change nothing."""

import os
import random
import sys

import duckdb
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check  # noqa: E402

from matchspark.llm import source_divergence  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "The", "river", "ÉCOLE", "école", "don't", "数据", "a1b", "x y", "😀", "Straße", "rare"]
    out = []
    for i in range(400):
        text = " ".join(rng.choices(words, [30, 9, 20, 5, 5, 8, 6, 4, 3, 2, 7, 0.2], k=rng.randint(0, 40)))
        out.append((i, text, rng.choice(["en", "en", "de", "fr"]), f"s{rng.choice([0, 0, 0, 1, 2, 3])}"))
    out += [(500, None, "en", "s1"), (501, "", "en", "only empty"), (502, "the the", None, None), (503, "the river", "", "x"), (504, "!!! 12 --", "xx", "s0"),
            (505, "the river " * 20_000, "en", "s0"), (506, "nothing common", "xx", "s1"), (None, "the", "en", "S0"), (None, "the", "en", "S0")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, lang string, source string, n long, term string")


def connected(df, path):
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return con


def test_equals_sql(spark, rows, tmp_path):
    df = frame(spark, rows)
    assert check.compare(source_divergence.divergences(df), connected(df, str(tmp_path / "d")), source_divergence.SQL) == ""


def test_blocks_and_salts_change_nothing(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK", 2)
    monkeypatch.setattr(source_divergence, "SALT", 3)
    df = frame(spark, rows)
    assert check.compare(source_divergence.divergences(df), connected(df, str(tmp_path / "d")), source_divergence.SQL) == ""


def test_spilled_stripes_have_the_same_sums():
    texts = ["a b a", "b c", "", "C c A é"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 10), pa.array(["s0", "s1", "s0"] * 6 + ["s2", "s0"]), pa.array(texts)], names=["lang", "source", "text"])

    def sums(limit):
        total = {}
        for out in source_divergence.fold(iter([batch]), limit):
            for r in out.to_pylist():
                for e in r["entries"]:
                    at = (r["lang"], r["term"], e["source"])
                    total[at] = total.get(at, 0) + e["n"]
        return total

    assert len(list(source_divergence.fold(iter([batch]), 4))) > 4
    assert sums(4) == sums(10**6)
    assert sums(4)[("en", "a", None)] == 5 and sums(4)[("de", "c", "s0")] > 0


def test_no_rows(spark, empty_docs):
    assert source_divergence.divergences(empty_docs).count() == 0


def test_ties_go_to_the_first_item(spark):
    rows = [(i, "aa bb cc dd", "en", "s1") for i in range(30)] + [(i, "aa", "en", "s2") for i in range(30)] + [(99, "", "en", "s3")]
    got = source_divergence.divergences(frame(spark, rows)).where("part = 'term' AND source = 's1'").orderBy("rank").collect()
    assert [r["item"] for r in got] == ["bb", "cc", "dd"] and len({r["value"] for r in got}) == 1
