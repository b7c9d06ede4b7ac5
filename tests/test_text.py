import random
import re
import string

from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import text
from matchspark.operators import cleaning

# The noise pattern as stated, for a backtracking engine with a large stack.
PLAIN = re.compile(
    r"(/9j/[A-Za-z0-9+/=]{30,}|iVBORw0KGgo[A-Za-z0-9+/=]{30,}|JVBERi0x[A-Za-z0-9+/=]{30,}"
    r"|[A-Za-z0-9+/=]{80,}|[^A-Za-z0-9 ]{30,}|([A-Za-z]{3,} ){15,})")


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_noise_edges(spark):
    run = "A" * 79
    words = "word " * 14
    rows = [run, run + "A", "-" * 29, "-" * 30, words, words + "last ", "é" * 30, "éword " + words,
            "/9j/" + "a" * 29, "/9j/" + "a" * 30 + "!", "...." * 8 + "/" + "b" * 80, "ab" + "=" * 80, None, ""]
    expected = [None if r is None else PLAIN.sub("", r) for r in rows]
    assert values(spark, rows, text.remove_noise) == expected


def test_noise_random(spark):
    rng = random.Random(7)
    pieces = ["AbC ", "word ", "no ", "é", "/", "+=", "-" * 10, "x" * 40, "9" * 30, "\n", " ", "/9j/", "iVBORw0KGgo", "JVBERi0x", "a1 "]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    assert values(spark, rows, text.remove_noise) == [PLAIN.sub("", r) for r in rows]


def test_long_text_does_not_overflow(spark):
    long = "word " * 60_000
    assert values(spark, [long + "9"], text.remove_noise) == ["9"]


def test_prose_runs_can_be_kept(spark):
    words = "word " * 20
    assert values(spark, [words], lambda c: text.remove_noise(c, prose_runs=False)) == [words]


def test_collapse_spaces(spark):
    rows = ["  a \t b\n c ", " x ", None]
    assert values(spark, rows, text.collapse_spaces) == ["a b\n c", "x", ""]


def test_html(spark):
    rows = [
        '<p class="a>b">Ciao &amp; <b>addio</b></p>', "<script>var a='</p>';</script>x<style>p{}</style>",
        "<!-- a <b> -->y<!DOCTYPE html>", "1 < 2 &lt;3", "&#65;&#x42;&#128512;&amp;lt; &unknown; &egrave;", None, "plain",
    ]
    assert values(spark, rows, text.strip_html) == [
        "Ciao & addio", "x", "y", "1 < 2 <3", "AB\U0001F600&lt; &unknown; è", "", "plain"]


def test_keep_latin(spark):
    assert values(spark, ["  a\n\nb é×÷ (x) \"q\" - €5 ", None], text.keep_latin) == ["a b é (x) \"q\" - 5", ""]


def test_cap_and_usable(spark):
    rows = ["abc", "abcd", None]
    assert values(spark, rows, lambda c: text.cap_length(c, 3)) == ["abc", "", None]
    assert values(spark, ["12345", "123456", "is null here", None], text.usable_text) == [False, True, False, False]


def test_clean_description_drops_and_keeps(spark):
    rows = [(1, "  <b>Senior</b>\t\tBuyer &amp; more "), (2, "   "), (3, None), (4, "null value"), (5, "abc")]
    df = cleaning.clean_texts(spark.createDataFrame(rows, "id int, description string"))
    assert [tuple(r) for r in df.collect()] == [(1, "senior buyer & more")]


def test_cleaning_computes_texts_once(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "id string, description string").write.parquet(str(tmp_path / "t"))
    df = cleaning.clean_texts(spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("JVBERi0x") == 1


def test_valid_text(spark):
    rows = ["x", " NULL ", "None", "nan", "", "  ", None]
    assert values(spark, rows, text.valid_text) == ["x"] + [None] * 6


def test_split_members(spark):
    assert values(spark, ["a, b ,,c", "", None], text.split_members) == [["a", "b", "c"], [], None]


def test_alphanumeric(spark):
    assert values(spark, ["Data_Engineer - È 2"], text.alphanumeric) == ["dataengineerè2"]


def test_vocabulary_sizes():
    assert len(vocab.CANDIDATE_FEATURES) == 14 and len(vocab.VACANCY_FEATURES) == 7
    assert all(len(p) == 3 for p in vocab.MODEL_PRICES)
    assert set(string.ascii_letters) <= set(text.NOISE_PATTERN)
