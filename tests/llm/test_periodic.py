"""Runs against a comparison of every word with the one a period before."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from conftest import ODD

from matchspark.llm import periodic_runs


def runs_by_comparison(w, least=6, exponent=4):
    found = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(key, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_comparison(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_words(rng):
    k = rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(k) for _ in range(rng.randint(0, 20))]
    for _ in range(rng.randint(0, 4)):
        period = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
        words += (period * rng.randint(1, 8))[:rng.randint(1, 40)] + [rng.randrange(k) for _ in range(rng.randint(0, 3))]
    return [b"%d" % w for w in words]


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (3, 3), (10, 3), (1, 5), (12, 4)])
def test_runs_of_random_words(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(300):
        docs = [periodic_words(rng) for _ in range(rng.randint(1, 4))]
        got, _ = periodic_runs._handled([(d, None) for d in docs], least, exponent)
        assert got == [runs_by_comparison(d, least, exponent) for d in docs]


def test_long_runs_and_words_without_runs():
    for words, runs in (([b"a"] * 60_000, [(0, 60_000, 1)]), ([b"a", b"b", b"c", b"a", b"d"] * 12_000, [(0, 60_000, 5)])):
        got, (text,) = periodic_runs._handled([(words, None)], 6, 4)
        assert got == [runs] and text == b" ".join(words[:runs[0][2]])
    one, two = [b"a"], [b"a", b"b"]
    while len(two) < 30_000:
        one, two = two, two + one
    assert periodic_runs._handled([(two, None)], 6, 4)[0] == [[]]
    with pytest.raises(ValueError):
        periodic_runs.runs_in(periodic_runs.np.array([0, 1]), 6, 2)


def test_digests_of_odd_and_periodic_rows(spark, docs_schema, empty_docs, rows_of):
    rng = random.Random(8)
    rows = [(i, t) for i, t in ODD] + [(None, "a " * 30), (None, None), (5, "one two three"), (5, "one two three")]
    rows += [(100 + i, b" ".join(periodic_words(rng)).decode()) for i in range(150)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs_schema).selectExpr("*", "1 AS key", "'x' AS runs", "2 AS tail")
    assert rows_of(periodic_runs.digests(df), *COLUMNS) == sorted((digest(i, t) for i, t in rows), key=repr)
    assert periodic_runs.digests(empty_docs).count() == 0


def test_whole_table(spark, folder, rows_of):
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = rows_of(periodic_runs.digests(spark.read.parquet(f"{folder}/documents.parquet")), *COLUMNS)
    assert got == sorted((digest(r["doc_id"], r["text"]) for r in rows), key=repr)
