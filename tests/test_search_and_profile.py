import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.operators import blockmax, conformance, cost, profiling, quantiles, search

DOCS = [(1, "red ring red", 10), (2, "blue bolt", 20), (3, "red bolt nut", 30), (4, "", 40), (5, "RED, ring!", 50)]


def stated_bm25(query):
    docs = {k: "".join(c if c.isalnum() else " " for c in t.lower()).split() for k, t, _ in DOCS}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for key, words in docs.items():
        tf = Counter(words)
        for w in set(query.split()):
            df = sum(w in d for d in docs.values())
            if tf[w]:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                out[key] = out.get(key, 0) + idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / mean))
    return out


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "k int, t string, n int")
    queries = spark.createDataFrame([("a", "red ring"), ("b", "bolt"), ("c", "none")], "q string, s string")
    got = {(r["q"], r["k"]): r["score"] for r in search.search(docs, "k", "t", queries, "q", "s").collect()}
    wanted = {(q, k): v for q, s in (("a", "red ring"), ("b", "bolt")) for k, v in stated_bm25(s).items()}
    assert got.keys() == wanted.keys() and all(abs(got[x] - wanted[x]) < 1e-9 for x in got)


def test_search_filter_limit_and_stored_index(spark):
    docs = spark.createDataFrame(DOCS, "k int, t string, n int")
    queries = spark.createDataFrame([("a", "red ring bolt")], "q string, s string")
    found = search.search(docs, "k", "t", queries, "q", "s", {"@gte": {"n": 20}}, limit=2)
    assert len(found.collect()) == 2 and min(r["k"] for r in found.collect()) > 1
    stored = search.postings(docs, "k", "t"), search.lengths(docs, "k", "t")
    again = search.search(docs, "k", "t", queries, "q", "s", {"@gte": {"n": 20}}, limit=2, index=stored)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_search_document(spark):
    df = spark.createDataFrame([(1, "Buyer", None)], "candidateid int, last_job string, skills string")
    got = search.build_documents(df, "candidateid", {"last_job": "Last job", "skills": "Skills"}, [], []).first()
    assert got["description"] == "Last job: Buyer\nSkills: "


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice([rng.gauss(0, 1), 5.0, rng.expovariate(0.001)])) for g in "abc" for _ in range({"a": 1, "b": 500, "c": 77}[g])]
    rows += [("d", 3.0)] * 10 + [("e", None)]
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in profiling.exact_quantiles(
        spark.createDataFrame(rows, "g string, x double"), "g", "x", points).collect()}
    for g in "abcd":
        values = [x for k, x in rows if k == g]
        for p in points:
            assert abs(got[g, p] - np.quantile(values, p)) < 1e-9
    assert not any(k[0] == "e" for k in got)


SHAPES = {
    "normal": lambda rng, n: [rng.gauss(0, 1) for _ in range(n)], "sorted": lambda rng, n: [float(i) for i in range(n)],
    "few values": lambda rng, n: [float(rng.choice([1, 2, 2, 2, 9])) for _ in range(n)], "constant": lambda rng, n: [7.0] * n,
    "far apart": lambda rng, n: [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(n)],
    "two heaps": lambda rng, n: [rng.choice([0, 1e9]) + rng.random() for _ in range(n)], "widest": lambda rng, n: [rng.choice([-1.7e308, 1.7e308, 0.0]) for _ in range(n)],
}


@pytest.mark.parametrize("many", [10**6, 1500])
def test_sketched_quantiles_and_boxes(spark, many, monkeypatch):
    """Groups beyond the size that is counted whole, with both widths of brackets."""
    if many < 10**6:  # coarser, so that the narrow brackets are wider than two rows here as well
        for name, value in (("MANY", many), ("NARROW", 0.0025), ("ACCURACY", 2000)):
            monkeypatch.setattr(quantiles, name, value)
    rng = random.Random(many)
    data = {f"{name} {n}": make(rng, n) for name, make in SHAPES.items() for n in (1, 999, 2003, 6000)}
    rows = [(g, x) for g, values in data.items() for x in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [("normal 1", None), ("normal 1", float("nan")), ("normal 1", float("inf")), (None, 1.0)], "g string, x double").repartition(3)
    points = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in profiling.exact_quantiles(df, "g", "x", points).collect()}
    assert got.keys() == {(g, p) for g in data for p in points}
    for g, values in data.items():
        if "widest" not in g:
            assert np.allclose([got[g, p] for p in points], np.quantile(values, points), rtol=1e-9, atol=0), g
    for r in profiling.box_stats(df.where("g not like 'widest%'"), "g", "x").collect():
        values = np.array(data[r["g"]])
        q1, q3 = r["q1"], r["q3"]
        assert np.allclose([q1, r["median"], q3], np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-9, atol=0)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (r["n"], r["lowest"], r["highest"]) == (len(values), values.min(), values.max())
        assert (r["whisker_low"], r["whisker_high"]) == (values[values >= low].min(), values[values <= high].max())
        assert r["outliers"] == int(((values < low) | (values > high)).sum())


def test_histogram_equals_numpy(spark):
    values = [0.0, 0.1, 0.5, 0.5, 1.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counts, edges = np.histogram([v for v in values if v is not None and math.isfinite(v)], bins=4)
    got = sorted(tuple(r) for r in profiling.histogram(df, "x", 4).collect())
    assert [r[3] for r in got] == list(counts) and np.allclose([r[1] for r in got], edges[:-1])
    constant = profiling.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in constant] == list(np.histogram([2.0, 2.0], bins=4)[0])


def test_density_integrates_to_one(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", 1.0)], "g string, x double")
    rows = profiling.density(df, "g", "x", 200).orderBy("point").collect()
    assert {r["g"] for r in rows} == {"a"}
    assert 0.95 < np.trapezoid([r["density"] for r in rows], [r["grid_x"] for r in rows]) <= 1.0


def test_density_equals_the_sum_of_kernels(spark):
    rng = random.Random(5)
    data = {"normal": [rng.gauss(50, 9) for _ in range(3000)], "two": [1.0, 2.0], "far": [rng.gauss(0, 1) for _ in range(400)] + [1e6],
            "copies": [float(rng.choice([1, 2, 2, 7])) for _ in range(900)], "large": [1e9 + rng.random() for _ in range(200)], "none": [3.0] * 5}
    df = spark.createDataFrame([(g, x) for g, values in data.items() for x in values] + [("two", float("nan")), (None, 1.0)], "g string, x double")
    got = {}
    for r in profiling.density(df, "g", "x", 40).collect():
        got.setdefault(r["g"], {})[r["point"]] = (r["grid_x"], r["density"])
    assert got.keys() == data.keys() - {"none"}
    for g, found in got.items():
        values = np.array(data[g])
        h = values.std(ddof=1) * len(values) ** -0.2
        grid = np.linspace(values.min(), values.max(), 40)
        wanted = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
        assert np.allclose([found[i][0] for i in range(40)], grid, rtol=1e-12)
        # In units of the kernel's height; rounding of large values apart, the stated bound holds.
        assert np.abs(np.array([found[i][1] for i in range(40)]) - wanted).max() * h * math.sqrt(2 * math.pi) < (1e-10 if g != "large" else 1e-6)


def test_weekday_order_and_pairs(spark):
    days = spark.sql("select explode(sequence(timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-09', interval 1 day)) as t")
    assert [r["part"] for r in profiling.datepart_counts(days, "t", "weekday").collect()] == profiling.WEEKDAYS
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, None), (2, 1)], "x int, y int")
    assert sorted(str(r["pair_count"]) for r in profiling.pair_counts(pairs, "x", "y").collect()) == ["1", "2", "2", "None"]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (3, None)], "n int, s string")
    got = {r["column_name"]: r for r in profiling.table_profile(df).collect()}
    assert got["n"]["null_percent"] == 25.0 and got["n"]["mean"] == 5 / 3 and got["n"]["distinct_values"] is None
    assert got["s"]["distinct_values"] == 2 and got["s"]["duplicate_rows"] == 1 and got["s"]["rows"] == 4


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "a long, b string")
    assert conformance.schema_differences(df, {"A": "long", "b": "str"}) == []
    assert [x[:2] for x in conformance.schema_differences(df, {"a": "bool", "c": "str"})] == [("c", "missing"), ("b", "extra"), ("a", "type")]
    checked = spark.createDataFrame([("10%",), ("15%",), ("x",), (None,)], "p string")
    rule = conformance.rule_violations(checked, {"steps": conformance.percent_in_steps(F.col("p"))}).first()
    assert (rule["checked"], rule["violations"]) == (4, 2)


def test_costs(spark):
    df = spark.createDataFrame([("abcde", "xy"), (None, "x")], "p string, a string")
    counted = cost.with_tokens(df, F.col("p"), F.col("a"))
    assert [tuple(r)[2:] for r in counted.collect()] == [(2, 1, 3), (0, 1, 1)]
    rows = {r["model"]: r["credits_total"] for r in cost.cost_by_model(counted, vocab.MODEL_PRICES).collect()}
    assert abs(rows["openai-gpt-5"] - (2 * 0.69 + 2 * 5.5) / 1e6) < 1e-15
    assert cost.prices(spark).count() == 4 and cost.study_sample(df, "p", "a").count() == 1
    assert cost.row_credits(counted, 1.0, 2.0).agg(F.sum("credits_total")).first()[0] == pytest.approx(6e-6)


@pytest.mark.parametrize("descending", [True, False])
def test_places_of_all_rows_nulls_last(spark, descending):
    rng = random.Random(4)
    rows = [(i, None if i % 5 == 0 else float(rng.randint(0, 300))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(7)
    got = {r.place: (r.id, r.x) for r in profiling.placed(df, "x", "id", descending).collect()}
    wanted = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
    assert [got[i + 1] for i in range(len(rows))] == wanted and len(got) == len(rows)
    assert all(got[i][1] is None for i in range(2401, 3001))
    assert profiling.placed(df.limit(0), "x", "id", descending).count() == 0


def blended_by_hand(docs, queries, vectors, weight, allowed=None):
    """Every document with a common word or, for queries with a vector, a vector."""
    words = {k: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for k, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for x in words.values() for w in set(x))
    out = {}
    for q, text in queries:
        asked = set("".join(c if c.isalnum() else " " for c in text.lower()).split())
        for k, have in words.items():
            if allowed is not None and k not in allowed:
                continue
            tf = Counter(have)
            total = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(have) / mean))
                        for w in asked if tf[w])
            both = vectors and q in vectors[1] and k in vectors[0]
            if both:
                a, b = np.array(vectors[0][k]), np.array(vectors[1][q])
                total += weight * float(a @ b) / (float(np.linalg.norm(a) * np.linalg.norm(b)) + 1e-9)
            if both or asked & tf.keys():
                out[q, k] = total
    return out


def best_by_hand(scores, limit):
    out = {}
    for (q, k), x in scores.items():
        out.setdefault(q, []).append((-round(x, 9), k))
    return {q: [k for _, k in sorted(v)[:limit]] for q, v in out.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 3)))) for i in range(900)]
    docs += [(900 + i, docs[7][1]) for i in range(60)] + [(970, None), (971, ""), (972, "w1 " * 5000)]
    queries = [(f"q{i}", " ".join(rng.choices(common, k=3) + rng.choices(rare, k=rng.randint(0, 2)))) for i in range(25)] + [("none", "zzz"), ("empty", "")]
    near = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(0, 960, 3)}
    asked = {f"q{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(0, 25, 2)} | {"none": [1.0, 0.0, 0.0, -1.0]}
    return docs, queries, (near, asked)


@pytest.mark.parametrize("weight", [0.5, 10.0])
def test_blended_search_sees_every_document(spark, corpus, weight, monkeypatch):
    monkeypatch.setattr(blockmax, "DOCUMENTS", 200)
    monkeypatch.setattr(blockmax, "RANGE", 8)
    monkeypatch.setattr(blockmax, "QUERIES", 7)
    docs, queries, (near, asked) = corpus
    frame = spark.createDataFrame(docs, "k long, t string").repartition(3)
    found = search.search(
        frame, "k", "t", spark.createDataFrame(queries, "q string, s string"), "q", "s", limit=6, vectors=(
            spark.createDataFrame([(k, v) for k, v in near.items()], "k long, doc_vector array<double>"),
            spark.createDataFrame([(q, v) for q, v in asked.items()], "q string, query_vector array<double>"), weight)).collect()
    scores = blended_by_hand(docs, queries, (near, asked), weight)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["q"], []).append(r["k"])
        assert abs(r["score"] - scores[r["q"], r["k"]]) < 1e-9
    assert got == best_by_hand(scores, 6)
    # Documents without a common word are found by meaning alone.
    assert len(got["none"]) == 6


@pytest.mark.parametrize("stored", ["no", "blocks", "rows"])
def test_pruned_search_equals_scoring_all(spark, corpus, stored, monkeypatch):
    monkeypatch.setattr(blockmax, "DOCUMENTS", 300)
    monkeypatch.setattr(blockmax, "RANGE", 4)
    docs, queries, _ = corpus
    frame = spark.createDataFrame([(k, t, k % 5) for k, t in docs], "k long, t string, n long").repartition(3)
    index = {"no": None, "blocks": blockmax.block_index(frame, "k", "t"),
             "rows": (search.postings(frame, "k", "t"), search.lengths(frame, "k", "t"))}[stored]
    asked = spark.createDataFrame(queries, "q string, s string")
    for where, allowed in ((None, None), ({"@lte": {"n": 1}}, {k for k, _ in docs if k % 5 <= 1})):
        found = search.search(frame, "k", "t", asked, "q", "s", where, 4, index).collect()
        got = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            got.setdefault(r["q"], []).append(r["k"])
        assert got == best_by_hand(blended_by_hand(docs, queries, None, 0, allowed), 4)


def test_most_documents_are_not_scored():
    rng = np.random.default_rng(1)
    n = 6400
    tf = rng.integers(1, 3, n)
    tf[rng.integers(0, n, 40)] = 60
    lens = np.full(n, 100)
    batch = blockmax.shard_rows(1, pa.array(np.arange(n)), lens, pa.array(["a"]), np.zeros(n, np.int64), np.arange(n), tf)
    shard = blockmax.Shard(pa.Table.from_batches([batch]).filter(pc.field("token").is_valid()), lens, 100.0)
    looked_at = []
    best, score = blockmax.best_in_shard(shard, [("a", 1.0)], None, None, None, np.arange(n), 5, looked_at)
    assert sorted(best) == sorted(np.lexsort((np.arange(n), -shard.gain))[:5]) and (score == shard.gain[best]).all()
    assert sum(looked_at) < n // 2


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "k long, t string")
    asked = spark.createDataFrame([("q", "a")], "q string, s string")
    assert search.search(docs.limit(0), "k", "t", asked, "q", "s").count() == 0
    assert search.search(docs, "k", "t", asked.limit(0), "q", "s").count() == 0
    assert [r["k"] for r in search.search(docs, "k", "t", asked, "q", "s").collect()] == [1]
