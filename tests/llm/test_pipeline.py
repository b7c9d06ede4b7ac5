"""The pipeline, stage by stage, against plain versions of its stages."""

import brute
import corpus_pipeline
import pytest
from conftest import ODD

from matchspark.llm import exact_dedup, packing, quality_qda, simhash_ring


@pytest.fixture(scope="module")
def passed(spark, folder, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{at}/{i}")
        after = spark.read.parquet(f"{at}/{i}")
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder, passed):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    for before, after in passed[:4]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs, good = passed[0]
    wanted = {r.doc_id for r in quality_qda.scored(docs, labels).collect() if r.predicted}
    assert {i for i, _ in texts(good)} == wanted
    assert {i for i, _ in texts(passed[1][1])} == {r[0] for r in brute.exact(texts(good)) if r[3]}
    near = {i for i, _ in texts(passed[2][1])}
    assert near == {i for i, _, c in brute.near_copies(texts(passed[1][1])) if i == c}
    before, after = dict(texts(passed[3][0])), dict(texts(passed[3][1]))
    assert before.keys() == after.keys()
    found = {i for i, *counts, _ in brute.secrets(before.items()) if sum(counts)}
    assert found and all(("[SECRET]" in after[i]) for i in found)
    assert not any(sum(counts) for _, *counts, _ in brute.secrets(after.items()))
    assert {i for i in before if before[i] != after[i]} >= found
    from tokenizers import Tokenizer

    rows = passed[4][1].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, rows), key=repr) == brute.pieces(after.items(), Tokenizer.from_file(packing.default_file()))


def test_run_is_the_stages(spark, folder, passed):
    got = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(got) == sorted(passed[4][1].select("doc_id", "piece", "length", "ids_crc32").collect())


def test_odd_and_no_rows(spark, folder, odd_docs, empty_docs):
    for docs in (odd_docs, empty_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= max(len(ODD) * 3, 1), name


def test_repeated_rows_and_null_keys_leave_one(spark, docs_schema):
    """A shard delivered twice, and null keys: one row of each group survives both stages."""
    words = [f"w{i}" for i in range(120)]
    near = " ".join([*words[:-1], "end"])
    assert bin(brute.fingerprint(" ".join(words)) ^ brute.fingerprint(near)).count("1") <= 4
    rows = [(5, " ".join(words)), (5, " ".join(words)), (7, " ".join(words)), (3, "quite another text of this shard"), (5, "same  key other text"),
            (5, "same key other text"), (None, "only null keys"), (None, "only null keys"), (None, " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(rows)], docs_schema)
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns
    wanted = [(3, rows[3][1]), (5, rows[0][1]), (5, "same key other text"), (None, "only null keys")]
    assert sorted(((i, " ".join(t.split())) for i, t in texts(exact)), key=repr) == sorted(wanted, key=repr)
    assert sorted(((i, " ".join(t.split())) for i, t in texts(simhash_ring.keep_first(docs))), key=repr) == sorted(wanted, key=repr)
    # Key 5 stays for another text, but this near copy of document 4 goes.
    crossed = spark.createDataFrame([(4, " ".join(words), None, None, 1), (5, near, None, None, 2), (5, "a text of its own", None, None, 3)] * 2, docs_schema)
    assert sorted(texts(simhash_ring.keep_first(crossed))) == [(4, " ".join(words)), (5, "a text of its own")]


def test_columns_with_clashing_names_stay(spark, folder, docs_schema):
    """Extra columns named like the operators' own keep their values through all filtering stages."""
    good = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(40).collect()]
    rows = [(i, t + (' password = "abcdefghijkl0123"' if n % 3 == 0 else ""), "en", "s", 1, 7 + n, [n], f"g{n}", f"d{n}", n, n, {"k": n}) for n, (i, t) in enumerate(good)]
    docs = spark.createDataFrame(rows, docs_schema + ", rid long, _spans array<int>, _group string, _digest string, _rid int, rid_ int, m map<string,int>")
    before = {r.doc_id: r for r in docs.collect()}
    after = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, after, folder)
        assert after.columns == docs.columns
    after = after.collect()
    assert after
    for r in after:
        assert [r[c] for c in docs.columns if c not in ("text", "n_chars")] == [before[r.doc_id][c] for c in docs.columns if c not in ("text", "n_chars")]
    assert any("[SECRET]" in r.text for r in after)
    pieces = spark.createDataFrame([(i, 100, f"g{i}", 5, 6) for i in range(50)], "doc_id long, length long, _group string, sequence_id int, offset int")
    packed = packing.pack(pieces)
    assert packed.columns == ["doc_id", "length", "_group", "sequence_id", "offset"] and {r["_group"] for r in packed.collect()} == {f"g{i}" for i in range(50)}
