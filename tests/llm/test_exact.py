"""Exact top-k, exact copies, BPE and packing against plain versions."""

import base64
import math
import random

import brute
import numpy as np
import pytest
from conftest import ODD

from matchspark.llm import bpe_fst, exact_dedup, packing, va_topk


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def plain_rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, v string")


def test_top_k_ties_nulls_and_lengths(spark, rows_of):
    rng = random.Random(3)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(400, 460)]
    rows += [(500, None), (550, [None, 1.0, 2.0]), (600, [math.nan, 0.0, 0.0]), (650, [math.inf, 0.0, 0.0]), (None, [0.1, 0.2, 0.3])]
    rows += [(700, [1.0, 2.0]), (701, [2.0, 1.0]), (750, []), (751, []), (800, [1e9, -1e9, 1e9])]
    df = vectors(spark, [(i, v, None, "x", None) for i, v in rows])
    got = rows_of(va_topk.nearest(df, block=4, ways=3), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute.nearest(rows)


def test_top_k_repeated_key_and_no_rows(spark, rows_of):
    df = vectors(spark, [(50, [1.0], 1, None, None), (50, [1.0], 1, None, None), (51, [2.0], 1, None, None)])
    assert rows_of(va_topk.nearest(df, ways=2), "query_id", "rank", "vec_id", "score") == [(50, 1, 51, 131072)]
    assert va_topk.nearest(df.limit(0), ways=2).count() == 0


def test_bounds_hold_and_most_vectors_are_never_read(spark):
    rng = np.random.default_rng(1)
    lo, hi = np.full((1, 16), -3000.0), np.full((1, 16), 3000.0)
    whole = rng.integers(-3000, 3001, (300, 16)).astype(float)
    codes = np.floor((whole - lo) / va_topk._edges(lo, hi)[1]).astype(np.uint8)
    low, high = va_topk._bounds(codes, lo, hi, whole[:20])
    exact = whole[:20] @ whole.T
    assert (low <= exact).all() and (exact <= high).all()


def test_exact_groups(spark, odd_docs, empty_docs, rows_of):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(exact_dedup.exact_groups(odd_docs), *columns) == brute.exact(ODD)
    rows = [(None, "a b"), (3, "a  b"), (2, "a\nb"), (None, "solo"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, keep_id string, text_sha256 string, _body int")
    assert rows_of(exact_dedup.exact_groups(df), *columns) == brute.exact(rows)
    assert sorted(exact_dedup.drop_copies(df).select("doc_id").toPandas().doc_id.dropna()) == [2, 8]
    assert exact_dedup.exact_groups(empty_docs).count() == 0


def test_bpe_equals_tiktoken(documents, odd_docs, plain_rows, empty_docs, rows_of):
    import public_tokenizers
    import tiktoken

    path, pattern = bpe_fst.default_files()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for df, rows in ((odd_docs, ODD), (documents, plain_rows)):
        assert rows_of(bpe_fst.coded_digests(df, path, pattern), *columns) == brute.coded(rows, encoding)
    assert bpe_fst.coded_digests(empty_docs, path, pattern).count() == 0


def test_decoding_alone(spark, odd_docs):
    path, pattern = bpe_fst.default_files()
    back = bpe_fst.decode(bpe_fst.encode(odd_docs, path, pattern), path)
    assert back.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t or "" for i, t in ODD}
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe_fst.decode(none, path).first().decoded == ""


def test_bpe_on_random_bytes():
    import tiktoken

    ranks = bpe_fst.read_ranks(bpe_fst.default_files()[0])
    encoding = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    machine, rng = bpe_fst.Transducer(ranks), random.Random(5)
    for alphabet in ("ab", "the ing", "aeioustrn", "    \n", "éèçàß", "0123 ,.-="):
        for _ in range(300):
            piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
            ids = [t for t in machine.encode(piece.encode())]
            assert ids == encoding.encode_ordinary(piece), piece


def test_transducer_emits_with_bounded_lookahead():
    machine = bpe_fst.Transducer(bpe_fst.read_ranks(bpe_fst.default_files()[0]))
    machine.encode(b"internationalisation of many long words without end " * 200)
    assert max(len(state[1]) for state in machine.states) <= 2 * max(machine.sizes.values())


def test_utf8_stream_keeps_broken_characters():
    text = "aé€😀" * 50
    data = text.encode()
    for step in (1, 2, 3, 5, 7):
        stream = bpe_fst.Utf8Stream()
        assert "".join(stream.feed(data[i:i + step]) for i in range(0, len(data), step)) + stream.close() == text
    stream = bpe_fst.Utf8Stream()
    assert stream.feed(b"a\xe2\x82") + stream.close() == "a�"


def test_pieces_equal_the_tokenizer(documents, odd_docs, plain_rows, empty_docs, rows_of):
    from tokenizers import Tokenizer

    path = packing.default_file()
    tokenizer = Tokenizer.from_file(path)
    for df, rows in ((odd_docs, ODD), (documents, plain_rows)):
        packed = packing.packed_documents(df, path)
        columns = ("doc_id", "piece", "start", "length", "ids_crc32")
        assert rows_of(packed, *columns) == brute.pieces(rows, tokenizer)
        check_sequences(packed.collect())
    assert packing.packed_documents(empty_docs, path).count() == 0


ADDED_TEXTS = [
    "a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|>Start of it<|endoftext|>", "<|endoftext|><|endoftext|>", "é<|endoftext|>数 don't<|startoftext|>'s",
    "x<|ENDOFTEXT|>y <|end oftext|> <|endoftext |>", "<|endoftext|>\n\n<|startoftext|>\t12<|endoftext|>", "one <|endoftext|> two " * 900, "<<|endoftext|>>.",
]


def test_added_tokens_of_the_file(spark, docs_schema, rows_of):
    from tokenizers import Tokenizer

    path = packing.default_file()
    rows = list(enumerate(ADDED_TEXTS))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs_schema)
    got = rows_of(packing.packed_documents(docs, path), "doc_id", "piece", "start", "length", "ids_crc32")
    assert got == brute.pieces(rows, Tokenizer.from_file(path))


@pytest.mark.parametrize("token", ["two words", "Mixed"])
def test_added_tokens_with_spaces_or_normalised(token, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_file())
    tokenizer.add_tokens([AddedToken(token, normalized=token == "Mixed")])
    tokenizer.save(str(tmp_path / "t.json"))
    texts = ["some two words here", "xMIXEDy mixed", "", "plain"]
    got = packing.WordEncoder(str(tmp_path / "t.json")).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


MIXED_TEXTS = [
    "", " ", "\x0b", "The the THE tHe. DON'T don't's 'S", "a\x85b\xa0c \x1cd", "ΟΔΟΣ Σ İstanbul ǅ K Å", "e\u0301 É é ÀÉ´ ª º µ ß ÿ",
    "</w> x</w>y </ w> 12 3.5% %%% ...", "數 字 ABC數 ĳ", "word " * 3000, "\u200b \ufeffx \u3000y", "\x00 a\x00b \x7f \x80",
]


def test_words_in_any_case_and_script():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(packing.default_file()), random.Random(8)
    texts = MIXED_TEXTS + [" ".join(rng.choice(["", "Ab", "é", "'s", "9", "</w>", "Σ", "%,"]) + rng.choice(["x", "Ñu", "", "7"]) for _ in range(40)) for _ in range(200)]
    encoder = packing.WordEncoder(packing.default_file())
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from what is kept
        got = encoder.encode([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == wanted
    assert encoder.encode([]) == []


def test_words_and_pieces_that_leave_the_tables(monkeypatch):
    import tiktoken

    ranks, pattern = bpe_fst.read_ranks(bpe_fst.default_files()[0]), bpe_fst.default_files()[1]
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for name, size in (("UNITS", 7), ("PIECES", 5), ("STATES", 40), ("STEPS", 60)):
        monkeypatch.setattr(bpe_fst, name, size)
    rng = random.Random(9)
    words = ["Reating%%%", "reating", "don't", "x1y22", "é", "數字", "\n\n", "a\tb", "", " ", "z" * 90, "...", "</s>"]
    texts = MIXED_TEXTS + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(100)]
    encoder = bpe_fst.Encoder(ranks, pattern)
    for _ in range(2):
        got = encoder.encode_all(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode_ordinary(t) for t in texts]
    assert encoder.encode_all([]) == [] and encoder.encode("") == b""


def check_sequences(rows, size=2048):
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= size
    least = math.ceil(sum(filled.values()) / size)
    assert len(filled) <= least * 1.05 + 1


def test_all_capacities_hold(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 100)) for i in range(500)]
    for rule in ("norm", "dot"):
        packed = packing.pack(spark.createDataFrame(rows, "id long, length long"), 100, 4, 5000.0 * 2, (1.0, 0.5, 0.5), rule, 8).collect()
        groups = {}
        for r in packed:
            groups.setdefault(r.sequence_id, []).append(r.length)
        assert len(packed) == 500
        assert all(sum(g) <= 100 and len(g) <= 4 and sum(x * x for x in g) <= 10000 for g in groups.values())
