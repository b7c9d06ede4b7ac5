"""Near copies and repeated passages against plain versions."""

import random

import brute
import numpy as np
import pytest
from conftest import ODD

from matchspark.llm import anchored, components, run_length_index, simhash_ring, suffix_trees


def passages(seed, n, separator=" "):
    """Texts made of shared passages, own words, and small changes."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = [[rng.choice(words) for _ in range(rng.randint(15, 90))] for _ in range(8)]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                part = list(rng.choice(shared))
                if rng.random() < 0.5:
                    part[rng.randrange(len(part))] = "changed"
                text += part[rng.randint(0, 5):]
            else:
                text += [rng.choice(words) for _ in range(rng.randint(1, 60))]
        out.append(separator.join(text))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = passages(1, 60) + passages(2, 20, "\t ") + ["a b " * 300, "x" * 900, "x" * 450, " ".join(["w"] * 25)]
    return [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(200, None), (201, "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "rid", "own") for i, t in rows], "doc_id long, text string, rid string, own string")


COLUMNS = {
    "words": ("doc_id", "n_words", "n_removed", "kept_sha256"),
    "bytes": ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
}


@pytest.mark.parametrize("most,kept", [(4096, 150_000), (3, 150_000), (3, 20)])
def test_repeated_words(spark, rows, rows_of, most, kept, monkeypatch):
    monkeypatch.setattr(anchored, "KEPT", kept)
    monkeypatch.setattr(suffix_trees, "SHAPE", anchored.Shape(True, 20, 6, most))
    got = rows_of(suffix_trees.removed_digests(frame(spark, rows)), *COLUMNS["words"])
    assert sorted(got) == brute.repeated_words(rows)
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("most,kept", [(4096, 150_000), (3, 150_000), (3, 20)])
def test_repeated_bytes(spark, rows, rows_of, most, kept, monkeypatch):
    monkeypatch.setattr(anchored, "KEPT", kept)
    monkeypatch.setattr(run_length_index, "SHAPE", anchored.Shape(False, 200, 24, most))
    got = rows_of(run_length_index.removed_digests(frame(spark, rows)), *COLUMNS["bytes"])
    assert got == brute.repeated_bytes(rows)
    assert sum(r[2] for r in got) > 500


def test_repeats_in_odd_texts(spark, odd_docs, empty_docs, rows_of):
    assert sorted(rows_of(suffix_trees.removed_digests(odd_docs), *COLUMNS["words"])) == brute.repeated_words(ODD)
    assert rows_of(run_length_index.removed_digests(odd_docs), *COLUMNS["bytes"]) == brute.repeated_bytes(ODD)
    assert suffix_trees.removed_digests(empty_docs).count() == 0
    assert run_length_index.removed_digests(empty_docs).count() == 0


def test_repeats_in_documents(spark, folder, rows_of):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows_of(suffix_trees.removed_digests(docs), *COLUMNS["words"])) == brute.repeated_words(rows)
    assert rows_of(run_length_index.removed_digests(docs), *COLUMNS["bytes"]) == brute.repeated_bytes(rows)


def test_repeated_rows_and_null_keys(spark, rows_of):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text), (5, text), (None, text), (7, text)]
    words = rows_of(suffix_trees.removed_digests(frame(spark, rows)), "doc_id", "n_removed")
    assert words == [(5, 80), (5, 80), (7, 80), (None, 0)]
    assert {r[1] for r in rows_of(run_length_index.removed_digests(frame(spark, rows)), "doc_id", "n_removed")} == {len(text)}


def test_matches_of_the_index():
    rng = random.Random(4)
    bodies = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(25)] + [b"abab" * 9, b"", b"aaaa"]
    bodies += bodies[:3]
    index = run_length_index.RunLengthIndex(bodies)
    got, at = index.matches(), 0
    starts = [(b, i) for b in bodies for i in range(len(b))]
    for n, body in enumerate(bodies):
        for i in range(len(body)):
            longest = 0
            for m, other in enumerate(bodies):
                for j in range(len(other)):
                    if (m, j) != (n, i):
                        size = 0
                        while i + size < len(body) and j + size < len(other) and body[i + size] == other[j + size]:
                            size += 1
                        longest = max(longest, size)
            assert got[at + i] == longest
        at += len(body) + 1
    assert len(index.symbols) < len(starts)


def test_deep_nodes_group_suffixes_by_their_first_words():
    rng = random.Random(6)
    for least in (1, 2, 4):
        suffixes = sorted([rng.choice([b"a", b"a\x01", b"b"]) for _ in range(rng.randint(0, 9))] for _ in range(200))
        depths = [suffix_trees.common_words(a, b) for a, b in zip(suffixes, suffixes[1:])]
        got = sorted((first, last) for _, first, last in suffix_trees.deep_nodes(depths, least))
        groups = {}
        for i, s in enumerate(suffixes):
            if len(s) >= least:
                groups.setdefault(tuple(s[:least]), []).append(i)
        assert got == sorted((g[0], g[-1]) for g in groups.values() if len(g) > 1)
        for depth, first, last in suffix_trees.deep_nodes(depths, least):
            assert depth == min(depths[first:last])


def test_words_with_control_characters(spark, rows_of):
    head = " ".join(f"w{i}" for i in range(20))
    rows = [(1, head), (2, head + "\x01 x y"), (3, head + " z"), (4, "q " + head), (5, head + "! x"), (6, head + " z z")]
    got = sorted(rows_of(suffix_trees.removed_digests(frame(spark, rows)), *COLUMNS["words"]))
    assert got == brute.repeated_words(rows)
    assert [r[2] for r in got] == [0, 0, 20, 20, 0, 21]


def test_spots_keep_place_and_windows():
    place, lo, hi = np.array([5, 200, 1 << 30]), np.array([0, 24, (1 << 30) - 3]), np.array([5, 180, (1 << 30)])
    for p, a, b, spot in zip(place, lo, hi, anchored.spots_at(place, lo, hi).tolist()):
        assert anchored.of_spot(spot) == (p, a, b, False) and anchored.of_spot(spot + 1) == (p, a, b, True)


def near_rows(n=400):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 50)) for _ in range(120)) for _ in range(12)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 9)}"
        out.append((n - i, " ".join(words)))
    return out


@pytest.mark.parametrize("group", [8192, 20])
def test_near_copies(spark, rows_of, group, monkeypatch):
    rows = near_rows() + [(1000 + i, t) for i, t in ODD] + [(None, ODD[3][1]), (1004, "one")]
    monkeypatch.setattr(simhash_ring, "GROUP", group)
    got = simhash_ring.near_groups(frame(spark, rows), group=group)
    got = sorted([(r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got.collect()], key=repr)
    assert got == brute.near_copies(rows)


def test_near_copies_of_documents(spark, folder, empty_docs, rows_of):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    columns = ("doc_id", "fingerprint", "component_id")
    assert rows_of(simhash_ring.near_digests(docs), *columns) == brute.near_copies(rows)
    assert simhash_ring.near_digests(empty_docs).count() == 0
    kept = simhash_ring.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for *_, c in brute.near_copies(rows)})


def test_every_pair_within_the_limit_shares_a_chain():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        bits = rng.choice(64, rng.integers(1, 5), replace=False)
        x = np.array([sum(1 << int(b) for b in bits)], np.uint64)
        assert any(simhash_ring._linked(x, np.array([i]))[0] for i in range(5))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(130, 101), (7, 7), (300, 301), (301, 300)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots)
    assert roots == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 131)}, 300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
