import math
import random
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import filters, geo, vectors
from matchspark.operators import matching, synonyms
from matchspark.operators.filtering import Request, filter_candidates
from matchspark.plans import jobs
from matchspark.sources import tables

DIMS = 6
CANDIDATE = (
    "candidate_id long, location string, region string, country string, desired_location string, latitude double, longitude double, "
    "age int, salary_low double, date_available date, parttime_preferenza_perc int, turno_preferenza array<string>, education string, "
    "skills string, languages string, certifications string, last_job_emb array<float>, second_last_job_emb array<float>, "
    "third_last_job_emb array<float>, skills_emb array<float>")
VACANCY = (
    "vacancy_id long, location string, region string, latitude double, longitude double, max_distance double, max_age int, max_ral double, "
    "date_available date, parttime_preferenza_perc int, turno_preferenza array<string>, education_mand string, skills_mand array<string>, "
    "languages_mand array<string>, certifications_mand array<string>, jobtitle_emb array<float>, skills_emb array<float>")


def random_sides(seed, people=220, openings=25):
    rng = random.Random(seed)
    vec = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(DIMS)]
    maybe = lambda v, p=0.15: None if rng.random() < p else v
    place = lambda: (maybe(rng.choice(["Bari", "lecce ", "Modena"])), maybe(rng.choice(["Puglia", "emilia", " PUGLIA"])))
    candidates, vacancies = [], []
    for i in range(people):
        city, region = place()
        lat = maybe(rng.uniform(40, 45))
        candidates.append((
            i, city, region, rng.choice(["Italia", "Francia"]), maybe(rng.choice(vocab.MOBILITY_LEVELS)), lat, rng.uniform(8, 18) if lat else None,
            maybe(rng.randint(18, 65)), maybe(float(rng.randint(10, 60))), maybe(date(2024, rng.randint(1, 12), 1)), maybe(rng.choice([0, 20, 50, 100])),
            maybe(rng.sample(["Mattina", "notte", "Pomeriggio", "Sera"], rng.randint(0, 3))), maybe(rng.choice(vocab.EDUCATION_LEVELS)),
            maybe(rng.choice(["SQL, Java", "java", "sap"])), maybe("Inglese"), maybe("Patente B"), vec(), vec(), vec(), vec()))
    for i in range(openings):
        city, region = place()
        lat = maybe(rng.uniform(40, 45), 0.3)
        vacancies.append((
            i, city, region, lat, rng.uniform(8, 18) if lat else None, rng.choice([20.0, 150.0, 600.0]), rng.choice([0, 40]), rng.choice([0.0, 40.0]),
            maybe(date(2024, 6, 1), 0.5), rng.choice([0, 50]), rng.choice([None, ["Mattina"], ["Notte", "Mattina"]]),
            rng.choice([None, "Laurea triennale"]), rng.choice([[], ["java"]]), rng.choice([[], ["inglese"]]), [], vec(), vec()))
    return candidates, vacancies


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, x)))


def admits(c, v):
    low = lambda s: (s or "").strip().lower()
    (_, city, region, country, mobility, lat, lon, age, salary, free, part, shifts, edu, skills, langs, certs, *_) = c
    (_, v_city, v_region, v_lat, v_lon, radius, max_age, max_ral, start, v_part, v_shifts, v_edu, need_skills, need_langs, _, *_) = v
    place = mobility == "Internazionale" or (mobility == "Nazionale" and country == "Italia")
    place |= mobility == "Regionale" and low(region) == low(v_region) != ""
    if v_lat is not None:
        place |= lat is not None and km(lat, lon, v_lat, v_lon) <= radius
    else:
        place |= low(city) == low(v_city) != ""
    rank = vocab.EDUCATION_LEVELS
    return bool(
        place and (not max_age or age is None or age <= max_age) and (not max_ral or salary is None or salary <= max_ral)
        and (start is None or free is None or free <= start) and (not v_part or not part or part >= v_part)
        and (not v_shifts or not shifts or {low(s) for s in v_shifts} <= {low(s) for s in shifts})
        and (not v_edu or (edu is not None and rank.index(edu) >= rank.index(v_edu)))
        and all(t in low(skills) for t in need_skills) and all(t in low(langs) for t in need_langs))


def brute_force(candidates, vacancies, k):
    out = []
    for v in vacancies:
        kept = [c for c in candidates if admits(c, v)]
        if not kept:
            continue
        job, skill = np.array(v[-2]), np.array(v[-1])
        cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9))
        sims = np.array([[cos(np.array(c[-4]), job), cos(np.array(c[-3]), job), cos(np.array(c[-2]), job), cos(np.array(c[-1]), skill)] for c in kept])
        low = sims.min(axis=0)
        scores = ((sims - low) / (1 - low + 1e-9)) @ np.array(vocab.SCORE_WEIGHTS)
        best = sorted(((round(s, 9), c[0]) for s, c in zip(scores, kept) if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        out += [(v[0], cid, int(np.round(s, 0)), n) for n, (s, cid) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,options", [
    (1, {}), (1, {"sent_vacancies": 0}), (2, {"sent_vacancies": 0, "candidate_tile": 16, "vacancy_tile": 3, "cell": 0.5}), (3, {"vacancy_tile": 4})])
def test_matching_equals_brute_force(spark, seed, options):
    candidates, vacancies = random_sides(seed)
    got = matching.match_all(
        spark.createDataFrame(vacancies, VACANCY), spark.createDataFrame(candidates, CANDIDATE).repartition(5), k=7, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(candidates, vacancies, 7)


@pytest.mark.parametrize("options", [{}, {"sent_vacancies": 0}, {"sent_vacancies": 0, "candidate_tile": 8, "vacancy_tile": 2, "cell": 2.0}])
def test_dirty_places_radius_provinces_and_vectors(spark, options):
    """Tabs around names, no radius, provinces and missing vectors mean the same on every path."""
    candidates, vacancies = random_sides(5)
    provinces = ["Bari", " modena", "LECCE", None]
    people = [(*c[:2], f"{c[2]}\t" if c[2] and i % 3 == 0 else c[2], *c[3:-1], None if i % 17 == 0 else c[-1], provinces[i % 4]) for i, c in enumerate(candidates)]
    wanted = [["bari", "Modena\t"], [], None]
    openings = [(*v[:2], f"\t{v[2]} " if v[2] else v[2], *v[3:5], None if i % 4 == 0 else v[5], *v[6:-1], None if i == 7 else v[-1], wanted[i % 3]) for i, v in enumerate(vacancies)]
    got = matching.match_all(
        spark.createDataFrame(openings, VACANCY + ", provinces array<string>"),
        spark.createDataFrame(people, CANDIDATE + ", province_ext string").repartition(5), k=7, **options)
    low = lambda s: (s or "").strip().lower()
    expected = []
    for v in openings:
        served = {low(p) for p in v[-1] or []}
        pool = [c[:-1] for c in people if c[-2] is not None and (not served or low(c[-1]) in served)]
        plain = [*v[:-1]]
        plain[5] = -1.0 if plain[5] is None else plain[5]
        if v[-2] is not None:
            expected += brute_force(pool, [tuple(plain)], 7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_hot_block_is_cut_into_bounded_tiles(spark):
    people = spark.range(3000).select(F.col("id").alias("candidate_id"), F.when(F.col("id") < 2000, F.lit("G")).otherwise(F.concat(F.lit("R:"), F.col("id") % 50)).alias("block"))
    openings = spark.range(40).select(F.col("id").alias("vacancy_id"), F.lit("G").alias("block"))
    left, right = matching.tiles(people, openings, 100, 10)
    sizes = left.groupBy("block", "c_tile", "v_tile").count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    met = left.join(right, ["block", "c_tile", "v_tile"]).select("candidate_id", "vacancy_id")
    assert met.count() == met.distinct().count() == 2000 * 40
    assert left.where("block <> 'G'").count() == 0


def test_packs_hold_every_row_once_and_no_copies(spark):
    """However many packs the other side has, a row is written once, with the blocks of its pack."""
    rows = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 10 == 3, F.array().cast("array<string>")).otherwise(F.array((F.col("id") % 7).cast("string"))).alias("blocks"))
    found = matching.packs(rows.coalesce(2), 64).collect()
    sizes = [len(matching._rows_of(pa.scalar(bytes(r["body"]), pa.binary()))) for r in found]
    ids = sorted(i for r in found for i in matching._rows_of(pa.scalar(bytes(r["body"]), pa.binary()))["id"])
    assert ids == [i for i in range(1000) if i % 10 != 3] and max(sizes) == 64 and len(found) <= 16
    assert all(set(r["blocks"]) == set("0123456") for r in found if len(r["blocks"]) > 6) and len({r["pack"] for r in found}) == len(found)


def test_many_openings_are_matched_without_copies_of_vectors(spark):
    """Smaller tiles mean more packs that meet, but no more rows shuffled."""
    candidates, vacancies = random_sides(4)
    people, openings = spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(vacancies, VACANCY)
    met = matching.match_all(openings, people, k=7, sent_vacancies=0, candidate_tile=4, vacancy_tile=1)
    assert "FlatMapCoGroupsInPandas" not in met._jdf.queryExecution().toString() and "CartesianProduct" in met._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in met.collect()) == brute_force(candidates, vacancies, 7)


def batches(spark, candidates, vacancies):
    people = matching.prepare_candidates(spark.createDataFrame(candidates, CANDIDATE)).select("everywhere", "location", *matching.CANDIDATE_COLUMNS)
    openings = matching.prepare_vacancies(spark.createDataFrame(vacancies, VACANCY)).select("location", *matching.VACANCY_COLUMNS)
    c, v = matching._People(matching._rows(people.toArrow())), matching._Openings(matching._rows(openings.toArrow()))
    v.meet(c)
    return c, v


@pytest.mark.parametrize("options", [{}, {"sent_vacancies": 0}, {"sent_vacancies": 0, "candidate_tile": 100, "vacancy_tile": 8}])
def test_close_short_and_zero_vectors_are_scored_exactly(spark, options):
    """Vectors closer than single precision tells, very short ones and zeros: nobody is lost to rounding."""
    candidates, vacancies = random_sides(6, 700, 20)
    rng, near = random.Random(6), lambda v: [float(np.float32(x + rng.choice([0, 1e-7, 3e-7]))) for x in v]
    scaled = lambda v, x: [float(np.float32(y * x)) for y in v]
    people = []
    for i, c in enumerate(candidates):
        vecs = [near(x) for x in candidates[i % 40][-4:]]
        if i % 50 == 7:
            vecs = [scaled(x, rng.choice([0.0, 1e-5, 1e-11])) for x in vecs]
        people.append((*c[:-4], *vecs))
    got = matching.match_all(
        spark.createDataFrame(vacancies, VACANCY), spark.createDataFrame(people, CANDIDATE).repartition(3), k=30, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(people, vacancies, 30)


def test_a_candidate_without_numbers_spoils_no_others(spark):
    """A vector that holds no numbers can't be scored; the other candidates are as without it."""
    candidates, vacancies = random_sides(7, 120, 12)
    lost = [(*c[:-4], [float("nan")] * DIMS, *c[-3:]) if i % 10 == 0 else c for i, c in enumerate(candidates)]
    got = matching.match_all(spark.createDataFrame(vacancies, VACANCY), spark.createDataFrame(lost, CANDIDATE), k=200, sent_vacancies=0)
    picked = {(r[0], r[1]) for r in got.collect()}
    assert picked and not [p for p in picked if p[1] % 10 == 0]
    assert {p[0] for p in picked} == {v[0] for v in vacancies if sum(admits(c, v) for c in candidates if c[0] % 10) > 1}


def test_tiles_ask_every_opening_that_may_admit(spark):
    """Also around the poles, across the date line and for places that are none."""
    rng = random.Random(8)
    spots = [(89.9, 10.0), (-89.9, -170.0), (0.0, 179.9), (0.0, -179.9), (45.0, 9.0), (95.0, 9.0), (45.0, 200.0), (None, None)]
    spot = lambda: tuple(None if x is None else x + rng.uniform(-0.5, 0.5) for x in rng.choice(spots))
    candidates, vacancies = random_sides(8, 1500, 60)
    candidates = [(*c[:5], *spot(), *c[7:]) for c in candidates]
    vacancies = [(*v[:3], *spot(), *v[5:]) for v in vacancies]
    c, v = batches(spark, candidates, vacancies)
    asked = 0
    for tile in c.tiles:
        ok = matching._admitted(c, v, np.arange(tile.start, tile.stop)[None, :], np.arange(len(v))[:, None])
        assert ok.tolist() == [[admits(candidates[i], vacancies[j]) for i in c.ids[tile.start:tile.stop]] for j in v.ids]
        assert set(np.flatnonzero(ok.any(axis=1))) <= set(matching._asking(c, v, tile))
        asked += len(matching._asking(c, v, tile))
    assert asked < len(c.tiles) * len(v)


def test_few_pairs_are_tested_or_scored_exactly(spark, monkeypatch):
    """Matrix products settle most pairs; filters and exact scores see the few that may count."""
    candidates, vacancies = random_sides(9, 40 * matching.SCORED_PEOPLE // 8, 30)
    candidates = [(*c[:4], "Internazionale", *c[5:]) for c in candidates]
    rng = np.random.default_rng(9)
    many = [(n * len(candidates) + c[0], *c[1:-4], *rng.normal(size=(4, DIMS)).tolist()) for n in range(8) for c in candidates]
    c, v = batches(spark, many, vacancies)
    seen = {"tested": 0, "exact": 0}
    test, exact = matching._admitted, matching._exact
    monkeypatch.setattr(matching, "_admitted", lambda c, v, i, j: (seen.__setitem__("tested", seen["tested"] + np.broadcast(i, j).size), test(c, v, i, j))[1])
    monkeypatch.setattr(matching, "_exact", lambda c, v, n, i, j: (seen.__setitem__("exact", seen["exact"] + len(i)), exact(c, v, n, i, j))[1])
    lows = next(matching._found([(c, 0, v)], matching._Lows, 16))
    v.lows = lows.set_index("vacancy_id").reindex(v.ids)[list(matching.SIMS)].to_numpy().T
    v.fine &= np.isfinite(v.lows).all(axis=0)
    best = next(matching._found([(c, 0, v)], lambda v: matching._Best(v, vocab.SCORE_WEIGHTS, 5), 16))
    assert len(best) == 5 * v.fine.sum() > 50
    pairs = len(many) * len(vacancies)
    assert seen["tested"] < pairs / 4 and seen["exact"] < pairs / 50


def test_score_request_scales_and_breaks_ties(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [(i, e(1, 0), e(1, 0), e(1, 0), e(1, 0)) for i in (3, 1, 2)] + [(4, e(0, 1), e(0, 1), e(0, 1), e(0, 1)), (5, e(0, 0), e(0, 0), e(0, 0), e(0, 0))]
    people = spark.createDataFrame(rows, "candidate_id long, last_job_emb array<float>, second_last_job_emb array<float>, third_last_job_emb array<float>, skills_emb array<float>")
    request = spark.createDataFrame([(e(1, 0), e(1, 0))], "jobtitle_emb array<float>, skills_emb array<float>")
    assert [tuple(r) for r in matching.score_request(people, request, k=2).collect()] == [(1, 95), (2, 95)]
    assert matching.score_request(people, request, k=None).count() == 3
    older = matching.score_request(people, request, weights=vocab.OLDER_SCORE_WEIGHTS, scale=False)
    assert [r["score"] for r in older.collect()] == [95, 95, 95]


def people_for_filter(spark):
    rows = [
        (1, "Bari", "Puglia", "Italia", "Bari", "Locale", 41.12, 16.87, 30, 20000, date(2024, 1, 1), 100, ["Mattina", "Notte"], "SQL, Java", "Inglese", "Patente B", "Laurea triennale"),
        (2, "Lecce", "Puglia", "Italia", "LECCE", "Regionale", 40.35, 18.17, None, None, None, None, None, "sql", "inglese, russo", None, "dottorato/master"),
        (3, "Modena", "Emilia-Romagna", "Italia", "Modena", "Nazionale", None, None, 60, 50000, date(2025, 1, 1), 0, [], "java", None, "x", "Diploma scuola media"),
        (4, "Milano", "Lombardia", "Italia", "Milano", "Internazionale", 45.4, 9.2, 30, 1, None, 100, None, "sql", "inglese", None, None),
        (5, "Parma", "Emilia-Romagna", "Francia", "Parma", "Nazionale", 44.8, 10.3, 30, 1, None, 100, None, "sql", "inglese", None, None),
        (6, "Bari", "Puglia", "Italia", "Bari", None, None, None, 30, 1, None, 100, None, "sql", "inglese", None, None)]
    return spark.createDataFrame(rows, (
        "candidateid long, location string, region string, country string, province_ext string, desired_location string, latitude double, longitude double, age int, "
        "salary_low long, date_available date, parttime_preferenza_perc int, turno_preferenza array<string>, skills string, languages string, certifications string, education string"))


def towns(spark):
    return spark.createDataFrame([
        ("1", "Bari", "BA", "Bari", "Puglia", "70121", 41.12, 16.87), ("2", "Nowhere", "NW", "N", "Puglia", "1", None, None),
        ("3", "Lost", "L", "L", None, "1", float("nan"), 1.0)], tables.CITY_SCHEMA)


@pytest.mark.parametrize("request_,wanted", [
    (Request(), {3}),
    (Request(location="BARI "), {1, 2, 3}),
    (Request(location="Bari", max_distance=150), {1, 2, 3}),
    (Request(location="Nowhere"), {2, 3}),
    (Request(location="Atlantide"), {3}),
    (Request(location="Lost"), {3}),
    (Request(location="Bari", max_age=30), {1, 2}),
    (Request(location="Bari", max_ral=20000), {1, 2}),
    (Request(location="Bari", date_available=date(2024, 1, 1)), {1, 2}),
    (Request(location="Bari", parttime_preferenza_perc=50), {1, 2, 3}),
    (Request(location="Bari", turno_preferenza=("Notte",)), {1, 2, 3}),
    (Request(location="Bari", turno_preferenza=("Notte", "Pomeriggio")), {2, 3}),
    (Request(location="Bari", skills_mand="sql , JAVA"), {1}),
    (Request(location="Bari", languages_mand=("Inglese", "Russo")), {2}),
    (Request(location="Bari", certifications_mand="patente b"), {1}),
    (Request(location="Bari", education_mand="Laurea triennale"), {1, 2}),
    (Request(provinces=()), {3, 4}),
])
def test_candidate_filter(spark, request_, wanted):
    got = {r["candidateid"] for r in filter_candidates(people_for_filter(spark), request_, towns(spark)).collect()}
    assert got == wanted


def test_search_job_shapes_result(spark):
    people = people_for_filter(spark)
    for i, name in enumerate(vocab.CANDIDATE_VECTORS):
        people = people.withColumn(name, F.array(F.lit(1.0 + i).cast("float"), F.col("candidateid").cast("float")))
    request = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0])], "jobtitle_emb array<float>, skills_emb array<float>")
    got = jobs.search_candidates(people, Request(location="Bari"), request, towns(spark), k=2, active={"turno_preferenza": ["x"]})
    assert got.columns == ["Score", "ID Candidato", "Location", "URL", "Età", "Preferenza turno"]
    rows = got.collect()
    assert len(rows) == 2 and rows[0]["Score"] >= rows[1]["Score"] and rows[0]["URL"].startswith("[Open Link](")


def shifts_by_explode(df, key, shifts, wanted):
    """The shift test as exploding and counting."""
    low = [w.lower() for w in wanted]
    full = df.select(key, F.explode(shifts).alias("s")).where(F.lower("s").isin(low)).groupBy(key).agg(F.countDistinct(F.lower("s")).alias("n"))
    return df.join(full.where(F.col("n") == len(set(low))).select(key), key).unionAll(df.where(F.col(shifts).isNull() | (F.size(shifts) == 0)))


def test_shift_forms_agree(spark):
    df = spark.createDataFrame([(1, ["Mattina", "Notte"]), (2, ["mattina"]), (3, []), (4, None), (5, ["Notte", "Notte"]), (6, ["notte", "x", "MATTINA"])], "i int, s array<string>")
    wanted = F.array(F.lit("Mattina"), F.lit("Notte"))
    a = {r["i"] for r in df.where(filters.holds_all(F.col("s"), wanted)).collect()}
    b = {r["i"] for r in shifts_by_explode(df, "i", "s", ["Mattina", "Notte"]).collect()}
    assert a == b == {1, 3, 4, 6}


def test_haversine_bounds(spark):
    got = spark.range(1).select(
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), geo.haversine(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)).alias("zero")).first()
    assert abs(got["half"] - math.pi * 6371) < 1e-6 and got["zero"] == 0


def test_hash_embedding_is_unit_and_repeatable(spark):
    df = spark.createDataFrame([("SQL java sql",), (None,), ("",), ("---",)], "t string")
    a, none, empty, symbols = (r[0] for r in df.select(vectors.hash_embedding(F.col("t"), 32)).collect())
    assert len(a) == 32 and abs(sum(x * x for x in a) - 1) < 1e-6
    assert none == empty and sum(none) > 0 and sum(symbols) == 0


def plain_expansion(roles, query, cutoff):
    def norm(text):
        return "".join(ch for ch in text.lower() if ch.isalnum())

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    owner = {}
    for role in sorted(roles):
        for word in [role, *roles[role]]:
            owner.setdefault(norm(word), role)
    q = norm(query)
    close = lambda n: 1 - edits(q, n) / max(len(q), len(n), 1) >= cutoff - 1e-12
    found = {r for n, r in owner.items() if q in n or n in q or close(n)}
    return list(dict.fromkeys(t for r in sorted(roles) if r in found for t in roles[r]))


@pytest.mark.parametrize("cutoff", [0.85, 0.6])
def test_synonyms_equal_stated_rule(spark, cutoff):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 12)))
    roles = {f"role {i}": [word() for _ in range(4)] for i in range(25)} | {"acquisti": ["buyer", "procurement", "gestione ordini"]}
    asked = [word() for _ in range(60)] + ["Senior Buyer", "procurment", "a", "ab", "gestione-ordine", "zzz"]
    asked += [t[:-1] + "x" for ts in roles.values() for t in ts]
    asked = sorted({q for q in asked if any(ch.isalnum() for ch in q)})
    terms = synonyms.dictionary(spark.createDataFrame(list(roles.items()), "role string, synonyms array<string>"))
    got = synonyms.expand_roles(spark.createDataFrame([(q,) for q in asked], "q string"), "q", terms, cutoff)
    assert {r["q"]: r["synonyms"] for r in got.collect()} == {q: plain_expansion(roles, q, cutoff) or None for q in asked}


def test_scalar_synonym_is_one_term(spark):
    terms = synonyms.dictionary(spark.createDataFrame([("accettazione", "accoglienza")], "role string, synonyms string"))
    got = synonyms.expand_roles(spark.createDataFrame([("Accettazione",)], "q string"), "q", terms).first()
    assert got["synonyms"] == ["accoglienza"]
