import json
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import filters, jsonx
from matchspark.operators import extraction, features, geography, incremental, notes, recency, rubric
from matchspark.plans import jobs
from matchspark.sources import tables


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_repair_json(spark):
    cases = {
        '```json{"a": 1}```': '{"a": 1}', '  ```JSON\n{"A":\t1}\n```': '{"a": 1}', '{"a": "b\\"}"': '{"a": "b"}',
        '{"a": 1}\'': '{"a": 1}', "": "", '{"a":  1, "b": 2}': '{"a": 1, "b": 2}',
    }
    for raw, wanted in cases.items():
        assert one(spark, raw, "string", jsonx.repair_json) == wanted
    assert one(spark, None, "string", jsonx.repair_json) == ""
    for raw in ('{"a": 1,}', "{", "x", ""):
        assert one(spark, raw, "string", jsonx.is_valid_json) is False


def test_field_rules(spark):
    ages = {"": None, "nan": None, "0": None, "1": 1, "150": 150, "151": None, "30.7": None, " 40 ": 40}
    for raw, wanted in ages.items():
        assert one(spark, raw, "string", jsonx.valid_age) == wanted
    births = {"1990-02-28": date(1990, 2, 28), "1992-02-29": None, "1990-04-31": None, "1990-12-31": date(1990, 12, 31), "1890-01-01": None}
    for raw, wanted in births.items():
        assert one(spark, raw, "string", jsonx.valid_birth_date) == wanted
    for raw, wanted in {"2010": None, "20100": "20100", "201000": None, "2010a": None}.items():
        assert one(spark, raw, "string", jsonx.valid_zip) == wanted


def test_part_time(spark):
    percent = lambda c: features.largest_percent(c, vocab.PART_TIME_PERCENTS)
    for raw, wanted in {"80%": 80, "80, 100": 100, "5%": None, None: 100}.items():
        assert one(spark, raw, "string", percent) == wanted
    for raw, wanted in {"90, 100": 100, "a 7% b": 7, "none": None}.items():
        assert one(spark, raw, "string", features.largest_number) == wanted


def test_append_shift(spark):
    df = spark.createDataFrame(
        [(["Mattina"], "True "), (None, "true"), (["Fine Settimana"], "true"), (["Notte"], "False"), (None, None)],
        "s array<string>, a string")
    got = [r[0] for r in df.select(features.append_shift(F.col("s"), F.col("a"))).collect()]
    assert got == [["Mattina", "Fine Settimana"], ["Fine Settimana"], ["Fine Settimana"], ["Notte"], None]


def test_mobility_and_closest(spark):
    level = lambda c: features.highest_level(c, vocab.MOBILITY_LEVELS)
    assert one(spark, "locale; NAZIONALE", "string", level) == "Nazionale"
    assert one(spark, "altro", "string", level) is None
    near = lambda c: features.closest_allowed(c, vocab.PART_TIME_PERCENTS)
    assert [one(spark, v, "int", near) for v in (0, 15, 16, 99, None)] == [10, 10, 20, 100, None]


def test_result_columns():
    assert features.result_columns({}) == features.RESULT_COLUMNS
    shown = features.result_columns({"skills_mand": "sql", "skills_opt": "x", "max_ral": 1})
    assert shown == features.RESULT_COLUMNS + ["skills", "salary_low"]


def test_recent_uses_all_dates(spark):
    as_of = F.lit("2024-03-31").cast("timestamp_ntz")
    people = spark.createDataFrame([
        (1, datetime(2024, 3, 1), None), (2, datetime(2024, 2, 1), None), (3, None, None), (4, None, datetime(2024, 3, 20)), (5, None, None)],
        "k int, added timestamp_ntz, modified timestamp_ntz")
    changes = spark.createDataFrame([(2, datetime(2024, 3, 30)), (3, datetime(2024, 1, 1)), (2, datetime(2024, 3, 2))], "k int, t timestamp_ntz")
    got = recency.recent(people, changes, "k", "t", ["added", "modified"], as_of, 30)
    assert {r["k"]: r["date_last_active"] for r in got.collect()} == {
        1: datetime(2024, 3, 1), 2: datetime(2024, 3, 30), 4: datetime(2024, 3, 20)}


def test_high_water_without_history(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert recency.since_high_water(df, None, "t").count() == 1
    assert recency.since_high_water(df, df.limit(0), "t").count() == 1
    assert recency.since_high_water(df, df.select((F.col("t") + F.expr("interval 1 day")).alias("t")), "t").count() == 0


def test_chat_threads(spark):
    q = vocab.CHAT_QUESTION
    t = lambda d: datetime(2024, d // 28 + 1, d % 28 + 1)
    rows = [
        ("n1", "p1", f"{q} si", "JoBoti", t(1), 0), ("n1", "p1", f"{q} no", "joboti", t(40), 0),
        ("n2", "p1", f"{q} forse", "x joboti", t(2), 0), ("n3", "p1", q, "joboti", t(1), 0), ("n3", "p1", q, "joboti", t(2), 1),
        ("n4", "p2", q, "call", t(1), 0), ("n5", "p3", "altro", "joboti", t(1), 0), ("n6", "p4", f"{q} a", "joboti", t(5), 0)]
    df = spark.createDataFrame(rows, "noteid string, personreferenceid string, comments string, action string, load_datetimestamp timestamp_ntz, isdeleted int")
    got = {r[0]: r[1] for r in notes.chat_threads(df, "joboti", q).collect()}
    assert got == {"p1": f"{q} forse || {q} no", "p4": f"{q} a"}


def test_change_flags(spark):
    rows = [("a", "a", False), ("a", "b", True), ("a", None, True), (None, "b", True), ("a", "Description", False)]
    df = spark.createDataFrame(rows, "raw string, old string, wanted boolean")
    flag = incremental.changed(F.col("raw"), incremental.fingerprint(F.col("old")), F.col("old") == vocab.RAW_HEADER)
    got = df.select(flag.alias("g"), "wanted").collect()
    assert all(r["g"] == r["wanted"] for r in got)


def test_history_join_suffixes(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    old = spark.createDataFrame([(1, "z", 7)], "k int, x string, feature int")
    got = incremental.with_history(new, old, "k").orderBy("k")
    assert got.columns == ["k", "x", "x_old", "feature"] and [tuple(r) for r in got.collect()] == [(1, "a", "z", 7), (2, "b", None, None)]


def candidate_rows(spark, texts, chats=None):
    chats = chats or {}
    rows = [(str(i), t, t, chats.get(i), chats.get(i), ["Notte"]) for i, t in texts.items()]
    return spark.createDataFrame(
        rows, "candidateid string, description string, description_raw string, chatwa string, chatwa_raw string, turno_preferenza array<string>")


def cities(spark):
    return spark.createDataFrame(
        [("2", "Bari", "BA", "Bari", "Puglia", "70121", 41.1, 16.8), ("1", "BARI", "BA", "Bari", "Puglia", "70100", 41.12, 16.87)],
        tables.CITY_SCHEMA)


def test_transformation_runs_incrementally(spark, tmp_path):
    root = str(tmp_path / "t")
    stamp = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp_ntz")
    first = candidate_rows(spark, {1: "domicilio: Bari | cap 70121 | eta: 30 | inglese", 2: "ultimo lavoro: buyer"}, {1: "Disponibile? si", 2: "Disponibile? no"})
    run = lambda rows, d: {r["candidateid"]: r for r in jobs.run_transformation(
        spark, rows, root, cities(spark), stamp(d), run_id=f"r{d}", dims=16).collect()}
    one_ = run(first, 1)
    assert one_["1"]["age"] == 30 and one_["1"]["languages"] == "inglese" and one_["1"]["zip_code"] == "70121"
    assert one_["1"]["latitude"] == 41.12 and one_["1"]["province_ext"] == "Bari" and one_["1"]["distance_km"] == 999999
    assert one_["1"]["turno_preferenza"] == ["Notte", "Fine Settimana"] and one_["2"]["turno_preferenza"] == ["Notte"]
    assert len(one_["1"]["skills_emb"]) == 16
    # Nothing changed: same rows, nothing processed, stamps and appended shift kept.
    two = run(first, 2)
    strip = lambda rows: {k: {c: v for c, v in r.asDict().items() if not c.startswith("needs_")} for k, r in rows.items()}
    assert strip(two) == strip(one_)
    changed = candidate_rows(spark, {1: "domicilio: Bari | eta: 31", 2: "ultimo lavoro: buyer", 3: "eta: 20"}, {2: "Disponibile? si"})
    three = run(changed, 3)
    assert three["1"]["age"] == 31 and three["1"]["time_processing"] == datetime(2024, 1, 3)
    assert three["2"]["last_job"] == "buyer" and three["2"]["turno_preferenza"] == ["Notte", "Fine Settimana"]
    assert three["3"]["age"] == 20
    log = tables.read_log(spark, f"{root}/candidate_log").orderBy("id").collect()
    assert [(r["nproc_cv_rows"], r["nproc_wa_rows"]) for r in log] == [(2, 2), (0, 0), (2, 1)]
    tables.reset_log(spark, f"{root}/candidate_log")
    assert not tables.table_exists(spark, f"{root}/candidate_log")


def test_publish_survives_a_dead_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert not tables.table_exists(spark, path)
    tables.publish(spark.range(3), path)
    # A run that dies after its data but before its pointer leaves the old version.
    monkeypatch.setattr(tables, "table_exists", lambda *_: (_ for _ in ()).throw(RuntimeError("dead")))
    with pytest.raises(RuntimeError):
        tables.publish(spark.range(9), path)
    monkeypatch.undo()
    assert tables.table_exists(spark, path) and tables.current(spark, path).count() == 3
    tables.publish(spark.range(5), path)
    assert tables.current(spark, path).count() == 5


def test_long_zip_codes_stay_whole(spark):
    rows = [("1", "A", "", "", "", "701219.0", "1", "2"), ("2", "B", "", "", "", "121", "1", "2"), ("3", "C", "", "", "", "x", "1", "2")]
    raw = spark.createDataFrame(rows, "unique_identifier string, city_name string, province string, province_ext string, region string, zip string, latitude string, longitude string")
    assert {r.city_name: r.zip for r in tables.load_cities(raw).collect()} == {"A": "701219", "B": "00121", "C": None}


def test_vacancy_run_keeps_rejects_and_history(spark, tmp_path):
    root, stamp = str(tmp_path / "v"), F.lit("2024-01-01").cast("timestamp_ntz")
    new = spark.createDataFrame(
        [(1, "Buyer", "cerca buyer"), (2, "Cook", "cerca bad cook")], "joborderid long, jobtitle string, description string").withColumn("description_raw", F.col("description"))
    rules = extraction.vacancy_rules()
    provider = lambda c: F.when(c.contains("bad"), F.lit("no json")).otherwise(rules(c))
    for _ in range(2):
        got = jobs.run_vacancies(spark, new, root, stamp, provider=provider, dims=8).collect()
        assert [r["joborderid"] for r in got] == [1]
        assert [tuple(r) for r in tables.current(spark, f"{root}/vacancy_rejects").collect()] == [(2, "no json")]
    log = tables.read_log(spark, f"{root}/vacancy_log").orderBy("id").collect()
    assert [(r["nproc_rows"], r["nproc_rejected"]) for r in log] == [(2, 1), (1, 1)]


def test_vacancy_features(spark):
    new = spark.createDataFrame(
        [(1, "Buyer", "Full time giornaliero, richiesto inglese, 24 ore"), (2, "x", None), (3, " ", "")],
        "joborderid long, jobtitle string, description string").withColumn("description_raw", F.col("description"))
    got = {r["joborderid"]: r for r in jobs.transform_vacancies(new, None, F.lit("2024-01-01").cast("timestamp_ntz"), dims=8).collect()}
    assert set(got) == {1}  # a vacancy without text gets no answer; blank ones are not asked
    assert got[1]["turno_preferenza"] == "mattina, pomeriggio" and got[1]["parttime_preferenza_perc"] == 60
    assert got[1]["country"] == "italia" and got[1]["languages"] == "inglese" and len(got[1]["jobtitle_emb"]) == 8


def test_rejected_answers_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "candidateid int, description string")
    answer = extraction.batch_provider(lambda ps: [json.dumps({"age": "33"}) if p == "ok" else "no json" for p in ps])
    good, rejected = extraction.extract_candidates(df, answer)
    assert [(r["candidateid"], r["age"], r["skills"]) for r in good.collect()] == [(1, 33, None)]
    assert [r["candidateid"] for r in rejected.collect()] == [2]


def test_dedupe_asks_once(spark, tmp_path):
    rows = [(i, "same" if i < 3000 else f"p{i}" if i < 5000 else None) for i in range(5010)]
    df = spark.createDataFrame(rows, "i int, p string")
    log = str(tmp_path / "calls")

    def call(prompts):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [p.upper() for p in prompts]

    got = extraction.ask(df, F.col("p"), extraction.batch_provider(call), "a", dedupe=True)
    got = sorted(got.collect(), key=lambda r: r["i"])
    assert [r["a"] for r in got] == [p and p.upper() for _, p in rows]
    asked = open(log).read().split()
    assert len(asked) == len(set(asked)) == 2001


def test_geo_fan_out(spark):
    people = spark.createDataFrame([("1", "bari", "99999"), ("2", "Nowhere", None)], "candidateid string, location string, zip_code string")
    single = geography.enrich(people, cities(spark)).orderBy("candidateid").collect()
    assert [(r["zip_code"], r["latitude"]) for r in single] == [("70100", 41.12), (None, None)]
    assert geography.enrich(people, cities(spark), fan_out=True).count() == 3


def test_city_loading(spark):
    raw = spark.createDataFrame([
        ("1", " Bari ", "BA", "Bari", "Puglia", "121", "41.1", "x"), ("2", "null", "", "", "", "1", "1", "1"), ("3", None, "", "", "", "1", "1", "1")],
        ["Unique Identifier", "City Name", "Province", "Province Ext", '"Region"', "Zip", "Latitude ", "Longitude"])
    rows = tables.load_cities(raw).collect()
    assert [tuple(r) for r in rows] == [("1", "Bari", "BA", "Bari", "Puglia", "00121", 41.1, None)]


def test_coordinate_repair(spark):
    bad = spark.createDataFrame([("1", "Bari", "Bari", None, None), ("2", "Lecce", "Lecce", 40.35, 18.17), ("3", "X", "Y", float("nan"), 1.5)],
                                "unique_identifier string, city_name string, province_ext string, latitude double, longitude double")
    known = spark.createDataFrame([("bari ", "BARI", 41.1, 16.8)], "city_name string, province_ext string, latitude double, longitude double")
    got = {r["unique_identifier"]: (r["latitude"], r["longitude"]) for r in extraction.repair_coordinates(bad, known).collect()}
    assert got == {"1": (41.1, 16.8), "2": (40.35, 18.17), "3": (None, None)}


def test_versions_are_kept(spark, tmp_path):
    path = str(tmp_path / "v")
    assert not tables.table_exists(spark, path)
    tables.publish(spark.range(3), path)
    tables.publish(tables.current(spark, path).where("id > 0"), path)  # reads what it replaces
    assert sorted(r[0] for r in tables.current(spark, path).collect()) == [1, 2]


def test_rubric(spark):
    rows = [("Senior BUYER", "buyer", "buyer", 100), ("buyer", "buyer", "x", 85), ("buyer", None, "buyer", 70), ("buyer", "x", "x", 55),
            ("x", "buyer", "buyer", 40), ("x", "buyer", None, 25), (None, None, "buyer", 0), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "a string, b string, c string, wanted int")
    rating = rubric.job_rating(F.lit("Buyer"), F.col("a"), F.col("b"), F.col("c"))
    assert all(r["g"] == r["wanted"] for r in df.select(rating.alias("g"), "wanted").collect())


def test_gate_without_columns(spark):
    df = spark.createDataFrame([(1, "True", "3.5"), (2, "no", "9"), (3, "yes", "x")], "i int, mand_a string, score_b string")
    assert [tuple(r) for r in rubric.gate_and_sum(df).collect()] == [(1, 4)]
    assert rubric.gate_and_sum(df.select("i")).count() == 0


def test_compile_filter(spark):
    df = spark.createDataFrame([(30, "Bari"), (50, "Bari"), (None, "Bari"), (20, "Lecce")], "age int, province_ext string")
    assert df.where(filters.compile_filter({})).count() == 4
    wanted = {"@and": [{"@lte": {"age": 40}}, {"@eq": {"province_ext": "Bari"}}]}
    assert df.where(filters.compile_filter(wanted)).count() == 1


def test_ingestion_end_to_end(spark):
    as_of = F.lit("2024-03-31").cast("timestamp_ntz")
    people = spark.createDataFrame([
        (1, "A", "B", "<p>Magazziniere esperto</p>", 20000, None, True, "regionale", "80, 100", "Mattina, Notte", datetime(2024, 3, 30), None),
        (2, "C", "D", "vecchio profilo", None, None, None, None, None, None, datetime(2020, 1, 1), None)],
        "candidateid long, first_name string, last_name string, description string, salary_low long, date_available timestamp_ntz, will_relocate boolean, "
        "desired_location string, parttime_preferenza_perc string, turno_preferenza string, date_added timestamp_ntz, date_last_modified timestamp_ntz")
    subs = spark.createDataFrame([], "candidateid long, joborderid long, data_ultimo_cambio_status timestamp_ntz")
    chat = spark.createDataFrame([("n", "1", vocab.CHAT_QUESTION + " si", "joboti", datetime(2024, 3, 1), 0)],
                                 "noteid string, personreferenceid string, comments string, action string, load_datetimestamp timestamp_ntz, isdeleted int")
    got = jobs.ingest_candidates(people, subs, chat, as_of, "joboti").collect()
    assert len(got) == 1
    row = got[0]
    assert row["candidateid"] == "1" and row["description"] == "magazziniere esperto" and row["desired_location"] == "Regionale"
    assert row["parttime_preferenza_perc"] == 100 and row["turno_preferenza"] == ["Mattina", "Notte"] and row["chatwa"].endswith("si")
    orders = spark.createDataFrame([
        (9, "Buyer", "Bari", "Puglia", 1000, None, "50%", "sql", "", None, "testo", None, " ", 1, "Accepting Candidates", datetime(2024, 3, 1)),
        (8, "Chiusa", "Bari", "Puglia", 1000, None, "50%", "sql", "", None, "testo", None, " ", 0, "Accepting Candidates", datetime(2024, 3, 1))],
        "joborderid long, jobtitle string, citta string, regione string, salary long, data_inizio_validita timestamp_ntz, part_time_percent string, skill_list string, "
        "titoli_richiesti string, descrizione_uso_interno string, testo_pubblicazione string, richieste_aggiuntive string, requisiti string, isopen int, status string, datelastmodified timestamp_ntz")
    vacancies = jobs.ingest_vacancies(orders, subs, as_of).collect()
    assert [r["joborderid"] for r in vacancies] == [9]
    assert vacancies[0]["description"].startswith("skills richieste: sql | percentuale part time: 50% | titoli di studio richiesti: | descr")


def test_batch_provider_skips_nulls(spark):
    seen = spark.createDataFrame([("a",), (None,)], "p string")
    upper = extraction.batch_provider(lambda ps: [p.upper() for p in ps])
    assert sorted(seen.select(upper(F.col("p"))).toPandas().iloc[:, 0].map(str)) == ["A", "None"]
    assert isinstance(pd.Series(["x"]), pd.Series)
