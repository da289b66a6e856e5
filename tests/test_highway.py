"""The whole chain on generated annual files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ratescope.operators import models, quality, rates
from ratescope.plans import highway as hw
from ratescope.runtime import scratch_path

YEARS = [2021, 2022, 2023, 2024, 2025]
STATES = [uf for ufs in hw.REGIONS.values() for uf in ufs]


def pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


@pytest.fixture(scope="module")
def files(spark):
    """4,000 occurrences in text form; night, a simple road and two layouts raise the flag."""
    i = F.col("id")
    h = F.abs(F.hash("id"))
    day = F.date_add(F.lit("2021-01-01").cast("date"), ((h % 1826)).cast("int"))
    night = (h % 24 < 6)
    risk = night.cast("int") * 25 + (h % 3 == 0).cast("int") * 20 + (h % 7 == 0).cast("int") * 15 + 10
    grave = (F.abs(F.hash(i + 7)) % 100 < risk).cast("int")
    light = (h % 2).cast("int")
    safe = (h % 3 + 1).cast("int")
    layout = F.concat(pick(list(hw.LAYOUTS), h % 12), F.when(h % 5 == 0, F.concat(F.lit("; Reta;"), pick(list(hw.LAYOUTS), h % 12))).otherwise(""))
    text = {
        "id": i.cast("string"),
        "data_inversa": F.date_format(day, "yyyy-MM-dd"),
        "dia_semana": pick(hw.WEEKDAYS, F.weekday(day)),
        "horario": F.format_string("%02d:%02d:00", (h % 24).cast("int"), (h % 60).cast("int")),
        "uf": pick(STATES, h),
        "br": F.when(h % 50 == 0, "0").otherwise((h % 9 * 101 + 1).cast("string")),
        "km": F.regexp_replace(((h % 3000) / 10).cast("string"), r"\.", ","),
        "municipio": F.concat(F.lit(" CIDADE "), (h % 40).cast("string"), F.lit(" ")),
        "causa_acidente": pick(["Velocidade", "Transitar na contramão", "Chuva", "Outra"], h),
        "tipo_acidente": F.when((F.year(day) > 2022) & (h % 6 == 0), "Engavetamento").otherwise(pick(["Colisão frontal", "Tombamento", "Colisão traseira"], h)),
        "classificacao_acidente": F.when(h % 30 == 0, "NA").otherwise("Com Vítimas Feridas"),
        "fase_dia": F.when(night, "Plena Noite").otherwise(pick(hw.DAY_PHASES[:3], h)),
        "sentido_via": pick(hw.DIRECTIONS, h),
        "condicao_metereologica": pick(hw.WEATHER, h),
        "tipo_pista": pick(hw.ROAD_TYPES, h),
        "tracado_via": layout,
        "uso_solo": pick(hw.LAND_USES, h),
        "pessoas": (grave + light + safe).cast("string"),
        "mortos": F.lit("0"),
        "feridos_leves": light.cast("string"),
        "feridos_graves": grave.cast("string"),
        "ilesos": safe.cast("string"),
        "ignorados": F.lit("0"),
        "feridos": (grave + light).cast("string"),
        "veiculos": (h % 4 + 1).cast("string"),
        "latitude": F.concat(F.lit("-"), (h % 30).cast("string"), F.lit(",5")),
        "longitude": F.concat(F.lit("-"), (h % 40 + 33).cast("string"), F.lit(",25")),
        "regional": F.lit("REG"),
        "delegacia": F.lit("DEL"),
        "uop": F.lit("UOP"),
    }
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = scratch_path(spark, "files")
    raw = spark.range(4_000).select(F.year(day).alias("year"), *[c.alias(n) for n, c in text.items()])
    raw.write.option("sep", ";").option("header", True).option("encoding", "windows-1252").partitionBy("year").csv(path)
    return {y: f"{path}/year={y}" for y in YEARS}


@pytest.fixture(scope="module")
def df(spark, files):
    return hw.read_occurrences(spark, files).cache()


def test_files_keep_their_contract(df):
    assert df.count() == 4_000
    quality.assert_rules(df, hw.contract(df, YEARS))
    broken = df.withColumn("feridos", F.col("feridos") + 1).withColumn("km", -F.col("km") - 1)
    with pytest.raises(ValueError, match="km range: 4000.*feridos sum_of_parts: 4000"):
        quality.assert_rules(broken, hw.contract(broken, YEARS))


def test_audit(df):
    tables = {n: t.collect() for n, t in hw.audit_tables(df).items()}
    combined = [r for r in tables["audit"] if r[hw.PERIOD] is None][0]
    assert combined["rows"] == 4_000 and combined["duplicated_rows"] == 0
    assert combined["feridos_identity_failures"] == combined["pessoas_identity_failures"] == 0
    assert [r["column"] for r in tables["null_counts"]] == ["classificacao_acidente"]
    assert {r["token"] for r in tables["layout_tokens"]} == set(hw.LAYOUTS)


@pytest.fixture(scope="module")
def described(df):
    return hw.descriptive_tables(df, minimum_rows=2)


def test_descriptions_agree_with_single_summaries(df, described, rows):
    derived = hw.derive(df)
    for name in ("month", "uf", "municipality", "people"):
        direct = rates.rate_summary(derived, hw.DIMENSIONS[name], hw.FLAG)
        direct = direct.select(F.col(hw.DIMENSIONS[name]).cast("string").alias("category"), *direct.columns[1:])
        assert rows(described[f"{name}_summary"], *direct.columns) == rows(direct)
    assert [r["category"] for r in described["weekday_summary"].collect()] == hw.WEEKDAYS
    assert described["hour_summary"].count() == 24


def test_every_description_runs(described):
    for name, table in described.items():
        assert table.collect(), name
    assert hw.UNKNOWN_ROAD not in {r["category"] for r in described["br_top_volume"].collect()}
    life = {r["category"]: r for r in described["lifecycle"].collect()}
    assert life["Engavetamento"]["appears_later"] and life["Engavetamento"]["first_period"] == 2023


def test_associations(df):
    tables = hw.association_tables(df, minimum_rows=2)
    matrix = tables["evidence"].collect()
    names = [r["dimension"] for r in matrix]
    assert names.count("road_type") == 2 and "overall" in names and "layout" in names
    weekend = [r for r in matrix if r["dimension"] == "day_phase"][0]
    assert weekend["comparison"] == "Plena Noite vs Pleno dia"
    assert weekend["rate_percent"] > weekend["reference_rate_percent"]
    overall = [r for r in matrix if r["dimension"] == "overall"][0]
    assert overall["total"] == 4_000 and overall["periods_observed"] == 5
    assert len({(r["dimension"], r["comparison"]) for r in matrix}) == len(matrix)
    gaps = [r["difference_points"] for r in tables["core"].collect()]
    assert gaps == sorted(gaps, reverse=True)
    assert tables["consistency"].where("priority = 'data quality'").count() == 0


def test_drift(df):
    tables = {n: t.collect() for n, t in hw.drift_tables(df, YEARS[:4], YEARS[4:]).items()}
    assert len(tables["categorical"]) == len(hw.DRIFT_VARIABLES)
    assert {r["variable"] for r in tables["numeric"]} == {*hw.DECIMALS, "pessoas", "veiculos"}
    assert len(tables["layout"]) == 12
    dates = [r for r in tables["annual"] if r["variable"] == "data_inversa"]
    assert len(dates) == 5 and all(r["covered_months"] == 12 for r in dates)
    assert sum(r["consistent_rows"] for r in dates) == 4_000


def test_cubes(df):
    tables = hw.cube_tables(df)
    for name in hw.CUBES:
        assert tables[name].agg(F.sum("total")).first()[0] == 4_000
    days = [r["dia_semana"] for r in tables["temporal"].where("source_year = 2021").collect()]
    assert days == sorted(days, key=hw.WEEKDAYS.index)


def test_modelling(spark, df):
    table = hw.model_ready(df).cache()
    assert tuple(table.columns) == hw.ROLES.columns and not set(table.columns) & set(hw.FORBIDDEN)
    design = {n: t.collect() for n, t in hw.design_tables(table, YEARS[:4], 2025).items()}
    assert all(r["violations"] == 0 for r in design["checks"])
    assert [r["fold"] for r in sorted(design["folds"])] == [1, 2, 3]
    fits = {
        "logistic": models.fit_logistic,
        "boosted_trees": lambda t, r, f: models.fit_boosted(t, r, f, rounds=6, rate=0.3, depth=3),
    }
    predictions, compared = hw.compare_models(table, YEARS[:4], fits)
    board = {r["run"]: r for r in compared["leaderboard"].collect()}
    base = df.agg(F.avg(F.col(hw.FLAG).cast("double"))).first()[0]
    assert set(board) == set(fits) and all(r["ap_mean"] > base for r in board.values())
    assert all(r["agrees"] for r in compared["comparable"].collect())
    out = hw.evaluate_final(
        table, YEARS[:4], 2025, predictions["boosted_trees"], fits["boosted_trees"], scratch_path(spark, "final")
    )
    final_rows = df.where("source_year = 2025").count()
    assert out["final_metrics"].first()["rows"] == final_rows
    confusion = out["final_threshold"].first()
    assert confusion["tn"] + confusion["fp"] + confusion["fn"] + confusion["tp"] == final_rows
    assert sum(r["rows"] for r in out["outcomes"].collect()) == final_rows
    assert out["contribution_errors"].first()["maximum_error"] < 1e-6
    assert sum(r["share"] for r in out["predictors"].collect()) == pytest.approx(1.0)
    assert out["development_vs_final"].count() == 7
    folder = scratch_path(spark, "tables")
    hw.write_tables({"metrics": out["final_metrics"], "calibration": out["calibration"]}, folder)
    assert spark.read.option("header", True).csv(f"{folder}/calibration").count() == out["calibration"].count()
