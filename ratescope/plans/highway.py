"""The whole chain for annual files of highway occurrences: read, check, describe, compare, model.

Each step is a composition of the operators. Steps that give many tables settle the few cells they
share, so the occurrence table is read once per step and not once per result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratescope import functions as fx
from ratescope.operators import contrast as ct
from ratescope.operators import (
    cubes,
    drift,
    explain,
    features,
    lifecycle,
    models,
    quality,
    ranking,
    rates,
    runs,
    scores,
    splits,
    statistics,
    tokens,
)
from ratescope.runtime import settle
from ratescope.sources import read_periods, write_table

# The file format, the category lists and their order, and the numbers of the analysis.
PERIOD = "source_year"
FLAG = "target_grave"
COLUMNS = [
    "id",
    "data_inversa",
    "dia_semana",
    "horario",
    "uf",
    "br",
    "km",
    "municipio",
    "causa_acidente",
    "tipo_acidente",
    "classificacao_acidente",
    "fase_dia",
    "sentido_via",
    "condicao_metereologica",
    "tipo_pista",
    "tracado_via",
    "uso_solo",
    "pessoas",
    "mortos",
    "feridos_leves",
    "feridos_graves",
    "ilesos",
    "ignorados",
    "feridos",
    "veiculos",
    "latitude",
    "longitude",
    "regional",
    "delegacia",
    "uop",
]
COUNTS = [
    "pessoas",
    "mortos",
    "feridos_leves",
    "feridos_graves",
    "ilesos",
    "ignorados",
    "feridos",
    "veiculos",
]
DECIMALS = ["km", "latitude", "longitude"]
MONTHS = [
    "Janeiro",
    "Fevereiro",
    "Março",
    "Abril",
    "Maio",
    "Junho",
    "Julho",
    "Agosto",
    "Setembro",
    "Outubro",
    "Novembro",
    "Dezembro",
]
WEEKDAYS = [
    "segunda-feira",
    "terça-feira",
    "quarta-feira",
    "quinta-feira",
    "sexta-feira",
    "sábado",
    "domingo",
]
WEEKDAY_GROUPS = ("Dias úteis", "Fim de semana")
DAY_PHASES = ["Amanhecer", "Pleno dia", "Anoitecer", "Plena Noite"]
REGIONS = {
    "Norte": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "Nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Centro-Oeste": ["DF", "GO", "MT", "MS"],
    "Sudeste": ["ES", "MG", "RJ", "SP"],
    "Sul": ["PR", "RS", "SC"],
}
ROAD_TYPES = ["Simples", "Dupla", "Múltipla"]
LAND_USES = ["Não", "Sim"]
DIRECTIONS = ["Crescente", "Decrescente", "Não Informado"]
WEATHER = [
    "Chuva",
    "Céu Claro",
    "Garoa/Chuvisco",
    "Granizo",
    "Ignorado",
    "Neve",
    "Nevoeiro/Neblina",
    "Nublado",
    "Sol",
    "Vento",
]
LAYOUTS = {
    "Aclive": "tracado_aclive",
    "Curva": "tracado_curva",
    "Declive": "tracado_declive",
    "Desvio Temporário": "tracado_desvio_temporario",
    "Em Obras": "tracado_em_obras",
    "Interseção de Vias": "tracado_intersecao_de_vias",
    "Ponte": "tracado_ponte",
    "Reta": "tracado_reta",
    "Retorno Regulamentado": "tracado_retorno_regulamentado",
    "Rotatória": "tracado_rotatoria",
    "Túnel": "tracado_tunel",
    "Viaduto": "tracado_viaduto",
}
CLASSIFICATIONS = ["Sem Vítimas", "Com Vítimas Feridas", "Com Vítimas Fatais"]
SPECIAL_VALUES = ["Ignorado", "Não Informado"]
SPECIAL_COLUMNS = [
    "sentido_via",
    "condicao_metereologica",
    "classificacao_acidente",
    "regional",
    "delegacia",
    "uop",
]
CATEGORICAL = [
    "dia_semana",
    "uf",
    "municipio",
    "causa_acidente",
    "tipo_acidente",
    "classificacao_acidente",
    "fase_dia",
    "sentido_via",
    "condicao_metereologica",
    "tipo_pista",
    "tracado_via",
    "uso_solo",
    "regional",
    "delegacia",
    "uop",
]
LATITUDES, LONGITUDES = (-35, 6), (-75, -32)
UNKNOWN_ROAD = "Não identificada (BR 0)"
DRIFT_VARIABLES = [
    "month_name",
    "dia_semana",
    "hour",
    "fase_dia",
    "uf",
    "br",
    "municipio",
    "sentido_via",
    "condicao_metereologica",
    "tipo_pista",
    "uso_solo",
    "tipo_acidente",
    "causa_acidente",
    "tracado_via",
    "pessoas",
    "veiculos",
]
PREDICTORS = [
    "month_name",
    "dia_semana",
    "hour",
    "uf",
    "br",
    "km",
    "sentido_via",
    "condicao_metereologica",
    "tipo_pista",
    "uso_solo",
]
FORBIDDEN = [
    "mortos",
    "feridos_graves",
    "feridos_leves",
    "feridos",
    "ilesos",
    "ignorados",
    "classificacao_acidente",
    "regional",
    "delegacia",
    "uop",
    "tipo_acidente",
    "causa_acidente",
    "pessoas",
    "veiculos",
    "horario",
    "fase_dia",
    "municipio",
    "latitude",
    "longitude",
    "tracado_via",
]
CUBES = {
    "temporal": [PERIOD, "dia_semana", "hour"],
    "contextual": [PERIOD, "tipo_pista", "condicao_metereologica", "uso_solo"],
    "geography": [PERIOD, "uf", "br"],
}

ROLES = features.Roles(
    ("id", PERIOD, "data_inversa"), FLAG, (*PREDICTORS, *LAYOUTS.values()), tuple(FORBIDDEN)
)
RECIPE = features.Recipe(
    tuple(p for p in PREDICTORS if p != "km"), ("km",), tuple(LAYOUTS.values())
)


# --- reading and checking --------------------------------------------------------------------


def read_occurrences(spark: SparkSession, files: Mapping[int, str], **reader) -> DataFrame:
    """One file (or folder) per year, typed, with the year and the flag."""
    special = {*COUNTS, *DECIMALS, "id", "br", "data_inversa", "horario"}
    return read_periods(
        spark,
        files,
        COLUMNS,
        PERIOD,
        text=[c for c in COLUMNS if c not in special],
        dates=["data_inversa"],
        times=["horario"],
        integers=COUNTS,
        lenient_integers=["br"],
        decimals=DECIMALS,
        flag_counts=["mortos", "feridos_graves"],
        flag_column=FLAG,
        **reader,
    )


def contract(df: DataFrame, years: Sequence[int]) -> list[quality.Rule]:
    """Column rules and cross-column rules, for ``quality.check_rules``."""
    optional = {"classificacao_acidente", "regional", "delegacia", "uop"}
    domains = {
        "dia_semana": WEEKDAYS,
        "uf": [uf for ufs in REGIONS.values() for uf in ufs],
        "classificacao_acidente": CLASSIFICATIONS,
        "fase_dia": DAY_PHASES,
        "sentido_via": DIRECTIONS,
        "condicao_metereologica": WEATHER,
        "tipo_pista": ROAD_TYPES,
        "uso_solo": LAND_USES,
    }
    at_least_one = {"pessoas", "veiculos"}
    injured = F.col("feridos_leves") + F.col("feridos_graves")
    weekdays = {name: i for i, name in enumerate(WEEKDAYS, start=1)}
    wrong_day = fx.map_strict(weekdays, "dia_semana", "weekday") != fx.iso_weekday("data_inversa")
    return [
        *quality.not_null(*[c for c in (*COLUMNS, PERIOD, FLAG) if c not in optional]),
        *[quality.in_domain(c, values) for c, values in domains.items()],
        *[quality.in_range(c, int(c in at_least_one)) for c in (*COUNTS, "br", "km")],
        quality.in_range("latitude", *LATITUDES),
        quality.in_range("longitude", *LONGITUDES),
        quality.in_range(PERIOD, min(years), max(years)),
        quality.equal("feridos", "sum_of_parts", injured),
        quality.equal(PERIOD, "year_of_date", F.year("data_inversa")),
        quality.equal(FLAG, "definition", fx.any_positive("mortos", "feridos_graves")),
        quality.Rule("dia_semana", "weekday_of_date", wrong_day),
    ]


def audit_tables(df: DataFrame) -> dict[str, DataFrame]:
    people = sum(
        (F.col(c) for c in ("feridos_leves", "feridos_graves", "ilesos", "ignorados")),
        F.col("mortos"),
    )
    injured = F.col("feridos_leves") + F.col("feridos_graves")
    checks = {
        "feridos_identity_failures": F.col("feridos") != injured,
        "pessoas_identity_failures": F.col("pessoas") != people,
        "br_zero": F.col("br") == 0,
        "km_zero": F.col("km") == 0,
        "clima_ignorado": F.col("condicao_metereologica") == "Ignorado",
        "sentido_nao_informado": F.col("sentido_via") == "Não Informado",
    }
    return {
        "audit": quality.audit_run(df, "id", "data_inversa", checks, FLAG, PERIOD),
        "null_counts": quality.null_counts(df),
        "category_cardinality": quality.category_cardinality(df, CATEGORICAL),
        "layout_tokens": quality.distinct_tokens(df, "tracado_via"),
        "duplicate_ids": quality.check_unique(df, ["id"]),
        "data_quality": quality.data_quality_table(df),
        "cardinality": quality.cardinality_table(df, CATEGORICAL),
        "special_categories": quality.special_category_table(df, SPECIAL_COLUMNS, SPECIAL_VALUES),
        "coordinates": quality.coverage_pairs(df, "latitude", "longitude"),
        "fingerprint": quality.dataset_fingerprint(df, "id", FLAG, PERIOD),
    }


def derive(df: DataFrame) -> DataFrame:
    """Month, hour, weekday group, macro-region and labels in one projection."""
    region_of = {uf: region for region, ufs in REGIONS.items() for uf in ufs}
    return df.withColumns(
        {
            "month_number": fx.month_number("data_inversa"),
            "month_name": fx.month_name("data_inversa", MONTHS),
            "hour": fx.time_hour("horario"),
            "weekday_group": fx.weekday_group("dia_semana", WEEKDAYS[:5], WEEKDAY_GROUPS),
            "macroregion": fx.map_strict(region_of, "uf", "state"),
            "municipality_label": fx.place_label("municipio", "uf"),
            "br_label": fx.code_label("br", unknown_label=UNKNOWN_ROAD),
        }
    )


# --- describing ------------------------------------------------------------------------------

DIMENSIONS = {
    "month": "month_name",
    "weekday": "dia_semana",
    "weekday_group": "weekday_group",
    "hour": "hour",
    "day_phase": "fase_dia",
    "macroregion": "macroregion",
    "uf": "uf",
    "br": "br_label",
    "municipality": "municipality_label",
    "road_type": "tipo_pista",
    "land_use": "uso_solo",
    "direction": "sentido_via",
    "weather": "condicao_metereologica",
    "accident_type": "tipo_acidente",
    "cause": "causa_acidente",
    "people": "pessoas",
    "vehicles": "veiculos",
}
ORDERS = {
    "month": MONTHS,
    "weekday": WEEKDAYS,
    "weekday_group": list(WEEKDAY_GROUPS),
    "hour": [str(h) for h in range(24)],
    "day_phase": DAY_PHASES,
    "macroregion": list(REGIONS),
    "road_type": ROAD_TYPES,
    "land_use": LAND_USES,
    "direction": DIRECTIONS,
    "weather": WEATHER,
}
NOT_RANKED = {"br": [UNKNOWN_ROAD], "weather": ["Ignorado"]}
RANKED = ("uf", "br", "municipality", "accident_type", "cause")
TAXONOMIES = {"accident_type": "tipo_acidente", "cause": "causa_acidente"}


def occurrence_cells(df: DataFrame) -> DataFrame:
    """Cells of all dimensions, settled: every descriptive table is a sum over them."""
    return settle(rates.dimension_cells(derive(df), DIMENSIONS, FLAG, PERIOD))


def layout_cells(df: DataFrame) -> DataFrame:
    """Cells of the multi-valued layout field, settled."""
    return settle(
        tokens.token_cells(df, "tracado_via", [PERIOD], FLAG, list(LAYOUTS))
    )


def descriptive_tables(
    df: DataFrame, minimum_rows: int = ranking.MINIMUM_ROWS
) -> dict[str, DataFrame]:
    """Summaries, by-year tables, stability, rankings, lifecycles and layout tables.

    Rate rankings list categories with at least ``minimum_rows`` rows.
    """
    cells = occurrence_cells(df)
    by_year = rates.period_summary(df, FLAG, PERIOD)
    out = {"annual": by_year, "target_stability": rates.rate_range(by_year)}
    for name in DIMENSIONS:
        out[f"{name}_summary"] = rates.summary_from_cells(cells, name, ORDERS.get(name))
        out[f"{name}_by_year"] = rates.by_period_from_cells(cells, name, PERIOD)
    for name in RANKED:
        excluded = {"category": NOT_RANKED.get(name, [])}
        summary = rates.summary_from_cells(cells, name)
        out[f"{name}_top_volume"] = ranking.top_by_volume(summary, "category", excluded=excluded)
        out[f"{name}_top_rate"] = ranking.top_by_rate(
            summary, "category", minimum_rows, excluded=excluded
        )
    out["stability"] = rates.rate_spread(
        cells.withColumns(
            {
                "total": rates.cell_total(),
                "rate_percent": fx.percent("flagged", rates.cell_total()),
            }
        ),
        ["dimension", "category"],
        PERIOD,
    )
    taxonomy_cells = cells.where(F.col("dimension").isin(*TAXONOMIES))
    out["taxonomy_stability"] = lifecycle.stability_from_cells(
        taxonomy_cells, PERIOD, minimum_rows=minimum_rows
    )
    presence = taxonomy_cells.select(
        "dimension", "category", PERIOD, rates.cell_total().alias("rows")
    )
    out["lifecycle"] = lifecycle.lifecycle_of(presence, PERIOD)
    out["taxonomy"] = lifecycle.taxonomy_diagnostics(df, TAXONOMIES, PERIOD)
    out["month_calendar"] = rates.calendar_rate(derive(df), "month_number", FLAG, PERIOD)
    out["eligible"] = ranking.eligible_counts(
        {
            "br": out["br_summary"].where(F.col("category") != UNKNOWN_ROAD),
            "municipality": out["municipality_summary"],
        }
    )
    out["weather_highlights"] = ranking.rate_highlights(
        out["weather_summary"],
        "category",
        minimum_rows,
        {"category": NOT_RANKED["weather"]},
    )
    out["layout_summary"] = tokens.token_rate_summary(df, "tracado_via", FLAG, list(LAYOUTS))
    out["layout_by_year"] = tokens.token_rate_by_period(
        df, "tracado_via", FLAG, PERIOD, list(LAYOUTS)
    )
    out["layout_highlights"] = ranking.rate_highlights(
        out["layout_summary"], "token", minimum_rows
    )
    out["layout_list"] = tokens.token_list(df, "tracado_via", list(LAYOUTS))
    out["count_statistics"] = statistics.numeric_summary_nearest(df, ["pessoas", "veiculos"])
    return out


def association_tables(df: DataFrame, minimum_rows: int = 500) -> dict[str, DataFrame]:
    """The contrasts, their core findings and their consistency over the years."""
    layout = layout_cells(df).where(F.col("token").isNotNull())
    cells = occurrence_cells(df).unionByName(
        layout.select(
            F.lit("layout").alias("dimension"),
            F.col("token").alias("category"),
            PERIOD,
            "flagged",
            "unflagged",
        )
    )
    whole = cells.where(F.col("dimension") == "uf").withColumns(
        {"dimension": F.lit(ct.OVERALL), "category": F.lit("all")}
    )
    summed = whole.groupBy("dimension", "category", PERIOD).agg(
        F.sum("flagged").alias("flagged"), F.sum("unflagged").alias("unflagged")
    )
    evidence = ct.evidence_from_cells(cells.unionByName(summed))
    pick, contrast = ct.Pick, ct.Contrast
    high, low, volume = pick("highest_rate"), pick("lowest_rate"), pick("highest_volume")
    ranked = pick("highest_rate", minimum_rows=minimum_rows)
    lowest_ranked = pick("lowest_rate", minimum_rows=minimum_rows)

    def named(dimension, focal, reference, priority, optional=False):
        other = reference if isinstance(reference, pick) else pick("value", reference)
        return contrast(dimension, pick("value", focal), other, priority, optional)

    known_weather = tuple(NOT_RANKED["weather"])
    matrix = ct.matrix_from_evidence(
        evidence,
        [
            contrast("month", high, low),
            named("weekday_group", "Fim de semana", "Dias úteis", "central"),
            contrast("hour", high, low),
            named("day_phase", "Plena Noite", "Pleno dia", "central"),
            contrast("macroregion", high, low, "central"),
            contrast("uf", high, low, "contextual"),
            named("road_type", "Simples", "Dupla", "central"),
            named("road_type", "Simples", "Múltipla", "secondary"),
            named("land_use", "Não", "Sim", "secondary"),
            contrast(
                "weather",
                pick("highest_rate", minimum_rows=minimum_rows, excluded=known_weather),
                pick("lowest_rate", minimum_rows=minimum_rows, excluded=known_weather),
            ),
            contrast("layout", ranked, lowest_ranked),
            contrast("accident_type", ranked, volume, "central"),
            named("accident_type", "Colisão frontal", volume, "central", True),
            contrast("cause", ranked, volume, "central"),
            named("cause", "Transitar na contramão", volume, "central", True),
            contrast(
                "people",
                pick("largest_value", minimum_rows=minimum_rows),
                pick("smallest_value", minimum_rows=minimum_rows),
            ),
            contrast("vehicles", ranked, pick("smallest_value", minimum_rows=minimum_rows)),
            contrast("weather", pick("value", "Ignorado"), None, "data quality", True),
            contrast("direction", pick("value", "Não Informado"), None, "data quality", True),
            contrast("br", pick("value", UNKNOWN_ROAD), None, "data quality", True),
        ],
        minimum_rows,
        overall=True,
    )
    return {
        "evidence": matrix,
        "core": ct.core_findings(matrix),
        "consistency": ct.consistency(matrix),
    }


def drift_tables(
    df: DataFrame, development: Sequence[int], comparison: Sequence[int]
) -> dict[str, DataFrame]:
    derived = derive(df)
    sides = (list(development), list(comparison), PERIOD)
    return {
        "categorical": drift.categorical_drift(derived, DRIFT_VARIABLES, *sides),
        "new_categories": drift.new_categories(derived, DRIFT_VARIABLES, *sides),
        "numeric": drift.numeric_drift(df, DECIMALS, ["pessoas", "veiculos"], *sides),
        "layout": drift.multilabel_drift(df, "tracado_via", *sides, known=list(LAYOUTS)),
        "annual": drift.annual_profile(
            derived,
            DRIFT_VARIABLES,
            "data_inversa",
            "month_name",
            fx.month_name("data_inversa", MONTHS),
            "horario",
            "hour",
            PERIOD,
        ),
    }


def cube_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The three dashboard cubes from one scan, with their facets."""
    every = settle(cubes.cubes(derive(df), CUBES, FLAG))
    out = {}
    measures = ["total", "flagged", "unflagged", "proportion"]
    for name, dimensions in CUBES.items():
        cells = every.where(F.col("cube") == name).select(*dimensions, *measures)
        out[name] = cubes.sort_cube(cells, dimensions, {"dia_semana": WEEKDAYS})
        out[f"{name}_facets"] = cubes.facet_values(cells, dimensions)
    out["roads_by_state"] = cubes.dependent_facets(out["geography"], "uf", "br")
    return out


# --- modelling -------------------------------------------------------------------------------

FITS = {
    "logistic": models.fit_logistic,
    "random_forest": models.fit_forest,
    "boosted_trees": models.fit_boosted,
}


def model_ready(df: DataFrame) -> DataFrame:
    return features.model_table(derive(df), ROLES, {}, "tracado_via", LAYOUTS)


def design_tables(
    table: DataFrame, development: Sequence[int], final: int
) -> dict[str, DataFrame]:
    folds = splits.expanding_folds(development)
    args = (folds, list(development), final)
    return {
        "checks": splits.check_folds(table, *args, "id", FLAG, PERIOD),
        "partitions": splits.partition_summary(table, *args, FLAG, PERIOD),
        "folds": splits.fold_table(table, folds, FLAG, PERIOD),
        "preprocessing": features.fold_preprocessing_summary(table, RECIPE, folds, PERIOD),
    }


def compare_models(
    table: DataFrame, development: Sequence[int], fits: Mapping[str, models.Fit] = FITS
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Out-of-fold predictions per run (settled) and the comparison tables."""
    folds = splits.expanding_folds(development)
    predictions = {
        name: settle(models.out_of_fold(table, folds, RECIPE, fit, ["id"], FLAG, PERIOD))
        for name, fit in fits.items()
    }
    metrics = {
        name: scores.fold_metrics(p, FLAG, by=["fold"]) for name, p in predictions.items()
    }
    measures = ["rows", "positive_rate", "average_precision", "roc_auc", "brier_score"]
    compared = settle(runs.fold_comparison(metrics, ["fold", *measures]))
    board = runs.leaderboard(compared, [f.fold for f in folds])
    names = list(fits)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return predictions, {
        "fold_comparison": compared,
        "leaderboard": board,
        "pairwise": runs.pairwise_deltas(board, pairs, [f.fold for f in folds]),
        "stability": runs.metric_stability(compared),
        "fold_deltas": runs.fold_deltas(compared),
        "comparable": runs.comparable_runs(compared, ["rows", "positive_rate"]),
        "best": runs.select_best(
            board,
            metrics=compared,
            stability=runs.metric_stability(compared),
            deltas=runs.pairwise_deltas(board, pairs, [f.fold for f in folds]),
        ),
    }


def evaluate_final(
    table: DataFrame, development: Sequence[int], final: int, out_of_fold: DataFrame, fit, path: str
) -> dict[str, DataFrame]:
    """Threshold from the out-of-fold scores, refit, score the final year, interpret boosted trees."""
    chosen = scores.best_f1_threshold(out_of_fold, FLAG)
    threshold = chosen.first()["threshold"]
    model = models.refit_all_development(table, development, RECIPE, fit, path, FLAG, PERIOD)
    held = settle(models.score_holdout(path, table, final, threshold, ["id"], FLAG, PERIOD))

    def metrics(predictions: DataFrame) -> DataFrame:
        curve = scores.score_curve(scores.score_cells(predictions, FLAG))
        return scores.probability_metrics(curve)

    by_fold = scores.fold_metrics(out_of_fold, FLAG, by=["fold"]).withColumn("run", F.lit("chosen"))
    thresholds = scores.threshold_table(
        out_of_fold, {"selected": threshold, "reference": 0.5}, FLAG, "score", ["selected"], PERIOD
    )
    frozen = scores.threshold_table(held, {"frozen": threshold}, FLAG, "score", (), PERIOD)
    final_metrics = metrics(held)
    out = {
        "threshold": chosen,
        "thresholds": thresholds,
        "final_metrics": final_metrics,
        "final_threshold": frozen,
        "calibration": scores.calibration_table(held, FLAG),
        "development_vs_final": runs.development_comparison(
            runs.run_summary(by_fold),
            thresholds.where(F.col(PERIOD).isNull() & (F.col("threshold_role") == "selected")),
            final_metrics,
            frozen,
        ),
        "outcomes": scores.outcome_profile(held, FLAG),
        "predictions": held,
    }
    if hasattr(model.stages[-1], "treeWeights"):
        rows = table.where(F.col(PERIOD) == final)
        named = features.feature_map(model.transform(rows), RECIPE)
        decided = settle(explain.tree_contributions(model, rows, ["id", FLAG])).withColumn(
            "decision", fx.at_least("score", threshold)
        )
        ranking_table = explain.contribution_ranking(decided, named)
        out |= {
            "contribution_errors": explain.contribution_errors(decided),
            "features": explain.feature_ranking(decided, named),
            "predictors": ranking_table,
            "top_predictors": explain.top_features(ranking_table),
            "by_outcome": explain.contribution_by_outcome(decided, named, FLAG),
        }
    return out


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as CSV in a folder of its own."""
    for name, table in tables.items():
        write_table(table, f"{folder.rstrip('/')}/{name}")
