"""Queries of the dataset stage: scalars, filters, household features, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quintil.catalog.base import SURVEY, people, query, raw_predictions, survey, table, tidy, tidy_sql
from quintil.catalog.base import PREDICTIONS as PRED
from quintil.contract import Contract
from quintil.functions import scalar as S
from quintil.operators import audit, dataset as D, effects, explore, household, order

W = f"WITH {SURVEY}"
KEY = "person_key"
BANDS = ("0-3", "4-8", "9-12", "13-17", "18-24", "25-64", "65+")
BAND_SQL = """CASE WHEN P03 <= 3 THEN '0-3' WHEN P03 <= 8 THEN '4-8' WHEN P03 <= 12 THEN '9-12' WHEN P03 <= 17 THEN '13-17'
  WHEN P03 <= 24 THEN '18-24' WHEN P03 <= 64 THEN '25-64' ELSE '65+' END"""
RECODED = """SELECT person_key, CASE WHEN P10 = 0 THEN 9 ELSE P10 END AS P10,
  CASE WHEN H10 = 0 THEN 1 ELSE H10 END AS H10, CASE WHEN H12 = 0 THEN 9 ELSE H12 END AS H12,
  CASE WHEN PROP = 0 THEN 9 ELSE PROP END AS PROP, CASE WHEN CONDACT = 0 THEN 9 ELSE CONDACT END AS CONDACT FROM survey"""
BAND_COUNTS = ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS \"Personas_{b}\"" for b in BANDS)


# --- B: projections and filters -------------------------------------------------
def by_year(spark, sf_dir):
    """The survey as one frame per year; the two newest carry the drift columns."""
    df = survey(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    years = sorted(r["y"] for r in dates.collect())
    frames = {}
    for year in years:
        frame = df.filter(F.col("ANO4") == year)
        if year in years[-2:]:
            frame = frame.withColumns({c: F.lit(None).cast("double") for c in D.DRIFT_COLUMNS})
        frames[str(year)] = frame
    return frames, [str(y) for y in years[-2:]]


@query("b1_harmonize", f"{W} SELECT CAST(ANO4 AS VARCHAR) AS source_year, count(*) AS n, count(*) FILTER (WHERE INGRESO = 1) AS n_income, "
       "CASE WHEN ANO4 >= (SELECT max(ANO4) - 1 FROM survey) THEN 6 ELSE 0 END AS dropped FROM survey GROUP BY ANO4")
def b1(spark, sf_dir):
    frames, drift = by_year(spark, sf_dir)
    harmonized, drops = D.harmonize(frames, drift_years=drift)
    dropped = F.create_map(*[F.lit(v) for y, c in drops.items() for v in (y, len(c))])
    return (
        D.union_years(harmonized)
        .groupBy("source_year")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("INGRESO") == 1).alias("n_income"))
        .withColumn("dropped", dropped[F.col("source_year")])
    )


@query("b2_tag_year", f"{W} SELECT person_key, '1998' AS source_year FROM survey")
def b2(spark, sf_dir):
    return D.tag_year(survey(spark, sf_dir).select(KEY), "1998")


@query("b3_inclusion_filter", f"{W} SELECT person_key, INGRESO, P47T, PROP FROM survey WHERE INGRESO = 1 AND P47T > 0 AND PROP IS NOT NULL")
def b3(spark, sf_dir):
    return D.include(survey(spark, sf_dir)).select(KEY, "INGRESO", "P47T", "PROP")


@query("b4_construct_target", tidy_sql(f"{W} SELECT person_key, log10(P47T) AS logP47T FROM survey WHERE INGRESO = 1 AND P47T > 0 AND PROP IS NOT NULL", "logP47T"))
def b4(spark, sf_dir):
    return tidy(D.with_target(D.include(survey(spark, sf_dir))).select(KEY, "logP47T"))


def modeling(spark, sf_dir):
    """Modelling table of the survey, rows numbered by year and person."""
    engineered, _ = D.engineer(survey(spark, sf_dir))
    return order.add_row_id(D.select_modeling(D.with_target(D.include(engineered)))[0], ["ANO4", KEY])


MODELING = f"""{W}, r AS (
  SELECT CODUSU, ANO4, TRIMESTRE, AGLOMERADO, Region, INGRESO, P47T, P02, P03, P21, T_VI, person_key,
    CASE WHEN P09 = 0 THEN 'Z_NO_APLICA' ELSE CAST(P09 AS VARCHAR) END AS P09,
    CASE WHEN P10 = 0 THEN 9 ELSE P10 END AS P10, CASE WHEN PROP = 0 THEN 9 ELSE PROP END AS PROP,
    CASE WHEN CONDACT = 0 THEN 9 ELSE CONDACT END AS CONDACT,
    CASE WHEN NOT (CASE WHEN H10 = 0 THEN 1 ELSE H10 END = 1) THEN 0
      WHEN (CASE WHEN H12 = 0 THEN 9 ELSE H12 END) IN (1, 2) THEN 2 ELSE 1 END AS sanitacion_nivel,
    {BAND_SQL} AS band FROM survey),
h AS (SELECT CODUSU, {BAND_COUNTS}, coalesce(max(TRY_CAST(P09 AS DOUBLE)), 0) AS Max_Nivel_Educativo FROM r GROUP BY CODUSU),
modeling AS (
  SELECT row_number() OVER (ORDER BY ANO4, person_key) - 1 AS row_id, log10(P47T) AS logP47T, r.* EXCLUDE (band), h.* EXCLUDE (CODUSU)
  FROM r JOIN h USING (CODUSU) WHERE INGRESO = 1 AND P47T > 0 AND PROP IS NOT NULL)"""
FEATURES = ("ANO4, TRIMESTRE, AGLOMERADO, Region, P02, P03, P09, P10, PROP, CONDACT, person_key, sanitacion_nivel, "
            + ", ".join(f'"Personas_{b}"' for b in BANDS) + ", Max_Nivel_Educativo")


@query("b5_select_modeling_columns", tidy_sql(f"{MODELING} SELECT row_id, logP47T, {FEATURES} FROM modeling", "logP47T"))
def b5(spark, sf_dir):
    return tidy(modeling(spark, sf_dir))


AUDITED = ("CODUSU", "ANO4", "INGRESO", "P47T", "P03", "P21", "T_VI", "PROP")


@query("b6_forbidden_audit", tidy_sql(
    f"""{W} SELECT 'survey' AS "table", g AS leakage_group, c AS "column", v AS non_null_share FROM (
    SELECT 'identifiers' AS g, 'CODUSU' AS c, avg(CAST(CODUSU IS NOT NULL AS INT)) AS v FROM survey
    UNION ALL SELECT 'sample_indicators', 'INGRESO', avg(CAST(INGRESO IS NOT NULL AS INT)) FROM survey
    UNION ALL SELECT 'target', 'P47T', avg(CAST(P47T IS NOT NULL AS INT)) FROM survey
    UNION ALL SELECT 'income_components', 'P21', avg(CAST(P21 IS NOT NULL AS INT)) FROM survey
    UNION ALL SELECT 'income_components', 'T_VI', avg(CAST(T_VI IS NOT NULL AS INT)) FROM survey)""", "non_null_share"))
def b6(spark, sf_dir):
    profile = audit.column_profile(survey(spark, sf_dir).select(*AUDITED)).withColumn("table", F.lit("survey"))
    return tidy(audit.forbidden_audit(profile))


@query("b8_feature_view_drop", f"{W} SELECT person_key, ANO4, TRIMESTRE, P02, P03 FROM survey")
def b8(spark, sf_dir):
    df = survey(spark, sf_dir)
    features = [KEY, "ANO4", "TRIMESTRE", "AGLOMERADO", "Region", "P02", "P03"]
    viewed, kept, _ = effects.apply_view(df, features, "no_geo", ["AGLOMERADO", "Region", "AGLO_rk"])
    return viewed.select(*kept)


@query("b12_range_filters", f"""{W} SELECT name, count(*) AS n, round(sum(CAST(P47T AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM (
  SELECT 'income_boxplot' AS name, P47T FROM survey WHERE P47T > 0 AND P47T < 1000000
  UNION ALL SELECT 'log_boxplot', P47T FROM survey WHERE P47T > 0 AND log10(greatest(P47T, 1e-9)) > 0
  UNION ALL SELECT 'income_histogram', P47T FROM survey WHERE P47T > 0 AND P47T < 50000
  UNION ALL SELECT 'log_regression', P47T FROM survey WHERE P47T > 0 AND log10(greatest(P47T, 1e-9)) < 6) GROUP BY name""")
def b12(spark, sf_dir):
    df = survey(spark, sf_dir).withColumn("logP47T", S.log_positive("P47T"))
    parts = [explore.plot_filter(df, name).select(F.lit(name).alias("name"), "P47T") for name in explore.FILTERS]
    union = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return union.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("P47T").cast("decimal(18,2)")).cast("double").alias("total"))


@query("b13_drop_columns", f"{W} SELECT * EXCLUDE (H10, H12) FROM survey")
def b13(spark, sf_dir):
    return D.drop_source_columns(survey(spark, sf_dir))[0]


# --- C: scalar functions --------------------------------------------------------
@query("c1_recode", f"{W} {RECODED}")
def c1(spark, sf_dir):
    return S.recode(survey(spark, sf_dir)).select(KEY, "P10", "H10", "H12", "PROP", "CONDACT")


@query("c2_recode_total", f"""{W} SELECT person_key, CASE WHEN H10 IN (0, 2) THEN 0 WHEN H10 = 1 THEN 1 END AS H10,
  CASE WHEN H12 IN (0, 3, 4) THEN 0 WHEN H12 IN (1, 2) THEN H12 END AS H12,
  CASE WHEN PROP IN (0, 4, 5) THEN 0 WHEN PROP IN (1, 2, 3) THEN PROP END AS PROP,
  CASE WHEN P10 IN (0, 9) THEN 0 WHEN P10 IN (1, 2) THEN P10 END AS P10,
  CASE WHEN P09 IN (0, 9) THEN 0 WHEN P09 BETWEEN 1 AND 8 THEN P09 END AS P09 FROM survey""")
def c2(spark, sf_dir):
    return S.recode_total(survey(spark, sf_dir)).select(KEY, "H10", "H12", "PROP", "P10", "P09")


@query("c3_stringify_code", f"{W} SELECT person_key, CASE WHEN P09 = 0 THEN 'Z_NO_APLICA' ELSE CAST(P09 AS VARCHAR) END AS P09 FROM survey")
def c3(spark, sf_dir):
    return S.stringify_code(survey(spark, sf_dir)).select(KEY, "P09")


@query("c4_sanitation_level", f"{MODELING} SELECT person_key, sanitacion_nivel FROM r")
def c4(spark, sf_dir):
    return S.recode(survey(spark, sf_dir)).select(KEY, S.sanitation_level().alias("sanitacion_nivel"))


@query("c5_log_components", tidy_sql(f"""{W} SELECT person_key, CASE WHEN P21 > 0 THEN log10(P21) END AS logP21,
  CASE WHEN T_VI > 0 THEN log10(T_VI) END AS "logT_VI" FROM survey""", "logP21 logT_VI"))
def c5(spark, sf_dir):
    return tidy(S.log_components(survey(spark, sf_dir)).select(KEY, "logP21", "logT_VI"))


@query("c6_age_band", f"{W} SELECT person_key, {BAND_SQL} AS band FROM survey")
def c6(spark, sf_dir):
    return survey(spark, sf_dir).select(KEY, S.age_band().alias("band"))


AGE_CUT_SQL = """CASE WHEN P03 > -1 AND P03 <= 17 THEN '-18' WHEN P03 > 17 AND P03 <= 24 THEN '18-25'
  WHEN P03 > 24 AND P03 <= 40 THEN '26-40' WHEN P03 > 40 AND P03 <= 55 THEN '41-55' WHEN P03 > 55 AND P03 <= 100 THEN '55+' END"""


@query("c7_age_group_cut", f"{W} SELECT person_key, {AGE_CUT_SQL} AS age_group FROM survey")
def c7(spark, sf_dir):
    return survey(spark, sf_dir).select(KEY, S.age_group_cut().alias("age_group"))


EDUC_SQL = """CASE WHEN P09 IN (1, 2, 3, 9) THEN 'Baja'
  WHEN P09 IN (4, 5) THEN CASE P10 WHEN 1 THEN 'Media completa' WHEN 2 THEN 'Media incompleta' ELSE 'Desconocido' END
  WHEN P09 IN (6, 7, 8) THEN CASE P10 WHEN 1 THEN 'Superior completa' WHEN 2 THEN 'Superior incompleta' ELSE 'Desconocido' END
  ELSE 'Desconocido' END"""


@query("c8_education_group", f"{W} SELECT person_key, {EDUC_SQL} AS educ_group FROM survey")
def c8(spark, sf_dir):
    return survey(spark, sf_dir).select(KEY, S.education_group().alias("educ_group"))


@query("c9_to_number", """SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE) AS from_props,
  TRY_CAST(event_type AS DOUBLE) AS from_type FROM events""")
def c9(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select(
        "event_id", S.to_number(F.regexp_replace("props", "[^0-9.]", "")).alias("from_props"), S.to_number("event_type").alias("from_type")
    )


@query("c10_fixed_effect_level", f"""{W} SELECT person_key, coalesce(CAST(PROP AS VARCHAR), '<NA>') AS one,
  coalesce(CAST(PROP AS VARCHAR), '<NA>') || '__' || CAST(ANO4 AS VARCHAR) AS two FROM survey""")
def c10(spark, sf_dir):
    return survey(spark, sf_dir).select(KEY, S.level_text("PROP").alias("one"), S.level_text("PROP", "ANO4").alias("two"))


@query("c11_slugify", """SELECT page_id, CASE WHEN t = '' THEN 'run' ELSE t END AS slug FROM (
  SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-') AS t FROM pages)""")
def c11(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.slugify("url").alias("slug"))


@query("c12_errors", tidy_sql(f"{PRED} SELECT model, row_id, residual, abs_error, squared_error FROM with_errors", "residual abs_error squared_error"))
def c12(spark, sf_dir):
    df = S.with_errors(raw_predictions(spark, sf_dir).withColumn("y_pred", F.round("y_pred", 9)))
    return tidy(df.select("model", "row_id", "residual", "abs_error", "squared_error"))


@query("c13_log10_to_pct", tidy_sql(f"{W} SELECT person_key, 100.0 * (power(10.0, P03 / 100.0) - 1.0) AS pct FROM survey", "pct"))
def c13(spark, sf_dir):
    return tidy(survey(spark, sf_dir).select(KEY, S.log10_to_pct(F.col("P03") / 100.0).alias("pct")))


@query("c14_sign_label", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'positive' WHEN c_acctbal < 0 THEN 'negative' ELSE 'zero' END AS sign FROM customer")
def c14(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.sign_label("c_acctbal").alias("sign"))


LABELS = {"cat__CONDACT_2": "cat__CONDACT_Desocupado", "cat__CONDACT_3": "cat__CONDACT_Inactivo"}


@query("c15_label_rename", f"""{W} SELECT person_key, replace(replace(replace(f, 'cat__CONDACT_2', 'cat__CONDACT_Desocupado'),
  'cat__CONDACT_3', 'cat__CONDACT_Inactivo'), 'cat__', '') AS feature FROM (SELECT person_key, 'cat__CONDACT_' || CONDACT AS f FROM survey)""")
def c15(spark, sf_dir):
    df = survey(spark, sf_dir).select(KEY, F.concat(F.lit("cat__CONDACT_"), "CONDACT").alias("feature"))
    return S.rename_labels(df, LABELS).withColumn("feature", S.strip_prefix("feature", "cat__"))


@query("c17_round_n", tidy_sql(f"{W} SELECT Region, round(avg(P47T), 4) AS mean_income FROM survey GROUP BY Region", "mean_income"))
def c17(spark, sf_dir):
    df = survey(spark, sf_dir).groupBy("Region").agg(F.avg("P47T").alias("mean_income"))
    return tidy(S.round_columns(df, ["mean_income"]))


@query("c18_safe_ratio", tidy_sql(f"{W} SELECT person_key, P21 / nullif(P47T, 0) AS ratio FROM survey", "ratio"))
def c18(spark, sf_dir):
    return tidy(survey(spark, sf_dir).select(KEY, S.safe_ratio("P21", "P47T").alias("ratio")))


# --- D, E, F: household and geography -------------------------------------------
HOUSE = f"{W}, b AS (SELECT *, {BAND_SQL} AS band FROM survey), h AS (SELECT CODUSU, {BAND_COUNTS}, coalesce(max(CAST(P09 AS DOUBLE)), 0) AS Max_Nivel_Educativo FROM b GROUP BY CODUSU)"


@query("d2_household_join", f"{HOUSE} SELECT person_key, coalesce(\"Personas_9-12\", 0) AS \"Personas_9-12\" FROM survey LEFT JOIN h USING (CODUSU)")
def d2(spark, sf_dir):
    df = survey(spark, sf_dir).select(KEY, "CODUSU", "P03")
    totals = {"Personas_9-12": household.composition_totals()["Personas_9-12"]}
    return household.attach_totals(df, ["CODUSU"], totals).select(KEY, "Personas_9-12")


@query("e1_household_age_composition", f"{HOUSE} SELECT person_key, h.* EXCLUDE (CODUSU, Max_Nivel_Educativo) FROM survey JOIN h USING (CODUSU)")
def e1(spark, sf_dir):
    return household.household_composition(survey(spark, sf_dir).select(KEY, "CODUSU", "P03")).select(KEY, *household.COMPOSITION)


@query("e2_household_max_education", f"{HOUSE} SELECT person_key, Max_Nivel_Educativo FROM survey JOIN h USING (CODUSU)")
def e2(spark, sf_dir):
    return household.household_education(survey(spark, sf_dir).select(KEY, "CODUSU", "P09")).select(KEY, household.MAX_EDUCATION)


@query("f7_household_window", tidy_sql(f"{W} SELECT person_key, max(P47T) OVER (PARTITION BY CODUSU) AS top_income FROM survey", "top_income"))
def f7(spark, sf_dir):
    df = survey(spark, sf_dir).select(KEY, "CODUSU", "P47T")
    return tidy(household.attach_totals(df, ["CODUSU"], {"top_income": F.max("P47T")}, default=None).select(KEY, "top_income"))


RANKED = """m AS (SELECT ANO4, Region, avg(P47T) AS a FROM survey WHERE P47T > 0 GROUP BY ANO4, Region),
  k AS (SELECT ANO4, Region, round(cume_dist() OVER (PARTITION BY ANO4 ORDER BY a), 3) AS rank FROM m)"""


@query("f5_geo_rank", f"{W}, {RANKED} SELECT * FROM k")
def f5(spark, sf_dir):
    return explore.geo_rank(survey(spark, sf_dir).filter(F.col("P47T") > 0), "ANO4", "Region")


@query("d3_geo_rank_join", f"{W}, {RANKED} SELECT person_key, rank AS Reg_rk FROM survey LEFT JOIN k USING (ANO4, Region)")
def d3(spark, sf_dir):
    df = survey(spark, sf_dir)
    ranks = explore.geo_rank(df.filter(F.col("P47T") > 0), "ANO4", "Region")
    return explore.geo_rank_join(df, ranks, ["ANO4", "Region"], "Reg_rk").select(KEY, "Reg_rk")


# --- A14, L: metadata and audits ------------------------------------------------
@query("a14_dataset_metadata", f"""{W} SELECT count(*) AS row_count_before_filters,
  count(*) FILTER (WHERE INGRESO = 1 AND P47T > 0 AND PROP IS NOT NULL) AS row_count_after_filters, 'logP47T' AS target,
  20 AS feature_count, 6 AS drops_last_year FROM survey""")
def a14(spark, sf_dir):
    frames, drift = by_year(spark, sf_dir)
    harmonized, drops = D.harmonize(frames, drift_years=drift)
    raw = D.union_years(harmonized)
    engineered, facts = D.engineer(raw)
    filtered = D.with_target(D.include(engineered)).withColumn("row_id", F.monotonically_increasing_id())
    dataset, features, excluded = D.select_modeling(filtered)
    meta = D.dataset_metadata(raw, dataset, features, excluded, drops, facts, Contract())
    last = F.size(meta["dropped_columns_by_year"][drift[-1]])
    return meta.select("row_count_before_filters", "row_count_after_filters", "target", "feature_count", last.alias("drops_last_year"))


@query("l1_household_composition_check", tidy_sql(f"""{W}, s AS (SELECT ANO4, count(*) OVER (PARTITION BY CODUSU) AS n,
  count(*) OVER (PARTITION BY CODUSU, ANO4, TRIMESTRE, P02) AS size FROM survey)
  SELECT ANO4, count(*) AS n, count(*) FILTER (WHERE n = size) AS matches, avg(CAST(n = size AS INT)) AS match_rate FROM s GROUP BY ANO4""", "match_rate"))
def l1(spark, sf_dir):
    df = survey(spark, sf_dir).select("CODUSU", "ANO4", "TRIMESTRE", "P02", "P03")
    sized = household.attach_totals(df, ["CODUSU", "ANO4", "TRIMESTRE", "P02"], {"IX_TOT": F.count(F.lit(1))})
    return tidy(audit.household_composition_check(household.household_composition(sized)))


AUDIT_COLUMNS = ("ANO4", "P02", "P03", "PROP", "INGRESO", "P47T", "Region")
AUDIT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{'numeric' if c in ('P03', 'INGRESO', 'P47T') else 'categorical'}' AS role, count(*) AS n,
    avg(CAST({c} IS NULL AS INT)) AS null_rate, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS is_constant,
    (SELECT max(k) FROM (SELECT count(*) AS k FROM survey WHERE {c} IS NOT NULL GROUP BY {c})) >= 0.99 * count({c}) AS near_constant,
    {'true' if c in ('INGRESO', 'P47T') else 'false'} AS forbidden, false AS geo_rank FROM survey""" for c in AUDIT_COLUMNS)


@query("l2_feature_audit", tidy_sql(f"{W} {AUDIT_SQL}", "null_rate"))
def l2(spark, sf_dir):
    return tidy(audit.feature_audit(survey(spark, sf_dir), AUDIT_COLUMNS))


@query("l3_special_code_audit", tidy_sql(f"""{W} SELECT 'P09' AS "column", 0 AS code, count(*) FILTER (WHERE P09 = 0) AS n, avg(CAST(P09 = 0 AS INT)) AS share FROM survey
  UNION ALL SELECT 'H10', 0, count(*) FILTER (WHERE H10 = 0), avg(CAST(H10 = 0 AS INT)) FROM survey
  UNION ALL SELECT 'P10', 9, count(*) FILTER (WHERE P10 = 9), avg(CAST(P10 = 9 AS INT)) FROM survey""", "share"))
def l3(spark, sf_dir):
    return tidy(audit.special_code_audit(survey(spark, sf_dir), {"P09": [0], "H10": [0], "P10": [9], "H15": [31]}))


@query("l4_cardinality_audit", f"""{W}, c AS (SELECT 'AGLOMERADO' AS "column", CAST(AGLOMERADO AS VARCHAR) AS v, count(*) AS c FROM survey GROUP BY ALL
  UNION ALL SELECT 'P03', CAST(P03 AS VARCHAR), count(*) FROM survey GROUP BY ALL)
  SELECT "column", count(*) AS levels, min(c) AS min_rows_per_level, max(c) AS max_rows_per_level,
    count(*) FILTER (WHERE c < 1200) AS rare_levels, "column" = 'AGLOMERADO' AS declared_categorical FROM c GROUP BY "column" """)
def l4(spark, sf_dir):
    return audit.cardinality_audit(survey(spark, sf_dir), ["AGLOMERADO", "P03"], rare_below=1200)


@query("h1_union_years", f"{W} SELECT CAST(ANO4 AS VARCHAR) AS source_year, person_key, CASE WHEN ANO4 = (SELECT max(ANO4) FROM survey) THEN 1 END AS V2_01_M FROM survey")
def h1(spark, sf_dir):
    frames, drift = by_year(spark, sf_dir)
    frames = {y: f.drop(*D.DRIFT_COLUMNS) for y, f in frames.items()}
    frames[drift[-1]] = frames[drift[-1]].withColumn("V2_01_M", F.lit(1))
    return D.union_years(frames).select("source_year", KEY, "V2_01_M")


@query("g0_global_rank", f"{W} SELECT person_key, row_number() OVER (ORDER BY ANO4, person_key) - 1 AS row_id FROM survey")
def g0(spark, sf_dir):
    return order.add_row_id(survey(spark, sf_dir).select("ANO4", KEY), ["ANO4", KEY]).select(KEY, "row_id")


@query("income_by_region_year", tidy_sql(f"{MODELING} SELECT Region, ANO4, count(*) AS n, avg(logP47T) AS mean_log_income, "
       "avg(Max_Nivel_Educativo) AS mean_max_education FROM modeling GROUP BY Region, ANO4", "mean_log_income mean_max_education"))
def income_by_region_year(spark, sf_dir):
    """Flagship: recode, household features, inclusion, target, mean log income."""
    engineered, _ = D.engineer(survey(spark, sf_dir))
    frame = D.with_target(D.include(engineered))
    return tidy(
        frame.groupBy("Region", "ANO4").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("logP47T").alias("mean_log_income"),
            F.avg(household.MAX_EDUCATION).alias("mean_max_education"),
        )
    )
