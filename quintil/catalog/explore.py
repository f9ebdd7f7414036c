"""Queries of the exploration stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quintil.catalog.base import SURVEY, query, survey, table, tidy, tidy_sql
from quintil.functions.scalar import log_positive
from quintil.operators import classify, explore

W = f"WITH {SURVEY}"
LOG = "CASE WHEN P47T > 0 THEN log10(P47T) END"
DIMENSIONS = ("P09", "P02", "P10", "Region", "AGLOMERADO")


@query("e17_sum_by_category", f"""{W} SELECT dimension, value, CAST(sum(CAST(P47T AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (
  {" UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, P47T FROM survey" for d in DIMENSIONS)}) GROUP BY ALL""")
def e17(spark, sf_dir):
    df = survey(spark, sf_dir).withColumn("P47T", F.col("P47T").cast("decimal(18,2)"))
    return explore.sum_by_category(df, DIMENSIONS).withColumn("total", F.col("total").cast("double"))


def describe_sql(column: str, source: str) -> str:
    return (f"SELECT ANO4, count({column}) AS count, avg({column}) AS mean, stddev_samp({column}) AS std, min({column}) AS min, max({column}) AS max, "
            f"quantile_cont({column}, 0.25) AS p25, quantile_cont({column}, 0.5) AS p50, quantile_cont({column}, 0.75) AS p75 FROM {source} GROUP BY ANO4")


@query("e18_describe_by_year", tidy_sql(f"""{W}, l AS (SELECT ANO4, P47T, {LOG} AS logP47T FROM survey)
  SELECT 'P47T' AS variable, * FROM ({describe_sql("P47T", "l")}) UNION ALL SELECT 'logP47T', * FROM ({describe_sql("logP47T", "l")})
  UNION ALL SELECT 'P47T positive', * FROM ({describe_sql("P47T", "(SELECT * FROM l WHERE P47T > 0)")})""", "mean std min max p25 p50 p75", 5))
def e18(spark, sf_dir):
    df = survey(spark, sf_dir).withColumns({"logP47T": log_positive("P47T"), "P47T positive": F.when(F.col("P47T") > 0, F.col("P47T"))})
    return tidy(explore.describe_columns(df, ["ANO4"], ["P47T", "logP47T", "P47T positive"]).where(F.col("count") > 0), 5)


@query("e19_boxplot_stats", tidy_sql(f"""{W}, f AS (SELECT ANO4, P47T AS x FROM survey WHERE P47T > 0 AND P47T < 1000000),
  q AS (SELECT ANO4, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM f GROUP BY ANO4)
  SELECT ANO4, q1, median, q3, min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
    max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers FROM f JOIN q USING (ANO4) GROUP BY ANO4, q1, median, q3""",
  "q1 median q3 whisker_low whisker_high"))
def e19(spark, sf_dir):
    return tidy(explore.boxplot_stats(explore.plot_filter(survey(spark, sf_dir), "income_boxplot"), "ANO4", "P47T"))


OUT = " UNION ALL ".join(f"""SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM l, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM l)""" for c in ("P47T", "logP47T", "P21"))


@query("e20_iqr_outliers", f"{W}, l AS (SELECT P47T, P21, {LOG} AS logP47T FROM survey) {OUT}")
def e20(spark, sf_dir):
    df = survey(spark, sf_dir).withColumn("logP47T", log_positive("P47T"))
    return explore.iqr_outliers(df, ["P47T", "logP47T", "P21"])


NUMERIC = ("P47T", "P03", "P21", "T_VI", "PROP")
PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@query("e21_pearson_matrix", tidy_sql(f"""{W} {" UNION ALL ".join(f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS correlation FROM survey" for a, b in PAIRS)}""", "correlation"))
def e21(spark, sf_dir):
    return tidy(explore.pearson_matrix(survey(spark, sf_dir), NUMERIC))


def rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


# Every pair is ranked on the rows that have both values.
@query("e22_spearman_pairs", tidy_sql(f"""{W} {" UNION ALL ".join(f"""SELECT '{a}' AS variable_1, '{b}' AS variable_2, abs(corr(x, y)) AS correlation
  FROM (SELECT {rank_sql(a)} AS x, {rank_sql(b)} AS y FROM survey WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in PAIRS)}""", "correlation"))
def e22(spark, sf_dir):
    return tidy(explore.spearman_pairs(survey(spark, sf_dir), NUMERIC))


CATEGORICAL = ("P10", "H10", "H12", "PROP", "CONDACT", "Region")
CAT_PAIRS = [(a, b) for i, a in enumerate(CATEGORICAL) for b in CATEGORICAL[i + 1:]]


def score_sql(a: str, b: str) -> str:
    counts = f"(SELECT {a} AS a, {b} AS b, count(*) AS n FROM survey GROUP BY ALL)"
    return (f"SELECT '{a}' AS A, '{b}' AS B, (SELECT sum(m) / sum(n) FROM (SELECT max(n) AS m, sum(n) AS n FROM {counts} GROUP BY a)) AS pmax_B_given_A, "
            f"(SELECT sum(m) / sum(n) FROM (SELECT max(n) AS m, sum(n) AS n FROM {counts} GROUP BY b)) AS pmax_A_given_B")


SCORES = " UNION ALL ".join(score_sql(a, b) for a, b in CAT_PAIRS)


@query("e23_determinism_score", tidy_sql(f"{W} {SCORES}", "pmax_B_given_A pmax_A_given_B"))
def e23(spark, sf_dir):
    return tidy(explore.determinism_scores(survey(spark, sf_dir), CATEGORICAL))


@query("e24_near_deterministic_pairs", tidy_sql(f"{W} SELECT * FROM ({SCORES}) WHERE pmax_B_given_A >= 0.98 OR pmax_A_given_B >= 0.98", "pmax_B_given_A pmax_A_given_B"))
def e24(spark, sf_dir):
    return tidy(explore.near_deterministic_pairs(survey(spark, sf_dir), CATEGORICAL))


@query("e25_value_counts", f"""{W} {" UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM survey WHERE {c} IS NOT NULL GROUP BY ALL" for c in CATEGORICAL)}""")
def e25(spark, sf_dir):
    return explore.value_counts(survey(spark, sf_dir), CATEGORICAL)


# The classifier takes a person as having income when older than 40; its score is the age.
CLASSIFIED = f"c AS (SELECT INGRESO AS label, CASE WHEN P03 > 40 THEN 1 ELSE 0 END AS prediction, CAST(P03 AS DOUBLE) AS score FROM survey)"


def classified(spark, sf_dir):
    return survey(spark, sf_dir).select(
        F.col("INGRESO").alias("label"), F.when(F.col("P03") > 40, 1).otherwise(0).alias("prediction"), F.col("P03").cast("double").alias("score")
    )


@query("e29_classification_report", tidy_sql(f"""{W}, {CLASSIFIED}, k AS (SELECT 0 AS class UNION ALL SELECT 1),
  s AS (SELECT class, (SELECT count(*) FROM c WHERE label = class AND prediction = class) AS hit, (SELECT count(*) FROM c WHERE label = class) AS support,
    (SELECT count(*) FROM c WHERE prediction = class) AS predicted FROM k),
  p AS (SELECT class, support, hit, coalesce(hit / nullif(CAST(predicted AS DOUBLE), 0), 0) AS precision, coalesce(hit / nullif(CAST(support AS DOUBLE), 0), 0) AS recall FROM s)
  SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support,
    sum(hit) OVER () / CAST(sum(support) OVER () AS DOUBLE) AS accuracy FROM p""", "precision recall f1 accuracy"))
def e29(spark, sf_dir):
    return tidy(classify.classification_report(classified(spark, sf_dir)))


@query("e29_confusion_counts", f"{W}, {CLASSIFIED} SELECT label, prediction, count(*) AS n FROM c GROUP BY ALL")
def e29c(spark, sf_dir):
    return classify.confusion_counts(classified(spark, sf_dir))


@query("e30_roc_auc", tidy_sql(f"""{W}, {CLASSIFIED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM c)
  SELECT (sum(k) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1.0) / 2)
    / (count(*) FILTER (WHERE label = 1) * CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE)) AS auc FROM r""", "auc"))
def e30(spark, sf_dir):
    return tidy(classify.roc_auc(classified(spark, sf_dir)))


@query("e30_roc_auc_documents", tidy_sql("""WITH c AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
  r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM c)
  SELECT (sum(k) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1.0) / 2)
    / (count(*) FILTER (WHERE label = 1) * CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE)) AS auc FROM r""", "auc"))
def e30d(spark, sf_dir):
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return tidy(classify.roc_auc(df, "quality", "n_chars"))
