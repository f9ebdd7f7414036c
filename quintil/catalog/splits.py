"""Queries on splits, samples, folds and permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quintil.catalog.base import JOINED, PEOPLE, SURVEY, people, query, split_people, survey, table, tidy, tidy_sql
from quintil.operators import effects, order, permute, splits

P = f"WITH {PEOPLE}"
W = f"WITH {SURVEY}"


@query("i1_random_split", f"{JOINED} SELECT row_id, split FROM splits")
def i1(spark, sf_dir):
    return splits.random_split(people(spark, sf_dir))


@query("i3_nested_split", f"""{P}, r AS (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id)) - 1 AS pos, count(*) OVER () AS n FROM people),
  c AS (SELECT *, ceil(n * CAST(0.1 AS DOUBLE)) AS held FROM r)
  SELECT row_id, CASE WHEN pos < held THEN 'validation' WHEN pos < held + ceil((n - held) * CAST(2 AS DOUBLE) / 9) THEN 'test' ELSE 'train' END AS split FROM c""")
def i3(spark, sf_dir):
    return splits.nested_split(people(spark, sf_dir))


SAMPLE = f"""{JOINED}, sizes AS (SELECT split, count(*) AS size, sum(count(*)) OVER () AS n FROM joined GROUP BY split),
  q AS (SELECT split, floor(CAST(n AS DOUBLE) * 0.25) AS total, floor(CAST(n AS DOUBLE) * 0.25) * size / n AS share FROM sizes),
  t AS (SELECT split, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, CASE split WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END)
    <= total - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS want FROM q),
  pos AS (SELECT joined.row_id, joined.split, want, row_number() OVER (PARTITION BY joined.split ORDER BY md5('42:' || row_id)) AS rn FROM joined JOIN t USING (split)),
  main AS (SELECT row_id, split FROM pos WHERE rn <= want)"""


@query("i4_stratified_sample", f"{SAMPLE} SELECT row_id, split FROM main")
def i4(spark, sf_dir):
    joined = split_people(spark, sf_dir)
    n = table(spark, sf_dir, "orders").count()
    return splits.stratified_sample(joined, int(n * 0.25)).select("row_id", "split")


@query("d6_extra_pool_anti", f"{SAMPLE} SELECT row_id FROM joined WHERE row_id NOT IN (SELECT row_id FROM main)")
def d6(spark, sf_dir):
    return splits.extra_pool(people(spark, sf_dir), i4(spark, sf_dir)).select("row_id")


@query("i5_training_frame_sample", tidy_sql(f"""{JOINED} SELECT row_id, split, logP47T, Region, X1 FROM joined WHERE split = 'train'
  ORDER BY md5('42:' || row_id) LIMIT 10""", "logP47T X1"))
def i5(spark, sf_dir):
    train = split_people(spark, sf_dir).filter(F.col("split") == "train")
    return tidy(splits.training_sample(train, ["Region", "X1"]))


@query("b10_split_filter", f"{JOINED} SELECT row_id FROM joined WHERE split = 'test'")
def b10(spark, sf_dir):
    joined = split_people(spark, sf_dir)
    splits.require_splits(joined)
    return joined.filter(F.col("split") == "test").select("row_id")


@query("d1_join_splits", tidy_sql(f"{JOINED} SELECT row_id, logP47T, split FROM joined", "logP47T"))
def d1(spark, sf_dir):
    df = people(spark, sf_dir)
    return tidy(splits.join_splits(df, splits.random_split(df)).select("row_id", "logP47T", "split"))


@query("d9_id_reconcile", """SELECT * FROM (SELECT 'missing' AS side, o_orderkey AS row_id FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
  UNION ALL SELECT * FROM (SELECT DISTINCT 'extra' AS side, l_orderkey AS row_id FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def d9(spark, sf_dir):
    """Orders without lines, and lines without an order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return splits.id_reconcile(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id")))


@query("h5_validate_splits", """WITH a AS (SELECT doc_id AS row_id, CASE quality WHEN 1 THEN 'train' ELSE 'holdout' END AS split FROM labels)
  SELECT * FROM (SELECT 'missing' AS problem, CAST(doc_id AS VARCHAR) AS detail FROM documents WHERE doc_id NOT IN (SELECT row_id FROM a))
  UNION ALL SELECT * FROM (SELECT 'extra', CAST(row_id AS VARCHAR) FROM a WHERE row_id NOT IN (SELECT doc_id FROM documents))
  UNION ALL SELECT * FROM (SELECT 'duplicated', CAST(row_id AS VARCHAR) FROM a GROUP BY row_id HAVING count(*) > 1)
  UNION ALL SELECT DISTINCT 'invalid label', split FROM a WHERE split NOT IN ('train', 'test', 'validation')""")
def h5(spark, sf_dir):
    """Labels read as a faulty split table of the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, "train").otherwise("holdout").alias("split")
    )
    return splits.split_problems(docs, marks)


@query("e11_split_proportions", tidy_sql(f"""{JOINED} SELECT s AS split, coalesce((SELECT count(*) FROM splits WHERE split = s) / CAST((SELECT count(*) FROM splits) AS DOUBLE), 0) AS proportion
  FROM (VALUES ('train'), ('test'), ('validation')) v(s)""", "proportion"))
def e11(spark, sf_dir):
    return tidy(splits.split_proportions(splits.random_split(people(spark, sf_dir))))


@query("e12_split_counts", f"{JOINED} SELECT s AS split, (SELECT count(*) FROM splits WHERE split = s) AS n FROM (VALUES ('train'), ('test'), ('validation')) v(s)")
def e12(spark, sf_dir):
    return splits.split_counts(splits.random_split(people(spark, sf_dir)))


@query("f6_kfold", f"{JOINED} SELECT row_id, ntile(3) OVER (ORDER BY row_id) - 1 AS fold FROM joined WHERE split = 'train'")
def f6(spark, sf_dir):
    train = split_people(spark, sf_dir).filter(F.col("split") == "train")
    return splits.kfold(train, 3).select("row_id", "fold")


@query("f6_stratified_kfold", "SELECT doc_id AS row_id, quality, ntile(5) OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS fold FROM labels")
def f6s(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return splits.stratified_kfold(df, 5, "quality")


# --- permutations and effects ---------------------------------------------------
MODE = f"""c AS (SELECT AGLOMERADO, PROP, count(*) AS n FROM survey GROUP BY ALL),
  m AS (SELECT AGLOMERADO, PROP AS value, n_values FROM (SELECT *, count(*) OVER (PARTITION BY AGLOMERADO) AS n_values,
    row_number() OVER (PARTITION BY AGLOMERADO ORDER BY n DESC, coalesce(CAST(PROP AS VARCHAR), '<NA>')) AS k FROM c) WHERE k = 1)"""


@query("e14_group_mode", f"{W}, {MODE} SELECT * FROM m")
def e14(spark, sf_dir):
    return permute.group_mode(survey(spark, sf_dir), "AGLOMERADO", "PROP")


PERMUTED = f"""{MODE}, o AS (SELECT *, row_number() OVER (ORDER BY CAST(AGLOMERADO AS VARCHAR)) AS i,
    row_number() OVER (ORDER BY md5('42:' || AGLOMERADO)) AS j, count(*) OVER () AS n FROM m),
  f AS (SELECT *, CASE WHEN (SELECT bool_and(i = j) FROM o) AND n > 1 THEN j % n + 1 ELSE j END AS slot FROM o),
  x AS (SELECT a.AGLOMERADO, a.value, b.value AS permuted, a.n_values FROM f a JOIN f b ON a.i = b.slot)"""


@query("i6_group_permutation", f"{W}, {PERMUTED} SELECT * FROM x")
def i6(spark, sf_dir):
    return permute.permuted_values(survey(spark, sf_dir), "PROP", "AGLOMERADO")


@query("d4_permuted_join", f"{W}, {PERMUTED} SELECT person_key, permuted AS PROP FROM survey LEFT JOIN x ON survey.AGLOMERADO IS NOT DISTINCT FROM x.AGLOMERADO")
def d4(spark, sf_dir):
    out, _ = permute.group_permutation(survey(spark, sf_dir), "PROP", "AGLOMERADO")
    return out.select("person_key", "PROP")


@query("d4_permuted_join_null_group", f"""{W}, c AS (SELECT PROP, H10, count(*) AS n FROM survey GROUP BY ALL),
  m AS (SELECT PROP, H10 AS value FROM (SELECT *, row_number() OVER (PARTITION BY PROP ORDER BY n DESC, CAST(H10 AS VARCHAR)) AS k FROM c) WHERE k = 1),
  o AS (SELECT *, coalesce(CAST(PROP AS VARCHAR), '<NA>') AS kk FROM m),
  p AS (SELECT *, row_number() OVER (ORDER BY kk) AS i, row_number() OVER (ORDER BY md5('42:' || kk)) AS j, count(*) OVER () AS n FROM o),
  f AS (SELECT *, CASE WHEN (SELECT bool_and(i = j) FROM p) AND n > 1 THEN j % n + 1 ELSE j END AS slot FROM p),
  x AS (SELECT a.PROP, b.value AS permuted FROM f a JOIN f b ON a.i = b.slot)
  SELECT person_key, permuted AS H10 FROM survey LEFT JOIN x ON survey.PROP IS NOT DISTINCT FROM x.PROP""")
def d4n(spark, sf_dir):
    out, _ = permute.group_permutation(survey(spark, sf_dir), "H10", "PROP")
    return out.select("person_key", "H10")


@query("i7_row_permutation", tidy_sql(f"""{P}, a AS (SELECT row_id, logP47T, row_number() OVER (ORDER BY row_id) AS i FROM people),
  b AS (SELECT Region, X1, row_number() OVER (ORDER BY md5('7:' || row_id)) AS i FROM people)
  SELECT row_id, logP47T, Region, X1 FROM a JOIN b USING (i)""", "logP47T X1"))
def i7(spark, sf_dir):
    df = people(spark, sf_dir).select("row_id", "logP47T", "Region", "X1")
    return tidy(permute.row_permutation(df, ["Region", "X1"], 7))


@query("g0_hash_rank", f"{W} SELECT person_key, row_number() OVER (ORDER BY md5('42:' || person_key)) - 1 AS rank FROM survey")
def g0h(spark, sf_dir):
    return order.hash_rank(survey(spark, sf_dir).select("person_key"), "person_key", 42)


@query("e13_level_cap", f"""{W} SELECT 'prop_fe' AS fe_name, count(DISTINCT coalesce(CAST(PROP AS VARCHAR), '<NA>')) AS n_levels, 10 AS max_levels, true AS within_cap FROM survey
  UNION ALL SELECT 'aglo_year_fe', count(DISTINCT AGLOMERADO || '__' || ANO4), 500, true FROM survey
  UNION ALL SELECT 'aglo_fe', count(DISTINCT AGLOMERADO), 10, count(DISTINCT AGLOMERADO) <= 10 FROM survey""")
def e13(spark, sf_dir):
    specs = [
        {"name": "prop_fe", "columns": ["PROP"], "max_levels": 10},
        {"name": "aglo_year_fe", "columns": ["AGLOMERADO", "ANO4"], "max_levels": 500},
    ]
    df, _, facts = effects.apply_fixed_effects(survey(spark, sf_dir), [], specs)
    over = {"fe_name": "aglo_fe", "generated_column": "AGLOMERADO_TEXT", "max_levels": 10}
    df = df.withColumn("AGLOMERADO_TEXT", F.col("AGLOMERADO").cast("string"))
    return effects.level_counts(df, [*facts, over])
