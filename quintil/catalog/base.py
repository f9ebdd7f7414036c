"""Input views over the star-schema tables, in DataFrame and SQL form.

``survey``: one row per line item read as one interviewed person; an order is a
household. ``people``: one row per order, whose key is a unique integer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintil.functions.scalar import with_errors
from quintil.operators.metrics import income_decile
from quintil.operators.splits import with_split
from quintil.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}
DIGITS = 6

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def query(name: str, sql: str | None = None):
    """Register a query under its operator id, with its SQL twin if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; the declared schema saves the footer-reading job."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double; adding zero turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def tidy_sql(sql: str, columns: str, digits: int = DIGITS) -> str:
    """The same rounding for named columns of a SQL query."""
    replaced = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in columns.split())
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # Lines travel twice: to their parts and to their orders. What the lines alone tell is worked out before that where it is
    # smaller than what it is made of, else afterwards: amounts and keys pack badly.
    out_of_sample = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    lines = line.select(
        "l_partkey",
        "l_linenumber",
        F.col("l_orderkey").alias("CODUSU"),
        F.when(out_of_sample, 0).otherwise(1).alias("INGRESO"),
        F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(2).alias("P02"),
        (F.col("l_quantity") * 2).cast("int").alias("P03"),
        F.when(F.col("l_partkey") % 4 == 3, 9).otherwise((F.col("l_partkey") % 4).cast("int")).alias("P10"),
        "l_suppkey",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        F.col("l_shipdate").cast("date").alias("l_shipdate"),
    )
    homes = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            "o_orderkey",
            F.year("o_orderdate").alias("ANO4"),
            F.quarter("o_orderdate").alias("TRIMESTRE"),
            F.col("c_nationkey").alias("AGLOMERADO"),
            F.col("r_name").alias("Region"),
        )
    )
    joined = lines.join(part, lines.l_partkey == part.p_partkey).join(homes, F.col("CODUSU") == F.col("o_orderkey"))
    return joined.select(
        "CODUSU",
        "ANO4",
        "TRIMESTRE",
        "AGLOMERADO",
        "Region",
        "INGRESO",
        F.when(F.col("INGRESO") == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("P47T"),
        "P02",
        "P03",
        F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("l_linenumber")).alias("P09"),
        "P10",
        (F.col("p_size") % 3).alias("H10"),
        (F.col("p_size") % 5).alias("H12"),
        F.when(F.col("p_size") == 50, F.lit(None)).otherwise(F.col("p_size") % 4).alias("PROP"),
        (F.col("p_size") % 4).alias("CONDACT"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice") * F.col("l_discount")).alias("P21"),
        F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice") * F.col("l_tax")).alias("T_VI"),
        F.concat_ws(
            "-", "CODUSU", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), "l_shipdate",
        ).alias("person_key"),
    )


SURVEY = """survey AS (
  SELECT l_orderkey AS CODUSU, year(o_orderdate) AS ANO4, quarter(o_orderdate) AS TRIMESTRE,
    c_nationkey AS AGLOMERADO, r_name AS Region,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 ELSE 1 END AS INGRESO,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0.0 ELSE l_extendedprice END AS P47T,
    CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END AS P02,
    CAST(l_quantity * 2 AS INT) AS P03,
    CASE WHEN p_size % 10 = 0 THEN 0 ELSE l_linenumber END AS P09,
    CASE WHEN l_partkey % 4 = 3 THEN 9 ELSE CAST(l_partkey % 4 AS INT) END AS P10,
    p_size % 3 AS H10, p_size % 5 AS H12,
    CASE WHEN p_size = 50 THEN NULL ELSE p_size % 4 END AS PROP,
    p_size % 4 AS CONDACT,
    CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice * l_discount END AS P21,
    CASE WHEN l_tax = 0 THEN 0.0 ELSE l_extendedprice * l_tax END AS T_VI,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(l_shipdate AS DATE)) AS person_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.log10("o_totalprice").alias("logP47T"),
            F.year("o_orderdate").alias("ANO4"),
            F.quarter("o_orderdate").alias("TRIMESTRE"),
            F.col("c_nationkey").alias("AGLOMERADO"),
            F.col("r_name").alias("Region"),
            F.col("o_orderpriority").alias("CAT_OCUP"),
            (F.col("c_acctbal") / 1000).alias("X1"),
        )
    )


PEOPLE = """people AS (
  SELECT o_orderkey AS row_id, log10(o_totalprice) AS logP47T, year(o_orderdate) AS ANO4,
    quarter(o_orderdate) AS TRIMESTRE, c_nationkey AS AGLOMERADO, r_name AS Region,
    o_orderpriority AS CAT_OCUP, c_acctbal / 1000 AS X1
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SPLITS = """ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id)) - 1 AS pos, count(*) OVER () AS n FROM people),
splits AS (
  SELECT row_id, CASE WHEN pos < round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'train'
    WHEN pos < round_even(n * CAST(0.7 AS DOUBLE), 0) + round_even(n * CAST(0.2 AS DOUBLE), 0) THEN 'test'
    ELSE 'validation' END AS split FROM ranked),
joined AS (SELECT people.*, split FROM people JOIN splits USING (row_id))"""


def split_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(people(spark, sf_dir))


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two closed-form models fitted on train: the mean of a region, and a line on X1."""
    joined = split_people(spark, sf_dir)
    train = joined.filter(F.col("split") == "train")
    means = train.groupBy("Region").agg(F.avg("logP47T").alias("__mean"))
    line = train.agg(F.regr_slope("logP47T", "X1").alias("b"), F.regr_intercept("logP47T", "X1").alias("a")).first()
    scored = joined.filter(F.col("split") != "train").join(means, "Region")
    models = F.array(
        F.struct(F.lit("GroupMean").alias("model"), F.col("__mean").alias("y_pred")),
        F.struct(F.lit("Univariate").alias("model"), (F.lit(line["a"]) + F.lit(line["b"]) * F.col("X1")).alias("y_pred")),
    )
    return scored.select(
        "row_id", "split", "logP47T", "Region", "ANO4", "TRIMESTRE", "CAT_OCUP", "AGLOMERADO", "X1",
        F.explode(models).alias("m"),
    ).select(
        F.lit("run_a").alias("run_id"), "m.model", "split", "row_id", F.col("logP47T").alias("y_true"), "m.y_pred",
        "Region", "ANO4", "TRIMESTRE", "CAT_OCUP", "AGLOMERADO", "X1",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Errors are rounded before they are compared, so that ties are the same in both engines.
    df = with_errors(raw_predictions(spark, sf_dir).withColumn("y_pred", F.round("y_pred", 9)))
    # Deciles read the predictions several times, so they are written first, as a run does.
    return income_decile(settle(df)).select(
        "run_id", "model", "split", "row_id", "y_true", "y_pred", "residual", "abs_error", "squared_error", "income_decile"
    )


PREDICTED = """train AS (SELECT * FROM joined WHERE split = 'train'),
region_mean AS (SELECT Region, avg(logP47T) AS m FROM train GROUP BY Region),
line AS (SELECT regr_slope(logP47T, X1) AS b, regr_intercept(logP47T, X1) AS a FROM train),
scored AS (
  SELECT 'run_a' AS run_id, 'GroupMean' AS model, joined.*, m AS p FROM joined JOIN region_mean USING (Region) WHERE split <> 'train'
  UNION ALL
  SELECT 'run_a', 'Univariate', joined.*, (SELECT a FROM line) + (SELECT b FROM line) * X1 FROM joined WHERE split <> 'train'),
with_errors AS (
  SELECT run_id, model, split, row_id, logP47T AS y_true, round(p, 9) AS y_pred,
    logP47T - round(p, 9) AS residual, abs(logP47T - round(p, 9)) AS abs_error,
    (logP47T - round(p, 9)) * (logP47T - round(p, 9)) AS squared_error,
    Region, ANO4, TRIMESTRE, CAT_OCUP, AGLOMERADO, X1 FROM scored),
edges AS (
  SELECT run_id, model, split, quantile_cont(y_true, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q
  FROM with_errors GROUP BY run_id, model, split),
predictions AS (
  SELECT with_errors.* EXCLUDE (Region, ANO4, TRIMESTRE, CAT_OCUP, AGLOMERADO, X1),
    CASE WHEN len(list_distinct(q)) >= 2
      THEN greatest(1, len(list_distinct(list_filter(q, lambda e: e < y_true)))) END AS income_decile
  FROM with_errors JOIN edges USING (run_id, model, split))"""

PREDICTIONS = f"WITH {PEOPLE}, {SPLITS}, {PREDICTED}"
JOINED = f"WITH {PEOPLE}, {SPLITS}"
