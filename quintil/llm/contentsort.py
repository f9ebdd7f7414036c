"""Exact duplicates by a distributed sort of whole contents, on the JVM alone.

Splitters drawn from a sample range-partition the rows by the beginning of their normalised text and, for texts that
begin alike, by a hash of the whole, so that splitters stay small whatever the length of a text. An external sort inside
each range places equal texts side by side, each is compared in full with its neighbour, and a run of equals keeps one row.

A group of copies with more bytes than a quarter of an average range is cut into pieces by a hash of its identifiers,
which the splitters may separate; at most four such groups a range exist, so their table is broadcast. The pieces' first
rows are compared in full once more and give the group its size and its survivor.

A null text counts as empty. A null identifier stays only where no other does; of rows with the same text and the same
identifier one stays. Rows are never merged: one row comes back for each row of the input, whatever other columns it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quintil.session import settle

HEAD = 24  # characters of a text that take part in a splitter
ROW_BYTES = 16  # what a row weighs besides its text


def mark_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda t: t,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row, and a struct ``rest`` of the columns in ``carry``.

    ``keep`` is ``smallest`` or ``largest``: the identifier that stays of equal texts.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    least, order = (F.min, F.asc_nulls_last) if keep == "smallest" else (F.max, F.desc_nulls_last)
    content = F.coalesce(normalise(docs[text]), F.lit(""))
    rest = [F.struct(*[docs[c] for c in carry]).alias("rest")] if carry else []
    rows = docs.select(docs[key].alias("doc_id"), content.alias("t"), F.xxhash64(content).alias("h"), *rest)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.sum(F.octet_length("t") + F.lit(ROW_BYTES))
    share = max(1, (rows.agg(weight).first()[0] or 0) // (4 * parts))
    sizes = rows.groupBy("h").agg(weight.alias("bytes"), F.count("*").alias("n")).where(f"n > 1 AND bytes > {share}")
    hot = sizes.select("h", F.ceil(F.col("bytes") / share).alias("pieces"))

    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), "pieces"), F.lit(0))
    cut = rows.join(F.broadcast(hot), "h", "left").withColumns({"head": F.substring("t", 1, HEAD), "salt": salt})
    place = ["head", "h", "salt"]
    near = Window.partitionBy(*place).orderBy("t", order("doc_id"))
    fresh = F.coalesce(F.lag("t").over(near) != F.col("t"), F.lit(True))
    compared = cut.repartitionByRange(*place).withColumn("fresh", fresh)
    numbered = compared.withColumn("run", F.sum(F.col("fresh").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    slim = numbered.select(
        *place,
        "run",
        "fresh",
        "doc_id",
        F.sha2("t", 256).alias("text_sha256"),
        F.col("pieces").isNotNull().alias("hot"),
        F.when(F.col("fresh") & F.col("pieces").isNotNull(), F.col("t")).alias("t"),
        *(["rest"] if carry else []),
    )
    run = Window.partitionBy(*place, "run")
    runs = slim.withColumns({"keep_id": least("doc_id").over(run), "group_size": F.count("*").over(run)}).drop("head", "salt", "run")
    runs = settle(runs)

    firsts = runs.where("hot AND fresh").groupBy("t", "h", "text_sha256")
    groups = firsts.agg(least("keep_id").alias("whole_id"), F.sum("group_size").alias("whole_size"))
    joined = runs.drop("t").join(F.broadcast(groups.drop("t")), ["h", "text_sha256"], "left")
    split = F.col("whole_size").isNotNull()
    keep_id = F.when(split, F.col("whole_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("whole_size", "group_size").alias("group_size"),
        (F.col("fresh") & keep_id.eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        *(["rest"] if carry else []),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """The rows that stay, with all their columns as they were."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked = mark_copies(named, place[key], place[text], keep, normalise, tuple(named.columns))
    return marked.where("kept").select("rest.*").toDF(*docs.columns)
