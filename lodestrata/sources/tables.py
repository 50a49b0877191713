"""The star schema's tables seen as inputs of the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import as_files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ROWS_OF_TASK = 25_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by a key over tasks of about ROWS_OF_TASK, for texts that are rendered from them.

    A table of short rows is read by few tasks, the texts are many times its size.
    Filters on what is rendered stay in the tasks that render, so that the few do not
    render as well and all uses of a table share one reading.
    """
    out = rows.repartition(-(-rows.count() // ROWS_OF_TASK) or 1, key)
    return out.withColumn(key, F.when(F.monotonically_increasing_id() >= 0, F.col(key)))


def whole(c: Column) -> Column:
    """A number as text."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commits."""
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, folder, "orders").select(F.lit("p").alias("project"), F.col("o_orderkey").alias("commit"), F.col("o_custkey").cast("string").alias("author"), day.alias("ts"))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders as changes of paths."""
    return table(spark, folder, "lineitem").select(
        F.lit("p").alias("project"), F.col("l_orderkey").alias("commit"), F.format_string("src/%05d", F.col("l_partkey")).alias("path"),
        F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"),
    )


def ownership(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers as paths, order states as authors."""
    o = table(spark, folder, "orders")
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    key = [F.lit("p").alias("project"), F.col("o_orderkey").alias("commit")]
    return (
        o.select(*key, F.format_string("src/%05d", F.col("o_custkey")).alias("path"), F.lit(1).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions")),
        o.select(*key, F.col("o_orderstatus").alias("author"), day.alias("ts")),
    )


def imports(spark: SparkSession, folder: str, oriented: bool = False) -> DataFrame:
    """Edges from a supplier to that of the next line of an order; ``oriented``: from that of the earlier nation to the other."""
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")  # noqa: E741
    name = lambda key: F.format_string("s%05d", key)
    rows = l.withColumnRenamed("l_suppkey", "a").join(l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b")), ["l_orderkey", "l_linenumber"]).where("a <> b")
    if oriented:
        s = table(spark, folder, "supplier")
        end = lambda key, nation: s.select(F.col("s_suppkey").alias(key), F.struct(F.col("s_nationkey").alias("n"), name(F.col("s_suppkey")).alias("s")).alias(nation))
        rows = rows.join(end("a", "x"), "a").join(end("b", "y"), "b")
        back = F.col("x.n") > F.col("y.n")
        rows = rows.select("l_orderkey", "l_linenumber", F.when(back, F.col("y.s")).otherwise(F.col("x.s")).alias("src"), F.when(back, F.col("x.s")).otherwise(F.col("y.s")).alias("dst"))
    else:
        rows = rows.withColumn("src", name(F.col("a"))).withColumn("dst", name(F.col("b")))
    return rows.select(F.lit("p").alias("project"), "src", "dst", F.struct("l_orderkey", "l_linenumber").alias("ord"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of their source's project; one without text is an empty file.

    A text's language is no folder of a tree, so none is left out or noise for a name like ``bin`` or ``gen``.
    """
    d = table(spark, folder, "documents")
    path, content = F.format_string("%s/d%08d.md", F.col("lang"), F.col("doc_id")), F.coalesce("text", F.lit(""))
    return d.select(
        F.col("source").alias("project"), path.alias("path"), F.lit("Markdown").alias("language"), F.lit("md").alias("ext"),
        F.octet_length(content).cast("long").alias("size_bytes"), content.alias("content"), F.lit(None).cast("string").alias("noise_reason"),
    )


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    """A source file for each order: an import of the order before, a function with decisions, a comment, a blank."""
    o = dealt(table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c")).where("k is not null"), "k")
    key, before = whole(F.col("k")), whole(F.col("k") - 1)
    most = (F.col("k") % 13).cast("int") + 1
    decisions = ["\n".join(f"  if (a > {i}) {{ b = b + a; }}" for i in range(1, n + 1)) for n in range(1, 14)]
    each = F.array_join(F.transform(F.sequence(F.lit(1), most), lambda i: F.concat(F.lit("  if (a > "), i.cast("string"), F.lit(") { b = b + a; }"))), "\n")
    ifs = F.when(most > 0, F.get(F.lit(decisions), most - 1)).otherwise(each)  # of keys under zero, line by line
    ifs = F.coalesce(ifs, F.lit(""))  # so that no text is rendered to see that it is not null
    content = F.concat(
        F.lit("import { f"), before, F.lit(", unused"), key, F.lit(" } from './o"), before, F.lit("';\n"),
        F.when(F.col("c") % 3 == 0, "// a comment with if (x) and while\n").otherwise(""),
        F.when(F.col("c") % 5 == 0, "\n").otherwise(""),
        F.lit("export function f"), key, F.lit("(a) {\n  let b = f"), before, F.lit("(a) ? 1 : 2;\n"), ifs, F.lit("\n  return b && a;\n}\nconst g"), key, F.lit(" = (x) => x + 1;\n"),
    )
    rest = F.col("c") % 20
    project = F.concat(F.when(rest.between(0, 9), "p0").otherwise("p"), whole(rest))  # as "p%02d" gives it
    return as_files(o.select(project.alias("project"), F.concat(F.lit("src/o"), key, F.lit(".ts")).alias("path"), content.alias("content")))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as saved reports of their customer's project."""
    score = F.least(F.lit(100), F.floor(F.col("o_totalprice") / 4000)).cast("int")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.format_string("c%05d", F.col("o_custkey")).alias("project_path"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at"), score.alias("overall_score"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("{}")).alias("ai_json"),
    )
