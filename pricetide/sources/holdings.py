"""Holdings CSV documents: numbered lines, header check and typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.text import positive_number, strip

# The limits that an upload form sets, and the columns a document must name.
UPLOAD_BYTES = 1_000_000
UPLOAD_ROWS = 5_000
MAX_QUANTITY = 1_000_000.0
REQUIRED = ("cm_product_id", "quantity")


def read_holdings(spark: SparkSession, paths: str | list[str], names: str | None = None) -> DataFrame:
    """One row per uploaded file: portfolio_id (its path) and the CSV text.

    For many files give their folder, and a pattern of their names in `names`: a folder is listed
    at once, but a path with a pattern becomes a path for each file, and each is listed by a task.
    """
    return spark.read.text(paths, wholetext=True, pathGlobFilter=names).select(
        F.col("_metadata.file_path").alias("portfolio_id"), F.col("value").alias("csv")
    )


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ",", -1), strip)


def parse_holdings(
    documents: DataFrame, max_bytes: int | None = None, max_rows: int | None = None
) -> DataFrame:
    """Rows and line errors of CSV documents (portfolio_id, csv).

    Result: portfolio_id, line, error (NULL when valid), cm_product_id,
    variant_key, quantity, cost_basis_eur. A document that breaks a rule yields one
    error on line 1. Size limits hold only where they are given, as an upload form
    gives UPLOAD_BYTES and UPLOAD_ROWS. A byte order mark and white space of any kind
    around the text and its cells are left out.
    """
    text = strip(F.regexp_replace("csv", "^\ufeff", ""))
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s != "")
    docs = documents.select(
        "portfolio_id",
        F.octet_length("csv").alias("bytes"),
        lines.alias("lines"),
    ).withColumn("header", _cells(F.get("lines", F.lit(0))))
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.col("header"))
    problem = (
        F.when(
            F.lit(max_bytes is not None) & (F.col("bytes") > F.lit(max_bytes)),
            "CSV exceeds the 1 MB limit" if max_bytes == UPLOAD_BYTES else f"CSV exceeds the {max_bytes} byte limit",
        )
        .when(F.size("lines") == 0, "CSV is empty")
        .when(
            F.lit(max_rows is not None) & (F.size("lines") - 1 > F.lit(max_rows)),
            f"CSV exceeds the {max_rows} holding limit",
        )
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("Missing required column: "), F.array_join(missing, ", ")),
        )
    )
    docs = docs.withColumn("problem", problem)
    names = ("cm_product_id", "variant_key", "quantity", "cost_basis_eur")
    # Column positions are looked up once per document, cells split once per line.
    for name in names:
        docs = docs.withColumn(f"at_{name}", F.array_position("header", name).cast("int"))
    # A document is read once: it yields its one problem, or its lines.
    valid = F.col("problem").isNull()
    rows = (
        docs.select(
            "portfolio_id",
            "problem",
            *[f"at_{name}" for name in names],
            F.posexplode(F.when(valid, F.col("lines")).otherwise(F.array(F.lit("")))).alias("pos", "text"),
        )
        .filter(~valid | (F.col("pos") > 0))
        .withColumn("cells", F.split("text", ",", -1))
        .select(
            "portfolio_id",
            (F.col("pos") + 1).cast("int").alias("line"),
            F.col("problem").alias("error"),
            *[
                F.when(
                    valid & (F.col(f"at_{name}") > 0), strip(F.get("cells", F.col(f"at_{name}") - 1))
                ).alias(f"{name}_text")
                for name in names
            ],
        )
    )
    pid_number = F.col("cm_product_id_text").try_cast("double")
    typed = rows.select(
        "portfolio_id",
        "line",
        "error",
        F.when((pid_number > 0) & (pid_number == F.floor(pid_number)), pid_number.cast("bigint")).alias(
            "cm_product_id"
        ),
        F.coalesce(F.when(F.col("variant_key_text") != "", F.col("variant_key_text")), F.lit("nonfoil")).alias(
            "variant_key"
        ),
        positive_number(F.col("quantity_text"), MAX_QUANTITY).alias("quantity"),
        positive_number(F.col("cost_basis_eur_text")).alias("cost_basis_eur"),
        (F.coalesce(F.col("cost_basis_eur_text"), F.lit("")) != "").alias("has_cost"),
    )
    row_error = (
        F.when(F.col("cm_product_id").isNull(), "Invalid cm_product_id")
        .when(F.col("quantity").isNull(), "Invalid quantity")
        .when(F.col("has_cost") & F.col("cost_basis_eur").isNull(), "Invalid cost_basis_eur")
    )
    return typed.withColumn("error", F.coalesce("error", row_error)).drop("has_cost")
