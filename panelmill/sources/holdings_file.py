"""The raw snapshot file: its columns, its catalogue, and how its text is read without losing any of it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.columns import row_sum
from panelmill.functions.hashing import sample_entities
from panelmill.schema import Catalogue, LadderStep, Product

# Columns of the raw file, in file order.
ATTRIBUTE_COLUMNS = (
    "fecha_dato",
    "ncodpers",
    "ind_empleado",
    "pais_residencia",
    "sexo",
    "age",
    "fecha_alta",
    "ind_nuevo",
    "antiguedad",
    "indrel",
    "ult_fec_cli_1t",
    "indrel_1mes",
    "tiprel_1mes",
    "indresi",
    "indext",
    "conyuemp",
    "canal_entrada",
    "indfall",
    "tipodom",
    "cod_prov",
    "nomprov",
    "ind_actividad_cliente",
    "renta",
    "segmento",
)

# Product flags of the raw file with name and family, and the confirmed ladder.
HOLDINGS_CATALOGUE = Catalogue(
    products=(
        Product("ind_ahor_fin_ult1", "Saving account", "savings"),
        Product("ind_aval_fin_ult1", "Guarantees", "other"),
        Product("ind_cco_fin_ult1", "Current account", "core"),
        Product("ind_cder_fin_ult1", "Derivatives account", "investment"),
        Product("ind_cno_fin_ult1", "Payroll account", "core"),
        Product("ind_ctju_fin_ult1", "Junior account", "core"),
        Product("ind_ctma_fin_ult1", "Mas particular account", "core"),
        Product("ind_ctop_fin_ult1", "Particular account", "core"),
        Product("ind_ctpp_fin_ult1", "Particular plus account", "core"),
        Product("ind_deco_fin_ult1", "Short-term deposit", "savings"),
        Product("ind_deme_fin_ult1", "Medium-term deposit", "savings"),
        Product("ind_dela_fin_ult1", "Long-term deposit", "savings"),
        Product("ind_ecue_fin_ult1", "E-account", "digital"),
        Product("ind_fond_fin_ult1", "Funds", "investment"),
        Product("ind_hip_fin_ult1", "Mortgage", "lending"),
        Product("ind_plan_fin_ult1", "Pension plan", "investment"),
        Product("ind_pres_fin_ult1", "Loan", "lending"),
        Product("ind_reca_fin_ult1", "Taxes", "services"),
        Product("ind_tjcr_fin_ult1", "Credit card", "card"),
        Product("ind_valo_fin_ult1", "Securities", "investment"),
        Product("ind_viv_fin_ult1", "Home account", "savings"),
        Product("ind_nomina_ult1", "Payroll", "services"),
        Product("ind_nom_pens_ult1", "Pension payments", "services"),
        Product("ind_recibo_ult1", "Direct debit", "services"),
    ),
    ladder=(
        LadderStep("Current account", ("ind_cco_fin_ult1",)),
        LadderStep("Direct debit", ("ind_recibo_ult1",)),
        LadderStep("Payroll package", ("ind_cno_fin_ult1", "ind_nomina_ult1", "ind_nom_pens_ult1")),
        LadderStep("Credit card", ("ind_tjcr_fin_ult1",)),
    ),
)

# Cells that mean "no value" in a delimited file.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)

DATE_COLUMN, ENTITY_COLUMN = "fecha_dato", "ncodpers"
CORRUPT = "_corrupt_record"


class IngestError(Exception):
    """The file is not what it should be; nothing is loaded."""


def file_schema(catalogue: Catalogue = HOLDINGS_CATALOGUE) -> T.StructType:
    """Attributes as text, only the date, the id and the flags typed."""
    typed: dict[str, T.DataType] = {DATE_COLUMN: T.DateType(), ENTITY_COLUMN: T.LongType()}
    fields = [T.StructField(name, typed.get(name, T.StringType())) for name in ATTRIBUTE_COLUMNS]
    fields += [T.StructField(product.code, T.ByteType()) for product in catalogue.products]
    return T.StructType(fields)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of the file."""
    return spark.read.option("header", True).csv(path).columns


def header_problems(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """Missing and unexpected columns, one row each."""
    found = spark.createDataFrame([(name,) for name in header_of(spark, path)], "column_name string")
    wanted = spark.createDataFrame([(name,) for name in expected], "column_name string")
    sides = found.withColumn("_found", F.lit(True)).join(wanted.withColumn("_wanted", F.lit(True)), "column_name", "full")
    problem = F.when(F.col("_found").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected")
    return sides.select("column_name", problem.alias("problem")).filter("problem IS NOT NULL")


def check_header(spark: SparkSession, path: str, expected: Sequence[str]) -> list[str]:
    """The file's own column order; raises if `header_problems` finds any."""
    problems = header_problems(spark, path, expected).orderBy("problem", "column_name").collect()  # a few names
    if problems:
        raise IngestError("the header does not fit: " + ", ".join(f"{row['problem']} {row['column_name']}" for row in problems))
    return header_of(spark, path)


def read_text(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Every cell as text, plus the whole line where it does not split into the right number of cells.

    `names` is the file's own header order, and every file must have that header. The read stays
    splittable: a line is a row, ended by a line feed with or without a carriage return.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, CORRUPT]])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def null_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells that are exactly one of the no-value tokens become NULL; padded ones stay text."""
    return df.withColumns({name: F.when(~F.col(name).isin(*NULL_TOKENS), F.col(name)) for name in columns})


def _typed(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return column
    value = F.trim(column)
    if isinstance(kind, T.DateType):
        # A cast alone also takes a year, a month, or a date with something after it.
        value = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value)
    return value.try_cast(kind)


def typed_cells(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns of a text table, in schema order. What does not parse becomes NULL; see
    `malformed_cells` for counting that."""
    return text.select(*[_typed(F.col(field.name), field.dataType).alias(field.name) for field in schema.fields])


def malformed_cells(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Cells per typed column that hold something that is not a value of the type, one pass for all."""
    typed = [field for field in schema.fields if not isinstance(field.dataType, T.StringType)]
    bad = {
        field.name: F.col(field.name).isNotNull() & _typed(F.col(field.name), field.dataType).isNull()
        for field in typed
    }
    return text.agg(*[F.count(F.when(wrong, 1)).alias(name) for name, wrong in bad.items()]).unpivot(
        [], list(bad), "column_name", "malformed_cells"
    )


def missing_keys(df: DataFrame, keys: Sequence[str] = (DATE_COLUMN, ENTITY_COLUMN)) -> DataFrame:
    """Rows without one of the keys, counted per key."""
    return df.agg(*[(F.count(F.lit(1)) - F.count(key)).alias(key) for key in keys]).unpivot(
        [], list(keys), "key_name", "missing_rows"
    )


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files without their headers, counted without the CSV parser."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .groupBy(F.col("_metadata.file_path").alias("_file"))
        .agg((F.count(F.lit(1)) - 1).alias("_lines"))
        .agg(F.coalesce(F.sum("_lines"), F.lit(0)).alias("data_lines"))
    )


def row_reconciliation(spark: SparkSession, path: str, parsed: DataFrame) -> DataFrame:
    """Data lines of the files against the rows that parsed whole."""
    # A CSV scan may not be asked for the corrupt-line column alone.
    some_cell = F.struct(parsed.columns[0])
    whole = parsed.agg(F.count(F.when(F.col(CORRUPT).isNull(), some_cell)).alias("parsed_rows"))
    return data_lines(spark, path).withColumn("parsed_rows", whole.scalar())


def period_differences(found: DataFrame, expected: Sequence[str], label: str = "month") -> DataFrame:
    """Periods that are expected but absent, or present but not expected."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(name,) for name in expected], f"{label} string")
    present = found.select(label).distinct()
    absent = wanted.join(present, label, "left_anti").withColumn("problem", F.lit("missing"))
    extra = present.join(wanted, label, "left_anti").withColumn("problem", F.lit("unexpected"))
    return absent.unionByName(extra)


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def expected_months(first: str, last: str) -> list[str]:
    """All month labels from first to last."""
    start, end = (dt.date.fromisoformat(f"{label}-01") for label in (first, last))
    if end < start:
        raise ValueError(f"last month {last} is before first month {first}")
    count = (end.year - start.year) * 12 + end.month - start.month + 1
    numbers = [start.year * 12 + start.month - 1 + step for step in range(count)]
    return [f"{number // 12:04d}-{number % 12 + 1:02d}" for number in numbers]


def load_checked(
    spark: SparkSession,
    path: str,
    catalogue: Catalogue = HOLDINGS_CATALOGUE,
    months: Sequence[str] | None = None,
    sample_share: float | None = None,
) -> tuple[DataFrame, Mapping[str, int]]:
    """The typed snapshot rows of a raw file, after every check. Raises IngestError on the first failure.

    Line count, whole rows, missing keys, malformed cells and months come from one pass over the parsed
    text and one over the raw lines.
    """
    schema = file_schema(catalogue)
    names = check_header(spark, path, schema.fieldNames())
    parsed = read_text(spark, path, names)
    text = null_tokens(parsed, names)
    typed = [field for field in schema.fields if not isinstance(field.dataType, T.StringType)]
    wrong = row_sum(
        [
            (F.col(field.name).isNotNull() & _typed(F.col(field.name), field.dataType).isNull()).cast("bigint")
            for field in typed
        ]
    )
    keyless = reduce(lambda one, other: one | other, [F.col(key).isNull() for key in (DATE_COLUMN, ENTITY_COLUMN)])
    whole = F.col(CORRUPT).isNull()
    facts = text.agg(
        F.count(F.when(whole, 1)).alias("parsed_rows"),
        F.sum(F.when(whole, wrong)).alias("malformed_cells"),
        F.count(F.when(whole & keyless, 1)).alias("missing_keys"),
        F.array_sort(F.collect_set(F.when(whole, month_label(_typed(F.col(DATE_COLUMN), T.DateType()))))).alias(
            "months"
        ),
    ).first()
    lines = data_lines(spark, path).first()["data_lines"]
    if facts["parsed_rows"] != lines:
        raise IngestError(
            f"{lines} data lines but {facts['parsed_rows']} whole rows; a line break inside a cell, "
            "or a truncated file"
        )
    if facts["missing_keys"]:
        raise IngestError(f"{facts['missing_keys']} rows without {DATE_COLUMN} or {ENTITY_COLUMN}")
    if facts["malformed_cells"]:
        raise IngestError(f"{facts['malformed_cells']} typed cells do not parse")
    if months is not None and list(facts["months"]) != list(months):
        raise IngestError(f"expected months {list(months)}, found {list(facts['months'])}")
    # Every line is whole by now, so nothing has to be filtered.
    rows = typed_cells(text, schema).withColumn("month", month_label(F.col(DATE_COLUMN)))
    if sample_share is not None:
        rows = sample_entities(rows, sample_share, ENTITY_COLUMN)
    return rows, {"source_rows": lines, "columns": len(schema.fields)}
