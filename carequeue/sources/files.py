"""Patient files in, tables and files out, and SQL over a registered table."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carequeue.schema import schema_of

#: Header lines that the driver reads at the same time.
HEADERS_AT_ONCE = 16


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a path, a folder or a pattern, without hidden ones."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, folders = [], list(fs.globStatus(fs_path) or [])
    while folders:
        status = folders.pop()
        at = status.getPath()
        if at.getName().startswith(("_", ".")) and len(found) + len(folders):
            continue
        if status.isDirectory():
            folders += [s for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))]
        else:
            found.append(at.toString())
    return sorted(found)


def _headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their header lines; of a file only its first line is read."""
    def names(file: str) -> tuple[str, ...]:
        line = spark.read.option("header", True).option("enforceSchema", False)
        return tuple(line.csv(file).columns)

    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        read = list(pool.map(names, files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(read, files, strict=True):
        groups.setdefault(header, []).append(file)
    return groups


def _csv_groups(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    files = _files(spark, path)
    if not files:
        spark.read.csv(path)  # raises for a missing path
    groups = _headers(spark, files)
    empty = [f for header, group in groups.items() if not header for f in group]
    if empty and len(groups) > 1:
        groups.pop(())  # a file without any line has no rows
    return groups


def _typed_files(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    """Files that hold their types: those of one schema are read together, by name."""
    files = _files(spark, path)
    if not files:
        return spark.read.format(fmt).load(path)  # raises for a missing path
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        schemas = list(pool.map(lambda f: spark.read.format(fmt).load(f).schema, files))
    first: dict[str, tuple[T.DataType, str]] = {}
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for file, schema in zip(files, schemas, strict=True):
        for field in schema.fields:
            kind, where = first.setdefault(field.name, (field.dataType, file))
            if kind != field.dataType:
                raise ValueError(
                    f"column {field.name} is {field.dataType.simpleString()} in {file}"
                    f" and {kind.simpleString()} in {where}"
                )
        groups.setdefault(schema.json(), (schema, []))[1].append(file)
    parts = [spark.read.format(fmt).schema(s).load(group) for s, group in groups.values()]
    return _by_name(parts)


def _by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_patients(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read patients with declared types, from a file, a folder or a pattern.

    For CSV only header lines are read to learn which columns there are; values that do
    not fit their type become NULL (``clashing_values`` finds them). Files may have
    different headers, in any order of columns: files of one header are read together,
    and the parts are united by name, with NULL for what a file does not have. Of files
    that hold their types, such as Parquet, two that give a column unlike types are an
    error that names both. A missing path raises.
    """
    if fmt != "csv":
        return _typed_files(spark, fmt, path)
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return _by_name(
        [
            reader.schema(schema_of(header)).csv(files)
            for header, files in _csv_groups(spark, path).items()
        ]
    )


def clashing_values(spark: SparkSession, path: str) -> DataFrame:
    """Values in CSV files that do not fit the declared type of their column.

    One row per file and column: file, column, type, bad_values, example (the least).
    """
    found = []
    reader = spark.read.option("header", True).option("enforceSchema", False)
    for header, files in _csv_groups(spark, path).items():
        typed = [f for f in schema_of(header).fields if f.dataType != T.StringType()]
        if not typed:
            continue
        text = T.StructType([T.StructField(name, T.StringType()) for name in header])
        bad = [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.when(
                    F.trim(f"`{f.name}`").try_cast(f.dataType).isNull(), F.col(f"`{f.name}`")
                ).alias("value"),
            )
            for f in typed
        ]
        rows = reader.schema(text).csv(files)
        found.append(
            rows.select(F.col("_metadata.file_path").alias("file"), F.inline(F.array(*bad))).where(
                "value is not null"
            )
        )
    if not found:
        return spark.createDataFrame([], "file string, column string, type string, bad_values long, example string")
    return (
        reduce(DataFrame.union, found)
        .groupBy("file", "column", "type")
        .agg(F.count("*").alias("bad_values"), F.min("value").alias("example"))
    )


def save_table(df: DataFrame, table: str = "patient_data", fmt: str = "parquet") -> None:
    """Replace a catalog table, its schema included, also by rows that are read from it.

    The rows are written to a table of their own first, then names are changed. Until
    then the old table stands, and it is all there is to see if writing fails.
    """
    spark = df.sparkSession
    if fmt == "delta":
        df.write.mode("overwrite").format(fmt).option("overwriteSchema", "true").saveAsTable(table)
        return
    tag = uuid.uuid4().hex
    staged, old = f"{table}__new_{tag}", f"{table}__old_{tag}"
    try:
        df.write.format(fmt).saveAsTable(staged)
    except Exception:
        spark.sql(f"drop table if exists {staged}")
        raise
    if not spark.catalog.tableExists(table):
        spark.sql(f"alter table {staged} rename to {table}")
        return
    spark.sql(f"alter table {table} rename to {old}")
    try:
        spark.sql(f"alter table {staged} rename to {table}")
    except Exception:
        spark.sql(f"alter table {old} rename to {table}")
        spark.sql(f"drop table if exists {staged}")
        raise
    spark.sql(f"drop table {old}")
    spark.catalog.refreshTable(table)


def save_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run_sql(df: DataFrame, query: str, view: str = "patients") -> DataFrame:
    """Run SQL text over a table. Errors are raised.

    Where the text names the table in braces, as ``{patients}``, the frame itself is
    passed, and no view is made. A plain name is registered as a view of the session.
    """
    if f"{{{view}}}" in query:
        return df.sparkSession.sql(query, **{view: df})
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(query)
