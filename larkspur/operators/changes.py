"""Changes of keyed tables as new snapshots: updates, deletes, renames, retention.

Tables are immutable: each operator gives the table after the change, and
``save`` writes it to a folder of its own. Nothing is changed in place, so a job
that is run again after a failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``base`` and the new rows; columns that these lack are null."""
    return base.unionByName(rows, allowMissingColumns=True)


def update(base: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns of the rows that meet a condition; null conditions don't."""
    hit = F.coalesce(where, F.lit(False))
    return base.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns))


def update_from(base: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of the rows with a partner in ``source`` (one for each key) are taken from it, nulls too."""
    new = source.select(*keys, F.struct(*columns).alias("_new"))
    both = base.join(new, keys, "left")
    take = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c)
    return both.select(*(take(c) if c in columns else F.col(c) for c in base.columns))


def update_latest(base: DataFrame, rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The latest row of each key of ``rows`` gets its ``columns``; keys that ``base`` lacks are added."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    new = rows.select(*keys, F.struct(*columns).alias("_new"))
    numbered = base.withColumn("_k", F.row_number().over(newest)).join(new, keys, "left")
    hit = (F.col("_k") == 1) & F.col("_new").isNotNull()
    kept = numbered.select(*(F.when(hit, F.col("_new").getField(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))
    return append(kept, rows.join(base.select(*keys), keys, "left_anti"))


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str, references: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows that refer to a deleted key; ``references`` names the column of each."""
    out = {}
    for name, df in tables.items():
        column = references.get(name, key)
        out[name] = df.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return out


def rename_keys(base: DataFrame, names: DataFrame, key: str, referring: list[DataFrame]) -> DataFrame:
    """``base`` with its keys renamed by ``names`` (old, new); an error if another table refers to an old one or a new one is taken."""
    for other in referring:
        if other.join(names, other[key] == names["old"], "left_semi").limit(1).count():
            raise ValueError(f"other rows refer to a renamed {key}")
    renamed = base.join(F.broadcast(names) if _few(names) else names, base[key] == names["old"], "left").select(*(F.coalesce(F.col("new"), base[key]).alias(key) if c == key else base[c] for c in base.columns))
    unique(renamed, [key])
    return renamed


def _few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a small frame is small enough to send to every task."""
    return df.limit(most + 1).count() <= most


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame; an error if two of its rows have equal keys."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not unique: {tuple(twice[0])[:-1]}")
    return df


def affected(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """(updated, inserted): how many rows of ``delta`` ``upsert`` writes over and adds."""
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True))
    both = delta.join(known, keys, "left")
    return both.agg(F.count_if(F.col("_known")).alias("updated"), F.count_if(F.col("_known").isNull()).alias("inserted"))


def keep_min_id(df: DataFrame, keys: list[str], id: str) -> DataFrame:  # noqa: A002
    """Of rows with equal keys the one with the least id."""
    return df.withColumn("_least", F.min(id).over(Window.partitionBy(*keys))).where(F.col(id) == F.col("_least")).drop("_least")


def retained(files: DataFrame, key: str, name: str, time: str, dropped: tuple[str, ...] = (".pdf", ".html", ".htm", ".txt", ".json")) -> DataFrame:
    """Adds ``kept``: the newest document of each key, and files that are neither documents nor news."""
    low = F.lower(F.col(name))
    artifact = low.startswith("news")
    for end in dropped:
        artifact = artifact | low.endswith(end)
    newest = Window.partitionBy(key).orderBy(low.endswith(".pdf").desc(), F.desc(time), name)
    return files.withColumn("_k", F.row_number().over(newest)).withColumn("kept", ~artifact | (low.endswith(".pdf") & (F.col("_k") == 1))).drop("_k")


def free_names(files: DataFrame, folder: str, name: str, order: list[str]) -> DataFrame:
    """Adds ``target``: the name, or with ``_1``, ``_2``, ... before its end where an earlier file of the folder has it."""
    k = F.row_number().over(Window.partitionBy(folder, name).orderBy(*order)) - 1
    stem = F.regexp_replace(F.col(name), r"(?i)\.pdf$", "")
    return files.withColumn("target", F.when(k == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), F.lit(".pdf"))))


def differences(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(op, key columns, before, after) of rows that differ between two snapshots with the same columns: insert, update, delete.

    Rows are compared whole, nulls being equal; null keys are keys. Each side has a key once.
    """
    rest = [c for c in new.columns if c not in keys]
    side = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct(*rest).alias(name))
    a, b = side(old, "before"), side(new, "after")
    on = [a[f"before_{k}"].eqNullSafe(b[f"after_{k}"]) for k in keys]
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    both = a.join(b, on, "full").withColumn("op", op).where(F.col("op").isNotNull())
    return both.select("op", *(F.when(F.col("after").isNull(), F.col(f"before_{k}")).otherwise(F.col(f"after_{k}")).alias(k) for k in keys), "before", "after")


def save(df: DataFrame, folder: str) -> None:
    """A snapshot in a folder that must not be there yet: readers of the old one aren't disturbed."""
    df.write.mode("errorifexists").parquet(folder)


#: Quotes are doubled, as other programs read them; blanks at the ends of a text stay, empty texts are ``""`` and nulls nothing.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export(df: DataFrame, folder: str) -> None:
    """CSV with a header, which ``exported`` and other programs read back as it was."""
    df.write.mode("errorifexists").options(**CSV).csv(folder)


def exported(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows that ``export`` has written; texts may go over several lines. A row that doesn't fit the schema is an error."""
    # A null value of its own tells fields without anything from empty texts in quotes.
    return spark.read.schema(schema).options(**CSV, nullValue="\0", emptyValue="").option("multiLine", True).option("mode", "FAILFAST").csv(folder)
