"""Cascading deletes and audits over the declared keys, references and domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.plans.materialize import materialize
from matchspark.schemas import EMBEDDING_DIMENSION, FOREIGN_KEYS, TABLES


def cascade_delete(
    tables: dict[str, DataFrame], deleted: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """The tables with ``removed``: true where deleting the rows in ``deleted`` takes the row.

    ``deleted`` maps a table to the primary keys of its rows to delete.  Writing a result
    partitioned by ``removed`` gives the new snapshot and what went in one pass.

    Tables are visited parents first.  The removed ids of a table with dependents
    are written out: several joins read them, and their file size lets Spark
    broadcast them only where they are small.
    """
    parents_with_children = {fk.parent for fk in FOREIGN_KEYS}
    removed_ids: dict[str, DataFrame] = {}
    result: dict[str, DataFrame] = {}
    alone = {name: tables[name] for name in deleted if name in tables}
    for name, table in (in_dependency_order(tables) | alone).items():
        edges = [
            ([fk.column], removed_ids[fk.parent].withColumnRenamed("id", fk.column))
            for fk in FOREIGN_KEYS
            if fk.child == name and fk.parent in removed_ids
        ]
        if name in deleted:
            key = list(TABLES[name].primary_key)
            edges.append((key, deleted[name].select(*key).distinct()))
        flagged = table
        hit = F.lit(False)
        for i, (columns, ids) in enumerate(edges):
            gone = ids.select(*columns, F.lit(True).alias(f"_gone{i}"))
            flagged = flagged.join(gone, columns, "left")
            hit = hit | F.col(f"_gone{i}").isNotNull()
        result[name] = flagged.select(*table.columns, hit.alias("removed"))
        if edges and name in parents_with_children:
            removed_ids[name] = materialize(
                result[name].filter("removed").select("id"), f"removed-{name}"
            )
    return result


def in_dependency_order(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Parents before children."""
    order = ["users", *dict.fromkeys(fk.child for fk in FOREIGN_KEYS)]
    return {name: tables[name] for name in order if name in tables}


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, column, parent, missing_keys, orphan_rows) per reference.

    Children are counted per key before the join, so a key with any number of
    children is one row in it.  Embeddings have no declared reference and are
    reported per object type.
    """
    edges = [
        (fk.child, fk.column, fk.parent, tables[fk.child].select(F.col(fk.column).alias("key")))
        for fk in FOREIGN_KEYS
        if fk.child in tables and fk.parent in tables
    ]
    if "embeddings" in tables:
        edges += [
            (
                "embeddings",
                "object_id",
                parent,
                tables["embeddings"]
                .filter(F.col("object_type") == kind)
                .select(F.col("object_id").alias("key")),
            )
            for kind, parent in [("candidate", "candidates"), ("position", "positions")]
            if parent in tables
        ]
    parts = []
    for child, column, parent, keys in edges:
        known = tables[parent].select(F.col("id").alias("key"))
        counted = keys.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"))
        parts.append(
            counted.join(known, "key", "left_anti")
            .agg(
                F.count("*").alias("missing_keys"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
            )
            .select(
                F.lit(child).alias("child"),
                F.lit(column).alias("column"),
                F.lit(parent).alias("parent"),
                "missing_keys",
                "orphan_rows",
            )
        )
    return union_all(parts)


def audit_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, key, duplicate_keys, surplus_rows) per key; a NULL part never conflicts."""
    parts = []
    for name, df in tables.items():
        for key in TABLES[name].keys:
            if not set(key) <= set(df.columns):
                continue
            counted = df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n"))
            parts.append(
                counted.filter("n > 1")
                .agg(
                    F.count("*").alias("duplicate_keys"),
                    F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
                )
                .select(
                    F.lit(name).alias("table"),
                    F.lit(", ".join(key)).alias("key"),
                    "duplicate_keys",
                    "surplus_rows",
                )
            )
    return union_all(parts)


def domain_violations(name: str, df: DataFrame, dimension: int = EMBEDDING_DIMENSION) -> Column:
    """Array of struct(column, rule) a row of the table breaks."""
    table = TABLES[name]
    tests: list[tuple[str, str, Column]] = []
    for f in table.columns.fields:
        if f.name not in df.columns:
            continue
        c = F.col(f.name)
        if not f.nullable:
            tests.append((f.name, "not_null", c.isNull()))
        if f.name in table.enums:
            tests.append((f.name, "domain", ~c.isin(table.enums[f.name])))
        if f.name in table.max_length:
            tests.append((f.name, "length", F.length(c) > table.max_length[f.name]))
        if isinstance(f.dataType, T.DecimalType):
            tests.append((f.name, "range", (c < 0) | (c > 1)))
        if isinstance(f.dataType, T.ArrayType):
            tests.append((f.name, "dimension", F.size(c) != dimension))
    return F.array_compact(
        F.array(
            *[
                F.when(bad, F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule")))
                for column, rule, bad in tests
            ]
        )
    )


def audit_domains(
    tables: dict[str, DataFrame], dimension: int = EMBEDDING_DIMENSION
) -> DataFrame:
    """(table, column, rule, rows) of every broken rule, one scan per table."""
    return union_all(
        [
            df.select(F.inline(domain_violations(name, df, dimension)))
            .groupBy("column", "rule")
            .agg(F.count("*").alias("rows"))
            .select(F.lit(name).alias("table"), "column", "rule", "rows")
            for name, df in tables.items()
        ]
    )
