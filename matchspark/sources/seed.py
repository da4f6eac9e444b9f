"""Load seed rows whose parents are named by e-mail address.

The steps run in order, each against the tables as the step before left them: a
row whose parent does not exist yet is not inserted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.ids import derived_id
from matchspark.operators.ingest import accepted, insert_ignore
from matchspark.operators.vectors import enqueue_embeddings
from matchspark.plans.materialize import materialize


@dataclass
class SeedStep:
    """Rows for one table.

    users: provider, provider_user_id, email, full_name, user_name.
    candidates: email, about.  recruiters: email.
    positions: email (of the recruiter's user), title, description, company.
    ``order`` names further columns that give a row's place in the step, unique per row;
    without them rows go by their JSON text, and equal rows are one.
    """

    table: str
    rows: DataFrame
    order: list[str] = field(default_factory=list)


def load_seed(
    tables: dict[str, DataFrame], steps: list[SeedStep], now: Column, seed: str = ""
) -> dict[str, DataFrame]:
    """The tables after the steps; conflicting rows are ignored.

    New candidates and positions are queued for embedding.  ``seed`` must differ
    between loads, as ids derive from it.
    """
    tables = dict(tables)
    for number, step in enumerate(steps):
        new = _resolve(tables, step)
        key = _CONFLICT_KEYS[step.table]
        if key:
            optional = "company" if step.table == "positions" else None
            new = accepted(
                insert_ignore(tables[step.table], new, key, ["_order"], optional=optional)
            )
        new = new.withColumn(
            "id", derived_id(_PREFIX[step.table], now, "_order", seed=f"{seed}/{number}")
        ).withColumn("updated_at", now)
        new = materialize(new.select(*tables[step.table].columns), step.table)
        tables[step.table] = tables[step.table].unionByName(new)
        if step.table in ("candidates", "positions"):
            none = new.select("id").limit(0)
            pending = enqueue_embeddings(
                tables["embeddings"],
                new if step.table == "candidates" else none,
                new if step.table == "positions" else none,
                now,
            )
            tables["embeddings"] = tables["embeddings"].unionByName(
                materialize(pending, "pending")
            )
    return tables


_CONFLICT_KEYS = {
    "users": ["provider", "provider_user_id"],
    "candidates": ["user_id"],
    "recruiters": None,
    "positions": ["title", "description", "company"],
}
_PREFIX = {"users": "usr", "candidates": "can", "recruiters": "rec", "positions": "pos"}


def _resolve(tables: dict[str, DataFrame], step: SeedStep) -> DataFrame:
    """The step's rows with their parent ids, and ``_order`` unique per row."""
    rows = step.rows

    def ordered(rows: DataFrame) -> DataFrame:
        place = F.struct(*step.order) if step.order else F.to_json(F.struct(*rows.columns))
        return rows.withColumn("_order", place)

    if step.table == "users":
        return ordered(rows)
    users = tables["users"].select("email", F.col("id").alias("user_id"))
    rows = rows.join(users, "email").drop("email")
    if step.table == "positions":
        owners = tables["recruiters"].select("user_id", F.col("id").alias("recruiter_id"))
        rows = rows.join(owners, "user_id").drop("user_id")
    return ordered(rows)
