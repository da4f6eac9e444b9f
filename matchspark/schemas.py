"""The nine tables: column types, enum domains, lengths, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Enum domains.
PROVIDERS = ["google", "apple"]
REACTION_TYPES = ["positive", "negative", "neutral"]
REACTOR_TYPES = ["candidate", "recruiter"]
EMBEDDING_STATUSES = ["pending", "failed", "done"]
EMBEDDING_OBJECT_TYPES = ["candidate", "position"]

# Id prefixes.
ID_PREFIXES = {
    "users": "usr",
    "refresh_tokens": "rtk",
    "candidates": "can",
    "recruiters": "rec",
    "positions": "pos",
    "recommendations": "rcm",
}

EMBEDDING_DIMENSION = 1024
SCORE_TYPE = T.DecimalType(3, 2)


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str = "id"


@dataclass(frozen=True)
class Table:
    name: str
    columns: T.StructType
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    enums: dict[str, list[str]] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.columns.fields if not f.nullable]

    @property
    def keys(self) -> list[tuple[str, ...]]:
        return [self.primary_key, *self.unique]


def _struct(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in cols])


_S, _TS = T.StringType(), T.TimestampNTZType()

TABLES: dict[str, Table] = {
    t.name: t
    for t in [
        Table(
            "users",
            _struct(
                ("id", _S, False),
                ("provider", _S, False),
                ("provider_user_id", _S, False),
                ("email", _S, True),
                ("full_name", _S, True),
                ("user_name", _S, True),
                ("updated_at", _TS, False),
            ),
            ("id",),
            (("provider", "provider_user_id"), ("user_name",)),
            {"provider": PROVIDERS},
            {"provider_user_id": 255, "email": 255, "full_name": 255, "user_name": 100},
        ),
        Table(
            "refresh_tokens",
            _struct(
                ("jti", _S, False),
                ("user_id", _S, False),
                ("expires_at", _TS, False),
                ("revoked", T.BooleanType(), True),
            ),
            ("jti",),
            defaults={"revoked": False},
        ),
        Table(
            "candidates",
            _struct(
                ("id", _S, False),
                ("user_id", _S, False),
                ("about", _S, False),
                ("updated_at", _TS, False),
            ),
            ("id",),
            (("user_id",),),
        ),
        Table("recruiters", _struct(("id", _S, False), ("user_id", _S, False)), ("id",)),
        Table(
            "positions",
            _struct(
                ("id", _S, False),
                ("recruiter_id", _S, False),
                ("title", _S, False),
                ("description", _S, False),
                ("company", _S, True),
                ("updated_at", _TS, False),
            ),
            ("id",),
            (("title", "description", "company"),),
        ),
        Table(
            "embeddings",
            _struct(
                ("object_id", _S, False),
                ("object_type", _S, False),
                ("created_at", _TS, False),
                ("updated_at", _TS, False),
                ("embedding", T.ArrayType(T.FloatType()), True),
                ("status", _S, False),
            ),
            ("object_id", "object_type"),
            (),
            {"object_type": EMBEDDING_OBJECT_TYPES, "status": EMBEDDING_STATUSES},
            defaults={"status": "pending"},
        ),
        Table(
            "recommendations",
            _struct(
                ("id", _S, False),
                ("position_id", _S, False),
                ("candidate_id", _S, False),
                ("score", SCORE_TYPE, False),
            ),
            ("id",),
            (("position_id", "candidate_id"),),
        ),
        Table(
            "reactions",
            _struct(
                ("recommendation_id", _S, False),
                ("reactor_type", _S, False),
                ("reactor_id", _S, False),
                ("reaction_type", _S, False),
                ("created_at", _TS, False),
            ),
            ("recommendation_id", "reactor_type", "reactor_id"),
            (),
            {"reactor_type": REACTOR_TYPES, "reaction_type": REACTION_TYPES},
        ),
        Table(
            "matches",
            _struct(
                ("candidate_id", _S, False),
                ("position_id", _S, False),
                ("created_at", _TS, False),
            ),
            ("candidate_id", "position_id"),
        ),
    ]
}

# Every reference deletes its dependents with the parent.  Parents come first,
# so walking the list in order visits a table only after all its parents.
FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("refresh_tokens", "user_id", "users"),
    ForeignKey("candidates", "user_id", "users"),
    ForeignKey("recruiters", "user_id", "users"),
    ForeignKey("positions", "recruiter_id", "recruiters"),
    ForeignKey("recommendations", "position_id", "positions"),
    ForeignKey("recommendations", "candidate_id", "candidates"),
    ForeignKey("matches", "position_id", "positions"),
    ForeignKey("matches", "candidate_id", "candidates"),
    ForeignKey("reactions", "recommendation_id", "recommendations"),
]
