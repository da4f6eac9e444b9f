"""Scopes and token lifetimes from the roles a user holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lifetimes in seconds.
ACCESS_SECONDS = 30 * 60
ONBOARDING_SECONDS = 24 * 3600
REFRESH_SECONDS = 30 * 24 * 3600


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def role_map(candidate_id: Column | str, recruiter_id: Column | str) -> Column:
    """MAP role -> id of the roles held."""
    both = F.create_map(
        F.lit("candidate"), _col(candidate_id), F.lit("recruiter"), _col(recruiter_id)
    )
    return F.map_filter(both, lambda _, v: v.isNotNull())


def role_scope(
    candidate_id: Column | str, recruiter_id: Column | str, onboarding: Column | str
) -> Column:
    """Space-separated scopes, always in the order candidate, recruiter, onboarding."""
    return F.concat_ws(
        " ",
        F.when(_col(candidate_id).isNotNull(), F.lit("role:candidate")),
        F.when(_col(recruiter_id).isNotNull(), F.lit("role:recruiter")),
        F.when(_col(onboarding), F.lit("role:onboarding")),
    )


def access_lifetime(onboarding: Column | str, override_seconds: int = 0) -> Column:
    """Lifetime of an access token: onboarding wins, then the override, then 30 min."""
    return F.when(_col(onboarding), F.lit(ONBOARDING_SECONDS)).otherwise(
        F.lit(override_seconds or ACCESS_SECONDS)
    )


def refresh_lifetime(override_seconds: int = 0) -> Column:
    return F.lit(override_seconds or REFRESH_SECONDS)
