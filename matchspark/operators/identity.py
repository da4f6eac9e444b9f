"""Who a sign-in belongs to, which roles that user holds, and what it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.ids import derived_id
from matchspark.functions.names import clean_names
from matchspark.functions.usernames import assign_user_names
from matchspark.operators.ingest import accepted, ingest_users_bulk
from matchspark.operators.lookups import first_recruiter

NOT_FOUND, NO_ROLE, OK, AMBIGUOUS = "not_found", "no_role", "ok", "ambiguous"


def roles_of(users: DataFrame, candidates: DataFrame, recruiters: DataFrame) -> DataFrame:
    """``users`` (user_id, ...) with candidate_id, recruiter_id and recruiter_count."""
    own = candidates.select("user_id", F.col("id").alias("candidate_id"))
    return users.join(own, "user_id", "left").join(first_recruiter(recruiters), "user_id", "left")


def _outcome(user: str = "user_id"):
    return (
        F.when(F.col(user).isNull(), NOT_FOUND)
        .when(F.col("candidate_id").isNull() & F.col("recruiter_id").isNull(), NO_ROLE)
        .otherwise(OK)
    )


def user_by_provider(
    identities: DataFrame, users: DataFrame, candidates: DataFrame, recruiters: DataFrame
) -> DataFrame:
    """(provider, provider_user_id, ...) -> user_id, candidate_id, recruiter_id, outcome.

    Of several recruiters the smallest id counts.
    """
    known = roles_of(
        users.select("provider", "provider_user_id", F.col("id").alias("user_id")),
        candidates,
        recruiters,
    ).drop("recruiter_count")
    return identities.join(known, ["provider", "provider_user_id"], "left").withColumn(
        "outcome", _outcome()
    )


def user_roles(
    requests: DataFrame, users: DataFrame, candidates: DataFrame, recruiters: DataFrame
) -> DataFrame:
    """(user_id, provider) -> candidate_id, recruiter_id, outcome.

    More than one recruiter is an error for that user alone: ``ambiguous``.
    """
    known = roles_of(
        users.select(F.col("id").alias("user_id"), "provider"), candidates, recruiters
    ).withColumn("_known", F.lit(True))
    joined = requests.select("user_id", "provider").join(known, ["user_id", "provider"], "left")
    several = F.col("recruiter_count") > 1
    return joined.select(
        "user_id",
        "provider",
        F.when(~F.coalesce(several, F.lit(False)), F.col("candidate_id")).alias("candidate_id"),
        F.when(~F.coalesce(several, F.lit(False)), F.col("recruiter_id")).alias("recruiter_id"),
        F.when(several, AMBIGUOUS).otherwise(_outcome("_known")).alias("outcome"),
    )


def claims_to_users(claims: DataFrame) -> DataFrame:
    """(provider, claims_json, user_json, ...) -> provider_user_id, email, full_name, error.

    Google: the address must be verified and the name clean.  Apple: the name comes
    from ``user_json`` where that can be read, and is taken as it is.
    """
    options = {"columnNameOfCorruptRecord": "_bad"}
    google = F.from_json(
        "claims_json",
        "sub string, email string, email_verified boolean, name string, given_name string, "
        "family_name string, picture string, _bad string",
        options,
    )
    apple = F.from_json(
        "claims_json",
        "sub string, email string, email_verified string, is_private_email string, _bad string",
        options,
    )
    person = F.from_json(
        "user_json", "name struct<firstName: string, lastName: string>, _bad string", options
    )
    parsed = (
        claims.withColumn("_kinds", _kinds("claims_json"))
        .withColumn("_google", F.when(F.col("provider") == "google", google))
        .withColumn("_apple", F.when(F.col("provider") == "apple", apple))
        .withColumn("_person", F.when(F.col("provider") == "apple", person))
        .withColumn("_raw", F.coalesce("_google.name", F.lit("")))
    )
    parsed = clean_names(parsed, "_raw", "_name", "_fault")

    def text(path: str):
        return F.coalesce(F.col(path), F.lit(""))

    is_google = F.col("provider") == "google"
    # Non-text values in text fields make the claims unreadable.
    apple_bad = F.col("_apple").isNull() | F.col("_apple._bad").isNotNull() | _not_text(
        ["sub", "email", "email_verified", "is_private_email"]
    )
    google_bad = F.col("_google").isNull() | F.col("_google._bad").isNotNull() | _not_text(
        ["sub", "email", "name", "given_name", "family_name", "picture"]
    )
    error = F.when(
        is_google,
        F.when(google_bad, "unreadable_claims")
        .when(~F.coalesce("_google.email_verified", F.lit(False)), "email_not_verified")
        .otherwise(F.concat(F.lit("name_"), F.col("_fault"))),
    ).otherwise(F.when(apple_bad, "unreadable_claims"))
    person_read = F.col("_person").isNotNull() & F.col("_person._bad").isNull()
    apple_name = F.when(
        person_read & (text("user_json") != ""),
        F.concat(text("_person.name.firstName"), F.lit(" "), text("_person.name.lastName")),
    ).otherwise("")
    good = F.col("error").isNull()
    return (
        parsed.withColumn("error", error)
        .withColumn(
            "provider_user_id",
            F.when(good, F.when(is_google, text("_google.sub")).otherwise(text("_apple.sub"))),
        )
        .withColumn(
            "email",
            F.when(good, F.when(is_google, text("_google.email")).otherwise(text("_apple.email"))),
        )
        .withColumn(
            "full_name", F.when(good, F.when(is_google, F.col("_name")).otherwise(apple_name))
        )
        .drop(
            "_kinds", "_google", "_apple", "_person", "_raw", "_name", "_fault", "claims_json", "user_json"
        )
    )


def _kinds(json: str):
    """The kind of every claim, by name, from one parse; NULL if the text is no object."""
    return F.try_variant_get(F.try_parse_json(F.col(json)), "$", "map<string, variant>")


def _not_text(fields: list[str]):
    """True where one of the fields holds a number, a boolean, an array or an object."""
    bad = F.lit(False)
    for name in fields:
        kind = F.schema_of_variant(F.try_element_at("_kinds", F.lit(name)))
        bad = bad | ~F.coalesce(kind, F.lit("VOID")).isin("STRING", "VOID")
    return bad


def signin_outcome(
    sign_ins: DataFrame, users: DataFrame, candidates: DataFrame, recruiters: DataFrame
) -> DataFrame:
    """(seq, provider, provider_user_id) -> user_id, outcome.

    create_user (then onboarding), onboarding (a user without role) or token_pair.
    The first sign-in of an unknown identity creates the user; its later ones find
    a user without role.  First sign-ins are found by counting per identity on the
    map side and joined by ``seq``, so an identity with any number of sign-ins
    stays spread.
    """
    asked = sign_ins.select("seq", "provider", "provider_user_id")
    known = user_by_provider(asked, users, candidates, recruiters)
    firsts = (
        asked.groupBy("provider", "provider_user_id")
        .agg(F.min("seq").alias("seq"))
        .select("seq", F.lit(True).alias("_first"))
    )
    outcome = (
        F.when(F.col("outcome") == OK, "token_pair")
        .when((F.col("outcome") == NOT_FOUND) & F.col("_first"), "create_user")
        .otherwise("onboarding")
    )
    return known.join(firsts, "seq", "left").select(
        "seq", "provider", "provider_user_id", "user_id", outcome.alias("outcome")
    )


def new_users(
    outcomes: DataFrame, claims: DataFrame, users: DataFrame, now: Column, seed: str = ""
) -> DataFrame:
    """The ``users`` rows that sign-ins create, with generated ids and names.

    ``outcomes`` is the result of ``signin_outcome``; ``claims`` (seq, email, full_name) says
    who signed in.  Identities stored meanwhile are left out.
    """
    made = (
        outcomes.filter("outcome = 'create_user'")
        .select("seq", "provider", "provider_user_id")
        .join(claims.select("seq", "email", "full_name"), "seq")
        .withColumn("id", derived_id("usr", now, "provider", "provider_user_id", seed=seed))
    )
    named = assign_user_names(made, "id", users, seed)
    kept = accepted(ingest_users_bulk(users, named))
    return kept.withColumn("updated_at", now).select(*users.columns)


def session_state(jtis: DataFrame, refresh_tokens: DataFrame, now) -> DataFrame:
    """jti -> active, revoked, invalid (unknown or expired) or error (revoked is NULL)."""
    live = refresh_tokens.filter(F.col("expires_at") > now).select(
        "jti", "revoked", F.lit(True).alias("_live")
    )
    state = (
        F.when(F.col("_live").isNull(), "invalid")
        .when(F.col("revoked").isNull(), "error")
        .when(F.col("revoked"), "revoked")
        .otherwise("active")
    )
    return jtis.join(live, "jti", "left").select("jti", state.alias("state"))
