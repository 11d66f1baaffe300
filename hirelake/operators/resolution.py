"""Keyed get-or-create and entity matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import blank_to_null, slug
from hirelake.operators.keys import dense_ids, first_per, lookup
from hirelake.rules import PLACEHOLDER_NAME, PLACEHOLDER_ROLE, Rules
from hirelake.session import staged


def first_seen(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """First row per key in input order (an order-safe ``dropDuplicates``)."""
    return first_per(df, keys, ordinal)


def _max_id(stored: DataFrame) -> DataFrame:
    return stored.agg(F.max("id"))


def _resolved(stored: DataFrame, wanted: DataFrame, keys: list[str], minor: str | None = None) -> DataFrame:
    """``wanted`` rows with the ``id`` of the stored row of their key, or the next free ids in their order.

    Created rows keep all their columns; of found ones the stored row has the attributes, so theirs
    are null. The one join is written to the shared folder, as numbering reads it twice.
    """
    named = stored.select(*keys, "id").dropna(subset=keys)
    ids = first_per(named, keys, "id").withColumnRenamed("id", "_id")
    order = ["ordinal", *[minor] * bool(minor)]
    kept = [*keys, *order]
    others = [c for c in wanted.columns if c not in (*kept, "id")]
    joined = staged(lookup(wanted, ids, keys, keys, row_id="ordinal"), "wanted")
    existing = joined.where(F.col("_id").isNotNull()).select(
        F.col("_id").alias("id"), *kept, F.lit(False).alias("is_new"),
        *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in others])
    created = dense_ids(joined.where(F.col("_id").isNull()), "ordinal", "id", _max_id(stored), minor)
    return existing.unionByName(created.select("id", *kept, F.lit(True).alias("is_new"), *others))


def upsert_companies(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Get or create by exact name. ``found(ordinal, name, ...)`` -> ``(id, name, ordinal, is_new, ...)``."""
    return _resolved(stored, first_seen(found, ["name"], "ordinal"), ["name"])


def upsert_jobs(stored: DataFrame, found: DataFrame, minor: str | None = None) -> DataFrame:
    """Get or create by url; rows without a url are always created.

    ``found(ordinal, company_id, title, url, ...)`` -> ``(id, url, ordinal, is_new, ...)``. Where one
    ordinal has several rows, ``minor`` orders them.
    """
    found = found.withColumn("url", blank_to_null("url"))
    order = F.struct("ordinal", minor) if minor else "ordinal"
    rest = [c for c in found.columns if c != "url"]
    keyed = first_seen(found.where(F.col("url").isNotNull()), ["url"], order)
    wanted = keyed.select("url", *rest).unionByName(found.where(F.col("url").isNull()).select("url", *rest))
    return _resolved(stored.withColumn("url", blank_to_null("url")), wanted, ["url"], minor)


def upsert_contacts(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Get or create by (company, name) -> ``(id, company_id, name, ordinal, is_new, ...)``."""
    keys = ["company_id", "name"]
    return _resolved(stored, first_seen(found, keys, "ordinal"), keys)


def match_companies(targets: DataFrame, companies: DataFrame) -> DataFrame:
    """Match targets to companies by case-blind name, else by domain, else mark them new.

    Each lookup side is first reduced to one row per key, so a popular name or domain cannot
    multiply rows. Names are compared as text, not as patterns.
    """
    by_name = companies.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("_by_name"))
    by_domain = companies.where(F.col("domain").isNotNull()).groupBy(
        F.col("domain").alias("_domain")).agg(F.min("id").alias("_by_domain"))
    joined = lookup(targets, by_name, [F.lower("name")], ["_name"], "target_id")
    joined = lookup(joined, by_domain, [F.lower("domain")], ["_domain"], "target_id")
    how = F.when(F.col("_by_name").isNotNull(), "name") \
        .when(F.col("_by_domain").isNotNull(), "domain").otherwise("new")
    return joined.select("target_id", F.coalesce("_by_name", "_by_domain").alias("company_id"),
                         how.alias("matched_by"))


def speculative_jobs(companies: DataFrame, jobs: DataFrame, rules: Rules) -> DataFrame:
    """One invented opening per company without jobs, when the rules allow it."""
    if not rules.allow_speculative:
        companies = companies.where(F.lit(False))
    bare = companies.join(jobs.select(F.col("company_id").alias("id")).distinct(), "id", "left_anti")
    return bare.select(
        F.col("id").alias("company_id"),
        F.lit(f"{rules.preferred_role} (Speculative Application)").alias("title"),
        F.concat(F.lit("speculative://"), slug("name")).alias("url"),
        F.lit(rules.preferred_location).alias("location"),
        F.lit(float(rules.max_experience_years)).alias("experience_years_required"))


def placeholder_contacts(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """One stand-in contact per company without contacts."""
    bare = companies.join(
        contacts.select(F.col("company_id").alias("id")).distinct(), "id", "left_anti")
    return bare.select(
        F.col("id").alias("company_id"), F.lit(PLACEHOLDER_NAME).alias("name"),
        F.lit(PLACEHOLDER_ROLE).alias("role"),
        F.concat(F.lit("https://linkedin.com/company/"), F.lower("name")).alias("linkedin_url"))
