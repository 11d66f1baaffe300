"""Clearing invalid mailboxes. No job here ever removes a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import filled
from hirelake.operators.keys import lookup
from hirelake.operators.outreach import mail_verdicts
from hirelake.rules import CLEARED_EMAIL_STATES, NO_EMAIL_STATES


def clean_contacts(contacts: DataFrame, mail_domains: DataFrame) -> DataFrame:
    """Contacts with unusable mailboxes set to null; ``cleared`` marks them.

    Null and empty mailboxes are left as they are.
    """
    judged = mail_verdicts(contacts, mail_domains)
    bad = filled("email") & (F.col("verdict") != "ok")
    return judged.withColumn("cleared", bad).withColumn(
        "email", F.when(~bad, F.col("email"))).drop("verdict")


def clean_applications(applications: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Applications with the state after the cleaning; ``changed`` marks updated ones.

    First those whose contact was just cleared, then failed ones without a usable mailbox.
    """
    contact = cleaned.select(F.col("id").alias("_cid"), F.col("cleared").alias("_cleared"),
                             filled("email").alias("_mail"))
    rows = lookup(applications, contact, ["contact_id"], ["_cid"], "id")
    lost = F.coalesce("_cleared", F.lit(False)) & F.col("state").isin(*CLEARED_EMAIL_STATES)
    stuck = F.col("state").isin(*NO_EMAIL_STATES) & ~F.coalesce("_mail", F.lit(False))
    return rows.withColumn("changed", lost | stuck).withColumn(
        "state", F.when(lost | stuck, "No Professional Email").otherwise(F.col("state"))
    ).drop("_cleared", "_mail")


def clean_summary(cleaned_contacts: DataFrame, cleaned_applications: DataFrame) -> DataFrame:
    """Counters of a cleaning: each changed application counts once."""
    c = cleaned_contacts.agg(F.count_if("cleared").alias("n")).scalar()
    return cleaned_applications.agg(F.count_if("changed").alias("updated_applications")).select(
        c.alias("cleared_emails"), "updated_applications")
