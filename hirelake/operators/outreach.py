"""Contact validation and ranking: mail checks, best contact, duplicate guard, e-mail conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.mail import (
    company_domain,
    first_sound_mailbox,
    mail_domain,
    mailbox_guesses,
    mailbox_ok,
)
from hirelake.functions.text import filled, strip
from hirelake.operators.keys import first_per, lookup
from hirelake.rules import CONTACTED, Rules


def accepting(mail_domains: DataFrame) -> DataFrame:
    """The distinct domains of ``(domain, accepts_mail)`` that take mail, in lower case."""
    return mail_domains.where("accepts_mail").select(F.lower(strip("domain")).alias("domain")).distinct()


def with_mail_flag(df: DataFrame, domain: Column, mail_domains: DataFrame, row_id: str,
                   flag: str = "mail_ok") -> DataFrame:
    """Add whether ``domain`` accepts mail, by a table ``(domain, accepts_mail)``.

    Spark broadcasts the domain table only under its own size limit; beyond it the lookup shuffles,
    rows without a domain are spread, and a popular domain is split.
    """
    known = accepting(mail_domains).select(F.col("domain").alias("_mx"), F.lit(True).alias("_known"))
    joined = lookup(df, known, [domain], ["_mx"], row_id)
    return joined.withColumn(flag, F.coalesce("_known", F.lit(False))).drop("_known")


def mail_verdicts(contacts: DataFrame, mail_domains: DataFrame) -> DataFrame:
    """``(id, email, verdict)``: empty, syntax, domain or ok, tested in that order."""
    domain = F.when(mailbox_ok("email"), mail_domain("email"))
    flagged = with_mail_flag(contacts, domain, mail_domains, "id")
    verdict = F.when(~filled("email"), "empty").when(~mailbox_ok("email"), "syntax") \
        .when(~F.col("mail_ok"), "domain").otherwise("ok")
    return flagged.withColumn("verdict", verdict).drop("mail_ok")


def mail_capable(contacts: DataFrame, mail_domains: DataFrame) -> DataFrame:
    """Contacts whose mailbox domain accepts mail."""
    known = accepting(mail_domains)
    located = contacts.where(filled("email")).withColumn("domain", mail_domain("email"))
    return lookup(located, known, ["domain"], ["domain"], how="left_semi")


def with_company_domain(contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Contacts with their company's stored or guessed domain."""
    domains = companies.select(
        F.col("id").alias("company_id"), company_domain("domain", "name").alias("domain"))
    return contacts.join(domains, "company_id")


def with_guesses(contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Contacts with all their mailbox guesses."""
    return with_company_domain(contacts, companies).withColumn(
        "guesses", mailbox_guesses("name", "domain"))


def first_valid_mailbox(contacts: DataFrame, companies: DataFrame, mail_domains: DataFrame,
                        answers: DataFrame | None = None) -> DataFrame:
    """First acceptable mailbox per contact, null when there is none: the one found for it, else a guess.

    ``answers(contact_id, answer)`` may be of any domain. All guesses of a contact share one domain, so of them only the
    first sound one is a candidate; the one or two candidates are checked by one join and the first that passes is picked.
    """
    located = with_company_domain(contacts, companies)
    guess = F.struct(F.lit(1).alias("pos"), first_sound_mailbox("name", "domain").alias("mailbox"),
                     F.lower(strip("domain")).alias("at"))
    tried = F.array(guess)
    if answers is not None:
        found = answers.select(F.col("contact_id").alias("_for"), strip("answer").alias("_answer"))
        located = located.join(found, F.col("id") == F.col("_for"), "left").drop("_for")
        sound = F.when(mailbox_ok("_answer"), F.struct(F.lit(0).alias("pos"), F.col("_answer").alias("mailbox"),
                                                       mail_domain("_answer").alias("at")))
        tried = F.array(sound, guess)
    rows = located.select("id", F.explode(F.array_compact(tried)).alias("t")).select("id", "t.*")
    flagged = with_mail_flag(rows.where(F.col("mailbox").isNotNull()), F.col("at"), mail_domains, "id")
    picked = flagged.where("mail_ok").groupBy("id").agg(F.min_by("mailbox", "pos").alias("mailbox"))
    return located.drop("_answer").join(picked, "id", "left")


def role_rank(role: str, rules: Rules) -> Column:
    """Position of the first priority term contained in the role; unlisted roles come last."""
    lowered = F.coalesce(F.lower(F.col(role)), F.lit(""))
    rank = F.lit(len(rules.role_priority))
    for i, term in reversed(list(enumerate(rules.role_priority))):
        rank = F.when(lowered.contains(term), i).otherwise(rank)
    return rank


def best_contacts(contacts: DataFrame, rules: Rules, ordinal: str = "id") -> DataFrame:
    """Best contact per company by role priority, ties by input order.

    An aggregate over ``(rank, ordinal)``, not a window: one company may own most contacts.
    """
    ranked = contacts.withColumn("rank", role_rank("role", rules))
    return first_per(ranked, ["company_id"], F.struct("rank", ordinal))


def guarded_companies(contacts: DataFrame, applications: DataFrame) -> DataFrame:
    """Companies already written to: ``(company_id, contact_id)`` of the guarded first contact.

    First contact = lowest id with a non-null mailbox (the empty text counts here).
    """
    first = contacts.where(F.col("email").isNotNull()).groupBy("company_id").agg(
        F.min("id").alias("contact_id"))
    written = applications.where(F.col("state").isin(*CONTACTED)).select("contact_id").distinct()
    return first.join(written, "contact_id", "left_semi")


def duplicate_applications(applications: DataFrame, jobs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Applications to guarded companies."""
    at = applications.join(
        jobs.select(F.col("id").alias("job_id"), "company_id"), "job_id")
    guarded = guarded_companies(contacts, applications).select("company_id")
    return lookup(at, guarded, ["company_id"], ["company_id"], how="left_semi")


def mailbox_owners(contacts: DataFrame) -> DataFrame:
    """``(email, owner, next_owner)``: the two lowest contact ids per mailbox.

    ``row_number() <= 2`` runs as a group limit before the shuffle, so a mailbox shared by many
    contacts sends two rows per task, and pairs of contacts are never formed.
    """
    rank = F.row_number().over(W.partitionBy("email").orderBy("id"))
    top = contacts.where(filled("email")).select("email", "id").withColumn("_rn", rank) \
        .where(F.col("_rn") <= 2)
    return top.groupBy("email").agg(
        F.min(F.when(F.col("_rn") == 1, F.col("id"))).alias("owner"),
        F.min(F.when(F.col("_rn") == 2, F.col("id"))).alias("next_owner"))


def relink_conflicts(found: DataFrame, contacts: DataFrame) -> DataFrame:
    """Set a found mailbox, or point to the contact that already owns it.

    ``found(contact_id, email)`` -> ``+ linked_contact_id, action``; the owner is the lowest id
    other than the contact itself.
    """
    joined = lookup(found, mailbox_owners(contacts), ["email"], ["email"], "contact_id")
    other = F.when(F.col("owner") != F.col("contact_id"), F.col("owner")) \
        .otherwise(F.col("next_owner"))
    return joined.select(
        *found.columns,
        F.coalesce(other, "contact_id").alias("linked_contact_id"),
        F.when(other.isNotNull(), "relink").otherwise("set").alias("action"))
