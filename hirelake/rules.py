"""Fixed vocabularies and the rule set that parameterises the jobs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: stage labels of the reports -----------------------------------------------
STAGE_LABELS = {
    0: "Company Discovery",
    1: "Job Discovery",
    2: "Filtering & Screening",
    3: "Company Research",
    4: "Contact Research",
    5: "Email Discovery",
    6: "Opportunity Scoring",
    7: "Resume Tailoring",
    8: "Email Generation",
    9: "Validation & QC",
    10: "Gmail Draft Creation",
    11: "DB Finalization",
    12: "Completed",
}

# --- fixed values: state a row carries once it has entered a stage ----------------------------
STATE_ON_ENTRY = {
    3: "Company Research",
    4: "Contact Research",
    5: "Professional Email Discovery",
    6: "Opportunity Scoring",
    7: "Resume Tailoring",
    8: "Email Generation",
    9: "Validation",
    10: "Gmail Draft Creation",
    11: "Database Finalization",
    12: "Completed",
}
FIRST_STAGE, LAST_STAGE, DONE_STAGE = 3, 11, 12

# --- fixed values: the status sets; they differ on purpose, each report has its own -----------
RUN_TERMINAL = (
    "Completed", "Skipped", "Duplicate", "Salary Too Low", "Excluded Company", "Ghost Job",
    "No Professional Email", "Research Failed", "Timeout", "Validation Failed", "Draft Failed",
    "Manual Skip", "Failed",
)
WEB_TERMINAL = (
    "Completed", "Skipped", "Duplicate", "Salary Too Low", "Excluded Company", "Ghost Job",
    "Failed", "No Professional Email",
)
WEB_FILTERED = (
    "Excluded Company", "Salary Too Low", "Ghost Job", "Duplicate", "No Professional Email",
    "Skipped",
)
CLI_FILTERED = ("Excluded Company", "Salary Too Low", "Ghost Job")
REFILTER_CLOSED = ("Completed", "Skipped", "Excluded Company", "Salary Too Low", "Ghost Job")
RETRYABLE = ("Failed", "Research Failed", "Draft Failed", "Validation Failed")
CONTACTED = ("Completed", "Gmail Draft Creation", "Email Generation")
CLEARED_EMAIL_STATES = ("Professional Email Discovery", "Email Discovery", "Draft Failed")
NO_EMAIL_STATES = ("Research Failed", "Draft Failed", "Validation Failed")

# --- fixed values: where a failed row restarts; anything else restarts at 7 -------------------
RETRY_STAGE = {"Research Failed": 3, "Draft Failed": 10}
RETRY_DEFAULT_STAGE = 7

# --- fixed values: hosts known to refuse scripted fetches -------------------------------------
SEED_BLOCKED_DOMAINS = (
    "linkedin.com", "zoominfo.com", "rocketreach.co", "indeed.com", "tracxn.com",
    "stackshare.io", "glassdoor.com", "crunchbase.com",
)

# --- fixed values: the placeholder contact ----------------------------------------------------
PLACEHOLDER_NAME = "Hiring Manager"
PLACEHOLDER_ROLE = "Engineering Manager"


# Contact roles from the most wanted on, and the weights of a score.
ROLE_PRIORITY = ("engineering manager", "hiring manager", "tech lead", "head of engineering", "cto", "recruiter", "hr")
SCORE_WEIGHTS = {"role_match": 0.3, "tech_stack": 0.3, "salary": 0.1, "company_quality": 0.1, "growth": 0.1, "confidence": 0.1}


@dataclass(frozen=True)
class Rules:
    """Everything a user may tune; list-valued rules become literals in the plan."""

    excluded_companies: tuple[str, ...] = ()
    excluded_title_words: tuple[str, ...] = ()
    max_experience_years: float = 1.0
    allow_speculative: bool = False
    preferred_roles: tuple[str, ...] = ()
    geographies: tuple[str, ...] = ()
    role_priority: tuple[str, ...] = ROLE_PRIORITY
    weights: Mapping[str, float] = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    minimum_score: float = 0.60
    daily_draft_limit: int = 20
    cache_ttl_seconds: int = 86400
    breaker_failures: int = 3
    blacklist_failures: int = 5
    seed_blocked: tuple[str, ...] = SEED_BLOCKED_DOMAINS
    sender_name: str = "Your Name"
    linkedin_url: str = ""
    github_url: str = ""

    COMPONENTS = ("role_match", "tech_stack", "salary", "company_quality", "growth", "confidence")

    def __post_init__(self) -> None:
        missing = [c for c in self.COMPONENTS if c not in self.weights]
        if missing:
            raise ValueError(f"scoring weights missing: {missing}")
        if self.max_experience_years < 0:
            raise ValueError("max_experience_years must not be negative")

    @property
    def preferred_role(self) -> str:
        return self.preferred_roles[0] if self.preferred_roles else "Software Engineer"

    @property
    def preferred_location(self) -> str:
        return self.geographies[0] if self.geographies else "Remote"

    @classmethod
    def from_mapping(cls, config: Mapping[str, Any]) -> "Rules":
        """Build from the nested settings mapping (the parsed settings file); missing sections fail."""
        prefs, exclusions = config["job_preferences"], config["exclusions"]
        settings, scoring = config["pipeline"], config["scoring"]
        identity = config.get("user_identity", {})
        return cls(
            excluded_companies=tuple(exclusions["companies"]),
            excluded_title_words=tuple(exclusions["keywords"]),
            max_experience_years=float(prefs["experience_years_max"]),
            allow_speculative=bool(prefs.get("allow_speculative_outreach", False)),
            preferred_roles=tuple(prefs["roles"]),
            geographies=tuple(prefs["geographies"]),
            weights={k: float(v) for k, v in scoring["weights"].items()},
            minimum_score=float(scoring["thresholds"]["minimum_score"]),
            daily_draft_limit=int(settings["daily_draft_limit"]),
            cache_ttl_seconds=int(settings["cache_lifetime_seconds"]),
            sender_name=identity.get("name", "Your Name"),
            linkedin_url=identity.get("linkedin_url", ""),
            github_url=identity.get("github_url", ""),
        )

    def as_table(self, spark: SparkSession) -> DataFrame:
        """The rule set as rows ``(rule, ordinal, name, value)`` for audit and for joining to logs."""
        rows = []
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, Mapping):
                rows += [(f.name, i, k, str(v)) for i, (k, v) in enumerate(value.items())]
            elif isinstance(value, tuple):
                rows += [(f.name, i, None, str(v)) for i, v in enumerate(value)]
            else:
                rows.append((f.name, 0, None, str(value)))
        return spark.createDataFrame(rows, "rule STRING, ordinal INT, name STRING, value STRING")


# Rule set used with the generated test tables.
FIXTURE_RULES = Rules(
    excluded_companies=("00000007",),
    excluded_title_words=("Specified",),
    role_priority=("promo", "economy", "standard"),
    allow_speculative=True,
    preferred_roles=("Backend Engineer",),
    geographies=("Remote",),
    sender_name="Jane Doe",
    linkedin_url="https://www.linkedin.com/in/jane-doe/",
    github_url="https://github.com/jane-doe",
)
