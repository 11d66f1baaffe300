"""Column lists of the small tables used in tests."""

COMPANY = "id BIGINT, name STRING, domain STRING, industry STRING, employee_count INT"
JOB = ("id BIGINT, company_id BIGINT, title STRING, location STRING, salary STRING, url STRING, "
       "experience_years_required DOUBLE")
CONTACT = "id BIGINT, company_id BIGINT, name STRING, role STRING, email STRING"
APPLICATION = ("id BIGINT, run_id STRING, job_id BIGINT, contact_id BIGINT, current_stage INT, state STRING, "
               "score DOUBLE, tailored_resume_path STRING, updated_at TIMESTAMP_NTZ")
EMAIL = ("id BIGINT, application_id BIGINT, subject STRING, body STRING, gmail_draft_id STRING, status STRING, "
         "created_at TIMESTAMP_NTZ")
RESUME = "id BIGINT, application_id BIGINT, parent_resume STRING, path STRING"
HISTORY = "id BIGINT, application_id BIGINT, stage INT, state STRING, timestamp TIMESTAMP_NTZ"
