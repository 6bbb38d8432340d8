"""Policy vocabularies and the per-set rules built on them.

The rules work on an ``array<string>`` of entity types (a file's or a
document's type *set*), so they are plain column expressions evaluated after
one ``collect_set`` aggregate — the set is bounded by the vocabulary size.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values: must equal the reference's lists for the same decisions
# ---------------------------------------------------------------------------

# strict breach policy: sensitive types
SENSITIVE_TYPES = [
    "US_SOCIAL_SECURITY_NUMBER", "US_SSN",
    "US_DRIVER_LICENSE", "US_PASSPORT",
    "CREDIT_CARD", "BANK_ACCOUNT", "IBAN_CODE", "US_BANK_ROUTING", "US_BANK_NUMBER",
    "MEDICAL_RECORD_NUMBER", "HEALTH_INSURANCE_POLICY_NUMBER",
    "PIN_CODE", "PASSWORD", "SECURITY_ANSWER",
    "DIGITAL_SIGNATURE", "BIOMETRIC_IDENTIFIER",
]
NAME_TYPES = ["PERSON"]
NAME_PAIR = ["FIRST_NAME", "LAST_NAME"]
LOGIN_TYPES = ["EMAIL_ADDRESS", "USERNAME"]
SECRET_TYPES = ["PASSWORD", "ACCESS_CODE"]
SSN_TYPES = ["US_SSN", "US_SOCIAL_SECURITY_NUMBER"]
FINANCIAL_TYPES = ["CREDIT_CARD", "BANK_ACCOUNT", "US_BANK_NUMBER", "IBAN_CODE", "US_BANK_ROUTING"]
GOV_ID_TYPES = ["US_DRIVER_LICENSE", "US_PASSPORT"]
HEALTH_TYPES = ["MEDICAL_RECORD_NUMBER", "HEALTH_INSURANCE_POLICY_NUMBER"]

# breach labels, in the order the reference lists them
BREACH_LABELS = [
    ("NAME_WITH_SSN", "PII-SSN"),
    ("NAME_WITH_FINANCIALS", "PII-FIN"),
    ("NAME_WITH_GOV_ID", "PII-GOV"),
    ("NAME_WITH_HEALTH", "PII-MED"),
    ("NAME_WITH_OTHER", "PII-GEN"),
    ("CREDENTIALS", "CREDS"),
    ("MULTIPLE", "HIGH-RISK"),
]

# strict policy display names
STRICT_DISPLAY_NAMES = {
    "US_SOCIAL_SECURITY_NUMBER": "Social Security Number",
    "US_SSN": "Social Security Number",
    "US_DRIVER_LICENSE": "Driver's License",
    "US_PASSPORT": "Passport Number",
    "CREDIT_CARD": "Credit Card Number",
    "BANK_ACCOUNT": "Bank Account Number",
    "US_BANK_NUMBER": "Bank Account Number",
    "US_BANK_ROUTING": "Bank Routing Number",
    "IBAN_CODE": "International Bank Account Number",
    "MEDICAL_RECORD_NUMBER": "Medical Record Number",
    "HEALTH_INSURANCE_POLICY_NUMBER": "Health Insurance Policy Number",
    "PIN_CODE": "PIN Code",
    "PASSWORD": "Password",
    "SECURITY_ANSWER": "Security Answer",
    "DIGITAL_SIGNATURE": "Digital Signature",
    "BIOMETRIC_IDENTIFIER": "Biometric Identifier",
    "PERSON": "Person Name",
    "FIRST_NAME": "First Name",
    "LAST_NAME": "Last Name",
    "EMAIL_ADDRESS": "Email Address",
    "USERNAME": "Username",
    "ACCESS_CODE": "Access Code",
}

# four-tier classification (0 public .. 3 restricted)
RESTRICTED = [
    "US_SOCIAL_SECURITY_NUMBER", "US_SSN", "CREDIT_CARD", "BANK_ACCOUNT",
    "US_DRIVER_LICENSE", "US_PASSPORT",
    "MEDICAL_RECORD_NUMBER", "HEALTH_INSURANCE_POLICY_NUMBER",
    "PASSWORD", "ACCESS_CODE", "AWS_SECRET_KEY", "ITAR_CONTROLLED",
    "PIN_CODE", "SECURITY_ANSWER", "DIGITAL_SIGNATURE", "BIOMETRIC_IDENTIFIER",
]
CONFIDENTIAL = [
    "STUDENT_ID", "EMPLOYEE_ID", "GOV_ID",
    "IBAN_CODE", "US_BANK_NUMBER", "US_BANK_ROUTING", "SWIFT_CODE",
    "DONOR_NAME", "GRANT_ID",
]
INTERNAL = [
    "PERSON", "FIRST_NAME", "LAST_NAME", "EMAIL_ADDRESS", "PHONE_NUMBER",
    "ORG", "IP_ADDRESS", "US_POSTAL_CODE", "USERNAME", "ADDRESS",
]
TIER_NAMES = ["Tier-0 Public", "Tier-1 Internal", "Tier-2 Confidential", "Tier-3 Restricted"]
TIER_KEYS = ["tier0_public", "tier1_internal", "tier2_confidential", "tier3_restricted"]
TIER_WORDS = ["Public", "Internal", "Confidential", "Restricted"]

# tier policy display names
TIER_DISPLAY_NAMES = {
    "US_SOCIAL_SECURITY_NUMBER": "Social Security Number",
    "US_SSN": "Social Security Number",
    "US_DRIVER_LICENSE": "Driver's License",
    "US_PASSPORT": "Passport Number",
    "CREDIT_CARD": "Credit Card Number",
    "BANK_ACCOUNT": "Bank Account Number",
    "US_BANK_NUMBER": "Bank Account Number",
    "US_BANK_ROUTING": "Bank Routing Number",
    "IBAN_CODE": "International Bank Account Number",
    "SWIFT_CODE": "SWIFT Code",
    "MEDICAL_RECORD_NUMBER": "Medical Record Number",
    "HEALTH_INSURANCE_POLICY_NUMBER": "Health Insurance Policy Number",
    "PIN_CODE": "PIN Code",
    "PASSWORD": "Password",
    "SECURITY_ANSWER": "Security Answer",
    "DIGITAL_SIGNATURE": "Digital Signature",
    "BIOMETRIC_IDENTIFIER": "Biometric Identifier",
    "AWS_SECRET_KEY": "AWS Secret Key",
    "ITAR_CONTROLLED": "ITAR Controlled Data",
    "STUDENT_ID": "Student ID",
    "EMPLOYEE_ID": "Employee ID",
    "GOV_ID": "Government ID",
    "DONOR_NAME": "Donor Name",
    "GRANT_ID": "Grant ID",
    "PERSON": "Person Name",
    "FIRST_NAME": "First Name",
    "LAST_NAME": "Last Name",
    "EMAIL_ADDRESS": "Email Address",
    "PHONE_NUMBER": "Phone Number",
    "ORG": "Organization",
    "IP_ADDRESS": "IP Address",
    "US_POSTAL_CODE": "Postal Code",
    "USERNAME": "Username",
    "ADDRESS": "Address",
    "ACCESS_CODE": "Access Code",
}

# simple extract policy: type -> category
SIMPLE_CATEGORIES = {
    "US_SSN": "Social Security Number",
    "US_DRIVER_LICENSE": "Driver's License",
    "US_PASSPORT": "Passport Number",
    "CREDIT_CARD": "Credit Card Number",
    "BANK_ACCOUNT": "Bank Account Number",
    "PHONE_NUMBER": "Phone Number",
    "EMAIL_ADDRESS": "Email Address",
    "US_BANK_NUMBER": "Bank Account Number",
    "US_ITIN": "Tax ID Number",
    "MEDICAL_LICENSE": "License Number",
    "AU_MEDICARE": "Medical ID",
    "AU_TFN": "Tax File Number",
    "UK_NHS": "Medical ID",
    "IBAN_CODE": "Bank Account Number",
    "IP_ADDRESS": "Digital Identifier",
    "LOCATION": "Address Information",
    "PERSON": "Personal Name",
    "NRP": "Potentially PII",
}

# tiered mask: types masked completely; types masked to the last four
TIER_FULL_MASK = ["US_SOCIAL_SECURITY_NUMBER", "US_SSN", "CREDIT_CARD", "PASSWORD", "ACCESS_CODE", "PIN_CODE",
                  "SECURITY_ANSWER", "AWS_SECRET_KEY"]
TIER_LAST4_MASK = ["US_DRIVER_LICENSE", "US_PASSPORT", "BANK_ACCOUNT", "MEDICAL_RECORD_NUMBER",
                   "HEALTH_INSURANCE_POLICY_NUMBER", "US_BANK_NUMBER", "US_BANK_ROUTING", "IBAN_CODE"]
# simple mask: types shown as the last four
SIMPLE_LAST4_MASK = ["US_SSN", "CREDIT_CARD", "BANK_ACCOUNT", "US_BANK_NUMBER", "IBAN_CODE"]

HIGH_CONFIDENCE_THRESHOLD = 0.7


# ---------------------------------------------------------------------------
# rules over a type set column
# ---------------------------------------------------------------------------

def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _has(types: Column, t: str) -> Column:
    return F.array_contains(types, t)


def _any(types: Column, values) -> Column:
    return F.arrays_overlap(types, _arr(values)) == F.lit(True)


def has_name(types: Column) -> Column:
    return _has(types, "PERSON") | (_has(types, "FIRST_NAME") & _has(types, "LAST_NAME"))


def has_sensitive(types: Column) -> Column:
    return _any(types, SENSITIVE_TYPES)


def credential_pair(types: Column) -> Column:
    return _any(types, LOGIN_TYPES) & _any(types, SECRET_TYPES)


def breach_trigger(types: Column) -> Column:
    """(name AND sensitive) OR credential pair."""
    return (has_name(types) & has_sensitive(types)) | credential_pair(types)


def breach_components(types: Column) -> Column:
    """The label components in the reference's order (Q8: generic only if
    no earlier component, credentials included)."""
    name = has_name(types)
    creds = F.when(credential_pair(types), F.lit("CREDS"))
    ssn = F.when(name & _any(types, SSN_TYPES), F.lit("PII-SSN"))
    fin = F.when(name & _any(types, FINANCIAL_TYPES), F.lit("PII-FIN"))
    gov = F.when(name & _any(types, GOV_ID_TYPES), F.lit("PII-GOV"))
    med = F.when(name & _any(types, HEALTH_TYPES), F.lit("PII-MED"))
    specific = F.array_compact(F.array(creds, ssn, fin, gov, med))
    gen = F.when(name & has_sensitive(types) & (F.size(specific) == 0), F.lit("PII-GEN"))
    return F.array_compact(F.array(creds, ssn, fin, gov, med, gen))


def breach_label(types: Column) -> Column:
    """One component -> it; several -> HIGH-RISK; none -> UNKNOWN."""
    comps = breach_components(types)
    return (F.when(F.size(comps) > 1, F.lit("HIGH-RISK")).when(F.size(comps) == 1, comps[0])
            .otherwise(F.lit("UNKNOWN")))


def breach_reasons(types: Column) -> Column:
    """Reason codes in the reference's order."""
    return F.array_compact(F.array(
        F.when(has_name(types) & has_sensitive(types), F.lit("personal_info_with_sensitive_data")),
        F.when(credential_pair(types), F.lit("credential_pair"))))


def type_tier(t: Column) -> Column:
    """Tier of a single type (0-3)."""
    return (F.when(t.isin(*RESTRICTED), 3).when(t.isin(*CONFIDENTIAL), 2).when(t.isin(*INTERNAL), 1)
            .otherwise(0))


def set_tier(types: Column) -> Column:
    """Highest tier of any type in the set."""
    return (F.when(_any(types, RESTRICTED), 3).when(_any(types, CONFIDENTIAL), 2)
            .when(_any(types, INTERNAL), 1).otherwise(0))


def tier_name(tier: Column) -> Column:
    return F.element_at(_arr(TIER_NAMES), tier + 1)


def tier_key(tier: Column) -> Column:
    return F.element_at(_arr(TIER_KEYS), tier + 1)


def tier_word(tier: Column) -> Column:
    return F.element_at(_arr(TIER_WORDS), tier + 1)


def display_name(t: Column, names: dict[str, str] = TIER_DISPLAY_NAMES) -> Column:
    """Display name with the type itself as the default."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, t), t)


def dimension(spark: SparkSession):
    """Entity-type dimension: one row per known type with every attribute.

    Small and fixed (under 50 rows), so joins to it are broadcast.
    """
    types = sorted(set(SENSITIVE_TYPES) | set(RESTRICTED) | set(CONFIDENTIAL) | set(INTERNAL)
                   | set(SIMPLE_CATEGORIES) | set(STRICT_DISPLAY_NAMES) | {"ACCESS_CODE"})
    rows = []
    for t in types:
        tier = 3 if t in RESTRICTED else 2 if t in CONFIDENTIAL else 1 if t in INTERNAL else 0
        rows.append((t, tier, TIER_DISPLAY_NAMES.get(t, t), STRICT_DISPLAY_NAMES.get(t, t),
                     SIMPLE_CATEGORIES.get(t), t in SENSITIVE_TYPES))
    return spark.createDataFrame(rows, "entity_type string, tier int, display_name string, "
                                       "strict_name string, simple_category string, sensitive boolean")
