"""Recognizer catalogue: what each entity type looks like in text.

Three lanes keep the plan small and every pattern valid in both Java regex
and RE2 (no look-around, no back-references, no ``\\b``):

* token lanes — one guarded pass finds maximal number-like (or upper-case
  code-like) tokens; each token is then full-matched against the type shapes
  and checked (checksum / range).  One regex pass serves many types.
* shape lane — one pattern per type (e-mail, phone, street address).
* cue lane — ``label [:=#] value``; the value is the last group of the
  pattern, so the label never enters the span.

A span must not run into a letter or digit: the characters before the match
(``head_edge``; for cues, before the label: no letter) and after it
(``tail_guard``) are checked on the candidates, not with a consuming guard
in the pattern, which would make Java's matcher slow.  Scores are ours: 0.85 for a cue or a specific shape, 0.95 for a passed
strong checksum, 0.5 for a bare number whose checksum is weak, +0.3 when a
context word occurs in the 40 characters before the span, capped at 1.0.
The default threshold 0.7 therefore means "checked or cued".
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column

from . import checksums as ck

# ---------------------------------------------------------------------------
# fixed values (patterns, scores, context words) — our design
# ---------------------------------------------------------------------------
# Patterns start with a plain character class (no leading alternation), which
# keeps Java's matcher fast; the "not inside a longer word" rule is checked
# on the characters before and after each match instead.
NUM_TOKEN = "[0-9](?:[0-9.-]*[0-9])?"
CODE_TOKEN = "[A-Z][A-Z0-9]{7,33}"
TOKEN_EDGE = "^[A-Za-z0-9]$"   # a token may not touch one of these
LABEL_EDGE = "^[A-Za-z]$"      # a cue label may not follow one of these

SHAPE_SCORE = 0.85
STRONG_CHECK_SCORE = 0.95
WEAK_NUMBER_SCORE = 0.5
CONTEXT_BOOST = 0.3
CONTEXT_WIDTH = 40


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    lane: str                       # 'num' | 'code' | a recognizer-own pattern lane
    full: str | None = None         # full-match shape for token lanes
    pattern: str | None = None      # own pattern for shape/cue lanes
    group: int = 0
    score: float = SHAPE_SCORE
    check: Callable[[Column], Column] | None = None
    check_name: str | None = None   # name of the SQL twin of ``check``
    context: str | None = None      # lower-case alternation of cue words
    prefilter: str | None = None    # cheap rlike on the whole text
    tail_guard: bool = True
    head_edge: str | None = TOKEN_EDGE   # class the char before the match may not be
    tags: tuple = field(default_factory=tuple)


def _cue(labels: str, value: str, sep: str = "[:#=]") -> str:
    """label words, optional 'number/no/#', a separator, then the value group."""
    return ("(?i:" + labels + ")(?i: (?:number|no\\.?|num|#|id))?\\s*"
            + sep + "\\s*\"?(" + value + ")")


ID_VALUE = "[A-Za-z0-9][A-Za-z0-9-]{3,19}"
NAME_VALUE = "[A-Z][a-z]+(?: [A-Z][a-z]+)+"

RECOGNIZERS: tuple[Recognizer, ...] = (
    # token lane: numbers ---------------------------------------------------
    Recognizer("US_SSN", "num", full="^[0-9]{3}-[0-9]{2}-[0-9]{4}$", check=ck.ssn_ok,
               check_name="ssn", context="ssn|social security"),
    Recognizer("US_ITIN", "num", full="^9[0-9]{2}-[0-9]{2}-[0-9]{4}$", check=ck.itin_ok,
               check_name="itin", context="itin|taxpayer"),
    Recognizer("IP_ADDRESS", "num", full="^[0-9]{1,3}(\\.[0-9]{1,3}){3}$", check=ck.ipv4_ok,
               check_name="ipv4", context="ip|address|host"),
    Recognizer("CREDIT_CARD", "num", full="^([0-9]{13,19}|[0-9]{4}(-[0-9]{4}){3})$",
               score=STRONG_CHECK_SCORE, check=ck.luhn_ok, check_name="luhn",
               context="card|visa|mastercard|amex|credit"),
    Recognizer("US_BANK_ROUTING", "num", full="^[0-9]{9}$", score=WEAK_NUMBER_SCORE,
               check=ck.aba_routing_ok, check_name="aba", context="routing|aba|rtn"),
    Recognizer("UK_NHS", "num", full="^([0-9]{10}|[0-9]{3}-[0-9]{3}-[0-9]{4})$",
               score=WEAK_NUMBER_SCORE, check=ck.nhs_ok, check_name="nhs", context="nhs|health service"),
    Recognizer("AU_TFN", "num", full="^[0-9]{9}$", score=WEAK_NUMBER_SCORE,
               check=ck.au_tfn_ok, check_name="tfn", context="tfn|tax file"),
    Recognizer("AU_MEDICARE", "num", full="^[2-6][0-9]{9}$", score=WEAK_NUMBER_SCORE,
               check=ck.au_medicare_ok, check_name="medicare", context="medicare"),
    Recognizer("US_POSTAL_CODE", "num", full="^[0-9]{5}(-[0-9]{4})?$", score=WEAK_NUMBER_SCORE,
               context="zip|postal|postcode"),
    # token lane: upper-case codes -----------------------------------------
    Recognizer("IBAN_CODE", "code", full="^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
               score=STRONG_CHECK_SCORE, check=ck.iban_ok, check_name="iban", context="iban|account"),
    Recognizer("AWS_SECRET_KEY", "code", full="^AKIA[0-9A-Z]{16}$", score=STRONG_CHECK_SCORE,
               context="aws|key"),
    # shape lane -----------------------------------------------------------
    Recognizer("EMAIL_ADDRESS", "email",
               pattern="[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
               prefilter="@", tail_guard=False, head_edge=None),
    Recognizer("PHONE_NUMBER", "phone",
               pattern="(?:\\+[0-9]{1,2}[ .-])?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
               prefilter="[0-9]{3}[ .-][0-9]{4}", context="phone|tel|call|mobile|cell|fax"),
    Recognizer("ADDRESS", "address",
               pattern="[0-9]{1,6} (?:[A-Z][A-Za-z]+ ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Blvd)",
               prefilter="(Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Blvd)"),
    # cue lane -------------------------------------------------------------
    Recognizer("ACCESS_CODE", "cue_access",
               pattern="(?i:token|access code|api key|apikey|secret key)\\s*[:=]\\s*\"?([A-Za-z0-9_-]{6,})",
               group=1, prefilter="(?i)token|access code|api ?key|secret key"),
    Recognizer("PASSWORD", "cue_password",
               pattern="(?i:password|passwd|pwd)\\s*[:=]\\s*\"?([^\\s\"]+)", group=1,
               prefilter="(?i)password|passwd|pwd", tail_guard=False),
    Recognizer("PIN_CODE", "cue_pin", pattern=_cue("pin|pin code", "[0-9]{4,8}"), group=1,
               prefilter="(?i)pin"),
    Recognizer("USERNAME", "cue_user",
               pattern=_cue("username|user name|login|user id|userid", "[A-Za-z0-9._-]{3,}"), group=1,
               prefilter="(?i)user|login"),
    Recognizer("SECURITY_ANSWER", "cue_answer",
               pattern=_cue("security answer|secret answer|security question answer",
                            "[A-Za-z0-9]+(?: [A-Za-z0-9]+){0,4}"), group=1,
               prefilter="(?i)answer"),
    Recognizer("PERSON", "cue_person", pattern=_cue("name|full name|patient|employee name", NAME_VALUE, ":"),
               group=1, prefilter="(?i)name|patient", tail_guard=False),
    Recognizer("DONOR_NAME", "cue_donor", pattern=_cue("donor|donor name", NAME_VALUE, ":"), group=1,
               prefilter="(?i)donor", tail_guard=False),
    Recognizer("US_DRIVER_LICENSE", "cue_dl",
               pattern=_cue("driver'?s? licen[cs]e|dl", ID_VALUE), group=1, prefilter="(?i)licen|dl"),
    Recognizer("US_PASSPORT", "cue_passport", pattern=_cue("passport", ID_VALUE), group=1,
               prefilter="(?i)passport"),
    Recognizer("MEDICAL_RECORD_NUMBER", "cue_mrn",
               pattern=_cue("medical record|mrn", ID_VALUE), group=1, prefilter="(?i)medical|mrn"),
    Recognizer("HEALTH_INSURANCE_POLICY_NUMBER", "cue_hipn",
               pattern=_cue("insurance policy|health insurance|policy", ID_VALUE), group=1,
               prefilter="(?i)policy|insurance"),
    Recognizer("MEDICAL_LICENSE", "cue_medlic", pattern=_cue("medical license|dea", ID_VALUE), group=1,
               prefilter="(?i)medical|dea"),
    Recognizer("STUDENT_ID", "cue_student", pattern=_cue("student|student id", ID_VALUE), group=1,
               prefilter="(?i)student"),
    Recognizer("EMPLOYEE_ID", "cue_employee", pattern=_cue("employee|employee id|emp id", ID_VALUE), group=1,
               prefilter="(?i)emp"),
    Recognizer("GOV_ID", "cue_gov", pattern=_cue("government id|gov id|national id|state id", ID_VALUE),
               group=1, prefilter="(?i)id"),
    Recognizer("GRANT_ID", "cue_grant", pattern=_cue("grant|grant id|award", ID_VALUE), group=1,
               prefilter="(?i)grant|award"),
    Recognizer("BANK_ACCOUNT", "cue_bank", pattern=_cue("bank account|account", "[0-9]{6,17}"), group=1,
               prefilter="(?i)account"),
    Recognizer("US_BANK_NUMBER", "cue_usbank", pattern=_cue("checking|savings|acct", "[0-9]{6,17}"),
               group=1, prefilter="(?i)checking|savings|acct"),
    Recognizer("SWIFT_CODE", "cue_swift", pattern=_cue("swift|bic|swift code", "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"),
               group=1, prefilter="(?i)swift|bic"),
)

# Marker terms (fixed values, our design): words that stand for themselves.
MARKER_TERMS = (
    ("DIGITAL_SIGNATURE", "digital signature"),
    ("DIGITAL_SIGNATURE", "BEGIN PGP SIGNATURE"),
    ("BIOMETRIC_IDENTIFIER", "fingerprint"),
    ("BIOMETRIC_IDENTIFIER", "retina scan"),
    ("BIOMETRIC_IDENTIFIER", "iris scan"),
    ("BIOMETRIC_IDENTIFIER", "voiceprint"),
    ("ITAR_CONTROLLED", "ITAR"),
    ("ITAR_CONTROLLED", "export controlled"),
)


def _marker(entity_type: str) -> Recognizer:
    pattern = "(?i:" + "|".join(t.replace(" ", "[ -]+") for e, t in MARKER_TERMS if e == entity_type) + ")"
    return Recognizer(entity_type, "marker_" + entity_type.lower(), pattern=pattern,
                      prefilter=pattern, head_edge=TOKEN_EDGE)


RECOGNIZERS += tuple(_marker(e) for e in dict.fromkeys(e for e, _ in MARKER_TERMS))

LANE_PATTERN = {"num": NUM_TOKEN, "code": CODE_TOKEN}
LANE_PREFILTER = {"num": "[0-9]", "code": "[A-Z][A-Z0-9]{7}"}

def lane_guard(lane: str) -> str:
    """Cheap literal test implied by every pattern of a lane group: a text
    without it cannot match, so the group's regex passes are skipped.

    * cue lanes all need one of ``: = #`` after the label;
    * number, phone and address lanes need a digit;
    * e-mail needs an ``@``."""
    if lane.startswith("cue_"):
        return "sep"
    if lane in ("num", "phone", "address"):
        return "digit"
    if lane == "email":
        return "at"
    return "none"


def head_edge(lane: str, recs: list[Recognizer]) -> str | None:
    if lane.startswith("cue_"):
        return LABEL_EDGE
    if lane in LANE_PATTERN:
        return TOKEN_EDGE
    return recs[0].head_edge


def by_type() -> dict[str, Recognizer]:
    return {r.entity_type: r for r in RECOGNIZERS}


def select(entities=None) -> list[Recognizer]:
    """Recognizer pruning: only the requested types enter the plan."""
    if entities is None:
        return list(RECOGNIZERS)
    wanted = set(entities)
    return [r for r in RECOGNIZERS if r.entity_type in wanted]


def lanes(recs: list[Recognizer]) -> dict[str, list[Recognizer]]:
    out: dict[str, list[Recognizer]] = {}
    for r in recs:
        out.setdefault(r.lane, []).append(r)
    return out


def lane_pattern(lane: str, recs: list[Recognizer]) -> tuple[str, int]:
    if lane in LANE_PATTERN:
        return LANE_PATTERN[lane], 0
    r = recs[0]
    return r.pattern, r.group


def lane_prefilter(lane: str, recs: list[Recognizer]) -> str | None:
    if lane in LANE_PREFILTER:
        return LANE_PREFILTER[lane]
    return recs[0].prefilter
