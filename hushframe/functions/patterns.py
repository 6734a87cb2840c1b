"""The patterns, word lists and tables that detection results depend on, and the rule table built from them.

Patterns are written in the common notation and turned into the JVM's dialect by `jvm`: \\b is an ASCII word border there, \\s the white space of
web text, and $ the very end.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values. -----------------------------------------------------------------------------------------------------------

WHITE = "\t\n\x0b\f\r \xa0  -     　﻿"

AADHAAR = r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
PAN = r"\b[A-Z]{3}[ABCFGHLJPTK][A-Z]\d{4}[A-Z]\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
UPI = r"(?i)\b[\w.\-]{2,}@(?:oksbi|okhdfcbank|okicici|okaxis|paytm|ybl|ibl|axl|upi)\b"
EMAIL = r"\b[\w.+\-]+@[\w\-]+\.[\w.\-]{2,}\b"
PHONE = r"(?:\+?91[\s-]?)?\b[6-9]\d{9}\b"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAY_MONTH_YEAR = r"\b(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)\d{2}\b"
ISO_DATE = r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:T\d{2}:\d{2}(?::\d{2})?)?\b"
DAY_NAME_YEAR = rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\.?,?\s+(?:19|20)\d{{2}}\b"
NAME_DAY_YEAR = rf"(?i)\b(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}}\b"
NAME_SHORT_YEAR = rf"(?i)\b(?:{MONTHS})/\d{{2}}\b"
ID_NUMBER = r"(?i)\b(?=[A-Z0-9-]{6,18}\b)(?=[^\s]*\d)[A-Z0-9][A-Z0-9-]{4,16}[A-Z0-9]\b"

AADHAAR_CONTEXT = r"(?i)(aadhaar|aadhar|uidai|\buid\b|आधार)"
ID_CONTEXT = (
    r"(?i)(driver'?s?\s*licen[cs]e|licen[cs]e\s*(no|num|#)|social\s*(security\s*)?(number|num)?|ssn|passport|id\s*card|\bid\b\s*[:#]|applicant|account\s*(no|num|#)"
    r"|employee\s*id|registration\s*(no|num))\s*[:#-]?\s*$"
)
DOB_CONTEXT = r"(?i)(date\s*of\s*birth|\bd\.?o\.?b\.?\b|\bborn\b|birth\s*(day|date)?|janm|जन्म)[^.]{0,40}$"

SENSITIVE_AUTOCOMPLETE = (
    "cc-number cc-csc cc-exp cc-name cc-exp-month cc-exp-year tel tel-national email street-address postal-code address-line1 address-line2 bday"
    " name given-name family-name new-password current-password one-time-code"
).split()
SENSITIVE_NAME = r"(?i)(pass|pwd|secret|token|otp|cvv|cvc|aadhaar|aadhar|uidai|pan\b|ssn|passport|account|acct|ifsc|upi|card|phone|mobile|email|dob|birth|salary|income)"
SENSITIVE_GOAL = r"(?i)\b(password|passwd|pwd|otp|pin|cvv|cvc|secret|token|card\s*number|aadhaar|aadhar|pan\b|passport|ssn)\b"

PLACEHOLDERS = {
    "aadhaar": "[[AADHAAR]]",
    "pan": "[[PAN]]",
    "card": "[[CARD]]",
    "ifsc": "[[IFSC]]",
    "upi": "[[UPI]]",
    "email": "[[EMAIL]]",
    "phone_in": "[[PHONE]]",
    "dob": "[[DOB]]",
    "id_number": "[[ID_NUMBER]]",
    "name": "[[NAME]]",
    "addr": "[[ADDRESS]]",
    "user": "[[USERNAME]]",
    "ip": "[[IP]]",
    "password": "[[PASSWORD]]",
    "sensitive_field": "[[SENSITIVE]]",
    "visual_candidate": "[[IMAGE]]",
}

VERHOEFF_D = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
VERHOEFF_P = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")
VERHOEFF_INVERSE = "0432156789"

BLOCK_TAGS = "p|div|li|tr|td|th|h[1-6]|section|article|header|footer|nav|aside|form|fieldset|table|ul|ol|dl|dt|dd|blockquote|pre|main|figure|figcaption|canvas|br"
INLINE_TAGS = "a abbr b bdi bdo cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr label font ins del".split()
SKIPPED_TAGS = "script style noscript svg head".split()
INTERACTIVE_TAGS, INTERACTIVE_ROLES = "a button input select textarea".split(), "button link textbox".split()
LABEL_KINDS = {"EMAIL": "email", "TEL": "phone_in", "BOD": "dob", "DATE": "dob", "DRIVERLICENSE": "id_number", "SOCIALNUMBER": "id_number", "IDCARD": "id_number", "PASSPORT": "id_number"}
TAG_CLASSES = {
    "GIVENNAME1": "NAME",
    "GIVENNAME2": "NAME",
    "LASTNAME1": "NAME",
    "LASTNAME2": "NAME",
    "LASTNAME3": "NAME",
    "TITLE": "NAME",
    "CITY": "ADDR",
    "STATE": "ADDR",
    "STREET": "ADDR",
    "BUILDING": "ADDR",
    "SECADDRESS": "ADDR",
    "POSTCODE": "ADDR",
    "COUNTRY": "ADDR",
    "USERNAME": "USER",
    "IP": "IP",
}

# Built from them. --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A detection rule; verify names the test a match has to pass."""

    kind: str
    severity: int
    pattern: str
    verify: str | None = None


#: The order decides ties.
RULES = (
    Rule("aadhaar", 3, AADHAAR, "aadhaar"),
    Rule("card", 3, CARD, "luhn"),
    Rule("pan", 3, PAN),
    Rule("ifsc", 2, IFSC),
    Rule("upi", 2, UPI),
    Rule("email", 2, EMAIL),
    Rule("phone_in", 2, PHONE, "phone"),
    *(Rule("dob", 1, p, "birth") for p in (DAY_MONTH_YEAR, ISO_DATE, DAY_NAME_YEAR, NAME_DAY_YEAR, NAME_SHORT_YEAR)),
    Rule("id_number", 3, ID_NUMBER, "labelled"),
)

#: The server's audit: shapes and checksums alone, digits and borders as Unicode has them.
AUDIT_RULES = tuple(Rule(r.kind, r.severity, r.pattern, {"aadhaar": "verhoeff", "luhn": "luhn"}.get(r.verify)) for r in RULES[:8])

BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def jvm(pattern: str, unicode: bool = False) -> str:
    """The pattern in the JVM's dialect."""
    out = pattern.replace("[^\\s]", f"[^{WHITE}]").replace("[\\s-]", f"[{WHITE}-]").replace("\\s", f"[{WHITE}]")
    out = out[:-1] + r"\z" if out.endswith("$") else out
    return "(?U)" + out if unicode else out.replace(r"\b", BORDER)


def re2(pattern: str) -> str:
    """The pattern for DuckDB, whose \\b and \\d are ASCII already."""
    out = pattern.replace("[^\\s]", f"[^{WHITE}]").replace("[\\s-]", f"[{WHITE}-]").replace("\\s", f"[{WHITE}]")
    return out[:-1] + r"\z" if out.endswith("$") else out
