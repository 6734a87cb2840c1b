"""Single operators of detection and redaction: fixed cases, then a plain model of the rules on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hushframe.functions import checksum, patterns, redact, scan


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def kinds(spark, text):
    return [s.kind for s in one(spark, scan.scan_text(F.col("t")), t=text)]


def test_checksums(spark):
    rows = spark.createDataFrame([(x,) for x in ("234123412346", "234123412345", "134123412346", "034123412346", "4539578763621486", "4539578763621487", "0", "", None)], "d string")
    got = rows.select(checksum.verhoeff_ok(F.col("d")).alias("v"), checksum.luhn_ok(F.col("d")).alias("l")).collect()
    assert [r.v for r in got] == [True] + [False] * 8
    assert [r.l for r in got] == [False] * 4 + [True] + [False] * 4


def test_check_digits_complete_numbers(spark):
    rows = spark.range(200).select((F.col("id") * 7919 + 20000000000).cast("string").alias("a"), (F.col("id") * 104729 + 400000000000000).cast("string").alias("c"))
    ok = rows.select(checksum.verhoeff_ok(F.concat("a", checksum.verhoeff_digit(F.col("a")).cast("string"))).alias("a"), checksum.luhn_ok(F.concat("c", checksum.luhn_digit(F.col("c")).cast("string"))).alias("c"))
    assert ok.filter("a and c").count() == 200


CASES = [
    ("order 100000000000 shipped", []),
    ("Aadhaar: 2341 2341 2346", ["aadhaar"]),
    ("ticket 2341 2341 2346", []),
    ("Date of Birth: 21/07/1936", ["dob"]),
    ("The treaty was signed on 17th February 1946.", []),
    ("Driver's License: 6042580277", ["id_number"]),
    ("write to a.b@x.com today", ["email"]),
    ("4539 5787 6362 1486 12", []),  # a failed test uses its match up
    ("call +919845012345", []),
    ("call +91 9845012345", ["phone_in"]),
    ("call 98450123456", []),
    ("SSN: abcdef,9", ["id_number"]),  # a digit beyond the token is seen
    ("आधार234123412346 x", ["aadhaar"]),  # word borders are ASCII
    ("PAN abcpk1234z ABCPK1234Z HDFC0123456 hdfc0123456", ["pan", "ifsc"]),
    ("PAY ME@YBL or me@okaxis.", ["upi", "upi"]),
    ("born in a hospital on 1990-01-01", ["dob"]),
    ("born here. Then 1990-01-01", []),
    ("DOB: May 5th, 1966 dob January/88", ["dob", "dob"]),
    ("x@y", []),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(spark, text, want):
    assert kinds(spark, text) == want


def test_redaction_is_exact(spark):
    red = lambda t: one(spark, redact.redact_text(F.col("t"), scan.scan_text(F.col("t"))), t=t)
    assert red("write to a.b@x.com today") == "write to [[EMAIL]] today"
    assert red("card 4539578763621486 end") == "card [[CARD]]end"  # the separator belongs to the match
    assert red("nothing") == "nothing" and red("") == ""


def spans(*items):
    return F.array(*(F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"), F.lit(k).cast("string").alias("kind")) for a, b, k in items))


def test_malformed_spans(spark):
    red = lambda *s: one(spark, redact.redact_text(F.col("t"), spans(*s)), t="0123456789abcdef")
    assert red((8, 10, "pan"), (0, 2, "card")) == "[[CARD]]234567[[PAN]]abcdef"
    assert red((4, 10, "pan"), (6, 14, "card")) == "0123[[PAN]]ef"
    assert red((2, 4, "pan"), (4, 6, "card")) == "01[[PAN]][[CARD]]6789abcdef"
    assert red((None, 4, "pan"), (9, 3, "pan")) == "0123456789abcdef"
    assert red((0, 4, None)) == "[[REDACTED]]456789abcdef"


def test_placeholders(spark):
    rows = spark.createDataFrame([("phone_in",), ("autocomplete:cc-number",), ("face",), ("",), (None,)], "k string")
    assert [r[0] for r in rows.select(redact.placeholder_for(F.col("k"))).collect()] == ["[[PHONE]]", "[[CC_NUMBER]]", "[[REDACTED]]", "[[REDACTED]]", "[[REDACTED]]"]


def plain_scan(text):
    """The rules in plain Python."""
    found = []
    for order, rule in enumerate(patterns.RULES):
        pattern = rule.pattern.replace("$", r"\Z").replace(r"[^\s]", f"[^{patterns.WHITE}]").replace(r"[\s-]", f"[{patterns.WHITE}-]").replace(r"\s", f"[{patterns.WHITE}]")
        for m in re.finditer(pattern, text, re.ASCII):
            before, digits = text[max(0, m.start() - 48) : m.start()], re.sub(r"\D", "", m[0])
            context = lambda p: re.search(p.replace("$", r"\Z").replace(r"\s", f"[{patterns.WHITE}]"), before, re.ASCII)  # noqa: E731, B023
            if rule.verify == "luhn":
                ok = 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            elif rule.verify == "aadhaar":
                c = 0
                for i, d in enumerate(digits[::-1]):
                    c = int(patterns.VERHOEFF_D[c][int(patterns.VERHOEFF_P[i % 8][int(d)])])
                ok = c == 0 and (m[0] == digits or re.search(patterns.AADHAAR_CONTEXT, text[max(0, m.start() - 40) : m.start()], re.ASCII))
            elif rule.verify == "phone":
                ok = not re.search(r"[0-9]\Z", before) and not re.match("[0-9]", text[m.end() :]) and not context(patterns.ID_CONTEXT)
            elif rule.verify == "birth":
                ok = context(patterns.DOB_CONTEXT)
            elif rule.verify == "labelled":
                ok = context(patterns.ID_CONTEXT)
            else:
                ok = True
            if ok:
                found.append((m.start(), -rule.severity, -(m.end() - m.start()), order, rule.kind, m.end()))
    out, end = [], 0
    for start, *_, kind, stop in sorted(found):
        if start >= end:
            out.append((kind, start, stop))
            end = stop
    return out


def test_random_texts_against_the_plain_model(spark):
    pick = random.Random(11)
    parts = ["Aadhaar: ", "234123412346", "2341 2341 2346", "4539578763621486", "4539 5787-6362 1486", "ABCPK1234Z", "HDFC0123456", "a@ybl", "u.v@mail.example.org", "9876543210", "+91 ", "DOB: ", "born ", "21/07/1936", "1977-04-07T00:00:00", "5 May 1966", "May 5th, 1966", "passport: ", "id: ", "X1234567", " ", "\n", ". ", "-", "é", "आ", "\xa0", "x"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 14))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("s", scan.scan_text(F.col("t")))
    for r in rows.withColumn("red", redact.redact_text(F.col("t"), F.col("s"))).collect():
        want = plain_scan(r.t) if len(r.t) >= 4 else []
        assert [(s.kind, s.start, s.end) for s in r.s] == want, r.t
        out, at = "", 0
        for kind, start, end in want:
            out += r.t[at:start] + patterns.PLACEHOLDERS[kind]
            at = end
        assert r.red == out + r.t[at:]


def test_audit_needs_no_context(spark):
    got = one(spark, scan.audit_kinds(F.col("t")), t="ticket 2341 2341 2346 on 21/07/1936, me@ybl, 4539578763621487")
    assert got == ["aadhaar", "dob", "upi"]
