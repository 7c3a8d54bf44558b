"""Personal data in texts: what is found, and what is let pass, against the plain patterns."""

import re

from scoutlake.operators import text_scan

TEXTS = [
    "call (512) 555-0142 or +1 512.555.0143\r\nnot 15125550142999, but 5125550144.",
    "a@b.co, x@mail.example.com user@domain.com\u2028third@line.org",
    "ok@skip.org  # pii-ok\nBearer abc.def=\x0bapi_key = 'abcdefghijklmnop1' secret-key: short",
    "synthetic-test-data\nreal@mail.org",
    "1\n2\n3\n4\n5\nsynthetic-test-data real@mail.org",
    None,
    "",
]


def plain():
    for i, text in enumerate(TEXTS):
        lines = (text or "").splitlines()
        if any("synthetic-test-data" in line for line in lines[:5]):
            continue
        for n, line in enumerate(lines, 1):
            for kind, pattern in text_scan.PATTERNS.items() if "pii-ok" not in line else ():
                for m in re.finditer(pattern, line):
                    where = m[0].lower().split("@")[-1]
                    if kind != "email" or not (m[0].lower() in text_scan.PLACEHOLDERS or any(where == d or where.endswith("." + d) for d in text_scan.RESERVED)):
                        yield i, n, kind, m[0]


def test_findings(spark):
    found = text_scan.findings(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), "doc_id")
    want = sorted(plain())
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 8
    assert {k for _, _, k, _ in want} == set(text_scan.PATTERNS)
