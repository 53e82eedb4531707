"""License scan: rules and their keywords, the scan against a plain version, odd rows, plan."""

import random
import re
import time
from re import _constants as C
from re import _parser as P

import pytest

from civiltext.llm import license_scan
from civiltext.llm.license_scan import CONFIDENCE, RULES, Signature, scan_licenses

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def sample(parsed, rng):
    """A random string that an expression matches."""
    out = ""
    for op, arg in parsed:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.NOT_LITERAL:
            out += "x"
        elif op is C.SUBPATTERN:
            out += sample(arg[-1], rng)
        elif op is C.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        elif op is C.IN:
            kind, what = rng.choice([a for a in arg if a[0] is not C.NEGATE])
            out += "word" if arg[0][0] is C.NEGATE else chr(what if kind is C.LITERAL else rng.randint(*what))
        else:
            raise AssertionError(op)
    return out


def plain_scan(text, rules=RULES):
    line, found = " ".join(words(text)), []
    for i, r in enumerate(rules):
        for m in re.finditer(f"(?<![^ ])(?:{r.regex})(?![^ ])", line):
            start = line[: m.start()].count(" ")
            found.append((start, start + m.group().count(" "), r.label, r.rank, i, r.base))

    def gone(d):
        holds = [f for f in found if f[0] <= d[0] and d[1] <= f[1]]
        return not d[5] and any((f[1] - f[0] > d[1] - d[0] and f[3] <= d[3]) or (f[:2] == d[:2] and f[3:5] < d[3:5]) for f in holds)

    return sorted(d for d in found if not gone(d))


def row_of(doc_id, text, rules=RULES):
    found = plain_scan(text, rules)
    base = [d for d in found if d[5]]
    labels = lambda x: ",".join(sorted({d[2] for d in x}))
    starts = [d[0] for d in base]
    score = CONFIDENCE[min(d[3] for d in found)] if found else 0.0
    return doc_id, len(words(text)), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(found), score, found


def scanned(spark, rows, rules=RULES):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id int, text string, _words int, labels string, _found string")
    got = scan_licenses(df, rules=rules)
    assert [c for c in got.columns if c in df.columns and c != "labels"] == ["doc_id", "text", "_words", "_found"]
    return [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], sorted(map(tuple, r["detections"]))) for r in got.collect()]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, repr(r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_there_are_hundreds_of_rules_and_every_match_holds_its_keywords():
    assert len(RULES) > 250 and len({(r.regex, r.base) for r in RULES}) == len(RULES)
    rng = random.Random(2)
    for r in RULES:
        for _ in range(40):
            text = sample(P.parse(r.regex), rng)
            assert words(text) == text.split(" ") and re.fullmatch(r.regex, text), (r, text)
            assert all(set(g) & set(text.split()) for g in r.needs), (r, text)


def test_samples_of_every_rule_among_prose(spark):
    rng = random.Random(4)
    prose = "the cat sat on a mat by the public library with open common terms mit dem Hund version 2 0 or later license gnu cc".split()
    rows = []
    for i, r in enumerate(RULES):
        parts = [" ".join(rng.choices(prose, k=rng.randint(0, 6))) for _ in range(3)]
        other = sample(P.parse(rng.choice(RULES).regex), rng)
        text = f"{parts[0]} {sample(P.parse(r.regex), rng)} {parts[1]} {other}{rng.choice([' ', ', ', '. (', ' '])}{parts[2]}"
        rows.append((i, rng.choice([text, text.upper(), text.title(), text.replace(" ", "-")])))
    same(scanned(spark, rows), [row_of(*r) for r in rows])


ODD = [
    (1, None), (2, ""), (3, " .,;\x00"), (None, "MIT License"), (4, "mit license"), (4, "mit license"), (5, "mit  -- LICENSE mit/license"), (6, "xmit license mit licenses"),
    (7, "GNU General Public License, GNU general\npublic license version 3 or (at your option) any later version"), (8, "éapache license apache licenseé apache license"),
    (9, "apache lİcense apache licenKe MİT LİCENSE"), (10, "cc by cc by nc 4.0 CC-BY CC BY-NC-SA 4.0 cc"), (11, "a " * 50_000 + "apache license"),
    (12, "mit license " * 600), (13, "license " * 3 + "Licensed under the MIT License. All rights reserved. " * 100), (14, "spdx-license-identifier: GPL-2.0-or-later WITH x"),
    (15, "\x01 mit \x02 license $0 \\ mit license"), (16, "漢字 mit license 漢字"),
]


def test_odd_texts(spark):
    same(scanned(spark, ODD), [row_of(*r) for r in ODD])
    assert scanned(spark, []) == []


def test_priority_and_containment(spark):
    rule = lambda label, rank, regex, base=False: Signature(label, rank, tuple((w,) for w in regex.split()[:1]), regex, base)
    rules = [rule("base", 2, "b c", True), rule("long", 2, "a b c d"), rule("strong", 0, "b c"), rule("weak", 4, "a b c d e"), rule("twin", 2, "a b c d"), rule("part", 2, "d e")]
    text = "x a b c d e y b c"
    assert {d[:3] for d in plain_scan(text, rules)} == {(2, 3, "base"), (7, 8, "base"), (1, 4, "long"), (2, 3, "strong"), (7, 8, "strong"), (1, 5, "weak"), (4, 5, "part")}
    same(scanned(spark, [(1, text)], rules), [row_of(1, text, rules)])


def test_scan_stays_in_its_row(spark):
    plan = scan_licenses(spark.range(1).selectExpr("id AS doc_id", "string(id) AS text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("column", ["N_WORDS", "Labels", "_words", "_found", "__found"])
def test_clashing_names(spark, column):
    df = spark.createDataFrame([(1, "mit license", 5)], f"doc_id int, text string, {column} int")
    row = scan_licenses(df).collect()[0]
    assert row["labels"] == "mit" and row["n_words"] == 2
    assert license_scan.BASE_RANK == 2


def test_a_long_text_of_matches_costs_little(spark):
    n = 40_000
    started = time.monotonic()
    df = spark.createDataFrame([(1, "mit license " * n + "the apache license version 2 0 " * n)], "doc_id int, text string")
    row = scan_licenses(df).drop("detections").collect()[0]
    assert (row["n_words"], row["n_base"], row["last_word"], row["labels"]) == (8 * n, 2 * n, 8 * n - 5, "apache,apache-2.0,mit")
    assert time.monotonic() - started < 60
