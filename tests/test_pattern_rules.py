"""Pattern rules by required literals, against matching every name."""

import random
import re

from pyspark.sql import functions as F

from quarry.operators.quality.spec import match_rules, required_literal

CASES = {
    "src[0-4]$": "src", "^src1[0-9]$": "src1", "abc?de": None, "abcd?efg": "efg", "ab+c": None,
    "orders+x": "orders", "(abc)def": "def", "(?:abc|xyz)defg": "defg", "abc|defg": None,
    "(?i)orders": None, r"a\\.orders": "orders", r"\\x41bcd": None, r"\\p{Lu}abc": None,
    "[a[bc]]def": None, "[]abc]def": None, "abc{2}": None, "abcd{0,1}": "abc", "orders.*eu": "orders",
    "ab": None, ".*": None, "": None, "((abc)d)efgh": "efgh", "abc*+def": "def", "xyz??abc": "abc",
    r"\\d+_orders\\b": "_orders", "abc}def": None, "a{2}*bcd": None}


def test_required_literals(spark):
    cases = {k.replace("\\\\", "\\"): v for k, v in CASES.items()}
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    got = dict(rows.select("p", required_literal(F.col("p"))).collect())
    for pattern, literal in cases.items():
        assert got[pattern] == literal, pattern


def test_pairs_are_those_of_matching_every_name(spark):
    r = random.Random(3)
    parts = ["src", "ord", "a", "b", "x_", "[ab]", "[^a]", ".", ".*", "a*", "b?", "(ab|c)", "(ord)?",
             "s{1,2}", r"\\d"[1:], "c+", r"\\."[1:], "|"]
    patterns = {"".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(250)}
    patterns = {("^" if r.random() < .3 else "") + p + ("$" if r.random() < .3 else "")
                for p in patterns}
    names = {"".join(r.choice(["src", "ord", "a", "b", "c", "x_", "1", "."])
                     for _ in range(r.randint(0, 6))) for _ in range(300)}
    good = []
    for p in sorted(patterns):
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            continue
    rules = spark.createDataFrame([(str(i), p, None) for i, p in enumerate([*good, None])],
                                  "rule_id string, table_pattern string, column_pattern string")
    tables = spark.createDataFrame([(n, "c") for n in sorted(names)] + [(None, "c")],
                                   "table_name string, column_name string")
    got = {(r.rule_id, r.table_name) for r in match_rules(rules, tables).collect()}
    want = {(str(i), n) for i, p in enumerate([*good, None]) for n in names
            if p is None or re.search(p, n)}
    assert got == want
