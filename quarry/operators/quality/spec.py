"""Typed rule specification (Q1-Q27 parameters, defaults and aliases)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default pass thresholds per rule type and dialect.
# "service" is the rule service (results with status/pass_rate), "engine"
# the per-connection rule engine.
SERVICE_THRESHOLDS = {
    "completeness": 0.95, "uniqueness": 1.0, "validity": 1.0, "consistency": 1.0,
    "accuracy": 0.9, "timeliness": 0.9, "conformity": 1.0, "integrity": 1.0,
    "reference_integrity": 0.95, "range_check": 0.95, "regex_pattern": 0.95,
    "custom_sql": 1.0, "python": 1.0,
}
ENGINE_THRESHOLDS = dict(SERVICE_THRESHOLDS, validity=0.95, consistency=0.95)

# Short names used in pipeline configs.
ALIASES = {
    "not_null": ("completeness", {"threshold": 1.0}),
    "unique": ("uniqueness", {}),
    "range": ("range_check", {}),
    "format": ("regex_pattern", {}),
}

# Remediation actions and severities.
REMEDIATIONS = ("alert_only", "quarantine", "auto_fix", "reject", "manual_review")
SEVERITIES = ("low", "medium", "high", "critical")

RULE_TYPES = tuple(SERVICE_THRESHOLDS)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    column: str | None = None
    definition: dict = field(default_factory=dict)
    name: str | None = None
    severity: str = "medium"
    remediation: str = "alert_only"
    dialect: str = "service"
    organization_id: str | None = None
    target_table: str | None = None
    is_active: bool = True

    def normalized(self) -> "Rule":
        """Resolve aliases into their rule type and default parameters."""
        if self.rule_type in ALIASES:
            rtype, extra = ALIASES[self.rule_type]
            return replace(self, rule_type=rtype, definition={**extra, **self.definition})
        return self

    @property
    def display_name(self) -> str:
        return self.name or self.rule_id

    def threshold(self) -> float:
        table = ENGINE_THRESHOLDS if self.dialect == "engine" else SERVICE_THRESHOLDS
        t = self.definition.get("threshold")
        return float(t if t is not None else table.get(self.rule_type, 1.0))


def rule_from_row(row) -> Rule:
    """A stored rule row (``rule_definition`` is a JSON string) -> ``Rule``."""
    d = row.asDict() if hasattr(row, "asDict") else dict(row)
    definition = d.get("rule_definition") or {}
    if isinstance(definition, str):
        definition = json.loads(definition) if definition.strip() else {}
    return Rule(rule_id=str(d.get("id") or d.get("rule_id")), rule_type=d["rule_type"],
                column=d.get("column_name") or d.get("target_column"), definition=definition,
                name=d.get("name"), severity=d.get("severity") or "medium",
                remediation=d.get("remediation_action") or "alert_only",
                dialect=d.get("dialect") or "service",
                organization_id=d.get("organization_id"), target_table=d.get("table_name")
                or d.get("target_table"), is_active=bool(d.get("is_active", True)))


def select_rules(rules: DataFrame, organization_id: str, dataset: str | None = None,
                 rule_ids: list[str] | None = None) -> DataFrame:
    """Q20: active rules of one tenant whose target is the dataset or unset
    (P13 + P16 + P17). Returns a DataFrame; the caller collects the (small,
    configuration-sized) result to compile the plan."""
    out = rules.filter((F.col("organization_id") == organization_id) & F.col("is_active"))
    if dataset is not None:
        out = out.filter((F.col("table_name") == dataset) | F.col("table_name").isNull())
    if rule_ids:
        out = out.filter(F.col("id").isin(list(rule_ids)))
    return out


def auto_rules(columns: list[str], completeness_threshold: float = 0.95) -> list[Rule]:
    """Completeness on every column, uniqueness on columns containing 'id'."""
    rules = [Rule(f"completeness_{c}", "completeness", c,
                  {"threshold": completeness_threshold}) for c in columns]
    rules += [Rule(f"uniqueness_{c}", "uniqueness", c) for c in columns if "id" in c.lower()]
    return rules


# Patterns without any operator but the anchors: ``^name$`` and ``^prefix``.
_EXACT = r"^\^[A-Za-z0-9_]+\$$"
_PREFIX = r"^\^[A-Za-z0-9_]+(\.\*)?$"


GRAM = 3


def required_literal(pattern: Column) -> Column:
    """The longest run of characters that every match of a regular expression
    contains; null where none of ``GRAM`` characters is sure. What is optional,
    repeated, grouped, escaped or a class ends a run; flags, escapes by code or
    name, alternatives outside of groups and what isn't understood give null."""
    gap = "\0"
    rest = pattern
    for what in (r"\\.", r"\[[^\]]*\]", *[r"\([^()]*\)"] * 4, r"\+[+?]?",
                 r".(?:[*?]|\{[^}]*\})[+?]?", r"[.^$]"):
        rest = F.regexp_replace(rest, what, gap)
    # (a quantifier after a quantifier, as in ``a{2}*``, is left over and not understood)
    sure = ~pattern.rlike(r"\(\?[a-zA-Z-]|\\[^dDwWsSbB\W_]|\x00") & ~rest.rlike(r"[|()\[\]{}*?]")
    longest = F.array_max(F.transform(F.split(rest, gap),
                                      lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return F.when(sure & (longest["n"] >= GRAM), longest["x"])


def match_rules(rules: DataFrame, datasets: DataFrame) -> DataFrame:
    """Which pattern rules apply to which dataset columns.

    ``rules(rule_id, table_pattern, column_pattern, data_source_types)``
    (patterns are regular expressions, NULL = any) against
    ``datasets(table_name, column_name, source_type)``.

    Table patterns are matched against the distinct table names, not against
    every column, all by equi-joins: exact patterns by the name, prefixes by
    each prefix of a name, and other expressions by the first characters of a
    literal that they require (``required_literal``), looked up among the
    trigrams of the names; only names that hold it meet the expression. What
    requires no literal (and rules for any table) meets every name, as it must:
    names are dealt out in as many parts as there are shuffle partitions and
    these rules go to each part. The matching (rule, table) pairs are then joined
    to the columns on the table name, where column pattern and source type are
    plain filters."""
    names = datasets.select("table_name").distinct()
    by = rules.withColumn("__literal", required_literal(F.col("table_pattern"))) \
        .withColumn("__kind", F.when(F.col("table_pattern").isNull(), "any")
                    .when(F.col("table_pattern").rlike(_EXACT), "exact")
                    .when(F.col("table_pattern").rlike(_PREFIX), "prefix")
                    .when(F.col("__literal").isNotNull(), "gram")
                    .otherwise("scan")) \
        .withColumn("__key", F.when(F.col("__kind") == "gram", F.left("__literal", F.lit(GRAM)))
                    .otherwise(F.regexp_replace("table_pattern", r"^\^|\$$|\.\*$", ""))) \
        .drop("__literal")
    exact = names.join(by.where("__kind = 'exact'"), F.col("table_name") == F.col("__key"))
    prefixes = names.select("table_name", F.explode(F.expr(
        "transform(sequence(1, greatest(length(table_name), 1)), n -> left(table_name, n))"))
        .alias("__start"))
    prefix = prefixes.join(by.where("__kind = 'prefix'"), F.col("__start") == F.col("__key")) \
        .drop("__start")
    grams = names.where(F.length("table_name") >= GRAM).select("table_name", F.explode(F.expr(
        f"array_distinct(transform(sequence(1, length(table_name) - {GRAM - 1}), "
        f"n -> substring(table_name, n, {GRAM})))")).alias("__gram"))
    gram = grams.join(by.where("__kind = 'gram'"), F.col("__gram") == F.col("__key")) \
        .where("table_name RLIKE table_pattern").drop("__gram")
    parts = int(datasets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = names.withColumn("__part", F.pmod(F.xxhash64("table_name"), F.lit(parts)))
    everywhere = by.where("__kind IN ('any', 'scan')").withColumn(
        "__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    rest = dealt.join(everywhere, "__part").drop("__part").where(
        "table_name IS NOT NULL AND (table_pattern IS NULL OR table_name RLIKE table_pattern)")
    pairs = exact.unionByName(prefix).unionByName(gram).unionByName(rest).drop("__kind", "__key")
    out = datasets.join(pairs, "table_name").where(
        "column_pattern IS NULL OR column_name RLIKE column_pattern")
    if "data_source_types" in rules.columns and "source_type" in datasets.columns:
        out = out.where("data_source_types IS NULL OR "
                        "array_contains(data_source_types, source_type)")
    return out
