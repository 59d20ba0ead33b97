"""Data-quality rules: spec, fused checks, reports."""

from quarry.operators.quality.checks import Check, RuleError, compile_rule, register_row_check
from quarry.operators.quality.engine import (RESULT_COLUMNS, RESULT_SCHEMA, check_record,
                                             compile_rules, failure_samples, row_flags, without_row_form,
                                             run_checks, run_rules, schema_diff)
from quarry.operators.quality.spec import Rule, auto_rules, rule_from_row, select_rules

__all__ = ["Check", "RuleError", "compile_rule", "register_row_check", "check_record",
           "failure_samples", "schema_diff", "RESULT_COLUMNS", "RESULT_SCHEMA",
           "compile_rules", "row_flags", "run_checks", "run_rules", "Rule", "auto_rules",
           "rule_from_row", "select_rules", "without_row_form"]
