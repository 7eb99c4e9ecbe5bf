"""Registered queries and, where SQL can express them, the SQL to compare them with."""

from gridloom.plans import fleet_plans, grade_plans, measure_plans, rule_plans, run_plans, source_plans, token_plans, usage_plans

MODULES = [token_plans, usage_plans, grade_plans, run_plans, fleet_plans, source_plans, rule_plans, measure_plans]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
