"""Queries by name, and the SQL of those that have it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


#: The view of candidates, their roles and skills, as SQL.
CANDIDATES = """WITH base AS (SELECT c_custkey AS candidate_ref, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 500) END AS years,
CASE c_mktsegment WHEN 'BUILDING' THEN 'citizen' WHEN 'MACHINERY' THEN 'permanent_resident' WHEN 'AUTOMOBILE' THEN 'requires_sponsorship' WHEN 'FURNITURE' THEN 'visa_unrestricted' END AS rights,
CASE WHEN c_nationkey % 3 = 0 THEN 'Clearance of nation ' || c_nationkey END AS clearance,
CASE WHEN c_acctbal > 5000 THEN floor((c_acctbal - 5000) / 1000) END AS management FROM customer),
p AS (SELECT *, CASE WHEN rights IS NOT NULL THEN rights <> 'requires_sponsorship' END AS unrestricted FROM base),
r AS (SELECT o_custkey AS candidate_ref, o_orderkey AS role_id, o_orderdate AS began, o_orderpriority AS title, o_orderdate >= TIMESTAMP '2001-01-01' AS is_current,
CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 5000) END AS months,
CASE WHEN o_orderstatus <> 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'executive' WHEN '2-HIGH' THEN 'senior' WHEN '3-MEDIUM' THEN 'mid' WHEN '4-NOT SPECIFIED' THEN 'junior' WHEN '5-LOW' THEN 'graduate' END END AS seniority,
CASE o_orderstatus WHEN 'F' THEN 'permanent' WHEN 'O' THEN 'contract' END AS employment_type FROM orders),
s AS (SELECT o_custkey AS candidate_ref, p_name AS name, CASE l_returnflag WHEN 'R' THEN 'tool' WHEN 'A' THEN 'technical' ELSE 'soft' END AS category,
CASE WHEN l_quantity > 5 THEN floor(l_quantity / 5) END AS years, CASE WHEN l_linestatus = 'F' THEN 'expert' ELSE 'beginner' END AS proficiency
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
