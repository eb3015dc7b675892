"""All queries of the library outside the llm subpackage, by name, and the SQL they are compared with."""

from __future__ import annotations

from factlattice.plans import core_problems as core
from factlattice.plans import core_sql, files, forms, more, relational, scalars

QUERIES = {n: getattr(core, n) for n in ("p1_found", "p1_values", "p3_found", "p3_totals", "p4_found", "p4_history",
    "p5_found")} | relational.query.queries | scalars.query.queries | forms.query.queries | more.query.queries | files.query.queries
SQL = core_sql.SQL | relational.query.sql | scalars.query.sql | forms.query.sql | more.query.sql | files.query.sql
