"""Registered queries and their SQL, by module."""

from chartlake.plans import charts, entities, names, problems

MODULES = (problems, charts, entities, names)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
