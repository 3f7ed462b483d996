"""All queries of the job catalogue and their SQL."""

from __future__ import annotations

from .operators import account, account_reports, audit, candidates, catalogue, facets, history, lifecycle, page_audit, resolution, resumes, scoring, site, vacancies

FLAGSHIP = "rank_top"
MODULES = (catalogue, lifecycle, scoring, audit, candidates, vacancies, page_audit, resumes, account, facets, account_reports, history, resolution, site)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
