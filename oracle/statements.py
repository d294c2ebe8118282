"""All oracle statements by query name."""

from oracle import flows, pages, results, sites

STATEMENTS: dict[str, str] = {**pages.STATEMENTS, **sites.STATEMENTS, **results.STATEMENTS, **flows.STATEMENTS}
