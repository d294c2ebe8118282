"""Schemas of the tables that operators take and return."""

PAGES = """
    run_id STRING, site_id STRING, page_index BIGINT, url STRING, raw_status INT, raw_html STRING,
    rendered_html STRING, fetch_error STRING, rendered_error STRING
"""

RESPONSES = """
    run_id STRING, site_id STRING, seq BIGINT, method STRING, url STRING, accept STRING, status INT,
    headers MAP<STRING, ARRAY<STRING>>, body STRING, bytes BIGINT, final_url STRING,
    redirect_chain ARRAY<STRUCT<from_url: STRING, to_url: STRING, status: INT, same_host: BOOLEAN>>,
    error STRING
"""

LINKS = """
    run_id STRING, site_id STRING, src_url STRING, link_idx INT, href STRING, abs_url STRING
"""

PAGE_PROFILES = """
    run_id STRING, site_id STRING, page_index BIGINT, url STRING, profile STRING, profile_ord INT,
    ok BOOLEAN, reason STRING, bytes BIGINT, chars BIGINT, tokens_est BIGINT, markdown STRING,
    artifact STRING
"""

CHECK_RESULTS = """
    run_id STRING, site_id STRING, page_index BIGINT, page_url STRING, source_ord INT, check_id STRING,
    category STRING, severity STRING, title STRING, message STRING, fix STRING, conclusion STRING,
    details MAP<STRING, STRING>
"""

FINDINGS = """
    run_id STRING, site_id STRING, seq BIGINT, finding_id STRING, title STRING, severity STRING,
    source STRING, evidence STRING, affected_profiles ARRAY<STRING>, fix_hint STRING, page_url STRING,
    occurrences BIGINT, conclusion STRING
"""

RUN_EVENTS = """
    run_id STRING, seq BIGINT, ts TIMESTAMP, type STRING, url STRING, page_index BIGINT, profile STRING,
    ok BOOLEAN, chars BIGINT, tokens_est BIGINT, js_gated DOUBLE, pages ARRAY<STRING>, source STRING,
    capped BOOLEAN, message STRING
"""

# One JSON document per finished run, as exported snapshots carry it.
RUN_DOCUMENT = """
    id STRING, status STRING, errorMessage STRING,
    result STRUCT<
        id: STRING, status: STRING, startedAt: BIGINT, finishedAt: BIGINT, errorMessage: STRING,
        config: STRUCT<rootUrl: STRING, cap: BIGINT>,
        siteStats: STRUCT<pagesScanned: BIGINT, source: STRING, capped: BOOLEAN,
            avgJsGatedFraction: DOUBLE, avgTokensClaudePerProfile: MAP<STRING, DOUBLE>, fixBacklog: BIGINT>,
        fixes: ARRAY<STRUCT<id: STRING, title: STRING, severity: STRING, source: STRING,
            evidence: STRING, fixHint: STRING, pageUrl: STRING, occurrences: BIGINT>>,
        pages: ARRAY<STRUCT<url: STRING,
            profiles: MAP<STRING, STRUCT<id: STRING, ok: BOOLEAN, reason: STRING, bytes: BIGINT,
                chars: BIGINT, tokensClaude: BIGINT, markdown: STRING, rawArtifact: STRING,
                screenshot: STRING, durationMs: BIGINT>>,
            diff: STRUCT<largestProfile: STRING, charsFraction: MAP<STRING, DOUBLE>, jsGatedFraction: DOUBLE>>>
    >
"""
