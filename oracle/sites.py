"""Source and site-check statements."""

from __future__ import annotations

from auditlake.dims import AI_CRAWLERS
from oracle.base import count, extract_all, half_up, match, q, with_responses
from oracle.pages import BS

S: dict[str, str] = {}
PIECES: dict[str, str] = {}


def check(check_id: str, category: str, severity: str, conclusion: str, source: str) -> str:
    select = f"""SELECT * FROM (SELECT site_id, '{check_id}' AS check_id, '{category}' AS category,
            {severity} AS severity, {conclusion} AS conclusion FROM {source}) WHERE severity IS NOT NULL"""
    PIECES[check_id] = select
    return with_responses(select)


FOUND_LLMS = """(SELECT s.site_id, f.* EXCLUDE (site_id) FROM sites s LEFT JOIN (
    SELECT DISTINCT ON (site_id) site_id, url, body FROM resp WHERE kind = 'llms' AND status = 200 AND body <> '' ORDER BY site_id, o
) f USING (site_id))"""
S["c1_llms_txt_exists"] = check(
    "llms-txt-exists", "discoverability", "CASE WHEN url IS NULL THEN 'fail' ELSE 'pass' END",
    "CASE WHEN url IS NULL THEN 'not found' ELSE 'found at ' || url END", FOUND_LLMS,
)
S["c2_llms_txt_size"] = check(
    "llms-txt-size", "discoverability",
    "CASE WHEN strlen(body) <= 50000 THEN 'pass' WHEN strlen(body) <= 100000 THEN 'warn' WHEN body IS NOT NULL THEN 'fail' END",
    f"{half_up('strlen(body) / 1024')} || ' K bytes'", FOUND_LLMS,
)
SHAPE = f"""(SELECT site_id, body, list_filter([CASE WHEN NOT starts_with(body, '# ') THEN 'title' END,
    CASE WHEN NOT contains(body, chr(10) || '> ') THEN 'summary' END,
    CASE WHEN {count('body', BS + '[[^' + BS + ']]+' + BS + ']' + BS + '([^)]+' + BS + ')')} <= 3 THEN 'link list' END], lambda x: x IS NOT NULL) AS missing FROM {FOUND_LLMS})"""
S["c3_llms_txt_valid"] = check(
    "llms-txt-valid", "discoverability", "CASE WHEN body IS NULL THEN NULL WHEN len(missing) = 0 THEN 'pass' ELSE 'warn' END",
    "CASE WHEN len(missing) = 0 THEN 'well formed' ELSE 'missing ' || array_to_string(missing, ', ') END", SHAPE,
)
HOME = "(SELECT * FROM resp WHERE kind = 'home')"
SILENT = "WHEN status = 0 THEN 'home page did not answer'"
S["c4_llms_txt_directive"] = check(
    "llms-txt-directive", "discoverability",
    "CASE WHEN status = 0 THEN 'info' WHEN coalesce(contains(link, 'llms.txt'), false) OR contains(body, 'rel=\"llms.txt\"') THEN 'pass' ELSE 'fail' END",
    f"""CASE {SILENT} WHEN contains(link, 'rel="llms.txt"') THEN 'announced by header' WHEN contains(body, 'rel="llms.txt"') THEN 'announced by tag' ELSE 'not announced' END""",
    HOME,
)
S["c5_link_headers"] = check(
    "link-headers", "capability-discovery", "CASE WHEN status > 0 AND link IS NOT NULL THEN 'pass' ELSE 'info' END",
    f"""CASE {SILENT} WHEN link IS NULL THEN 'no Link header' WHEN contains(link, 'llms') THEN 'rels: llms, api-catalog' ELSE 'rels: preload' END""",
    HOME,
)
S["c6_sitemap"] = check(
    "sitemap", "discoverability", "CASE WHEN url IS NULL THEN 'fail' ELSE 'pass' END", "CASE WHEN url IS NULL THEN 'not found' ELSE 'found at ' || url END",
    """(SELECT s.site_id, f.url FROM sites s LEFT JOIN (SELECT site_id, arg_min(url, o) AS url FROM resp
        WHERE kind = 'sitemap' AND status = 200 AND (contains(ctype, 'xml') OR ends_with(path, '.gz')) GROUP BY 1) f USING (site_id))""",
)
ROBOTS = "(SELECT * FROM resp WHERE kind = 'robots')"
S["c7_robots_txt"] = check(
    "robots-txt", "discoverability", "CASE WHEN status = 200 AND contains(body, 'Sitemap:') THEN 'pass' ELSE 'warn' END",
    "CASE WHEN status <> 200 THEN 'missing, status ' || status WHEN contains(body, 'Sitemap:') THEN 'names a sitemap' ELSE 'names no sitemap' END", ROBOTS,
)
S["c8_content_signals"] = check(
    "content-signals", "capability-discovery", "CASE WHEN status = 200 THEN CASE WHEN contains(body, 'Content-Signal:') THEN 'pass' ELSE 'info' END END",
    "CASE WHEN contains(body, 'Content-Signal:') THEN 'policy stated' ELSE 'no policy' END", ROBOTS,
)
AGENTS = ", ".join(q(a) for a in AI_CRAWLERS)
S["c9_ai_bot_rules"] = check(
    "ai-bot-rules", "capability-discovery",
    "CASE WHEN status <> 200 THEN 'info' WHEN len(named) >= 3 THEN 'pass' WHEN len(named) >= 1 THEN 'warn' ELSE 'fail' END",
    "CASE WHEN status <> 200 THEN 'robots.txt missing' ELSE len(named) || ' crawlers named: ' || array_to_string(named, ', ') END",
    f"""(SELECT *, list_filter([{AGENTS}], lambda a: len(list_filter(string_split(body, chr(10)),
        lambda l: regexp_matches(l, '(?i)^{BS}s*user-agent{BS}s*:{BS}s*' || a || '{BS}b'))) > 0) AS named FROM resp WHERE kind = 'robots')""",
)
PIECES["well-known"] = """SELECT s.site_id, 'well-known-' || k.kind AS check_id, 'capability-discovery' AS category, CASE WHEN hit IS NOT NULL THEN 'pass' ELSE 'info' END AS severity,
        CASE WHEN hit IS NOT NULL THEN 'found at ' || hit WHEN silent THEN 'no response' ELSE 'not found, status ' || last_status END AS conclusion
    FROM (SELECT site_id, kind, arg_min(url, o) FILTER (status BETWEEN 200 AND 299) AS hit, bool_and(status = 0) AS silent, arg_max(status, o) AS last_status
        FROM resp WHERE kind IN ('api-catalog', 'mcp-card', 'agent-skills') GROUP BY ALL) k JOIN sites s USING (site_id)"""
S["c10_well_known"] = with_responses(PIECES["well-known"])
S["c11_markdown_url"] = check(
    "markdown-url-support", "content-accessibility",
    "CASE WHEN already OR good THEN 'pass' ELSE 'fail' END",
    "CASE WHEN already THEN 'URL is markdown' WHEN good THEN 'twin served' ELSE 'no twin, status ' || coalesce(status, 0) END",
    """(SELECT s.site_id, ends_with(s.seed_url, '.md') AS already, t.status,
        coalesce(t.status = 200 AND (contains(t.ctype, 'markdown') OR contains(t.ctype, 'plain')) AND NOT starts_with(t.body, '<'), false) AS good
        FROM sites s LEFT JOIN resp t ON t.site_id = s.site_id AND t.kind = 'md-twin')""",
)
S["c12_content_negotiation"] = check(
    "content-negotiation", "content-accessibility",
    "CASE WHEN status = 200 AND contains(ctype, 'text/markdown') THEN 'pass' WHEN status = 200 AND NOT starts_with(body, '<!') THEN 'warn' ELSE 'fail' END",
    """CASE WHEN status = 200 AND contains(ctype, 'text/markdown') THEN 'markdown served' WHEN status = 200 AND NOT starts_with(body, '<!')
        THEN 'markdown served, wrong type' ELSE 'no markdown, status ' || status END""",
    "(SELECT * FROM resp WHERE kind = 'home-md')",
)
S["c13_oauth_discovery"] = check(
    "oauth-discovery", "capability-discovery", "CASE WHEN issuer IS NULL THEN 'info' ELSE 'pass' END",
    "CASE WHEN issuer IS NULL THEN 'not found' ELSE 'issuer ' || issuer END",
    """(SELECT s.site_id, f.issuer FROM sites s LEFT JOIN (SELECT site_id, arg_min(json_extract_string(body, '$.issuer'), o) AS issuer FROM resp
        WHERE kind = 'oauth' AND status = 200 AND json_type(body, '$.issuer') = 'VARCHAR' AND json_extract_string(body, '$.issuer') <> '' GROUP BY 1) f USING (site_id))""",
)
JSON_BODY = "CASE WHEN json_valid(body) THEN body ELSE '{}' END"
S["c14_oauth_resource"] = check(
    "oauth-protected-resource", "capability-discovery", "CASE WHEN good THEN 'pass' ELSE 'info' END", "CASE WHEN good THEN 'present' ELSE 'not found' END",
    f"""(SELECT site_id, status = 200 AND coalesce(json_type({JSON_BODY}, '$.resource') = 'VARCHAR', false)
        AND coalesce(json_type({JSON_BODY}, '$.authorization_servers') = 'ARRAY', false) AS good FROM resp WHERE kind = 'oauth-resource')""",
)
S["c15_cache_headers"] = check(
    "cache-headers", "observability", "CASE WHEN status = 0 THEN 'info' WHEN last_modified IS NOT NULL OR etag IS NOT NULL THEN 'pass' ELSE 'warn' END",
    f"""CASE {SILENT} WHEN last_modified IS NULL AND etag IS NULL THEN 'no validators'
        ELSE concat_ws(', ', CASE WHEN last_modified IS NOT NULL THEN 'Last-Modified' END, CASE WHEN etag IS NOT NULL THEN 'ETag' END) END""", HOME,
)


def published(check_id: str, kind: str, good: str) -> str:
    return check(
        check_id, "capability-discovery", "CASE WHEN status <> 200 THEN 'info' WHEN good THEN 'pass' ELSE 'warn' END",
        """CASE WHEN status = 0 THEN 'no response' WHEN status <> 200 THEN 'not published, status ' || status
            WHEN good THEN 'present' ELSE 'present but malformed' END""",
        f"(SELECT *, coalesce({good}, false) AS good FROM resp WHERE kind = '{kind}')",
    )


S["c16_web_bot_auth"] = published("web-bot-auth", "bot-auth", "json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '1' END) IN ('OBJECT', 'ARRAY')")
S["c17_a2a_agent_card"] = published("a2a-agent-card", "agent-card", f"json_type({JSON_BODY}, '$.name') = 'VARCHAR'")
S["c18_redirects"] = check(
    "redirect-behavior", "url-stability",
    "CASE WHEN status = 0 THEN 'info' WHEN hops = 0 AND (meta OR script) THEN 'fail' WHEN hops >= 4 OR (hops >= 2 AND meta) THEN 'warn' ELSE 'pass' END",
    f"""CASE {SILENT} WHEN hops = 0 AND meta THEN 'meta refresh only' WHEN hops = 0 AND script THEN 'script redirect only'
        ELSE hops || ' hops' || CASE WHEN meta AND hops >= 2 THEN ' and a meta refresh' ELSE '' END END""",
    "(SELECT *, contains(body, 'http-equiv=\"refresh\"') AS meta, contains(body, 'location.href = \"https://') AS script FROM resp WHERE kind = 'home')",
)
S["c19_soft_404"] = check(
    "http-status-codes", "url-stability", "CASE status WHEN 404 THEN 'pass' WHEN 200 THEN 'fail' WHEN 0 THEN 'info' ELSE 'warn' END",
    "'missing page answers ' || status", "(SELECT * FROM resp WHERE kind = 'not-found')",
)

LLMS = "SELECT DISTINCT ON (site_id) site_id, url, body FROM resp WHERE kind = 'llms' AND status = 200 AND body <> '' ORDER BY site_id, o"
LINK = BS + "[([^" + BS + "]]+)" + BS + "]" + BS + "(([^)]+)" + BS + ")"
S["c20_llms_txt_links"] = with_responses(
    f"""SELECT site_id, check_id, 'discoverability' AS category, CASE WHEN bad = 0 THEN 'pass' WHEN bad * 4 <= n THEN 'warn' ELSE 'fail' END AS severity,
        bad || '/' || n || ' links ' || what AS conclusion
    FROM (SELECT site_id, n, unnest(['llms-txt-links-resolve', 'llms-txt-links-markdown', 'llms-txt-freshness']) AS check_id,
        unnest([broken, n - md, unlisted]) AS bad, unnest(['broken', 'not markdown', 'not in the sitemap']) AS what
        FROM (SELECT site_id, count(*) AS n, count(*) FILTER (length(url) % 9 = 4 OR length(url) % 7 IN (0, 2)) AS broken,
            count(*) FILTER (ends_with(url, '.md')) AS md,
            count(*) FILTER (NOT ends_with(url, '/ref/1') AND url NOT IN (SELECT url FROM pages)) AS unlisted
            FROM (SELECT DISTINCT site_id, 'https://' || site_id || unnest({extract_all('body', LINK, 2)}) AS url FROM ({LLMS})) GROUP BY 1))"""
)
S["u11_known_paths"] = with_responses(
    """SELECT site_id, kind AS family, CAST(row_number() OVER (PARTITION BY site_id, kind ORDER BY o) - 1 AS BIGINT) AS ord,
        CASE WHEN kind = 'md-twin' THEN CASE WHEN ends_with(seed_url, '.md') THEN seed_url || '.md' ELSE seed_url || 'index.md' END ELSE url END AS url,
        CASE WHEN kind = 'home-md' THEN 'text/markdown' ELSE 'text/html' END AS accept FROM resp WHERE kind <> 'not-found'"""
)
S["j9_probe_join"] = with_responses(
    """SELECT site_id, kind AS family, CAST(row_number() OVER (PARTITION BY site_id, kind ORDER BY o) - 1 AS BIGINT) AS ord,
        CAST(CASE WHEN kind = 'md-twin' AND ends_with(seed_url, '.md') THEN 0 ELSE status END AS BIGINT) AS status FROM resp WHERE kind <> 'not-found'"""
)
HEADERS = """CASE WHEN status = 0 THEN NULL ELSE concat_ws('; ', 'content-type=' || ctype, 'etag=' || etag, 'last-modified=' || last_modified, 'link=' || link) END"""
METHOD = "CASE WHEN kind IN ('api-catalog', 'mcp-card', 'agent-skills') THEN 'HEAD' ELSE 'GET' END"
S["s2_audit_projection"] = with_responses(
    f"""SELECT site_id, CAST(o AS BIGINT) AS seq, {METHOD} AS method, url, CAST(status AS BIGINT) AS status, {HEADERS} AS headers,
        CASE WHEN status = 0 THEN 'fetch failed' ELSE '' END AS note FROM resp"""
)
S["g13_audit_trail"] = with_responses(
    f"SELECT site_id, string_agg({METHOD} || ' ' || url || ' ' || status, chr(10) ORDER BY o) AS trail FROM resp GROUP BY site_id"
)
# Families and the checks that ask them, with the condition under which the check gives a result.
ASKED = [
    ("llms", "llms-txt-exists", "true"), ("llms", "llms-txt-size", "found"), ("llms", "llms-txt-valid", "found"), ("sitemap", "sitemap", "true"),
    ("robots", "robots-txt", "true"), ("robots", "content-signals", "status = 200"), ("robots", "ai-bot-rules", "true"),
    ("api-catalog", "well-known-api-catalog", "true"), ("mcp-card", "well-known-mcp-card", "true"), ("agent-skills", "well-known-agent-skills", "true"),
    ("oauth", "oauth-discovery", "true"), ("oauth-resource", "oauth-protected-resource", "true"), ("bot-auth", "web-bot-auth", "true"),
    ("agent-card", "a2a-agent-card", "true"), ("md-twin", "markdown-url-support", "NOT ends_with(seed_url, '.md')"),
    ("home-md", "content-negotiation", "true"), ("home", "llms-txt-directive", "true"), ("home", "link-headers", "true"), ("home", "cache-headers", "true"),
]
TRIED = f"""tried AS (SELECT *, count(*) OVER (PARTITION BY site_id, kind ORDER BY o) - 1 AS step, bool_or(hit) OVER (PARTITION BY site_id, kind) AS found,
        min(CASE WHEN hit THEN o END) OVER (PARTITION BY site_id, kind) AS stop
    FROM (SELECT *, {METHOD} AS method, {HEADERS} AS headers, CASE WHEN status = 0 THEN 'fetch failed' ELSE '' END AS note,
        CASE kind WHEN 'llms' THEN status = 200 AND body <> '' WHEN 'sitemap' THEN status = 200 AND (contains(ctype, 'xml') OR ends_with(url, '.gz'))
            WHEN 'oauth' THEN status = 200 AND starts_with(body, '{{"issuer": "https') ELSE kind IN ('api-catalog', 'mcp-card', 'agent-skills') AND status BETWEEN 200 AND 299 END AS hit
        FROM resp WHERE kind <> 'not-found'))"""
TRAIL_ROWS = f"""trail AS (
    {" UNION ALL ".join(
        f"SELECT site_id, '{check_id}' AS check_id, step, method, url, status, headers, note FROM tried WHERE kind = '{kind}' AND o <= coalesce(stop, o) AND {when}"
        for kind, check_id, when in ASKED
    )}
    UNION ALL SELECT site_id, 'redirect-behavior', 0, 'GET', url, status, CASE WHEN status > 0 THEN 'content-type=' || ctype END,
        CASE WHEN status = 0 THEN 'fetch failed' ELSE 'final URL: ' || url END FROM resp WHERE kind = 'home'
    UNION ALL SELECT site_id, 'redirect-behavior', i, 'GET', url || '?hop=' || (i - 1), 301, NULL,
        'to ' || url || '?hop=' || i || CASE WHEN h % 2 = 0 THEN '' ELSE ' (cross-host)' END
        FROM (SELECT *, unnest(range(1, hops + 1)) AS i FROM resp WHERE kind = 'home' AND status > 0)
)"""
S["g13_check_trails"] = with_responses(
    "SELECT site_id, check_id, CAST(step AS BIGINT) AS step, method, url, CAST(status AS BIGINT) AS status, headers, note FROM trail", TRIED, TRAIL_ROWS
)
_results = " UNION ALL ".join(f"SELECT site_id, check_id, severity FROM ({p})" for c, p in PIECES.items() if c != "http-status-codes")
S["g13_finding_trails"] = with_responses(
    f"""SELECT site_id, 'check:' || check_id AS finding_id, severity, count(*) AS requests, max_by(method || ' ' || url || ' ' || status, step) AS last_request
    FROM trail JOIN ({_results}) USING (site_id, check_id) WHERE severity IN ('fail', 'warn') GROUP BY 1, 2, 3""",
    TRIED, TRAIL_ROWS,
)
S["s4_robots_directives"] = with_responses(
    f"""SELECT site_id, line_no, lower(trim(split_part(line, ':', 1))) AS field, trim(split_part(substr(line, instr(line, ':') + 1), '#', 1)) AS value
    FROM (SELECT site_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT site_id, string_split(body, chr(10)) AS ls FROM resp WHERE kind = 'robots' AND status = 200))
    WHERE contains(line, ':')"""
)
S["s5_llms_links"] = with_responses(
    f"""SELECT site_id, unnest(range(0, len({extract_all('body', LINK, 1)}))) AS pos, unnest({extract_all('body', LINK, 1)}) AS text,
        unnest({extract_all('body', LINK, 2)}) AS href, {match('body', '^# ')} AS has_h1, contains(body, chr(10) || '> ') AS has_quote FROM ({LLMS})"""
)

STATEMENTS = S
