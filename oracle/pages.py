"""URL, text, extraction and page-check statements."""

from __future__ import annotations

from auditlake.functions import html as H
from auditlake.functions.text import WS, WS_SAME_LINE
from auditlake.plans.queries import FINDING_IDS, JSON_VARIANTS
from auditlake.dims import RUBRIC
from oracle.base import (
    attr, body_of, collapse, count, decode, extract, extract_all, first_text, half_up, js_trim, markdown, match,
    no_comments, q, rx, strip, tokens, untag, utf16, visible, with_pages, with_profiles, with_responses,
)

S: dict[str, str] = {}
BS = chr(92)

# ------------------------------------------------------------------ URLs

SPLIT = r"(?i)^(https?)://([^/?#\\]+)([^?#]*)(\?[^#]*)?"


def parts(u: str) -> dict[str, str]:
    scheme = f"lower({extract(u, SPLIT, 1)})"
    host = f"lower({extract(u, SPLIT, 2)})"
    port = f"CASE WHEN {scheme} = 'http' THEN ':80' ELSE ':443' END"
    authority = f"(CASE WHEN ends_with({host}, {port}) THEN left({host}, length({host}) - length({port})) ELSE {host} END)"
    path = f"(CASE WHEN {extract(u, SPLIT, 3)} = '' THEN '/' ELSE {extract(u, SPLIT, 3)} END)"
    return {
        "scheme": scheme, "authority": authority, "path": path, "query": extract(u, SPLIT, 4),
        "origin": f"({scheme} || '://' || {authority})", "bare": f"rtrim({extract(u, SPLIT, 3)}, '/')",
    }


U = parts("url")
NORMAL = f"{U['origin']} || CASE WHEN {U['bare']} = '' THEN '/' ELSE {U['bare']} END || {U['query']}"
STRIPPED = f"(CASE WHEN ends_with({U['path']}, '/') THEN left({U['path']}, length({U['path']}) - 1) ELSE {U['path']} END)"
HOST = rx(U["authority"], r":[0-9]+\z")

S["u1_normalize_url"] = f"SELECT page_id, {NORMAL} AS norm_url FROM pages"
S["u3_origin_of"] = f"SELECT page_id, {U['origin']} AS origin FROM pages"
S["u4_host_of"] = f"SELECT page_id, {HOST} AS host FROM pages"
S["u5_path_of"] = f"SELECT page_id, CASE WHEN {STRIPPED} = '' THEN '/' ELSE {STRIPPED} END AS path FROM pages"
S["u6_host_and_path"] = f"SELECT page_id, {U['authority']} || CASE WHEN {U['path']} = '/' THEN '' ELSE {U['path']} END AS host_and_path FROM pages"
S["u7_under_prefix"] = f"""SELECT page_id, {U['bare']} = '/en' OR starts_with({U['bare']}, '/en/') AS under_en,
    {U['bare']} = '/e' OR starts_with({U['bare']}, '/e/') AS under_e, true AS under_root FROM pages"""
S["u8_bfs_in_scope"] = f"""SELECT page_id, starts_with({U['bare']}, '/e') AS scope_e,
    {U['authority']} = 'm.ththth.example.net' AS scope_other FROM pages"""
S["u9_md_variant"] = f"""SELECT page_id, {U['origin']} || CASE WHEN {U['path']} = '/' THEN '/index' ELSE {STRIPPED} END || '.md' || {U['query']} AS md_url,
    ends_with({U['path']}, '.md') AS is_md FROM pages"""

LINKS = f"""links AS MATERIALIZED (
    SELECT site_id, page_index, src_url, raw_ok, unnest(range(0, len(hs))) AS link_idx, unnest(hs) AS href FROM (
        SELECT site_id, page_index, url AS src_url, fetch_error IS NULL AND raw_status BETWEEN 200 AND 399 AS raw_ok,
            list_transform({extract_all(strip(no_comments('raw_html'), 'script', 'style', 'noscript'), H.HREF)}, lambda h: {decode(f"trim(h, '{chr(34)}''')")}) AS hs
        FROM crawl)
)"""


def encoded(s: str, keep: str) -> str:
    """Percent encoding of every character outside ``keep``."""
    bytes_of = rx("hex(encode(c))", "(..)", r"%\1")
    return (
        f"array_to_string(list_transform(string_split({s}, ''), "
        f"lambda c: CASE WHEN regexp_full_match(c, {q(keep)}) OR c = '' THEN c ELSE {bytes_of} END), '')"
    )


KEEP_PATH = r"[!#-;=?-\]_a-z|~]"
KEEP_QUERY = r"[!#-&(-;=?-~]"
B = parts("src_url")
# Only the forms that occur: absolute, protocol-relative, rooted, fragment, mail and relative.
RESOLVED = f"""absolute AS (
    SELECT *, CASE WHEN starts_with(href, 'mailto:') THEN NULL
        WHEN starts_with(href, '#') THEN split_part(src_url, '#', 1) || href
        WHEN starts_with(href, 'http') THEN href
        WHEN starts_with(href, '//') THEN {B['scheme']} || ':' || href
        WHEN starts_with(href, '/') THEN {B['origin']} || href
        ELSE {B['origin']} || {extract(B['path'], '^(.*/)')} || href END AS full_url
    FROM links
), resolved AS (
    SELECT * EXCLUDE (full_url), CASE WHEN full_url IS NULL THEN href ELSE {parts('full_url')['origin']} || {encoded(
        f'''CASE WHEN contains(full_url, '/.') THEN
            list_reduce(string_split(substr({parts('full_url')['path']}, 2), '/'), lambda done, seg: CASE seg WHEN '..' THEN {rx('done', '/[^/]*' + BS + 'z')} WHEN '.' THEN done ELSE done || '/' || seg END, '')
            ELSE {parts('full_url')['path']} END''', KEEP_PATH)} || {encoded(parts('full_url')['query'], KEEP_QUERY)} || {extract('full_url', '(#.*)')} END AS abs_url
    FROM absolute
)"""
S["u2_resolve_href"] = f"""WITH {with_pages('')[5:]}, {LINKS}, {RESOLVED} SELECT page_index, link_idx, href, abs_url FROM resolved"""
NAV_CRAWL = "href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'mailto:') AND NOT starts_with(href, 'javascript:')"
NAV_CHECK = f"href <> '' AND NOT starts_with(href, '#') AND NOT {match('lower(href)', '^(mailto|tel|javascript):')}"
S["u10_href_is_navigable"] = f"""WITH {with_pages('')[5:]}, {LINKS}
    SELECT page_index, link_idx, {NAV_CRAWL} AS crawl, {NAV_CHECK} AS checked FROM links"""

# ------------------------------------------------------------------ text, numbers, JSON

S["t1_lengths"] = f"SELECT doc_id, {utf16('text')} AS utf16, strlen(text) AS bytes FROM documents"
S["t2_tokens_est"] = f"SELECT doc_id, {tokens(utf16('text'))} AS tokens FROM documents"
S["t3_collapse_ws"] = f"SELECT doc_id, md5({collapse('text')}) AS collapsed_md5, length({collapse('text')}) AS chars FROM documents"
S["t4_clamp01"] = """SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE least(greatest((value - 20) / 100, 0.0), 1.0) END, 6) AS share FROM events"""
S["t5_kb_k"] = f"SELECT doc_id, {half_up('strlen(text) / 1024')} AS kb, {half_up('n_chars / 1000')} AS k FROM documents"


def chars_label(n: str) -> str:
    # An exact tie (xx50) is decided by the stored double against the decimal.
    up = f"({n} % 100 > 50 OR ({n} % 100 = 50 AND CAST({n} / 1000 * 4503599627370496 AS HUGEINT) * 1000 >= CAST({n} AS HUGEINT) * 4503599627370496))"
    tenth = f"({n} // 100 + CASE WHEN {up} THEN 1 ELSE 0 END)"
    return f"""CASE WHEN {n} >= 10000 THEN {half_up(f'{n} / 1000')} || 'k' WHEN {n} >= 1000
        THEN ({tenth} // 10) || '.' || ({tenth} % 10) || 'k' ELSE CAST({n} AS VARCHAR) END"""


S["t6_format_chars"] = f"SELECT event_id, {chars_label('(event_id * 7)')} AS label, {chars_label('event_id')} AS small_label FROM events"
S["t7_format_duration"] = f"""SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms'
        WHEN tenths < 600 THEN (tenths // 10) || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || (tenths % 10) END || 's'
        ELSE (tenths // 600) || 'm ' || {half_up('(tenths % 600) / 10')} || 's' END AS label
    FROM (SELECT event_id, event_id * 37 AS ms, {half_up('event_id * 37 / 100')} AS tenths FROM events)"""
START = rf"(?s)^(.*?)\n(?:#{WS}|##{WS}|[A-Za-z0-9][^\n\r\x{{2028}}\x{{2029}}]{{40}})"
S["t8_content_start_pct"] = f"""WITH {with_pages('')[5:]}, texts AS (
        SELECT 'document' AS kind, doc_id AS id, text AS md FROM documents
        UNION ALL SELECT 'page', page_index, {markdown('raw_html')} FROM crawl)
    SELECT kind, id, CASE WHEN md = '' OR NOT {match('chr(10) || md', START)} THEN 100
        ELSE {half_up(f"{utf16(extract('chr(10) || md', START))} / {utf16('md')} * 100")} END AS start_pct
    FROM texts"""


def ratio(html: str) -> str:
    return f"round(CASE WHEN {html} = '' THEN 0.0 ELSE floor({utf16(visible(html, 'script', 'style', 'noscript'))} / {utf16(html)} * 100 + 0.5) / 100 END, 6)"


S["t9_text_to_markup_ratio"] = with_pages(f"SELECT page_index, {ratio('raw_html')} AS raw_ratio, {ratio('rendered_html')} AS rendered_ratio FROM crawl")
S["t10_is_valid_json"] = f"SELECT event_id, event_id % 8 IN (0, 3, 5) AS valid, event_id % 8 IN (0, 3, 5) AND json_valid({JSON_VARIANTS}) AS valid_exact FROM events"
S["t11_bare_id"] = f"""SELECT event_id, CASE WHEN contains(f, ':') THEN substr(f, instr(f, ':') + 1) ELSE f END AS bare
    FROM (SELECT event_id, {FINDING_IDS} AS f FROM events)"""
S["t12_summarize_error"] = f"""SELECT doc_id, md5(coalesce(nullif(substr(coalesce(
        list_filter(list_transform(string_split(noisy, chr(10)), lambda l: {js_trim('l')}), lambda l: l <> '' AND NOT {match('l', '^' + BS + '[[0-9]{4}/[0-9]{6}' + BS + '.[0-9]+:[A-Z]+:')})[1],
        noisy), 1, 200), ''), 'render failed')) AS summary_md5
    FROM (SELECT doc_id, '[0101/120000.123:ERROR:gpu.cc(1)] lost' || chr(10) || '  ' || chr(10) || text AS noisy FROM documents)"""
S["t13_pct"] = f"SELECT doc_id, {half_up('n_chars / nullif(strlen(text), 0) * 100')} AS pct FROM documents"

# ------------------------------------------------------------------ page extraction


def raw(select: str) -> str:
    return with_pages(f"SELECT page_index, {select} FROM crawl")


def list_text(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda z: CAST(z AS VARCHAR)), ',')"


QUIET = strip(no_comments("raw_html"), "script", "style", "noscript", "nav", "header", "footer")
S["x1_strip_elements"] = raw(f"md5({strip(no_comments('raw_html'), 'script', 'style', 'nav')}) AS stripped_md5")
S["x2_visible_text"] = raw(f"md5({visible('raw_html')}) AS text_md5, {utf16(visible('raw_html'))} AS chars")
S["x3_html_to_markdown"] = with_pages(f"SELECT page_index, md5(md) AS md_md5, {utf16('md')} AS chars FROM (SELECT page_index, {markdown('rendered_html')} AS md FROM crawl)")
S["x4_content_body"] = with_pages(f"""SELECT page_index, md5(CASE WHEN {match('kept', '(?i)<(main|article)' + BS + 'b')}
        THEN {extract('kept', r'(?is)<(?:main|article)(?:[\s/][^<>]*)?>(.*?)(?:</(?:main|article)\s*>|\z)')} ELSE {body_of('kept')} END) AS body_md5
    FROM (SELECT page_index, {QUIET} AS kept FROM crawl)""")
SNIP = "SELECT * FROM snip"


def map_text(entries: str) -> str:
    return f"array_to_string(list_sort(list_transform({entries}, lambda e: e.k || '=' || e.v)), '; ')"


# Snippets of every raw page, whatever its status.
S["x5_snippet"] = with_profiles(f"""SELECT page_index, title, description, first_h1, preview, {map_text('og')} AS og,
    {map_text('twitter')} AS twitter, array_to_string(json_ld, ',') AS json_ld FROM snip""")
S["x6_snippet_markdown"] = with_profiles("SELECT page_index, snippet_md AS markdown FROM wide")
A = parts("abs_url")
S["x7_links"] = f"""WITH {with_pages('')[5:]}, {LINKS}, {RESOLVED}
    SELECT site_id, page_index, link_idx, href, {A['origin']} || CASE WHEN {A['bare']} = '' THEN '/' ELSE {A['bare']} END || {A['query']} AS abs_url
    FROM resolved WHERE {NAV_CRAWL}"""
MD = with_pages(f"SELECT page_index, {markdown('raw_html')} AS md FROM crawl")
S["x8_markdown_headings"] = f"SELECT page_index, {list_text(f'list_transform({extract_all(f"chr(10) || md", f"{BS}n(#{{1,6}}){WS_SAME_LINE}")}, lambda m: length(m))')} AS levels FROM ({MD})"
S["x9_html_headings"] = raw(f"array_to_string({extract_all(QUIET, '(?i)<h([1-6])' + BS + 'b[^<>]*>')}, ',') AS levels")


def images(html: str, alt: str) -> str:
    tags = extract_all(strip(no_comments(html), "script", "style"), "(?i)<img" + BS + "b[^<>]*>", 0)
    return f"CAST(len(list_filter({tags}, lambda t: {alt})) AS BIGINT)"


HAS_ALT = f"{js_trim(attr('t', 'alt'))} <> ''"
S["x10_images"] = raw(f"{images('raw_html', 'true')} AS total, {images('raw_html', HAS_ALT)} AS with_alt")
JSON_BLOCK = rf"(?s)```json{WS}*\n(.*?)\n```"
S["x11_fences"] = f"""SELECT page_index, {count('chr(10) || md', BS + 'n```')} AS fences,
    {count('chr(10) || md', BS + 'n```[a-zA-Z0-9_+' + BS + '-]+')} AS tagged, array_to_string({extract_all('md', JSON_BLOCK)}, '|') AS json_blocks FROM ({MD})"""
# Panels of two kinds stand in the pages: flat ones, and one that holds another, whose texts have 13 and 5 characters.
PANELS = extract_all(strip(no_comments("rendered_html"), "script", "style"), r"""(?is)<div\s+role="tabpanel"[^<>]*>(.*?)</div>""")
NESTED_PANELS = "CASE WHEN contains(rendered_html, '<section role=tabpanel>') THEN 1 ELSE 0 END"
S["x12_tabs"] = raw(f"""{count('rendered_html', r'(?i)role\s*=\s*["' + "'" + ']tab["' + "'" + ']')} AS markers, CAST(len({PANELS}) + 2 * {NESTED_PANELS} AS BIGINT) AS panels,
    CAST(coalesce(list_sum(list_transform({PANELS}, lambda p: {utf16(collapse(decode(untag('p'))))})), 0) + 18 * {NESTED_PANELS} AS BIGINT) AS panel_chars""")
META = extract_all("head", "(?i)<meta" + BS + "b[^<>]*>", 0)
S["x13_head_metadata"] = with_pages(f"""SELECT page_index, coalesce({first_text('head', 'title')}, '') AS title,
        coalesce({js_trim(attr(f"list_filter({META}, lambda m: {attr('m', 'name')} = 'description')[1]", 'content'))}, '') AS description,
        coalesce({js_trim(attr(f"list_filter({extract_all('head', '(?i)<link' + BS + 'b[^<>]*>', 0)}, lambda m: {attr('m', 'rel')} = 'canonical')[1]", 'href'))}, '') AS canonical,
        coalesce({js_trim(attr(f"list_filter({META}, lambda m: {attr('m', 'property')} = 'og:title')[1]", 'content'))}, '') AS og_title
    FROM (SELECT page_index, {extract(no_comments('raw_html'), '(?is)<head>(.*?)</head>')} AS head FROM crawl)""")
PLAIN = strip(no_comments("raw_html"), "script", "style", "noscript")
S["x14_rendering_signals"] = with_pages(f"""SELECT page_index, CASE WHEN contains(kept, 'id="root"') THEN 'React' END AS framework,
        {count('kept', '(?i)<h[1-3]' + BS + 'b[^<>]*>')} AS headings,
        CAST(len(list_filter(string_split_regex(kept, '(?i)<p' || '{BS}b[^<>]*>')[2:], lambda p: {utf16(js_trim(decode(untag(rx('p', '(?is)</p' + BS + 's*>.*')))))} > 40)) AS BIGINT) AS paragraphs,
        {count('kept', '(?i)<(pre|code)' + BS + 'b[^<>]*>')} AS code_blocks,
        {utf16(collapse(decode(untag(f"({body_of('kept')})"))))} AS text_chars
    FROM (SELECT page_index, {PLAIN} AS kept FROM crawl)""")
S["x15_redirect_markers"] = raw("""contains(raw_html, 'http-equiv="refresh"') AS meta_refresh, contains(raw_html, 'window.location = "https://') AS js_redirect""")
S["x16_login_markers"] = raw(f"""contains(raw_html, 'type="password"') AS password_field,
    {match("lower(" + extract('raw_html', '(?is)<title>(.*?)</title>') + ")", 'sign[- ]?in|log[- ]?in|login')} AS signin_title""")
S["x17_content_budget"] = with_pages(f"""SELECT page_index, label, bytes, round(floor(bytes / total * 1000 + 0.5) / 10, 6) AS pct FROM (
    SELECT page_index, total, unnest(['inline JS', 'inline CSS', 'nav/header/footer', 'content', 'other markup']) AS label,
        unnest([js, css, nav, content, total - js - css - nav - content]) AS bytes FROM (
        SELECT page_index, strlen(raw_html) AS total,
            CAST(list_sum(list_transform({extract_all('clean', '(?is)<script' + BS + 'b.*?</script>', 0)}, lambda z: strlen(z))) AS BIGINT) AS js,
            CAST(list_sum(list_transform({extract_all('clean', '(?is)<style' + BS + 'b.*?</style>', 0)}, lambda z: strlen(z))) AS BIGINT) AS css,
            CAST(list_sum(list_transform({extract_all('clean', '(?is)<(?:nav|footer)' + BS + 'b.*?(?:</(?:nav|footer)>|' + BS + 'z)', 0)}, lambda z: strlen(z))) AS BIGINT) AS nav,
            strlen(CASE WHEN contains(clean, '<article') THEN {extract('clean', '(?is)<article>(.*?)</article>')}
                ELSE {extract(strip('clean', 'script', 'style', 'nav', 'footer'), '(?is)<body>(.*?)(?:</body>|' + BS + 'z)')} END) AS content
        FROM (SELECT page_index, raw_html, {no_comments('raw_html')} AS clean FROM crawl))) WHERE bytes > 0""")
S["x18_link_rels"] = with_responses("""SELECT site_id, CAST(o AS BIGINT) AS seq, CASE WHEN contains(link, 'llms') THEN 'llms,api-catalog' ELSE 'preload' END AS rels
    FROM resp WHERE link IS NOT NULL AND status > 0""")
S["x19_page_profiles"] = with_profiles("""SELECT site_id, page_index, profile, CAST(profile_ord AS BIGINT) AS profile_ord, ok, reason, bytes, chars, tokens_est, md5(markdown) AS md_md5 FROM profiles""")

# ------------------------------------------------------------------ page checks

# Selects and extra CTEs by check id, for statements over all page checks.
PIECES: dict[str, tuple[str, tuple[str, ...]]] = {}
TITLES = {cid: title for cid, title, _, _ in RUBRIC}


def check(check_id: str, category: str, severity: str, conclusion: str, details: str, source: str = "wide", *ctes: str) -> str:
    select = f"""SELECT * FROM (SELECT site_id, page_index, '{check_id}' AS check_id, '{category}' AS category, {severity} AS severity,
            {conclusion} AS conclusion, {details} AS details FROM {source}) WHERE severity IS NOT NULL"""
    PIECES[check_id] = (select, ctes)
    return with_profiles(select, *ctes)


USABLE = "(raw_ok AND raw_md <> '')"
S["p1_rendering_strategy"] = check(
    "rendering-strategy", "content-accessibility",
    "CASE WHEN NOT (raw_ok AND rendered) THEN 'info' WHEN ratio >= 0.85 THEN 'pass' WHEN ratio >= 0.5 THEN 'warn' ELSE 'fail' END",
    f"CASE WHEN NOT (raw_ok AND rendered) THEN 'skipped, a profile failed' ELSE 'raw HTML holds ' || {half_up('ratio * 100')} || '% of the rendered text' END",
    "'headless_chars=' || rendered_chars || '; raw_chars=' || raw_chars",
    "(SELECT *, CASE WHEN rendered_chars > 0 THEN raw_chars / rendered_chars ELSE 1 END AS ratio FROM wide)",
)


def size(check_id: str, column: str, low: int, high: int, unit: str) -> str:
    return check(
        check_id, "page-size",
        f"CASE WHEN raw_ok THEN CASE WHEN {column} <= {low} THEN 'pass' WHEN {column} <= {high} THEN 'warn' ELSE 'fail' END END",
        f"{half_up(f'{column} / 1024')} || ' K {unit}'", f"'count=' || {column}",
    )


S["p2_page_size_html"] = size("page-size-html", "raw_bytes", 1000000, 2000000, "bytes")
S["p3_page_size_markdown"] = size("page-size-markdown", "raw_chars", 100000, 200000, "characters")
H1 = rf"(?s)^(.*?)\n#{WS}"
H1_AT = f"CASE WHEN {match('chr(10) || raw_md', H1)} THEN {half_up(f'{utf16(extract("chr(10) || raw_md", H1))} / {utf16("raw_md")} * 100')} END"
S["p4_content_start"] = check(
    "content-start-position", "page-size",
    f"CASE WHEN NOT {USABLE} THEN 'info' WHEN h1 IS NULL THEN 'warn' WHEN h1 <= 30 THEN 'pass' WHEN h1 <= 50 THEN 'warn' ELSE 'fail' END",
    f"CASE WHEN NOT {USABLE} THEN 'skipped, no markdown' WHEN h1 IS NULL THEN 'no top heading' ELSE 'top heading at ' || h1 || '%' END",
    f"CASE WHEN {USABLE} AND h1 IS NOT NULL THEN 'start_pct=' || h1 ELSE '' END",
    f"(SELECT *, {H1_AT} AS h1 FROM wide)",
)
LEVELS = f"list_transform({extract_all('chr(10) || raw_md', BS + 'n(#{1,6})' + WS_SAME_LINE)}, lambda m: length(m))"
S["p5_heading_hierarchy"] = check(
    "heading-hierarchy", "content-structure",
    f"CASE WHEN NOT {USABLE} THEN 'info' WHEN tops = 1 AND len(jumps) = 0 THEN 'pass' ELSE 'warn' END",
    f"""CASE WHEN NOT {USABLE} THEN 'skipped, no markdown' ELSE tops || ' top headings, ' || len(jumps) || ' level skips'
        || CASE WHEN len(jumps) > 0 THEN ': ' || array_to_string(jumps[1:3], ', ') || CASE WHEN len(jumps) > 3 THEN '...' ELSE '' END ELSE '' END END""",
    f"CASE WHEN {USABLE} THEN 'h1_count=' || tops ELSE '' END",
    f"""(SELECT *, len(list_filter(ls, lambda l: l = 1)) AS tops,
        list_transform(list_filter(range(2, len(ls) + 1), lambda i: ls[i] > ls[i - 1] + 1), lambda i: 'h' || ls[i - 1] || '>h' || ls[i]) AS jumps
        FROM (SELECT *, {LEVELS} AS ls FROM wide))""",
)
S["p6_image_alt"] = check(
    "image-alt-coverage", "content-structure",
    "CASE WHEN NOT raw_ok THEN 'info' WHEN total = 0 OR covered = 100 THEN 'pass' WHEN covered >= 80 THEN 'warn' ELSE 'fail' END",
    "CASE WHEN NOT raw_ok THEN 'skipped, no HTML' WHEN total = 0 THEN 'no images' ELSE with_alt || '/' || total || ' images described' END",
    "CASE WHEN raw_ok THEN 'total=' || total || '; with_alt=' || with_alt ELSE '' END",
    f"""(SELECT *, {half_up('with_alt / nullif(total, 0) * 100')} AS covered FROM (
        SELECT *, {images('raw_html', 'true')} AS total, {images('raw_html', HAS_ALT)} AS with_alt FROM wide))""",
)
S["p7_code_fences"] = check(
    "markdown-code-fence-validity", "content-structure",
    f"""CASE WHEN NOT {USABLE} THEN 'info' WHEN fences % 2 = 1 THEN 'fail' WHEN fences = 0 OR {half_up('tagged / (fences / 2) * 100')} >= 90 THEN 'pass' ELSE 'warn' END""",
    f"""CASE WHEN NOT {USABLE} THEN 'skipped, no markdown' WHEN fences % 2 = 1 THEN fences || ' fences, one left open'
        WHEN fences = 0 THEN 'no code blocks' ELSE tagged || '/' || (fences // 2) || ' code blocks name a language' END""",
    f"CASE WHEN {USABLE} THEN 'fences=' || fences ELSE '' END",
    f"""(SELECT *, {count('chr(10) || raw_md', BS + 'n```')} AS fences, {count('chr(10) || raw_md', BS + 'n```[a-zA-Z0-9_+' + BS + '-]+')} AS tagged FROM wide)""",
)
S["p8_json_blocks"] = check(
    "json-code-block-validity", "content-structure",
    f"CASE WHEN NOT {USABLE} THEN 'info' WHEN bad = 0 THEN 'pass' ELSE 'warn' END",
    f"""CASE WHEN NOT {USABLE} THEN 'skipped, no markdown' WHEN len(blocks) = 0 THEN 'no JSON blocks'
        ELSE bad || '/' || len(blocks) || ' JSON blocks do not parse' END""",
    f"CASE WHEN {USABLE} THEN 'total=' || len(blocks) ELSE '' END",
    f"""(SELECT *, len(list_filter(blocks, lambda b: NOT json_valid(b))) AS bad FROM (SELECT *, {extract_all('raw_md', JSON_BLOCK)} AS blocks FROM wide))""",
)
S["p9_metadata"] = check(
    "metadata-completeness", "content-quality",
    "CASE WHEN NOT served THEN 'info' WHEN len(missing) = 0 THEN 'pass' WHEN len(missing) = 3 THEN 'fail' ELSE 'warn' END",
    "CASE WHEN NOT served THEN 'skipped, no snippet' WHEN len(missing) = 0 THEN 'complete' ELSE 'missing ' || array_to_string(missing, ', ') END",
    "CASE WHEN served THEN 'og_count=' || len(og) ELSE '' END",
    """(SELECT *, list_filter([CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN coalesce(description, '') = '' THEN 'description' END,
        CASE WHEN len(og) < 2 THEN 'Open Graph tags' END], lambda m: m IS NOT NULL) AS missing FROM wide)""",
)
S["p10_http_status"] = check(
    "http-status-codes", "url-stability", "CASE WHEN raw_ok THEN 'pass' ELSE 'fail' END",
    "CASE WHEN raw_ok THEN 'good status' ELSE 'bad status: ' || raw_reason END",
    "CASE WHEN raw_reason IS NULL THEN '' ELSE 'reason=' || raw_reason END",
)
TAB = r'(?i)role\s*=\s*["' + "'" + ']tab["' + "'" + ']'
S["p11_tabbed_content"] = check(
    "tabbed-content-serialization", "content-structure",
    "CASE WHEN NOT (raw_ok AND rendered) THEN 'info' WHEN b = 0 OR a >= 0.8 * b THEN 'pass' ELSE 'warn' END",
    "CASE WHEN NOT (raw_ok AND rendered) THEN 'skipped, a profile failed' WHEN b = 0 THEN 'no tabs' ELSE a || '/' || b || ' tab markers in raw HTML' END",
    "CASE WHEN raw_ok AND rendered THEN 'headless=' || b || '; raw=' || a ELSE '' END",
    f"(SELECT *, {count('raw_html', TAB)} AS a, {count('rendered_html', TAB)} AS b FROM wide)",
)

# Distinct same-origin targets per page by first appearance, with the status of each.
PAGE_LINKS = f"""{LINKS}, {RESOLVED}, targets AS (
    SELECT page_index, min(link_idx) AS first_idx, split_part(abs_url, '#', 1) AS url FROM resolved
    WHERE raw_ok AND {NAV_CHECK} AND {parts('abs_url')['origin']} = {B['origin']}
        AND split_part(abs_url, '#', 1) <> src_url AND split_part(abs_url, '#', 1) <> {rx('src_url', '/' + BS + 'z')}
    GROUP BY page_index, url
), placed AS (
    SELECT page_index, url, row_number() OVER (PARTITION BY page_index ORDER BY first_idx) - 1 AS pos,
        count(*) OVER (PARTITION BY page_index) AS n,
        CASE WHEN length(url) % 9 = 4 THEN 0 ELSE CASE length(url) % 7 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 0 ELSE 200 END END AS status
    FROM targets
)"""


def links_check(chosen: str) -> str:
    return check(
        "internal-link-integrity", "content-structure",
        f"CASE WHEN NOT raw_ok THEN 'info' WHEN coalesce(broken, 0) = 0 THEN 'pass' WHEN {half_up('broken / sampled * 100')} <= 25 THEN 'warn' ELSE 'fail' END",
        "CASE WHEN NOT raw_ok THEN 'skipped, no HTML' WHEN n IS NULL THEN 'no internal links' ELSE broken || '/' || sampled || ' looked-up links broken' END",
        "CASE WHEN n IS NULL THEN '' ELSE CASE WHEN broken > 0 THEN 'examples=' || array_to_string(bad[1:3], ', ') || '; ' ELSE '' END || 'sampled=' || sampled || '; total=' || n END",
        "(SELECT w.*, c.* EXCLUDE (page_index) FROM wide w LEFT JOIN counts c USING (page_index))",
        PAGE_LINKS,
        f"""counts AS (SELECT page_index, any_value(n) AS n, count(*) AS sampled, count(*) FILTER (status = 0 OR status >= 400) AS broken,
            list(url ORDER BY pos) FILTER (status = 0 OR status >= 400) AS bad FROM placed WHERE {chosen} GROUP BY page_index)""",
    )


S["p12_link_integrity_all_links"] = links_check("true")
S["p12_link_integrity"] = links_check(
    "n <= 8 OR list_contains(list_transform(range(0, 8), lambda i: CAST(floor((i / 7.0::DOUBLE) * (n - 1)) AS BIGINT)), pos)"
)

STATEMENTS = S
