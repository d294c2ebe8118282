"""SQL building blocks shared by the oracle statements.

The derivation of inputs and the pattern tables are the ones Spark uses; everything that decides a
result (conditions, thresholds, joins, order) is written out again in SQL.
"""

from __future__ import annotations

from auditlake.functions import html as H
from auditlake.functions.text import WS, WS_CHARS
from auditlake.plans import corpus as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def extract(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {group})"


def extract_all(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({expr}, {q(pattern)}, {group})"


def count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {q(pattern)}, 0)) AS BIGINT)"


def utf16(expr: str) -> str:
    return f"CAST(length({expr}) + length({rx(expr, '[^' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')}) AS BIGINT)"


def half_up(expr: str) -> str:
    return f"CAST(floor({expr} + 0.5) AS BIGINT)"


def tokens(chars: str) -> str:
    return f"CASE WHEN {chars} <= 0 THEN 0 ELSE {half_up(f'{chars} / 4')} END"


def collapse(expr: str) -> str:
    return f"trim({rx(expr, WS + '+', ' ')}, ' ')"


def js_trim(expr: str) -> str:
    return f"trim({expr}, {q(WS_CHARS)})"


def strip(expr: str, *tags: str) -> str:
    for tag in tags:
        expr = rx(expr, H.element(tag))
    return expr


def no_comments(expr: str) -> str:
    return rx(expr, H.COMMENT)


def untag(expr: str) -> str:
    return rx(expr, H.ANY_TAG)


# The references that the pages of the tables hold, the ampersand last.
REFERENCES = [
    ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&eacute;", "\u00e9"), ("&#239;", "\u00ef"), ("&#x2014;", "\u2014"),
    ("&euro;", "\u20ac"), ("&#150;", "\u2013"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
]


def decode(expr: str) -> str:
    for name, char in REFERENCES:
        expr = f"replace({expr}, {q(name)}, {q(char)})"
    return expr


def body_of(expr: str) -> str:
    inner = extract(expr, r"(?is)<body(?:[\s/][^<>]*)?>(.*?)(?:</body\s*>|\z)")
    return f"CASE WHEN {match(expr, '(?i)<body[' + chr(92) + 's/>]')} THEN {inner} ELSE {strip(expr, 'head')} END"


def visible(expr: str, *tags: str) -> str:
    tags = tags or ("script", "style", "noscript", "template")
    return collapse(decode(untag(f"({body_of(strip(no_comments(expr), *tags))})")))


def attr(tag: str, name: str) -> str:
    return decode(f"""trim({extract(tag, rf'(?i)' + chr(92) + f's{name}' + chr(92) + 's*=' + chr(92) + f's*{H.ATTR_VALUE}')}, '"''')""")


def rules(expr: str, table) -> str:
    for pattern, repl in table:
        expr = rx(expr, pattern, repl)
    return expr


# What the lists and quotes inside each other become; plain lists are told by a rule.
NESTED = "3.  first\n4.  second\n    -   inner\n    -   para\n\n> said\n> \n> more\n>\n> -   point\n\n-   1.  deep"
PLAIN_LISTS = [(r"(?i)</?ul>", "\n\n"), (r"(?i)<li>", "\n-   ")]


def markdown(html: str) -> str:
    kept = f"replace({strip(no_comments(html), 'script', 'noscript', 'iframe', 'svg')}, {q(C.NESTED)}, '<p>\uE007</p>')"
    # Text before a list ends without white space.
    return f"replace({rx(_markdown(kept), ' +' + chr(10) + '+' + chr(0xE007), chr(10) * 2 + chr(0xE007))}, '\uE007', {q(NESTED)})"


def _markdown(kept: str) -> str:
    tags = rules(rules(rules("s", [H.TEXT_RULES[0], *PLAIN_LISTS, *H.TEXT_RULES[1:]]), H.IMAGE_RULES), H.TAG_RULES)
    text = rules(f"replace({decode(tags)}, '`', '{chr(92)}`')", H.ESCAPE_RULES)
    for mark, plain in H.MARKS:
        text = f"replace({text}, {q(mark)}, {q(plain)})"
    code = rx(decode(untag("s")), r"\n\z")
    lang = extract("s", r"(?i)^\s*<code\b[^<>]*\bclass\s*=\s*[^<>]*?\blanguage-([^\s\"'<>]+)")
    fence = f"CASE WHEN {match(code, '(?:^|' + chr(10) + ')```')} THEN '````' ELSE '```' END"
    fenced = f"({fence}) || {lang} || chr(10) || {code} || chr(10) || ({fence})"
    plain = js_trim(f"replace({code}, '`', '{chr(92)}`')")
    pre = f"CASE WHEN {match('s', '(?i)^' + chr(92) + 's*<code' + chr(92) + 'b')} THEN {fenced} ELSE {plain} END"
    return (
        f"array_to_string(list_filter(list_transform(regexp_split_to_array({kept}, {q("(?i)</?pre(?:[" + chr(92) + "s/][^<>]*)?>")}), "
        f"lambda s, i: CASE WHEN i % 2 = 0 THEN {pre} ELSE {text} END), lambda t: t <> ''), chr(10) || chr(10))"
    )


PAGES = f"""
stored AS (
    SELECT page_id, url, {rx('html', chr(92) + 'r' + chr(92) + 'n?', chr(10))} AS html FROM pages
),
based AS (SELECT page_id, url, {C.BASE_HTML} AS base_html FROM stored),
crawl AS MATERIALIZED (
    SELECT {C.SITE_ID} AS site_id, page_id AS page_index, page_id, url, {C.RAW_STATUS} AS raw_status,
        {C.RAW_HTML} AS raw_html, {C.RENDERED_HTML} AS rendered_html,
        {C.FETCH_ERROR} AS fetch_error, {C.RENDERED_ERROR} AS rendered_error
    FROM based
)"""

META_PAIRS = f"""list_filter(list_transform(metas, lambda m: struct_pack(k := {attr('m', '{key}')}, v := {attr('m', 'content')})),
    lambda p: starts_with(p.k, '{{prefix}}') AND p.v <> '')""".replace("{key}", "@KEY@").replace("{{prefix}}", "@PREFIX@")


def meta_pairs(key: str, prefix: str) -> str:
    return META_PAIRS.replace("@KEY@", key).replace("{prefix}", prefix).replace("@PREFIX@", prefix)


def meta_entries(pairs: str) -> str:
    """Entries in order of first appearance, each with its last value."""
    firsts = f"list_filter({pairs}, lambda p, i: list_position(list_transform({pairs}, lambda z: z.k), p.k) = i)"
    return (
        f"list_transform({firsts}, lambda f: struct_pack(k := f.k, "
        f"v := list_filter({pairs}, lambda x: x.k = f.k)[-1].v))"
    )


def first_text(html: str, tag: str) -> str:
    inner = extract(html, rf"(?is)<{tag}(?:[\s/][^<>]*)?>(.*?)(?:</{tag}\s*>|\z)")
    return f"nullif({js_trim(decode(untag(inner)))}, '')"


LD_JSON = r"""(?is)<script(?:[\s/][^<>]*)?\stype\s*=\s*["']?application/ld\+json["']?[^<>]*>(.*?)(?:</script\s*>|\z)"""

PROFILES = f"""{PAGES},
parsed AS (
    SELECT *, {no_comments('raw_html')} AS clean,
        fetch_error IS NULL AS fetched, rendered_error IS NULL AS rendered,
        fetch_error IS NULL AND raw_status BETWEEN 200 AND 399 AS served
    FROM crawl
),
tagged AS (SELECT *, {extract_all('clean', rf"(?i)<meta(?:[{chr(92)}s/]{H.QUOTED})?>|<meta(?:[{chr(92)}s/][^<>]*)?>", 0)} AS metas FROM parsed),
pieces AS (
    SELECT *,
        {first_text(strip('clean', 'svg'), 'title')} AS title,
        list_filter(metas, lambda m: {attr('m', 'name')} = 'description')[1] AS desc_tag,
        {meta_pairs('property', 'og:')} AS og_pairs,
        {meta_pairs('name', 'twitter:')} AS tw_pairs,
        {first_text(strip('clean', 'script', 'style'), 'h1')} AS first_h1,
        substr({visible('raw_html')}, 1, 200) AS preview,
        list_filter(list_transform({extract_all('clean', LD_JSON)}, lambda b: {js_trim('b')}), lambda b: json_valid(b)) AS json_ld,
        {markdown('raw_html')} AS raw_md, {markdown('rendered_html')} AS rendered_md
    FROM tagged
),
snip AS (
    SELECT *, CASE WHEN {match('desc_tag', '(?i)' + chr(92) + 'scontent' + chr(92) + 's*=')} THEN {js_trim(attr('desc_tag', 'content'))} END AS description,
        {meta_entries('og_pairs')} AS og, {meta_entries('tw_pairs')} AS twitter
    FROM pieces
),
shown AS (
    SELECT *, array_to_string(list_filter(list_concat(list_concat(list_concat(
            [CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN description <> '' THEN 'Description: ' || description END],
            list_transform(og, lambda e: e.k || ': ' || e.v)), list_transform(twitter, lambda e: e.k || ': ' || e.v)),
            [CASE WHEN first_h1 <> '' THEN 'First H1: ' || first_h1 END]), lambda x: x IS NOT NULL), chr(10)) AS head_lines
    FROM snip
),
prof AS MATERIALIZED (
    SELECT site_id, page_index, url, raw_status, raw_html, rendered_html, fetched, rendered, served,
        title, description, og, twitter, first_h1, preview, json_ld,
        served AS raw_ok,
        CASE WHEN NOT fetched THEN fetch_error WHEN raw_status >= 400 THEN 'HTTP ' || raw_status END AS raw_reason,
        CASE WHEN fetched THEN raw_md ELSE '' END AS raw_md,
        CASE WHEN fetched THEN strlen(raw_html) ELSE 0 END AS raw_bytes,
        CASE WHEN rendered THEN rendered_md ELSE '' END AS rendered_md,
        CASE WHEN rendered THEN strlen(rendered_html) ELSE 0 END AS rendered_bytes,
        CASE WHEN rendered THEN NULL WHEN starts_with(rendered_error, 'Skipped') THEN rendered_error
            ELSE 'Timeout 20000ms exceeded' END AS rendered_reason,
        CASE WHEN NOT fetched THEN fetch_error WHEN NOT served THEN 'HTTP ' || raw_status END AS snippet_reason,
        CASE WHEN served THEN CASE WHEN head_lines = '' THEN '' ELSE head_lines || chr(10) END
            || CASE WHEN len(json_ld) > 0 THEN chr(10) || 'JSON-LD:' || chr(10) || array_to_string(json_ld, chr(10)) || chr(10) ELSE '' END
            || chr(10) || 'Preview (' || {utf16('preview')} || ' chars):' || chr(10) || preview ELSE '' END AS snippet_md
    FROM shown
),
wide AS (
    SELECT *, {utf16('raw_md')} AS raw_chars, {utf16('rendered_md')} AS rendered_chars, {utf16('snippet_md')} AS snippet_chars
    FROM prof
),
profiles AS (
    SELECT site_id, page_index, url, 'rawHttp' AS profile, 0 AS profile_ord, raw_ok AS ok, raw_reason AS reason,
        raw_bytes AS bytes, raw_chars AS chars, {tokens('raw_chars')} AS tokens_est, raw_md AS markdown FROM wide
    UNION ALL
    SELECT site_id, page_index, url, 'headless', 1, rendered, rendered_reason, rendered_bytes, rendered_chars,
        {tokens('rendered_chars')}, rendered_md FROM wide
    UNION ALL
    SELECT site_id, page_index, url, 'snippet', 2, served, snippet_reason, strlen(snippet_md), snippet_chars,
        {tokens('snippet_chars')}, snippet_md FROM wide
)"""

SITES = f"""
sites AS (
    SELECT site_id, h, 'https://' || site_id || CASE WHEN h % 10 = 3 THEN '/guide.md' ELSE '/' END AS seed_url
    FROM (SELECT {C.SITE_ID} AS site_id, min(page_id) AS h FROM pages GROUP BY 1)
)"""

_PROBES = ", ".join(f"({q(k)}, {q(p) if p else 'NULL'}, {i})" for i, (k, p) in enumerate(C.PROBES))

RESPONSES = f"""{SITES},
probes(kind, path, o) AS (VALUES {_PROBES}),
resp AS MATERIALIZED (
    SELECT site_id, h, seed_url, kind, path, o, {C.PROBE_URL} AS url, {C.PROBE_STATUS} AS status, {C.BODY.replace('doc_text', "coalesce(doc_text, '')")} AS body,
        {C.CONTENT_TYPE} AS ctype, {C.LINK_HEADER} AS link, {C.LAST_MODIFIED} AS last_modified, {C.ETAG} AS etag, {C.HOPS} AS hops
    FROM sites JOIN (SELECT page_id AS h, coalesce(html, '') AS page_html FROM pages) USING (h)
        LEFT JOIN (SELECT doc_id AS h, coalesce(text, '') AS doc_text FROM documents) USING (h), probes
)"""


def with_pages(select: str) -> str:
    return f"WITH {PAGES}\n{select}"


def with_profiles(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([PROFILES, *ctes])}\n{select}"


def with_responses(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([RESPONSES, *ctes])}\n{select}"
