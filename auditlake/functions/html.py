"""HTML column functions: every page is read by JVM regular expressions, never row by row in Python.

All patterns stay within what RE2 can do (no lookaround, no back references), and avoid open-ended
scans that restart at every tag: an element that is never closed runs to the end of the page, as it
does in a browser. A tag's name ends at white space, ``/`` or ``>``, so ``<svg-icon>`` is no ``svg``.
"""

from __future__ import annotations

from base64 import b64encode
from html.entities import html5

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import markup
from auditlake.functions.text import WS, WS_SAME_LINE, blank_to_null, collapse_ws, js_trim, let, utf16_len, utf16_prefix

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
ATTR_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'<>]+)"""
# The rest of a tag whose quoted values may hold angle brackets.
QUOTED = r"""[^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*"""
# Any tag: with quoted values first, else up to the next angle bracket.
ANY_TAG = rf"</?[a-zA-Z]{QUOTED}>|<[^<>]*>"

# Named character references of HTML, with their semicolon and, where it may be missing, without; from the standard library.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
REFERENCE = rf"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{'|'.join(_OPEN_NAMES)}))"
# Numbers 128 to 159 stand for what they are in the Windows code page, where it has a character there.
_WINDOWS = [ord(bytes([n]).decode("cp1252", "replace")) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else n for n in range(128, 160)]
# All names with what they stand for, one text for each first letter; one literal that is split when the query is planned.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_NAMES = "\x03".join("\x01" + "".join(f"{n}\x02{c}\x01" for n, c in sorted(html5.items()) if n[0] == letter) for letter in _LETTERS)


def normalize_newlines(s: Column) -> Column:
    return F.regexp_replace(s, r"\r\n?", "\n")


def element(tag: str) -> str:
    """Pattern of an element with its content; an unclosed one runs to the end."""
    return rf"(?is)<{tag}(?:[\s/][^<>]*)?>.*?(?:</{tag}\s*>|\z)"


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def strip_elements(html: Column, *tags: str, comments: bool = False) -> Column:
    """Remove elements with their content, and comments too, in one pass over the text.

    Whatever starts first wins, so a script inside a comment or the other way round is no matter.
    """
    kinds = [rf"<{tag}(?:[\s/][^<>]*)?>.*?(?:</{tag}\s*>|\z)" for tag in tags]
    if comments:
        kinds.insert(0, r"<!--.*?(?:-->|\z)")
    return F.regexp_replace(html, "(?is)" + "|".join(kinds), "")


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _named(name: str) -> str:
    """What a name stands for; NULL if it is none."""
    letter = f"CASE WHEN ascii({name}) BETWEEN 65 AND 90 THEN ascii({name}) - 65 WHEN ascii({name}) BETWEEN 97 AND 122 THEN ascii({name}) - 71 END"
    names = f"get(split(decode(unbase64('{b64encode(_NAMES.encode()).decode()}'), 'UTF-8'), '\x03'), {letter})"
    place = f"instr(names, concat('\x01', {name}, '\x02'))"
    return _let(names, "names", _let(place, "at", f"CASE WHEN at > 0 THEN substring_index(substring(names, at + length({name}) + 2, 8), '\x01', 1) END"))


def _numbered(reference: str) -> str:
    """Character of a numeric reference; a number that is none gives the replacement character."""
    digits = f"substring(regexp_replace(regexp_extract({reference}, '[0-9a-fA-F]+', 0), '^0+', ''), 1, 9)"
    number = _let(digits, "d", f"try_cast(CASE WHEN {reference} RLIKE '^&#[xX]' THEN conv(d, 16, 10) ELSE d END AS BIGINT)")
    windows = f"CAST(get(split('{' '.join(map(str, _WINDOWS))}', ' '), CAST(n - 128 AS INT)) AS BIGINT)"
    known = _let(number, "n", f"CASE WHEN n BETWEEN 128 AND 159 THEN {windows} WHEN n BETWEEN 55296 AND 57343 OR n < 1 OR n > 1114111 THEN NULL ELSE n END")
    return f"decode(unhex(lpad(hex(coalesce({known}, 65533)), 8, '0')), 'UTF-32')"


def _decoder() -> str:
    """The decoding of a text as a SQL lambda: built from column calls it would take seconds in plans with many uses.

    An unknown name may begin with one that needs no semicolon.
    """
    names = f"array(substring(r, 2, 64), regexp_extract(r, '^&({'|'.join(_OPEN_NAMES)})', 1))"
    hits = f"filter(transform({names}, w -> struct({_named('w')} AS c, length(w) AS n)), x -> x.c IS NOT NULL)"
    named = _let(f"get({hits}, 0)", "hit", "CASE WHEN hit IS NULL THEN r ELSE concat(hit.c, substring(r, hit.n + 2, length(r))) END")
    one = f"CASE WHEN startswith(r, '&#') THEN {_numbered('r')} ELSE {named} END"
    pieces = f"zip_with(split(t, r'{REFERENCE}'), regexp_extract_all(t, r'{REFERENCE}', 0), (p, r) -> CASE WHEN r IS NULL THEN p ELSE concat(p, {one}) END)"
    return f"t -> CASE WHEN contains(t, '&') THEN array_join({pieces}, '') ELSE t END"


# The parsed lambda of the running context.
_PARSED: dict[int, Column] = {}


def decode_entities(s: Column) -> Column:
    """Decode all character references in one pass; text without an ampersand, which most short text is, passes by."""
    context = id(SparkContext._active_spark_context)
    if context not in _PARSED:
        _PARSED.clear()
        _PARSED[context] = F.expr(_decoder())
    return F.get(F.call_function("transform", F.array(s), _PARSED[context]), F.lit(0))


def strip_tags(s: Column, by: str = "") -> Column:
    return F.regexp_replace(s, ANY_TAG, by)


def body_of(html: Column) -> Column:
    """Inside of ``body``; a page without the tag is all body but for its head."""
    return let(
        html,
        lambda h: F.when(
            h.rlike(r"(?i)<body[\s/>]"), F.regexp_extract(h, r"(?is)<body(?:[\s/][^<>]*)?>(.*?)(?:</body\s*>|\z)", 1)
        ).otherwise(strip_elements(h, "head")),
    )


def visible_text(html: Column) -> Column:
    """Body text with white space collapsed and without script, style, noscript and template."""
    kept = strip_elements(html, "script", "style", "noscript", "template", comments=True)
    return collapse_ws(decode_entities(strip_tags(body_of(kept))))


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag's text; empty if it is missing."""
    quoted = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*{ATTR_VALUE}", 1)
    return decode_entities(F.btrim(quoted, F.lit("\"'")))


def tags_of(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}(?:[\s/]{QUOTED})?>|<{tag}(?:[\s/][^<>]*)?>"), F.lit(0))


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("bigint")


# ---------------------------------------------------------------- HTML to markdown

# Private-use characters stand for structure until literal text has been escaped.
HEAD, TICK, ANCHOR, QUOTE = "\uE001", "\uE002", "\uE003", "\uE006"
# Elements that start a new block.
BLOCK_TAGS = (
    "address article aside blockquote body canvas center dd dir div dl dt fieldset figcaption figure "
    "footer form frameset header hgroup html main menu nav ol output p section table tbody td tfoot th "
    "thead tr ul"
)
# (pattern, replacement) in order; \1 and \2 are groups.
TEXT_RULES = [
    (r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+", " "),
    (r"(?i)<h([1-6])(?:[\s/][^<>]*)?>", f"\n\n{HEAD}\\1 "),
    (r"(?i)<br(?:[\s/][^<>]*)?>", "  \n"),
    (r"(?i)<hr(?:[\s/][^<>]*)?>", "\n\n* * *\n\n"),
    (rf"(?i)</?(?:{BLOCK_TAGS.replace(' ', '|')})(?:[\s/][^<>]*)?>|</h[1-6]\s*>", "\n\n"),
    (r"(?i)(<a[\s/>])", rf"{ANCHOR}\1"),
    (
        rf"""(?i){ANCHOR}<a(?:[\s/]{QUOTED})?\shref\s*=\s*["']?([^"'<>\s]+)["']?(?:\s{QUOTED})?>([^{ANCHOR}]*?)</a\s*>""",
        r"[\2](\1)",
    ),
    (
        rf"""(?i){ANCHOR}<a(?:[\s/][^<>]*?)?\shref\s*=\s*["']?([^"'<>\s]+)[^<>]*>([^{ANCHOR}]*?)</a\s*>""",
        r"[\2](\1)",
    ),
    (r"(?i)</?(?:b|strong)(?:[\s/][^<>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:[\s/][^<>]*)?>", "_"),
    (r"(?i)</?code(?:[\s/][^<>]*)?>", TICK),
]
_VALUE = r"""("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""
# A value keeps its quotation marks until both sides are marked, then they go.
IMAGE_RULES = [
    (rf"(?i)<img(?:[\s/][^<>]*?)?\salt\s*=\s*{_VALUE}[^<>]*?\ssrc\s*=\s*{_VALUE}[^<>]*>", f"![{QUOTE}\\1{QUOTE}]({QUOTE}\\2{QUOTE})"),
    (rf"(?i)<img(?:[\s/][^<>]*?)?\ssrc\s*=\s*{_VALUE}[^<>]*?\salt\s*=\s*{_VALUE}[^<>]*>", f"![{QUOTE}\\2{QUOTE}]({QUOTE}\\1{QUOTE})"),
    (rf"(?i)<img(?:[\s/][^<>]*?)?\ssrc\s*=\s*{_VALUE}[^<>]*>", f"![]({QUOTE}\\1{QUOTE})"),
    (rf"""{QUOTE}["']|["']{QUOTE}|{QUOTE}""", ""),
]
TAG_RULES = [(rf"{ANY_TAG}|{ANCHOR}", "")]
# Applied once entities are decoded: literal marks must not turn into structure.
ESCAPE_RULES = [
    # A heading without text is none.
    (rf"{HEAD}[1-6] *(\n|\z)", r"\1"),
    (r"(^|\n) *(#{1,6} )", r"\1\\\2"),
    (r"\n +", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^[ \n]+|[ \n]+\z", ""),
]
# Literal replacements: the mark of a heading with its level, then the mark of code.
MARKS = [*[(f"{HEAD}{n}", "#" * n) for n in range(1, 7)], (TICK, "`")]


def java_replacement(repl: str) -> str:
    """``\\1`` group references in Java's notation."""
    out = repl.replace("$", r"\$")
    for group in "123":
        out = out.replace(rf"\{group}", f"${group}")
    return out


def _apply(s: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, repl in rules:
        s = F.regexp_replace(s, pattern, java_replacement(repl))
    return s


def _markdown_text(segment: Column) -> Column:
    tagged = let(
        _apply(segment, TEXT_RULES), lambda t: F.when(F.lower(t).contains("<img"), _apply(t, IMAGE_RULES)).otherwise(t)
    )
    s = F.replace(decode_entities(_apply(tagged, TAG_RULES)), F.lit("`"), F.lit("\\`"))
    s = _apply(s, ESCAPE_RULES)
    for mark, plain in MARKS:
        s = F.replace(s, F.lit(mark), F.lit(plain))
    return s


def _markdown_pre(segment: Column) -> Column:
    """Fenced block for ``<pre><code>``; other preformatted text stays text."""
    lang = F.regexp_extract(segment, r"(?i)^\s*<code\b[^<>]*\bclass\s*=\s*[^<>]*?\blanguage-([^\s\"'<>]+)", 1)
    code = F.regexp_replace(decode_entities(strip_tags(segment)), r"\n\z", "")
    fence = F.when(code.rlike(r"(?:^|\n)```"), F.lit("````")).otherwise(F.lit("```"))
    fenced = F.concat(fence, lang, F.lit("\n"), code, F.lit("\n"), fence)
    return F.when(segment.rlike(r"(?i)^\s*<code\b"), fenced).otherwise(js_trim(F.replace(code, F.lit("`"), F.lit("\\`"))))


def html_to_markdown(html: Column) -> Column:
    """ATX headings, fenced code, nested lists and quotes; script, noscript, iframe and svg dropped.

    A page is cut at the tags of lists, quotes and ``pre``; each piece is converted by itself and gets the margin
    of what is open around it. White space and marks mean something in ``pre``, so that text is handled apart.
    """
    kept = strip_elements(html, "script", "noscript", "iframe", "svg", comments=True)
    return markup.placed_pieces(kept, _markdown_text, _markdown_pre)


# ---------------------------------------------------------------- page parts


# Opening tag of what holds a page's content: main, article, or any element in that role.
CONTENT_OPEN = r"""(?i)<(?:(?:main|article)(?:[\s/][^<>]*)?|[a-z][a-z0-9-]*(?:\s[^<>]*)?\srole\s*=\s*["']?main(?:["'\s/][^<>]*)?)>"""


def inner_of(rest: Column, tag: Column) -> Column:
    """What an element holds, given the text after its opening tag.

    Opening and closing tags of its name are counted to the one that closes it; without that the
    element runs to the end.
    """
    pattern = F.concat(F.lit("(?i)</?"), tag, F.lit(r"(?:[\s/][^<>]*)?>"))

    def fold(marks: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            mark, closes = x["mark"], x["mark"].startswith("</")
            depth = done["depth"] + F.when(closes, -1).when(mark.endswith("/>"), 0).otherwise(1)
            size = done["size"] + F.length(x["piece"]) + F.when(depth == 0, 0).otherwise(F.length(mark))
            return F.when(done["depth"] == 0, done).otherwise(F.struct(depth.alias("depth"), size.alias("size")))

        pieces = F.slice(F.split(rest, pattern), F.lit(1), F.size(marks))
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
        walked = F.aggregate(F.zip_with(pieces, marks, lambda p, m: F.struct(p.alias("piece"), m.alias("mark"))), start, step)
        return let(walked, lambda w: F.when(w["depth"] == 0, F.substring(rest, F.lit(1), w["size"])).otherwise(rest))

    return let(F.regexp_extract_all(rest, pattern, F.lit(0)), fold)


def main_part(page: Column) -> Column:
    """Inside of the first main, article or role=main element; of the body if there is none."""

    def after(opening: Column) -> Column:
        rest = F.substring(page, F.instr(page, opening) + F.length(opening), F.length(page))
        tag = F.lower(F.regexp_extract(opening, r"^<([a-zA-Z0-9-]+)", 1))
        return F.when(opening == "", body_of(page)).otherwise(let(rest, lambda r: inner_of(r, tag)))

    return let(F.regexp_extract(page, CONTENT_OPEN, 0), after)


def content_body(html: Column) -> Column:
    """First main, article or role=main element without boilerplate; else the body."""
    return let(strip_elements(html, "script", "style", "noscript", "nav", "header", "footer", comments=True), main_part)


def text_to_markup_ratio(html: Column) -> Column:
    kept = strip_elements(html, "script", "style", "noscript", comments=True)
    text = utf16_len(collapse_ws(decode_entities(strip_tags(body_of(kept)))))
    ratio = F.try_divide(text, utf16_len(html))
    return F.when(F.length(html) == 0, F.lit(0.0)).otherwise(F.floor(ratio * 100 + 0.5) / 100)


def _meta_map(metas: Column, key_attr: str, prefix: str) -> Column:
    """Map of matching tags in order of first appearance; a repeated key keeps its last value."""
    pairs = F.filter(
        F.transform(metas, lambda m: F.struct(attr(m, key_attr).alias("k"), attr(m, "content").alias("v"))),
        lambda p: p["k"].startswith(prefix) & (p["v"] != ""),
    )

    def last_wins(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda p: p["k"]))
        last = F.transform(keys, lambda k: F.element_at(F.filter(found, lambda p: p["k"] == k), -1)["v"])
        return F.map_from_arrays(keys, last)

    return let(pairs, last_wins)


def first_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:[\s/][^<>]*)?>(.*?)(?:</{tag}\s*>|\z)", 1)
    return let(js_trim(decode_entities(strip_tags(inner))), blank_to_null)


def first_meta(metas: Column, key_attr: str, name: str) -> Column:
    """Trimmed content of the first matching meta tag; NULL if there is no such tag."""
    hit = F.get(F.filter(metas, lambda m: attr(m, key_attr) == name), F.lit(0))
    return let(hit, lambda m: F.when(m.rlike(r"(?i)\scontent\s*="), js_trim(attr(m, "content"))))


JSON_LD = r"""(?is)<script(?:[\s/][^<>]*)?\stype\s*=\s*["']?application/ld\+json["']?[^<>]*>(.*?)(?:</script\s*>|\z)"""


def snippet(html: Column, legacy: bool = False, json_ok=None) -> Column:
    """What a search-snippet reader keeps of a page.

    ``legacy`` reads JSON-LD only after all scripts are gone, so that list is always empty.
    """
    from auditlake.functions.text import is_valid_json

    json_ok = json_ok or is_valid_json

    def read(page: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(page, F.lit(JSON_LD), F.lit(1)), js_trim)
        json_ld = F.array().cast("array<string>") if legacy else F.filter(blocks, json_ok)

        def with_metas(metas: Column) -> Column:
            return F.struct(
                first_text(strip_elements(page, "svg"), "title").alias("title"),
                first_meta(metas, "name", "description").alias("description"),
                _meta_map(metas, "property", "og:").alias("og"),
                _meta_map(metas, "name", "twitter:").alias("twitter"),
                first_text(strip_elements(page, "script", "style"), "h1").alias("first_h1"),
                utf16_prefix(visible_text(page), 200).alias("preview"),
                json_ld.alias("json_ld"),
            )

        return let(tags_of(page, "meta"), with_metas)

    return let(strip_comments(html), read)


def snippet_markdown(s: Column) -> Column:
    """The snippet as the text its reader works with."""

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    def entries(m: Column) -> Column:
        return F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))

    head = F.concat(
        F.filter(F.array(line("Title", s["title"]), line("Description", s["description"])), lambda x: x.isNotNull()),
        entries(s["og"]),
        entries(s["twitter"]),
        F.filter(F.array(line("First H1", s["first_h1"])), lambda x: x.isNotNull()),
        F.when(F.size(s["json_ld"]) > 0, F.concat(F.array(F.lit(""), F.lit("JSON-LD:")), s["json_ld"])).otherwise(
            F.array().cast("array<string>")
        ),
        F.array(
            F.lit(""),
            F.concat(F.lit("Preview ("), utf16_len(s["preview"]).cast("string"), F.lit(" chars):")),
            s["preview"],
        ),
    )
    return F.array_join(head, "\n")


HREF = rf"(?i)<a(?:[\s/](?:{QUOTED}|[^<>]*?))?\shref\s*=\s*{ATTR_VALUE}"


def hrefs(html: Column) -> Column:
    """Targets of ``a[href]`` in document order; scripts and comments are no document."""
    kept = strip_elements(html, "script", "style", "noscript", comments=True)
    return F.transform(
        F.regexp_extract_all(kept, F.lit(HREF), F.lit(1)), lambda h: decode_entities(F.btrim(h, F.lit("\"'")))
    )


def markdown_heading_levels(md: Column) -> Column:
    marks = F.regexp_extract_all(F.concat(F.lit("\n"), md), F.lit(rf"\n(#{{1,6}}){WS_SAME_LINE}"), F.lit(1))
    return F.transform(marks, lambda m: F.length(m))


def html_heading_levels(html: Column) -> Column:
    kept = strip_elements(html, "script", "style", "noscript", "nav", "header", "footer", comments=True)
    return F.transform(
        F.regexp_extract_all(kept, F.lit(r"(?i)<h([1-6])(?:[\s/][^<>]*)?>"), F.lit(1)), lambda d: d.cast("int")
    )


def level_jumps(levels: Column) -> Column:
    """Adjacent pairs ``(from, to)`` that go down by more than one level."""
    pairs = F.zip_with(
        F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))),
        F.slice(levels, F.lit(2), F.greatest(F.size(levels), F.lit(1))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return F.filter(pairs, lambda p: p["b"] > p["a"] + 1)


def images(html: Column) -> Column:
    return tags_of(strip_elements(html, "script", "style", comments=True), "img")


def image_counts(html: Column) -> Column:
    tags = images(html)
    return F.struct(
        F.size(tags).cast("bigint").alias("total"),
        F.size(F.filter(tags, lambda t: js_trim(attr(t, "alt")) != "")).cast("bigint").alias("with_alt"),
    )


def fence_counts(md: Column) -> Column:
    m = F.concat(F.lit("\n"), md)
    return F.struct(
        count_matches(m, r"\n```").alias("fences"),
        count_matches(m, r"\n```[a-zA-Z0-9_+\-]+").alias("tagged"),
    )


def json_blocks(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(rf"(?s)```json{WS}*\n(.*?)\n```"), F.lit(1))


TAB_MARKER = r"""(?i)role\s*=\s*["']tab["']"""


def tab_markers(html: Column) -> Column:
    return count_matches(html, TAB_MARKER)


def head_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<head(?:[\s/][^<>]*)?>(.*?)(?:</head\s*>|<body\b|\z)", 1)


def redirect_markers(body: Column) -> Column:
    """Meta refresh and script redirects in a page body."""
    meta = body.rlike(r"""(?i)<meta[^<>]+http-equiv\s*=\s*["']?refresh["']?[^<>]*>""")
    script = body.rlike(
        r"""(?i)\b(?:window\.)?location\s*(?:\.href|\.replace|\.assign)?\s*=\s*['"]https?://"""
    ) | body.rlike(r"""(?i)\blocation\.replace\s*\(\s*['"]https?://""")
    return F.struct(meta.alias("meta_refresh"), script.alias("js_redirect"))


def login_markers(html: Column) -> Column:
    page = strip_comments(html)
    return F.struct(
        page.rlike(r"""(?i)<input(?:[\s/][^<>]*)?\stype\s*=\s*["']?password\b""").alias("password_field"),
        F.lower(F.regexp_extract(page, r"(?is)<title(?:[\s/][^<>]*)?>(.*?)(?:</title\s*>|\z)", 1))
        .rlike(r"sign[- ]?in|log[- ]?in|login")
        .alias("signin_title"),
    )


def link_rels(header: Column) -> Column:
    return F.regexp_extract_all(header, F.lit(r"""(?i)rel\s*=\s*["']?([a-z0-9_\-]+)["']?"""), F.lit(1))


# Root elements of client-side app shells, first match wins.
APP_SHELLS = [
    ("___gatsby", "Gatsby"),
    ("__next", "Next.js"),
    ("__nuxt", "Nuxt"),
    ("app", "Vue or SvelteKit"),
    ("root", "React"),
]


def rendering_signals(html: Column) -> Column:
    """App-shell framework, counts of substantive elements and length of the body text."""

    def read(kept: Column) -> Column:
        pieces = F.split(kept, r"(?i)<p(?:[\s/][^<>]*)?>")
        after_open = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        texts = F.transform(
            after_open, lambda p: js_trim(decode_entities(strip_tags(F.regexp_replace(p, r"(?is)</p\s*>.*", ""))))
        )
        framework = F.coalesce(
            *[
                F.when(kept.rlike(rf"""(?i)\sid\s*=\s*["']?{shell}["'\s>]"""), F.lit(name))
                for shell, name in APP_SHELLS
            ]
        )
        return F.struct(
            framework.alias("framework"),
            count_matches(kept, r"(?i)<h[1-3](?:[\s/][^<>]*)?>").alias("headings"),
            F.size(F.filter(texts, lambda t: utf16_len(t) > 40)).cast("bigint").alias("paragraphs"),
            count_matches(kept, r"(?i)<(?:pre|code)(?:[\s/][^<>]*)?>").alias("code_blocks"),
            utf16_len(collapse_ws(decode_entities(strip_tags(body_of(kept))))).alias("text_chars"),
        )

    return let(strip_elements(html, "script", "style", "noscript", comments=True), read)


def tab_panels(html: Column) -> Column:
    """Number of tab panels and the characters of their text, nested elements included."""
    return markup.panels_of(strip_elements(html, "script", "style", comments=True))


def content_budget(html: Column) -> Column:
    """Where the bytes of a page go, as non-overlapping segments that never exceed the total.

    The bytes of a kind of element are what removing it takes away.
    """
    size = F.octet_length

    def style_attrs(page: Column) -> Column:
        values = F.regexp_extract_all(page, F.lit(r"""(?i)\sstyle\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, v: total + size(v) - 2)

    # Each step removes one kind; ``let`` keeps every intermediate text for the next two uses.
    return let(strip_comments(html), lambda page: let(strip_elements(page, "script"), lambda no_script: let(
        strip_elements(no_script, "style"), lambda no_style: let(strip_elements(no_style, "svg"), lambda no_svg: let(
            strip_elements(no_svg, "noscript"), lambda quiet: let(
                strip_elements(quiet, "nav", "header", "footer"), lambda no_nav: _fit_to_total(
                    size(html).cast("bigint"),
                    [
                        ("inline JS", size(page) - size(no_script)),
                        ("inline CSS", size(no_script) - size(no_style) + style_attrs(no_style)),
                        ("SVG", size(no_style) - size(no_svg)),
                        ("nav/header/footer", size(quiet) - size(no_nav)),
                        ("content", size(main_part(no_nav))),
                    ],
                ),
            ),
        )),
    )))


def _total_bytes(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + p["bytes"])


def _segment(label: Column, size: Column) -> Column:
    return F.struct(label.alias("label"), size.cast("bigint").alias("bytes"))


def _fit_to_total(total: Column, parts: list[tuple[str, Column]]) -> Column:
    """Scale the parts down together if they exceed the total; what is left over is other markup."""

    def scale(raw: Column) -> Column:
        return let(
            _total_bytes(raw),
            lambda counted: F.when(
                counted > total,
                F.transform(raw, lambda p: _segment(p["label"], F.floor(p["bytes"] * (total / counted) + 0.5))),
            ).otherwise(raw),
        )

    def complete(scaled: Column) -> Column:
        other = _segment(F.lit("other markup"), F.greatest(total - _total_bytes(scaled), F.lit(0)))
        return F.transform(
            F.filter(F.concat(scaled, F.array(other)), lambda p: p["bytes"] > 0),
            lambda p: F.struct(
                p["label"].alias("label"), p["bytes"].alias("bytes"), (F.floor(p["bytes"] / total * 1000 + 0.5) / 10).alias("pct")
            ),
        )

    raw = F.array(*[_segment(F.lit(label), b) for label, b in parts])
    return let(let(raw, scale), complete)


def head_metadata(html: Column) -> Column:
    """Title, description, canonical link and og:title of the head; empty where missing."""
    head = head_of(strip_comments(html))
    metas, links = tags_of(head, "meta"), tags_of(head, "link")
    canonical = F.get(F.filter(links, lambda t: attr(t, "rel") == "canonical"), F.lit(0))
    return F.struct(
        F.coalesce(first_text(head, "title"), F.lit("")).alias("title"),
        F.coalesce(first_meta(metas, "name", "description"), F.lit("")).alias("description"),
        F.coalesce(js_trim(attr(canonical, "href")), F.lit("")).alias("canonical"),
        F.coalesce(first_meta(metas, "property", "og:title"), F.lit("")).alias("og_title"),
    )
