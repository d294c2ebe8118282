"""URL column functions.

``try_parse_url`` refuses characters that occur in real hrefs and keeps dot segments, so URLs are
split with one pattern instead. Only http and https URLs have a host here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import js_trim, let

SPLIT = r"(?i)^(https?)://([^/?#\\]+)([^?#]*)(\?[^#]*)?"
BAD_AUTHORITY = r"[ <>^`{|}%\"]"


def _part(u: Column, group: int) -> Column:
    return F.regexp_extract(u, SPLIT, group)


def scheme_of(u: Column) -> Column:
    return F.lower(_part(u, 1))


def authority_of(u: Column) -> Column:
    """Host with port in lower case, default ports dropped; empty if there is none."""
    host = F.lower(_part(u, 2))
    return F.when(scheme_of(u) == "http", F.regexp_replace(host, r":80\z", "")).otherwise(
        F.regexp_replace(host, r":443\z", "")
    )


def is_url(u: Column) -> Column:
    return F.coalesce((_part(u, 2) != "") & ~_part(u, 2).rlike(BAD_AUTHORITY), F.lit(False))


def raw_path(u: Column) -> Column:
    """Path with the root written as ``/``."""
    path = _part(u, 3)
    return F.when(path == "", F.lit("/")).otherwise(path)


def query_of(u: Column) -> Column:
    """Query with its ``?``; a lone ``?`` stays."""
    return F.regexp_extract(u, SPLIT, 4)


def url_parts(u: Column) -> Column:
    """All parts of a URL as a struct, for expressions that need several of them."""
    split = F.struct(
        F.lower(_part(u, 1)).alias("scheme"),
        F.lower(_part(u, 2)).alias("host"),
        _part(u, 3).alias("path"),
        _part(u, 4).alias("query"),
    )

    def finish(p: Column) -> Column:
        port = F.when(p["scheme"] == "http", F.lit(":80")).otherwise(F.lit(":443"))
        authority = F.when(p["host"].endswith(port), F.left(p["host"], F.length(p["host"]) - F.length(port))).otherwise(p["host"])
        return F.struct(
            F.coalesce((p["host"] != "") & ~p["host"].rlike(BAD_AUTHORITY), F.lit(False)).alias("ok"),
            p["scheme"].alias("scheme"),
            F.concat(p["scheme"], F.lit("://"), authority).alias("origin"),
            F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]).alias("path"),
            p["query"].alias("query"),
        )

    return let(split, finish)


def origin_of(u: Column) -> Column:
    return F.when(is_url(u), F.concat(scheme_of(u), F.lit("://"), authority_of(u)))


def host_of(u: Column) -> Column:
    """Host without port; text that is no URL comes back unchanged."""
    return F.when(is_url(u), F.regexp_replace(authority_of(u), r":[0-9]+\z", "")).otherwise(u)


def path_of(u: Column) -> Column:
    """Path for display: one trailing slash removed, root kept."""
    short = F.regexp_replace(raw_path(u), r"/\z", "")
    return F.when(is_url(u), F.when(short == "", F.lit("/")).otherwise(short)).otherwise(u)


def host_and_path(u: Column) -> Column:
    path = raw_path(u)
    return F.when(
        is_url(u), F.concat(authority_of(u), F.when(path == "/", F.lit("")).otherwise(path))
    ).otherwise(u)


def bare_path(u: Column) -> Column:
    """Path without any trailing slashes; the root is empty."""
    return F.regexp_replace(_part(u, 3), r"/+\z", "")


def normalize_url(u: Column) -> Column:
    """Fragment dropped, trailing slashes of the path dropped, query kept."""
    return let(
        url_parts(u),
        lambda p: F.when(
            p["ok"],
            F.concat(
                p["origin"],
                F.coalesce(F.nullif(F.regexp_replace(p["path"], r"/+\z", ""), F.lit("")), F.lit("/")),
                p["query"],
            ),
        ),
    )


def without_fragment(u: Column) -> Column:
    return F.regexp_replace(u, r"#.*", "")


UNSAFE_IN_PATH = r"[^\x21-\x7E]|[\"<>^`{}]"
UNSAFE_IN_QUERY = r"[^\x21-\x7E]|[\"'<>]"
UNSAFE_IN_FRAGMENT = r"[^\x21-\x7E]|[\"<>`]"


def _percent_encoded(text: Column, unsafe: str) -> Column:
    """UTF-8 percent encoding of the characters matching ``unsafe``; most text has none."""

    def encode(t: Column) -> Column:
        chars = F.transform(
            F.split(t, ""),
            lambda ch: F.when(
                ch.rlike(unsafe), F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
            ).otherwise(ch),
        )
        return F.when(t.rlike(unsafe), F.array_join(chars, "")).otherwise(t)

    return let(text, encode)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path; most paths have none."""

    def walk(p: Column) -> Column:
        joined = F.aggregate(
            F.split(F.substring(p, F.lit(2), F.length(p)), "/"),
            F.lit(""),
            lambda done, seg: F.when(
                F.lower(seg).isin("..", ".%2e", "%2e.", "%2e%2e"), F.regexp_replace(done, r"/[^/]*\z", "")
            )
            .when(F.lower(seg).isin(".", "%2e"), done)
            .otherwise(F.concat(done, F.lit("/"), seg)),
        )
        ends = F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}\z"), F.lit("/")).otherwise(F.lit(""))
        resolved = F.coalesce(F.nullif(F.concat(joined, ends), F.lit("")), F.lit("/"))
        return F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"), resolved).otherwise(p)

    return let(path, walk)


def clean_url(u: Column) -> Column:
    """Serialise an absolute http(s) URL: lower-case host, dots resolved, unsafe text encoded."""

    def serialise(text: Column) -> Column:
        return let(
            url_parts(text),
            lambda p: F.when(
                p["ok"],
                F.concat(
                    p["origin"],
                    _percent_encoded(_without_dots(F.translate(p["path"], "\\", "/")), UNSAFE_IN_PATH),
                    _percent_encoded(p["query"], UNSAFE_IN_QUERY),
                    _percent_encoded(F.regexp_extract(text, r"(#.*)\z", 1), UNSAFE_IN_FRAGMENT),
                ),
            ),
        )

    return let(u, serialise)


def base_parts(base: Column) -> Column:
    """What hrefs are resolved against, computed once per page."""

    def build(p: Column) -> Column:
        return F.struct(
            p["ok"].alias("ok"),
            p["scheme"].alias("scheme"),
            p["origin"].alias("origin"),
            p["path"].alias("path"),
            F.regexp_extract(p["path"], r"^(.*/)", 1).alias("folder"),
            without_fragment(base).alias("here"),
        )

    return let(url_parts(base), build)


def resolve_against(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` given ``base_parts``; NULL where it cannot be parsed.

    Other schemes (``mailto:`` and the like) come back as written: they have no host.
    """

    def resolve(h: Column) -> Column:
        web = (
            F.when(h == "", base["here"])
            .when(h.startswith("#"), F.concat(base["here"], h))
            .when(h.rlike(r"(?i)^https?://"), h)
            .when(h.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit("://"), F.substring(h, F.lit(3), F.length(h))))
            .when(h.startswith("/"), F.concat(base["origin"], h))
            .when(h.startswith("?"), F.concat(base["origin"], base["path"], h))
            .otherwise(F.concat(base["origin"], base["folder"], h))
        )
        other_scheme = h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~h.rlike(r"(?i)^https?:")
        return F.when(other_scheme, h).when(base["ok"], clean_url(web))

    return let(js_trim(href), resolve)


def resolve_href(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``."""
    return let(base_parts(base), lambda b: resolve_against(href, b))


def under_prefix(u: Column, authority: Column, prefix: Column) -> Column:
    """Same host and at or below ``prefix``, cut at a segment boundary."""
    path = bare_path(u)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    root = F.regexp_replace(prefix, r"/+\z", "")
    below = F.when(root == "", path.startswith("/")).otherwise(path.startswith(F.concat(root, F.lit("/"))))
    return F.coalesce(is_url(u) & (authority_of(u) == authority) & ((path == root) | below), F.lit(False))


def bfs_in_scope(u: Column, seed: Column) -> Column:
    """Same host and the path starts with the seed's path as plain text, without a boundary."""
    return F.coalesce(
        is_url(u) & (authority_of(u) == authority_of(seed)) & bare_path(u).startswith(bare_path(seed)),
        F.lit(False),
    )


def md_variant(u: Column) -> Column:
    path = raw_path(u)
    stem = F.when(path == "/", F.lit("/index")).otherwise(F.regexp_replace(path, r"/\z", ""))
    return F.when(is_url(u), F.concat(origin_of(u), stem, F.lit(".md"), query_of(u)))


def is_md_url(u: Column) -> Column:
    return raw_path(u).endswith(".md")


def href_is_navigable(href: Column, mode: str = "check") -> Column:
    """``crawl`` skips mailto/javascript as written; ``check`` also tel, in any case."""
    schemes = r"^(?:mailto|javascript):" if mode == "crawl" else r"(?i)^(?:mailto|tel|javascript):"
    return F.coalesce((href != "") & ~href.startswith("#") & ~href.rlike(schemes), F.lit(False))
