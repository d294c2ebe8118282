"""Reader profiles: what each kind of reader gets of a page.

The wide form keeps a page's three profiles side by side on one row, so comparing them needs no
shuffle; the long form has one row per page and profile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.dims import PROFILES
from auditlake.functions import html as H
from auditlake.functions.text import byte_len, clamp01, js_round, summarize_error, tokens_est, utf16_len

KEYS = ["run_id", "site_id", "page_index", "url"]


def _status_ok(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def _http_reason(status: Column) -> Column:
    return F.concat(F.lit("HTTP "), status.cast("string"))


def _profile(ok: Column, reason: Column, filled: Column, size: Column, markdown: Column, artifact: Column) -> Column:
    """One profile; with ``filled`` false all its metrics are zero."""
    zero = F.lit(0).cast("bigint")
    chars = F.when(filled, utf16_len(markdown)).otherwise(zero)
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"),
        reason.alias("reason"),
        F.when(filled, byte_len(size)).otherwise(zero).alias("bytes"),
        chars.alias("chars"),
        tokens_est(chars).alias("tokens_est"),
        F.when(filled, markdown).otherwise(F.lit("")).alias("markdown"),
        F.when(filled, artifact).alias("artifact"),
    )


def with_profiles(pages: DataFrame, legacy_snippet: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages plus structs ``rawHttp``, ``headless``, ``snippet`` and the parsed ``snippet_data``.

    A failed raw fetch keeps its metrics when there was a body; the other two fall to zeros. The
    conversions sit in a projection of their own so that each runs once per page. ``keep`` names further columns
    to carry along.
    """
    status = F.col("raw_status")
    fetched = F.col("fetch_error").isNull() & F.col("raw_html").isNotNull()
    served = fetched & _status_ok(status)
    rendered = F.col("rendered_error").isNull() & F.col("rendered_html").isNotNull()
    converted = pages.select(
        *KEYS,
        *keep,
        "raw_status",
        "fetch_error",
        "rendered_error",
        F.when(fetched, F.col("raw_html")).alias("_raw"),
        F.when(rendered, F.col("rendered_html")).alias("_rendered"),
        H.html_to_markdown(F.when(fetched, F.col("raw_html"))).alias("_raw_md"),
        F.when(served, H.snippet(F.col("raw_html"), legacy=legacy_snippet)).alias("snippet_data"),
    )
    # A page that renders to what was served is not converted again.
    same = F.col("_rendered").eqNullSafe(F.col("_raw"))
    rendered_md = F.when(same, F.col("_raw_md")).otherwise(H.html_to_markdown(F.when(~same, F.col("_rendered"))))
    shown = converted.withColumns({"_snippet_md": H.snippet_markdown(F.col("snippet_data")), "_rendered_md": rendered_md})
    error = F.coalesce("fetch_error", F.lit("fetch failed"))
    fetched = F.col("_raw").isNotNull()
    rendered = F.col("_rendered").isNotNull()
    served = F.col("snippet_data").isNotNull()
    return shown.select(
        *KEYS,
        *keep,
        "raw_status",
        _profile(
            fetched & _status_ok(status),
            F.when(~fetched, error).when(status >= 400, _http_reason(status)),
            fetched,
            F.col("_raw"),
            F.col("_raw_md"),
            F.col("_raw"),
        ).alias("rawHttp"),
        _profile(
            rendered,
            F.when(~rendered, summarize_error(F.coalesce("rendered_error", F.lit("")))),
            rendered,
            F.col("_rendered"),
            F.col("_rendered_md"),
            F.col("_rendered"),
        ).alias("headless"),
        _profile(
            served,
            F.when(~fetched, error).when(~served, _http_reason(status)),
            served,
            F.col("_snippet_md"),
            F.col("_snippet_md"),
            F.to_json("snippet_data"),
        ).alias("snippet"),
        "snippet_data",
    )


class ProfileRegistry:
    """Named profile builders, each ``DataFrame -> DataFrame`` of long profile rows.

    Registering a name again replaces its builder in place; order is that of first registration.
    """

    def __init__(self) -> None:
        self._builders: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, build: Callable[[DataFrame], DataFrame]) -> None:
        self._builders[name] = build

    def names(self) -> list[str]:
        return list(self._builders)

    def run(self, name: str, pages: DataFrame) -> DataFrame:
        if name not in self._builders:
            raise KeyError(f"unknown profile: {name}")
        return self._builders[name](pages)

    def run_all(self, pages: DataFrame) -> DataFrame:
        first, *others = [self.run(name, pages) for name in self._builders]
        for df in others:
            first = first.unionByName(df)
        return first


def long_profile(wide: DataFrame, name: str) -> DataFrame:
    return wide.select(
        *KEYS, F.lit(name).alias("profile"), F.lit(PROFILES.index(name)).alias("profile_ord"), f"{name}.*"
    )


def built_in_profiles() -> ProfileRegistry:
    """The three profiles as separate builders; prefer ``page_profiles`` when all are wanted."""
    registry = ProfileRegistry()
    for name in PROFILES:
        registry.register(name, lambda pages, name=name: long_profile(with_profiles(pages), name))
    return registry


def page_profiles(wide: DataFrame) -> DataFrame:
    """Long form of ``with_profiles``: one pass, three rows per page."""
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("profile"), F.lit(i).alias("profile_ord"), F.col(p).alias("r"))
            for i, p in enumerate(PROFILES)
        ]
    )
    return wide.select(*KEYS, F.explode(rows).alias("p")).select(*KEYS, "p.profile", "p.profile_ord", "p.r.*")


def js_gated(raw: Column, rendered: Column) -> Column:
    return clamp01(F.coalesce(F.try_divide((rendered - raw).cast("double"), rendered), F.lit(0.0)))


def page_diff(wide: DataFrame) -> DataFrame:
    """Largest profile, each profile's share of it and the script-gated share, without a shuffle."""
    chars = {p: F.coalesce(F.col(f"{p}.chars"), F.lit(0)) for p in PROFILES}
    largest = F.greatest(*chars.values())
    name = F.coalesce(*[F.when(chars[p] == largest, F.lit(p)) for p in PROFILES])

    def share(p: str) -> Column:
        return F.coalesce(F.try_divide(chars[p].cast("double"), largest), F.lit(0.0))

    return wide.select(
        *KEYS,
        name.alias("largest_profile"),
        F.create_map(*[x for p in PROFILES for x in (F.lit(p), share(p))]).alias("chars_fraction"),
        js_gated(chars["rawHttp"], chars["headless"]).alias("js_gated_fraction"),
    )


def pivot_profiles(profiles: DataFrame, value: str = "chars") -> DataFrame:
    """One row per page with a column per profile; profiles that are missing count 0."""
    wide = profiles.groupBy(*KEYS).pivot("profile", PROFILES).agg(F.first(value))
    return wide.fillna(0, PROFILES)


def page_diff_long(profiles: DataFrame) -> DataFrame:
    """``page_diff`` for stored long profiles, from sums per page that combine before the shuffle."""
    wide = profiles.groupBy(*KEYS).agg(
        *[
            F.struct(F.coalesce(F.max(F.when(F.col("profile") == p, F.col("chars"))), F.lit(0)).alias("chars")).alias(p)
            for p in PROFILES
        ]
    )
    return page_diff(wide)


def site_stats(wide: DataFrame) -> DataFrame:
    """Pages, mean script-gated share over all pages and rounded mean tokens per profile."""
    gated = js_gated(F.coalesce("rawHttp.chars", F.lit(0)), F.coalesce("headless.chars", F.lit(0)))
    return wide.groupBy("run_id", "site_id").agg(
        F.count(F.lit(1)).alias("pages_scanned"),
        (F.sum(gated) / F.count(F.lit(1))).alias("avg_js_gated_fraction"),
        *[
            js_round(F.sum(F.coalesce(F.col(f"{p}.tokens_est"), F.lit(0))) / F.count(F.lit(1))).alias(f"avg_tokens_{p}")
            for p in PROFILES
        ],
    )


def wide_from_features(features: DataFrame) -> DataFrame:
    """Staged page features in the shape that ``site_stats`` reads."""
    return features.select(
        *KEYS,
        F.struct(F.col("raw_chars").alias("chars"), F.col("tokens_rawHttp").alias("tokens_est")).alias("rawHttp"),
        F.struct(F.col("headless_chars").alias("chars"), F.col("tokens_headless").alias("tokens_est")).alias("headless"),
        F.struct(F.col("tokens_snippet").alias("tokens_est")).alias("snippet"),
    )


def page_matrix(wide: DataFrame) -> DataFrame:
    """Tokens, characters and share of the page's largest profile."""
    chars = [F.coalesce(F.col(f"{p}.chars"), F.lit(0)) for p in PROFILES]
    most = F.greatest(F.lit(1), *chars)
    out = wide.select(*KEYS, *[c.alias(f"chars_{p}") for c, p in zip(chars, PROFILES)],
                      *[F.coalesce(F.col(f"{p}.tokens_est"), F.lit(0)).alias(f"tokens_{p}") for p in PROFILES],
                      *[(c / most).alias(f"share_{p}") for c, p in zip(chars, PROFILES)])
    return out


def page_divergence(wide: DataFrame) -> DataFrame:
    """How far raw HTML falls short of the rendered page, flagged from 30 % on."""
    raw, rendered = F.coalesce("rawHttp.chars", F.lit(0)), F.coalesce("headless.chars", F.lit(0))
    share = F.when(rendered > 0, js_round((rendered - raw) / rendered * 100)).otherwise(F.lit(0))
    pct = F.greatest(F.lit(0), F.least(F.lit(100), share)).cast("bigint")
    return wide.select(*KEYS, pct.alias("divergence_pct")).withColumn("show_divergence", F.col("divergence_pct") >= 30)


def spread_tone(raw: Column, rendered: Column) -> Column:
    return (
        F.when(raw.isNull() | rendered.isNull(), F.lit("neutral"))
        .when((raw == 0) | (rendered == 0), F.lit("broken"))
        .when(raw / rendered < 0.6, F.lit("partial"))
        .otherwise(F.lit("good"))
    )


def profile_statuses(stats: DataFrame) -> DataFrame:
    """``good``, ``partial`` or ``broken`` per profile of each site, in long form."""
    rendered = F.coalesce(F.col("avg_tokens_headless"), F.lit(0))
    rows = []
    for i, p in enumerate(PROFILES):
        t = F.coalesce(F.col(f"avg_tokens_{p}"), F.lit(0))
        status = (
            F.when(t == 0, F.lit("broken")).when((rendered > 0) & (t / rendered < 0.5), F.lit("partial")).otherwise(F.lit("good"))
        )
        retrieval = F.when(
            (status == "partial") & (rendered > 0), F.greatest(F.lit(0), F.least(F.lit(100), js_round(t / rendered * 100)))
        )
        rows.append(
            F.struct(
                F.lit(p).alias("profile"), F.lit(i).alias("profile_ord"), t.alias("tokens"), status.alias("status"),
                retrieval.cast("bigint").alias("retrieval_pct"),
            )
        )
    return stats.select("run_id", "site_id", F.explode(F.array(*rows)).alias("p")).select("run_id", "site_id", "p.*")


def skipped_profiles(wide: DataFrame) -> DataFrame:
    """Profiles whose first page says it was skipped."""
    reasons = F.struct(*[F.when(~F.col(f"{p}.ok"), F.col(f"{p}.reason")).alias(p) for p in PROFILES])
    first = wide.groupBy("run_id", "site_id").agg(F.min_by(reasons, F.col("page_index")).alias("r"))
    rows = F.array(*[F.struct(F.lit(p).alias("profile"), F.col(f"r.{p}").alias("reason")) for p in PROFILES])
    long = first.select("run_id", "site_id", F.explode(rows).alias("p")).select("run_id", "site_id", "p.*")
    return long.where(F.col("reason").startswith("Skipped"))


def with_skips(statuses: DataFrame, skipped: DataFrame) -> DataFrame:
    """Statuses with ``skipped`` where the first page was; one row per site and profile on both sides."""
    marks = skipped.select("run_id", "site_id", "profile", F.col("reason").alias("skip_reason"))
    return statuses.join(marks, ["run_id", "site_id", "profile"], "left").withColumn(
        "status", F.when(F.col("skip_reason").isNotNull(), F.lit("skipped")).otherwise(F.col("status"))
    )
