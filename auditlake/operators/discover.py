"""Page discovery: sitemaps first, else a breadth-first walk over the link table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import html as H
from auditlake.functions import urls as U
from auditlake.functions.text import js_trim
from auditlake.operators.windows import cap_per_site, first_k, first_seen, ordinal_within
from auditlake.session import stage

SITE = ["run_id", "site_id"]
# Parents whose links are numbered together.
PARENTS = 4096


def _entries(tag: str) -> Column:
    """Contents of the closed elements: cut at the opening tags, so that each part is read once."""
    parts = F.split("_xml", rf"<{tag}(?:\s[^<>]*)?>")
    closed = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(rf"</{tag}\s*>"))
    return F.transform(closed, lambda p: F.get(F.split(p, rf"</{tag}\s*>", 2), F.lit(0)))


def sitemap_locs(bodies: DataFrame) -> DataFrame:
    """Locations of each sitemap body: ``(sitemap_url, is_index, pos, loc)``.

    Split into entries first and then into their one ``loc``, so image locations are not taken for
    pages. Text that is no sitemap gives no rows.
    """
    xml = F.regexp_replace("body", H.COMMENT, "")
    is_index = F.col("_xml").rlike(r"<sitemapindex\b")
    entries = F.when(is_index, _entries("sitemap")).when(F.col("_xml").rlike(r"<urlset\b"), _entries("url"))
    one_loc = F.filter(entries, lambda e: F.regexp_count(e, F.lit(r"<loc\b")) == 1)
    found = F.transform(
        one_loc,
        lambda e: js_trim(
            H.decode_entities(F.regexp_replace(F.regexp_extract(e, r"(?s)<loc\b[^>]*>(.*?)</loc\s*>", 1), r"<!\[CDATA\[|\]\]>", ""))
        ),
    )
    kept = F.filter(found, lambda loc: loc != "")
    rows = bodies.select(*SITE, "sitemap_url", xml.alias("_xml"))
    return rows.select(*SITE, "sitemap_url", is_index.alias("is_index"), F.posexplode(kept).alias("pos", "loc"))


def expand_sitemaps(sites: DataFrame, locs: DataFrame) -> DataFrame:
    """Page URLs of every site's sitemap; an index is expanded one level, indexes below it dropped.

    Keeps ``seed_url`` and the place: ``parent`` (the child's place in the index, 0 without one) and
    ``pos`` in its file. A URL that occurs again keeps its first place.
    """
    root = F.concat(U.origin_of(F.col("seed_url")), F.lit("/sitemap.xml"))
    top = sites.select(*SITE, "seed_url", root.alias("sitemap_url")).join(locs, [*SITE, "sitemap_url"])
    place = F.col("pos").cast("bigint").alias("pos")
    flat = top.where(~F.col("is_index")).select(*SITE, "seed_url", F.lit(0).cast("bigint").alias("parent"), place, "loc")
    parents = top.where("is_index").select(*SITE, "seed_url", F.col("pos").alias("parent"), F.col("loc").alias("sitemap_url"))
    children = parents.join(locs.where(~F.col("is_index")), [*SITE, "sitemap_url"]).select(
        *SITE, "seed_url", F.col("parent").cast("bigint").alias("parent"), place, "loc"
    )
    return first_seen(flat.unionByName(children), [*SITE, "seed_url", "loc"], "parent", "pos")


def in_sitemap_scope(expanded: DataFrame) -> DataFrame:
    """Only pages of the seed's host at or below the seed's path."""
    seed = F.col("seed_url")
    return expanded.where(U.under_prefix(F.col("loc"), U.authority_of(seed), U.raw_path(seed)))


def page_links(pages: DataFrame) -> DataFrame:
    """Link table of crawled pages: normalised source, place on the page, href, normalised target."""
    rows = pages.select(*SITE, "url", F.posexplode(H.hrefs(F.col("raw_html"))).alias("link_idx", "href"))
    target = U.normalize_url(U.resolve_href(F.col("href"), F.col("url")))
    return rows.where(U.href_is_navigable(F.col("href"), "crawl")).select(
        *SITE, U.normalize_url(F.col("url")).alias("src_url"), "link_idx", "href", target.alias("abs_url")
    )


def scoped_edges(links: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct in-scope edges ``(src_url, url, link_idx)``, the first place on the page kept."""
    seeds = sites.select(*SITE, "seed_url")
    scoped = links.join(seeds, SITE).where(U.bfs_in_scope(F.col("abs_url"), F.col("seed_url")))
    return scoped.groupBy(*SITE, "src_url", F.col("abs_url").alias("url")).agg(F.min("link_idx").alias("link_idx"))


def bfs(links: DataFrame, sites: DataFrame, max_pages: int | None = None, max_depth: int = 6) -> DataFrame:
    """Breadth-first order of the pages of all sites: ``(url, pos, depth)`` from position 0.

    One join per level for all sites together. A queue visits the pages of a level in order of
    their parent's position and their place on its page, so that pair is what a level is numbered
    by. Pages at ``max_depth`` are listed but not expanded, and a site stops at ``max_pages``.
    Every level is written to the shared folder: lineage stays short, and the pages already seen
    are a union of at most ``max_depth`` small tables.
    """
    edges = stage(scoped_edges(links, sites), "edges")
    start = sites.select(*SITE, U.normalize_url(F.col("seed_url")).alias("url")).where(F.col("url").isNotNull())
    zero = F.lit(0).cast("bigint")
    frontier = stage(start.select(*SITE, "url", zero.alias("pos"), F.lit(0).alias("depth")), "level")
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, levels)
        reached = frontier.select(*SITE, F.col("url").alias("src_url"), F.col("pos").alias("parent")).join(
            edges, [*SITE, "src_url"]
        )
        place = F.min(F.struct("parent", "link_idx")).alias("_place")
        fresh = reached.groupBy(*SITE, "url").agg(place).join(seen.select(*SITE, "url"), [*SITE, "url"], "left_anti")
        if max_pages is None:
            placed = ordinal_within(fresh, SITE, "_place", "_n", block=F.floor(F.col("_place.parent") / PARENTS))
        else:
            placed = first_k(fresh, SITE, [F.col("_place")], max_pages, "_n").withColumn("_n", F.col("_n") - 1)
        sizes = seen.groupBy(*SITE).agg(F.count(F.lit(1)).alias("_seen"))
        numbered = placed.join(sizes, SITE).withColumn("pos", F.col("_seen") + F.col("_n"))
        if max_pages is not None:
            numbered = numbered.where(F.col("pos") < max_pages)
        frontier = stage(numbered.select(*SITE, "url", F.col("pos").cast("bigint").alias("pos"), F.lit(depth).alias("depth")), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def discover(sites: DataFrame, locs: DataFrame, links: DataFrame, cap: int = 10) -> DataFrame:
    """Page list of every site: its scoped sitemap if that has pages, else a walk from the seed.

    ``capped`` can only be true for sitemaps, since the walk itself stops at the cap.
    """
    scoped = stage(in_sitemap_scope(expand_sitemaps(sites, locs)), "sitemap-pages")
    listed = cap_per_site(scoped.withColumnRenamed("loc", "url"), cap, SITE, "parent", "pos")
    # At most ``cap`` rows per site are left to number.
    first = first_k(listed, SITE, [F.col("parent"), F.col("pos")], cap, "_n").withColumn("pos", (F.col("_n") - 1).cast("bigint"))
    from_sitemap = first.select(*SITE, "pos", "url", F.lit("sitemap").alias("source"), "capped")
    others = sites.join(scoped.select(*SITE).distinct(), SITE, "left_anti")
    walked = bfs(links, others, max_pages=cap).select(*SITE, "pos", "url", F.lit("bfs").alias("source"), F.lit(False).alias("capped"))
    return from_sitemap.unionByName(walked)
