"""URL expressions; all are Catalyst expressions, and none raises on malformed input (null stays null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of links that are no pages.
FILE_ENDINGS = (
    "pdf doc docx ppt pptx xls xlsx zip rar tar gz jpg jpeg png gif svg mp4 mp3 avi mov webp ico css js xml txt woff woff2 ttf eot json rss atom dmg exe pkg"
).split()
#: Places where sites keep sitemaps.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps/sitemap.xml", "/sitemap1.xml", "/feeds/sitemap.xml", "/sitemap-pages.xml", "/xmlsitemap.php")
#: Hosts of social networks.
SOCIAL_HOSTS = ("facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "pinterest.com", "snapchat.com", "tiktok.com")


def origin(url: Column) -> Column:
    """Scheme and authority, port included; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1), F.lit(""))


def origin_without_port(url: Column) -> Column:
    return F.regexp_replace(origin(url), r":\d+$", "")


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def path(url: Column) -> Column:
    """The path without query and fragment; empty where there is none."""
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def last_segment(text: Column) -> Column:
    return F.element_at(F.split(text, "/"), -1)


def lookup_target(url: Column) -> Column:
    """The form in which a site is looked up: trimmed, with a scheme, and '/' as the path of a bare host."""
    trimmed = F.trim(url)
    full = F.when(trimmed.rlike(r"^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    bare = path(full).isin("", "/")
    return F.when(bare & origin(full).isNotNull(), F.concat(origin(full), F.lit("/"))).otherwise(full)


def sitemap_kind(url: Column) -> Column:
    """'sitemap' for entries that are sitemaps themselves, 'page' for others, null for what is no URL."""
    child = F.lower(url).contains("sitemap") & F.lower(url).rlike(r"\.xml(\.gz)?$")
    return F.when(is_web_url(url), F.when(child, F.lit("sitemap")).otherwise(F.lit("page")))


def link_is_checked(link: Column) -> Column:
    """Whether a link could be a page: long enough, no other scheme or anchor, no file ending in its path (in any case)."""
    bare = F.regexp_replace(F.lower(link), r"[?#].*$", "")
    other = link.rlike(r"^(mailto:|tel:|javascript:|ftp:|#|data:)")
    return F.coalesce((F.length(link) >= 4) & ~other & ~bare.rlike(r"\.(" + "|".join(FILE_ENDINGS) + r")$"), F.lit(False))


def _joined_path(base_path: Column, link_path: Column) -> Column:
    """A relative or rooted path against a base's: a relative one takes the place of the base's last segment, and empty ones in between fall out; dot segments are resolved."""
    folder = F.split(base_path, "/")
    folder = F.when(F.element_at(folder, -1) == "", folder).otherwise(F.slice(folder, 1, F.size(folder) - 1))
    relative = F.concat(folder, F.split(link_path, "/"))
    relative = F.filter(relative, lambda x, i: (x != "") | (i == 0) | (i == F.size(relative) - 1))
    parts = F.when(link_path.startswith("/"), F.split(link_path, "/")).otherwise(relative)
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    done = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    joined = F.array_join(done, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, link: Column) -> Column:
    """A link as an absolute URL: absolute, protocol-relative, rooted, query, fragment or relative to the base's folder; dot segments are resolved."""
    href = F.trim(link)
    tail = F.regexp_extract(href, r"^[^?#]*([?#].*)?$", 1)
    relative = F.concat(origin(base), _joined_path(path(base), F.regexp_replace(href, r"[?#].*$", "")), tail)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href == "", base)
        .otherwise(relative)
    )
