"""URL expressions built from regexes, so that odd but common URLs (spaces,
bars, unescaped letters) still have a host; a strict parser returns null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagegauge.functions.text import js_trim, let, nullif_blank

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


def url_scheme(url: Column) -> Column:
    return nullif_blank(F.lower(F.regexp_extract(url, _SCHEME, 1)))


def url_host(url: Column) -> Column:
    """Lower-case host name without user info or port; null if there is none."""
    return nullif_blank(F.lower(F.regexp_extract(url, _AUTHORITY + r"([^/?#:]*)", 1)))


def url_port(url: Column) -> Column:
    """Port as written, null if absent or the default of the scheme."""
    port = nullif_blank(F.regexp_extract(url, _AUTHORITY + r"[^/?#:]*:([0-9]+)", 1))
    scheme = url_scheme(url)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(~F.coalesce(default, F.lit(False)), port)


def url_origin(url: Column) -> Column:
    """scheme://host[:port]; null without a host."""
    port = F.coalesce(F.concat(F.lit(":"), url_port(url)), F.lit(""))
    return F.concat(url_scheme(url), F.lit("://"), url_host(url), port)


def url_path(url: Column) -> Column:
    """Path, '/' if empty; null for a URL without a host."""
    path = F.regexp_extract(url, _AUTHORITY + r"[^/?#]*([^?#]*)", 1)
    return F.when(url_host(url).isNotNull(), F.when(path == "", "/").otherwise(path))


def url_tail(url: Column) -> Column:
    """Query and fragment, with their marks."""
    return F.regexp_extract(url, r"^[^?#]*([?#].*)?", 1)


def host_of(site: Column) -> Column:
    """Host of a URL or bare site name, lower case, without 'www.'."""
    with_scheme = F.when(F.startswith(site, F.lit("http")), site).otherwise(
        F.concat(F.lit("https://"), site)
    )
    return F.regexp_replace(F.coalesce(url_host(with_scheme), site), r"^www\.", "")


def is_platform_host(url: Column, platform: str = "facebook") -> Column:
    """Host is the platform's own domain, one of its subdomains or its short name."""
    short = {"facebook": ["fb.com"]}.get(platform, [])
    host = F.coalesce(host_of(url), F.lit(""))
    return (
        (host == f"{platform}.com") | F.endswith(host, F.lit(f".{platform}.com")) | host.isin(short)
    )


def same_page(a: Column, b: Column) -> Column:
    """Origin and path are equal."""
    return F.coalesce((url_origin(a) == url_origin(b)) & (url_path(a) == url_path(b)), F.lit(False))


def _without_dots(path: Column) -> Column:
    """Resolve . and .. segments of an absolute path."""
    parts = F.split(F.substring(path, 2, 1 << 20), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def url_normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, '/' for an empty path, dots resolved."""
    path = url_path(url)
    path = F.when(F.contains(path, F.lit("/.")), _without_dots(path)).otherwise(path)
    return F.concat(url_origin(url), path, url_tail(url))


def url_key(url: Column) -> Column:
    """Join key of a page: normal form without the fragment."""
    return F.regexp_replace(url_normalize(url), r"#.*\z", "")


def url_resolve(href: Column, base: Column) -> Column:
    """Absolute URL of a link on page `base`; null for script links, page anchors,
    and relative links without a usable base."""
    link = js_trim(href)
    base_dir = F.regexp_replace(url_path(base), r"[^/]*\z", "")
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    absolute = (
        F.when(url_scheme(link).isin("http", "https") & url_host(link).isNull(), F.lit(None))
        .when(url_scheme(link).isNotNull(), link)
        .when(F.startswith(link, F.lit("//")), F.concat(url_scheme(base), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(url_origin(base), link))
        .when(F.startswith(link, F.lit("?")), F.concat(url_origin(base), url_path(base), link))
        .when(link == "", F.concat(url_origin(base), url_path(base), base_query))
        .otherwise(F.concat(url_origin(base), base_dir, link))
    )
    skip = (
        href.isNull() | (href == "") | F.startswith(href, F.lit("javascript:")) | F.startswith(href, F.lit("#"))
    )
    return F.when(
        ~skip,
        let(absolute, lambda u: F.when(url_host(u).isNotNull(), url_normalize(u)).otherwise(u)),
    )


def normalize_links(links: Column, of_strings: bool = False) -> Column:
    """Links as array<struct<url,text>> from strings or from {url,text} structs."""
    if of_strings:
        return F.transform(links, lambda u: F.struct(u.alias("url"), F.lit("").alias("text")))
    return F.transform(
        links,
        lambda x: F.struct(
            F.coalesce(x["url"], F.lit("")).alias("url"),
            js_trim(F.coalesce(x["text"], F.lit(""))).alias("text"),
        ),
    )


def is_external(url: Column, origin: Column) -> Column:
    """Starts with http and lies on another origin."""
    return F.coalesce(F.startswith(url, F.lit("http")) & ~F.startswith(url, origin), F.lit(False))
