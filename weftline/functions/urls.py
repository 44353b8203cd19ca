"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hints in paths and image rules.
EDITORIAL_HINTS = ("/about", "/story", "/stories", "/journal", "/manifesto", "/editorial", "/sustainability", "/values", "/heritage", "/our-")
EDITORIAL_PROBES = ("/about", "/about-us", "/our-story", "/story", "/journal", "/manifesto", "/sustainability")
PRODUCT_HINTS = ("/p/", "/t/", "/product/", "/products/")
PRIORITY_HINTS = ("/w/", "/t/", "/products/", "/product/", "/p/", "/shop/")
IMAGE_EXTENSIONS = "jpg|jpeg|png|webp|gif"
BROKEN_TRANSFORM = "/w/(f_auto|fl_|c_scale|t_product|h_1[.]0|w_1[.]0|fl_layer_apply)"
STYLE_CODE = "^[A-Z0-9]*[0-9][A-Z0-9]*-[0-9]+$"

_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def defragment(url: Column) -> Column:
    """The URL without its fragment."""
    return F.regexp_replace(url, "#.*$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Authority, lower case, without one leading ``www.``; a port is kept."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), "^www[.]", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def brand_token(url: Column) -> Column:
    """The label before the last one, or the only one."""
    parts = F.split(host(url), "[.]")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(host(url))


def brand_name(url: Column) -> Column:
    token = brand_token(url)
    return F.when(token != "", F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substr(token, F.lit(2)))))


def same_site(url: Column, seed: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) == host(seed))


def plausible_image(url: Column) -> Column:
    low = F.lower(path(url))
    return scheme(url).isin("http", "https") & low.rlike(f"[.]({IMAGE_EXTENSIONS})$") & ~low.rlike(BROKEN_TRANSFORM)


def allowed_image(url: Column, seed: Column) -> Column:
    """A plausible image of the same site, or of a host that carries the site's name."""
    named = F.translate(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), ".-", "").contains(brand_token(seed)) & (brand_token(seed) != "")
    return plausible_image(url) & (same_site(url, seed) | named)


def absolute_image(raw: Column, base: Column) -> Column:
    """Absolute form of an image reference, or null; relative ones without a leading slash give null."""
    said = F.trim(raw)
    low = F.lower(said)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    full = (
        F.when((said == "") | low.startswith("data:") | low.startswith("blob:") | low.startswith("javascript:"), F.lit(None).cast("string"))
        .when(low.rlike("^https?://"), defragment(said)).when(said.startswith("//"), defragment(F.concat(F.lit("https:"), said)))
        .when(said.startswith("/"), defragment(F.concat(origin, said)))
    )
    return F.when(plausible_image(full), full)


def absolute_link(href: Column, base: Column) -> Column:
    """Absolute form of a link: full, ``//host``, ``/path``, ``?query``, or relative to the base's folder (dot segments resolved)."""
    said = F.trim(href)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), said)
    for _ in range(4):
        joined = F.regexp_replace(F.regexp_replace(joined, "/[.](/|$)", "/"), "(://[^/]+(?:/[^/]+)*?)/(?![.][.]/)[^/]+/[.][.](/|$)", "$1/")
    return (
        F.when(said.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), said).when(said.startswith("//"), F.concat(scheme(base), F.lit(":"), said))
        .when(said.startswith("/"), F.concat(origin, said)).when(said.startswith("?"), F.concat(origin, path(base), said))
        .when(said.startswith("#") | (said == ""), base).otherwise(joined)
    )


def _any(value: Column, hints: tuple[str, ...]) -> Column:
    return value.rlike("|".join(hints))


def is_editorial(url: Column) -> Column:
    return _any(F.lower(path(url)), EDITORIAL_HINTS)


def page_class(url: Column) -> Column:
    low = F.lower(path(url))
    return F.when(low.isin("", "/"), "homepage").when(_any(low, PRODUCT_HINTS), "pdp").when(_any(low, EDITORIAL_HINTS), "editorial").otherwise("other")


def sample_type(url: Column) -> Column:
    """Page type of a sample: the whole URL is looked at, listings first."""
    low = F.lower(url)
    return F.when(low.rlike("/w/|/shop/|/collection"), "listing").when(low.rlike("/t/|/product/|/p/"), "pdp").when(path(url).isin("", "/"), "homepage").otherwise("other")


def is_priority_link(url: Column) -> Column:
    return _any(url, PRIORITY_HINTS)


def profile_handle(url: Column, dots: bool = True) -> Column:
    """The only path segment of a profile URL, normalised; null where there is none."""
    from .text import social_handle

    got = F.regexp_extract(path(url), f"^/+([A-Za-z0-9_{'.' if dots else ''}]+)/?$", 1)
    return F.when(got != "", social_handle(got))


def post_permalink(code: Column) -> Column:
    return F.concat(F.lit("https://www.instagram.com/p/"), code, F.lit("/"))


def status_permalink(handle: Column, status: Column) -> Column:
    return F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), status)


def large_media(url: Column) -> Column:
    return F.when(url.contains("pbs.twimg.com") & ~url.contains("?"), F.concat(url, F.lit("?name=large"))).otherwise(url)


def style_code(value: Column, pattern: Column | str = STYLE_CODE) -> Column:
    """Whether the trimmed value is a style code; the pattern may be a column of configured patterns."""
    said = F.upper(F.trim(value))
    return F.coalesce(said.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(said, pattern), F.lit(False))


def sku_from_url(url: Column, pattern: str = STYLE_CODE) -> Column:
    """The last path segment that is a style code, upper case."""
    parts = F.reverse(F.split(F.trim(path(url), F.lit("/")), "/"))
    return F.upper(F.get(F.filter(parts, lambda p: F.upper(p).rlike(pattern)), F.lit(0)))


def image_match_keys(url: Column) -> Column:
    """The file name and the id-like path segments, lower case."""
    parts = F.split(F.lower(path(url)), "/")
    return F.array_distinct(F.filter(F.concat(F.array(F.element_at(parts, -1)), F.filter(parts, lambda p: p.rlike("^[a-f0-9-]{8,}$"))), lambda p: p != ""))


def slug(value: Column, default: str = "brand") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit(default)).otherwise(made)
