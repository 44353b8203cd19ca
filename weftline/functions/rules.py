"""Predicates and small decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Markers of blocking pages.
BLOCK_BODY = ("akamai", "page_owner", "access denied", "reference #", "edgesuite.net")
BLOCK_CODES = ("GE401001",)
INTERSTITIAL = ("bm-verify", "/interstitial/ic.html", "triggerinterstitialchallenge")
SHORT_BODY = 8000
MISSING_PROFILE = ('"error_type":"user_not_found"', '"page_not_found"', "sorry, this page isn't available")
SIGNED_OUT = '"url":"userbyrestid","status":401'
NEUTRAL_CHROMA, DARKEST, LIGHTEST = 8, 0.04, 0.93
ASPECT = (0.4, 2.5)


def _has(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def block(status: Column, headers: Column, body: Column) -> Column:
    """``struct<provider, reason>`` of a page that blocks crawlers, else null."""
    low, values = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(F.array_join(F.map_values(headers), " "), F.lit("")))
    found = lambda provider, reason: F.struct(F.lit(provider).alias("provider"), F.lit(reason).alias("reason"))
    blank_title = F.coalesce(body, F.lit("")).rlike(r"(?i)<title>\s*&nbsp;\s*</title>") & (F.length(body) < SHORT_BODY)
    return (
        F.when(status == 429, found("unknown", "http_429_rate_limited"))
        .when((status == 403) & (_has(low, BLOCK_BODY) | _has(values, ("ak_bmsc", "akamai"))), found("akamai", "http_403_forbidden"))
        .when(status == 403, found("unknown", "http_403_forbidden"))
        .when((status == 400) & (_has(values, ("akamaighost",)) | _has(F.coalesce(body, F.lit("")), BLOCK_CODES)), found("akamai", "http_400_bad_request"))
        .when((status == 200) & (_has(low, INTERSTITIAL) | blank_title), found("akamai", "interstitial_challenge"))
    )


def html_content(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False))


def profile_page_ok(html: Column) -> Column:
    return ~_has(html, MISSING_PROFILE)


def timeline_page_ok(html: Column) -> Column:
    return ~html.contains(SIGNED_OUT)


def complete(name: Column, sku: Column) -> Column:
    return F.coalesce((name != "") & (sku != ""), F.lit(False))


def large_enough(width: Column, height: Column, least_width: Column, least_height: Column) -> Column:
    return (width >= least_width) & (height >= least_height)


def aspect_ok(width: Column, height: Column, low: float = ASPECT[0], high: float = ASPECT[1]) -> Column:
    return F.coalesce((width > 0) & (height > 0) & (width / height).between(low, high), F.lit(False))


def neutral(r: Column, g: Column, b: Column) -> Column:
    """Grey, nearly black or nearly white."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light = (top + low) / 2.0 / 255.0
    return (top - low <= NEUTRAL_CHROMA) | (light < DARKEST) | (light > LIGHTEST)


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "product", 0).when(kind == "editorial", 1).when(kind == "social", 2).when(kind == "other", 3).when(kind.isNull(), 99).otherwise(4)


def fresh(updated_at: Column, today: Column) -> Column:
    return F.coalesce(F.to_date(updated_at) == today, F.lit(False))
