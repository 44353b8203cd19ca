"""Which social profiles of a handle exist, from captured profile pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules as R, text as T

#: Profile addresses (fixed values).
PROFILES = {"instagram": "https://www.instagram.com/{}/", "twitter": "https://x.com/{}"}


def profile_urls(handles: DataFrame) -> DataFrame:
    """``(brand_id, handle, network, url)`` to look at."""
    clean = T.social_handle(F.col("handle"))
    each = F.explode(F.create_map(*(F.lit(x) for kv in PROFILES.items() for x in kv))).alias("network", "template")
    return handles.select("brand_id", clean.alias("handle"), each).where("handle <> ''").select("brand_id", "handle", "network", F.replace("template", F.lit("{}"), F.col("handle")).alias("url"))


def present(wanted: DataFrame, pages: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``(brand_id, profiles map, status)``; ``pages`` are ``(url, status, html)``, ``users`` usernames known from an API.

    A brand without any profile keeps its row, with status ``none``.
    """
    low = F.lower("html")
    seen = wanted.join(pages.where("status = 200"), "url", "left")
    named = F.contains(low, F.concat(F.lit('"username":"'), "handle", F.lit('"')))
    if users is not None:
        known = users.select(F.lower("username").alias("handle")).distinct().withColumn("known", F.lit(True))
        seen = seen.join(known, "handle", "left")
    else:
        seen = seen.withColumn("known", F.lit(None).cast("boolean"))
    ok = F.when(F.col("html").isNull(), False).when(F.col("network") == "instagram", R.profile_page_ok(low) & (named | F.coalesce("known", F.lit(False)))).otherwise(R.timeline_page_ok(low))
    found = F.map_from_entries(F.sort_array(F.collect_list(F.when(ok, F.struct("network", "url")))))
    got = seen.groupBy("brand_id").agg(found.alias("profiles"))
    return got.withColumn("status", F.when(F.size("profiles") > 0, "ok").otherwise("none"))
