"""Posts and images from captured profile documents, as JSON column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, urls as U
from .products import json_objects

#: Weights of social snippets (fixed values).
BIO, CAPTION, POST = 2.5, 1.4, 1.3
MOST_POSTS, MOST_STATUSES = 12, 20


def _nodes(edges: Column) -> Column:
    return F.transform(F.from_json(edges, "array<struct<node:string>>"), lambda e: e["node"])


def profile_posts(payloads: DataFrame, most: int = MOST_POSTS) -> DataFrame:
    """``(profile, ord, node)`` of the first posts of each profile payload ``(profile, payload)``."""
    edges = F.get_json_object("payload", "$.data.user.edge_owner_to_timeline_media.edges")
    return payloads.select("profile", F.posexplode(F.slice(F.filter(_nodes(edges), lambda n: n.isNotNull()), 1, most)).alias("ord", "node"))


def profile_texts(payloads: DataFrame, most: int = MOST_POSTS) -> DataFrame:
    """``(profile, ord, kind, text, weight)``: the biography, then captions that are not promotional."""
    bio = payloads.select("profile", F.lit(-1).alias("ord"), F.lit("tagline").alias("kind"), T.snippet(F.get_json_object("payload", "$.data.user.biography")).alias("text"), F.lit(BIO).alias("weight"))
    posts = profile_posts(payloads, most).select("profile", "ord", F.lit("editorial").alias("kind"), T.caption(F.col("node")).alias("said"), F.lit(CAPTION).alias("weight"))
    posts = posts.where(~T.promotional(F.col("said"))).select("profile", "ord", "kind", T.snippet(F.col("said")).alias("text"), "weight")
    return bio.unionByName(posts).where("text is not null")


def profile_images(payloads: DataFrame, most: int = MOST_POSTS) -> DataFrame:
    """``(profile, ord, pos, url, post_url)``: still images of posts that are not promotional."""
    n = F.col("node")
    one = F.coalesce(F.get_json_object(n, "$.display_url"), F.when(F.get_json_object(n, "$.is_video") == "true", F.get_json_object(n, "$.thumbnail_src")))
    children = F.filter(_nodes(F.get_json_object(n, "$.edge_sidecar_to_children.edges")), lambda c: F.coalesce(F.get_json_object(c, "$.is_video"), F.lit("false")) != "true")
    urls = F.when(F.size(children) > 0, F.transform(children, lambda c: F.get_json_object(c, "$.display_url"))).otherwise(F.array(one))
    posts = profile_posts(payloads, most).where(~T.promotional(T.caption(n)))
    got = posts.select("profile", "ord", U.post_permalink(F.nullif(F.get_json_object(n, "$.shortcode"), F.lit(""))).alias("post_url"), F.posexplode(urls).alias("pos", "url"))
    return got.where("url is not null").select("profile", "ord", "pos", "url", "post_url")


def timeline_objects(pages: DataFrame) -> DataFrame:
    """``(profile, ord, node)`` of every JSON object in the page data of ``(profile, html)``."""
    data = pages.select("profile", F.regexp_extract("html", '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1).alias("data"))
    return json_objects(data, "profile", "data")


def _first_per(key: Column, order: str) -> Column:
    return F.row_number().over(Window.partitionBy("profile", key).orderBy(order))


def statuses(objects: DataFrame, most: int = MOST_STATUSES) -> DataFrame:
    """``(profile, ord, nth, id, text, node)``: objects that look like posts, each id once, the first few.

    Objects without an id are never taken for each other.
    """
    n = F.col("node")
    has = lambda p: F.get_json_object(n, p).isNotNull()
    said = F.coalesce(F.get_json_object(n, "$.full_text"), F.get_json_object(n, "$.text"))
    looks = (has("$.full_text") | has("$.text")) & (has("$.entities") | has("$.id_str"))
    got = objects.where(looks).select("profile", "ord", F.get_json_object(n, "$.id_str").alias("id"), said.alias("text"), "node")
    once = got.withColumn("_n", F.when(F.col("id").isNull(), 1).otherwise(_first_per(F.col("id"), "ord"))).where("_n = 1").drop("_n")
    nth = F.row_number().over(Window.partitionBy("profile").orderBy("ord"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most)


def status_texts(found: DataFrame) -> DataFrame:
    """Texts that are not promotional, each once whatever its case."""
    kept = found.where(~T.promotional(F.col("text"))).select("profile", "nth", "id", T.snippet(F.col("text")).alias("text")).where("text is not null")
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("profile", F.lower("text")).orderBy("nth"))).where("_n = 1").select("profile", "nth", "id", "text", F.lit(POST).alias("weight"))


def status_images(found: DataFrame) -> DataFrame:
    """``(profile, nth, pos, url)`` of photographs, extended entities first, each URL once a post, in large size."""
    media = "array<struct<type:string,media_url_https:string,media_url:string>>"
    of = lambda p: F.coalesce(F.from_json(F.get_json_object("node", p), media), F.array().cast(media))
    every = F.filter(F.concat(of("$.extended_entities.media"), of("$.entities.media")), lambda m: F.coalesce(m["type"], F.lit("photo")) == "photo")
    urls = F.array_distinct(F.filter(F.transform(every, lambda m: F.coalesce(m["media_url_https"], m["media_url"])), lambda u: u.isNotNull()))
    return found.where(~T.promotional(F.col("text"))).select("profile", "nth", F.posexplode(F.transform(urls, U.large_media)).alias("pos", "url"))


def biography(objects: DataFrame) -> DataFrame:
    """``(profile, text)``: the profile's own description, else the first one anywhere."""
    d = F.nullif(F.trim(F.get_json_object("node", "$.description")), F.lit(""))
    own = F.lower(F.get_json_object("node", "$.screen_name")) == F.lower("profile")
    got = objects.select("profile", "ord", d.alias("said"), F.coalesce(own, F.lit(False)).alias("own")).where("said is not null")
    return got.groupBy("profile").agg(F.min_by("said", F.struct((~F.col("own")).alias("other"), "ord")).alias("text"))
