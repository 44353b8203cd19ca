"""Extraction rules: which keys, attributes and selectors of a site hold products.

Rules are data, one row a domain; the structs below are the schema of that table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls as U

SCHEMA = """domain string, product_card struct<card_selector:string,link_selector:string,name_from_link_text:boolean,sku_from_link_url:boolean,image_within_card:boolean>,
json_sources array<struct<source:string,name_keys:array<string>,sku_keys:array<string>,sku_prefer_pdp_url:boolean,pdp_url_keys:array<string>,image_keys:array<string>>>,
dom_context struct<ancestor_limit:int,card_selector:string,card_link_selector:string,sku_attrs:array<string>,name_attrs:array<string>>,
embedded_image_json_fields array<string>, sku_style_pattern string, single_product_page_path_contains string, priority_link_path_contains array<string>, updated_at timestamp"""


@dataclass(frozen=True)
class CardRule:
    card_selector: str
    link_selector: str
    name_from_link_text: bool = True
    sku_from_link_url: bool = True
    image_within_card: bool = True


@dataclass(frozen=True)
class JsonRule:
    source: str
    name_keys: tuple[str, ...] = ()
    sku_keys: tuple[str, ...] = ()
    sku_prefer_pdp_url: bool = True
    pdp_url_keys: tuple[str, ...] = ("pdpUrl.url",)
    image_keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class DomRule:
    ancestor_limit: int = 5
    card_selector: str | None = None
    card_link_selector: str | None = None
    # Usual attributes.
    sku_attrs: tuple[str, ...] = ("data-sku", "data-product-sku", "data-product-id", "data-item-id")
    name_attrs: tuple[str, ...] = ("data-product-name", "data-product-title")


@dataclass(frozen=True)
class Rules:
    domain: str = ""
    product_card: CardRule | None = None
    json_sources: tuple[JsonRule, ...] = ()
    dom_context: DomRule = field(default_factory=DomRule)
    embedded_image_json_fields: tuple[str, ...] = ("portraitURL", "squarishURL", "imageUrl", "image_url", "thumbnailUrl", "src")
    sku_style_pattern: str | None = U.STYLE_CODE
    single_product_page_path_contains: str | None = None
    priority_link_path_contains: tuple[str, ...] = ()
    updated_at: datetime | None = None

    def normalized(self) -> Rules:
        """Blanks filled: JSON sources, card selectors for the element context, attributes, ancestors, and usual priority paths before the own ones."""
        dom = self.dom_context
        card = self.product_card
        if card:
            dom = replace(dom, card_selector=dom.card_selector or card.card_selector, card_link_selector=dom.card_link_selector or card.link_selector)
        usual = DomRule()
        dom = replace(dom, sku_attrs=dom.sku_attrs or usual.sku_attrs, name_attrs=dom.name_attrs or usual.name_attrs, ancestor_limit=dom.ancestor_limit if dom.ancestor_limit >= 3 else 5)
        paths = tuple(p for p in reversed(U.PRIORITY_HINTS) if p not in self.priority_link_path_contains) + self.priority_link_path_contains
        return replace(self, dom_context=dom, priority_link_path_contains=paths, json_sources=self.json_sources or shop_defaults().json_sources)


def generic(domain: str = "") -> Rules:
    """JSON-LD only."""
    return Rules(domain=domain, json_sources=(JsonRule("json_ld", ("name",), ("sku", "productID", "mpn"), False, (), ("image",)),))


def shop_defaults(domain: str = "") -> Rules:
    """JSON-LD, page data and inline blocks with the usual keys of shops (fixed values)."""
    return Rules(
        domain=domain,
        json_sources=(
            JsonRule("json_ld", ("name",), ("sku", "productID", "mpn"), False, ("pdpUrl.url",), ("image",)),
            JsonRule(
                "next_data", ("copy.title", "title", "fullTitle", "productTitle", "name"), ("styleColor", "productCode", "sku", "productID", "productId", "mpn"), True, ("pdpUrl.url",),
                ("colorwayImages.portraitURL", "colorwayImages.squarishURL", "portraitURL", "squarishURL", "portraitImg", "squarishImg", "image", "imageUrl"),
            ),
            JsonRule("inline_json", ("copy.title",), ("productCode", "styleColor"), True, ("pdpUrl.url",), ("portraitURL", "squarishURL")),
        ),
        embedded_image_json_fields=("portraitURL", "squarishURL", "portraitImg", "squarishImg", "imageUrl", "image_url", "thumbnailUrl", "src"),
        sku_style_pattern=U.STYLE_CODE, single_product_page_path_contains="/t/", priority_link_path_contains=U.PRIORITY_HINTS,
    )


def table_of(spark: SparkSession, rules: list[Rules]) -> DataFrame:
    """The rules as rows."""
    return spark.createDataFrame([asdict(r) for r in rules], SCHEMA)


def of_row(row) -> Rules:
    """Rules from a row of the table."""
    card = CardRule(**row["product_card"].asDict()) if row["product_card"] else None
    tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    sources = tuple(JsonRule(**tuples(s.asDict())) for s in row["json_sources"] or ())
    dom = DomRule(**tuples(row["dom_context"].asDict())) if row["dom_context"] else DomRule()
    rest = {k: tuple(row[k] or ()) if k.startswith(("embedded", "priority")) else row[k] for k in ("domain", "embedded_image_json_fields", "sku_style_pattern", "single_product_page_path_contains", "priority_link_path_contains", "updated_at")}
    return Rules(product_card=card, json_sources=sources, dom_context=dom, **rest)


def upsert(existing: DataFrame, new: DataFrame, key: str = "domain") -> DataFrame:
    """New rows in place of existing ones of the same key; of several new ones of a key the latest."""
    from pyspark.sql import Window

    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("updated_at")))).where("_n = 1").drop("_n")
    return existing.join(latest, key, "left_anti").unionByName(latest)


def resolve(wanted: DataFrame, stored: DataFrame, inferred: DataFrame, today) -> DataFrame:
    """``(domain, origin)`` and the rules to use: stored ones of today, else inferred ones, else ``default``.

    Each table has one row a domain.
    """
    s = stored.select("domain", F.struct(*stored.columns).alias("stored"))
    i = inferred.select("domain", F.struct(*inferred.columns).alias("inferred"))
    from ..functions.rules import fresh

    got = wanted.select("domain").distinct().join(s, "domain", "left").join(i, "domain", "left")
    is_fresh = F.col("stored").isNotNull() & fresh(F.col("stored.updated_at"), today)
    origin = F.when(is_fresh, "stored").when(F.col("inferred").isNotNull(), "inferred").otherwise("default")
    return got.select("domain", origin.alias("origin"), F.when(is_fresh, F.col("stored")).otherwise(F.col("inferred")).alias("rules"))


def load_or_infer(wanted: DataFrame, stored: DataFrame, samples: DataFrame, infer: Callable[[str, str], Rules], now: datetime, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rules in use, the table from now on)``: stored rules of today, else inferred ones.

    ``samples`` are ``(domain, ord, url, html)``, a few pages a domain.  ``infer(prompt, domain)`` gives rules; those that
    find nothing on the domain's own samples make way for the usual ones of shops, with the inferred card rule.  The
    rules in use carry ``origin``: ``stored``, ``inferred`` or ``default``.
    """
    from ..functions.rules import fresh
    from ..plans.prompts import extraction

    today = F.lit(now.date())
    kept = stored.where(F.lit(not refresh) & F.coalesce(fresh(F.col("updated_at"), today), F.lit(False)))
    names = wanted.select("domain").distinct()
    seen = F.struct("ord", "url", U.sample_type(F.col("url")).alias("page_type"), "html")
    told = samples.groupBy("domain").agg(F.sort_array(F.collect_list(seen)).alias("samples"))
    due = names.join(kept, "domain", "left_anti").join(told, "domain", "left")
    due = due.withColumn("prompt", extraction(F.col("domain"), F.coalesce("samples", F.array().cast(told.schema["samples"].dataType))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .products import finds_anything

        for b in batches:
            out = []
            for domain, prompt, pages in zip(*(b.column(c).to_pylist() for c in ("domain", "prompt", "samples"))):
                got = infer(prompt, domain)
                valid = finds_anything(got, [(p["url"] or "", p["html"] or "") for p in pages or ()])
                said = asdict(replace(settled(got, valid), domain=domain, updated_at=None))
                out.append((domain, "inferred" if valid else "default", json.dumps(said)))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["domain", "origin", "rules"])

    got = due.select("domain", "prompt", "samples").mapInArrow(run, "domain string, origin string, rules string")
    got = got.select("origin", F.from_json("rules", SCHEMA).alias("r")).select("origin", "r.*").withColumn("updated_at", F.lit(now).cast("timestamp"))
    used = kept.join(names, "domain", "left_semi").withColumn("origin", F.lit("stored")).unionByName(got)
    return used, upsert(stored, got.drop("origin"))


def settled(inferred: Rules, valid: bool) -> Rules:
    """Inferred rules if they found something on the samples, else the usual ones of shops with the inferred card rule."""
    if valid:
        return inferred.normalized()
    return replace(shop_defaults(inferred.domain), product_card=inferred.product_card).normalized()
