"""What a hosted model would be asked, as text columns, and the retries around it.

No model is called here: a caller gives ``ask``, a function from a prompt to a JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def discovery(name: Column, url: Column, count: Column, target: Column) -> Column:
    """Asks for themes over a sample of images."""
    return F.concat(F.lit("Sample of "), count.cast("string"), F.lit(" images of "), name, F.lit(" ("), F.coalesce(url, F.lit("unknown site")), F.lit(").\nName exactly "), target.cast("string"), F.lit(" themes that exclude each other and span them: label, description, key elements, seed images (from 1)."))


def assignment(name: Column, url: Column, count: Column, themes: Column) -> Column:
    """Asks for the images of a batch by fixed themes ``array<struct<cluster_label, description>>``."""
    lines = F.array_join(F.transform(themes, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["cluster_label"], F.lit(": "), F.coalesce(t["description"], F.lit("")))), "\n")
    return F.concat(F.lit("Batch of "), count.cast("string"), F.lit(" images of "), name, F.lit(" ("), F.coalesce(url, F.lit("unknown site")), F.lit(").\nThemes, not to be renamed:\n"), lines, F.lit("\nGive each theme its images (from 1); an image has one theme at most."))


def extraction(domain: Column, samples: Column) -> Column:
    """Asks for extraction rules of a site from a few of its pages ``array<struct<url, page_type, html>>``."""
    pages = F.transform(samples, lambda s, i: F.concat(F.lit("Page "), (i + 1).cast("string"), F.lit(", "), F.coalesce(s["page_type"], F.lit("other")), F.lit(", "), F.coalesce(s["url"], F.lit("")), F.lit(":\n"), F.coalesce(s["html"], F.lit(""))))
    asks = "Which embedded data, keys, cards and attributes hold the products' names, style codes and images? Embedded data goes before markup, what several pages share before what one has; a page without products adds nothing.\n"
    return F.concat(F.lit("Rules to read products from "), domain, F.lit(", of which there are "), F.size(samples).cast("string"), F.lit(" pages.\n" + asks), F.array_join(pages, "\n\n"))


def synthesis(name: Column, url: Column, themes: Column, palette: Column, names: Column, lines: Column) -> Column:
    """Asks for a profile from everything gathered."""
    colours = F.array_join(F.transform(palette, lambda p: F.concat(p["hex"], F.lit(" ("), p["pct"].cast("string"), F.lit("%)"))), ", ")
    products = F.array_join(F.transform(F.slice(F.array_distinct(names), 1, 40), lambda n: F.concat(F.lit("- "), n)), "\n")
    part = lambda head, body, none: F.concat(F.lit(f"{head}\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit(none)), F.lit("\n\n"))
    return F.concat(part("Brand:", name, "unknown"), part("Site:", url, "unknown"), part("Themes:", F.to_json(themes), "none"), part("Palette:", colours, "unavailable"), part("Products:", products, "none"), part("Texts:", lines, "(no text snippets were available)"))


def template_profile(name: Column, themes: Column, palette: Column, texts: Column) -> Column:
    """A profile without a model: what was counted, in sentences."""
    labels = F.array_join(F.transform(themes, lambda t: t["label"]), ", ")
    colours = F.array_join(F.transform(palette, lambda p: p["hex"]), ", ")
    return F.struct(
        F.concat(name, F.lit(" shows "), F.coalesce(F.nullif(labels, F.lit("")), F.lit("no themes")), F.lit(".")).alias("summary"),
        F.coalesce(F.nullif(colours, F.lit("")), F.lit("unavailable")).alias("colours"), F.slice(F.coalesce(texts, F.array().cast("array<string>")), 1, 3).alias("quotes"),
    )


def asked(prompts: DataFrame, ask: Callable[[str], str], key: str = "batch", attempts: int = 2) -> DataFrame:
    """``(key, answer)``; a prompt that fails every attempt has a null answer, and its images stay unassigned."""

    def one(prompt: str | None) -> str | None:
        for _ in range(attempts if prompt else 0):
            try:
                return ask(prompt)
            except Exception:  # noqa: BLE001  whatever a client raises counts as a failed attempt
                continue
        return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([one(p) for p in b.column("prompt").to_pylist()], pa.string())], names=[key, "answer"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, answer string")
