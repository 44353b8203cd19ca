"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lengths and promotional words.
MOST_CHARS, LEAST_HERO, LEAST_PARAGRAPH, MOST_PARAGRAPHS, MOST_PRODUCT_PARAGRAPHS = 800, 12, 40, 6, 3
PERCENT_OFF = r"(?iu)([0-9]+\s*%\s*(off|indirim(li|de)?)|%\s*[0-9]+\s*(off|indirim(li|de)?)?)"
PROMO_WORDS = r"(?iu)\b(sale|discount|promo(tion|tional)?|clearance|indirim(li|de)?)\b"
EVENT_WORDS = (r"(?iu)\b(register|registration|rsvp|sign\s*up)\b", r"(?iu)\b(store|opening|flagship|boutique)\b", r"(?iu)\b(invite|invitation)\b")


def clean(text: Column) -> Column:
    """White space runs become one space, ends trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def truncate(text: Column, most: int = MOST_CHARS) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def snippet(text: Column) -> Column:
    """Clean text of at most 800 characters, null where nothing is left."""
    return F.nullif(truncate(clean(text)), F.lit(""))


def promotional(text: Column) -> Column:
    """Discounts and sales, or at least two of registering, stores and invitations."""
    events = sum((text.rlike(p).cast("int") for p in EVENT_WORDS), F.lit(0))
    return F.coalesce((F.trim(text) != "") & (text.rlike(PERCENT_OFF) | text.rlike(PROMO_WORDS) | (events >= 2)), F.lit(False))


def social_handle(handle: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(handle)), "^@+", ""), "[^a-z0-9._]", "")


def resolution(value: Column) -> Column:
    """``WxH`` as a struct of two integers; anything else is an error."""
    ok = value.rlike("^[0-9]+x[0-9]+$")
    part = lambda i: F.regexp_extract(value, "^([0-9]+)x([0-9]+)$", i).cast("int")
    return F.when(ok, F.struct(part(1).alias("width"), part(2).alias("height"))).otherwise(F.raise_error(F.concat(F.lit("not a resolution: "), F.coalesce(value, F.lit("null")))))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def scalar_text(json: Column, path: str) -> Column:
    """A trimmed non-empty string or a number as text, from JSON text."""
    return F.nullif(F.trim(F.get_json_object(json, path)), F.lit(""))


def unescape_json(said: Column) -> Column:
    """What an escaped JSON string says, or the string itself."""
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), said, F.lit('"]')), "array<string>"), F.lit(0)), said)


def caption(node: Column) -> Column:
    """First caption of a post's JSON node."""
    return F.nullif(F.trim(F.get_json_object(node, "$.edge_media_to_caption.edges[0].node.text")), F.lit(""))


def prompt_line(kind: Column, weight: Column, url: Column, text: Column) -> Column:
    """One snippet of a prompt: a bullet with its origin, and the text on a line of its own."""
    return F.concat(F.lit("- ["), kind, F.lit(" | weight="), F.format_string("%.1f", weight), F.lit(" | "), url, F.lit("]\n  "), text)


def image_caption(nth: Column, product: Column, sku: Column) -> Column:
    """Parts that are there, joined by middle dots, in brackets."""
    named = lambda label, c: F.concat(F.lit(label), F.nullif(c, F.lit("")))
    return F.concat(F.lit("["), F.concat_ws(" · ", F.concat(F.lit("Image "), nth.cast("string")), named("product: ", product), named("sku: ", sku)), F.lit("]"))


def data_uri(content: Column) -> Column:
    """An image for a model request; null for bytes that aren't PNG, JPEG, GIF or WebP."""
    head = F.hex(F.substring(content, 1, 4))
    kind = F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpeg").when(head == "47494638", "gif").when(head == "52494646", "webp")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))
