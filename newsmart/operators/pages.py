"""Landed web pages -> article text and lead image."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.functions.html import page_images, strip_noise
from newsmart.functions.text import resolve_url, strip

#: HTML5 names of characters as JSON text, from the standard library.
NAMES = json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})


def pages_scan(pages: DataFrame) -> DataFrame:
    """Fetched pages that answered 200."""
    return pages.filter(F.col("status") == 200)


def strip_boilerplate(html: Column) -> Column:
    """Without comments and the fixed boilerplate elements, whichever begins first: a comment mark inside a
    script and a tag inside a comment mean nothing. Names end at a blank, slash or bracket."""
    tags = "|".join(S.BOILERPLATE_TAGS)
    return F.regexp_replace(html, rf"(?is)<!--.*?-->|<({tags})(?=[\s/>]).*?</\1\s*>", "")


def decode_entities(c: Column) -> Column:
    """Decimal, hexadecimal and named references, each decoded once: what a reference gives is not read again. Unknown
    names stay; numbers that are no character become U+FFFD."""
    names = F.from_json(F.lit(NAMES), "map<string,string>")

    def piece(text: Column) -> Column:
        ref = F.regexp_extract(text, r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1)
        hexed = F.regexp_extract(ref, r"^#[xX]0*([0-9a-fA-F]{1,8})$", 1)
        plain = F.regexp_extract(ref, r"^#0*([0-9]{1,9})$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        char = F.when(ref.startswith("#"), number).otherwise(F.try_element_at(names, ref))
        return F.when((ref != "") & char.isNotNull(), F.concat(char, F.substr(text, F.length(ref) + 3))).otherwise(text)

    return F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")


def visible_text(html: Column) -> Column:
    """Text of the page: tags (a bracket before a letter; "a < b" is text) become blanks, entities are decoded, white space collapses."""
    text = decode_entities(F.regexp_replace(html, r"(?s)</?[A-Za-z!?][^>]*>", " "))
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def main_text(html: Column) -> Column:
    """Text of the first <article> element, else NULL."""
    body = F.regexp_extract(html, r"(?is)<article(?=[\s/>])[^>]*>(.*?)</article\s*>", 1)
    return F.when(body != "", visible_text(body))


def page_extract(pages: DataFrame, clean: bool = False) -> DataFrame:
    """Adds text: the article element when it has more than the fixed number of characters, else all
    visible text. ``clean`` also drops share bars and the like, which needs the page tree (Arrow UDF)."""
    html = strip_boilerplate(F.col("html"))
    bare = pages.withColumn("_html", strip_noise(html) if clean else html)
    main = main_text(F.col("_html"))
    enough = F.length(F.trim(main)) > S.MIN_EXTRACT_CHARS
    return bare.withColumn("text", F.when(enough, main).otherwise(visible_text(F.col("_html")))).drop("_html")


def lead_image(html: Column, url: Column) -> Column:
    """First usable image address of a page, whole; empty if there is none. The page tree only lists what the page offers;
    blanks, data: pictures, logos and the like go here, and relative addresses are resolved against the page's own."""
    bad = "|".join(S.BAD_IMAGE_WORDS)
    offered = F.filter(F.transform(page_images(html), strip), lambda a: (a != "") & ~F.lower(a).rlike(bad) & ~a.startswith("data:"))
    page = F.coalesce(url, F.lit(""))
    near = lambda a: F.when(a.startswith("http") | a.startswith("//") | (page == ""), a).otherwise(resolve_url(a, page))
    whole = F.transform(F.transform(offered, near), lambda a: F.when(a.startswith("//"), F.concat(F.lit("https:"), a)).otherwise(a))
    return F.coalesce(F.get(F.filter(whole, lambda a: a.startswith("http")), F.lit(0)), F.lit(""))


def with_lead_image(pages: DataFrame) -> DataFrame:
    return pages.withColumn("image_url", lead_image(F.col("html"), F.col("url")))
