"""Text, titles and links of HTML pages as column expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.text import collapse

NOISE = ("script", "style", "nav", "header", "footer")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decode(c: Column) -> Column:
    for name, value in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def page_text(html: Column) -> Column:
    """What a reader sees: without noise elements, comments and tags, entities decoded."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in NOISE:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return collapse(decode(F.regexp_replace(c, r"<[^>]*>", " ")))


def page_title(html: Column) -> Column:
    return collapse(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def links(html: Column) -> Column:
    """array<struct<href, label>> of the anchors, in page order."""
    pattern = F.lit(r"""(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>""")
    return F.zip_with(F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2)), lambda a, b: F.struct(a.alias("href"), collapse(decode(F.regexp_replace(b, r"<[^>]*>", " "))).alias("label")))
