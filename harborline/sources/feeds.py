"""Postings from stored RSS, XML and JSON payloads; each function explodes a payload column into rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.html import decode
from harborline.functions.text import blank_to_null


def _first_of_each(df: DataFrame, key: str) -> DataFrame:
    """The first row of each payload's ``key``, by position."""
    by = Window.partitionBy("payload_id", key).orderBy("position")
    return df.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def _elements(df: DataFrame, payload: str, tag: str) -> DataFrame:
    """(payload_id, position, body) of the elements ``tag`` of an XML text."""
    bodies = F.regexp_extract_all(F.col(payload), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return df.select("payload_id", F.posexplode(bodies).alias("position", "body"))


def _field(body: Column, name: str) -> Column:
    """The text of a child element, plain or in CDATA, with entities decoded; null if blank."""
    cdata = F.regexp_extract(body, rf"(?is)<{name}>\s*<!\[CDATA\[(.*?)\]\]>\s*</{name}>", 1)
    plain = F.regexp_extract(body, rf"(?is)<{name}>(.*?)</{name}>", 1)
    return F.nullif(F.trim(decode(F.when(F.trim(plain).startswith("<![CDATA["), cdata).otherwise(plain))), F.lit(""))


def rss_items(df: DataFrame, prefix: str, payload: str = "payload") -> DataFrame:
    """(payload_id, position, id, url) of the items whose link has an id parameter."""
    link = F.trim(F.regexp_extract("body", r"(?is)<link>(.*?)</link>", 1))
    rows = _elements(df, payload, "item").withColumn("url", link).withColumn("key", F.regexp_extract("url", r"(?i)[?&](?:jobid|id)=([^&]+)", 1))
    return rows.filter("key <> ''").select("payload_id", "position", F.concat(F.lit(f"{prefix}_"), F.lower("key")).alias("id"), "url")


def body_text(html: Column) -> Column:
    """Text of an HTML fragment with line breaks kept and list items as dashes."""
    t = F.regexp_replace(html, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6])\s*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<li\b[^>]*>", "- "), r"<[^>]+>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


def xml_jobs(df: DataFrame, prefix: str, payload: str = "payload", tag: str = "job") -> DataFrame:
    """(payload_id, id, title, url, posted_at, text) of the jobs with reference, title, url and description;
    the first of each reference counts."""
    rows = _elements(df, payload, tag)
    rows = rows.select("payload_id", "position", *(_field(F.col("body"), n).alias(n) for n in ("referencenumber", "title", "url", "date", "description")))
    rows = rows.filter("referencenumber IS NOT NULL AND title IS NOT NULL AND url IS NOT NULL AND description IS NOT NULL")
    first = _first_of_each(rows, "referencenumber")
    return first.select("payload_id", F.concat(F.lit(f"{prefix}_"), "referencenumber").alias("id"), "title", "url", F.col("date").alias("posted_at"), F.concat("title", F.lit("\n\n"), body_text(F.col("description"))).alias("text"))


def json_postings(df: DataFrame, prefix: str, fields: dict[str, list[str]], payload: str = "payload", root: str = "$") -> DataFrame:
    """(payload_id, id, then ``fields``) of the objects of a JSON array at ``root``.

    Each field takes the first of its JSON paths that isn't blank. Objects without id or title go, the first
    of each id stays, and anything but an array gives no rows.
    """
    array = F.try_parse_json(F.get_json_object(F.col(payload), root)) if root != "$" else F.try_parse_json(F.col(payload))
    parts = F.when(F.schema_of_variant(array).startswith("ARRAY"), array.cast("array<variant>"))
    rows = df.select("payload_id", F.posexplode(parts).alias("position", "o"))
    pick = lambda paths: F.coalesce(*(blank_to_null(F.try_variant_get("o", p, "string")) for p in paths))
    rows = rows.select("payload_id", "position", *(pick(paths).alias(name) for name, paths in fields.items())).filter("id IS NOT NULL AND title IS NOT NULL")
    rest = [n for n in fields if n != "id"]
    return _first_of_each(rows, "id").select("payload_id", F.concat(F.lit(f"{prefix}_"), "id").alias("id"), *rest)


def enrich(listing: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """``listing`` with each column taken from ``detail`` where that isn't blank."""
    d = detail.select(key, *(F.col(c).alias(f"__{c}") for c in listing.columns if c != key and c in detail.columns))
    both = listing.join(d, key, "left")
    return both.select(*(F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)).alias(c) if f"__{c}" in d.columns else F.col(c) for c in listing.columns))


def json_ld_date(html: Column) -> Column:
    """The first ``datePosted`` of the page's structured data blocks, or null."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    return F.get(F.filter(F.transform(blocks, lambda b: F.get_json_object(b, "$.datePosted")), lambda d: d.isNotNull()), F.lit(0))
