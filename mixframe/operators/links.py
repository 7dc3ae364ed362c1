"""Jobs over addresses: links of crawled pages, canonical forms, hosts, artwork."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# What a page is read as: comments and scripts, which hold no links, and the tags that can have one.  A quoted value may
# hold a ">"; the possessive loops keep long tags off the stack.
TOKEN = (r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>"
         r"|<(?:a|iframe|embed|audio|video|source)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
# One attribute with its value: double-quoted, single-quoted or bare.
ATTRIBUTE = r"(?s)[^\s\"'>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>`]+)"
ADDRESSES = ("href", "src", "data-src")
ANCHOR_DATE = r"((?:19|20)\d{2}-\d{2}-\d{2})"


def absolute(link: Column, base: Column) -> Column:
    """A link as written to a full address, seen from the page's own address."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.split(F.split(base, r"\?")[0], "#")[0], r"[^/]*$", "")
    return (F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(F.lit("https:"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link.startswith("#"), F.concat(F.split(base, "#")[0], link))
            .otherwise(F.concat(folder, link)))


def decoded(text: Column) -> Column:
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def tag_addresses(html: Column) -> Column:
    """The values of all address attributes of a page, in the order they are written."""
    def value(attribute):
        written = F.regexp_extract(attribute, r"(?s)=\s*(.*)$", 1)
        return F.when(written.rlike("^[\"']"), F.substr(written, F.lit(2), F.length(written) - 2)).otherwise(written)

    def addresses(tag):
        named = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0), lambda a: F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).isin(*ADDRESSES))
        return F.filter(F.transform(named, value), lambda v: F.trim(v) != "")

    tags = F.filter(F.regexp_extract_all(html, F.lit(TOKEN), 0), lambda t: ~t.rlike("(?i)^<(?:!|script|style)"))
    return F.flatten(F.transform(tags, addresses))


def scan_links(pages: DataFrame) -> DataFrame:
    """Every link and embedded player of a page, absolute and canonical: ``(page_id, pos, raw, url, dated)``.

    Attributes may be quoted either way or not at all; a tag with several addresses gives all of them, comments and
    scripts give none.
    """
    raw = pages.select("page_id", F.col("url").alias("_page"), F.posexplode(tag_addresses(F.col("html"))).alias("pos", "raw"))
    full = raw.withColumn("_full", absolute(decoded(F.trim("raw")), F.col("_page")))
    web = F.col("_full").rlike("^https?://")
    return full.select("page_id", "pos", "raw", F.when(web, U.canonical_url("_full")).otherwise(F.col("_full")).alias("url"),
                       F.nullif(F.regexp_extract("_full", ANCHOR_DATE, 1), F.lit("")).alias("dated"))


def canonical_urls(df: DataFrame, column: str = "url") -> DataFrame:
    """All address columns of the library at once."""
    u = F.col(column)
    return (df.withColumn("canonical", U.canonical_url(u)).withColumn("url_key", U.player_key(u))
            .withColumn("host", U.host(u)).withColumn("video_id", U.video_id(u))
            .withColumn("playlist", U.playlist_url(u)).withColumn("undotted", U.undotted_slug(u))
            .withColumn("numeric_form", U.is_numeric_form(u)))


def filter_supported_hosts(links: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    return links.where(U.host("url").isin(*(hosts or U.SUBMIT_HOSTS)))


def filter_public_playlists(links: DataFrame) -> DataFrame:
    """Addresses that name a playlist anyone can open."""
    return links.withColumn("playlist", U.playlist_url("url")).where(F.col("playlist").isNotNull())


def artwork_urls(df: DataFrame) -> DataFrame:
    """Full-size form of an artwork address, its other extension, and the widest of a ``srcset``."""
    u = F.col("artwork")
    original = F.regexp_replace(u, r"-(?:t\d+x\d+|large|crop|small|badge|tiny)(?=\.[a-z]+$)", "-original")
    original = F.regexp_replace(original, r"/\d+x\d+(?=[/.])", "/0x0")
    entries = F.transform(F.split("srcset", r"\s*,\s*"), lambda s: F.struct(
        F.regexp_extract(s, r"\s(\d+)[wx]$", 1).try_cast("int").alias("w"), F.split(F.trim(s), r"\s+")[0].alias("u")))
    widest = F.array_max(F.filter(entries, lambda e: e["w"].isNotNull()))["u"]
    token = F.regexp_extract(u, r"/([A-Za-z0-9+=_-]{16,})(?:\.[a-z]+)?$", 1)
    path = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64")).cast("string")
    return (df.withColumn("original", original).withColumn("widest", widest)
            .withColumn("decoded_path", F.when(path.rlike(r"^[\x20-\x7e]+$"), path))
            .withColumn("other_extension", F.when(original.rlike(r"(?i)\.jpe?g$"), F.regexp_replace(original, r"(?i)\.jpe?g$", ".png"))
                        .when(original.rlike(r"(?i)\.png$"), F.regexp_replace(original, r"(?i)\.png$", ".jpg"))))


def json_fields(df: DataFrame, column: str = "json", names: tuple[str, ...] = ("identifier",)) -> DataFrame:
    """First identifier found in a metadata document, be it an object, an array or nested one down."""
    v = F.try_parse_json(column)
    paths = [p for n in names for p in (f"$.{n}", f"$[0].{n}", f"$.metadata.{n}", f"$.{n}[0]")]
    return df.withColumn("_v", v).withColumn(
        "identifier", F.coalesce(*[F.try_variant_get("_v", p, "string") for p in paths])).drop("_v")
