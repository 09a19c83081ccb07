"""URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import filled


def segments(url: Column) -> Column:
    """Non-empty parts of a URL without scheme, query and fragment; the host comes first."""
    bare = F.regexp_replace(F.regexp_replace(filled(url), r"^[^?#]*?://", ""), r"[?#].*$", "")
    return F.filter(F.split(bare, "/"), lambda x: x != "")


def segment(url: Column, index: int) -> Column:
    """Part ``index`` (0 is the host), or the empty string."""
    return F.coalesce(F.try_element_at(segments(url), F.lit(index + 1)), F.lit(""))


def title_slug(url: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit(""))


def base_url(endpoint: Column) -> Column:
    """Endpoint without trailing slashes and a closing /graphql."""
    return F.regexp_replace(F.regexp_replace(endpoint, "/+$", ""), "/graphql$", "")


def item_url(base: Column, kind: str, item_id: Column) -> Column:
    """Link to an item of a kind ("scenes", "tags", "performers"), null without base or id."""
    ok = base.isNotNull() & (base != "") & item_id.isNotNull() & (item_id.cast("string") != "")
    return F.when(ok, F.concat(F.regexp_replace(base, "/+$", ""), F.lit(f"/{kind}/"), item_id.cast("string")))


def candidate_url(urls: Column, url: Column) -> Column:
    """The first of ``urls``, else ``url``, else null."""
    return F.coalesce(F.try_element_at(urls, F.lit(1)), F.nullif(url, F.lit("")))
