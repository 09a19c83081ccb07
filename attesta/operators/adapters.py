"""Source adapters: how a store names the owner of a result and how it is asked."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.substitutions import search_variants
from attesta.functions.text import filled, spaceless, squeeze, strip_html
from attesta.functions.urls import segment, title_slug


@dataclass(frozen=True)
class Adapter:
    """Declared behaviour of one store. ``owner_source``: url_segment, result_field or none."""

    name: str
    owner_source: str = "none"
    owner_segment: int = 0
    owner_field: tuple[str, ...] = ()
    title_match_counts_as_ownership: bool = False
    search_omits_seed: bool = False
    catalog_resolvable: bool = True
    scraper_id: str = ""
    aliases: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.name:
            raise ValueError("an adapter needs a name")
        if self.owner_source not in ("url_segment", "result_field", "none"):
            raise ValueError(f"{self.name}: unknown owner source {self.owner_source!r}")
        if self.owner_segment < 0:
            raise ValueError(f"{self.name}: a segment is counted from 0")
        if self.owner_source == "result_field" and not self.owner_field:
            raise ValueError(f"{self.name}: result_field needs a path")
        for alias, full in self.aliases.items():
            if not isinstance(full, str):
                raise ValueError(f"{self.name}: alias {alias!r} must have one name")

    def owner_of(self, url: Column, result: Column | None = None) -> Column:
        """Owner of a result (a struct column), or the empty string."""
        if self.owner_source == "url_segment":
            return segment(url, self.owner_segment)
        if self.owner_source == "result_field" and result is not None:
            value = result
            for step in self.owner_field:
                value = value.getField(step)
            return strip_html(value.cast("string"))
        return F.lit("")

    def features_artist(self, url: Column, title: Column, owner: Column, slug: Column) -> Column:
        """Whether a result belongs to the artist of a slug."""
        own = spaceless(owner)
        in_title = F.contains(spaceless(F.concat_ws(" ", title, title_slug(url))), slug) if self.title_match_counts_as_ownership else F.lit(False)
        return (slug != "") & (F.startswith(own, slug) | in_title)

    def search_query(self, seed: Column, title: Column) -> Column:
        parts = (title,) if self.search_omits_seed else (seed, title)
        return F.lower(squeeze(F.concat_ws(" ", *[filled(p) for p in parts])))


def identity(code: Column, title: Column, urls: Column) -> Column:
    """What makes two result rows one: their urls, code and title."""
    return F.to_json(F.struct(code.alias("code"), title.alias("title"), urls.alias("urls")), {"ignoreNullFields": "false"})


def catalog_search(names: DataFrame, listings: DataFrame, pairs: dict[str, list[str]], name: str = "name") -> DataFrame:
    """Results of each name's query variants, duplicates by identity dropped, first kept.

    ``listings``: (query, row_ix, code, title, urls, ...). Each distinct variant is looked up once.
    """
    asked = names.select(name).distinct().select(name, F.posexplode(search_variants(F.col(name), pairs)).alias("variant_ix", "query"))
    found = asked.join(listings, "query")
    first = Window.partitionBy(name, identity(F.col("code"), F.col("title"), F.col("urls"))).orderBy("variant_ix", "row_ix")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def owners_of(results: DataFrame, stores: dict[str, Adapter], result: str | None = None) -> DataFrame:
    """(candidate, owner) over the results of all stores that can confirm owners.

    ``results``: (candidate, store, url, ...); ``result`` names the struct column that result_field adapters read.
    """
    out = None
    for name, adapter in sorted(stores.items()):
        if adapter.owner_source == "none":
            continue
        owner = adapter.owner_of(F.col("url"), F.col(result) if result else None)
        part = results.where(F.col("store") == name).select("candidate", owner.alias("owner"))
        out = part if out is None else out.unionByName(part)
    return results.select("candidate", F.lit("").alias("owner")).limit(0) if out is None else out
