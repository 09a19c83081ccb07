"""Attribution of files to creators: folder and name readings, evidence, alias maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.dates import looks_like_date
from attesta.functions.text import clean_folder, filled, is_container, is_in, normalize, spaceless, squeeze, strip_ext
from attesta.functions.vocab import ARTICLE_LEADS, MONTH_PATTERN

# Bounds and patterns that define what is read as a name.
MOST_UP, LEAST_CHARS, MOST_WORDS = 4, 3, 4
LEAST_EXACT, LEAST_PREFIX = 1, 2
_DASH = r"(?U)\s+[-–—]\s+"
_MONTH_YEAR = rf"(?iU)^(?:(?:{MONTH_PATTERN})\.?\s?(?:19|20)\d{{2}}|(?:19|20)\d{{2}}\s?(?:{MONTH_PATTERN})\.?)$"
_FEAT = r"(?isU)^(.*?)(?:^|\s)(?:feat|ft|featuring)\.?\s+(\S.*)$"
# End of fixed values.


def creator_folder(path: Column, most_up: int = MOST_UP) -> Column:
    """The nearest ancestor folder, of at most ``most_up``, that names someone; else the parent, cleaned."""
    parts = F.split(filled(path), "/")
    folders = F.slice(F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), 1, most_up)
    depth = F.array_position(folders, "")  # the root, or a doubled slash, ends the walk
    folders = F.when(depth > 0, F.slice(folders, 1, (depth - 1).cast("int"))).otherwise(folders)
    named = F.filter(folders, lambda x: (clean_folder(x) != "") & ~is_container(x))
    return clean_folder(F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(folders, F.lit(1)), F.lit("")))


def is_name(text: Column) -> Column:
    """Whether a text could be a person's name: guards on length, words, dates, articles and container words."""
    text = F.trim(filled(text))
    words, key = F.split(normalize(text), " "), spaceless(text)
    return (
        (key != "")
        & (F.length(key) >= LEAST_CHARS)
        & (F.size(words) <= MOST_WORDS)
        & ~looks_like_date(text)
        & ~key.rlike(r"^\p{Nd}+$")
        & ~squeeze(text).rlike(_MONTH_YEAR)
        & ~is_in(words[0], ARTICLE_LEADS)
        & ~is_container(text)
    )


def same_name(a: Column, b: Column) -> Column:
    a, b = spaceless(a), spaceless(b)
    return (a != "") & (a == b)


def featured_name(text: Column) -> Column:
    """The name after a feat marker, if it also leads the text; else null."""
    lead, featured = F.regexp_extract(text, _FEAT, 1), F.trim(F.regexp_extract(text, _FEAT, 2))
    led = F.startswith(F.concat(normalize(lead), F.lit(" ")), F.concat(normalize(featured), F.lit(" ")))
    return F.when((featured != "") & is_name(featured) & led, featured)


def filename_candidates(name: Column) -> Column:
    """Names a file name offers: each dash segment but the last that could be one; without a dash, a featured name."""
    text = F.trim(strip_ext(name))
    parts = F.split(text, _DASH)
    segments = F.filter(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), clean_folder), is_name)
    featured = featured_name(text)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(parts) > 1, segments).otherwise(F.array_compact(F.array(featured)))


def filename_candidate(name: Column) -> Column:
    """The first dash segment if it could be a name; without a dash, a featured name; else null."""
    text = F.trim(strip_ext(name))
    parts = F.split(text, _DASH, 2)
    left = clean_folder(parts[0])
    return F.when(text == "", None).when(F.size(parts) > 1, F.when(is_name(left), left)).otherwise(featured_name(text))


def with_filename_candidate(rows: DataFrame, name: str, out: str) -> DataFrame:
    """``rows`` with filename_candidate of a column as ``out``. The text and what is left of its dash are columns, so a file reads them once."""
    read = rows.withColumn("__text", F.trim(strip_ext(F.col(name)))).withColumn("__parts", F.split("__text", _DASH, 2))
    read = read.withColumn("__left", F.when(F.size("__parts") > 1, clean_folder(F.col("__parts")[0]))).withColumn("__named", is_name(F.col("__left")))
    candidate = F.when(F.col("__text") == "", None).when(F.col("__left").isNotNull(), F.when(F.col("__named"), F.col("__left"))).otherwise(featured_name(F.col("__text")))
    return read.withColumn(out, candidate).drop("__text", "__parts", "__left", "__named")


def owner_support(candidates: DataFrame, owners: DataFrame, key: str = "id", name: str = "candidate", owner: str = "owner") -> DataFrame:
    """(key, name, exact, prefix, supported) per candidate, from the owners that its search returned.

    ``owners``: (name, owner) rows, one per search result; blank owners support nobody.
    """
    return candidates.select(key, name).distinct().join(_support(owners, name, owner), name, "left").select(
        key, name, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exact", "prefix")], F.coalesce("supported", F.lit(False)).alias("supported")
    )


def _support(owners: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, exact, prefix, supported): one row for each searched name, so candidates meet one row and no owner twice."""
    told = owners.groupBy(name, owner).count().select(name, "count", spaceless(F.col(owner)).alias("__owner"), spaceless(F.col(name)).alias("__slug")).where("__owner <> ''")
    same = F.col("__owner") == F.col("__slug")
    exact, prefix = F.when(same, F.col("count")), F.when(~same & F.startswith("__owner", "__slug"), F.col("count"))
    counted = told.groupBy(name).agg(F.coalesce(F.sum(exact), F.lit(0)).alias("exact"), F.coalesce(F.sum(prefix), F.lit(0)).alias("prefix"))
    return counted.withColumn("supported", is_supported(F.col("exact"), F.col("prefix")))


def is_supported(exact: Column, prefix: Column) -> Column:
    return (exact >= LEAST_EXACT) | (prefix >= LEAST_PREFIX)


def resolve_by_evidence(candidates: DataFrame, owners: DataFrame, key: str = "id", name: str = "candidate") -> DataFrame:
    """One row per key: resolved name or null, and the candidates left unconfirmed.

    ``candidates``: (key, ordinal, name). One candidate is taken unasked; of several, the only supported one wins.
    """
    told = candidates.where(F.col(name).isNotNull()).select(key, "ordinal", name).join(_support(owners, name, "owner").select(name, "supported"), name, "left")
    every = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col(name).alias("name"), F.coalesce("supported", F.lit(False)).alias("supported")))).alias("every"))
    names = F.array_distinct("every.name")
    wins = F.array_distinct(F.transform(F.filter("every", lambda x: x["supported"]), lambda x: x["name"]))
    resolved = F.when(F.size(names) == 1, names[0]).when(F.size(wins) == 1, wins[0])
    return every.select(key, resolved.alias("resolved"), F.when(resolved.isNotNull(), F.array().cast("array<string>")).otherwise(F.col("every.name")).alias("unconfirmed"))


def configured_aliases(entries: DataFrame) -> DataFrame:
    """(key, full) of (adapter, alias, full) rows pooled over adapters.

    An empty alias or name, or one key with two names, raises when the rows are read.
    """
    keyed = entries.select(spaceless(F.col("alias")).alias("key"), F.trim("full").alias("full"))
    pooled = keyed.groupBy("key").agg(F.min("full").alias("full"), F.count_distinct("full").alias("n"), F.min(F.length("full")).alias("least"))
    bad = (F.col("key") == "") | (F.col("least") == 0) | (F.col("n") > 1)
    return pooled.select("key", F.when(bad, F.raise_error(F.concat(F.lit("alias is empty or names two people: "), F.col("key")))).otherwise(F.col("full")).alias("full"))


def library_aliases(performers: DataFrame) -> DataFrame:
    """(key, full, n_names, shadowed, usable) of each alias in (name, aliases) rows.

    Usable: claimed by one name and not itself someone's primary name.
    """
    primary = performers.select(spaceless(F.col("name")).alias("key")).where("key <> ''").distinct().withColumn("shadowed", F.lit(True))
    claims = performers.select("name", F.explode("aliases").alias("alias")).select("name", spaceless(F.col("alias")).alias("key")).where("key <> ''")
    own = claims.where(F.col("key") != spaceless(F.col("name")))
    grouped = own.groupBy("key").agg(F.min("name").alias("full"), F.count_distinct("name").alias("n_names"))
    return (
        grouped.join(primary, "key", "left")
        .withColumn("shadowed", F.coalesce("shadowed", F.lit(False)))
        .withColumn("usable", (F.col("n_names") == 1) & ~F.col("shadowed"))
    )


def pooled_aliases(configured: DataFrame, library: DataFrame) -> DataFrame:
    """(key, full, source): configured aliases, and the usable library aliases that they do not override."""
    usable = library.where("usable").select("key", "full").join(configured.select("key"), "key", "left_anti")
    return configured.select("key", "full").withColumn("source", F.lit("configured")).unionByName(usable.withColumn("source", F.lit("library")))


def resolve(files: DataFrame, aliases: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Resolution of (id, name, folder) rows: name, source, competing, rejected_folder, unconfirmed.

    An alias of the folder wins. Without ``owners`` the folder wins over the file name if it could be a name; with
    them, several candidates are held against the owners of their search results (see ``resolve_by_evidence``).
    """
    rows = files.select("id", "name", "folder").withColumn("own", clean_folder(F.col("folder"))).withColumn("key", spaceless(F.col("own")))
    rows = rows.join(aliases.select("key", F.col("full").alias("alias")), "key", "left").withColumn("own_name", is_name(F.col("own")))
    none = F.array().cast("array<string>")
    if owners is None:
        rows = with_filename_candidate(rows, "name", "from_file").withColumn("unconfirmed", none)
        picked = F.when(F.col("own_name"), F.col("own")).otherwise(F.col("from_file"))
    else:
        names = F.when(F.col("own_name"), F.concat(F.array("own"), filename_candidates(F.col("name")))).otherwise(filename_candidates(F.col("name")))
        listed = rows.where("alias is null").select("id", F.posexplode(names).alias("ordinal", "candidate"))
        first = listed.withColumn("slug", spaceless(F.col("candidate"))).groupBy("id", "slug").agg(F.min_by("candidate", "ordinal").alias("candidate"), F.min("ordinal").alias("ordinal")).drop("slug")
        rows = rows.join(resolve_by_evidence(first, owners), "id", "left").withColumn("unconfirmed", F.coalesce("unconfirmed", none))
        other = first.join(rows.select("id", "resolved"), "id").where(~same_name(F.col("candidate"), F.coalesce("resolved", F.lit(""))))
        rows = rows.join(other.groupBy("id").agg(F.min_by("candidate", "ordinal").alias("from_file")), "id", "left")
        picked = F.col("resolved")
    name = F.coalesce("alias", picked)
    source = (
        F.when(F.col("alias").isNotNull(), "alias").when(picked.isNull(), None).when(F.col("own_name") & same_name(picked, F.col("own")), "folder").otherwise("filename")
    )
    rows = rows.withColumn("resolved_name", name).withColumn("source", source)
    competing = F.when(F.col("resolved_name").isNotNull() & ~same_name(F.col("from_file"), F.col("resolved_name")), F.col("from_file"))
    rejected = F.when((F.col("own") != "") & ~F.col("own_name") & ~F.coalesce(F.col("source").isin("folder", "alias"), F.lit(False)), F.col("own"))
    return rows.select("id", F.col("resolved_name").alias("name"), "source", competing.alias("competing"), rejected.alias("rejected_folder"), "unconfirmed")


def resolved_creators(resolutions: DataFrame) -> DataFrame:
    return resolutions.where("name is not null").select("name").distinct()
