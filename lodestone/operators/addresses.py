"""Candidate addresses of documentation as a bounded ordered product: only the first ones of a package are ever made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.versions import clean_version

#: Where documentation sites keep the page of an API in a version; v: version, api, slug, path: the API.
PAGE_SUFFIXES = (
    "{v}/reference/api/{api}.html", "v{v}/reference/api/{api}.html", "version/{v}/reference/api/{api}.html", "{v}/reference/generated/{api}.html", "v{v}/reference/generated/{api}.html",
    "reference/api/{api}.html", "reference/generated/{api}.html", "{v}/api/{slug}/", "v{v}/api/{slug}/", "{v}/reference/{slug}/", "v{v}/reference/{slug}/", "{v}/{path}.html", "v{v}/{path}.html",
    "api/{slug}/", "reference/{slug}/", "{slug}/",
)
#: The same at the documentation hosts of ecosystems.
HOST_PAGES = {
    "cargo": ("https://docs.rs/{package}/{v}/{slug}.html", "https://docs.rs/{package}/{v}/{slashed}.html"),
    "go": ("https://pkg.go.dev/{package}@{v}#{anchor}",),
    "maven": ("https://javadoc.io/doc/{coordinates}/{v}/{dotless}.html",),
}
#: Pages of a documentation site that may tell of a migration, of a version, of an API.
SITE_SUFFIXES = ("llms.txt", "llms-full.txt", "migration/", "migrations/", "upgrade/", "upgrading/", "changelog/", "release-notes/", "releases/", "api/", "reference/")
VERSION_SUFFIXES = ("{v}/", "v{v}/", "{v}/migration/", "v{v}/migration/")
API_SUFFIXES = ("api/{slug}/", "reference/{slug}/", "concepts/{slug}/", "usage/{slug}/")


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def _listed(rows: DataFrame, value: str, order: Column, most: int) -> DataFrame:
    """package, values: the first values of a package in order, each once."""
    first = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy("package", value).agg(F.min(order).alias("_at"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("package").orderBy("_at", value))).where(F.col("_n") <= most)
    return ranked.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("value")))), lambda x: x["value"]).alias("values"))


def _first_of(rows: DataFrame, limit: int) -> DataFrame:
    """package, place, ..., url: each address of a package once, without a closing slash, the first ones."""
    plain = rows.withColumn("url", F.regexp_replace("url", "/+$", ""))
    once = plain.groupBy("package", "url").agg(F.min_by(F.struct("i", "title"), "i").alias("_f")).select("package", "url", "_f.i", "_f.title")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy("i"))).where(F.col("place") <= limit)
    return placed.select("package", "place", "title", "url")


def old_pages(packages: DataFrame, bases: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """package, place, title, url: the first pages that may describe a package's APIs in its current version.

    packages: package, ecosystem, version. bases: package, base (sites, in their order of text). symbols: package, symbol,
    ord. First the hosts of the ecosystem, then every site x symbol x suffix. Number i of the product is decoded to its
    parts by division, and only so many numbers are made as `limit` different addresses can need: two symbols may share a
    slug, but of one symbol's suffixes those with its name are its own, so every step of one symbol has new ones.
    """
    named = sum("{api}" in s or "{path}" in s for s in PAGE_SUFFIXES)
    steps = -(-limit // named) + 1
    sites = _listed(bases.select("package", F.regexp_replace("base", "/+$", "").alias("base")), "base", F.lit(0), steps).withColumnRenamed("values", "sites")
    names = _listed(symbols, "symbol", F.col("ord"), steps).withColumnRenamed("values", "symbols")
    rows = packages.select("package", F.lower(F.coalesce("ecosystem", F.lit(""))).alias("ecosystem"), clean_version(F.col("version")).alias("v")).where("v <> ''").join(names, "package").join(sites, "package", "left")
    none = F.array().cast("array<string>")
    hosts = none
    for ecosystem, templates in HOST_PAGES.items():
        usable = (F.col("ecosystem") == ecosystem) & (F.contains("package", F.lit(":")) if ecosystem == "maven" else F.lit(True))
        hosts = F.when(usable, F.array(*map(F.lit, templates))).otherwise(hosts)
    rows = rows.withColumn("hosts", hosts).withColumn("sites", F.coalesce("sites", none)).withColumn("suffixes", F.array(*map(F.lit, PAGE_SUFFIXES)))
    rows = rows.withColumn("_a", (F.size("hosts") * F.size("symbols")).cast("long")).withColumn("_b", (F.size("sites") * F.size("symbols") * F.size("suffixes")).cast("long"))
    count = F.least(F.col("_a") + F.col("_b"), F.col("_a") + F.lit(steps * len(PAGE_SUFFIXES)))
    numbered = rows.withColumn("i", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))))
    at_host = F.col("i") < F.col("_a")
    j = F.when(at_host, F.col("i")).otherwise(F.col("i") - F.col("_a"))
    width = F.when(at_host, F.size("hosts")).otherwise(F.size("suffixes"))
    part = lambda array, n: F.get(array, n.cast("int"))
    decoded = numbered.select(
        "package", "i", "v", "ecosystem", at_host.alias("at_host"), part(F.when(at_host, F.col("hosts")).otherwise(F.col("suffixes")), j % width).alias("template"),
        part(F.col("symbols"), F.floor(j / width) % F.size("symbols")).alias("symbol"), F.when(~at_host, part(F.col("sites"), F.floor(j / (width * F.size("symbols"))))).alias("site"),
    )
    symbol, api = F.col("symbol"), F.replace(F.replace("symbol", F.lit("/"), F.lit(".")), F.lit("::"), F.lit("."))
    values = {
        "v": F.col("v"), "package": F.col("package"), "api": api, "slug": tx.slug(symbol), "path": F.replace(api, F.lit("."), F.lit("/")), "slashed": F.replace(F.replace("symbol", F.lit("::"), F.lit("/")), F.lit("."), F.lit("/")),
        "anchor": F.regexp_extract(symbol, r"([^.:/]+)[.:/]*$", 1), "coordinates": F.regexp_replace("package", ":", "/"), "dotless": F.replace("symbol", F.lit("."), F.lit("/")),
    }
    site = F.when(F.col("at_host"), F.lit("")).otherwise(F.concat("site", F.lit("/")))
    host = F.when(F.col("ecosystem") == "cargo", "docs.rs ").when(F.col("ecosystem") == "go", "pkg.go.dev ").otherwise("javadoc ")
    title = F.when(F.col("at_host"), F.concat(host, symbol, F.lit(" "), F.col("v"))).otherwise(F.concat(F.lit("Old docs for "), symbol))
    return _first_of(decoded.select("package", "i", title.alias("title"), F.concat(site, _filled(F.col("template"), values)).alias("url")), limit)


def site_pages(packages: DataFrame, urls: DataFrame, versions: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """package, place, title, url: the first pages of a package's documentation sites that may tell of a migration.

    urls: package, url, base (in their order of text). versions: package, version, ord. symbols: package, symbol, ord. Each
    address is followed by its site's pages: fixed ones, then those of each version, then those of each symbol. Number i is
    decoded by division; addresses of one site repeat its pages, so only a site's first address is given them.
    """
    fixed, per_version, per_symbol = len(SITE_SUFFIXES), len(VERSION_SUFFIXES), len(API_SUFFIXES)
    sites = urls.where("url <> '' AND base <> ''").select("package", "url", "base").distinct()
    first = Window.partitionBy("package", "base").orderBy("url")
    # Beyond `limit` addresses none can be among the first.
    ordered = sites.withColumn("_lead", F.row_number().over(first) == 1).withColumn("_n", F.row_number().over(Window.partitionBy("package").orderBy("url")) - 1).where(F.col("_n") < limit)
    held = _listed(versions, "version", F.col("ord"), limit).withColumnRenamed("values", "versions")
    names = _listed(symbols.withColumn("slug", tx.slug(F.col("symbol"))), "slug", F.col("ord"), limit).withColumnRenamed("values", "slugs")
    none = F.array().cast("array<string>")
    rows = ordered.join(packages.select("package").distinct(), "package", "left_semi").join(held, "package", "left").join(names, "package", "left")
    rows = rows.withColumn("versions", F.coalesce("versions", none)).withColumn("slugs", F.coalesce("slugs", none))
    size = F.least(F.lit(limit), fixed + per_version * F.size("versions") + per_symbol * F.size("slugs"))
    each = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("_lead"), size).otherwise(0))))
    # 0 is the address itself.
    k = F.col("j") - 1
    in_versions, in_symbols = k - fixed, k - fixed - per_version * F.size("versions")
    lit = lambda values, n: F.get(F.array(*map(F.lit, values)), n)
    suffix = (
        F.when(k < fixed, lit(SITE_SUFFIXES, k))
        .when(in_symbols < 0, F.replace(lit(VERSION_SUFFIXES, in_versions % per_version), F.lit("{v}"), F.get("versions", F.floor(in_versions / per_version).cast("int"))))
        .otherwise(F.replace(lit(API_SUFFIXES, in_symbols % per_symbol), F.lit("{slug}"), F.get("slugs", F.floor(in_symbols / per_symbol).cast("int"))))
    )
    page = F.when(k < 0, F.col("url")).otherwise(F.concat("base", F.lit("/"), suffix))
    title = F.when(k < 0, F.lit("Documentation page")).otherwise(F.regexp_replace(suffix, "/+$", ""))
    return _first_of(each.select("package", (F.col("_n").cast("long") * (limit + 1) + F.col("j")).alias("i"), title.alias("title"), page.alias("url")), limit)
