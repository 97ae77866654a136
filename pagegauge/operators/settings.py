"""Site and module settings as three small tables, and config bundles.

site_off(host)                        sites where nothing runs
site_module(host, module, enabled)    per-site switches
module(module, enabled[, block_page_ads])   global switches
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions.joins import salted_join
from pagegauge.functions.urls import host_of


@dataclass(frozen=True)
class Settings:
    site_off: DataFrame
    site_module: DataFrame
    module: DataFrame


def site_rules(settings: Settings) -> DataFrame:
    """One row per host: excluded or not, and the modules switched off there."""
    off = settings.site_off.select(
        host_of(F.col("host")).alias("host"), F.lit(True).alias("excluded"), F.lit(None).cast("string").alias("off"))
    switched = settings.site_module.where("enabled = false").select(
        host_of(F.col("host")).alias("host"), F.lit(False).alias("excluded"), F.col("module").alias("off"))
    return off.unionByName(switched).groupBy("host").agg(
        F.max("excluded").alias("excluded"), F.sort_array(F.collect_set("off")).alias("modules_off")
    )


def _globally_off(settings: Settings) -> Column:
    """Modules switched off everywhere, as a scalar subquery over the module table."""
    off = settings.module.where("enabled = false")
    return off.agg(F.sort_array(F.collect_set("module"))).scalar()


def enabled_modules(pages: DataFrame, settings: Settings, modules: list[str] | None = None) -> DataFrame:
    """Pages with column `modules`: what runs there. Excluded sites have none.

    One join on host. Hosts are salted on the page side, as one site may own a
    large share of the pages; the settings side has one row per host.
    """
    ids = F.array(*[F.lit(m) for m in (modules or list(V.MODULE_ASPECT))])
    hosted = pages.withColumn("host", host_of(F.col("url")))
    joined = salted_join(hosted, site_rules(settings), ["host"])
    none = F.array().cast("array<string>")
    off = F.array_union(F.coalesce("modules_off", none), _globally_off(settings))
    return joined.withColumn(
        "modules",
        F.when(F.coalesce("excluded", F.lit(False)), none).otherwise(F.array_except(ids, off)),
    ).drop("excluded", "modules_off")


def ad_blocking_enabled(pages: DataFrame, settings: Settings, into: str = "block_ads") -> DataFrame:
    """adBlocker runs on the page and page ads are not exempted globally."""
    allowed = settings.module.where("module = 'adBlocker'").agg(
        F.coalesce(F.bool_and(F.coalesce("block_page_ads", F.lit(True))), F.lit(True))
    ).scalar() if "block_page_ads" in settings.module.columns else F.lit(True)
    gated = enabled_modules(pages, settings, ["adBlocker"])
    return gated.withColumn(into, (F.size("modules") > 0) & allowed).drop("modules", "host")


def apply_domain_defaults(user: DataFrame, bundle: DataFrame) -> DataFrame:
    """Shipped per-site switches under the user's own; the user's win."""
    mine = user.select("host", "module", F.col("enabled").alias("_user"))
    shipped = bundle.select("host", "module", F.col("enabled").alias("_shipped"))
    return mine.join(shipped, ["host", "module"], "full").select(
        "host", "module", F.coalesce("_user", "_shipped").alias("enabled")
    )


def off_by_default(pages: DataFrame, rules: DataFrame, module: str) -> DataFrame:
    """Pages with a flag: does the shipped list switch this module off on their host?"""
    off = rules.where((F.col("module") == module) & ~F.col("enabled")).select(
        host_of(F.col("host")).alias("host"), F.lit(True).alias("_off")).distinct()
    joined = salted_join(pages.withColumn("host", host_of(F.col("url"))), off, ["host"])
    return joined.withColumn("off_by_default", F.coalesce("_off", F.lit(False))).drop("_off", "host")


def off_list(site_module: DataFrame) -> DataFrame:
    """Sites with switches, sorted, and the names of the modules off there."""
    names = F.create_map(*[F.lit(x) for kv in V.MODULE_NAMES.items() for x in kv])
    places = F.create_map(*[F.lit(x) for i, m in enumerate(V.MODULE_NAMES) for x in (m, i)])
    off = F.when(
        F.col("enabled") == F.lit(False),
        F.struct(F.try_element_at(places, F.col("module")).alias("place"),
                 F.coalesce(F.try_element_at(names, F.col("module")), F.col("module")).alias("name")),
    )
    grouped = site_module.groupBy("host").agg(F.sort_array(F.collect_set(off)).alias("off"))
    listed = F.array_join(F.transform("off", lambda x: x["name"]), ", ")
    return grouped.select("host", F.size("off").alias("n_off"), listed.alias("modules_off")).orderBy("host")


def add_site(site_module: DataFrame, host: str) -> DataFrame:
    """Put a site on the off-list with every module off; a listed site stays as it is."""
    spark = site_module.sparkSession
    new = spark.range(1).select(
        host_of(F.lit(host)).alias("host"),
        F.explode(F.array(*[F.lit(m) for m in V.MODULE_NAMES])).alias("module"),
        F.lit(False).alias("enabled"),
    )
    fresh = new.join(site_module.select("host").distinct(), "host", "left_anti")
    return site_module.select("host", "module", "enabled").unionByName(fresh)


def set_site_module(site_module: DataFrame, host: str, module: str, enabled: bool) -> DataFrame:
    """Switch one module of a listed site; on means dropping its row, so a site
    without rows left drops off the list."""
    mine = (F.col("host") == host) & (F.col("module") == module)
    rest = site_module.where(~mine)
    if enabled:
        return rest
    listed = site_module.where(F.col("host") == host).limit(1).select(
        "host", F.lit(module).alias("module"), F.lit(False).alias("enabled"))
    return rest.unionByName(listed.select(*rest.columns))


def remove_site(site_module: DataFrame, host: str) -> DataFrame:
    return site_module.where(F.col("host") != host)


def shipped_rules(spark) -> DataFrame:
    """The shipped off-by-default list as rows."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(m).alias("module")) for h, m in V.SHIPPED_OFF])
    return spark.range(1).select(F.inline(rows)).withColumn("enabled", F.lit(False))


def current_bundle(bundles: DataFrame, bundle_id: str | None = None) -> DataFrame:
    """Newest version of each bundle. Of equal versions the one stored first stays.

    bundles: bundle_id, version, updated_at, source, data. The shipped snapshot is
    simply a row with source 'bundled'. Rows without data do not count.
    """
    rows = bundles.where("data is not null and version is not null")
    if bundle_id is not None:
        rows = rows.where(F.col("bundle_id") == bundle_id)
    rest = F.struct("updated_at", "source", "data")
    # Latest first by version, then earliest by time.
    order = F.struct((-F.col("version")).alias("v"), F.col("updated_at"))
    return rows.groupBy("bundle_id").agg(
        F.max("version").alias("version"), F.min_by(rest, order).alias("b")
    ).select("bundle_id", "version", "b.*")


def bundle_site_rules(bundle: DataFrame) -> DataFrame:
    """(host, module, enabled) rows of a bundle whose data is map<host, map<module, bool>>."""
    return bundle.select(F.explode("data").alias("host", "switches")).select(
        "host", F.explode("switches").alias("module", "enabled"))
