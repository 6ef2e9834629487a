"""Profiles as tables (R1-R4, S2): settings of any number of tenants, joined to the rows instead of written into the plan.

The four tables have the columns of `schemas.PROFILE_*`. Each profile becomes one row of settings, and rows get those of
their profile by one left join, in which a hot profile's rows can be split by AQE and a small table is broadcast by its
measured size. Dictionaries of more than `fold_limit` values are not carried along with the rows: their values meet the
texts of their own profile alone, see `plans.columns.with_table_hits`.

Rows of the tables without a profile, and those without a type, threshold, value or term, are left out. Of several
thresholds of one type the lowest counts. A profile that is in no table has the bare defaults, a row without a profile
takes the default one. Entity types must match [A-Z_]+, else the job fails.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.similarity import longest_partner, shortest_partner
from cloakframe.functions.sqltext import empty, keep, quote, struct, transform
from cloakframe.options import DEFAULT_FUZZY_THRESHOLD, DEFAULT_THRESHOLDS, PRIORITY, TYPE_NAME, Options
from cloakframe.schemas import CANDIDATES, FUZZY_VALUES
from cloakframe.sources.profiles import ProfileSet
from cloakframe.sources.tables import stage

SETTINGS = "_settings"
PROFILE = "_profile"
DEFAULT_CUTS = "map(" + ", ".join(f"{quote(t)}, {v}D" for t, v in DEFAULT_THRESHOLDS.items()) + ")"


def _type() -> Column:
    wrong = F.raise_error(F.concat(F.lit("entity type must match [A-Z_]+: "), "entity_type"))
    return F.when(F.col("entity_type").rlike(TYPE_NAME.pattern), F.col("entity_type")).otherwise(wrong)


@dataclass(frozen=True)
class ProfileTables:
    """Four tables of settings by profile name, and the name that rows without one take."""

    thresholds: DataFrame
    entities: DataFrame
    fuzzy: DataFrame
    skip: DataFrame
    default: str = "default"

    @classmethod
    def of(cls, spark: SparkSession, profiles: ProfileSet) -> ProfileTables:
        return cls(
            profiles.threshold_table(spark), profiles.entity_table(spark), profiles.fuzzy_table(spark),
            profiles.skip_table(spark), profiles.default,
        )

    def written(self) -> ProfileTables:
        """The same with the dictionaries written to the shared folder, for plans that use them several times."""
        return replace(self, entities=stage(self.entities, "entities"))

    def values(self, options: Options) -> DataFrame:
        """The dictionary rows with `large`, which is true for the values of profiles with more than fold_limit."""
        rows = self.entities.where("profile IS NOT NULL AND entity_type IS NOT NULL AND value <> ''").select(
            "profile", _type().alias("entity_type"), "type_ord", "value", "value_ord"
        )
        counts = rows.groupBy("profile").agg((F.count("*") > options.fold_limit).alias("large"))
        return rows.join(counts, "profile")

    def fuzzy_thresholds(self) -> DataFrame:
        """(profile, enabled, near): one row a profile, thresholds by type."""
        rows = self.fuzzy.where("profile IS NOT NULL").groupBy("profile", "entity_type").agg(
            F.max("enabled").alias("enabled"), F.min("threshold").cast("double").alias("threshold")
        )
        pair = F.when(F.expr("entity_type IS NOT NULL AND threshold IS NOT NULL"), F.struct("entity_type", "threshold"))
        return rows.groupBy("profile").agg(
            F.coalesce(F.max("enabled"), F.lit(False)).alias("enabled"), F.map_from_entries(F.collect_list(pair)).alias("near")
        )

    def large_values(self, options: Options) -> DataFrame:
        """Values of large dictionaries by _profile, with the threshold of those that are matched fuzzily."""
        rows = self.values(options).where("large").join(self.fuzzy_thresholds().where("enabled"), "profile", "left")
        return rows.select(
            F.col("profile").alias(PROFILE), "entity_type", "type_ord", "value", "value_ord",
            F.expr(f"CASE WHEN enabled THEN {_near_threshold('entity_type')} END").alias("threshold"),
        )

    def any_large(self, options: Options) -> bool:
        return not self.values(options).where("large").select(F.lit(1)).limit(1).isEmpty()

    def settings(self, options: Options, fold_all: bool = False) -> DataFrame:
        """(_profile, _settings): one row a profile. With `fold_all` dictionaries of any size are in it."""
        cuts = self.thresholds.where("profile IS NOT NULL AND entity_type IS NOT NULL AND threshold IS NOT NULL")
        cuts = cuts.groupBy("profile", "entity_type").agg(F.min("threshold").cast("double").alias("threshold"))
        values = self.values(options)
        value = F.struct("type_ord", "value_ord", "entity_type", "value")
        term = F.col("term") if options.skip_parity else F.lower("term")
        kinds = {
            "t": cuts.select("profile", F.struct("entity_type", "threshold").alias("t")),
            "v": values.select("profile", F.when(F.lit(True) if fold_all else ~F.col("large"), value).alias("v"), "large"),
            "f": self.fuzzy_thresholds().select("profile", F.struct("enabled", "near").alias("f")),
            "s": self.skip.where("profile IS NOT NULL AND term IS NOT NULL").select("profile", term.alias("s")).distinct(),
        }
        rows = None
        for kind in kinds.values():
            rows = kind if rows is None else rows.unionByName(kind, allowMissingColumns=True)
        one = rows.groupBy("profile").agg(
            F.collect_list("t").alias("t"), F.sort_array(F.collect_list("v")).alias("v"),
            F.first("f", ignorenulls=True).alias("f"), F.collect_list("s").alias("s"), F.coalesce(F.max("large"), F.lit(False)).alias("large"),
        )
        own = "map_from_entries(t)"
        bare = f"map_filter({DEFAULT_CUTS}, (k, x) -> NOT exists(t, o -> o.entity_type = k))"
        folded = transform(
            "v",
            lambda v: struct(
                priority=str(PRIORITY["exact"]), type_ord=f"{v}.type_ord", value_ord=f"{v}.value_ord", neg_score="-1.0D",
                entity_type=f"{v}.entity_type", value=f"{v}.value", source="'exact'",
            ),
        )
        named = transform(
            keep("v", lambda v: f"length({v}.value) >= {options.min_entity_length}"),
            lambda v: struct(
                entity_type=f"{v}.entity_type", type_ord=f"{v}.type_ord", value=f"{v}.value", value_ord=f"{v}.value_ord",
                lowered=f"lower({v}.value)", threshold=_near_threshold(f"{v}.entity_type", "f.near"),
            ),
        )
        reach = transform(
            "near",
            lambda v: struct(
                entity_type=f"{v}.entity_type", type_ord=f"{v}.type_ord", value=f"{v}.value", value_ord=f"{v}.value_ord",
                lowered=f"{v}.lowered", threshold=f"{v}.threshold",
                lo=shortest_partner(f"length({v}.lowered)", f"{v}.threshold"), hi=longest_partner(f"length({v}.lowered)", f"{v}.threshold"),
            ),
        )
        shaped = one.select(
            F.col("profile").alias(PROFILE), "s", "large",
            F.expr(f"map_concat({own}, {bare})").alias("cuts"), F.expr(f"cast({folded} AS {CANDIDATES})").alias("values"),
            F.expr(f"CASE WHEN f.enabled THEN {named} END").alias("near"),
        ).withColumn("near", F.expr(f"coalesce(cast({reach} AS {FUZZY_VALUES}), {empty(FUZZY_VALUES)})"))
        lo, hi = transform("near", lambda v: f"{v}.lo"), transform("near", lambda v: f"{v}.hi")
        return shaped.select(
            PROFILE,
            F.struct(
                "cuts", "values", "near", F.expr(f"coalesce(array_min({lo}), 1)").alias("lo"),
                F.expr(f"coalesce(array_max({hi}), 0)").alias("hi"), F.col("s").alias("skips"), "large",
            ).alias(SETTINGS),
        )

    def asked(self, df: DataFrame, column: str | None) -> DataFrame:
        """`df` with the name of its profile as column _profile."""
        return df.withColumn(PROFILE, F.coalesce(F.col(column), F.lit(self.default)) if column else F.lit(self.default))

    def attach(self, df: DataFrame, column: str | None, options: Options, fold_all: bool = False) -> DataFrame:
        """`df` with the columns _profile and _settings; the settings of an unknown profile are null."""
        return self.asked(df, column).join(self.settings(options, fold_all), PROFILE, "left")


def _near_threshold(entity_type: str, near: str = "near") -> str:
    return f"coalesce(try_element_at({near}, {entity_type}), try_element_at({near}, 'DEFAULT'), {float(DEFAULT_FUZZY_THRESHOLD)}D)"
