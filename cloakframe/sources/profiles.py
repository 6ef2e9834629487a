"""Profiles (S2-S4, R1-R4): YAML or dict in, resolved settings and four small tables out."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import schemas
from cloakframe.functions.sqltext import quote
from cloakframe.options import DEFAULT_FUZZY_THRESHOLD, DEFAULT_THRESHOLDS, check_type_name


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table as literals: Spark knows its exact size, so it decides on broadcasting by itself."""
    columns = [c.strip().rsplit(" ", 1) for c in ddl.split(",")]

    def literal(value, kind: str) -> str:
        text = "NULL" if value is None else quote(value) if isinstance(value, str) else str(value)
        return f"cast({text} AS {kind})"

    values = ", ".join(f"({', '.join(literal(v, k) for v, (_, k) in zip(row, columns))})" for row in rows)
    if not rows:
        values = f"({', '.join(literal(None, k) for _, k in columns)})"
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in columns)})")
    return table if rows else table.limit(0)


@dataclass(frozen=True)
class DictionaryValue:
    entity_type: str
    type_ord: int
    value: str
    value_ord: int


@dataclass(frozen=True)
class ResolvedProfile:
    name: str
    thresholds: dict[str, float]
    dictionary: tuple[DictionaryValue, ...]
    fuzzy_enabled: bool
    fuzzy_thresholds: dict[str, float]
    skip_terms: tuple[str, ...]

    def threshold(self, entity_type: str) -> float:
        return self.thresholds.get(entity_type, self.thresholds["DEFAULT"])

    def fuzzy_threshold(self, entity_type: str) -> float:
        return self.fuzzy_thresholds.get(
            entity_type, self.fuzzy_thresholds.get("DEFAULT", DEFAULT_FUZZY_THRESHOLD)
        )


def default_profiles() -> dict[str, dict]:
    """What is used when no profile source is there (S3): thresholds, empty dictionaries, fuzzy off."""
    return {
        "default": {
            "thresholds": dict(DEFAULT_THRESHOLDS),
            "custom_entities": {"PERSON": [], "ORGANIZATION": [], "LOCATION": []},
            "skip_terms": [],
        }
    }


# The starter profile.
STARTER_PROFILES: dict[str, dict] = {
    "default": {
        "thresholds": dict(DEFAULT_THRESHOLDS),
        "custom_entities": {
            "PERSON": ["John Doe", "Jane Smith"],
            "ORGANIZATION": ["Acme Corporation", "Example Company LLC"],
            "LOCATION": ["123 Main Street, Anytown, USA", "456 Elm Avenue, Springfield"],
            "PHONE_NUMBER": ["+1 (555) 123-4567", "800-555-0100"],
            "EMAIL_ADDRESS": ["contact@example.com", "support@testcompany.org"],
        },
        "fuzzy_match": {
            "enabled": True,
            "thresholds": {"PERSON": 85, "ORGANIZATION": 90, "LOCATION": 85, "DEFAULT": 80},
        },
        "skip_terms": [
            "en", "de", "en-US", "en-GB", "de-DE",
            "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
            "january", "february", "march", "april", "may", "june", "july",
            "august", "september", "october", "november", "december",
            "user", "assistant", "system",
        ],
    },
    "high_security": {
        "description": "Lower thresholds for types that are not listed",
        "thresholds": {"DEFAULT": 0.6},
        "custom_entities": {"PERSON": ["John Doe", "Jane Smith"]},
        "fuzzy_match": {"enabled": True, "thresholds": {"DEFAULT": 75}},
        "skip_terms": [],
    },
}


def load_profiles(path: str | None = None) -> dict[str, dict]:
    """Profiles from YAML (S2); no file or an empty one gives the built-in default. A file that can't be read fails the
    job: without its dictionaries texts would pass unredacted."""
    if path is None or not os.path.exists(path):
        return default_profiles()
    import yaml

    with open(path, encoding="utf-8") as handle:
        try:
            content = yaml.safe_load(handle)
        except (yaml.YAMLError, UnicodeDecodeError) as e:
            raise ValueError(f"profiles can't be read: {path}") from e
    if content is None:
        return default_profiles()
    found = content.get("profiles") if isinstance(content, dict) else None
    if not isinstance(found, dict) or not all(isinstance(p, dict) for p in found.values()):
        raise ValueError(f"no mapping `profiles` of names to settings in {path}")
    ProfileSet(found)
    return found


def write_profile_template(path: str) -> bool:
    """Write the starter profile unless the file exists (S4); True when written."""
    import yaml

    folder = os.path.dirname(path)
    if folder:
        os.makedirs(folder, exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8") as handle:
            yaml.safe_dump({"version": 1, "profiles": STARTER_PROFILES}, handle, sort_keys=False)
        return True
    except FileExistsError:
        return False


class ProfileSet:
    """A handful of named profiles, checked once on the driver."""

    def __init__(self, profiles: dict[str, dict] | None = None, default: str = "default") -> None:
        self.profiles = default_profiles() if profiles is None else profiles
        self.default = default
        for profile in self.profiles.values():
            for entity_type in (profile.get("custom_entities") or {}):
                check_type_name(entity_type)

    @property
    def names(self) -> list[str]:
        return list(self.profiles)

    def resolve(self, name: str | None = None) -> ResolvedProfile:
        """Thresholds overlay the defaults; fuzzy thresholds replace theirs; unknown names get bare defaults."""
        chosen = name or self.default
        profile = self.profiles.get(chosen) or {}
        fuzzy = profile.get("fuzzy_match") or {}
        return ResolvedProfile(
            name=chosen,
            thresholds={**DEFAULT_THRESHOLDS, **(profile.get("thresholds") or {})},
            dictionary=tuple(_values(profile.get("custom_entities") or {})),
            fuzzy_enabled=bool(fuzzy.get("enabled", False)),
            fuzzy_thresholds=dict(fuzzy.get("thresholds") or {"DEFAULT": DEFAULT_FUZZY_THRESHOLD}),
            skip_terms=tuple(str(t) for t in (profile.get("skip_terms") or [])),
        )

    # -- the four small tables -------------------------------------------------------------

    def threshold_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, t, float(v))
            for name, p in self.profiles.items()
            for t, v in (p.get("thresholds") or {}).items()
        ]
        return literal_table(spark, rows, schemas.PROFILE_THRESHOLD)

    def entity_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, v.entity_type, v.type_ord, v.value, v.value_ord)
            for name, p in self.profiles.items()
            for v in _values(p.get("custom_entities") or {})
        ]
        return literal_table(spark, rows, schemas.PROFILE_ENTITY)

    def fuzzy_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for name in self.profiles:
            r = self.resolve(name)
            rows += [(name, r.fuzzy_enabled, t, int(v)) for t, v in r.fuzzy_thresholds.items()]
        return literal_table(spark, rows, schemas.PROFILE_FUZZY)

    def skip_table(self, spark: SparkSession) -> DataFrame:
        rows = [(name, str(t)) for name, p in self.profiles.items() for t in (p.get("skip_terms") or [])]
        return literal_table(spark, rows, schemas.PROFILE_SKIP)

    def resolved_thresholds(self, spark: SparkSession) -> DataFrame:
        """(profile, entity_type, threshold): defaults and profiles, full outer, the profile's value first."""
        rows = [(name, t, float(v)) for name in self.profiles for t, v in DEFAULT_THRESHOLDS.items()]
        return overlay_thresholds(literal_table(spark, rows, schemas.PROFILE_THRESHOLD), self.threshold_table(spark))

    def key_sql(self, profile: str) -> str:
        """SQL: the row's profile name, the default for none, '' (bare defaults) for an unknown one."""
        asked = f"coalesce({profile}, {quote(self.default)})"
        names = ", ".join(quote(n) for n in self.names)
        return f"CASE WHEN {asked} IN ({names}) THEN {asked} ELSE '' END" if names else "''"

    def per_profile(self) -> dict[str, ResolvedProfile]:
        """Resolved settings by key, with the bare defaults under ''."""
        return {n: self.resolve(n) for n in self.names} | {"": ProfileSet({}).resolve()}

    def cuts_sql(self, profile: str) -> str:
        """SQL for MAP<entity_type, threshold> of the row's profile: a literal, so no join is needed."""

        def cuts(p: ResolvedProfile) -> str:
            return "map(" + ", ".join(f"{quote(t)}, {float(v)}D" for t, v in p.thresholds.items()) + ")"

        pairs = ", ".join(f"{quote(n)}, {cuts(p)}" for n, p in self.per_profile().items())
        return f"try_element_at(map({pairs}), {self.key_sql(profile)})"


def overlay_thresholds(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Profile rows over default rows, per profile and type."""
    base = defaults.withColumnRenamed("threshold", "_base")
    return base.join(own, ["profile", "entity_type"], "full").select(
        "profile", "entity_type", F.coalesce("threshold", "_base").alias("threshold")
    )


def type_cut(cuts: str, entity_type: str) -> str:
    """SQL: the type's threshold, else the DEFAULT one (R2)."""
    return f"coalesce(try_element_at({cuts}, {entity_type}), try_element_at({cuts}, 'DEFAULT'))"


def _values(custom_entities: dict[str, list[str]]) -> list[DictionaryValue]:
    """Dictionary rows in profile order; empty values are dropped."""
    return [
        DictionaryValue(entity_type, t, str(value), v)
        for t, (entity_type, values) in enumerate(custom_entities.items())
        for v, value in enumerate(values or [])
        if value is not None and str(value) != ""
    ]


def chosen_profile(profile: Column, profiles: ProfileSet) -> Column:
    """The row's profile, else the default."""
    return F.coalesce(profile, F.lit(profiles.default))
