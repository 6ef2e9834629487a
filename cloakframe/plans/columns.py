"""Public API over text columns: redact_column and restore_column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import empty, keep, let, quote, struct, transform
from cloakframe.functions.text import eligible, is_skip_term, is_uuid_shaped
from cloakframe.operators.detect import BUILT_IN, Detector, detect
from cloakframe.operators.dictionary import (
    dictionary_candidates,
    dictionary_hits_join,
    group_hits_join,
    literal_dictionary,
    with_group_hits,
)
from cloakframe.operators.fuzzy import (
    folded_fuzzy,
    fuzzy_bounds,
    fuzzy_candidates,
    fuzzy_hits,
    fuzzy_literal,
    near_candidates,
    near_column,
)
from cloakframe.operators.redact import redact_candidates, redact_spans, spans_to_candidates
from cloakframe.operators.sweep import MANY, sweep_leaves
from cloakframe.operators.tokens import mapping_id, token_scope
from cloakframe.options import PRIORITY, Options
from cloakframe.schemas import CANDIDATES, ENTITIES, FUZZY_VALUES, SPANS
from cloakframe.sources.profile_tables import DEFAULT_CUTS, PROFILE, SETTINGS, ProfileTables
from cloakframe.sources.profiles import ProfileSet, ResolvedProfile, literal_table, type_cut
from cloakframe.sources.tables import stage


class RowProfiles:
    """Settings looked up per row by a profile column: one expression, however many profiles there are."""

    def __init__(self, column: str, profiles: ProfileSet) -> None:
        self.key = profiles.key_sql(column)
        self.cuts = profiles.cuts_sql(column)
        self.profiles = profiles.per_profile()
        self.largest = max(len(p.dictionary) for p in self.profiles.values())
        self.fuzzy_enabled = any(p.fuzzy_enabled and p.dictionary for p in self.profiles.values())

    def _map(self, value, array_type: str) -> str:
        pairs = ", ".join(f"{quote(n)}, {value(p)}" for n, p in self.profiles.items())
        return f"cast(map({pairs}) AS map<string, {array_type}>)"

    def over_threshold(self, spans: str) -> str:
        return let(self.cuts, lambda cuts: keep(spans, lambda s: f"{s}.score >= {type_cut(cuts, f'{s}.entity_type')}"))

    def dictionary(self, text: str) -> str:
        if not self.largest:
            return empty(CANDIDATES)
        values = self._map(lambda p: literal_dictionary(list(p.dictionary)), CANDIDATES)
        return keep(f"try_element_at({values}, {self.key})", lambda v: f"contains({text}, {v}.value)")

    def near_values(self, options: Options) -> str:
        values = self._map(lambda p: fuzzy_literal(p, options), FUZZY_VALUES)
        return f"coalesce(try_element_at({values}, {self.key}), {empty(FUZZY_VALUES)})"

    def fuzzy(self, text: str, options: Options) -> str:
        bounds = [fuzzy_bounds(p, options) for p in self.profiles.values() if p.fuzzy_enabled and p.dictionary]
        return folded_fuzzy(text, self.near_values(options), (min(b[0] for b in bounds), max(b[1] for b in bounds)), options)

    def skipped(self, text: str, parity: bool) -> str:
        def terms(p: ResolvedProfile) -> str:
            wanted = sorted({t if parity else t.lower() for t in p.skip_terms})
            return f"array({', '.join(quote(t) for t in wanted)})"

        return f"coalesce(array_contains(try_element_at({self._map(terms, 'array<string>')}, {self.key}), lower({text})), false)"


class TableProfiles(RowProfiles):
    """Settings that `ProfileTables.attach` joined to the row: one expression, whatever the profile."""

    def __init__(self) -> None:
        self.cuts = f"coalesce({SETTINGS}.cuts, {DEFAULT_CUTS})"
        self.largest, self.fuzzy_enabled = 1, True

    def dictionary(self, text: str) -> str:
        known = f"coalesce({SETTINGS}.values, {empty(CANDIDATES)})"
        return keep(known, lambda v: f"contains({text}, {v}.value)")

    def near_values(self, options: Options) -> str:
        return f"coalesce({SETTINGS}.near, {empty(FUZZY_VALUES)})"

    def fuzzy(self, text: str, options: Options) -> str:
        hits = folded_fuzzy(text, f"{SETTINGS}.near", (f"{SETTINGS}.lo", f"{SETTINGS}.hi"), options)
        return f"CASE WHEN size({SETTINGS}.near) > 0 THEN {hits} ELSE {empty(CANDIDATES)} END"

    def skipped(self, text: str, parity: bool) -> str:
        return f"coalesce(array_contains({SETTINGS}.skips, lower({text})), false)"


def candidates_of(
    text: str,
    profile: ResolvedProfile | RowProfiles,
    options: Options = Options(),
    detectors: Iterable[Detector] | None = None,
    lang: str | None = None,
    extra: str | None = None,
    joined: bool = False,
    fuzzy: bool = True,
    near: str | None = None,
) -> tuple[str, bool]:
    """SQL for what is found in one text expression, usable inside transform() as well, and whether these are exact
    spans (ARRAY<span>) or candidates, all of whose occurrences count (ARRAY<candidate>).

    Dictionaries of any size and fuzzy matching are folded into the expression. `extra` is an ARRAY<candidate> from
    elsewhere: gazetteers, a model, or dictionaries joined by `redact_column` (with `joined`, not folded again).
    Without `fuzzy` fuzzy matching is left to `extra`; `near` is SQL of fuzzy hits that were found before.
    """
    chosen = BUILT_IN if detectors is None else list(detectors)
    per_row = isinstance(profile, RowProfiles)
    n_values = 0 if joined else profile.largest if per_row else len(profile.dictionary)
    if per_row:
        spans = profile.over_threshold(detect(text, chosen, None, lang, options.disabled_types))
        values = [profile.dictionary(text)] if n_values else []
        if n_values and fuzzy and profile.fuzzy_enabled:
            values.append(near or profile.fuzzy(text, options))
        skipped = profile.skipped(text, options.skip_parity)
    else:
        spans = detect(text, chosen, profile.thresholds, lang, options.disabled_types)
        values = [dictionary_candidates(text, list(profile.dictionary))] if n_values else []
        if n_values and fuzzy and profile.fuzzy_enabled:
            values.append(near or folded_fuzzy(text, fuzzy_literal(profile, options), fuzzy_bounds(profile, options), options))
        skipped = is_skip_term(text, list(profile.skip_terms), options.skip_parity)
    touched = (
        f"{eligible(text, options.min_text_length)} AND NOT {skipped}"
        f" AND NOT {is_uuid_shaped(text, options.uuid_length, options.uuid_dashes)}"
    )
    if not options.all_occurrences and not n_values and extra is None:
        return f"CASE WHEN {touched} THEN {spans} ELSE {empty(SPANS)} END", True
    parts = [*values, spans_to_candidates(spans)]
    if extra is not None:
        parts.append(f"coalesce(cast({extra} AS {CANDIDATES}), {empty(CANDIDATES)})")
    return f"CASE WHEN {touched} THEN cast(concat({', '.join(parts)}) AS {CANDIDATES}) ELSE {empty(CANDIDATES)} END", False


def redaction(text: str, profile: ResolvedProfile | RowProfiles, scope: str, options: Options = Options(), **how) -> str:
    """SQL for STRUCT<text, entities> of one text expression alone, for SQL functions; `how` as in candidates_of."""
    found, exact = candidates_of(text, profile, options, **how)
    return (redact_spans if exact else redact_candidates)(options, text, scope, found)


JOINED = "_dictionary_hits"
NEAR_VALUES, NEAR = "_near_values", "_near"


def with_dictionary_hits(df: DataFrame, text: str, profile: ResolvedProfile, options: Options, extra: str | None) -> DataFrame:
    """`df` with the dictionary and fuzzy hits of its texts, and the candidates of `extra`, as column JOINED.

    Hits depend on the text alone, so they are found once for each distinct text and joined on its SHA-256.
    """
    rows = df.withColumn("_text_hash", F.sha2(text, 256))
    texts = rows.where(F.col(text).isNotNull()).select("_text_hash", F.col(text).alias("_text")).dropDuplicates(["_text_hash"])
    every = [(v.entity_type, v.type_ord, v.value, v.value_ord) for v in profile.dictionary]
    known = literal_table(df.sparkSession, every, "entity_type STRING, type_ord INT, value STRING, value_ord INT")
    exact = dictionary_hits_join(texts, ["_text_hash"], "_text", known)
    near = fuzzy_hits(texts, ["_text_hash"], "_text", profile, options) if profile.fuzzy_enabled else None
    return joined_hits(rows, ["_text_hash"], exact, near, extra).drop("_text_hash")


def joined_hits(rows: DataFrame, by: list[str], exact: DataFrame, near: DataFrame | None, extra: str | None) -> DataFrame:
    """`rows` with the hits of their text and the candidates of `extra`, as column JOINED."""
    one = F.struct(
        F.lit(PRIORITY["exact"]).alias("priority"), "type_ord", "value_ord", F.lit(-1.0).alias("neg_score"),
        "entity_type", "value", F.lit("exact").alias("source"),
    )
    hits = exact.select(*by, F.array(one).cast(CANDIDATES).alias("_c"))
    if near is not None:
        hits = hits.unionByName(fuzzy_candidates(near, by).select(*by, F.col("candidates").cast(CANDIDATES).alias("_c")))
    found = rows.join(hits.groupBy(*by).agg(F.flatten(F.collect_list("_c")).alias(JOINED)), by, "left")
    return found.withColumn(JOINED, F.concat(F.coalesce(F.col(JOINED), F.expr(empty(CANDIDATES))), own_candidates(extra)))


def own_candidates(extra: str | None) -> Column:
    none = F.expr(empty(CANDIDATES))
    return F.coalesce(F.col(extra).cast(CANDIDATES), none) if extra else none


def with_table_hits(
    df: DataFrame, text: str, tables: ProfileTables, settings: DataFrame, options: Options, extra: str | None
) -> DataFrame:
    """`df`, which has the profiles of its rows, with their settings, and as column JOINED the hits of dictionaries too large
    to fold and the candidates of `extra`. Only rows of such profiles are shuffled: once and whole, or, where a profile's
    values are many or matched fuzzily, each distinct text of a profile is read once and its hits are joined. Settings are
    joined behind that, so that they are neither shuffled nor sent to the workers with the rows."""
    of_large = settings.where(f"{SETTINGS}.large")
    all_rows, df = df.join(settings, PROFILE, "left"), df.join(of_large.select(PROFILE), PROFILE, "left_semi").where(F.col(text).isNotNull())
    is_large = F.coalesce(F.col(f"{SETTINGS}.large"), F.lit(False)) & F.col(text).isNotNull()
    rest = all_rows.where(~is_large).withColumn(JOINED, own_candidates(extra))
    known = stage(tables.large_values(options), "dictionaries")
    fuzzy = known.where("threshold IS NOT NULL")
    no_fuzzy = fuzzy.isEmpty()
    if no_fuzzy:
        whole = with_group_hits(df, text, known.drop("threshold").distinct(), PROFILE)
        if whole is not None:
            exact = transform(
                "_hits",
                lambda h: struct(
                    priority=str(PRIORITY["exact"]), type_ord=f"{h}.type_ord", value_ord=f"{h}.value_ord", neg_score="-1.0D",
                    entity_type=f"{h}.entity_type", value=f"{h}.value", source="'exact'",
                ),
            )
            hits = F.concat(F.expr(f"cast({exact} AS {CANDIDATES})"), own_candidates(extra))
            return rest.unionByName(whole.withColumn(JOINED, hits).drop("_hits").join(of_large, PROFILE))
    by = [PROFILE, "_text_hash"]
    rows = df.withColumn("_text_hash", F.sha2(text, 256))
    texts = rows.select(*by, F.col(text).alias("_text")).dropDuplicates(by)
    exact = group_hits_join(texts, by, "_text", known.drop("threshold"), PROFILE)
    near = None
    if not no_fuzzy:
        asked = texts.join(fuzzy.select(PROFILE).distinct(), PROFILE, "left_semi")
        near = fuzzy_hits(asked, by, "_text", options=options, dictionary=fuzzy, group=PROFILE)
    found = joined_hits(rows, by, exact, near, extra).drop("_text_hash")
    return rest.unionByName(found.join(of_large, PROFILE))


def redact_column(
    df: DataFrame,
    text: str,
    keys: list[str],
    profiles: ProfileSet | ProfileTables | None = None,
    profile: str | None = None,
    profile_column: str | None = None,
    options: Options = Options(),
    detectors: Iterable[Detector] | None = None,
    lang: str | None = None,
    extra: str | None = None,
    path: str | None = None,
    path_column: str | None = None,
    fuzzy: bool = True,
) -> DataFrame:
    """`df` plus mapping_id, redacted and entities. Narrow: no join, no shuffle, unless a dictionary has more than
    `options.fold_limit` values: those are found by joins on the text's hash, with the same result.

    `keys` name the document; `profile_column` picks a profile per row (unknown: bare defaults). Set `fuzzy` to False
    where `extra` has the fuzzy hits already. Texts with very many candidates are swept in Arrow batches. Profiles of very
    many tenants are given as `ProfileTables`, which are joined to the rows by `profile_column`.
    """
    profiles = profiles or ProfileSet(default=options.default_profile)
    chosen = None if detectors is None else list(detectors)
    scope = token_scope(options, "mapping_id", f"`{path_column}`" if path_column else quote(path or text))

    given, columns = extra, df.columns
    if isinstance(profiles, ProfileTables):
        if profile:
            raise ValueError("name the profiles of ProfileTables by profile_column")
        settings, joined = TableProfiles(), False
        profiles = profiles.written()
        if profiles.any_large(options):
            known = stage(profiles.settings(options), "settings")
            fuzzy = fuzzy and not known.where(f"size({SETTINGS}.near) > 0").isEmpty()
            df = with_table_hits(profiles.asked(df, profile_column), text, profiles, known, options, extra)
            extra = JOINED
        else:
            df = profiles.attach(df, profile_column, options)
    else:
        settings = RowProfiles(profile_column, profiles) if profile_column else profiles.resolve(profile)
        joined = isinstance(settings, ResolvedProfile) and len(settings.dictionary) > options.fold_limit
    if joined:
        df = with_dictionary_hits(df, text, settings, options, extra)
        extra = JOINED
    near = None
    per_row = isinstance(settings, RowProfiles)
    if fuzzy and not joined and settings.fuzzy_enabled and (settings.largest if per_row else settings.dictionary):
        values = settings.near_values(options) if per_row else fuzzy_literal(settings, options)
        df = df.withColumn(NEAR_VALUES, F.expr(values)).withColumn(NEAR, near_column(f"`{text}`", NEAR_VALUES, options))
        near = near_candidates(f"`{text}`", NEAR, NEAR_VALUES)
    found, exact = candidates_of(text, settings, options, chosen, lang, extra, joined, fuzzy, near)
    kept = [c for c in columns if c not in ("mapping_id", extra, given)]
    used = [*([extra] if extra else []), *([NEAR_VALUES, NEAR] if near else []), *([SETTINGS] if isinstance(settings, TableProfiles) else [])]
    staged = df.select(*kept, *used, F.expr(mapping_id(options, *keys)).alias("mapping_id"))
    if exact:
        done = staged.withColumn("_redaction", F.expr(redact_spans(options, text, scope, found)))
    else:
        leaf = struct(key="''", path="''", text=text, scope=scope, found="_found")
        done = staged.withColumn("_found", F.expr(found)).withColumn(
            "_swept", sweep_leaves(options, F.expr(f"CASE WHEN size(_found) > {MANY} THEN array({leaf}) END"))
        )
        few = redact_candidates(options, text, scope, "_found")
        swept = struct(text="_swept[0].text", entities=f"cast(_swept[0].entities AS {ENTITIES})")
        done = done.withColumn("_redaction", F.expr(f"CASE WHEN size(_found) > {MANY} THEN {swept} ELSE {few} END"))
    return done.select(
        *kept,
        "mapping_id",
        F.col("_redaction.text").alias("redacted"),
        F.col("_redaction.entities").alias("entities"),
    )


def combined(redacted: DataFrame) -> DataFrame:
    """With global scope a value has one token everywhere: its rows of one mapping are combined map-side."""
    rows = redacted.select("mapping_id", F.explode("entities").alias("e"))
    one = rows.groupBy("mapping_id", "e.placeholder").agg(F.min("e").alias("e"))
    return one.select("mapping_id", F.array("e").alias("entities"))


def mapping_rows(
    redacted: DataFrame,
    path: Column | str,
    profile: str = "default",
    created_at: str | None = None,
    options: Options = Options(),
) -> DataFrame:
    """Flat mapping rows (S6, T6) of a redact_column result. With document or leaf scope a leaf's
    entities are already distinct, so no shuffle; with global scope they are combined map-side."""
    stamp = F.expr(created_at or "current_timestamp()")
    where = F.lit(path) if isinstance(path, str) else path
    found = redacted if options.scope != "global" else combined(redacted)
    rows = (
        found.select("mapping_id", where.alias("path"), stamp.alias("created_at"), F.explode_outer("entities").alias("e"))
        .where(F.col("e").isNotNull())
        .select(
            "mapping_id", "path", "e.placeholder", "e.entity_type", "e.original", "e.score", "e.source",
            F.lit(profile).alias("profile"), "created_at", F.col("created_at").alias("last_access"),
        )
    )
    return rows.limit(0) if not options.keep_mappings else rows
