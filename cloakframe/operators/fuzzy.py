"""Fuzzy dictionary matching.

Up to fold_limit values the dictionary goes along with the texts, whose windows are tested in Arrow batches (`near`). Beyond, phrases and values meet on a shared piece: a value cut into one piece
more than the edits its threshold allows must keep one piece whole, so the equi-join on pieces
finds every match and never pairs whole groups. Either way cheap exact bounds run before the ratio.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import empty, keep, let, quote, struct, transform
from cloakframe.functions.similarity import indel_ratio, longest_partner, may_reach, shortest_partner
from cloakframe.functions.text import shifted, words
from cloakframe.operators.dictionary import dictionary_candidates, dictionary_hits_join, group_hits_join
from cloakframe.operators.near import near_phrases
from cloakframe.options import PRIORITY, Options
from cloakframe.schemas import CANDIDATES, FUZZY_VALUES
from cloakframe.sources.profiles import ResolvedProfile, literal_table
from cloakframe.sources.tables import broadcast_if_small, stage

DICTIONARY = "entity_type STRING, type_ord INT, value STRING, value_ord INT, threshold DOUBLE"
COLUMNS = ["entity_type", "type_ord", "value", "value_ord"]

# Under this threshold a value can be shorter than the number of edits allowed, and no piece is sure to stay.
LOWEST_PIECE_THRESHOLD = 67


def word_rows(leaves: DataFrame, keys: list[str], text: str, max_words: int) -> DataFrame:
    """(keys, i, w0.., l0..): every word with the words after it, as written and in lower case.

    The word arrays are zipped with themselves, shifted; all of it stays in generated code.
    """
    split = leaves.select(
        *keys, F.expr(words(text)).alias("_w"), F.expr(words(f"lower({text})")).alias("_l")
    )
    zipped = [f"{shifted(a, k)} AS {a}{k}" for a in ("_w", "_l") for k in range(max_words)]
    names = [f"{a}{k}" for a in ("_w", "_l") for k in range(max_words)]
    arrays = split.select(*keys, *[F.expr(z) for z in zipped])
    rows = arrays.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("i", "_z"))
    return rows.select(*keys, "i", *[F.col(f"_z.{n}").alias(n) for n in names])


def phrase_rows(
    leaves: DataFrame, keys: list[str], text: str, options: Options = Options(), lengths: tuple[int, int] | None = None
) -> DataFrame:
    """(keys, i, n, _p, words): windows of 1..max_phrase_words words, longer than min_entity_length.
    `_p` is the window in lower case; with `lengths` only windows of such a length. `written_phrase`
    gives the window as written."""
    n_words = options.max_phrase_words
    rows = word_rows(leaves, keys, text, n_words)
    cases = []
    for n in range(1, n_words + 1):
        size = " + ".join(f"length(_l{k})" for k in range(n)) + f" + {n - 1}"
        written = " + ".join(f"length(_w{k})" for k in range(n)) + f" + {n - 1}"
        test = f"{written} > {options.min_entity_length} AND _w{n - 1} IS NOT NULL"
        if lengths is not None:
            test += f" AND {size} BETWEEN {lengths[0]} AND {lengths[1]}"
        parts = ", ".join(f"_l{k}" for k in range(n))
        cases.append(f"{n}, CASE WHEN {test} THEN concat_ws(' ', {parts}) END")
    kept = [f"_w{k}" for k in range(n_words)]
    return rows.select(*keys, "i", *kept, F.expr(f"stack({n_words}, {', '.join(cases)}) AS (n, _p)")).where("_p IS NOT NULL")


def phrase_summaries(leaves: DataFrame, keys: list[str], text: str, options: Options = Options()) -> DataFrame:
    """(keys, n, n_phrases, n_chars, first_phrase, last_phrase): the windows of `phrase_rows` by their number of words, as
    written. The windows of a text are counted in its own row, so what is grouped are a few short rows a text."""

    def windows(n: int) -> str:
        whole = "_w"
        for k in range(1, n):  # the last ones, which have fewer words, end up null
            whole = f"zip_with({whole}, {shifted('_w', k)}, (a_, b_) -> a_ || ' ' || b_)"
        return keep(whole, lambda p: f"length({p}) > {options.min_entity_length}")

    def summary(n: int) -> str:
        return let(
            windows(n),
            lambda p: f"CASE WHEN size({p}) > 0 THEN "
            + struct(
                n=str(n), n_phrases=f"cast(size({p}) AS bigint)", n_chars=f"aggregate({p}, 0L, (a_, p_) -> a_ + length(p_))",
                first_phrase=f"array_min({p})", last_phrase=f"array_max({p})",
            )
            + " END",
        )

    every = f"array({', '.join(summary(n) for n in range(1, options.max_phrase_words + 1))})"
    split = leaves.select(*keys, F.expr(words(text)).alias("_w"))
    rows = split.select(*keys, F.explode_outer(F.expr(every)).alias("_s")).where(F.col("_s").isNotNull()).select(*keys, "_s.*")
    return rows.groupBy(*keys, "n").agg(
        F.sum("n_phrases").alias("n_phrases"), F.sum("n_chars").alias("n_chars"),
        F.min("first_phrase").alias("first_phrase"), F.max("last_phrase").alias("last_phrase"),
    )


def written_phrase(options: Options = Options()) -> str:
    """SQL over a row of phrase_rows: the window as it stands in the text."""
    cases = " ".join(
        f"WHEN {n} THEN concat_ws(' ', {', '.join(f'_w{k}' for k in range(n))})" for n in range(1, options.max_phrase_words + 1)
    )
    return f"CASE n {cases} END"


def dictionary_frame(leaves: DataFrame, profile: ResolvedProfile, options: Options = Options()) -> DataFrame:
    rows = [
        (v.entity_type, v.type_ord, v.value, v.value_ord, float(profile.fuzzy_threshold(v.entity_type)))
        for v in profile.dictionary
        if len(v.value) >= options.min_entity_length
    ]
    return literal_table(leaves.sparkSession, rows, DICTIONARY)


def _banded(dictionary: DataFrame) -> DataFrame:
    """One row per dictionary value and phrase length that can reach its threshold."""
    lo, hi = shortest_partner("length(_lowered)", "threshold"), longest_partner("length(_lowered)", "threshold")
    return dictionary.withColumn("_lowered", F.lower("value")).withColumn(
        "_length", F.explode(F.expr(f"sequence({lo}, {hi})"))
    )


def _range(banded: DataFrame) -> tuple[int, int]:
    lo, hi = banded.agg(F.min("_length"), F.max("_length")).first()
    return (0, 0) if lo is None else (lo, hi)


def _with_edits(rows: DataFrame) -> DataFrame:
    """The most insertions and deletions that still reach the threshold."""
    return rows.withColumn(
        "_edits", F.expr("cast(floor((100.0D - threshold) * (_value_length + _length) / 100.0D + 1e-9D) AS int)")
    )


def _piece_table(combos: DataFrame) -> DataFrame:
    """(threshold, _value_length, _length, _k, _from, _size): how values of a length are cut."""
    return _with_edits(combos).select(
        "threshold", "_value_length", "_length", "_edits",
        F.expr(
            "inline(transform(sequence(0, _edits), k -> named_struct('_k', k, "
            "'_from', k * (_value_length div (_edits + 1)) + least(k, _value_length % (_edits + 1)), "
            "'_size', _value_length div (_edits + 1) + if(k < _value_length % (_edits + 1), 1, 0))))"
        ),
    )


def piece_pairs(phrase: DataFrame, keys: list[str], banded: DataFrame, group: str | None = None) -> DataFrame:
    """Candidate pairs over a shared piece, with a `group` column of both sides within a group only. `phrase` has keys, i,
    n, phrase, _p, _length."""
    within = [group] if group else []
    values = banded.withColumn("_value_length", F.length("_lowered"))
    # Bounded by the lengths and thresholds that occur, not by the number of values.
    cuts = _piece_table(values.select("threshold", "_value_length", "_length").distinct())
    by = ["threshold", "_value_length", "_length"]
    pieces = values.join(cuts, by).withColumn("_piece", F.expr("substr(_lowered, cast(_from + 1 AS int), cast(_size AS int))"))
    shifts = cuts.withColumn(
        "_at",
        F.explode(
            F.expr(
                "sequence(greatest(_from - (_edits + _value_length - _length) div 2, 0), "
                "greatest(least(_from + (_edits + _length - _value_length) div 2, _length - _size), "
                "greatest(_from - (_edits + _value_length - _length) div 2, 0)))"
            )
        ),
    ).select(*by, "_k", "_at", "_size")
    probes = phrase.join(shifts, "_length").withColumn(
        "_piece", F.expr("substr(_p, cast(_at + 1 AS int), cast(_size AS int))")
    )
    met = probes.join(pieces.select(*within, *by, "_k", "_piece", "_lowered", *COLUMNS), [*within, *by, "_k", "_piece"])
    return met.select(*keys, "i", "n", "phrase", "_p", "_lowered", "threshold", *COLUMNS).distinct()


def _joined_hits(leaves: DataFrame, keys: list[str], text: str, known: DataFrame, options: Options, group: str | None) -> DataFrame:
    """(keys, COLUMNS, _hit): phrases over the threshold of a dictionary that is joined."""
    banded = _banded(known)
    lowered = phrase_rows(leaves, keys, text, options, _range(banded)).withColumn("_length", F.length("_p"))
    phrase = lowered.withColumn("phrase", F.expr(written_phrase(options))).select(*keys, "i", "n", "phrase", "_p", "_length")
    by_piece = banded.where(F.col("threshold") >= LOWEST_PIECE_THRESHOLD)
    by_length = banded.where(F.col("threshold") < LOWEST_PIECE_THRESHOLD)
    pairs = piece_pairs(phrase, keys, by_piece, group)
    pairs = pairs.unionByName(phrase.join(by_length, [group, "_length"] if group else "_length").select(pairs.columns))
    near = (
        pairs.where(F.expr(may_reach("_p", "_lowered", "threshold")))
        .withColumn("score", F.expr(indel_ratio("_p", "_lowered")))
        .where(F.col("score") >= F.col("threshold"))
    )
    return near.select(*keys, *COLUMNS, F.struct("i", "n", "phrase", "score").alias("_hit"))


def fuzzy_hits(
    leaves: DataFrame, keys: list[str], text: str, profile: ResolvedProfile | None = None,
    options: Options = Options(), dictionary: DataFrame | None = None, group: str | None = None,
) -> DataFrame:
    """(keys, entity_type, type_ord, value, value_ord, phrase, score): per value the exact hit
    (score 100) or the first phrase over the threshold in (start, words) order (Z3).

    The values come from `profile`, or from a `dictionary` table with the DICTIONARY columns. With `group`, a column of the
    table and one of `keys`, texts meet the values of their own group only.
    """
    if profile is not None and dictionary is None and not profile.fuzzy_enabled:
        profile = replace(profile, dictionary=())
    values = [v for v in profile.dictionary if len(v.value) >= options.min_entity_length] if profile else []
    small = dictionary is None and len(values) <= options.fold_limit
    if small:
        literal = fuzzy_literal(profile, options) if profile else f"cast(array() AS {FUZZY_VALUES})"
        # both kinds of hits in one reading of the texts
        found = leaves.select(
            *keys, F.expr(literal).alias("_values"), near_column(f"`{text}`", literal, options).alias("_near"),
            F.expr(dictionary_candidates(f"`{text}`", values)).alias("_exact"),
        )
        near = transform(
            "_near",
            lambda h: struct(
                **{c: f"_values[{h}.v].{c}" for c in COLUMNS},
                _hit=struct(i=f"{h}.i", n=f"{h}.n", phrase=f"{h}.phrase", score=f"{h}.score"),
            ),
        )
        whole = transform(
            "_exact",
            lambda v: struct(
                **{c: f"{v}.{c}" for c in COLUMNS}, _hit=struct(i="-1", n="0", phrase=f"{v}.value", score="100.0D")
            ),
        )
        every = F.explode_outer(F.expr(f"concat({whole}, {near})")).alias("_h")
        hits = found.select(*keys, every).where(F.col("_h").isNotNull()).select(*keys, "_h.*")
    else:
        known = dictionary_frame(leaves, profile, options) if dictionary is None else dictionary.where(
            F.length("value") >= options.min_entity_length
        )
        fuzzy = _joined_hits(leaves, keys, text, known, options, group)
        if group:
            exact = group_hits_join(leaves, keys, text, known.drop("threshold"), group)
        else:
            exact = dictionary_hits_join(leaves, keys, text, known.drop("threshold"))
        whole = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("n"), F.col("value").alias("phrase"), F.lit(100.0).alias("score"))
        hits = exact.select(*keys, *COLUMNS, whole.alias("_hit")).unionByName(fuzzy)
    return (
        hits.groupBy(*keys, *COLUMNS)
        .agg(F.min("_hit").alias("_hit"))
        .select(*keys, *COLUMNS, F.col("_hit.phrase").alias("phrase"), F.col("_hit.score").alias("score"))
    )


def near_column(text: str, dictionary: str, options: Options = Options()) -> Column:
    """`near_phrases` of a text and an array of dictionary values (`fuzzy_literal`); without values the text stays."""
    part = lambda field: F.expr(transform(dictionary, lambda v: f"{v}.{field}"))
    asked = F.expr(f"CASE WHEN size({dictionary}) > 0 THEN make_valid_utf8({text}) END")
    return near_phrases(asked, part("lowered"), part("threshold"), options.max_phrase_words, options.min_entity_length)


def near_candidates(text: str, near: str, dictionary: str) -> str:
    """SQL: candidates of a `near_column`, as `folded_fuzzy` gives them."""

    def candidate(h: str) -> str:
        v, trimmed = f"{dictionary}[{h}.v]", f"regexp_replace({h}.phrase, {quote(PUNCTUATION)}, '')"
        return struct(
            priority=str(PRIORITY["fuzzy"]), type_ord=f"{v}.type_ord", value_ord=f"{v}.value_ord", neg_score=f"-{h}.score / 100.0D",
            entity_type=f"{v}.entity_type", value=let(trimmed, lambda t: f"if({t} = '', {h}.phrase, {t})"), source="'fuzzy'",
        )

    new = keep(near, lambda h: f"NOT contains({text}, {dictionary}[{h}.v].value)")
    return f"coalesce(cast({transform(new, candidate)} AS {CANDIDATES}), {empty(CANDIDATES)})"


def folded_fuzzy(text: str, dictionary: str, bounds: tuple[int, int], options: Options = Options()) -> str:
    """SQL: fuzzy candidates of a text from an array of dictionary values (`fuzzy_literal`), without a join.

    Same rows as `fuzzy_hits`: per value that is not in the text as it stands, the first phrase over the threshold.
    """
    lo, hi = bounds

    def phrases(split: str) -> str:
        def of_start(i: str) -> str:
            def of_length(n: str) -> str:
                part = lambda a: f"array_join(slice({split}.{a}, {i} + 1, {n}), ' ')"
                return struct(i=i, n=n, p=part("l"), w=part("w"))

            return transform(f"sequence(1, least({options.max_phrase_words}, size({split}.w) - {i}))", of_length)

        starts = f"if(size({split}.w) > 0, sequence(0, size({split}.w) - 1), cast(array() AS array<int>))"
        every = f"flatten({transform(starts, of_start)})"
        return keep(every, lambda w: f"length({w}.w) > {options.min_entity_length} AND length({w}.p) BETWEEN {lo} AND {hi}")

    def hits(windows: str) -> str:
        def near(v: str) -> str:
            band = lambda w: f"length({w}.p) BETWEEN {v}.lo AND {v}.hi AND {may_reach(f'{w}.p', f'{v}.lowered', f'{v}.threshold')}"
            scored = lambda w: struct(i=f"{w}.i", n=f"{w}.n", w=f"{w}.w", score=indel_ratio(f"{w}.p", f"{v}.lowered"))
            over = keep(transform(keep(windows, band), scored), lambda h: f"{h}.score >= {v}.threshold")
            trimmed = lambda h: f"regexp_replace({h}.w, {quote(PUNCTUATION)}, '')"

            def candidate(h: str) -> str:
                return struct(
                    priority=str(PRIORITY["fuzzy"]), type_ord=f"{v}.type_ord", value_ord=f"{v}.value_ord", neg_score=f"-{h}.score / 100.0D",
                    entity_type=f"{v}.entity_type", value=let(trimmed(h), lambda t: f"if({t} = '', {h}.w, {t})"), source="'fuzzy'",
                )

            return let(over, lambda o: transform(f"slice({o}, 1, 1)", candidate))

        found = keep(dictionary, lambda v: f"NOT contains({text}, {v}.value)")
        return f"cast(flatten({transform(found, near)}) AS {CANDIDATES})"

    return let(struct(w=words(text), l=words(f"lower({text})")), lambda split: let(phrases(split), hits))


PUNCTUATION = r"^[\p{Punct}]+|[\p{Punct}]+$"


def fuzzy_literal(profile: ResolvedProfile, options: Options = Options()) -> str:
    """The profile's fuzzy dictionary as an array literal; empty where fuzzy matching is off."""
    rows = []
    for v in profile.dictionary if profile.fuzzy_enabled else ():
        if len(v.value) >= options.min_entity_length:
            threshold, lowered = f"{float(profile.fuzzy_threshold(v.entity_type))}D", f"lower({quote(v.value)})"
            rows.append(
                struct(
                    entity_type=quote(v.entity_type), type_ord=str(v.type_ord), value=quote(v.value), value_ord=str(v.value_ord),
                    lowered=lowered, threshold=threshold,
                    lo=shortest_partner(f"length({lowered})", threshold), hi=longest_partner(f"length({lowered})", threshold),
                )
            )
    return f"cast(array({', '.join(rows)}) AS {FUZZY_VALUES})"


def fuzzy_bounds(profile: ResolvedProfile, options: Options = Options()) -> tuple[int, int]:
    """Lengths a phrase must have to be near any value, or a wider range."""
    known = [(len(v.value), float(profile.fuzzy_threshold(v.entity_type))) for v in profile.dictionary if len(v.value) >= options.min_entity_length]
    if not profile.fuzzy_enabled or not known:
        return 1, 0
    # lower-casing may change a value's length by a character or two
    return min(int(t * (n - 2) / (200 - t)) for n, t in known), max(int((200 - t) * (n + 2) / max(t, 1e-9)) + 1 for n, t in known)


def fuzzy_candidates(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidates): hits as extra candidates for redact_column. The phrase found is redacted,
    without the punctuation around it, so restoring gives back what was written (Z4, Q8)."""
    trimmed = F.regexp_replace("phrase", PUNCTUATION, "")
    one = F.struct(
        F.lit(PRIORITY["fuzzy"]).alias("priority"),
        F.col("type_ord"),
        F.col("value_ord"),
        (-F.col("score") / 100.0).alias("neg_score"),
        F.col("entity_type"),
        F.when(trimmed == "", F.col("phrase")).otherwise(trimmed).alias("value"),
        F.lit("fuzzy").alias("source"),
    )
    return hits.where("score < 100 OR phrase <> value").groupBy(*keys).agg(F.collect_list(one).alias("candidates"))


def with_fuzzy_candidates(df: DataFrame, keys: list[str], hits: DataFrame) -> DataFrame:
    """`df` with the `fuzzy_candidates` of its keys. They are few beside the texts: they are written once and measured, and
    texts are shuffled only where the candidates are too large to broadcast."""
    found = stage(fuzzy_candidates(hits, keys), "candidates")
    # their size stands in for the text that `broadcast_if_small` measures
    known = broadcast_if_small(found.withColumn("_all", F.to_json("candidates")), "_all")
    return df.join(known.drop("_all"), keys, "left")
