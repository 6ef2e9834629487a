"""Pattern detectors (E1-E7, E10-E12) and the detector registry.

A detector is a regex both Java and RE2 read alike (ASCII classes, no lookaround, no anchors), checks on
the characters next to a match, an optional validator and a base score. A detector's result
for a text is an array of spans, so any number of detectors share one scan and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.checks import iban_valid, ipv6_valid, iso_date_valid, luhn_valid, octets_valid
from cloakframe.functions.sqltext import empty, keep, let, quote, struct, transform
from cloakframe.functions.text import match_starts
from cloakframe.options import PRIORITY, check_type_name
from cloakframe.schemas import SPANS

# Matches are located by their own text, so a pattern must not depend on what stands around it.
ANCHORS = re.compile(r"(?<![\\\[])\^|\\[bBAzZG]|(?<!\\)\$(?![^\[]*\])|\(\?<?[=!]")
CONTEXT_WIDTH = 40
CONTEXT_BOOST = 0.35


@dataclass(frozen=True)
class Detector:
    name: str
    entity_type: str
    pattern: str
    score: float
    lang: str = "*"
    gate: str | None = None  # cheap regex that must occur at all
    any_of: tuple[str, ...] = ()  # plain texts of which one must occur; tested before the gate
    digits: bool = False  # a match holds a digit: tested once for all such detectors
    left_not: str | None = None  # class the character before the match must not be in
    right_not: str | None = None  # regex the one or two characters after it must not match
    lead: bool = False  # pattern is (lead)(value): only group 2 is the span
    validator: Callable[[str], str] | None = None
    failed_score: float | None = None  # score when the validator says no; None drops the match
    context: tuple[str, ...] = ()
    java: str | None = None  # the same matches for Java, found faster; may look around

    def __post_init__(self) -> None:
        check_type_name(self.entity_type)
        if ANCHORS.search(self.pattern):
            raise ValueError(f"detector {self.name}: use left_not and right_not, not anchors or lookaround")

    @property
    def best_score(self) -> float:
        return min(self.score + CONTEXT_BOOST, 1.0) if self.context else self.score

    def _matches(self, text: str) -> str:
        """ARRAY<STRUCT<start, value, ...>> of raw pattern matches, with the characters the guards look at."""
        run = self.java or self.pattern
        pattern = quote(run)
        parts = {"m": f"regexp_extract_all({text}, {pattern}, 0)"}
        if self.lead:
            parts["v"] = f"regexp_extract_all({text}, {pattern}, 2)"

        def located(p: str) -> str:
            def one(start: str, i: str) -> str:
                whole = f"get({p}.m, {i})"
                value = f"get({p}.v, {i})" if self.lead else whole
                shift = f" + length({whole}) - length({value})" if self.lead else ""
                fields = {"start": f"{start}{shift}", "value": value}
                if self.left_not:
                    fields["before"] = f"substr({text}, {start}, if({start} > 0, 1, 0))"
                if self.right_not:
                    fields["after"] = f"substr({text}, {start} + length({whole}) + 1, 2)"
                return struct(**fields)

            return transform(match_starts(text, run, f"{p}.m"), one, 2)

        return let(struct(**parts), located)

    def spans(self, text: str, lang: str | None = None, threshold: float | None = None) -> str:
        """SQL for the ARRAY<span> of `text`; empty when the gate or the language rules it out."""
        guards = []
        if self.left_not:
            guards.append(lambda m: f"NOT rlike({m}.before, {quote(self.left_not)})")
        if self.right_not:
            guards.append(lambda m: f"NOT rlike({m}.after, {quote(f'^(?:{self.right_not})')})")
        if self.validator is not None and self.failed_score is None:
            guards.append(lambda m: self.validator(f"{m}.value"))
        found = self._matches(text)
        if guards:
            found = keep(found, lambda m: " AND ".join(g(m) for g in guards))

        def scored(m: str) -> str:
            score = f"{self.score}D"
            if self.validator is not None and self.failed_score is not None:
                score = f"CASE WHEN {self.validator(f'{m}.value')} THEN {score} ELSE {self.failed_score}D END"
            if self.context:
                score = boosted(score, text, f"{m}.start", self.context)
            return struct(
                entity_type=quote(self.entity_type),
                start=f"{m}.start",
                end=f"{m}.start + length({m}.value)",
                value=f"{m}.value",
                score=score,
                source="'pattern'",
                priority=str(PRIORITY["pattern"]),
                type_ord="0",
                value_ord="0",
            )

        spans = transform(found, scored)
        if threshold is not None:
            spans = keep(spans, lambda s: f"{s}.score >= {threshold}D")
        conditions = []
        if lang is not None and self.lang != "*":
            conditions.append(f"{lang} = {quote(self.lang)}")
        if self.any_of:
            conditions.append("(" + " OR ".join(f"contains({text}, {quote(t)})" for t in self.any_of) + ")")
        if self.gate is not None:
            conditions.append(f"rlike({text}, {quote(self.gate)})")
        condition = " AND ".join(conditions) or f"{text} IS NOT NULL"
        return f"CASE WHEN {condition} THEN {spans} ELSE {empty(SPANS)} END"


def boosted(score: str, text: str, start: str, context: Iterable[str]) -> str:
    """Raise the score when a context word stands in the window before the span."""
    window = f"lower(substr({text}, greatest({start} - {CONTEXT_WIDTH}, 0) + 1, least({start}, {CONTEXT_WIDTH})))"
    seen = quote(f"(?:^|[^a-z])(?:{'|'.join(context)})(?:[^a-z]|$)")
    return f"CASE WHEN rlike({window}, {seen}) THEN least({score} + {CONTEXT_BOOST}D, 1.0D) ELSE {score} END"


# Patterns, scores and context words of the built-in detectors.
_ALNUM = "[0-9A-Za-z]"
_LOCAL = "[A-Za-z0-9._%+-]"
# Endings in wide use, beside those of two letters, which are countries'; any other one counts too, for less.
WIDE_ENDINGS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|aero|coop|museum|travel|jobs|asia|app|dev|cloud|online|site|shop|"
    "store|tech|blog|news|live|email|xyz|club|space|world|agency|health|bank|[a-z][a-z]"
)
# A name's part: a capital, a lower-case letter (or an apostrophe and a capital), then letters of any script and case.
_NAME = r"\p{Lu}(?:\p{Ll}|['’]\p{Lu})(?:[\p{L}\p{M}]|['’-]\p{L})*"


def ending_known(value: str) -> str:
    """SQL: whether a domain ends as most do."""
    return f"rlike({value}, {quote(rf'\.(?:{WIDE_ENDINGS})$')})"


BUILT_IN: tuple[Detector, ...] = (
    Detector(
        "email", "EMAIL_ADDRESS",
        rf"{_LOCAL}+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}",
        1.0, any_of=("@",),
        # a run of such characters is tried from its start only, or from where the last match ended
        java=rf"(?:(?<!{_LOCAL})|\G){_LOCAL}+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}",
    ),
    Detector(
        "phone", "PHONE_NUMBER",
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
        0.75, digits=True, gate=r"[0-9]{3}[ .-][0-9]{4}", left_not="[0-9A-Za-z.-]", right_not=_ALNUM,
        context=("phone", "telephone", "tel", "cell", "mobile", "call", "fax"),
    ),
    Detector(
        "phone_local", "PHONE_NUMBER",
        r"[0-9]{3}-[0-9]{4}",
        0.4, digits=True, gate=r"[0-9]{3}-[0-9]{4}", left_not="[0-9A-Za-z.-]", right_not="[0-9A-Za-z-]",
        context=("phone", "telephone", "tel", "cell", "mobile", "call", "fax"),
    ),
    Detector(
        "ip", "IP_ADDRESS",
        r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
        0.8, digits=True, gate=r"[0-9]\.[0-9]", left_not="[0-9A-Za-z.]", right_not=r"[0-9A-Za-z]|\.[0-9]",
        validator=octets_valid, context=("ip", "ipv4", "host", "server"),
    ),
    Detector(
        "ip6", "IP_ADDRESS",
        r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}",
        0.8, any_of=(":",), gate=r"[0-9A-Fa-f:]:[0-9A-Fa-f:]", left_not="[0-9A-Za-z:]", right_not="[0-9A-Za-z:]",
        validator=ipv6_valid, context=("ip", "ipv6", "host", "server"),
    ),
    Detector(
        "url", "URL",
        r"(?:https?|ftp)://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]*[A-Za-z0-9/_~=&#%+-]",
        0.85, any_of=("://",), left_not=_ALNUM,
    ),
    Detector(
        "domain", "DOMAIN_NAME",
        r"[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[a-z]{2,63}",
        0.85, gate=r"\.[a-z]{2}", validator=ending_known, failed_score=0.8, left_not="[0-9A-Za-z_.-]", right_not=r"[0-9A-Za-z_-]|\.[0-9A-Za-z]",
    ),
    Detector(
        "date", "DATE_TIME",
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?",
        0.85, digits=True, gate=r"[0-9]{4}-[0-9]{2}-[0-9]{2}", left_not="[0-9A-Za-z-]", right_not="[0-9A-Za-z-]",
        validator=iso_date_valid, context=("date", "birthday", "born", "dob", "ordered", "due"),
    ),
    Detector(
        "card", "CREDIT_CARD", r"[0-9]{13,19}",
        1.0, digits=True, gate=r"[0-9]{13}", left_not=_ALNUM, right_not=_ALNUM,
        validator=luhn_valid, failed_score=0.3,
    ),
    Detector(
        "card_grouped", "CREDIT_CARD", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
        1.0, digits=True, gate=r"[0-9]{4}[ -][0-9]{4}[ -]", left_not=_ALNUM, right_not=_ALNUM,
        validator=luhn_valid, failed_score=0.3,
    ),
    Detector(
        "iban", "IBAN_CODE", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
        1.0, digits=True, gate=r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", left_not=_ALNUM, right_not=_ALNUM, validator=iban_valid,
    ),
    Detector(
        "ssn", "US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        0.5, digits=True, gate=r"[0-9]{3}-[0-9]{2}-[0-9]{4}", left_not="[0-9A-Za-z-]", right_not="[0-9A-Za-z-]",
        context=("ssn", "social", "security"),
    ),
    Detector(
        "person_intro_en", "PERSON",
        rf"((?:[Mm]y name is|I'm|I am|[Hh]ello|[Hh]i|[Dd]ear|Mr\.|Mrs\.|Ms\.|Dr\.) )({_NAME}(?: {_NAME}){{0,3}})",
        0.85, lang="en", lead=True, left_not=_ALNUM,
        any_of=("y name is ", "I'm ", "I am ", "ello ", "Hi ", "hi ", "ear ", "Mr. ", "Mrs. ", "Ms. ", "Dr. "),
    ),
    Detector(
        "person_intro_de", "PERSON",
        rf"((?:[Mm]ein Name ist|[Ii]ch bin|[Hh]allo|Herr|Frau) )({_NAME}(?: {_NAME}){{0,3}})",
        0.85, lang="de", lead=True, left_not=_ALNUM,
        any_of=("ein Name ist ", "ch bin ", "allo ", "Herr ", "Frau "),
    ),
)


class DetectorRegistry:
    """The detectors a job uses: the built-in ones plus any a caller adds."""

    def __init__(self, detectors: Iterable[Detector] = BUILT_IN) -> None:
        self._detectors: dict[str, Detector] = {d.name: d for d in detectors}

    def add(self, detector: Detector) -> DetectorRegistry:
        self._detectors[detector.name] = detector
        return self

    def add_rules(self, rules: DataFrame) -> DetectorRegistry:
        """Regex rules given as rows (name, entity_type, pattern, score, lang). Each becomes a part of the plan, as if
        it were written in the job."""
        for row in rules.select("name", "entity_type", "pattern", "score", "lang").collect():
            self.add(Detector(row["name"], row["entity_type"], row["pattern"], row["score"], row["lang"] or "*"))
        return self

    def get(self, name: str) -> Detector:
        return self._detectors[name]

    def select(self, *names: str) -> list[Detector]:
        return [self._detectors[n] for n in names]

    def all(self, lang: str | None = None) -> list[Detector]:
        """All detectors, or those that apply to one fixed language."""
        return [d for d in self._detectors.values() if lang is None or d.lang in ("*", lang)]


def threshold_for(entity_type: str, thresholds: dict[str, float]) -> float:
    return thresholds.get(entity_type, thresholds["DEFAULT"])


def detect(
    text: str,
    detectors: Iterable[Detector],
    thresholds: dict[str, float] | None = None,
    lang: str | None = None,
    disabled_types: Iterable[str] = (),
) -> str:
    """SQL for the ARRAY<span> of all detectors (E10). With thresholds, only spans that reach their
    type's (P7); a detector that can never reach its threshold is left out of the plan."""
    disabled = set(disabled_types)
    parts: list[str] = []
    with_digits: list[str] = []
    for d in detectors:
        if d.entity_type in disabled:
            continue
        cut = None if thresholds is None else threshold_for(d.entity_type, thresholds)
        if cut is not None and d.best_score < cut:
            continue
        (with_digits if d.digits else parts).append(d.spans(text, lang, cut))
    if with_digits:
        parts.append(f"CASE WHEN rlike({text}, '[0-9]') THEN concat({', '.join(with_digits)}) ELSE {empty(SPANS)} END")
    return f"concat({', '.join(parts)})" if parts else empty(SPANS)


def rescore(detector: Detector, context: Iterable[str], score: float | None = None) -> Detector:
    """The same detector with other context words or another base score."""
    return replace(detector, context=tuple(context), score=detector.score if score is None else score)


def span_rows(df: DataFrame, keys: list[str], spans: str) -> DataFrame:
    """One row per span. explode_outer keeps Spark from pushing a copy of the detection below it."""
    return (
        df.select(*keys, F.expr(spans).alias("_spans"))
        .select(*keys, F.explode_outer("_spans").alias("_s"))
        .where(F.col("_s").isNotNull())
        .select(*keys, "_s.*")
    )
