"""Writing the two products of a redaction: mappings first, then the text that needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cloakframe.operators.store import append_mappings
from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows
from cloakframe.plans.payloads import payload_mapping_rows
from cloakframe.sources.runs import is_committed, write_run


def write_redacted_column(
    redacted: DataFrame, text: str, out: str, mappings_out: str, options: Options = Options(), profile: str = "default",
    run: str | None = None,
) -> None:
    """Append the mappings and the rows of a redact_column result, without the text and its originals. With the name of a
    `run` both are tables of `sources.runs`: a job that is repeated under its name adds nothing."""
    _write(redacted, redacted.drop(text, "entities"), mapping_rows(redacted, text, profile, options=options), out, mappings_out, options, run)


def write_redacted_payload(
    redacted: DataFrame, out: str, mappings_out: str, options: Options = Options(), profile: str = "default", run: str | None = None
) -> None:
    """Append the mappings and the documents of a redact_payload result, without the originals; `run` as above."""
    rows = payload_mapping_rows(redacted, profile, options=options)
    _write(redacted, redacted.drop("entities"), rows, out, mappings_out, options, run)


def _write(
    source: DataFrame, shown: DataFrame, mappings: DataFrame, out: str, mappings_out: str, options: Options, run: str | None
) -> None:
    if run is not None and is_committed(source.sparkSession, out, run):
        return
    source.persist()
    try:
        if options.keep_mappings:
            append_mappings(mappings, mappings_out) if run is None else write_run(mappings, mappings_out, run)
        shown.write.mode("append").parquet(out) if run is None else write_run(shown, out, run)
    finally:
        source.unpersist()
