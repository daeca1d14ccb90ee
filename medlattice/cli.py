"""Command line: labelled clinical tasks out of a record archive."""

from __future__ import annotations

import argparse
import hashlib
from datetime import date

from pyspark.sql import functions as F

from .operators import tasks
from .session import build_session
from .sources import files, sinks


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("archive")
    p.add_argument("output", help="a new folder")
    p.add_argument("--work", required=True, help="a shared folder for the unpacked archive")
    p.add_argument("--bridge", required=True, help="CSV with concept_id and code")
    p.add_argument("--sha256", help="the digest the archive must have")
    p.add_argument("--cutoff", action="append", type=date.fromisoformat, required=True)
    p.add_argument("--horizon", action="append", type=int, default=None)
    p.add_argument("--source-end", default="auto")
    p.add_argument("--alias", action="append", default=[])
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(arguments)
    if a.sha256:
        with open(a.archive, "rb") as f:
            got = hashlib.file_digest(f, "sha256").hexdigest()
        if got != a.sha256.lower():
            raise SystemExit(f"the archive's digest is {got}")
    spark = build_session("clinical-tasks")
    tables = files.read_archive(spark, a.archive, a.work)
    day = lambda df: df.withColumns({c: F.to_date(F.substring(c, 1, 10)) for c in ("BIRTHDATE", "DEATHDATE", "START", "STOP", "DATE") if c in df.columns})
    tables = {n: day(df) for n, df in tables.items()}
    end = None if a.source_end == "auto" else date.fromisoformat(a.source_end)
    made = tasks.clinical_tasks(tables, files.strings(spark, a.bridge), a.alias, a.cutoff, a.horizon or [90, 365], end, a.seed)
    metadata = {k: v for k, v in made.metadata.items() if k != "risk_sets"}
    sinks.write_bundle({"documents": made.documents, "labels": made.labels, "events": made.events, "risk_sets": made.metadata["risk_sets"]}, a.output, metadata, {"documents": ["document_id"], "labels": ["document_id", "concept_id"], "events": ["event_id"]})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
