"""Writers: reports for people and checkpoints for the next run.

Reports are bounded by the review queue and are written by the driver, each in
one step. Checkpoints grow with the records and are Spark tables.
"""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.incremental import parse_rfc3339

CHECKPOINT_VERSION = 1
REPORT_FORMATS = {".json": "json", ".md": "markdown"}
DIVERGED_EXIT = 3


def write_text(path: str | Path, text: str) -> Path:
    """Write a private file whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(name, 0o600)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def to_json(payload: dict) -> str:
    return json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def output_paths(output: str | None, folder: str | None, state: str, run: str) -> tuple[Path | None, Path | None, str | None]:
    """(folder, file, format): a .json or .md name is one file, any other a folder."""
    if folder is not None:
        return Path(folder), None, None
    if output is None:
        return Path(state) / run, None, None
    form = REPORT_FORMATS.get(Path(output).suffix.lower())
    return (None, Path(output), form) if form else (Path(output), None, None)


def outside(path: str | Path, repository: str | Path | None) -> Path:
    """The path, which must not lie in the repository under review."""
    full = Path(path).resolve()
    if repository is not None and full.is_relative_to(Path(repository).resolve()):
        raise ValueError("a checkpoint must lie outside the repository")
    return full


def exit_code(diverged: bool, refuse: bool) -> int:
    """3 where a divergence is to stop the caller; the report has been written by then."""
    return DIVERGED_EXIT if diverged and refuse else 0


def write_checkpoint(state: DataFrame, path: str, workspace: str, created_at: str) -> None:
    """State rows (id, updated_at, fingerprint) with the facts that a reader checks."""
    facts = {"checkpoint_version": F.lit(CHECKPOINT_VERSION), "workspace_id": F.lit(workspace), "created_at": F.lit(created_at)}
    state.select("id", "updated_at", "fingerprint").withColumns(facts).write.mode("errorifexists").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, workspace: str, now: str) -> DataFrame:
    """A checkpoint's state rows; fails for another version or workspace, a later time or a bad entry.

    One aggregation over the table finds the first kind of fault, if any.
    """
    rows = spark.read.parquet(path)
    born, seen = parse_rfc3339(F.col("created_at")), parse_rfc3339(F.col("updated_at"))
    fault = (
        F.when(~F.col("checkpoint_version").eqNullSafe(F.lit(CHECKPOINT_VERSION)), "its version is not supported")
        .when(~F.col("workspace_id").eqNullSafe(F.lit(workspace)), "it belongs to another workspace")
        .when(born.isNull() | (born > parse_rfc3339(F.lit(now))), "its time is missing or lies ahead")
        .when(F.col("id").isNull() | ((F.coalesce("updated_at", F.lit("")) != "") & seen.isNull()), "an entry has no id or a wrong time")
        .when(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "an entry has a wrong fingerprint")
    )
    found = rows.agg(F.min(fault).alias("fault")).first().fault
    if found:
        raise ValueError(f"checkpoint refused: {found}")
    return rows.select("id", "updated_at", "fingerprint")


def report_folder(folder: str | Path, name: str, payload: dict, markdown: str, batches: list[tuple[dict, str]] = ()) -> list[Path]:
    """``<name>.json``, ``<name>.md`` and, numbered from 1, ``batch-N`` in both forms."""
    out = []
    for stem, body, text in [(name, payload, markdown), *[(f"batch-{k}", b, t) for k, (b, t) in enumerate(batches, 1)]]:
        out += [write_text(Path(folder) / f"{stem}.json", to_json(body)), write_text(Path(folder) / f"{stem}.md", text)]
    return out
