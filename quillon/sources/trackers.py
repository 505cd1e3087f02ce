"""Snapshots of a local tracker, handed over as files: list, context, version, export.

Readers never start a program and never write. A list is a JSON array or an
envelope with exactly one of ``issues``, ``items`` and ``data``; the export is
one JSON object a line. Both are read by many tasks: the export's lines split, and a
long list is cut between its records where its layout allows.
Anything of another shape fails, and errors name ids and fields only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.incremental import divergence, state_digest
from quillon.sources.json_lists import split_objects

# The shapes that are accepted, in the order in which names win.
ENVELOPES = ("issues", "items", "data")
ALIASES = {
    "description": ("description", "body"),
    "issue_type": ("issue_type", "type"),
    "acceptance_criteria": ("acceptance_criteria", "acceptanceCriteria", "acceptance"),
    "design": ("design", "design_notes"),
    "notes": ("notes", "current_notes"),
    "updated_at": ("updated_at", "updatedAt"),
    "dependencies": ("dependencies", "depends_on", "dependency_ids"),
    "parent": ("parent_id", "parent"),
}
TARGET_KEYS = ("depends_on_id", "dependency_id", "target_id", "id", "issue_id")
TYPE_KEYS = ("type", "dependency_type", "relationship_type")
PATH_KEYS = ("workspace_path", "beads_dir", "repo_root", "path")
IDENTITY_KEYS = ("project_id", "workspace_id", "repository_id", "repo_id")
VERSION_KEYS = ("version", "beads_version")
OLDEST = (1, 0, 5)
WHOLE_BYTES = 16 << 20  # lists up to that size are read by one task
STATE = ["status", "issue_type", "priority", "ephemeral", "links"]


class SourceError(ValueError):
    """A snapshot that cannot be read safely."""


@dataclass(frozen=True)
class Snapshot:
    """What is known of a source besides its records."""

    workspace_id: str
    workspace_path: str | None
    tracker: str
    version: str | None
    edge_types: tuple[tuple[str, int], ...] = ()
    records: int = 0
    exported: int | None = None
    live_digest: str | None = None
    export_digest: str | None = None
    divergence: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()


class Source(Protocol):
    """The one read-only boundary: a snapshot and its records."""

    def load(self) -> tuple[Snapshot, DataFrame]: ...


def _fail(text: str) -> Column:
    return F.raise_error(F.lit(text))


def _get(body: Column, *keys: str) -> Column:
    """The first of the keys that a JSON object has, as text; null for JSON null."""
    return F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in keys])


def _is_text(json: Column) -> Column:
    """Whether an array element that was parsed as text was no object or array."""
    return ~json.rlike(r"^\s*[\[{]")


def envelope(files: DataFrame) -> DataFrame:
    """``raw``: the records of whole files in ``value``, one JSON object a row."""
    body = F.col("value")
    parts = F.from_json(body, ", ".join(f"{k} string" for k in ENVELOPES))
    held = F.filter(F.array(*[parts[k] for k in ENVELOPES]), lambda p: p.isNotNull())
    one = F.when(F.size(held) == 1, F.element_at(held, 1)).otherwise(_fail("the list is no array and no envelope"))
    text = F.when(body.rlike(r"^\s*\["), body).when(body.rlike(r"^\s*\{"), one).otherwise(_fail("the list is no array and no envelope"))
    rows = F.from_json(text, "array<string>")
    return files.select(F.explode(F.coalesce(rows, _fail("the list is no array").cast("array<string>"))).alias("raw"))


def _labels(raw: Column) -> Column:
    names = F.transform(F.from_json(_get(raw, "labels"), "array<string>"), lambda x: F.trim(F.when(_is_text(x), x).otherwise(F.get_json_object(x, "$.name"))))
    good = F.forall(names, lambda n: F.coalesce(n != "", F.lit(False)))
    return F.when(names.isNull(), F.array().cast("array<string>")).when(good, F.array_sort(F.array_distinct(names))).otherwise(_fail("a label has no name").cast("array<string>"))


def _links(raw: Column, own: Column) -> Column:
    """(target, type) of a record's edges: texts are untyped, objects name their target."""
    items = F.from_json(_get(raw, *ALIASES["dependencies"]), "array<string>")
    pair = lambda x: F.struct(
        F.trim(F.when(_is_text(x), x).otherwise(_get(x, *TARGET_KEYS))).alias("target_id"),
        F.trim(F.when(_is_text(x), F.lit("depends-on")).otherwise(F.coalesce(_get(x, *TYPE_KEYS), F.lit("depends-on")))).alias("relationship_type"),
    )
    pairs = F.transform(items, pair)
    good = F.forall(pairs, lambda p: F.coalesce((p["target_id"] != "") & (p["relationship_type"] != "") & (p["target_id"] != own), F.lit(False)))
    kind = "array<struct<target_id:string,relationship_type:string>>"
    return F.when(pairs.isNull(), F.array().cast(kind)).when(good, F.array_sort(F.array_distinct(pairs))).otherwise(_fail("a dependency has no other record or no type").cast(kind))


def priority(value: Column) -> Column:
    """0 to 4 from a number or P0 to P4; null where there is none."""
    digits = F.regexp_extract(value, r"^[Pp]?\s*([+-]?\d+)\s*$", 1).try_cast("int")
    return F.when(F.coalesce(value, F.lit("")) == "", None).when(digits.between(0, 4), digits).otherwise(_fail("a priority is not 0 to 4").cast("int"))


def parse_records(raws: DataFrame) -> DataFrame:
    """Records with typed ``links`` of JSON objects in ``raw``; wrong ones fail."""
    raw = F.col("raw")
    need = lambda key: F.coalesce(F.nullif(F.trim(_get(raw, key)), F.lit("")), _fail(f"a record has no {key}"))
    text = lambda key: F.coalesce(_get(raw, *ALIASES[key]), F.lit(""))
    parent = _get(raw, *ALIASES["parent"])
    rows = raws.select("raw", need("id").alias("id"))
    parsed = rows.select(
        "id", need("title").alias("title"), text("description").alias("description"), need("status").alias("status"), F.trim(text("issue_type")).alias("issue_type"),
        priority(_get(raw, "priority")).alias("priority"), _labels(raw).alias("labels"),
        F.trim(F.when(_is_text(parent), parent).otherwise(_get(parent, "id", "issue_id"))).alias("parent_id"), _links(raw, F.col("id")).alias("links"),
        *[text(k).alias(k) for k in ("acceptance_criteria", "design", "notes", "updated_at")],
        F.coalesce(_get(raw, "ephemeral").try_cast("boolean"), F.lit(False)).alias("ephemeral"),
    )
    return parsed.withColumn("dependencies", F.array_sort(F.array_distinct(F.transform("links", lambda p: p["target_id"]))))


def require_unique(records: DataFrame) -> DataFrame:
    """The records, once it is known that no id occurs twice."""
    if records.groupBy("id").count().filter("count > 1").limit(1).count():
        raise SourceError("the list holds an id twice")
    return records


def edges(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("source_id"), F.explode("links").alias("p")).select("source_id", "p.target_id", "p.relationship_type")


def edge_types(records: DataFrame) -> tuple[tuple[str, int], ...]:
    """Types with their counts, in order: as many rows as there are types."""
    rows = edges(records).groupBy("relationship_type").count().orderBy("relationship_type").collect()
    return tuple((r["relationship_type"], r["count"]) for r in rows)


def format_types(counts: tuple[tuple[str, int], ...]) -> str:
    return ", ".join(f"{kind}={n}" for kind, n in counts) or "none"


VERSION = r"^v?(\d+)\.(\d+)\.(\d+)([-+].*)?$"


def compatible(version: Column) -> Column:
    """Whether a version is known and not older than the oldest supported one, nor a trial of it."""
    part = lambda k: F.regexp_extract(F.trim(version), VERSION, k)
    number = F.struct(*[part(k).try_cast("long") for k in (1, 2, 3)])
    oldest = F.struct(*[F.lit(n).cast("long") for n in OLDEST])
    return F.trim(version).rlike(VERSION) & ((number > oldest) | ((number == oldest) & ~part(4).startswith("-")))


def check_version(version: str) -> str:
    """As ``compatible``, of one version; what is not fails."""
    found = re.fullmatch(VERSION, version.strip())
    if not found:
        raise SourceError("the tracker's version is not known")
    number = tuple(int(found[k]) for k in (1, 2, 3))
    if number < OLDEST or (number == OLDEST and (found[4] or "").startswith("-")):
        raise SourceError(f"tracker {version} is older than {'.'.join(map(str, OLDEST))}")
    return version.strip()


def _export_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    sound = F.col("value").rlike(r"^\s*\{") & F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()
    return lines.select(F.col("value").alias("raw"), sound.alias("sound"))


def _marked(records: DataFrame) -> DataFrame:
    return records.withColumn("links", F.array_join(F.transform("links", lambda p: F.lower(F.concat_ws(":", p["target_id"], p["relationship_type"]))), ","))


class TrackerFiles:
    """A source of files: ``list``, and ``context``, ``version`` and ``export`` where there are any."""

    def __init__(self, spark: SparkSession, listing: str, context: str | None = None, version: str | None = None, export: str | None = None, whole_bytes: int = WHOLE_BYTES) -> None:
        self.spark, self.listing, self.context, self.version, self.export = spark, listing, context, version, export
        self.whole_bytes = whole_bytes

    def _whole(self, path: str) -> DataFrame:
        return self.spark.read.text(path, wholetext=True)

    def records(self) -> DataFrame:
        return require_unique(parse_records(self._raws()))

    def _raws(self) -> DataFrame:
        size = self.spark.read.format("binaryFile").load(self.listing).agg(F.sum("length")).first()[0]
        cut = split_objects(self.spark, self.listing, ENVELOPES) if (size or 0) > self.whole_bytes else None
        return envelope(self._whole(self.listing)) if cut is None else cut

    def _identity(self) -> tuple[str, str | None]:
        if self.context is None:
            raise SourceError("no context names the workspace")
        body = F.col("value")
        row = self._whole(self.context).select(_get(body, *PATH_KEYS).alias("path"), _get(body, *IDENTITY_KEYS).alias("own"), F.sha2(_get(body, *PATH_KEYS), 256).alias("hashed")).first()
        if row is None or not (row.own or row.path):
            raise SourceError("the context names no workspace")
        return row.own or row.hashed, row.path

    def _version(self) -> str | None:
        if self.version is None:
            return None
        row = self._whole(self.version).select(F.coalesce(_get(F.col("value"), *VERSION_KEYS), F.regexp_extract("value", r'^\s*"(.*)"\s*$', 1)).alias("v")).first()
        return check_version(row.v if row and row.v else "")

    def load(self) -> tuple[Snapshot, DataFrame]:
        """The snapshot and its records; an export that differs only warns."""
        own, path = self._identity()
        records = self.records()
        live = state_digest(_marked(records), STATE).first()
        found = {"records": int(live.records or 0), "live_digest": live.digest, "edge_types": edge_types(records)}
        if self.export is not None:
            found.update(self._against_export(records, found["records"], live.digest))
        return Snapshot(own, path, "local-tracker", self._version(), **found), records

    def _against_export(self, records: DataFrame, count: int, digest: str) -> dict:
        lines = _export_lines(self.spark, self.export)
        if lines.filter("NOT sound").limit(1).count():
            return {"warnings": ("an export was found but could not be read safely",)}
        exported = _marked(parse_records(lines.select("raw")))
        row = state_digest(exported, STATE).first()
        n = int(row.records or 0)
        out = {"exported": n, "export_digest": row.digest}
        if n == count and row.digest == digest:
            return out
        names = ["id", *STATE, "updated_at"]
        reasons = {r.reason for r in divergence(_marked(records), exported, names).collect()} | ({"record_count"} if n != count else set())
        told = f"the list holds {count} records, the export {n}; the list was used" if n != count else "list and export hold as many records in other states; the list was used"
        return {**out, "divergence": tuple(sorted(reasons)), "warnings": (told,)}
