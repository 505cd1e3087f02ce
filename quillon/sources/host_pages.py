"""An issue host's pages, handed over as JSON files in the order they were fetched.

Each file is one page of one connection: ``{<name>: {nodes, pageInfo}}``. Only
queries may be sent; ``refuse_writes`` is the guard for a transport.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.relations import relation_accounting
from quillon.sources.trackers import Snapshot, SourceError, edge_types, format_types, require_unique

# States, relations and the rules for records of another host.
STATES = {
    "completed": "closed",
    "canceled": "closed",
    "cancelled": "closed",
    "duplicate": "closed",
    "started": "in_progress",
    "backlog": "open",
    "unstarted": "open",
}
RELATIONS = {
    "blocks": "blocks",
    "duplicate": "duplicate-of",
    "related": "relates-to",
    "similar": "similar-to",
}
SYMMETRIC = ("relates-to", "similar-to")
BUGS, FEATURES = "bug|regression", "feature|enhancement"
URGENT, HIGH, LOW = r"\b(?:p0|critical|blocker)\b", r"\b(?:p1|high priority|priority: high)\b", r"\b(?:p3|low priority|priority: low)\b"
VERSION = "graphql-v1"
_PAGE = "struct<nodes:array<string>,pageInfo:struct<hasNextPage:boolean,endCursor:string>>"


def refuse_writes(query: str) -> str:
    if not query.lstrip().startswith("query "):
        raise SourceError("only queries may be sent")
    return query


def _mapped(value: Column, table: dict[str, str], what: str) -> Column:
    out = F.raise_error(F.lit(f"unknown {what}"))
    for key, mapped in reversed(table.items()):
        out = F.when(F.lower(F.trim(value)) == key, mapped).otherwise(out)
    return out


def nodes(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """``node``: the nodes of a connection's pages, after a check of their cursors.

    The check reads one row for each page; the nodes stay distributed.
    """
    pages = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.from_json("value", f"{name} {_PAGE}")[name].alias("p"))
    found = {r.path: r for r in pages.select("path", F.col("p.pageInfo").alias("info"), (F.col("p.nodes").isNull()).alias("bad")).collect()}
    cursor = None
    for k, path in enumerate(paths):
        row = found.get(re.sub("^file:/*", "/", path))
        if row is None or row.bad or row.info is None:
            raise SourceError(f"a page holds no {name} connection")
        if bool(row.info.hasNextPage) != (k < len(paths) - 1):
            raise SourceError(f"the pages of {name} end too early or too late")
        if row.info.hasNextPage and not row.info.endCursor:
            raise SourceError(f"a page of {name} has no end cursor")
        if row.info.hasNextPage and row.info.endCursor == cursor:
            raise SourceError(f"the cursor of {name} did not advance")
        cursor = row.info.endCursor
    return pages.select(F.explode("p.nodes").alias("node"))


def pick_team(teams: DataFrame, wanted: str) -> tuple[str, str]:
    """(id, key) of the one team whose id, key or name is ``wanted`` in any case."""
    get = lambda k: F.get_json_object("node", f"$.{k}")
    same = [F.lower(get(k)) == wanted.strip().lower() for k in ("id", "key", "name")]
    rows = teams.filter(F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False)) | F.coalesce(same[2], F.lit(False))).select(get("id").alias("id"), get("key").alias("key")).limit(2).collect()
    if len(rows) != 1:
        raise SourceError("no team of that name" if not rows else "several teams have that name")
    return rows[0].id, rows[0].key


def parse_issues(issues: DataFrame) -> DataFrame:
    """Records of issue nodes, without edges; ``cut`` marks those with more labels than the page."""
    get = lambda p: F.get_json_object("node", f"$.{p}")
    need = lambda p: F.coalesce(F.nullif(F.trim(get(p)), F.lit("")), F.raise_error(F.lit(f"an issue has no {p}")))
    number = get("priority").try_cast("double")
    names = F.transform(F.from_json(get("labels.nodes"), "array<struct<name:string>>"), lambda x: F.trim(x["name"]))
    none = F.lit("")
    return issues.select(
        need("identifier").alias("id"), need("title").alias("title"), F.coalesce(get("description"), none).alias("description"),
        _mapped(get("state.type"), STATES, "state").alias("status"), F.lit("issue").alias("issue_type"),
        F.when(number.isin(0, 1, 2, 3, 4), number.cast("int")).otherwise(F.raise_error(F.lit("a priority is not 0 to 4")).cast("int")).alias("priority"),
        F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))).alias("labels"), F.trim(get("parent.identifier")).alias("parent_id"),
        none.alias("acceptance_criteria"), none.alias("design"), none.alias("notes"), need("updatedAt").alias("updated_at"), F.lit(False).alias("ephemeral"),
        F.coalesce(get("labels.pageInfo.hasNextPage").try_cast("boolean"), F.lit(False)).alias("cut"),
    )


def parse_relations(relations: DataFrame) -> DataFrame:
    """``source_id, target_id, relationship_type`` of relation nodes; symmetric ones smaller id first."""
    get = lambda p: F.trim(F.get_json_object("node", f"$.{p}"))
    rows = relations.select(get("issue.identifier").alias("s"), get("relatedIssue.identifier").alias("t"), _mapped(get("type"), RELATIONS, "relation").alias("relationship_type"))
    wrong = F.coalesce(F.col("s") == F.col("t"), F.lit(True)) | (F.col("s") == "") | (F.col("t") == "")
    start = F.when(wrong, F.raise_error(F.lit("a relation has no two ends"))).otherwise(F.col("s"))
    turned = F.col("relationship_type").isin(*SYMMETRIC) & (F.col("t") < F.col("s"))
    return rows.select(F.when(turned, F.col("t")).otherwise(start).alias("source_id"), F.when(turned, F.col("s")).otherwise(F.col("t")).alias("target_id"), "relationship_type")


def one_relation_a_pair(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Inside relations: the strongest type of each pair, by the order of ``RELATIONS``."""
    rank = F.coalesce(*[F.when(F.col("relationship_type") == k, i) for i, k in enumerate(RELATIONS.values())])
    inside = relations
    for end in ("source_id", "target_id"):
        inside = inside.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    best = F.min(F.struct(rank.alias("k"), "source_id", "target_id", "relationship_type")).alias("b")
    return inside.groupBy(F.least("source_id", "target_id"), F.greatest("source_id", "target_id")).agg(best).select("b.source_id", "b.target_id", "b.relationship_type")


class HostPages:
    """A source of page files: issues of one team, relations of the whole workspace."""

    def __init__(self, spark: SparkSession, organization: str, team_id: str, issues: list[str], relations: list[str]) -> None:
        self.spark, self.organization, self.team_id, self.issues, self.relations = spark, organization, team_id, issues, relations

    def nodes(self, name: str) -> DataFrame:
        return nodes(self.spark, self.issues if name == "issues" else self.relations, name)

    def load(self) -> tuple[Snapshot, DataFrame]:
        import hashlib

        base = require_unique(parse_issues(self.nodes("issues")))
        rels = parse_relations(self.nodes("issueRelations"))
        kept = one_relation_a_pair(rels, base)
        kind = "array<struct<target_id:string,relationship_type:string>>"
        links = kept.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target_id", "relationship_type"))).alias("links"))
        records = base.join(links, "id", "left").withColumn("links", F.coalesce("links", F.array().cast(kind)))
        records = records.withColumn("dependencies", F.array_sort(F.array_distinct(F.transform("links", lambda p: p["target_id"]))))
        warnings = []
        if base.filter("cut").limit(1).count():
            warnings.append("labels of one or more records were cut")
        outside = rels.join(base.select(F.col("id").alias("source_id"), F.lit(1).alias("a")), "source_id", "left").join(base.select(F.col("id").alias("target_id"), F.lit(1).alias("b")), "target_id", "left")
        far = outside.filter("a IS NULL OR b IS NULL").groupBy("relationship_type").count().orderBy("relationship_type").collect()
        if far:
            warnings.append("relations that leave the team: " + format_types(tuple((r.relationship_type, r["count"]) for r in far)))
        identity = hashlib.sha256(f"{self.organization}:{self.team_id}".encode()).hexdigest()
        return Snapshot(identity, None, "issue-host", VERSION, edge_types(records), records.count(), warnings=tuple(warnings)), records.drop("cut")

    def accounting(self) -> DataFrame:
        base = parse_issues(self.nodes("issues"))
        return relation_accounting(parse_relations(self.nodes("issueRelations")), base.select("id"))


def label_rules(labels: Column) -> tuple[Column, Column]:
    """(type, priority) that labels state: a bug before a feature, the most urgent first."""
    said = F.lower(F.array_join(labels, " "))
    kind = F.when(said.rlike(BUGS), "bug").when(said.rlike(FEATURES), "feature").otherwise("task")
    return kind, F.when(said.rlike(URGENT), 0).when(said.rlike(HIGH), 1).when(said.rlike(LOW), 3).otherwise(2)


def label_records(issues: DataFrame, repository: str, body_limit: int) -> DataFrame:
    """Records of a code host's issues (number, title, body, state, labels, created, updated, url): type and priority come from labels."""
    if body_limit < 1:
        raise ValueError("body_limit must be positive")
    prefix = re.sub(r"[^a-z0-9]+", "-", repository.partition("/")[2].lower()).strip("-") or "host"
    kind, urgency = label_rules(F.col("labels"))
    return issues.select(
        F.concat(F.lit(f"{prefix}-gh-"), F.col("number").cast("string")).alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled issue")).alias("title"),
        F.substring(F.coalesce("body", F.lit("")), 1, body_limit).alias("description"), F.when(F.lower("state") == "closed", "closed").otherwise("open").alias("status"),
        urgency.alias("priority"), kind.alias("issue_type"), F.array_sort("labels").alias("labels"),
    )
