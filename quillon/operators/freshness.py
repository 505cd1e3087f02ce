"""Freshness of candidate pairs: what the graph, the titles and the lifecycle say."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import plain_title
from quillon.model import ACTIVE_STATUSES
from quillon.plans.staging import stage
from quillon.sources.records import is_closed

# Relations that explain a pair, and the order of evidence codes.
EXPLANATORY = ("parent-child", "blocks", "depends-on", "discovered-from")
EVIDENCE_ORDER = (
    "direct-parent-child", "direct-blocks", "direct-depends-on", "direct-discovered-from", "active-incoming-consumer",
    "explicit-issue-id-reference", "bounded-relationship-cue", "relationship-scope-complete", "relationship-scope-incomplete",
    "relationship-scope-degraded", "no-direct-explanatory-relationship", "exact-normalized-title", "lifecycle-active-active",
    "lifecycle-active-closed", "lifecycle-unknown", "candidate-possible-overlap", "candidate-completed-work-echo",
    "reciprocal-local-evidence", "semantic-threshold-admission", "semantic-candidate-only", "no-actionable-evidence",
)
ACTION_ORDER = ("duplicate", "superseded-open", "missing-relation", "uncertain", "intentional-follow-up")
#: Wording around the id of another record that states a relation to it.
CUE_AROUND = r"\b(?:after|before|block(?:ed|er|ers|ing|s)?(?:\s+by)?|build(?:s|ing)?\s+on|continu(?:ation|e|ed|es|ing)|depend(?:s|ed|ing)?\s+on|discover(?:ed)?\s+from|follow[\s-]?up|relat(?:e|ed|es|ing|ion|ionship)|supersed(?:e|ed|es|ing))\b"
LINEAGE_BEFORE = r"\b(?:decision|split)\s+from[\s:,\-–—()]*$"
REREVIEW_BEFORE = r"\b(?:found\s+by(?:\s+an?)?\s+)?re[\s-]?review(?:ed|ing)?(?:\s+of)?[\s:,\-–—()]*$"
REREVIEW_AFTER = r"^[\s:,\-–—()]{0,16}re[\s-]?review(?:ed|ing)?\b"
REMOVED_BUT_AFTER = r"^[\s:,\-–—()]{0,16}removed\b[\s\S]{0,64}\bbut\b"
FROM_BEFORE = r"\bfrom[\s:,\-–—()]*$"
ADVERSARIAL_REVIEW_AFTER = r"^[\s:,\-–—()]{0,16}adversarial\s+review\b"
RECIPROCAL_REASONS = ("discriminative-field-phrase", "discriminative-title-alignment", "discriminative-title-token", "sparse-title-alignment")
TEXT_FIELDS = ("title", "description", "acceptance_criteria", "design")  # notes tell of the past
TEXT_LIMIT, WINDOW = 4096, 96


def lifecycle(left: Column, right: Column) -> Column:
    blank = (F.trim(F.coalesce(left, F.lit(""))) == "") | (F.trim(F.coalesce(right, F.lit(""))) == "")
    closed = is_closed(left).cast("int") + is_closed(right).cast("int")
    return F.when(blank, "unknown").when(closed == 0, "active-active").when(closed == 1, "active-closed").otherwise("unknown")


def _states_relation(before: Column, after: Column) -> Column:
    """Whether the wording on the two sides of an id states a relation."""
    says = lambda text, cue: text.rlike("(?iU)" + cue)
    around = F.concat(before, F.lit(" issue-reference "), after)  # so that the sides cannot make up a cue together
    return (
        says(around, CUE_AROUND) | says(before, LINEAGE_BEFORE) | says(before, REREVIEW_BEFORE) | says(after, REREVIEW_AFTER)
        | says(after, REMOVED_BUT_AFTER) | (says(before, FROM_BEFORE) & says(after, ADVERSARIAL_REVIEW_AFTER))
    )


def reference_with_cue(text: Column, other_id: Column) -> Column:
    """Whether the first ``TEXT_LIMIT`` characters name an id with a relation cue within the window around it.

    The text is cut at the id; the place of each cut follows from the lengths.
    """
    text = F.substring(F.coalesce(text, F.lit("")), 1, TEXT_LIMIT)
    named = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9_.-])\Q"), other_id, F.lit(r"\E(?![A-Za-z0-9_-]|\.[A-Za-z0-9])"))
    lengths = F.transform(F.split(text, named, -1), F.length)
    size = F.length(other_id)
    ends = F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda s, n: s + n) + (k - 1) * size)
    starts = F.slice(ends, F.lit(1), F.size(ends) - 1)

    def stated(at: Column) -> Column:
        first = F.greatest(at - WINDOW, F.lit(0))
        return _states_relation(F.substring(text, first + 1, at - first), F.substring(text, at + size + 1, F.lit(WINDOW)))

    return F.coalesce((other_id != "") & F.exists(starts, stated), F.lit(False))


def ordered_codes(codes: Column) -> Column:
    """Codes without nulls and repeats in the fixed order; an unknown one fails."""
    known = F.array(*map(F.lit, EVIDENCE_ORDER))
    odd = F.array_except(F.filter(codes, lambda c: c.isNotNull()), known)
    fail = F.raise_error(F.concat(F.lit("unknown freshness evidence code: "), F.array_min(odd))).cast("array<string>")
    return F.when(F.size(odd) > 0, fail).otherwise(F.filter(known, lambda c: F.array_contains(codes, c)))


def consumers(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges into an endpoint from active records: ``target_id, source_id``."""
    live = edges.join(active.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return live.select("target_id", "source_id").distinct()


def third_party_consumer(pairs: DataFrame, edges: DataFrame, active: DataFrame) -> DataFrame:
    """Pairs (issue_id, related_issue_id) into which an active record outside the pair points.

    Three sources of an end are enough to know: two of them can be in the pair.
    """
    into = consumers(edges, active)
    first = F.row_number().over(Window.partitionBy("target_id").orderBy("source_id"))
    few = into.withColumn("k", first).filter("k <= 3").groupBy("target_id").agg(F.collect_list("source_id").alias("sources"))
    rows = pairs.select("issue_id", "related_issue_id").distinct()
    for key in ("issue_id", "related_issue_id"):
        rows = rows.join(few.select(F.col("target_id").alias(key), F.col("sources").alias(f"into_{key}")), key, "left")
    other = lambda c: F.coalesce(F.exists(c, lambda x: (x != F.col("issue_id")) & (x != F.col("related_issue_id"))), F.lit(False))
    return rows.filter(other("into_issue_id") | other("into_related_issue_id")).select("issue_id", "related_issue_id")


def direct_codes(pairs: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with the explanatory relations between them, either way, and by parent."""
    lo, hi = F.least("issue_id", "related_issue_id"), F.greatest("issue_id", "related_issue_id")
    keyed = edges.filter(F.col("relationship_type").isin(*EXPLANATORY)).select(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi"), "relationship_type")
    parents = records.filter("parent_id IS NOT NULL").select(F.least("id", "parent_id").alias("lo"), F.greatest("id", "parent_id").alias("hi"), F.lit("parent-child").alias("relationship_type"))
    kinds = keyed.unionByName(parents).distinct().groupBy("lo", "hi").agg(F.collect_set("relationship_type").alias("kinds"))
    rows = pairs.withColumns({"lo": lo, "hi": hi}).join(kinds, ["lo", "hi"], "left").drop("lo", "hi")
    return rows.withColumn("direct", F.transform(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: F.concat(F.lit("direct-"), k))).drop("kinds")


#: A run of the characters that may not stand before an id; four others fold to some of them.
NAME, PLAIN_ID = r"(?iu)[A-Za-z0-9_.-]+", r"\A[A-Za-z0-9_.-]+\z"
BEFORE_ID, AFTER_ID, INNER_STOP = r"(?<![A-Za-z0-9_.-])", r"(?![A-Za-z0-9_-]|\.[A-Za-z0-9])", r"\.(?![a-z0-9])"
FEW_SHAPES = 50


def _folded(name: Column) -> Column:
    return F.lower(F.translate(name, "\u017f\u212a\u0131\u0130", "skii"))


def _named(records: DataFrame, few_shapes: int = FEW_SHAPES) -> DataFrame:
    """``id, other_id``: records that may name another one; a superset of what ``reference_with_cue`` finds.

    Ids of plain characters differ by their digits mostly: what few shapes they have is one
    pattern for the texts. Else an id is a whole run of such characters, but for what may
    follow a full stop, so runs, cut at each such stop too, are joined with the ids. Ids
    of other characters are not looked up here.
    """
    ids = stage(records.filter(F.col("id").rlike(PLAIN_ID)).select("id", F.lower("id").alias("name")), "names")
    texts = F.concat_ws("\n", *[F.substring(F.coalesce(c, F.lit("")), 1, TEXT_LIMIT) for c in TEXT_FIELDS])
    shapes = [r.shape for r in ids.select(F.translate("name", "0123456789", "0000000000").alias("shape")).distinct().limit(few_shapes + 1).collect()]
    if len(shapes) <= few_shapes and not any(re.search(INNER_STOP, s) for s in shapes):
        kinds = "|".join(re.sub("0+", lambda m: f"[0-9]{{{len(m.group())}}}", re.sub(r"([.-])", r"\\\1", s)) for s in sorted(shapes)) or "(?!)"
        found = F.regexp_extract_all(texts, F.lit(f"(?iu){BEFORE_ID}(?:{kinds}){AFTER_ID}"), 0)
        rows = records.select("id", F.explode(F.array_distinct(found)).alias("name")).withColumn("name", _folded(F.col("name")))
    else:
        rows = records.select("id", F.explode(F.array_distinct(F.regexp_extract_all(texts, F.lit(NAME), 0))).alias("name")).withColumn("name", _folded(F.col("name")))
        stop = F.explode(F.filter(F.sequence(F.lit(1), F.length("name")), lambda k: (F.substring(F.col("name"), k, F.lit(1)) == ".") & ~F.substring(F.col("name"), k + 1, F.lit(1)).rlike("[a-z0-9]")))
        cut = rows.filter(F.col("name").rlike(INNER_STOP)).withColumn("stop", stop)
        rows = rows.unionByName(cut.select("id", F.expr("substring(name, 1, stop - 1)").alias("name")))
    return rows.join(ids.select(F.col("id").alias("other_id"), "name"), "name").filter("id <> other_id").select("id", "other_id").distinct()


def cued_pairs(candidates: DataFrame, records: DataFrame, few_shapes: int = FEW_SHAPES) -> DataFrame:
    """Pairs (issue_id, related_issue_id) of which one's text names the other with a relation cue.

    Only pairs that ``_named`` finds, or with an id that it cannot look up, meet their texts.
    """
    keys = ["issue_id", "related_issue_id"]
    named = _named(records, few_shapes)
    both = named.toDF(*keys).unionByName(named.toDF(*reversed(keys))).distinct()
    pairs = candidates.select(*keys).distinct()
    odd = pairs.filter(~F.col("issue_id").rlike(PLAIN_ID) | ~F.col("related_issue_id").rlike(PLAIN_ID))
    pairs = stage(pairs.join(both, keys, "left_semi").unionByName(odd).distinct(), "named-pairs")
    state = lambda key, p: records.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in TEXT_FIELDS]).join(pairs.select(key).distinct(), key, "left_semi")
    rows = pairs.join(state("issue_id", "l"), "issue_id").join(state("related_issue_id", "r"), "related_issue_id")
    names = [reference_with_cue(F.col(f"{p}_{c}"), F.col(other)) for p, other in (("l", "related_issue_id"), ("r", "issue_id")) for c in TEXT_FIELDS]
    return rows.filter(functools.reduce(operator.or_, names)).select(*keys)


def classify(candidates: DataFrame, records: DataFrame, edges: DataFrame, active: DataFrame, scope_complete: bool = True, degraded: bool = False) -> DataFrame:
    """Candidates with ``likely_action``, ``review_tier`` and ordered ``evidence_codes``.

    Structure wins over wording, wording over titles; similarity alone is only
    information. No candidate carries its records' texts: titles travel as digests.
    """
    complete, keys = scope_complete and not degraded, ["issue_id", "related_issue_id"]
    title = plain_title(F.col("title"))
    told = stage(records.select("id", F.when(title != "", F.unhex(F.sha2(title, 256))).alias("title"), "status", "parent_id"), "states")
    state = lambda key, p: told.select(F.col("id").alias(key), F.col("title").alias(f"{p}_title"), F.col("status").alias(f"{p}_status"))
    rows = candidates.join(state("issue_id", "l"), "issue_id").join(state("related_issue_id", "r"), "related_issue_id")
    rows = rows.withColumns({"same": F.coalesce(F.col("l_title") == F.col("r_title"), F.lit(False)), "life": lifecycle(F.col("l_status"), F.col("r_status"))})
    rows = direct_codes(rows.drop("l_title", "r_title", "l_status", "r_status"), edges, told)
    used = stage(third_party_consumer(candidates, edges, active), "used").withColumn("used", F.lit(True))
    cued = stage(cued_pairs(candidates, records), "cued").withColumn("cue", F.lit(True))
    rows = rows.join(used, keys, "left").join(cued, keys, "left").withColumn("cue", F.coalesce("cue", F.lit(False)))
    bound = (F.size("direct") > 0) | F.coalesce("used", F.lit(False))
    missing = F.col("cue") & F.lit(complete)
    action = (
        F.when(bound, "intentional-follow-up").when(missing, "missing-relation")
        .when(F.col("same") & (F.col("life") == "active-active"), "duplicate")
        .when(F.col("same") & (F.col("life") == "active-closed"), "superseded-open").otherwise("uncertain")
    )
    rows = rows.withColumn("likely_action", action)
    a = F.col("likely_action")
    one = lambda test, code: F.when(test, code)
    reciprocal = F.col("admission_reason") == "reciprocal-neighbor-threshold-exception"
    wording = reciprocal & F.col("reciprocal_evidence").isin(*RECIPROCAL_REASONS) & (F.col("signal_quality") == "discriminative-local-evidence")
    doubt, other = a == "uncertain", a.isin("duplicate", "superseded-open", "uncertain")
    codes = F.concat(
        F.when(a == "intentional-follow-up", F.col("direct")).otherwise(F.array().cast("array<string>")),
        F.array(
            one((a == "intentional-follow-up") & F.col("used"), "active-incoming-consumer"),
            one(F.col("cue") & (a != "intentional-follow-up"), "explicit-issue-id-reference"),
            one(F.col("cue") & (a != "intentional-follow-up"), "bounded-relationship-cue"),
            F.lit("relationship-scope-complete" if complete else "relationship-scope-incomplete"),
            one(F.lit(degraded), "relationship-scope-degraded"),
            one(a == "missing-relation", "no-direct-explanatory-relationship"),
            one(F.col("same") & other, "exact-normalized-title"),
            one(F.col("same") & other, F.concat(F.lit("lifecycle-"), F.col("life"))),
            one(doubt, F.concat(F.lit("candidate-"), F.col("kind"))),
            one(doubt & wording, "reciprocal-local-evidence"),
            one(doubt & (F.col("admission_reason") == "semantic-threshold"), "semantic-threshold-admission"),
            one(doubt, "semantic-candidate-only"),
            one(doubt & ~F.col("same") & ~F.col("cue"), "no-actionable-evidence"),
        ),
    )
    tier = F.when(a.isin("missing-relation", "duplicate", "superseded-open"), "action").otherwise("informational")
    return rows.select(*candidates.columns, "likely_action", tier.alias("review_tier"), ordered_codes(codes).alias("evidence_codes"))


def queue(assessed: DataFrame, budget: int | None = None) -> DataFrame:
    """The pool re-ranked: actions first, then by kind of action, in the order of the old positions; the first ``budget``.

    With a budget each task keeps that many, and only these are numbered.
    """
    place = F.when(F.col("review_tier") == "action", 0).otherwise(1)
    kind = F.array_position(F.array(*map(F.lit, ACTION_ORDER)), F.col("likely_action"))
    order = [place, kind, "position", "kind", "issue_id", "related_issue_id"]
    first = assessed if budget is None else assessed.orderBy(*order).limit(budget)
    return first.withColumn("freshness_position", F.row_number().over(Window.orderBy(*order)))


def summary(assessed: DataFrame) -> DataFrame:
    """Counts for each action and tier, with totals under ``all``."""
    rows = assessed.cube("likely_action", "review_tier").agg(F.count("*").alias("pairs"))
    return rows.select(F.coalesce("likely_action", F.lit("all")).alias("likely_action"), F.coalesce("review_tier", F.lit("all")).alias("review_tier"), "pairs")


def active_ids(records: DataFrame) -> DataFrame:
    return records.filter(F.lower("status").isin(*ACTIVE_STATUSES)).select("id")
