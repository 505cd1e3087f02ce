"""Work that touches the same code: paths, modules, hubs, collisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import module_of
from quillon.plans.staging import stage

# What counts as a code path.
CODE_EXTENSIONS = [".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".java", ".js", ".json", ".jsx", ".kt", ".md", ".php", ".proto", ".py", ".rb", ".rs", ".scala", ".sh", ".sql", ".svelte", ".swift", ".toml", ".ts", ".tsx", ".vue", ".xml", ".yaml", ".yml"]
IGNORED_PARTS = [".beads", ".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "build", "dist", "node_modules"]
DIRECTORY_ROOTS = ["app", "apps", "docs", "lib", "packages", "src", "test", "tests", ".github", "backend", "cmd", "frontend", "internal", "pkg", "scripts", "services"]
EDIT_VERBS = ["add", "change", "create", "edit", "fix", "implement", "migrate", "modify", "move", "refactor", "remove", "rename", "repair", "replace", "rewrite", "update", "write"]
REFERENCE_VERBS = ["audit", "check", "document", "inspect", "inventory", "read", "reference", "review", "see", "trace", "verify"]
PATH_PATTERN = r"(?<![\w:/.-])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+(?:\.[A-Za-z0-9]+|/))(?:(?:::|#)([A-Za-z_][A-Za-z0-9_.-]*))?"
ROOT_PATTERN = r"`([A-Za-z0-9_.-]+\.[A-Za-z0-9]+)(?:(?:::|#)([A-Za-z_][A-Za-z0-9_.-]*))?`"
URL_PATTERN = r"(?i)\b[a-z][a-z0-9+.-]*://\S+"
OBSERVED, EXPLICIT = "active-worktree-diff", "explicit-reference"
#: The values that a pointer's facts can have, by column.
VOCABULARIES = {
    "source": (OBSERVED, EXPLICIT),
    "edit_intent": ("observed-edit", "likely-edit", "reference-only", "unknown"),
    "context_kind": ("observed-worktree", "prose", "code-fence"),
    "path_presence": ("existing", "missing", "unavailable"),
    "source_field": ("title", "description", "acceptance_criteria", "design", "notes"),
}
BEFORE, AFTER = 80, 40  # characters around a mention that tell its intent
#: Each character of an HTML comment: where one starts, and on from there to its end.
COMMENT_CHARACTER = r"(?s)(?:(?=<!--.*?-->)|(?!\A)\G(?:(?<!-->)|(?<=<!-->))(?<!\A[^<]))."
MAX_COMMITTED_PATHS = 250


def normalize_path(raw: Column) -> Column:
    """A repository path in normal form; null where it is not a code path."""
    text = F.replace(F.regexp_replace(raw, r"""^[`'"()\[\]{}<>,;:]+|[`'"()\[\]{}<>,;:]+$""", ""), F.lit("\\"), F.lit("/"))
    folder = text.endswith("/")
    bare = F.regexp_replace(text, "/+$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: ~p.isin("", "."))
    whole = F.array_join(parts, "/")
    barred = F.exists(parts, lambda p: p.isin("..", *IGNORED_PARTS)) | (bare == ".") | bare.startswith("./")
    suffix = F.lower(F.regexp_extract(bare, r"[^/.](\.[^./]+)$", 1))
    fits = F.when(folder, F.element_at(parts, 1).isin(DIRECTORY_ROOTS)).otherwise(suffix.isin(CODE_EXTENSIONS))
    wrong = (bare == "") | (F.length(bare) > 240) | bare.startswith("/") | bare.startswith("~/") | bare.rlike("^[A-Za-z]:") | barred
    return F.when(~wrong & (F.size(parts) > 0) & fits, F.concat(whole, F.when(folder, "/").otherwise("")))


def normalize_git_path(raw: Column) -> Column:
    """As ``normalize_path``, but any file that is tracked counts."""
    bare = F.regexp_replace(F.replace(F.trim(raw), F.lit("\\"), F.lit("/")), "/+$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: ~p.isin("", "."))
    barred = F.exists(parts, lambda p: p.isin("..", *IGNORED_PARTS)) | (bare == ".") | bare.startswith("/") | (bare == "")
    return F.coalesce(normalize_path(raw), F.when(~barred, F.array_join(parts, "/")))


def edit_intent(context: Column) -> Column:
    words = lambda verbs: r"(?i)\b(?:" + "|".join(verbs) + r")\b"
    return F.when(context.rlike(words(EDIT_VERBS)), "likely-edit").when(context.rlike(words(REFERENCE_VERBS)), "reference-only").otherwise("unknown")


def _matches(text: Column, pattern: str) -> Column:
    """``start, end, path, symbol`` of a pattern's matches, with places from 0.

    The text is cut at the matches; places follow from the lengths.
    """
    found = lambda k: F.regexp_extract_all(text, F.lit(pattern), k)
    between = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(found(0), F.length)
    upto = lambda lengths, k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda s, n: s + n)
    start = lambda k: upto(between, k + 1) + upto(sizes, k)
    return F.transform(
        found(1),
        lambda path, k: F.struct(start(k).alias("start"), (start(k) + F.get(sizes, k)).alias("end"), path.alias("path"), F.get(found(2), k).alias("symbol")),
    )


def explicit_pointers(texts: DataFrame) -> DataFrame:
    """``issue_id, source_field, path, symbol, edit_intent, context_kind`` of ``texts (issue_id, source_field, text)``.

    Urls are taken out and HTML comments blanked; files at the root count only in
    back-ticks. The intent is that of the words from 80 characters before a
    mention to 40 after it.
    """
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), URL_PATTERN, " ")
    clean = F.when(clean.contains("<!--"), F.regexp_replace(clean, COMMENT_CHARACTER, " ")).otherwise(clean)
    rows = texts.select("issue_id", "source_field", clean.alias("clean"))
    text = F.col("clean")

    def pointer(m: Column) -> Column:
        first = F.greatest(m["start"] - BEFORE, F.lit(0))
        around = F.substring(text, first + 1, m["end"] + AFTER - first)
        return F.struct(
            normalize_path(m["path"]).alias("path"), F.nullif(m["symbol"], F.lit("")).alias("symbol"),
            edit_intent(around).alias("edit_intent"), in_code_fence(text, m["start"]).alias("context_kind"),
        )

    found = F.concat(_matches(text, PATH_PATTERN), _matches(text, ROOT_PATTERN))
    rows = rows.select("issue_id", "source_field", F.explode(F.transform(found, pointer)).alias("p"))
    return rows.select("issue_id", "source_field", "p.path", "p.symbol", "p.edit_intent", "p.context_kind").filter("path IS NOT NULL").distinct()


def path_mentions(texts: DataFrame) -> DataFrame:
    """``issue_id, source_field, path, symbol``: what ``explicit_pointers`` names, however worded."""
    return explicit_pointers(texts).select("issue_id", "source_field", "path", "symbol").distinct()


def observed_pointers(associated: DataFrame, trees: DataFrame, changed: DataFrame) -> DataFrame:
    """Pointers of the paths that an issue's worktree (``issue_id, path``) was seen to change (``worktree, path``)."""
    head = trees.select(F.col("path").alias("worktree"), F.col("head").alias("revision"))
    rows = associated.select("issue_id", F.col("path").alias("worktree")).join(head, "worktree").join(changed, "worktree")
    facts = {"edit_intent": F.lit("observed-edit"), "context_kind": F.lit("observed-worktree"), "source": F.lit(OBSERVED)}
    none = F.lit(None).cast("string")
    rows = rows.select("issue_id", normalize_git_path(F.col("path")).alias("path"), "revision", none.alias("symbol"), none.alias("source_field"))
    return rows.filter("path IS NOT NULL").withColumns(facts).distinct()


def _mask(column: str) -> Column:
    """The bit of a fixed vocabulary's value; none where it is null or another."""
    out = F.lit(0)
    for value in VOCABULARIES[column]:
        out = F.when(F.col(column) == value, _bit(column, value)).otherwise(out)
    return out


def _bit(column: str, value: str) -> int:
    before = 0
    for name, values in VOCABULARIES.items():
        if name == column:
            return 1 << (before + values.index(value))
        before += len(values)
    raise KeyError(column)


def _symbol(path: Column, symbol: Column) -> Column:
    return F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(path, F.lit("::"), symbol))


def surfaces(pointers: DataFrame) -> DataFrame:
    """``issue_id, kind, surface, observed, facts, path_facts, low, high``: distinct paths, modules and symbols (``path::symbol``) of each issue.

    ``facts`` has a bit for each source, intent, context, presence and field that the
    issue names the surface with, ``path_facts`` those of a symbol's path; ``low`` and
    ``high`` are the issue's first and last revision.
    """
    own, module = F.col("path"), module_of(F.col("path"))
    known = [(~own.endswith("/"), "path", own), (module.isNotNull(), "module", module)]
    if "symbol" in pointers.columns:
        known.append((_symbol(own, F.col("symbol")).isNotNull(), "symbol", _symbol(own, F.col("symbol"))))
    named = [F.when(fits, F.struct(F.lit(kind).alias("kind"), surface.alias("surface"))) for fits, kind, surface in known]
    bits = F.lit(0)
    for column in VOCABULARIES:
        bits = bits.bitwiseOR(_mask(column)) if column in pointers.columns else bits
    dated = F.nullif(F.col("revision"), F.lit("")) if "revision" in pointers.columns else F.lit(None).cast("string")
    own_issue = Window.partitionBy("issue_id")  # first, so that all that follows stays with the issue
    rows = pointers.select("issue_id", "path", (F.col("source") == OBSERVED).alias("observed"), bits.alias("bits"), F.array_compact(F.array(*named)).alias("s"), dated.alias("r"))
    rows = rows.withColumns({"low": F.min("r").over(own_issue), "high": F.max("r").over(own_issue)})
    rows = rows.withColumn("path_bits", F.bit_or("bits").over(Window.partitionBy("issue_id", "path")))
    found = rows.select("issue_id", "observed", "bits", "path_bits", "low", "high", F.inline("s")).groupBy("issue_id", "kind", "surface")
    return found.agg(
        F.bool_or("observed").alias("observed"), F.bit_or("bits").alias("facts"), F.max(F.when(F.col("kind") == "symbol", F.col("path_bits"))).alias("path_facts"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def _path_of(symbol: Column) -> Column:
    return F.regexp_extract(symbol, "(?s)^(.*)::", 1)


def hubs(found: DataFrame, limit: int) -> DataFrame:
    """Paths and modules of more than ``limit`` issues; a symbol is never a hub."""
    return found.filter("kind <> 'symbol'").groupBy("kind", "surface").agg(F.count("*").alias("issue_count")).filter(F.col("issue_count") > limit)


FEW_SURFACES = 1 << 18  # that many are broadcast
SIGNED = 64  # an issue with more surfaces has no signature


def signed(found: DataFrame) -> DataFrame:
    """``found``, staged, with a signature of its issue on path rows: short hashes of all that a pair on one path could share besides it.

    Those are modules, symbols, paths without a module, and paths of a module of which the
    issue has several. The hashes of one issue differ, or it has no signature, as when it
    has too many: so what two signatures have in common is at least what their issues share.
    """
    family = F.when(F.col("kind") == "path", F.coalesce(module_of(F.col("surface")), "surface"))
    by = Window.partitionBy("issue_id")
    rows = found.withColumn("many", F.count("*").over(by)).withColumn("family", family)
    crowd = F.count("*").over(Window.partitionBy("issue_id", "family"))
    needed = (F.col("kind") != "path") | (F.col("family") == F.col("surface")) | (crowd > 1)
    short = (F.pmod(F.xxhash64("kind", "surface"), F.lit(1 << 16)) - (1 << 15)).cast("short")
    rows = rows.withColumn("short", F.when(needed & (F.col("many") <= SIGNED), short))
    rows = rows.withColumn("all", F.collect_list("short").over(by))
    fits = (F.col("kind") == "path") & (F.col("many") <= SIGNED) & (F.size(F.array_distinct("all")) == F.size("all"))
    return stage(rows.withColumn("signature", F.when(fits, F.col("all"))).drop("many", "family", "short", "all"), "surfaces")


def _seen(facts: Column) -> Column:
    return facts.bitwiseAND(_bit("source", OBSERVED)) != 0


def _picked(found: DataFrame, some: DataFrame) -> DataFrame:
    """Rows of ``found`` on the staged surfaces ``some``, picked out before any shuffle if these are few."""
    return found.join(F.broadcast(some) if some.count() <= FEW_SURFACES else some, ["kind", "surface"], "left_semi")


def _meetings(found: DataFrame, limit: int, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``a, b, kind, surface`` and both sides' facts: one row for each surface that a pair shares, plain ones and hub paths.

    An equi-join on the surface. Of surfaces with more than one issue hubs are taken out
    before it, but for pairs on a hub path that one side was seen to change: each path or
    module then joins at most ``limit`` issues, or a hub's observed issues with its others.
    ``sole`` tells of a pair on a hub path that it shares nothing else. ``scope (issue_id)``
    keeps the pairs with an issue in it.
    """
    found = found if "signature" in found.columns else signed(found)
    if scope is not None:
        marked = found.join(scope.select("issue_id").distinct().withColumn("inside", F.lit(True)), "issue_id", "left")
        found = stage(marked.na.fill(False, ["inside"]), "surfaces")  # read five times
    else:
        found = found.withColumn("inside", F.lit(True))
    met = found.groupBy("kind", "surface").agg(F.count("*").alias("n")).filter("n > 1")
    held = (F.col("kind") != "symbol") & (F.col("n") > limit)
    met = stage(met.filter(~held | (F.col("kind") == "path")).select("kind", "surface", held.alias("hub")), "met-surfaces")
    plain = _picked(found, met.filter("NOT hub").select("kind", "surface"))
    facts = ("facts", "path_facts", "inside", "signature", "low", "high")
    side = lambda rows, name, *cols: rows.select("surface", F.col("issue_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in facts], *cols)
    pairs = side(plain, "a", "kind").join(side(plain, "b", "kind"), ["kind", "surface"]).filter("a < b AND (inside_a OR inside_b)")
    paths = found.filter("kind = 'path'").withColumn("path_facts", F.lit(None).cast("int"))
    hub = met.filter("hub").select("surface")
    seen = side(paths.filter(_seen(F.col("facts"))).join(hub, "surface", "left_semi"), "a").join(side(paths, "b"), "surface")
    seen = seen.filter((F.col("a") != F.col("b")) & ((F.col("a") < F.col("b")) | ~_seen(F.col("facts_b"))) & (F.col("inside_a") | F.col("inside_b")))
    alone = F.coalesce(F.size(F.array_intersect("signature_a", "signature_b")) == 1, F.lit(False))
    return pairs.withColumn("sole", F.lit(False)), seen.withColumns({"kind": F.lit("path"), "sole": alone})


def _sides(rows: DataFrame, *cols: str) -> DataFrame:
    """Meetings with the smaller id first."""
    first = F.col("a") < F.col("b")
    of = lambda side, x, y: F.struct(*[F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(c) for c in ("facts", "path_facts")]).alias(side)
    observed = _seen(F.col("facts_a").bitwiseOR(F.col("facts_b"))).alias("observed")
    return rows.select(F.least("a", "b").alias("issue_id"), F.greatest("a", "b").alias("related_issue_id"), "kind", "surface", observed, of("l", "a", "b"), of("r", "b", "a"), F.least("low_a", "low_b").alias("low"), F.greatest("high_a", "high_b").alias("high"), *cols)


def _shared(found: DataFrame, limit: int, scope: DataFrame | None = None) -> DataFrame:
    """``issue_id, related_issue_id, kind, surface, observed`` and both sides' facts: one row for each surface that a pair shares."""
    plain, seen = _meetings(found, limit, scope)
    return _sides(plain).unionByName(_sides(seen))


def shared_surfaces(found: DataFrame, limit: int, scope: DataFrame | None = None) -> DataFrame:
    """``issue_id, related_issue_id, kind, surface, observed`` of pairs that share a symbol, or a path or module that no guard holds back."""
    return _shared(found, limit, scope).select("issue_id", "related_issue_id", "kind", "surface", "observed")


def shared_evidence(found: DataFrame, limit: int, max_evidence: int = 8, scope: DataFrame | None = None) -> DataFrame:
    """``shared_paths, shared_symbols, shared_modules, guarded`` of every pair that shares one, with both sides' facts.

    Of the first ``max_evidence`` modules those count that an observed change touches;
    a pair with other modules only is ``guarded``. A shared symbol brings its path
    back, also one that is a hub. A pair that shares a hub path and nothing else, as
    signatures tell where the two meet, is ``on_hub`` and never shuffled as a pair.
    """
    entry = F.struct("surface", "observed", F.col("l.facts").alias("l"), F.col("r.facts").alias("r"), F.col("l.path_facts").alias("pl"), F.col("r.path_facts").alias("pr"))
    of = lambda kind: F.slice(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry))), 1, max_evidence)
    plain, seen = _meetings(found, limit, scope)
    seen = _sides(seen, "sole")
    pairs = _sides(plain).unionByName(seen.filter("NOT sole").drop("sole")).groupBy("issue_id", "related_issue_id").agg(of("path").alias("p"), of("symbol").alias("s"), of("module").alias("all_m"), F.min("low").alias("low"), F.max("high").alias("high"))
    brought = F.transform("s", lambda x: F.struct(_path_of(x["surface"]).alias("surface"), x["pl"].alias("l"), x["pr"].alias("r")))
    paths = F.transform("p", lambda x: F.struct(x["surface"].alias("surface"), x["l"].alias("l"), x["r"].alias("r")))
    pairs = pairs.withColumn("p", F.when(F.size("s") == 0, paths).otherwise(F.slice(F.sort_array(F.array_union(paths, brought)), 1, max_evidence))).withColumn("m", F.filter("all_m", lambda x: x["observed"]))
    every = lambda side: F.aggregate(F.concat(*[F.transform(c, lambda x: x[side]) for c in ("p", "s", "m")]), F.lit(0), lambda a, x: a.bitwiseOR(x))
    names = lambda c: F.transform(c, lambda x: x["surface"])
    several = pairs.select(
        "issue_id", "related_issue_id", names("p").alias("shared_paths"), names("s").alias("shared_symbols"), names("m").alias("shared_modules"),
        (F.size("p") + F.size("s") + F.size("m") == 0).alias("guarded"), every("l").alias("l"), every("r").alias("r"), "low", "high", F.lit(False).alias("on_hub"),
    )
    none = F.array().cast("array<string>")
    one = seen.filter("sole").select(
        "issue_id", "related_issue_id", F.array("surface").alias("shared_paths"), none.alias("shared_symbols"), none.alias("shared_modules"),
        F.lit(False).alias("guarded"), F.col("l.facts").alias("l"), F.col("r.facts").alias("r"), "low", "high", F.lit(True).alias("on_hub"),
    )
    return several.unionByName(one)


def collisions(pointers: DataFrame, limit: int, max_evidence: int = 8, scope: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """One row for each colliding pair: what it shares and how sure that is.

    A shared module counts only where an observed change touches it; paths count
    unless they are hubs that nobody was seen to change, and symbols always. The
    pointers to what is shared travel as bits with the pairs. ``shared`` is
    ``shared_evidence`` where that is at hand; ``scope`` as there.
    """
    pairs = shared_evidence(surfaces(pointers), limit, max_evidence, scope) if shared is None else shared
    pairs = pairs.filter("NOT guarded")
    low, high, all_bits = F.col("low"), F.col("high"), F.col("l").bitwiseOR(F.col("r"))
    has = lambda column, value, bits=all_bits: bits.bitwiseAND(_bit(column, value)) != 0
    named = lambda column: F.array_compact(F.array(*[F.when(has(column, v), v) for v in sorted(VOCABULARIES[column])]))
    sides = sum((has("source", OBSERVED, F.col(side)).cast("int") for side in ("l", "r")), F.lit(0))
    here, gone, unsure = (has("path_presence", v) for v in VOCABULARIES["path_presence"])
    return pairs.select(
        "issue_id", "related_issue_id", F.when(F.size("shared_paths") > 0, "exact-file").otherwise("shared-module").alias("kind"),
        "shared_paths", "shared_symbols", "shared_modules",
        F.when(sides == 2, "observed").when(sides == 1, "corroborated").otherwise("explicit").alias("confidence"),
        named("source").alias("evidence_sources"),
        F.when(has("edit_intent", "observed-edit"), "observed-edit").when(has("edit_intent", "likely-edit") & has("edit_intent", "reference-only"), "mixed")
        .when(has("edit_intent", "likely-edit"), "likely-edit").when(has("edit_intent", "reference-only"), "reference-only").otherwise("unknown").alias("edit_intent"),
        F.when(has("context_kind", "observed-worktree"), "observed-worktree").when(has("context_kind", "code-fence") & ~has("context_kind", "prose"), "code-fence-only")
        .when(has("context_kind", "code-fence"), "mixed").otherwise("prose").alias("context_kind"),
        F.when(~here & ~gone, "unavailable").when(here & ~gone & ~unsure, "all-existing").when(gone & ~here & ~unsure, "all-missing").otherwise("mixed").alias("path_presence"),
        F.when(low.isNull(), "unavailable").when(low == high, "same").otherwise("different").alias("revision_relation"),
        named("source_field").alias("intent_source_fields"),
    )


# --- what the guards hold back ---------------------------------------------------


def _hub_sets(found: DataFrame, limit: int) -> DataFrame:
    """``issue_id, hubs``: the numbers of the hubs that an issue has, those implied by others left out.

    Who shares a hub path shares its module, which is then a hub too; so only hub
    modules count, and hub paths without a module.
    """
    own = hubs(found, limit).filter(F.expr("kind = 'module'") | module_of(F.col("surface")).isNull())
    numbered = stage(own.select("kind", "surface", F.monotonically_increasing_id().alias("hub")), "hubs")
    return found.join(numbered, ["kind", "surface"]).groupBy("issue_id").agg(F.array_sort(F.collect_list("hub")).alias("hubs"))


def _pairs_sharing(sets: DataFrame, widest: int) -> int:
    """How many pairs of issues have a hub in common, without making them.

    Issues of one set of hubs are a class. By inclusion and exclusion the pairs are the
    sum over sets S of hubs of (-1)^(|S| + 1) times the pairs of issues that have all of
    S, and a class of k hubs adds to 2^k - 1 of them. A set that only one issue has adds
    nothing, so of sets of three and more only those are made of whose hubs every two are
    on two issues. Classes of more than ``widest``
    hubs are instead joined with the classes that have one of their hubs.
    """
    classes = stage(sets.groupBy("hubs").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "hub-classes")
    size, n = F.size("hubs"), F.col("n").cast("decimal(38,0)")
    own = classes.filter(size <= widest)
    within = (F.col("n").cast("decimal(19,0)") * (F.col("n").cast("decimal(19,0)") - 1) / 2).cast("decimal(38,0)")
    single = own.select(F.explode("hubs").alias("hub"), "n").groupBy("hub").agg(F.sum("n").alias("n")).agg(F.sum(within).alias("pairs")).first().pairs or 0
    later = F.transform("hubs", lambda x, k: F.transform(F.slice("hubs", k + 2, F.size("hubs")), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    two = own.filter(size > 1).select("id", "n", F.inline(F.flatten(later)))
    often = stage(two.groupBy("x", "y").agg(F.sum("n").alias("n")).filter("n > 1"), "hub-pairs")
    twice = often.agg(F.sum(within).alias("pairs"), F.count("*").alias("rows")).first()
    named = often.select("x", "y")
    kept = two.join(F.broadcast(named) if twice.rows <= FEW_SURFACES else named, ["x", "y"], "left_semi")
    kept = kept.groupBy("id", "n").agg(F.collect_list(F.struct("x", "y")).alias("twos")).filter(F.size("twos") > 2)
    kept = kept.withColumn("hubs", F.array_sort(F.array_union(F.col("twos.x"), F.col("twos.y"))))
    at = lambda h: F.element_at(F.transform(F.sequence(F.lit(0), F.size("hubs") - 1), lambda k: F.call_function("shiftleft", F.lit(1), k)), F.array_position("hubs", h).cast("int"))
    kept = kept.withColumn("twos", F.transform("twos", lambda p: at(p["x"]).bitwiseOR(at(p["y"]))))
    numbers = F.sequence(F.lit(1), F.expr("cast(power(2, size(hubs)) - 1 as int)"))
    inside = lambda m: F.size(F.filter("twos", lambda p: p.bitwiseAND(m) == p))
    whole = F.filter(numbers, lambda m: (F.bit_count(m) > 2) & (inside(m) * 2 == F.bit_count(m) * (F.bit_count(m) - 1)))
    chosen = F.filter("hubs", lambda _, k: F.call_function("shiftright", F.col("m"), k).bitwiseAND(1) == 1)
    some = kept.withColumn("m", F.explode(whole)).select(chosen.alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
    signed_pairs = F.when(F.size("s") % 2 == 1, 1).otherwise(-1) * within
    narrow = single - (twice.pairs or 0) + (some.agg(F.sum(signed_pairs).alias("pairs")).first().pairs or 0)
    if classes.filter(size > widest).isEmpty():
        return int(narrow)
    each = classes.withColumn("hub", F.explode("hubs")).select("hub", "id", "n", (size > widest).alias("wide"))
    wide = each.filter("wide").select("hub", F.col("id").alias("wide_id"), F.col("n").alias("wide_n"))
    met = wide.join(each, "hub").filter("NOT wide OR id >= wide_id").select("wide_id", "wide_n", "id", "n").distinct()
    own = F.when(F.col("id") == F.col("wide_id"), (n * (n - 1) / 2).cast("decimal(38,0)")).otherwise((n * F.col("wide_n")).cast("decimal(38,0)"))
    return int(narrow) + int(met.agg(F.sum(own).alias("pairs")).first().pairs or 0)


def _outside(rows: DataFrame, scope: DataFrame) -> DataFrame:
    return rows.join(scope.select("issue_id").distinct(), "issue_id", "left_anti")


def guard_counts(found: DataFrame, shared: DataFrame, limit: int, scope: DataFrame | None = None, widest: int = 10) -> dict[str, int]:
    """How many pairs the hub guard and the module guard hold back.

    ``shared`` is ``shared_evidence`` of the same surfaces and scope. The hub guard
    holds a pair back that shares hubs and nothing else: all pairs on hubs, counted
    without making them, less those of ``shared`` that have a hub in common as well.
    ``shared`` is read once, so it need not be staged.
    """
    sets = stage(_hub_sets(found, limit), "hub-sets")
    on_hubs = _pairs_sharing(sets, widest) - (_pairs_sharing(_outside(sets, scope), widest) if scope is not None else 0)
    both = shared.filter("NOT on_hub").select("issue_id", "related_issue_id", "guarded").join(sets.toDF("issue_id", "l_hubs"), "issue_id", "left")
    both = both.join(sets.toDF("related_issue_id", "r_hubs"), "related_issue_id", "left").select(F.arrays_overlap("l_hubs", "r_hubs").alias("known"), "guarded")
    both = both.unionByName(shared.filter("on_hub").select(F.lit(True).alias("known"), "guarded"))
    row = both.agg(F.count_if("known").alias("known"), F.count_if("guarded").alias("modules")).first()
    return {"omitted_by_hub_guard": on_hubs - row.known, "omitted_by_module_guard": row.modules}


def hub_guard_sample(found: DataFrame, shared: DataFrame, limit: int, count: int, max_evidence: int = 8, scope: DataFrame | None = None) -> DataFrame:
    """The first ``count`` pairs, by ids, that the hub guard holds back, and the hubs that they share.

    The first issues with a hub meet the others of their hubs; only where those have
    too few such pairs are more issues taken.
    """
    sets = stage(_hub_sets(found, limit), "hub-sets")
    members = sets.select("issue_id", F.explode("hubs").alias("hub"))
    if scope is not None:
        members = members.join(scope.select("issue_id").distinct().withColumn("inside", F.lit(True)), "issue_id", "left")
    else:
        members = members.withColumn("inside", F.lit(True))
    taken, keys = max(8, count), ["issue_id", "related_issue_id"]
    while True:
        heads = sets.orderBy("issue_id").limit(taken).select("issue_id")
        own = members.join(heads, "issue_id", "left_semi")
        later = members.select("hub", F.col("issue_id").alias("related_issue_id"), F.col("inside").alias("also"))
        pairs = own.join(later, "hub").filter("issue_id < related_issue_id AND (inside OR also)").select(*keys).distinct()
        first = pairs.join(shared.select(*keys), keys, "left_anti").orderBy(*keys).limit(count)
        first = stage(first, "guarded-pairs")
        if first.count() >= count or heads.count() < taken:
            break
        taken *= 8
    hub = found.join(hubs(found, limit).select("kind", "surface"), ["kind", "surface"], "left_semi").select("issue_id", "kind", "surface")
    left = F.broadcast(first).join(hub, "issue_id")
    both = left.join(hub.toDF("related_issue_id", "kind", "surface"), ["related_issue_id", "kind", "surface"], "left_semi")
    names = lambda kind: F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("surface")))), 1, max_evidence)
    return both.groupBy(*keys).agg(names("path").alias("suppressing_paths"), names("module").alias("suppressing_modules"))


def ordinal(column: str, values: tuple[str, ...]) -> Column:
    out = F.lit(len(values))
    for k, value in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == value, k).otherwise(out)
    return out


def collision_order() -> list[Column]:
    return [
        ordinal("kind", ("exact-file",)),
        ordinal("confidence", ("observed", "corroborated", "explicit")),
        ordinal("context_kind", ("observed-worktree", "prose", "mixed", "code-fence-only")),
        ordinal("path_presence", ("all-existing", "mixed", "all-missing", "unavailable")),
        ordinal("edit_intent", ("observed-edit", "likely-edit", "mixed", "unknown", "reference-only")),
        F.col("issue_id"),
        F.col("related_issue_id"),
    ]


def pointer_counts(pointers: DataFrame) -> DataFrame:
    """Counts by source, by context and by presence, in one pass."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("source", "context_kind", "path_presence")]))
    return pointers.select(named.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("pointers"))


def changed_paths(committed: DataFrame, working: DataFrame, untracked: DataFrame, guard: int = MAX_COMMITTED_PATHS) -> DataFrame:
    """Union of a worktree's changes; its committed ones are dropped if they are too many."""
    size = F.count("*").over(Window.partitionBy("worktree"))
    near = committed.select("worktree", "path").distinct().withColumn("n", size).filter(F.col("n") <= guard).drop("n")
    return near.union(working.select("worktree", "path")).union(untracked.select("worktree", "path")).distinct()


def worktrees(blocks: DataFrame) -> DataFrame:
    """``path, head, branch`` from porcelain blocks (one block a row in ``value``)."""
    take = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^{key} (.*)$", 1), F.lit(""))
    rows = blocks.select(take("worktree").alias("path"), take("HEAD").alias("head"), F.regexp_replace(take("branch"), "^refs/heads/", "").alias("branch"))
    return rows.filter("path IS NOT NULL")


def mappings(lines: DataFrame) -> DataFrame:
    """``issue_id, path`` of ``ID=PATH`` texts in ``value``; an empty side or an id given twice fails."""
    parts = F.split("value", "=", 2)
    side = lambda k: F.trim(F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    rows = lines.select(side(0).alias("issue_id"), side(1).alias("path"))
    count = F.count("*").over(Window.partitionBy("issue_id"))
    empty = (F.col("issue_id") == "") | (F.col("path") == "")
    fail = F.when(empty, F.raise_error(F.lit("a worktree mapping is not ID=PATH"))).when(count > 1, F.raise_error(F.concat(F.lit("a worktree is mapped twice: "), "issue_id")))
    return rows.select("issue_id", F.coalesce(fail.cast("string"), F.col("path")).alias("path"))


def check_mappings(named: DataFrame, issues: DataFrame, trees: DataFrame) -> DataFrame:
    """Mappings whose issue is under review and whose path is a worktree of one issue only; others fail."""
    faults = (
        (named.join(issues.select("issue_id"), "issue_id", "left_anti"), "a worktree mapping names an issue outside the review"),
        (named.join(trees.select("path"), "path", "left_anti"), "a mapped path is no worktree"),
        (named.groupBy("path").count().filter("count > 1"), "a mapped path belongs to another issue already"),
    )
    for rows, told in faults:
        if not rows.isEmpty():
            raise ValueError(told)
    return named


def associate_worktrees(issues: DataFrame, trees: DataFrame, named: DataFrame) -> DataFrame:
    """``issue_id, path``: which worktree (path, branch) shows an issue's observed changes.

    ``named (issue_id, path)`` comes first. Else a branch that holds an issue's id
    between separators, or ``bead-N`` for the only issue whose id ends in ``.N``,
    belongs to it if no other issue without a worktree fits the branch. Branches
    are cut at their separators and the spans joined with ids, so no issue meets
    every branch. Only the fits, of which a branch has a few, are taken in turn,
    by path, since each decides what the next may have.
    """
    ids = issues.select("issue_id", F.lower("issue_id").alias("key"), F.nullif(F.regexp_extract("issue_id", r"\.(\d+)$", 1), F.lit("")).alias("suffix"))
    ids = ids.withColumn("alike", F.count("suffix").over(Window.partitionBy("suffix")))
    first = named.join(issues.select("issue_id"), "issue_id", "left_semi").join(trees.select("path"), "path", "left_semi").select("issue_id", "path")
    free = trees.join(first.select("path"), "path", "left_anti").select("path", F.lower(F.coalesce("branch", F.lit(""))).alias("b"))
    open_ids = ids.join(first.select("issue_id"), "issue_id", "left_anti")
    parts = F.regexp_extract_all("b", F.lit(r"([^/_-]+|[/_-])"), 1)
    spans = free.select("path", "b", parts.alias("parts")).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1)))))
    spans = spans.withColumn("j", F.explode(F.sequence(F.col("i"), F.greatest(F.size("parts"), F.col("i")))))
    edge = lambda k: F.coalesce(F.get("parts", k).isin("/", "_", "-"), F.lit(True))
    spans = spans.filter(edge(F.col("i") - 2) & edge(F.col("j"))).select("path", F.array_join(F.slice("parts", F.col("i"), F.col("j") - F.col("i") + 1), "").alias("key"))
    full = spans.join(open_ids.select("issue_id", "key"), "key").select("issue_id", "path")
    numbers = free.select("path", F.explode(F.regexp_extract_all("b", F.lit(r"(?:^|[/_.-])bead[-_](\d+)(?=$|[/_.-])"), 1)).alias("suffix"))
    short = numbers.join(open_ids.filter("alike = 1").select("issue_id", "suffix"), "suffix").select("issue_id", "path")
    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        given: dict[str, str] = {}
        for path, group in pdf.sort_values(["path", "issue_id"]).groupby("path", sort=True):
            left = [i for i in group["issue_id"] if i not in given]
            if len(left) == 1:
                given[left[0]] = path
        return pd.DataFrame({"issue_id": list(given), "path": list(given.values())}, dtype=object)

    fits = full.withColumn("issue_id", F.col("issue_id").cast("string")).unionByName(short).distinct()
    return first.unionByName(fits.groupBy().applyInPandas(take, "issue_id string, path string"))


def path_presence(pointers: DataFrame, listing: DataFrame | None) -> DataFrame:
    """``path_presence`` of each pointer by the repository's file list; unavailable without one."""
    if listing is None:
        return pointers.withColumn("path_presence", F.lit("unavailable"))
    folders = listing.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("bare"))
    known = folders.distinct().withColumn("here", F.lit(True))
    rows = pointers.withColumn("bare", F.regexp_replace("path", "/+$", "")).join(known, "bare", "left")
    return rows.withColumn("path_presence", F.when(F.col("here"), "existing").otherwise("missing")).drop("bare", "here")


def in_code_fence(text: Column, position: Column) -> Column:
    """``code-fence`` where an odd number of fence lines starts before a position (from 0)."""
    fences = F.regexp_count(F.substring(text, F.lit(1), position), F.lit(r"(?m)^[ \t]*(?:```|~~~)"))
    return F.when(fences % 2 == 1, "code-fence").otherwise("prose")


def repository_context(invoked: tuple[str, str] | None, tracker: tuple[str, str] | None, asked: bool = True) -> tuple[str | None, str, str | None]:
    """(root, where it comes from, warning) of the roots and shared folders of two worktrees.

    The invoking worktree wins if it belongs to the tracker's repository.
    """
    if not asked or invoked is None:
        if tracker is None:
            return None, "unavailable", None
        return tracker[0], "tracker-workspace", "not invoked in a worktree; the tracker's is used" if asked else None
    if tracker is None:
        return invoked[0], "invocation-worktree", "the tracker is in no repository; the invoking worktree is used"
    if invoked[0] == tracker[0] or invoked[1] == tracker[1]:
        return invoked[0], "invocation-worktree", None
    return tracker[0], "tracker-workspace", "the invoking repository is not the tracker's; the tracker's is used"
