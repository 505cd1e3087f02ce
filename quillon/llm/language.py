"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector
machines separate the related languages within it. Features are the counts of
hashed byte trigrams of the lower-cased letters of the whole text, square-rooted
and scaled to length one. Fitting uses at most ``FIT_ROWS`` texts for each
language of the learning fold, and ``ALL_FIT_ROWS`` in all shared out evenly; every
language has at least one.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.learning import CHUNK_BYTES, bounded_batches, by_place, fit_linear, held_out, pack_row, sigmoid, unpack_rows

UNKNOWN = "und"
DIMENSIONS = 4096
FIT_ROWS = 500  # texts for each language
ALL_FIT_ROWS = 20_000  # bounds the matrix that the driver fits on, 16 kB a row
RIDGE = 1e-5
SHARPNESS = 4.0
BATCH_DOCS = 500

#: Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "lb", "fy", "sv", "da", "no", "nb", "nn", "is", "fo"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "finnic": ["fi", "et"],
    "celtic": ["ga", "gd", "cy", "br"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "pa", "gu"],
    "malayic": ["id", "ms"],
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Word characters beyond ASCII; numerals like U+00B2 and U+2167 are among them.
_ASCII_LETTER, _WORD_CHARACTER = re.compile("[A-Za-z]"), re.compile(r"[^\W\d_]")

# Bytes of letters keep their value; all others part words as a blank.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    """A language outside the table is a family of its own."""
    return _FAMILY_OF.get(lang, f"only-{lang}")


def has_letter(text: str) -> bool:
    """Whether a character is of one of Unicode's letter categories."""
    return _ASCII_LETTER.search(text) is not None or any(unicodedata.category(m[0])[0] == "L" for m in _WORD_CHARACTER.finditer(text))


def features(text: str) -> np.ndarray:
    out = np.zeros(DIMENSIONS, np.int64)
    folded = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    for at in range(0, len(folded) - 2, CHUNK_BYTES):
        data = folded[at : at + CHUNK_BYTES + 2]
        grams = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
        slots = (grams[data[1:-1] != 32] * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out += np.bincount(slots, minlength=DIMENSIONS)
    x = np.sqrt(out.astype(np.float32))
    return x / (np.linalg.norm(x) or 1.0)


@dataclass(frozen=True)
class LanguageModel:
    """Columns of ``weights``: one per family, then one per pair within families."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            if text is None or not self.families or not has_letter(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            margins = features(text) @ self.weights
            lang, score = self._decide(margins)
            langs.append(lang)
            scores.append(score)
        return langs, scores

    def _decide(self, margins: np.ndarray) -> tuple[str, float]:
        n = len(self.families)
        best = int(np.argmax(margins[:n]))
        family = self.families[best]
        others = np.delete(margins[:n], best)
        score = float(sigmoid(SHARPNESS * (margins[best] - others.max()))) if len(others) else 1.0
        votes = dict.fromkeys(self.members[family], 0)
        gap = dict.fromkeys(votes, 0.0)
        for (a, b), m in zip(self.pairs, margins[n:].tolist(), strict=True):
            if a in votes:
                votes[a if m > 0 else b] += 1
                gap[a] += m
                gap[b] -= m
        lang = max(votes, key=lambda v: (votes[v], gap[v], v))
        own = [m if a == lang else -m for (a, b), m in zip(self.pairs, margins[n:].tolist(), strict=True) if lang in (a, b)]
        return lang, score * float(sigmoid(SHARPNESS * np.array(min(own)))) if own else score


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel:
    x, y = np.asarray(x, np.float32).reshape(-1, DIMENSIONS), np.array(langs, object)
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    pairs = [(a, b) for f in families for i, a in enumerate(members[f]) for b in members[f][i + 1 :]]
    kin, columns = np.array([family_of(v) for v in y], object), []

    def machine(rows: np.ndarray, positive: np.ndarray) -> np.ndarray:
        weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
        return fit_linear(x[rows], np.where(positive, 1.0, -1.0), weight, "hinge", RIDGE, 120)

    everything = np.arange(len(y))
    columns += [machine(everything, kin == f) for f in families]
    for a, b in pairs:
        rows = np.flatnonzero((y == a) | (y == b))
        columns.append(machine(rows, y[rows] == a))
    weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS, 0))
    return LanguageModel(families, members, pairs, weights.astype(np.float32))


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on texts of every known language outside the held-out fold.

    The sample has ``fit_rows`` rows for each language, fewer where they would be
    more than ``ALL_FIT_ROWS``, chosen by hash of the id and read by a join with
    the chosen ids; one text for each id and language, as sparse counts, so an id
    that many rows have takes one place.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")).collect()
    if not counts:
        return fit(np.zeros((0, DIMENSIONS)), [])
    fit_rows = max(1, min(fit_rows, ALL_FIT_ROWS // len(counts)))
    shares = [(r.lang, min(1.0, 1.5 * (fit_rows + 30) / max(1, r.ids))) for r in counts]
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    few = known.select("doc_id", "lang", place.alias("place")).join(shares, "lang").filter(F.col("place") < F.col("share")).distinct()
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    few = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= fit_rows).select("doc_id", F.col("lang").alias("known"))
    chosen = F.broadcast(few.groupBy("doc_id").agg(F.min("known").alias("known")))
    rows = docs.select("doc_id", "lang", F.col("text").cast("string")).join(chosen, "doc_id").filter("lang = known AND text IS NOT NULL")
    rows = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in batches:
            made = [pack_row(features(t)) if has_letter(t) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(made, pa.binary())], ["doc_id", "lang", "x"])

    sent = rows.select(F.col("doc_id").cast("long"), "lang", "text")
    got = sent.mapInArrow(run, "doc_id long, lang string, x binary").filter("x IS NOT NULL").collect()
    got.sort(key=lambda r: (r.lang, r.doc_id, bytes(r.x)))
    return fit(unpack_rows([bytes(r.x) for r in got], DIMENSIONS), [r.lang for r in got])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Repeated rows stay; other columns may have any names.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                langs, scores = model.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    sent = bounded_batches(docs).select("doc_id", F.col("text").cast("string"))
    found = sent.mapInArrow(run, f"doc_id {sent.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def classify(docs: DataFrame) -> DataFrame:
    """Learn from the table's own labels and predict every row.

    Whole texts are read, however long; a null text or one without a letter is
    ``und``. An empty table gives no rows, and where no row has a language all are
    ``und``. Repeated rows are predicted each; a null ``doc_id`` is not held out
    and not learned from; columns with other names are not read.
    """
    return identify(docs, train(docs))


def filter_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows, all columns, whose text has a language (not ``und``).

    Null and letterless texts go; null or repeated ids, repeated rows and columns
    of any name stay as they are; an empty table stays empty.
    """
    renamed, text = by_place(docs)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                yield batch.filter(pa.array([lang != UNKNOWN for lang in model.predict(batch.column(text).to_pylist())[0]], pa.bool_()))

    return renamed.mapInArrow(run, kinds).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
