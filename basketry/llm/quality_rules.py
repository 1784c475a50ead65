"""Quality rules whose thresholds come from the data of each language and source.

Features are counted per document in one pass. Their distributions are kept as log-spaced histograms
(relative-error quantile sketches): sketches merge by adding bin counts, so they are plain grouped
sums, the same whatever the order of rows, and hot sources are combined before the shuffle. Fences
are read from the sketches per (language, source) and joined to the documents.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketry.llm.common import SPACES, map_rows, slices
from basketry.session import staged

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Ratios watched by the adaptive fences, and by how much a value must pass the upper quartile at least.
RATIOS = {"symbols_per_word": 0.25, "dup_line_share": 0.25, "repeat_word_share": 0.1, "chars_per_word": 4.0}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    grams = ids
    for step in range(1, WINDOW):
        grams = grams[:-1] * len(seen) + ids[step:] if len(seen) ** (step + 1) < 2**62 else \
            np.unique(grams, return_inverse=True)[1][:-1] * len(seen) + ids[step:]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def features_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = Counter(x for x in text.split("\n") if x.strip(SPACES))
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            sum(lines.values()) - len(lines), sum(lines.values()), repeated_words(words))


def measured_texts(texts: pa.Array, weight: int = 4_000_000) -> pa.StructArray:
    """FEATURES of every text of a batch. Only a slice of `weight` characters is held as Python strings at a time."""
    names, columns = [part.split()[0] for part in FEATURES.split(", ")], []
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), weight):
        columns.append(np.array(list(map(features_of, part.column(0).to_pylist())), np.int64))
    counted = np.concatenate(columns) if columns else np.zeros((0, len(names)), np.int64)
    return pa.StructArray.from_arrays([pa.array(c) for c in counted.T], names)


def quality_features(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
                     source: str = "source") -> DataFrame:
    """Per document the features of whole texts; a null text has none of anything."""
    def work(columns):
        return [columns[0], columns[1], columns[2], *map(list, zip(*map(features_of, columns[3])))]

    held = docs.select(F.col(id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
                       F.col(text).alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    return map_rows(held, ["doc_id", "lang", "source", "text"], f"doc_id {kind}, lang string, source string, {FEATURES}", work)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratio(name: str) -> Column:
    over = {"symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
            "repeat_word_share": ("n_repeat_words", "n_words"), "chars_per_word": ("word_chars", "n_words")}[name]
    return F.col(over[0]) / F.greatest(F.col(over[1]), F.lit(1))


def quantile_sketches(values: DataFrame, by: list[str], accuracy: float = 0.01) -> DataFrame:
    """Rows (*by, feature, bin, n) of rows (*by, feature, value >= 0): bin 0 for zero, else a power of the growth.

    Sketches of two tables merge by adding n. Any quantile read from the bins is within `accuracy`
    of the value, relatively.
    """
    growth = float(np.log((1 + accuracy) / (1 - accuracy)))
    at = F.when(F.col("value") <= 1e-9, F.lit(-1_000_000)).otherwise(F.ceil(F.log("value") / growth))
    return values.withColumn("bin", at.cast("int")).groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float], accuracy: float = 0.01) -> DataFrame:
    """Rows (*by, feature, total, *shares): nearest-rank quantiles of merged sketches, a few hundred bins per group."""
    growth = float(np.log((1 + accuracy) / (1 - accuracy)))
    merged = sketches.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "feature")
    running = merged.withColumns({
        "_run": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("n").over(group)})
    value = F.when(F.col("bin") == -1_000_000, 0.0).otherwise(
        F.exp(F.col("bin") * growth) * (2 / (1 + F.exp(F.lit(growth)))))
    return running.groupBy(*by, "feature").agg(
        F.max("_all").alias("total"),
        *[F.min(F.when(F.col("_run") >= F.ceil(F.col("_all") * s), value)).alias(k) for k, s in shares.items()])


def adaptive_verdicts(features: DataFrame, reach: float = 3.0, prior: float = 10.0,
                      accuracy: float = 0.01) -> DataFrame:
    """`features` with base_failed, n_above (fences passed) and kept.

    The upper fence of a ratio is q3 + max(reach * (q3 - q1), the ratio's least margin), with the
    quartiles of the documents of the same language and source that pass the base rule, at every size. As few
    documents tell little, quartiles of n of them count n / (n + prior), those of the language the rest, which
    are mixed with those of all documents likewise. Where the two differ, the spread is wider by a share of it.
    Null languages and sources are groups of their own; an empty table stays empty.
    """
    passed = features.where(~base_failed())
    values = passed.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(k).alias("feature"), _ratio(k).cast("double").alias("value")) for k in RATIOS])).alias("x")
    ).select("lang", "source", "x.*")
    sketches = staged(quantile_sketches(values, ["lang", "source"], accuracy).withColumn("_one", F.lit(1)), "sketches")
    shares = {"q1": 0.25, "q3": 0.75}
    def wide(by: list[str], name: str) -> DataFrame:
        by = [*by, "_one"]
        rows = sketch_quantiles(sketches, by, shares, accuracy)
        return rows.groupBy(*by).agg(F.max("total").alias(f"{name}_total"), *[
            F.max(F.when(F.col("feature") == k, F.col(q))).alias(f"{name}_{q}_{k}") for k in RATIOS for q in shares])

    groups = sketches.select("lang", "source", "_one").distinct()
    fences = groups
    for name, by in (("own", ["lang", "source"]), ("lang", ["lang"]), ("all", [])):
        other = wide(by, name).withColumnsRenamed({c: f"_{name}_{c}" for c in [*by, "_one"]})
        match = F.col("_one") == F.col(f"_{name}__one")
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"_{name}_{c}"))
        fences = fences.join(other, match, "left").drop(*[f"_{name}_{c}" for c in [*by, "_one"]])

    def fence(k: str) -> Column:
        top, spread = F.col(f"all_q3_{k}"), F.col(f"all_q3_{k}") - F.col(f"all_q1_{k}")
        for name in ("lang", "own"):
            own, n = F.col(f"{name}_q3_{k}"), F.col(f"{name}_total")
            weight = n / (n + F.lit(prior))
            spread = (weight * (own - F.col(f"{name}_q1_{k}")) + (1 - weight) * spread
                      + weight * (1 - weight) * F.abs(own - top))
            top = weight * own + (1 - weight) * top
        return top + F.greatest(reach * spread, F.lit(RATIOS[k]))

    fences = staged(fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                                  *[fence(k).alias(f"fence_{k}") for k in RATIOS]), "fences")
    judged = features.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
                           "left").drop("_lang", "_source")
    above = sum((F.coalesce(_ratio(k) > F.col(f"fence_{k}"), F.lit(False)).cast("int") for k in RATIOS), F.lit(0))
    return judged.withColumns({"base_failed": base_failed(), "n_above": above}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_above") == 0))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source and others) that the rules keep.

    Every row is judged by its own text, those with repeated ids or none too. Rows meet only the few
    fences, so texts are never shuffled, and are not written: features are counted for the fences and
    again for the verdicts, as a copy of all rows would take as much disk as `docs`. A column of any name may come along.
    """
    @F.arrow_udf(FEATURES)
    def measured(texts: pa.Array) -> pa.Array:
        return measured_texts(texts)

    once = measured.asNondeterministic()  # else filters on features are pushed below them, with a second count of all
    carried = docs.select(
        "lang", "source", once("text").alias("_features"), F.struct("*").alias("_row")).select(
        "lang", "source", "_features.*", "_row")
    return adaptive_verdicts(carried, **options).where("kept").select("_row.*")
