"""Quality rules by distribution divergence, in DataFrame functions only.

Counting rules come first: too few words, or too many words inside repeated eight-word windows. What
passes is compared with its language: the document's histogram of character classes, and that of the
language's commonest words against all others, each by Jensen-Shannon distance (base 2, 0 to 1) from
the language's reference. Short documents are no fair sample of a distribution, so the comparison has a
minimum length, and the allowed distance of the words' histogram shrinks with length as sampling noise does.

References are the mean histograms of all documents of a language that have the minimum length and aren't
mostly symbols or capitals: one aggregation, one row per listed language and one for the rest, so what
comes to the driver is bounded by the list. They can be given instead.

Texts are measured once, where they lie; nothing is shuffled but those few rows. Windows are compared by 64-bit
hashes within a document, by sorting, so a document with many repeats takes n log n.

Defined cases: a null text has no words and fails; a null or unlisted language uses the pooled reference
of the rest, by character classes only, or, where there is none, passes. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import materialize

# Common words by language.
COMMON = {
    "en": "the of and to a in is that for it as was",
    "de": "der die und in den von zu das mit sich des auf",
    "fr": "de la le et les des en un une du est que",
    "es": "de la que el en y a los se del las un",
}
# Fixed values end.

_SPACE = "[ \\t\\n\\x0B\\f\\r]"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: What is taken out of a text in turn; the class that each step counts to. What stays is of class 5.
STEPS = [("[a-z]+", 0), (_SPACE + "+", 1), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", 0), (r"\p{Lu}+", 2), (r"\p{N}+", 3), (r"[.,;:!?'\"()\-]+", 4)]
N_CLASSES = 6

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _once(column: Column) -> Column:
    """The same column, but not deterministic to the optimizer, so no filter is pushed below its
    projection with a copy of all that it rests on, and it is worked out once a row."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def measure(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", keep: list[str] | None = None, width: int = 8) -> DataFrame:
    """Counts and histograms of every row: row (a struct of the columns ``keep``, all by default), lang
    ("" if not listed), MEASURES, chars (by class) and words (of the language's common words, then all others)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    row = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)])
    out = docs.select(row.alias("row"), text.alias("text"), F.when(lang.isin(*COMMON), lang).otherwise("").alias("lang"), _once(words).alias("w"))
    out = out.withColumn("n", F.size("w")).withColumn("g1", F.transform("w", lambda w: F.xxhash64(w)))
    step, left = 1, "g1"
    while step < width:  # hashes of runs of 2, 4, ... words; a run past the end pairs with null and is cut off below
        out = out.withColumn(f"g{2 * step}", F.zip_with(left, F.slice(left, step + 1, F.size(left)), lambda a, b: F.xxhash64(a, b)))
        step, left = 2 * step, f"g{2 * step}"
    hashes, ordered, covered = _repeats(left, width)
    out = out.withColumn("hashes", hashes).withColumn("ordered", ordered)

    sizes, left = [F.length("text")], "text"
    for k, (pattern, _) in enumerate(STEPS):
        out = out.withColumn(f"l{k}", F.regexp_replace(left, pattern, ""))
        left = f"l{k}"
        sizes.append(F.length(left))
    counts = [F.lit(0)] * (N_CLASSES - 1) + [sizes[-1]]
    for (_, c), before, after in zip(STEPS, sizes, sizes[1:], strict=False):
        counts[c] = counts[c] + before - after

    letters, n_common = F.lit(None).cast("string"), max(len(x.split()) for x in COMMON.values())
    for name, listed in COMMON.items():  # a letter for each common word, so that counting them is plain string work
        own = F.array(*map(F.lit, listed.split()))
        letters = F.when(F.col("lang") == name, _codes(own)).otherwise(letters)
    out = out.withColumn("c", F.filter(F.transform("w", lambda w: F.lower(w)), lambda w: w.isin(*sorted({x for listed in COMMON.values() for x in listed.split()}))))
    out = out.withColumn("s", letters)
    bins = [F.length("s") - F.length(F.replace(F.col("s"), F.lit(x), F.lit(""))) for x in _LETTERS[:n_common]]
    bins = F.when(F.col("s").isNotNull(), F.array(*[b.cast("double") for b in bins], (F.col("n") - F.length("s")).cast("double")))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\x0B\\f\\r]"))
    out = out.withColumn("lines", lines)
    return out.select(
        "row",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(left, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        _once(F.array(*[c.cast("double") for c in counts])).alias("chars"),
        bins.alias("words"),
    )


def _codes(common: Column) -> Column:
    """The letters of the words in c that are common in one language."""
    return F.array_join(F.transform("c", lambda w: F.substring(F.lit(_LETTERS), F.array_position(common, w).cast("int"), F.when(F.array_contains(common, w), 1).otherwise(0))), "")


def _share(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(histogram, lambda x: x / total))


def references(measured: DataFrame, min_words: int = 50) -> dict[str, dict[str, list[float]]]:
    """By language ("" for the rest): the mean histograms of measured rows, "chars" and, for a listed language, "words"."""
    rows = measured.filter(F.col("n_words") >= min_words)
    rows = rows.select("lang", _once(_share(F.col("chars"))).alias("c"), _share(F.col("words")).alias("w")).filter((F.col("c")[5] < 0.1) & (F.col("c")[2] < 0.3))
    n_bins = 1 + max(len(x.split()) for x in COMMON.values())
    means = [F.avg(F.col("c")[i]).alias(f"c{i}") for i in range(N_CLASSES)] + [F.avg(F.col("w")[i]).alias(f"w{i}") for i in range(n_bins)]
    out = {}
    for row in rows.groupBy("lang").agg(*means).collect():  # a row per listed language and one for the rest
        words = [row[f"w{i}"] for i in range(n_bins)]
        out[row["lang"]] = {"chars": [row[f"c{i}"] for i in range(N_CLASSES)]} | ({} if words[0] is None else {"words": words})
    return out


def _distance(share: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of shares from a fixed one."""

    def terms(p: Column, q: Column) -> Column:
        mid = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
        return (part(p) + part(q)) / 2

    both = F.zip_with(share, F.array(*[F.lit(float(x)) for x in reference]), terms)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _repeats(runs: str, width: int) -> tuple[Column, Column, Column]:
    """In turn: hashes of all windows; those found twice or more with their places, sorted; the words in them."""
    hashes = F.when(F.col("n") > width, F.slice(runs, 1, F.greatest(F.col("n") - width + 1, F.lit(0))))
    ordered = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    )
    twin = lambda k: (F.get("ordered", k)["h"] == F.get("ordered", k - 1)["h"]) | (F.get("ordered", k)["h"] == F.get("ordered", k + 1)["h"])
    same = F.filter(F.sequence(F.lit(0), F.size("ordered") - 1), lambda k: F.coalesce(twin(k), F.lit(False)))
    places = F.sort_array(F.transform(same, lambda k: F.get("ordered", k)["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["end"])).alias("n"), (p + width).alias("end")))["n"]
    return hashes, ordered, F.when(F.col("ordered").isNull(), 0).otherwise(covered)


ADDED = (*MEASURES, "base_failed", "char_distance", "word_distance", "kept")


def score_quality(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    refs: dict[str, dict[str, list[float]]] | None = None,
    keep: list[str] | None = None,
    min_words: int = 50,
    max_char_distance: float = 0.25,
    max_word_distance: float = 0.45,
    noise: float = 3.0,
    max_both: tuple[float, float] = (0.15, 0.28),
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns ADDED, which win over columns of the same names.

    ``kept``: no counting rule failed, and the document is shorter than ``min_words`` or within
    ``max_char_distance`` and ``max_word_distance`` + ``noise`` / sqrt(words) of its language, and not
    beyond both distances of ``max_both`` at once. Without ``refs`` the measured rows are written to the
    shared folder, so that texts are read once for references and verdicts.
    """
    rows = measure(docs, text_col, lang_col, keep)
    if refs is None:
        rows = materialize(rows, "quality-measures")
        refs = references(rows, min_words)
    char, word = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, own in refs.items():
        char = F.when(F.col("lang") == name, _distance(_share(F.col("chars")), own["chars"])).otherwise(char)
        if "words" in own:
            word = F.when(F.col("lang") == name, _distance(_share(F.col("words")), own["words"])).otherwise(word)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("char_distance", _once(char)).withColumn("word_distance", word)
    far = (F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance + noise / F.sqrt("n_words"))
    far = far | ((F.col("char_distance") > max_both[0]) & (F.col("word_distance") > max_both[1]))
    kept = ~F.col("base_failed") & ((F.col("n_words") < min_words) | ~F.coalesce(far, F.lit(False)))
    rows = rows.withColumn("kept", _once(kept))
    names = docs.columns if keep is None else keep
    return rows.select(*[F.col("row")[c].alias(c) for c in names if c not in ADDED], *ADDED)


def keep_quality(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected; all columns stay."""
    wrapped = docs.select(F.struct("*").alias("__own"), *[F.col(c) for c in {options.get("text_col", "text"), options.get("lang_col", "lang")} if c])
    return score_quality(wrapped, keep=["__own"], **options).filter("kept").select("__own.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return score_quality(docs, keep=["doc_id"])
