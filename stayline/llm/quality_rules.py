"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every document gets counted statistics. Within each (language, source) the minimum
covariance determinant method estimates centre and covariance of three transformed
statistics from the most central part of the group; a document is rejected when its
squared Mahalanobis distance from that centre exceeds a cutoff.

Statistics are integers in units of 1/1024, so group sums are exact integers and do not
depend on the order in which executors deliver them. The central part is found from
counts per distance class, never by sorting a group, so a source that holds a third of
all rows costs what its rows cost.

Defined results: a null text counts as empty; a null language or source is a group of
its own; documents that fail the base rule take no part in estimates. A group of fewer than
``MIN_GROUP`` documents that pass it is judged by the estimate of its language, and failing
that by the estimate of the whole corpus, which is made however small it is. Repeated rows
are judged row by row. An empty table gives an empty
result. Input columns are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayline.llm.common import WORD, as_row, keep

#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = r"[#*$%&|<>]"

UNIT = 1024
MIN_GROUP = 30
STEPS = 4
#: Share of a group taken as its central part.
CENTRAL = 0.75
#: Least standard deviation of each statistic, in UNITs: spelling and rounding noise.
FLOORS = (0.25 * UNIT, 0.15 * UNIT, 0.25 * UNIT)
#: Squared distance beyond which a document is rejected.
CUTOFF = 100.0
#: Words of ordinary length added to each text before its mean word length is taken.
PSEUDO_WORDS, PSEUDO_LENGTH = 20, 5
#: Median of the chi-squared distribution with three degrees of freedom.
CHI2_MEDIAN = 2.366
_CLASSES_PER_OCTAVE = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _in_order(grams: Column) -> Column:
    """(hash, position) in order where some hash occurs twice, else null."""
    pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(pairs))


def _twice(order: Column) -> Column:
    """Positions of the windows that have an equal neighbour in the sorted array."""
    marked = F.transform(
        order,
        lambda x, i: F.when(
            F.coalesce(F.get(order, i - 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get(order, i + 1)["g"] == x["g"], F.lit(False)),
            x["i"],
        ),
    )
    return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))


def _covered(starts: Column) -> Column:
    """Size of the union of windows that begin at the ascending ``starts``."""
    reach = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WINDOW).alias("last")),
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(REPEAT_WINDOW), p - a["last"])).alias("n"), p.alias("last")
        ),
    )
    return reach["n"]


def with_statistics(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (see ``as_row``), the five counts of ``COUNTS`` and ``base_failed``."""
    given = docs.select(as_row(docs, carry), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    split = given.select(
        "row", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), lines.alias("lines"),
        F.regexp_count("t", F.lit(SYMBOLS)).alias("n_symbols"),
    )
    hashed = split.select(
        "row", "n_symbols", F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    h = F.col("h")
    windows = F.transform(
        h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, REPEAT_WINDOW)])
    )
    windowed = hashed.select(
        "row", *COUNTS[:4],
        F.slice(windows, F.lit(1), F.greatest(F.size("h") - (REPEAT_WINDOW - 1), F.lit(0))).alias("grams"),
    )
    # Each array is a column of its own, so no lambda works it out anew for every element.
    ordered = windowed.select("row", *COUNTS[:4], _in_order(F.col("grams")).alias("pairs"))
    counted = ordered.select(
        "row", *COUNTS[:4],
        F.coalesce(_covered(_twice(F.col("pairs"))), F.lit(0)).alias("n_repeat_words"),
    )
    longs = counted.select("row", *[F.col(c).cast("long").alias(c) for c in COUNTS])
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return longs.withColumn("base_failed", failed)


def _unit(value: Column) -> Column:
    return F.round(value * UNIT).cast("long")


def with_points(counted: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``counted`` with its group ``g0``, ``g1`` and the transformed statistics ``x0``,
    ``x1``, ``x2`` in UNITs."""
    words, chars = F.col("n_words"), F.col("word_chars")
    length = (chars + PSEUDO_WORDS * PSEUDO_LENGTH) / (words + PSEUDO_WORDS)
    symbols = 1 + 100 * F.col("n_symbols") / F.greatest(chars, F.lit(1))
    return counted.withColumns({
        **{g: F.col("row")[k] for g, k in zip(_GROUP[1:], keys)}, "x0": _unit(F.log1p(words)), "x1": _unit(length), "x2": _unit(F.log2(symbols)),
    })


_X, _GROUP = ("x0", "x1", "x2"), ("level", "g0", "g1")
_PAIRS = tuple((i, j) for i in range(3) for j in range(i, 3))


def _levels(points: DataFrame) -> DataFrame:
    """Every point three times: in its group, in its language (level 1) and in the corpus."""
    none = [F.lit(None).cast(points.schema[g].dataType) for g in _GROUP[1:]]
    given = [F.col(g) for g in _GROUP[1:]]
    keys = (given, [given[0], none[1]], none)
    each = F.array(*[
        F.struct(F.lit(n).alias("level"), *[k.alias(g) for k, g in zip(own, _GROUP[1:])]) for n, own in enumerate(keys)])
    return points.select(F.explode(each).alias("k"), *_X).select("k.*", *_X)


def _joined(points: DataFrame, parameters: DataFrame, how: str) -> DataFrame:
    """Rows beside the parameters of their group; null keys meet null keys."""
    right = parameters.withColumnsRenamed({g: f"of_{g}" for g in _GROUP})
    same = [points[g].eqNullSafe(right[f"of_{g}"]) for g in _GROUP]
    return points.join(right, same, how).drop(*[f"of_{g}" for g in _GROUP])


def _distance() -> Column:
    """Squared distance from the centre ``m*`` under the inverse covariance ``v**``."""
    e = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1 if i == j else 2) * e[i] * e[j] * F.col(f"v{i}{j}")
    return total


def _class(distance: Column) -> Column:
    """Distance classes, even on a logarithmic scale."""
    return F.floor(_CLASSES_PER_OCTAVE * F.log2(1 + F.greatest(distance, F.lit(0.0))))


def _inverse(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """Inverse of a symmetric 3 x 3 matrix by cofactors."""
    c = lambda i, j: cov[(min(i, j), max(i, j))]

    def cofactor(i: int, j: int) -> Column:
        rows, cols = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        value = c(rows[0], cols[0]) * c(rows[1], cols[1]) - c(rows[0], cols[1]) * c(rows[1], cols[0])
        return value if (i + j) % 2 == 0 else -value

    det = c(0, 0) * cofactor(0, 0) + c(0, 1) * cofactor(0, 1) + c(0, 2) * cofactor(0, 2)
    return {f"v{i}{j}": cofactor(i, j) / det for i, j in _PAIRS}


def _estimate(points: DataFrame) -> DataFrame:
    """Centre and inverse covariance per group, from exact integer sums."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = points.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        *[exact(F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)],
        *[exact(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i, j in _PAIRS],
    )
    means = sums.select(
        *_GROUP, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(3)],
        *[(F.col(f"s{i}{j}") / F.col("n")).alias(f"q{i}{j}") for i, j in _PAIRS],
    )
    cov = {
        (i, j): F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for i, j in _PAIRS
    }
    return means.select(
        *_GROUP, "m0", "m1", "m2", *[v.alias(k) for k, v in _inverse(cov).items()]
    )


def _start(points: DataFrame) -> DataFrame:
    """Medians and median deviations, as the first centre and (diagonal) covariance."""
    centres = points.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile(F.col(x), 0.5).alias(f"m{i}") for i, x in enumerate(_X)],
    ).where((F.col("n") >= MIN_GROUP) | (F.col("level") == 2))
    spread = _joined(points, centres, "inner").groupBy(*_GROUP, "m0", "m1", "m2").agg(
        *[F.percentile(F.floor(F.abs(F.col(x) - F.col(f"m{i}"))), 0.5).alias(f"d{i}") for i, x in enumerate(_X)]
    )
    scale = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i])) for i in range(3)]
    return spread.select(
        *_GROUP, "m0", "m1", "m2",
        *[(1 / (scale[i] * scale[i]) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _PAIRS],
    )


def _at_share(points: DataFrame, share: float) -> DataFrame:
    """The distance class below which ``share`` of each group lies."""
    return points.groupBy(*_GROUP).agg(
        F.ceil(F.percentile(F.col("class"), share)).alias("limit")
    )


def estimates(points: DataFrame) -> DataFrame:
    """Per group of enough rows: centre, inverse covariance and scale of the distances.

    ``points`` should be a written table, as it is read twice in each of ``STEPS`` steps.
    """
    fitted = keep(_start(points), "mcd")
    for _ in range(STEPS):
        classed = _joined(points, fitted, "inner").withColumn("class", _class(_distance()))
        limits = keep(_at_share(classed, CENTRAL), "mcd")
        central = _joined(classed, limits, "inner").where(F.col("class") <= F.col("limit"))
        fitted = keep(_estimate(central), "mcd")
    classed = _joined(points, fitted, "inner").withColumn("class", _class(_distance()))
    middle = _at_share(classed, 0.5)
    median = F.pow(F.lit(2.0), F.col("limit") / _CLASSES_PER_OCTAVE) - 1
    return keep(
        _joined(fitted, middle, "inner").withColumn(
            "scale", F.least(F.lit(1.0), CHI2_MEDIAN / F.greatest(median, F.lit(CHI2_MEDIAN)))
        ).drop("limit"),
        "mcd",
    )


def judge(counted: DataFrame) -> DataFrame:
    """A written table of ``with_points`` as ``row``, counts, ``base_failed``, ``distance``
    and ``kept``. It has to be written: a filter on the verdict would else be worked out
    inside the scan, from the text anew for every statistic.
    """
    passed = counted.where(~F.col("base_failed")).select(*_GROUP[1:], *_X)
    fitted = estimates(keep(_levels(passed), "levels"))
    parameters = F.struct(*[c for c in fitted.columns if c not in _GROUP]).alias("p")
    measured = counted.withColumn("_one", F.lit(1))
    # The finest level that has an estimate counts.
    for level, keys in enumerate((_GROUP[1:], _GROUP[1:2], ())):
        right = fitted.where(F.col("level") == level).select(
            F.lit(1).alias("of_one"), *[F.col(k).alias(f"of_{k}") for k in keys], parameters.alias(f"p{level}"))
        same = [measured["_one"] == right["of_one"], *[measured[k].eqNullSafe(right[f"of_{k}"]) for k in keys]]
        measured = measured.join(right, same, "left").drop("of_one", *[f"of_{k}" for k in keys])
    chosen = measured.withColumn("p", F.coalesce("p0", "p1", "p2")).select(*counted.columns, "p.*")
    judged = chosen.withColumn("distance", _distance() * F.col("scale"))
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return judged.withColumn("kept", verdict).select("row", *COUNTS, "base_failed", "distance", "kept")
