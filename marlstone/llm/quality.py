"""Quality rules: base rules and robust multivariate outliers, in DataFrame operations only.

Base rules look at a text alone: fewer than 50 words, or more than half of its words inside repeated
three-word windows, fail. The texts that pass are compared with those of their language and
source. Their statistics (see ``FEATURES``) get a robust centre and scatter by the minimum covariance
determinant: of all subsets with the share ``CORE`` of a group, that whose scatter has the least determinant. It is sought
from three deterministic starts: medians with quartile ranges, medians with the scatter of directions (spatial signs),
and the plain mean and scatter. A concentration step keeps the ``CORE`` with the smallest Mahalanobis distances and
estimates centre and scatter from these again. After ``FIRST_STEPS`` of them the start with the least determinant is
kept, and a group takes steps as long as one lowers its determinant by more than ``SETTLED`` of itself, ``MOST_STEPS`` in all at most; groups that
have settled take no further part. A text whose squared distance exceeds ``CUTOFF`` is rejected.

Scatters are regularised: they have the squares of small floors added to their variances, in determinants too. Floors keep them regular where most texts of a
group have the same value, say no symbol at all, and lie well below the spread of length and word length.
The core's scatter is too small for the group, so distances are scaled until their median is that of a chi-squared
distribution; its degrees of freedom are the statistics that vary in the core, each counted by
the share of its variance that is not the floor's. ``CUTOFF`` is a quantile of that distribution for all five.

A group needs some texts for an estimate: one of fewer than ``least`` texts is pooled with the other small ones of its language,
and if these are still too few, with all of the small rest. ``pooled`` says so in each row.

How it is distributed: every text is read once; its statistics, a few numbers, are written to the shared folder,
and the steps read these alone. A step is one pass: counts and moments are summed per group, start and bin of distances
before the shuffle, so that a group with a third of all rows sends one row per task and
bin, and the moments of the core are those of its bins. A bin is a 32nd of a doubling of the distance; the core ends with a whole bin.
The estimates, one row per group, are broadcast if they are counted to be at most ``MOST_BROADCAST``; beyond that Spark joins them as it sees fit. The driver sees one number a step.

Defined results: null, empty and blank texts have no words, zero counts and fail; a very long text is one row like any
other, whose windows must fit in one task; null languages and
sources are groups of their own; ids are never used, so null or repeated ids are rows like any others; an empty
table gives an empty result. Input columns other than the named ones are carried through or ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, delete_written, fresh, materialize, table, words, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Statistic and its floor, added to its variance as a square.
FEATURES = {
    "ln(1 + n_words)": 0.2,
    "ln(1 + word_chars / greatest(n_words, 1))": 0.02,
    "n_symbols / greatest(word_chars, 1)": 0.004,
    "n_dup_lines / greatest(n_lines, 1)": 0.04,
    "n_repeat_words / greatest(n_words, 1)": 0.04,
}
CORE, LEAST = 0.6, 60
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 20, 1e-3
#: The 0.9999 quantile of the chi-squared distribution with five degrees of freedom, one for each statistic.
CUTOFF = 25.745
#: Bins of the squared distance in a doubling of it.
BINS = 32
#: Distances below it are in one bin.
LEAST_D2 = 2.0**-10
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
P = len(FEATURES)


def base_statistics(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """``docs`` with a struct ``out`` of the base counts, n_lines and base_failed."""
    length = lambda c: F.length(c).cast("long")
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    # Each step is a projection of its own: an array that a lambda looks into must exist before.
    one = docs.select("*", filled.alias("_t"), words(text).alias("_w"), lines.alias("_l"))
    two = one.withColumn("_h", F.expr("if(size(_w) < 3, array(), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    # Where all windows differ, as in most texts, there is nothing to sort.
    three = two.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), array(), sort_array(transform(_h, (h, i) -> struct(h as h, i as i))))")).drop("_h")
    four = three.withColumn(
        "_r",
        F.expr("filter(_s, (x, k) -> (k > 0 and _s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(_s) and _s[least(k + 1, size(_s) - 1)].h = x.h))"),
    )
    repeated = F.expr(
        "aggregate(sort_array(transform(_r, x -> x.i)), struct(-3 as last, 0L as n), "
        "(a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n)"
    )
    five = four.select(
        *docs.columns,
        F.size("_w").cast("long").alias("_n"),
        length(F.translate("_t", BLANKS, "")).alias("_wc"),
        (length(F.col("_t")) - length(F.translate("_t", SYMBOLS, ""))).alias("_sy"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_d"),
        F.size("_l").cast("long").alias("_nl"),
        repeated.alias("_rw"),
    )
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("_rw") > MAX_REPEAT_PERCENT * F.col("_n"))
    return five.select(
        *docs.columns,
        F.struct(
            F.col("_n").alias("n_words"),
            F.col("_wc").alias("word_chars"),
            F.col("_sy").alias("n_symbols"),
            F.col("_d").alias("n_dup_lines"),
            F.col("_rw").alias("n_repeat_words"),
            F.col("_nl").alias("n_lines"),
            failed.alias("base_failed"),
        ).alias(out),
    )


#: Rows of a table per group, about 400 bytes each, that are broadcast; larger ones are left to Spark.
MOST_BROADCAST = 50_000


def _small(written_table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is known to be small; else a busy group would deal its rows to one task."""
    return F.broadcast(written_table) if written_table.count() <= MOST_BROADCAST else written_table


def _x(i: int) -> Column:
    return F.col(f"x{i}")


#: Names of the sums of a group of rows, and of a fit: centre m*, scatter factor l*_*, logarithm of its determinant, degrees of freedom.
_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i in range(P) for j in range(i + 1)]]
_FIT = [*[f"m{i}" for i in range(P)], *[f"l{i}_{j}" for i in range(P) for j in range(i + 1)], "lndet", "freedom"]


def _moments(x: list[Column]) -> list[Column]:
    out = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]]
    return out + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)]


def _fit(sums: DataFrame, *keep: str, centre: str = "s{i} / n", spread: str = "") -> DataFrame:
    """The fit of sums; ``centre`` and ``spread`` (of a scatter that is only a shape) are SQL with {i} for the statistic.

    Each name is used by the next ones in one projection; Catalyst lays them out in steps.
    """
    floors, pairs = list(FEATURES.values()), [(i, j) for i in range(P) for j in range(i + 1)]
    steps = [f"{centre.format(i=i)} AS m{i}" for i in range(P)] + [f"s{i} / n AS a{i}" for i in range(P)]
    steps += [f"s{i}_{j} / n - a{i} * a{j} AS c{i}_{j}" for i, j in pairs]
    c = "c"
    if spread:
        steps += [f"{spread.format(i=i)} / sqrt(greatest(c{i}_{i}, 1e-12D)) AS k{i}" for i in range(P)]
        steps += [f"c{i}_{j} * k{i} * k{j} AS d{i}_{j}" for i, j in pairs]
        c = "d"
    for i, j in pairs:
        rest = f"{c}{i}_{j}" + (f" + {floors[i] ** 2!r}D" if i == j else "") + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        steps.append(f"sqrt(greatest({rest}, 1e-12D)) AS l{i}_{i}" if i == j else f"({rest}) / l{j}_{j} AS l{i}_{j}")
    steps.append(" + ".join(f"2 * ln(l{i}_{i})" for i in range(P)) + " AS lndet")
    varies = " + ".join(f"1 - {floors[i] ** 2!r}D / greatest({c}{i}_{i} + {floors[i] ** 2!r}D, {floors[i] ** 2!r}D)" for i in range(P))
    steps.append(f"greatest(1D, {varies}) AS freedom")
    return sums.selectExpr(*keep, *steps).select(*keep, *_FIT)


def _distance(rows: DataFrame, fit: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance to each fit of their group."""
    steps = [f"(x{i} - m{i}{''.join(f' - l{i}_{k} * z{k}' for k in range(i))}) / l{i}_{i} AS z{i}" for i in range(P)]  # forward substitution
    steps.append(" + ".join(f"z{i} * z{i}" for i in range(P)) + " AS d2")
    return rows.join(fit, "grp", how).selectExpr("*", *steps).drop(*_FIT, *[f"z{i}" for i in range(P)])


def _step(rows: DataFrame, fit: DataFrame, core: float) -> DataFrame:
    """One concentration step: ``fit`` (grp, start, ...) as it was in ``was``, with the bin of its median distance, and the next fit."""
    bins = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(LEAST_D2))) * BINS).cast("int").alias("bin")
    counted = _distance(rows, _small(fit.select("grp", "start", *_FIT))).groupBy("grp", "start", bins).agg(*_moments([_x(i) for i in range(P)]))
    lane = Window.partitionBy("grp", "start")  # one row per bin, about a thousand of them whatever the rows
    counted = counted.withColumn("up", F.sum("n").over(lane.orderBy("bin"))).withColumn("all", F.sum("n").over(lane))
    inside = F.col("up") - F.col("n") < F.col("all") * core
    sums = [F.sum(F.when(inside, F.col(c))).alias(c) for c in _SUMS]
    middle = F.min(F.when(2 * F.col("up") >= F.col("all"), F.col("bin"))).alias("middle")
    new = _fit(counted.groupBy("grp", "start").agg(*sums, middle), "grp", "start", "middle")
    was = fit.select("grp", "start", F.struct(*_FIT).alias("was"))
    return new.join(was, ["grp", "start"])


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, fit): the three starts of every group."""
    quartiles = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)])
    quartiles = _small(materialize(quartiles, "quality-fit"))
    floors = list(FEATURES.values())
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floors[i]))
    off = [(_x(i) - F.col(f"q{i}")[1]) / spread(i) for i in range(P)]
    held = rows.join(quartiles, "grp").select("grp", *[_x(i) for i in range(P)], *[c.alias(f"o{i}") for i, c in enumerate(off)])
    held = held.withColumn("o", F.sqrt(sum((F.col(f"o{i}") * F.col(f"o{i}") for i in range(P)), F.lit(0.0))))
    signs = [F.when(F.col("o") > 0, F.col(f"o{i}") / F.col("o")).otherwise(0.0) for i in range(P)]
    sums = held.groupBy("grp").agg(F.struct(*_moments([_x(i) for i in range(P)])).alias("plain"), F.struct(*_moments(signs)).alias("signs"))
    sums = sums.join(quartiles.select("grp", *[F.col(f"q{i}")[1].alias(f"q{i}") for i in range(P)], *[spread(i).alias(f"r{i}") for i in range(P)]), "grp")
    # Directions without their products are the quartile start.
    none = {"n": F.lit(1.0)} | {c: F.lit(1.0 if c[1] == c[-1] and "_" in c else 0.0) for c in _SUMS[1:]}
    alone = sums.select("grp", F.lit(0).alias("start"), *[F.col(f"q{i}") for i in range(P)], *[F.col(f"r{i}") for i in range(P)], *[v.alias(k) for k, v in none.items()])
    shapes = sums.select("grp", F.lit(1).alias("start"), *[F.col(f"q{i}") for i in range(P)], *[F.col(f"r{i}") for i in range(P)], *[F.col("signs")[c].cast("double").alias(c) for c in _SUMS])
    plain = sums.select("grp", F.lit(2).alias("start"), "plain.*")
    given = {"centre": "q{i}", "spread": "r{i}"}
    return _fit(alone.unionByName(shapes), "grp", "start", **given).unionByName(_fit(plain, "grp", "start"))


def estimates(rows: DataFrame, *, core: float = CORE, most_steps: int = MOST_STEPS) -> DataFrame:
    """Minimum-covariance-determinant fit of every group in ``rows`` (grp, x0..), its lndet, start and scale."""
    spark, since = rows.sparkSession, len(written)
    fit, done = materialize(_starts(rows), "quality-fit"), None
    for step in range(1, most_steps + 1):
        new = _step(rows, fit, core)
        if step < FIRST_STEPS:
            fit = materialize(new.select("grp", "start", *_FIT), "quality-fit")
        elif step == FIRST_STEPS:
            best = F.min_by(F.struct("start", *_FIT), F.struct("lndet", "start")).alias("best")
            fit = materialize(new.groupBy("grp").agg(best).select("grp", "best.*"), "quality-fit")
        else:
            settled = (F.col("lndet") > F.col("was.lndet") - SETTLED) | F.lit(step == most_steps)
            new = materialize(new.withColumn("settled", settled), "quality-fit")
            ended = new.where("settled").select("grp", "start", "middle", "was.*")
            done = ended if done is None else done.unionByName(ended)
            fit = new.where("not settled").select("grp", "start", *_FIT)
            if fit.isEmpty():
                break
    done = materialize(done, "quality-fit")
    delete_written(spark, since=since, keep=1)
    freedom = F.col("freedom")
    median = freedom * F.pow(1 - 2 / (9 * freedom), F.lit(3.0))  # Wilson and Hilferty's approximation
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("middle") + 1) / BINS) / median)
    return done.select("grp", "start", *_FIT, scale.alias("scale"))


def judge(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carry: list[str] | None = None,
    out: str = "quality",
    least: int = LEAST,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """``docs`` with a struct ``out``: the base counts, base_failed, distance, pooled and kept.

    The columns ``carry`` (all, if None) go to the shared folder once, with the statistics,
    and are those of the result.
    """
    q = "_quality"
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    kept = docs.columns if carry is None else carry
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(text_col).alias("_text"), part(lang_col).alias("_lang"), F.concat_ws("\x1f", part(lang_col), part(source_col)).alias("_full"))
    measured = base_statistics(held, F.col("_text"), q).drop("_text")
    measured = materialize(measured, "quality-rows")

    passed = F.expr(f"not {q}.base_failed")
    counts = measured.where(passed).groupBy("_full", "_lang").agg(F.count("*").alias("n"))
    small = F.col("n") < least
    rest = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("_lang"))  # one row per group of the language
    groups = counts.withColumn("rest", rest).select(
        "_full", small.alias("pooled"), F.when(~small, F.col("_full")).when(F.col("rest") >= least, F.col("_lang")).otherwise(F.lit("")).alias("grp")
    )
    groups = _small(materialize(groups, "quality-groups"))
    features = [F.expr(f.replace("n_", f"{q}.n_").replace("word_chars", f"{q}.word_chars")).cast("double").alias(f"x{i}") for i, f in enumerate(FEATURES)]
    placed = measured.join(groups, "_full", "left")
    fit = _small(estimates(placed.where(passed).select("grp", *features)))
    final = _distance(placed.select("_row", q, "grp", "pooled", *features), fit, "left")
    verdict = passed & F.coalesce(F.col("d2") <= cutoff * F.col("scale"), F.lit(False))
    return final.select(
        *[F.col("_row")[c].alias(c) for c in kept if c != out],
        F.struct(F.col(f"{q}.*"), (F.col("d2") / F.col("scale")).alias("distance"), F.coalesce("pooled", F.lit(False)).alias("pooled"), verdict.alias("kept")).alias(out),
    )


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    out = fresh("_verdict", docs.columns)
    return judge(docs, out=out, **columns).where(F.col(out)["kept"]).select(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = judge(docs, carry=["doc_id"])  # no text is written
    return found.select("doc_id", *[F.col("quality")[c].alias(c) for c in BASE], F.col("quality")["base_failed"].alias("base_failed"), F.col("quality")["kept"].alias("kept"))
