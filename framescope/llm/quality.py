"""Quality rules: text statistics, and robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import join_small, stage

#: White space between words, and the symbols that are counted (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: The transformed statistics, and the least standard deviation that is believed of each (so that one constant in a group's bulk doesn't reject all else).
FEATURES = {"f_length": 0.5, "f_word_size": 0.15, "f_symbols": 0.04, "f_dup_lines": 0.15, "f_repeats": 0.1, "f_upper": 0.1, "f_distinct": 0.12}


def text_statistics(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` and, for each row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_distinct (long).

    Words are runs without blanks. n_repeat_words counts the words that lie in some five-word window found twice or more in the text; windows are
    compared by 64-bit hashes, and only texts that have a repeated window sort them. A null text has no words. No shuffle.
    """
    blanks, text = F.lit(BLANKS), F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, blanks)
    a = df.select(*keep, text.alias("_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, blanks) != "")
    count = F.size("_words").cast("long")
    squeezed = F.translate("_text", BLANKS, "")
    b = a.select(
        *keep,
        count.alias("n_words"),
        F.char_length(squeezed).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    w = F.col("_hashes")
    windows = F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))).otherwise(F.array().cast("array<bigint>"))
    plain = [*keep, "n_words", "word_chars", "n_symbols", "n_upper"]
    c = b.select(*plain, (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), windows.alias("_windows"))
    plain += ["n_dup_lines", "n_distinct"]
    repeated = F.size("_windows") != F.size(F.array_distinct("_windows"))
    d = c.select(*plain, F.when(repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    s = F.col("_sorted")
    twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    e = d.select(*plain, F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"])).alias("_at"))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_at", start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return e.select(*plain, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics named in FEATURES to rows of text_statistics."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "f_length": F.log1p(F.col("n_words").cast("double")),
            "f_word_size": F.log(chars / n),
            "f_symbols": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_symbols") / chars))),
            "f_dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
            "f_repeats": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n))),
            "f_upper": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_upper") / chars))),
            "f_distinct": F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / F.pow(n, F.lit(0.75))),
        }
    )


#: Concentration steps for the estimate of all rows, which only steadies small groups.
PRIOR_STEPS = 2


def group_key(group_cols: Sequence[str]) -> Column:
    """One text that names a row's group; nulls are a value of their own."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")) for c in group_cols))


def _with_cholesky(scatter: DataFrame, names: Sequence[str]) -> DataFrame:
    """From the covariances c_i_j (i >= j) of each group, adds the lower Cholesky factor l_i_j and log_det; each column of the factor is a projection of its own."""
    out = scatter
    for j in range(len(names)):
        used = [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - sum(used, F.lit(0.0)), F.lit(1e-12))))
        below = {}
        for i in range(j + 1, len(names)):
            dots = [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
            below[f"l_{i}_{j}"] = (F.col(f"c_{i}_{j}") - sum(dots, F.lit(0.0))) / F.col(f"l_{j}_{j}")
        if below:
            out = out.withColumns(below)
    return out.withColumn("log_det", 2 * sum((F.log(f"l_{j}_{j}") for j in range(len(names))), F.lit(0.0)))


def _squared(rows: DataFrame, names: Sequence[str], centre: Sequence[Column], factor: Sequence[Sequence[Column]], kept: Sequence[str]) -> DataFrame:
    """The columns `kept` of rows with `_d`, the squared Mahalanobis distance to a centre, by forward substitution with a lower Cholesky factor."""
    out = rows
    for i, name in enumerate(names):
        dots = [factor[i][k] * F.col(f"_y{k}") for k in range(i)]
        out = out.withColumn(f"_y{i}", (F.col(name) - centre[i] - sum(dots, F.lit(0.0))) / factor[i][i])
    return out.select(*kept, sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(names))), F.lit(0.0)).alias("_d"))


def _distances(rows: DataFrame, estimates: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with `_d`, the squared Mahalanobis distance to their group's centre."""
    d = range(len(names))
    return _squared(join_small(rows, estimates, ["_g"], how="left"), names, [F.col(f"m_{i}") for i in d], [[F.col(f"l_{i}_{k}") for k in range(i + 1)] for i in d], rows.columns)


def _estimate(rows: DataFrame, names: Sequence[str], floors: Sequence[float], scale: float, prior: dict[str, float] | None, strength: float) -> DataFrame:
    """Per group: mean m_i and covariance (times scale, floors added to the diagonal) of the rows, as a Cholesky factor, in the shared folder.

    With a prior both are drawn towards it, as if `strength` of its rows stood beside the group's n."""
    d = range(len(names))
    wanted = [F.count("*").alias("n")] + [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)] + [F.covar_pop(x, y).alias(f"v_{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(names[: i + 1])]
    found = rows.groupBy("_g").agg(*wanted)
    drawn = lambda own, key: own if prior is None else (F.col("n") * own + strength * prior[key]) / (F.col("n") + strength)
    scatter = found.select("_g", "n", *(drawn(F.col(f"m_{i}"), f"m_{i}").alias(f"m_{i}") for i in d), *(drawn(F.col(f"v_{i}_{j}") * scale + (floors[i] ** 2 if i == j else 0.0), f"c_{i}_{j}").alias(f"c_{i}_{j}") for i in d for j in range(i + 1)))
    factored = _with_cholesky(scatter, names)
    return stage(factored.select("_g", "n", "log_det", *(f"m_{i}" for i in d), *(f"l_{i}_{j}" for i in d for j in range(i + 1))), "quality-mcd")


def mcd_estimates(rows: DataFrame, names: Sequence[str], floors: Sequence[float], support: float = 0.75, steps: int = 4, prior: dict[str, float] | None = None, strength: float = 0.0) -> DataFrame:
    """Minimum-covariance-determinant estimates for each group `_g`: centre, Cholesky factor, log determinant.

    A deterministic start (median, and the scaled median absolute deviation, of each statistic) is followed by concentration steps: the share
    `support` of a group's rows with the least distances gives the next mean and covariance, whose determinant never grows but for the floors and the
    prior. The covariance of the support is blown up to be consistent at the normal distribution. Quantiles come from mergeable sketches, sums from
    partial aggregates, so a group may hold any share of the rows. prior: see pooled; a group of any size, one row as well, has an estimate with it.
    """
    d = range(len(names))
    drawn = lambda own, key: own if prior is None else (F.col("n") * own + strength * prior[key]) / (F.col("n") + strength)
    mid = rows.groupBy("_g").agg(F.count("*").alias("n"), *(F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(names)))
    spread = join_small(rows, stage(mid, "quality-median"), ["_g"]).groupBy("_g").agg(F.first("n").alias("n"), *(F.first(f"m_{i}").alias(f"m_{i}") for i in d), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"s_{i}") for i, x in enumerate(names)))
    start = {f"l_{i}_{j}": F.lit(0.0) for i in d for j in range(i)} | {f"l_{i}_{i}": F.sqrt(drawn(F.pow(F.col(f"s_{i}") * 1.4826, F.lit(2.0)) + floors[i] ** 2, f"c_{i}_{i}")) for i in d}
    found = stage(spread.withColumns(start | {f"m_{i}": drawn(F.col(f"m_{i}"), f"m_{i}") for i in d}), "quality-start")
    scale = consistency(support, len(names))
    for _ in range(steps):
        near = _distances(rows, found, names)
        cut = stage(near.groupBy("_g").agg(F.percentile_approx("_d", support, 1000).alias("_cut")), "quality-cut")
        found = _estimate(join_small(near, cut, ["_g"]).where("_d <= _cut"), names, floors, scale, prior, strength)
    return found


def pooled(rows: DataFrame, names: Sequence[str], floors: Sequence[float], support: float, steps: int) -> dict[str, float] | None:
    """Centre m_i and covariance c_i_j of all rows, by the same method; None without rows. A few dozen numbers reach the driver, and go on as literals."""
    d = range(len(names))
    first = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(x, 0.5, 1000) for x in names)).first()
    if not first["n"]:
        return None
    centre = list(first[1:])
    spread = rows.agg(*(F.percentile_approx(F.abs(F.col(x) - centre[i]), 0.5, 1000) for i, x in enumerate(names))).first()
    cov = [[(1.4826 * spread[i]) ** 2 + floors[i] ** 2 if i == j else 0.0 for j in d] for i in d]
    scale = consistency(support, len(names))
    for _ in range(steps):
        factor = cholesky(cov)
        near = _squared(rows, names, [F.lit(x) for x in centre], [[F.lit(factor[i][k]) for k in range(i + 1)] for i in d], names)
        cut = near.agg(F.percentile_approx("_d", support, 1000)).first()[0]
        found = near.where(F.col("_d") <= cut).agg(*(F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"v_{i}_{j}") for i in d for j in range(i + 1))).first()
        centre = [found[f"m_{i}"] for i in d]
        cov = [[found[f"v_{max(i, j)}_{min(i, j)}"] * scale + (floors[i] ** 2 if i == j else 0.0) for j in d] for i in d]
    return {f"m_{i}": float(centre[i]) for i in d} | {f"c_{i}_{j}": float(cov[i][j]) for i in d for j in range(i + 1)}


def cholesky(cov: Sequence[Sequence[float]]) -> list[list[float]]:
    """The lower factor of a small covariance, on the driver."""
    out: list[list[float]] = []
    for i, row in enumerate(cov):
        line: list[float] = []
        for j in range(i + 1):
            rest = row[j] - sum(a * b for a, b in zip(line, (out[j] if j < i else line)[:j]))
            line.append(max(rest, 1e-12) ** 0.5 if i == j else rest / out[j][j])
        out.append(line)
    return out


def consistency(support: float, dimensions: int, points: int = 4000) -> float:
    """support / P(chi2 of dimensions + 2 <= the chi2 of dimensions' quantile at support): the factor that undoes the trimming at the normal distribution."""
    q = chi2_quantile(support, dimensions, points)
    return support / chi2_cdf(q, dimensions + 2)


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    import math

    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(p: float, k: int, points: int = 200) -> float:
    low, high = 0.0, 1000.0
    for _ in range(points):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
        if high - low < 1e-10:
            break
    return high


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: Sequence[str] = ("lang", "source"), strength: float = 50.0, support: float = 0.75, steps: int = 4, tail: float = 1e-12, floors: dict[str, float] = FEATURES) -> DataFrame:
    """One row per row of df: id, the statistics of text_statistics, base_failed, distance (squared Mahalanobis distance, null if base_failed), kept.

    Estimates use the rows that pass the base rules, per group of group_cols, and every such row is judged: the estimate of a group is drawn towards
    that of all rows as if `strength` rows of theirs stood beside its own, which matters for small groups only. A row is rejected if its distance
    exceeds the chi-squared quantile at 1 - tail; one just at it stays. Null and empty texts fail the base rules; long texts are read whole; repeated
    rows count each; an empty table gives no rows. Only the named columns are read, whatever others are called.
    """
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_txt"), *(df[c].cast("string").alias(f"_c{k}") for k, c in enumerate(group_cols)))
    keys = [f"_c{k}" for k in range(len(group_cols))]
    stats = stage(features(text_statistics(rows, "_txt", ["_id", *keys])).withColumn("base_failed", base_failed()).withColumn("_g", group_key(keys)).drop(*keys), "quality-stats")
    names, levels = list(floors), list(floors.values())
    passed = stats.where(~F.col("base_failed"))
    prior = pooled(passed.select(*names), names, levels, support, PRIOR_STEPS)
    plain = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "base_failed"]
    out = stats.where("base_failed").select("_id", *plain, F.lit(None).cast("double").alias("distance"))
    if prior is not None:
        found = mcd_estimates(passed.select("_g", *names), names, levels, support, steps, prior, strength)
        out = out.unionByName(_distances(passed.select("_id", "_g", *plain, *names), found, names).select("_id", *plain, F.col("_d").alias("distance")))
    limit = chi2_quantile(1 - tail, len(names))
    return out.select(F.col("_id").alias(id_col), *plain, "distance", (~F.col("base_failed") & (F.col("distance") <= limit)).alias("kept"))
