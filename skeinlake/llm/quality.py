"""Operator 9: quality rules as robust multivariate outliers.

Five statistics of each text, on scales where ordinary texts are about normal, are compared within language
and source. Location and scatter are a minimum-covariance-determinant estimate: from three deterministic starts
(median absolute deviations alone, and with the correlations of hyperbolic tangents and of spatial signs), concentration
steps each keep the ``subset`` share of least Mahalanobis distance, until no determinant falls any more; the fit of least
determinant wins. All groups and starts take a step together, in one aggregation: moments by logarithmic class of distance,
the class on the border taken in part. No group is ever gathered in one place, so a hot source costs
no more than its rows.

A group of n texts has n / (n + ``prior``) of its own estimate and the rest from its language, whose estimate is its
groups' together, and so on to the whole table. So small groups need no rule of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs

STATS = ("symbols", "capitals", "recurring", "length", "short")
D = len(STATS)
#: Least standard deviations: statistics that hardly vary in a group don't reject at the first deviation.
FLOOR = np.array([0.06, 0.06, 0.05, 0.05, 0.05])
#: Tokens within which a token counts as recurring.
NEAR = 50
#: A text of n tokens deviates from its group's median by sqrt(n / (n + STEADY)) of what it shows.
STEADY = 40.0
#: Median of the chi-square distribution with D degrees of freedom, for consistency of the scatter.
CHI2_MEDIAN = 4.3515
#: Classes of squared distance for each doubling of it.
CLASSES = 4
STARTS = 3
MAX_STEPS = 12
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]

_PLAIN = frozenset(b".,;:!?'\"()-")
_SYMBOL = np.array([32 < b < 127 and not chr(b).isalnum() and (b not in _PLAIN or b == 33) for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in range(256)])


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text and its statistics; rows without tokens are zero."""
    tok = A.Tokens(texts, A.SPACED)
    n = np.diff(tok.first)
    sums = lambda table: np.concatenate([[0], np.cumsum(table[tok.data])])
    per_row = lambda s: s[tok.offsets[1:]] - s[tok.offsets[:-1]]
    size = tok.end - tok.start
    token_sums = lambda x: np.concatenate([[0], np.cumsum(x)])[tok.first]
    inside = np.diff(token_sums(size))
    letters = per_row(sums(_LETTER))
    row = tok.row
    order = np.lexsort((np.arange(len(row)), tok.hash, row))
    h, r = tok.hash[order], row[order]
    again = np.zeros(len(row), bool)
    again[order[1:]] = (h[1:] == h[:-1]) & (r[1:] == r[:-1]) & (np.diff(order) <= NEAR)
    share = lambda c, m: np.arcsin(np.sqrt(np.minimum(1, c / np.maximum(m, 1))))
    out = np.zeros((len(n), D))
    out[:, 0] = share(per_row(sums(_SYMBOL)), inside)
    out[:, 1] = share(per_row(sums(_CAPITAL)), letters)
    out[:, 2] = share(np.diff(token_sums(again)), n)
    out[:, 3] = np.log(np.maximum(inside, 1) / np.maximum(n, 1))
    out[:, 4] = share(np.diff(token_sums(size <= 3)), n)
    out[n == 0] = 0
    return n, out


def _vectors(docs: DataFrame, id_col: str, text_col: str, groups: list[str]) -> DataFrame:
    """(doc_id, g, parent, n, x0, ...): statistics, the group, and the group of its leading column."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"g{i}") for i, c in enumerate(groups)]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keys)
    names = [f"g{i}" for i in range(len(groups))]
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "text", F.to_json(F.array(*names)).alias("g"), F.to_json(F.array(*names[:1])).alias("parent")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in A.slices(batch.column(1)):
                n, x = statistics(part)
                rest = batch.slice(at, len(part))
                columns = [rest.column(0), rest.column(2), rest.column(3), pa.array(n, pa.int64()), *(pa.array(x[:, j]) for j in range(D))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "g", "parent", "n", *(f"x{j}" for j in range(D))]).filter(pa.array(n > 0))

    return rows.mapInArrow(run, ", ".join(["doc_id bigint, g string, parent string, n bigint", *(f"x{j} double" for j in range(D))]))


def _smoothed(groups: DataFrame, columns: list[str], prior: float) -> DataFrame:
    """(g, parent, size, columns) with each group's values drawn to its parent's, and these to those of all, by ``prior`` rows."""
    mean = [(F.sum(F.col("size") * F.col(c)) / F.sum("size")).alias(f"up_{c}") for c in columns]
    parents = groups.groupBy("parent").agg(F.sum("size").alias("up_size"), *mean)
    top = parents.agg(*((F.sum(F.col("up_size") * F.col(f"up_{c}")) / F.sum("up_size")).alias(c) for c in columns)).first()
    drawn = lambda own, size, to: (F.col(size) * F.col(own) + F.lit(prior) * to) / (F.col(size) + F.lit(prior))
    parents = parents.select("parent", *(drawn(f"up_{c}", "up_size", F.lit(top[c])).alias(f"up_{c}") for c in columns))
    both = jobs.join_small(groups, parents, "parent", "inner", 32 + 8 * len(columns))
    return both.select("g", "parent", "size", *(drawn(c, "size", F.col(f"up_{c}")).alias(c) for c in columns))


def _distance() -> Column:
    """Squared Mahalanobis distance with parameters ``mean`` and ``prec`` (rows of the precision matrix)."""
    dev = [F.col(f"x{j}") - F.col("mean")[j] for j in range(D)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col("prec")[i * D + j] * dev[i] * dev[j] * (1.0 if i == j else 2.0)
    return total


PARAMS = "g string, start int, mean array<double>, prec array<double>, det double, fell boolean"


def _matrix(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(columns[0]), D, D))
    for (i, j), c in zip(PAIRS, columns):
        out[:, i, j] = out[:, j, i] = c
    return out


def _params(g: pa.Array, start: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    det = np.linalg.slogdet(cov)[1]
    return pa.RecordBatch.from_arrays(
        [g, pa.array(start.astype(np.int32)), lists(mean), lists(np.linalg.inv(cov).reshape(len(cov), -1)), pa.array(det), pa.array(np.ones(len(cov), bool))],
        names=["g", "start", "mean", "prec", "det", "fell"],
    )


def _numbers(batch: pa.RecordBatch, first: int, n: int) -> list[np.ndarray]:
    return [batch.column(first + k).to_numpy(zero_copy_only=False) for k in range(n)]


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three starts of each group from its medians, deviations and products of tangents and signs."""
    for b in batches:
        if not b.num_rows:
            continue
        mean = np.stack(_numbers(b, 1, D), axis=1)
        scale = np.stack(_numbers(b, 1 + D, D), axis=1)
        identity = np.broadcast_to(np.eye(D), (len(mean), D, D))
        for k in range(STARTS):
            r = identity if k == 0 else _matrix(_numbers(b, 1 + 2 * D + (k - 1) * len(PAIRS), len(PAIRS)))
            if k:
                own = np.sqrt(np.maximum(np.einsum("nii->ni", r), 1e-12))
                r = 0.999 * r / own[:, :, None] / own[:, None, :] + 0.001 * identity
                np.einsum("nii->ni", r)[:] = 1
            yield _params(b.column(0), np.full(len(mean), k), mean, r * scale[:, :, None] * scale[:, None, :])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean and precision of each group and start from its count, sums and products."""
    for b in batches:
        if b.num_rows:
            count = np.maximum(_numbers(b, 2, 1)[0], 1e-9)
            mean = np.stack(_numbers(b, 3, D), axis=1) / count[:, None]
            cov = _matrix(_numbers(b, 3 + D, len(PAIRS))) / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
            yield _params(b.column(0), b.column(1).to_numpy(), mean, cov + np.diag(FLOOR**2))


def concentrated(rows: DataFrame, params: DataFrame, subset: float, tmp: jobs.Scratch) -> DataFrame:
    """(g, mean, prec, det) of least determinant, by concentration steps from all starts."""
    value = [F.count("*").cast("double").alias("c"), *(F.sum(f"x{j}").alias(f"s{j}") for j in range(D))]
    value += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    names = ["c", *(f"s{j}" for j in range(D)), *(f"p{i}{j}" for i, j in PAIRS)]
    own = Window.partitionBy("g", "start")
    for step in range(MAX_STEPS):
        distance = jobs.join_small(rows, params.select("g", "start", "mean", "prec"), "g", "inner", 800)
        of = F.floor(F.log2(_distance() + F.lit(1e-9)) * CLASSES).cast("int").alias("class")
        classes = distance.select("g", "start", of, *(f"x{j}" for j in range(D))).groupBy("g", "start", "class").agg(*value)
        before = F.sum("c").over(own.orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.sum("c").over(own) * subset - F.coalesce(before, F.lit(0.0))) / F.col("c")))
        kept = classes.withColumn("share", share).where("share > 0").groupBy("g", "start").agg(*(F.sum(F.col("share") * F.col(c)).alias(c) for c in names))
        new = kept.mapInArrow(_fit, PARAMS)
        if step:
            old = params.select("g", "start", *(F.col(c).alias(f"old_{c}") for c in ("mean", "prec", "det")))
            both = jobs.join_small(new, old, ["g", "start"], "inner", 800)
            less = F.col("det") < F.col("old_det")
            best = [F.when(less, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("mean", "prec", "det")]
            new = both.select("g", "start", *best, (F.col("det") < F.col("old_det") - 0.01).alias("fell"))
        params = tmp.save(new)
        if step and params.where("fell").isEmpty():
            break
    least = params.groupBy("g").agg(F.min_by(F.struct("start", "mean", "prec", "det"), F.struct("det", "start")).alias("b"))
    return tmp.save(least.select("g", "b.start", "b.mean", "b.prec", "b.det"))


def distances(docs: DataFrame, id_col: str, text_col: str, groups: list[str], subset: float, prior: float, tmp: jobs.Scratch) -> DataFrame:
    """(doc_id, d2): squared robust distances, scaled so that a group's median is that of its chi-square law."""
    rows = tmp.save(_vectors(docs, id_col, text_col, groups))
    middles = [f"m{j}" for j in range(D)]
    medians = rows.groupBy("g", "parent").agg(F.count("*").alias("size"), *(F.percentile_approx(f"x{j}", 0.5).alias(f"m{j}") for j in range(D)))
    medians = tmp.save(_smoothed(tmp.save(medians), middles, prior))
    sizes = medians.select("g", "parent", "size")
    pull = F.sqrt(F.col("n") / (F.col("n") + F.lit(STEADY)))
    steady = [(pull * (F.col(f"x{j}") - F.col(f"m{j}"))).alias(f"y{j}") for j in range(D)]
    moved = jobs.join_small(rows, medians.drop("parent", "size"), "g", "inner", 200).select("doc_id", "g", *middles, *steady)
    rows = tmp.save(moved.select("doc_id", "g", *((F.col(f"m{j}") + F.col(f"y{j}")).alias(f"x{j}") for j in range(D))))
    spread = jobs.join_small(rows, medians.drop("parent", "size"), "g", "inner", 200)
    scale = [F.sqrt(F.pow(1.4826 * F.percentile_approx(F.abs(F.col(f"x{j}") - F.col(f"m{j}")), 0.5), 2.0) + F.lit(float(FLOOR[j] ** 2))).alias(f"s{j}") for j in range(D)]
    scales = tmp.save(spread.groupBy("g", *middles).agg(*scale))
    z = [((F.col(f"x{j}") - F.col(f"m{j}")) / F.col(f"s{j}")).alias(f"z{j}") for j in range(D)]
    scaled = jobs.join_small(rows, scales, "g", "inner", 200).select("g", *z)
    norm = F.sqrt(sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(D)), F.lit(1e-12)))
    bent = scaled.select("g", *(F.tanh(f"z{j}").alias(f"t{j}") for j in range(D)), *((F.col(f"z{j}") / norm).alias(f"u{j}") for j in range(D)))
    products = bent.groupBy("g").agg(*(F.avg(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "tu" for i, j in PAIRS))
    start = jobs.join_small(scales, tmp.save(products), "g", "inner", 400)
    start = start.select("g", *middles, *(f"s{j}" for j in range(D)), *(f"{k}{i}{j}" for k in "tu" for i, j in PAIRS))
    fit = concentrated(rows, tmp.save(start.mapInArrow(_starts, PARAMS)), subset, tmp)
    params = tmp.save(_drawn(fit, sizes, prior, tmp))
    measured = tmp.save(jobs.join_small(rows, params, "g", "inner", 600).select("doc_id", "g", _distance().alias("d2")))
    middle = measured.groupBy("g").agg((F.percentile_approx("d2", 0.5) / F.lit(CHI2_MEDIAN)).alias("scale"))
    middle = tmp.save(_smoothed(tmp.save(jobs.join_small(sizes, middle, "g", "inner", 200)), ["scale"], prior))
    scaled = F.col("d2") / F.greatest(F.col("scale"), F.lit(1.0))
    return jobs.join_small(measured, middle.select("g", "scale"), "g", "inner", 200).select("doc_id", scaled.alias("d2"))


def _drawn(fit: DataFrame, sizes: DataFrame, prior: float, tmp: jobs.Scratch) -> DataFrame:
    """(g, mean, prec) with the estimates of small groups drawn to those of their language."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mean, prec = (np.array(b.column(c).to_pylist()) for c in ("mean", "prec"))
                cov = np.linalg.inv(prec.reshape(-1, D, D))
                columns = [mean[:, j] for j in range(D)] + [cov[:, i, j] + mean[:, i] * mean[:, j] for i, j in PAIRS]
                yield pa.RecordBatch.from_arrays([b.column("g"), *map(pa.array, columns)], names=["g", *names])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mean = np.stack(_numbers(b, 1, D), axis=1)
                cov = _matrix(_numbers(b, 1 + D, len(PAIRS))) - mean[:, :, None] * mean[:, None, :]
                yield _params(b.column(0), np.zeros(len(mean)), mean, cov)

    names = [f"m{j}" for j in range(D)] + [f"q{i}{j}" for i, j in PAIRS]
    fields = ", ".join(["g string", *(f"{c} double" for c in names)])
    own = jobs.join_small(sizes, tmp.save(fit.select("g", "mean", "prec").mapInArrow(moments, fields)), "g", "inner", 300)
    return _smoothed(tmp.save(own), names, prior).select("g", *names).mapInArrow(back, PARAMS).select("g", "mean", "prec")


def filter_quality(
    docs: DataFrame,
    cutoff: float = 45.0,
    subset: float = 0.6,
    prior: float = 50.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """Documents whose robust squared distance stays within ``cutoff``, with the input's columns.

    Statistics: shares of symbols, of capitals, of tokens that recur within 50 tokens and of tokens of at most three
    bytes, and the mean token length; short texts count as closer to their group's median. ``cutoff`` is calibrated on
    labelled texts, not a quantile of the chi-square law: the statistics have heavier tails than it. Every group is judged by
    its own estimate and its language's, weighted by its size against ``prior`` texts. Null language or source is a
    group of its own. Null ids, null texts and texts without a token are not judged and stay. Rows that repeat a doc_id stay
    or go together. An empty table gives an empty one; extra columns are kept.
    """
    with jobs.Scratch(docs.sparkSession) as tmp:
        rows = distances(docs, id_col, text_col, list(group_cols), subset, prior, tmp)
        far = tmp.keep(rows.where(F.col("d2") > cutoff).select(F.col("doc_id").alias("__doc")).distinct())
    keyed = docs.select("*", F.col(id_col).cast("bigint").alias("__doc"))
    return jobs.join_small(keyed, far, "__doc", "left_anti").select(*docs.columns)
