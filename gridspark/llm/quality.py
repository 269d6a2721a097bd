"""Quality classification with hierarchical empirical Bayes.

A logistic classifier on surface features gives each document a log-likelihood ratio.  Its soft
verdicts are summed by host and by path within a host.  Path means shrink toward their host's
posterior and host means toward the global mean; how far is estimated from how much sites differ
(method of moments), so sparse sites carry little weight of their own.  A document's final log-odds
are its own evidence plus the log-odds of its path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import materialize, unclashing

#: Labelled rows that the classifier is fitted on (a sample by hash of the id).
MOST_LABELLED = 20_000
#: Site tables of at most so many rows are broadcast (about 20 MB); larger ones are joined by shuffle.
MOST_BROADCAST_SITES = 200_000
#: Bounds of a site's pseudo-count.
LEAST_PRIOR, MOST_PRIOR = 10.0, 1e6
#: A single document's evidence in log-odds, at most; sites never outweigh clear evidence by far.
MOST_EVIDENCE = 12.0
LEAST_SCORE = 0.5

_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in "#$%&*|~^=<>@_+\\/{}[]"]] = True
_ALNUM = ~tb.PUNCTUATION
N_FEATURES = 9


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, one line of ``N_FEATURES`` numbers a row); zeros for a text without words."""
    for lo, hi, data, off in tb.chunks(column):
        w = tb.Words(data, off)
        n = np.maximum(w.count, 1)

        def by_row(flags: np.ndarray, first=w.first) -> np.ndarray:
            s = np.concatenate([[0], np.cumsum(flags)])
            return s[first[1:]] - s[first[:-1]]

        def by_byte(mask: np.ndarray, off=off) -> np.ndarray:
            s = np.concatenate([[0], np.cumsum(mask)])
            return s[off[1:]] - s[off[:-1]]

        size = w.end - w.start
        last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        plain = np.concatenate([[0], np.cumsum(_ALNUM[data])])
        h = w.hash
        again = np.zeros(len(h), dtype=bool)
        again[1:] = h[1:] == h[:-1]
        again[w.first[:-1][w.count > 0]] = False
        upper, lower = by_byte((data >= 65) & (data <= 90)), by_byte((data >= 97) & (data <= 122))
        yield (
            lo,
            hi,
            np.stack(
                [
                    by_row(_ODD[last]) / n,
                    by_row(plain[w.end] == plain[w.start]) / n,
                    by_row(again) / n,
                    upper / np.maximum(upper + lower, 1),
                    np.minimum(by_byte(data == 33) / n, 1),
                    np.minimum(by_byte((data >= 48) & (data <= 57)) / n, 3) / 3,
                    np.minimum(by_row(size) / n, 40) / 40,
                    by_row(size > 30) / n,
                    np.log1p(w.count) / 12,
                ],
                axis=1,
            )
            * (w.count > 0)[:, None],
        )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights and, last, an intercept that is zero evidence at the base rate of the labels.

    Without labels of both kinds the evidence is zero everywhere.  An id with labels of both kinds
    teaches nothing, nor does a null label.
    """
    labels = labels.select(F.col(id_col), (F.col(label_col) > 0).cast("double").alias("y")).where("y is not null")
    labels = labels.groupBy(id_col).agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    part = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MOST_LABELLED / max(labels.count(), 1)))
    rows = docs.select(id_col, text_col).join(F.broadcast(labels.where(part)), id_col).select(text_col, "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in features(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x]), b.column(1).slice(lo, hi - lo)], ["x", "y"])

    found = sorted((r.x, r.y) for r in rows.mapInArrow(run, "x binary, y double").collect())
    y = np.array([v for _, v in found])
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(N_FEATURES + 1)
    x = np.hstack([np.array([np.frombuffer(v) for v, _ in found]), np.ones((len(y), 1))])
    base = np.log(y.mean() / (1 - y.mean()))
    ridge = np.diag([1e-2] * N_FEATURES + [1e-6])
    beta = np.zeros(N_FEATURES + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    beta[-1] -= base
    return beta


def evidence(column: pa.Array, beta: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of good against bad for each text; a text without words has the least."""
    out = [np.where(x.any(axis=1), np.clip(x @ beta[:-1] + beta[-1], -MOST_EVIDENCE, MOST_EVIDENCE), -MOST_EVIDENCE) for _, _, x in features(column)]
    return np.concatenate(out) if out else np.zeros(0)


def _evidence_rows(docs: DataFrame, beta: np.ndarray, keep: list[str], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(evidence(b.column(len(keep)), shared.value))], [*b.schema.names[:-1], "evidence"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{kinds}, evidence double")


def sites(rows: DataFrame, base: float, host: str = "host", path: str = "path") -> DataFrame:
    """``host, path, host_posterior, path_posterior`` from ``host, path, evidence`` rows.

    ``base``: log-odds at zero evidence.  Nulls are a host or path of their own.
    """
    p = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    paths = materialize(rows.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good")), "paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))

    def pseudo(of: DataFrame, n: str, good: str, parent: Column, groups: int) -> float:
        """Beta pseudo-count by the method of moments: how little groups differ beyond chance."""
        r = of.agg(
            F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"), F.count(F.lit(1)).alias("g"),
            F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - parent, 2)).alias("ss"), F.sum(F.col(n) * parent * (1 - parent)).alias("v"),
        ).first()
        if r is None or not r.n or r.g <= groups or r.n <= r.n2 / r.n:
            return MOST_PRIOR
        v = r.v / r.n
        between = (r.ss - (r.g - groups) * v) / (r.n - r.n2 / r.n)
        return MOST_PRIOR if between <= 0 else float(np.clip(v / between - 1, LEAST_PRIOR, MOST_PRIOR))

    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count_distinct(F.struct(host)).alias("hosts")).first()
    mean = total.good / total.n if total.n else 0.5
    k = pseudo(hosts, "hn", "hgood", F.lit(mean), 1)
    hosts = hosts.select(F.col(host).alias("h"), "hn", "hgood", ((k * mean + F.col("hgood")) / (k + F.col("hn"))).alias("host_posterior"))
    both = paths.join(hosts, F.col(host).eqNullSafe(F.col("h"))).drop("h")
    k = pseudo(both.where("hn > n"), "n", "good", F.col("hgood") / F.col("hn"), int(total.hosts or 0))
    return both.select(host, path, "host_posterior", ((k * F.col("host_posterior") + F.col("good")) / (k + F.col("n"))).alias("path_posterior"))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_BROADCAST_SITES else table


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, evidence, host_posterior, path_posterior, score, keep`` for each row of ``docs``.

    ``score`` is the posterior probability of good quality; ``keep`` is ``score >= LEAST_SCORE``.
    A null, empty or wordless text has the least evidence.  Null hosts and paths are sites of their
    own.  Repeated rows are judged alike and each counts for its site.  Other columns are not read.
    """
    beta = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = materialize(_evidence_rows(rows, beta, ["id", "host", "path"], "text"), "evidence")
    site = materialize(sites(rows, _base(labels)), "sites").withColumnsRenamed({"host": "h", "path": "p"})
    out = rows.join(_bounded(site), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior")))))
    return out.select(F.col("id").alias(id_col), "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= LEAST_SCORE).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns; texts are never shuffled while the sites are few.

    Null, empty and wordless texts have the least evidence and go.  Null hosts and paths are sites of
    their own; repeated rows stay or go together.  No column's name can clash.
    """
    beta = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    site = materialize(sites(_evidence_rows(rows, beta, ["host", "path"], "text"), _base(labels)), "sites")
    h, p, odds = unclashing("host", "path", "odds")
    site = site.select(F.col("host").alias(h), F.col("path").alias(p), _logit(F.col("path_posterior")).alias(odds))
    joined = docs.join(_bounded(site), F.col(host_col).eqNullSafe(F.col(h)) & F.col(path_col).eqNullSafe(F.col(p))).drop(h, p)
    shared, at, least = docs.sparkSession.sparkContext.broadcast(beta), docs.columns.index(text_col), float(np.log(LEAST_SCORE / (1 - LEAST_SCORE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = evidence(b.column(at), shared.value) + np.asarray(b.column(b.num_columns - 1)) >= least
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(good))

    return joined.mapInArrow(run, docs.schema)


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _base(labels: DataFrame, label_col: str = "quality") -> float:
    r = labels.agg(F.count_if(F.col(label_col) > 0).alias("good"), F.count(label_col).alias("n")).first()
    return float(np.log((r.good + 1) / (r.n - r.good + 1)))
