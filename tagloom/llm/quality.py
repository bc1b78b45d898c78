"""Quality classifier: evidence of the text, weighed by what its site and path are like.

Method: hierarchical empirical Bayes. A logistic model of byte statistics, fitted on a bounded sample of
labelled documents, gives each document its evidence (log likelihood ratio). Soft counts of good
documents are summed by path, host and over all; rates of hosts are shrunk toward the global rate and
rates of paths toward their host's, each with a strength estimated from how much the rates really
vary (method of moments). A document's own count is left out of its path's rate. Evidence and the
shrunk rate add up to the posterior; a site with few documents hardly moves it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import add_columns, as_bytes, stored

#: Labelled documents that the model is fitted on, at most (those with the smallest hash of their id).
TRAIN_ROWS = 8_000
#: Documents with a lower posterior are rejected.
KEEP = 0.5

# Classes of bytes; statistics are the shares of pairs of neighbouring classes.
_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#",
    b"*", b"$%&@+=~^", b"'\"()[]{}<>-_/\\:;`", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)),
)
_K = len(_GROUPS)
_CLASS = np.full(256, 13, np.uint16)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
WIDTH = _K * _K + 5


def features(text: bytes) -> np.ndarray:
    """Square roots of class-pair shares, and size, repetition of lines and words, length of words."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    c = _CLASS[np.frombuffer(text, np.uint8)]
    if len(c) > 1:
        out[: _K * _K] = np.sqrt(np.bincount(c[:-1] * _K + c[1:], minlength=_K * _K) / (len(c) - 1))
    lines, words = text.split(b"\n"), text.split()
    out[_K * _K :] = (
        math.log1p(len(c)) / 10,
        1 - len(set(lines)) / len(lines),
        len(set(words)) / max(1, len(words)),
        min(1.0, len(c) / max(1, len(words)) / 20),
        1.0,
    )
    return out


@dataclass
class Model:
    """``weights`` on the features; ``base``: log odds of good documents in the sample."""

    weights: np.ndarray
    base: float

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        return np.array([features(t) @ self.weights for t in texts])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> Model:
    """Ridge-penalized logistic regression by Newton steps."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = math.log(rate / (1 - rate))
    w = np.zeros(x.shape[1])
    w[-1] = base
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(w, base)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on ``rows`` labelled documents at most; only their features come to the driver. Labels with
    nulls are left out; without any, the model is indifferent."""
    asked = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)").orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    joined = texts.join(F.broadcast(asked), "id")  # at most ``rows`` ids

    def stats(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"x": pa.array([features(t).astype(np.float32).tobytes() for t in as_bytes(batch.column(1))], pa.binary())}

    found = add_columns(joined, stats, ["text"], "x binary", keep=["id", "y"]).orderBy("id", "y").collect()
    if not found:
        return Model(np.zeros(WIDTH), 0.0)
    return fit(np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float64), np.array([r["y"] for r in found], np.float64))


def _strength(groups: DataFrame, rate: str) -> float:
    """Prior strength of a level: how many documents its parent's rate is worth. ``groups``: n, s, parent's rate."""
    r = groups.agg(
        F.sum("n").alias("n"),
        F.sum(F.expr(f"n * pow(s / n - {rate}, 2)")).alias("spread"),
        F.sum(F.expr(f"{rate} * (1 - {rate})")).alias("chance"),
        F.sum(F.expr(f"n * {rate} * (1 - {rate})")).alias("within"),
    ).first()
    if not r["n"]:
        return 1.0
    between = max(1e-6, (r["spread"] - r["chance"]) / r["n"])
    return min(1e6, max(1.0, r["within"] / r["n"] / between - 1))


def score(
    docs: DataFrame, model: Model, host: Column | None = None, path: Column | None = None, text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``evidence``, ``site_rate`` and ``score`` (posterior of being good, 0 to 1).

    ``host`` and ``path`` name the site and the part of it a document comes from (defaults: columns
    ``source`` and ``lang``). Null hosts and paths are groups of their own; null and empty texts are
    judged as empty texts. Each row counts, repeated rows too. An empty table stays empty. Columns of ``docs`` with the names of the added ones give way.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    named = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes with the added ones
    keyed = docs.select(host.cast("string").alias("host"), path.cast("string").alias("path"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, named)])
    keyed = keyed.withColumns({"host": F.coalesce(F.concat(F.lit("="), "host"), F.lit("")), "path": F.coalesce(F.concat(F.lit("="), "path"), F.lit(""))})
    text = named[docs.columns.index(text_col)]

    def judge(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"logit": pa.array(np.clip(model.log_odds(as_bytes(batch.column(1))), -30, 30), pa.float64())}

    good = F.expr("1 / (1 + exp(-logit))")
    paths = stored(
        add_columns(keyed.select("host", "path", text), judge, [text], "logit double", keep=["host", "path"])
        .groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("s")),
        "quality-paths",
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    worth = _strength(hosts.withColumn("up", F.lit(overall)), "up")
    rated = hosts.select("host", ((F.col("s") + worth * overall) / (F.col("n") + worth)).alias("host_rate"))
    below = paths.join(rated, "host")
    worth_path = _strength(below, "host_rate")
    judged = add_columns(keyed, judge, [text], "logit double")
    own = judged.join(below.select("host", "path", F.col("n").alias("site_n"), F.col("s").alias("site_s"), "host_rate"), ["host", "path"])
    rate = (F.col("site_s") - good + worth_path * F.col("host_rate")) / (F.col("site_n") - 1 + worth_path)
    rate = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    return own.withColumn("rate", rate).select(
        *[F.col(n).alias(c) for c, n in zip(docs.columns, named) if c.lower() not in ("evidence", "site_rate", "score")],
        (F.col("logit") - model.base).alias("evidence"),
        F.col("rate").alias("site_rate"),
        F.expr(f"1 / (1 + exp(-(logit - {model.base!r} + ln(rate / (1 - rate)))))").alias("score"),
    )
