"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over signs of style and over words that mark rejected documents gives each document's own
evidence. Marker words are graded by the lower bound of their log odds, which does not depend on how many labels
there are; the regression sees a document's words graded by the other PARTS of the labels only, so it learns what
they are worth on texts that they were not chosen from. Its mean by host and by path below a host, shrunk, gives sites' posteriors: a path towards its host,
a host towards the global rate, by prior strengths that are estimated from the sites themselves (method of
moments). By Bayes' rule a document's log odds move by its site's log odds less the global ones.

A document is good if its quality label is 1 and it is not labelled toxic. The model is fitted on at most
SAMPLE labelled documents, those whose identifiers hash lowest; hosts, paths and the global rate are
counted over all documents.

Cases: null text is empty and scored like any text; a null host or path is a site of its own; labels that are
null in quality are left out, a null toxic counts as 0; several labels of one document count as the worst;
without labels of both kinds every document is kept; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package
from .pieces import ROWS

#: The most labelled documents that the model is fitted on, and the most words that it knows.
SAMPLE, WORDS = 20_000, 50_000
#: A word marks rejects if it is in LEAST of them or more and its log odds, less SURE standard errors, are over OVER.
LEAST, SURE, OVER, PARTS = 3, 1.64, 0.5, 3

_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-:;()?")
_STOPS = b".,'\"-:;()?"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SPACED = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalpha()), b" " * sum(not chr(b).isalpha() for b in range(128)))
N_SIGNS = 10


def signs(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    return [
        math.log1p(n),
        min(20.0, size / max(1, n)),
        min(1.0, 8 * share(_SYMBOLS)),
        min(1.0, 4 * share(_STOPS)),
        share(_UPPER),
        share(_DIGITS),
        len(set(words)) / max(1, n),
        min(1.0, 4 * sum(map(operator.eq, words, words[1:])) / max(1, n)),
        min(1.0, 8 * data.count(b"|") / size),
        1.0 if n < 5 else 0.0,
    ]


def plain_words(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").lower().translate(_SPACED).split())


@dataclass
class Model:
    words: dict[bytes, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_SIGNS + 2))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_SIGNS + 2))
    weights: np.ndarray | None = None  # the constant last

    def features(self, texts: list[str], words: list[dict[bytes, float]] | None = None) -> np.ndarray:
        """words: the graded words for each text, if they are not the model's."""
        out = np.empty((len(texts), N_SIGNS + 2))
        for i, t in enumerate(texts):
            known = words[i] if words else self.words
            hits = sorted(known[w] for w in known.keys() & plain_words(t)) if known else []
            out[i] = [*signs(t), min(10.0, sum(hits)), max(hits, default=0.0)]
        return out

    def log_odds(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 12.0)
        x = (self.features(texts) - self.mean) / self.scale
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs (doc_id, text), labels (doc_id, quality, toxic)."""
    spark = docs.sparkSession
    ship_package(spark)
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    )
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows: small enough to broadcast
    known, _ = materialize(
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"), "labelled"
    )
    # Copies of a text fall into the same part.
    known = known.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(PARTS)).cast("int"))
    total = known.groupBy("part", "good").count().collect()
    n = {g: np.array([sum(r["count"] for r in total if r.good == g and r.part != k) for k in range(PARTS + 1)]) for g in (0, 1)}  # the last: all parts
    model = Model()
    if not n[0][-1] or not n[1][-1]:
        return model

    def own_words(batches):
        for batch in batches:
            words = [list(plain_words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.binary())), batch.column(1), batch.column(2)], ["words", "good", "part"])

    by_word = known.select("text", "good", "part").mapInArrow(own_words, "words array<binary>, good int, part int")
    by_word = by_word.select(F.explode("words").alias("word"), "good", "part")

    def count(good: int, k: int) -> Column:
        return F.count(F.when((F.col("good") == good) & (F.col("part") != k), 1))

    def bound(k: int) -> Column:
        """The lower bound of a word's log odds, counted without part k; null if it marks nothing."""
        bad, fine = F.col(f"bad{k}") + 0.5, F.col(f"fine{k}") + 0.5
        least = F.log(bad / float(n[0][k] + 1)) - F.log(fine / float(n[1][k] + 1)) - SURE * F.sqrt(1 / bad + 1 / fine)
        return F.when((F.col(f"bad{k}") >= LEAST) & (least > OVER), least)

    tables = range(PARTS + 1)
    counts = by_word.groupBy("word").agg(*[count(0, k).alias(f"bad{k}") for k in tables], *[count(1, k).alias(f"fine{k}") for k in tables])
    strong = counts.where(F.col(f"bad{PARTS}") >= LEAST).select("word", *[bound(k).alias(f"v{k}") for k in tables])
    strong = strong.withColumn("most", F.greatest(*[F.col(f"v{k}") for k in tables])).where("most is not null")
    graded: list[dict[bytes, float]] = [{} for _ in tables]
    for r in strong.orderBy(F.desc("most"), "word").limit(WORDS).collect():
        for k in tables:
            if r[f"v{k}"] is not None:
                graded[k][bytes(r.word)] = r[f"v{k}"]
    model.words = graded.pop()

    def rows(batches):
        for batch in batches:
            x = model.features(batch.column(0).to_pylist(), [graded[k] for k in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "good"])

    got = known.select("text", "good", "part").mapInArrow(rows, "x array<double>, good int").collect()
    x, y = np.array([r.x for r in got]), np.array([r.good for r in got], dtype=float)
    order = np.lexsort(x.T)  # the same model, however rows arrive
    x, y = x[order], y[order]
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all weights but the constant."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def site_posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """scored (host, path, p) -> one row a path: host_posterior, path_posterior, global_rate.

    Grouped aggregates only; hosts and paths may be any number. Strengths are those of beta priors by moments.
    """
    paths, _ = materialize(scored.groupBy(host, path).agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("global_rate"))  # one row

    def strength(sites: DataFrame, n: str, s: str, rate: Column, name: str) -> DataFrame:
        """One row: the prior strength m with rate (1 - rate) / (m + 1) as the variance of true rates."""
        mean_var = F.avg(rate * (1 - rate))
        spread = F.avg((F.col(s) / F.col(n) - rate) ** 2 - rate * (1 - rate) / F.col(n))
        return sites.agg(F.greatest(F.lit(2.0), F.least(F.lit(1e4), mean_var / F.greatest(spread, F.lit(1e-9)) - 1)).alias(name))

    with_rate = hosts.join(F.broadcast(whole))  # one row on that side
    of_hosts = strength(with_rate, "host_n", "host_s", F.col("global_rate"), "host_m")
    shrunk = with_rate.join(F.broadcast(of_hosts)).withColumn(
        "host_posterior", (F.col("host_s") + F.col("host_m") * F.col("global_rate")) / (F.col("host_n") + F.col("host_m"))
    )
    joined = paths.join(shrunk.withColumnRenamed(host, "_host"), paths[host].eqNullSafe(F.col("_host"))).drop("_host")
    of_paths = strength(joined, "n", "s", F.col("host_posterior"), "path_m")
    return joined.join(F.broadcast(of_paths)).select(
        host,
        path,
        "global_rate",
        "host_posterior",
        ((F.col("s") + F.col("path_m") * F.col("host_posterior")) / (F.col("n") + F.col("path_m"))).alias("path_posterior"),
    )


#: The columns that classify adds.
RESULTS = ("p_text", "host_posterior", "path_posterior", "p_good", "keep")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """docs with p_text, host_posterior, path_posterior, p_good and keep (p_good >= 0.5)."""
    model = fit(docs, labels, sample)

    @F.arrow_udf("double")
    def log_odds(texts: pa.Array) -> pa.Array:
        parts = [model.log_odds([t or "" for t in texts.slice(i, ROWS).to_pylist()]) for i in range(0, len(texts), ROWS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    # The caller's columns go by other names here, so that none of them meets those of the sites; results take the place of old ones.
    kept = {f"_c{i}": c for i, c in enumerate(c for c in docs.columns if c not in RESULTS)}
    scored = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in kept.items()], F.col(host).alias("_h"), F.col(path).alias("_p"), log_odds(F.col("text").cast("string")).alias("_odds"))
    p = 1 / (1 + F.exp(-F.col("_odds")))
    sites, _ = materialize(site_posteriors(scored.select("_h", "_p", p.alias("p")), "_h", "_p"), "sites")
    sites = sites.withColumnsRenamed({"_h": "_site_h", "_p": "_site_p"})
    # Spark broadcasts the sites only if they are under its size limit; otherwise both sides are dealt by site.
    out = scored.join(sites, F.col("_h").eqNullSafe(F.col("_site_h")) & F.col("_p").eqNullSafe(F.col("_site_p")), "left")
    odds = F.col("_odds") + _logit(F.col("path_posterior")) - _logit(F.col("global_rate"))
    good = 1 / (1 + F.exp(-odds))
    own = [F.col(n).alias(c) for n, c in kept.items()]
    return out.select(*own, p.alias("p_text"), "host_posterior", "path_posterior", good.alias("p_good"), (good >= 0.5).alias("keep"))
