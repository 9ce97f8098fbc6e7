"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; a sample of all texts, whatever they are, is the unlabelled set. A linear
classifier on hashed words and word beginnings (whether one occurs) is trained in numpy on the class-prior-corrected risk
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): where the second part falls below zero, its gradient is turned round.
The prior is the share of confirmed toxic texts among the labelled ones that may be learned from.

Only the fit is on bounded samples, POSITIVES and UNLABELLED texts, those first by the hash of their id, of rows that share
an id the one with the smallest text; every text is scored whole. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts get the score of a text without words; without confirmed examples all scores are 0;
a document labelled more than once is toxic if one label says so; repeated rows are scored each on their own, very long texts
in one piece; other columns of either table are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as tx
from .common import fold, ship, tidy

BITS = 18
PREFIXES = (4, 5)
POSITIVES, UNLABELLED = 3000, 9000
STEPS, RATE, BATCH, L1, MIN_SHARE = 700, 0.02, 1024, 3e-4, 0.01


def features(column: pa.Array, kind=tx.ALNUM):
    """Yields (first row, rows, word features, their row): each text's distinct words and
    their first bytes, hashed."""
    for at, n, raw, off in tx.slices(column):
        h, rows = tx.words(raw, off, kind, PREFIXES)
        key = np.unique((rows << BITS) | (h >> tx.U64(64 - BITS)).astype(np.int64))
        yield at, n, key & ((1 << BITS) - 1), key >> BITS


def nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of the non-negative risk's minimum, by Adam over mini-batches of both sets, with an L1
    penalty. Words of fewer than MIN_SHARE of the positives have no weight."""
    df = np.bincount(np.concatenate(pos), minlength=1 << BITS)
    kept = np.flatnonzero(df >= max(3, MIN_SHARE * len(pos)))
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    pos, unl = ([(t := number[ids])[t >= 0] for ids in rows] for rows in (pos, unl))
    dim = len(kept)
    w, m, s = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    w[dim] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def batch(rows):
        take = [rows[i] for i in rng.integers(0, len(rows), BATCH)]
        ids = np.concatenate(take)
        at = np.repeat(np.arange(BATCH), [len(t) for t in take])
        return ids, at, np.bincount(at, weights=w[ids], minlength=BATCH) + w[dim]

    for step in range(1, STEPS + 1):
        (pi, pa_, px), (ui, ua, ux) = batch(pos), batch(unl)
        sp, su = sigmoid(px), sigmoid(ux)
        # logistic loss: of a positive -log sigmoid(x), of a negative -log sigmoid(-x)
        negative = np.logaddexp(0, ux).mean() - prior * np.logaddexp(0, px).mean()
        turn = 1.0 if negative >= 0 else -1.0
        gp = prior * (sp - 1) * (turn > 0) - turn * prior * sp
        gu = turn * su
        g = (np.bincount(pi, weights=gp[pa_], minlength=dim + 1) + np.bincount(ui, weights=gu[ua], minlength=dim + 1)) / BATCH
        g[dim] += (gp.sum() + gu.sum()) / BATCH
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        rate = RATE / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
        w -= rate * (m / (1 - 0.9**step))
        w[:dim] = np.sign(w[:dim]) * np.maximum(0, np.abs(w[:dim]) - rate[:dim] * L1)
    out = np.zeros(1 << BITS)
    out[kept] = w[:dim]
    return out, float(w[dim])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """docs: doc_id, text; labels: doc_id, toxic. The model, or None without confirmed examples."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return None
    prior = min(0.5, max(0.01, toxic / n))
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    first = lambda df, k: df.select("doc_id", h.alias("h")).distinct().orderBy("h", "doc_id").limit(k).select("doc_id")
    pos = first(known.where("toxic = 1"), POSITIVES).withColumn("positive", F.lit(True))
    unl = first(docs.where("doc_id is not null").where(fold() != 0), UNLABELLED).withColumn("positive", F.lit(False))
    chosen = F.broadcast(pos.unionByName(unl))  # at most POSITIVES + UNLABELLED ids
    sample = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text")

    def run(batches):
        for b in batches:
            got = [np.empty(0, np.int64)] * b.num_rows
            for at, k, ids, rows in features(b.column("text")):
                cut = tx.runs(rows, k)
                for i in range(k):
                    got[at + i] = ids[cut[i] : cut[i + 1]]
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([x.astype(np.int32).tobytes() for x in got], pa.binary())], names=["positive", "ids"])

    rows = sample.mapInArrow(tidy(run), "positive boolean, ids binary").collect()
    sets = {k: [np.frombuffer(r.ids, np.int32).astype(np.int64) for r in sorted((r for r in rows if r.positive is k), key=lambda r: bytes(r.ids))] for k in (True, False)}
    if not sets[True] or not sets[False]:
        return None
    return nnpu(sets[True], sets[False], prior)


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs without the text, with score and predicted."""
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2**BITS weights

    def run(batches):
        w, bias = shared.value
        for b in batches:
            x = np.full(b.num_rows, bias)
            for at, k, ids, rows in features(b.column("_text")):
                x[at : at + k] += np.bincount(rows, weights=w[ids], minlength=k)
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.select(*kept, F.col(text_col).alias("_text")).mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs (doc_id, text), learning from labels (doc_id, toxic)."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels)
    return score(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), model)
