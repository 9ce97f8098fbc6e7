"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature.

Document frequencies are counted over all learnable texts. The classifier is fitted on a bounded sample, at most
SAMPLE_PER_CLASS texts of each language, those first by the hash of their id; a fifth of it sets the temperature. A feature
is one of 2**BITS hashed n-grams of up to ORDERS characters: its share of the text's n-grams times its inverse document
frequency, so a text's logits are a mean over its n-grams, which one pass over whole texts gives.

Learnable texts are those whose fold isn't 0 and whose language isn't null. Defined results: null texts and texts without
a letter give `und` with score 0; where nothing can be learned all texts give `und` with score 0; repeated rows are
judged each on their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import texts as tx
from .common import fold, give_back, ship, tidy

BITS, ORDERS = 16, 3
SAMPLE_PER_CLASS = 1500
#: Languages that can be told apart at most; more are an error.
MAX_CLASSES = 500
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.05, 3
#: A relative frequency times this is a feature's value.
SCALE = 100.0
ROWS = 64
SLOTS = 256
UNDECIDED = "und"


def _parts(column: pa.Array):
    """Texts of a column in lists of at most ROWS texts or about SLICE_BYTES characters."""
    held, size = [], 0
    for s in column:
        t = s.as_py()
        held.append(t)
        size += len(t or "")
        if len(held) >= ROWS or size >= tx.SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def document_frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, and how many texts there are. Each task sends one row of counts for
    each of SLOTS ranges of n-grams, and ranges are summed apart."""
    dim, width = 1 << BITS, (1 << BITS) // SLOTS

    def count(batches):
        letter, df, n = tx.letters(), np.zeros(dim, np.int64), 0
        for batch in batches:
            for part in _parts(batch.column(0)):
                seen = np.zeros(len(part) * dim, bool)
                for grams, rows in zip(*tx.char_ngrams(part, ORDERS, BITS, letter)[:2], strict=True):
                    seen[rows * dim + grams] = True
                df += seen.reshape(len(part), dim).sum(0)
                n += len(part)
        if n:
            cut = df.reshape(SLOTS, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([r.tobytes() for r in cut], pa.binary()), pa.array([n] * SLOTS, pa.int64())], names=["slot", "df", "n"])

    def add(key, rows):
        df, n = np.zeros(width, np.int64), 0
        for x, k in zip(rows.column("df"), rows.column("n"), strict=True):
            df += np.frombuffer(x.as_buffer(), np.int64)
            n += k.as_py()
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "df": pa.array([df.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    rows = learn.select("text").mapInArrow(tidy(count), "slot int, df binary, n long").groupBy("slot").applyInArrow(add, "slot int, df binary, n long").collect()
    df, n = np.zeros((SLOTS, width), np.int64), 0
    for r in rows:  # SLOTS rows
        df[r.slot], n = np.frombuffer(r.df, np.int64), r.n
    return df.ravel(), n


def sparse(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and their values."""
    out = []
    for t in texts:
        grams = np.concatenate(tx.char_ngrams([t], ORDERS, BITS, tx.letters())[0])
        ids, counts = np.unique(grams, return_counts=True)
        out.append((ids, counts / max(1, len(grams)) * idf[ids] * SCALE))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows, labels: np.ndarray, classes: int, seed: int = 7) -> np.ndarray:
    """Weights (2**BITS + 1, classes), the last row the intercepts, by FTRL-proximal with per-coordinate rates."""
    dim = (1 << BITS) + 1
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weights(ids):
        zi, ni = z[ids], n[ids]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            ids, x = np.append(ids, dim - 1), np.append(x, 1.0)
            w = weights(ids)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += g * g
    return weights(np.arange(dim))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(learn: DataFrame) -> dict | None:
    """learn: doc_id, text, lang. The model, or None where there is nothing to learn."""
    counts = learn.where("lang is not null").groupBy("lang").count().limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"there are more than {MAX_CLASSES} languages")
    if not counts:
        return None
    langs = sorted(r.lang for r in counts)
    h = F.xxhash64(F.col("doc_id"), F.lit(7))
    near = F.lit(False)
    for r in counts:  # so few of each language that a window over them is small
        share = min(1.0, 1.3 * (SAMPLE_PER_CLASS + 200) / r["count"])
        near = near | ((F.col("lang") == r.lang) & (F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000)))
    ranked = learn.where("lang is not null").where(near).select("lang", "text", "doc_id", h.alias("h"))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    sample = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE_PER_CLASS).orderBy("lang", "r").collect()
    df, n = document_frequencies(learn)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    rows, labels = sparse([r.text for r in sample], idf), np.array([langs.index(r.lang) for r in sample])
    own = np.array([r.r % 5 != 0 for r in sample])
    weights = train_ftrl([x for x, k in zip(rows, own, strict=True) if k], labels[own], len(langs))
    logits = np.array([x @ weights[ids] + weights[-1] for ids, x in rows]).reshape(len(rows), len(langs))
    t = temperature(logits[~own], labels[~own])
    model = {"langs": langs, "v": (weights[:-1] * idf[:, None] * SCALE / t).astype(np.float32), "b": weights[-1] / t}
    del sample, rows, logits, weights
    give_back()  # the driver goes on to other stages
    return model


def predict(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDECIDED), "score": F.lit(0.0)})
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the hashed features
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        m, letter = shared.value, tx.letters()
        v, langs = m["v"], np.array([*m["langs"], UNDECIDED], object)
        for batch in batches:
            best, score = [], []
            for part in _parts(batch.column(batch.schema.get_field_index(text_col))):
                grams, rows, has = tx.char_ngrams(part, ORDERS, BITS, letter)
                total, n = np.zeros((len(part), v.shape[1])), np.zeros(len(part))
                for g, r in zip(grams, rows, strict=True):
                    if len(g):
                        first = np.flatnonzero(np.diff(r, prepend=-1))
                        total[r[first]] += np.add.reduceat(v[g], first, axis=0)
                        n += np.bincount(r, minlength=len(part))
                p = softmax(total / np.maximum(n, 1)[:, None] + m["b"])
                top = np.where(has, p.argmax(1), len(langs) - 1)
                best += langs[top].tolist()
                score += np.where(has, p.max(1), 0.0).tolist()
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*kept).mapInArrow(tidy(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs (doc_id, text, lang)."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(fold() != 0).where("lang is not null and text is not null"))
    out = predict(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
