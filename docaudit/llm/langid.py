"""Language identification with error-correcting output codes.

Every language has a codeword of bits, far from the others.  One binary
classifier a bit (ridge regression on hashed byte n-grams) predicts it; decoding
adds up, for each codeword, the linear loss of every bit, weighted by how often
that bit's classifier was right on that language, and takes the smallest.  A
prediction whose two best codewords are closer than ``margin`` is flagged.

Training rows are a documented bounded sample: about ``sample`` documents in
all, as many of each language as of the others where there are enough, chosen
by a hash of the id.  All labelled rows count for the language list.  Scoring
reads every whole text once; the model is ``DIMS`` x bits numbers.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if no row can be learned from.  Null labels are not learned.
Rows without id are learned from and have ``held_out`` false.  Repeated rows
repeat their result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.textvec import byte_ngrams, pack_rows, row_chunks, unit_roots, unpack_rows

DIMS = 1 << 12
#: About so many training documents in all.
SAMPLE = 3000
#: Gap of weighted losses (of a range of 2) under which a prediction is ambiguous.
MARGIN = 0.1
#: Letters in lower case, bytes beyond ASCII as they are, all else a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # languages x bits, rows sum to 1
    scorer: np.ndarray  # (DIMS + 1) x bits


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n codewords of -1 and 1: of seeded draws the one whose closest pair is farthest apart."""
    bits = max(15, 8 * int(np.ceil(np.log2(max(n, 2)))))
    rng = np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(200):
        c = rng.choice([-1, 1], (n, bits))
        apart = (c[:, None, :] != c[None, :, :]).sum(axis=2) + bits * np.eye(n, dtype=int)
        both = (np.abs(c.sum(axis=0)) < n).all() or n == 1  # a bit that all share tells nothing
        if both and apart.min() > most:
            best, most = c, apart.min()
    return best if best is not None else c


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, rows, unit feature rows) of a text column."""
    for first, n, raw, at in row_chunks(texts, 256):
        yield first, n, unit_roots(byte_ngrams(_FOLD[raw], at, DIMS))


def fit(langs: list[str], x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Model:
    """Bit classifiers by ridge regression, and each one's accuracy on each language; ``x`` ends in ones and is scaled in place."""
    codes = codewords(len(langs))
    goal = codes[y].astype(np.float32)
    share = 1 / np.bincount(y, minlength=len(langs)).clip(1)[y]  # every language counts alike
    root = np.sqrt(share * len(x) / len(langs)).astype(np.float32)[:, None]
    x *= root
    few = len(x) < x.shape[1]
    gram = (x @ x.T if few else x.T @ x).astype(np.float64)
    gram[np.diag_indices_from(gram)] += ridge * len(x)
    w = x.T @ np.linalg.solve(gram, goal * root) if few else np.linalg.solve(gram, x.T @ (goal * root))
    right = np.sign(x @ w) == goal  # the scale of a row does not turn its sign
    accuracy = np.array([right[y == k].mean(axis=0) if (y == k).any() else np.ones(codes.shape[1]) for k in range(len(langs))]) + 1e-6
    return Model(langs, codes, accuracy / accuracy.sum(axis=1, keepdims=True), w.astype(np.float32))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, score, gap to the next) of feature rows, by loss-weighted decoding."""
    said = np.clip(x @ model.scorer[:-1] + model.scorer[-1], -1, 1)
    loss = -(said @ (model.codes * model.weights).T)  # linear loss: minus the agreement with each codeword
    order = np.argsort(loss, axis=1, kind="stable")
    rows = np.arange(len(x))
    best = order[:, 0]
    gap = loss[rows, order[:, 1]] - loss[rows, best] if loss.shape[1] > 1 else np.full(len(x), 2.0)
    odds = np.exp(-6 * (loss - loss[rows, best][:, None]))
    return best, 1 / odds.sum(axis=1), gap


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from the rows that are not held out and have a label and a text."""
    learn = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["k"]: r["n"] for r in learn.groupBy(F.col(lang_col).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = sample / len(langs)
    key = F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col))
    draw = (F.pmod(key, F.lit(1 << 20)) + 0.5) / (1 << 20)
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, each / counts[k]))]), F.col(lang_col))
    rows = learn.where(draw <= share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("key"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pack_rows(x), batch.column(2).slice(first, n)], ["lang", "x", "key"])

    # in a fixed order: the same model whatever order the rows arrive in.  Rows without id that share a text share their draw, hence the bound
    got = rows.mapInArrow(task, "lang string, x binary, key long").orderBy("key", "lang", "x").limit(2 * sample + len(langs)).select("lang", "x").toArrow()
    if not got.num_rows:
        return None
    place = {k: i for i, k in enumerate(langs)}
    y = np.array([place[k] for k in got["lang"].to_pylist()])
    return fit(langs, unpack_rows(got["x"], DIMS), y)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for first, n, x in features(texts):
                lang, score, unsure = ["und"] * n, [0.0] * n, [True] * n
                if model is not None:
                    best, sure, gap = decode(model, x)
                    for i in range(n):
                        text = texts[first + i].as_py()
                        if text and any(c.isalpha() for c in text):
                            lang[i], score[i], unsure[i] = model.langs[best[i]], float(sure[i]), bool(gap[i] < margin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                    ["id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    rows = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(task, f"id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def language_id(df: DataFrame, **names) -> DataFrame:
    """Train on the rows that are not held out, predict all."""
    return predict(df, train(df, **names), **{k: v for k, v in names.items() if k in ("id_col", "text_col")})
