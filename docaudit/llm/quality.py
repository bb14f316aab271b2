"""Quality classifier from weak labels.

Eleven overlapping heuristic labellers look at every document.  Nine name a
defect (signs, shouting, repetition, ...) and vote bad or nothing; two name
plain prose and vote good or nothing.  Expectation-maximisation over the counts
of vote patterns of all documents estimates how often each labeller votes on
good and on bad documents, and the share of good ones (votes independent given
the truth).  The posterior of a pattern is the label of its documents; a linear
scorer on hashed features (byte n-grams and binned labeller quantities) is
fitted to it by logistic regression and decides.

Only pattern counts come to the driver (at most 2**11 rows).  The scorer is
fitted to a documented bounded sample of about ``SAMPLE`` documents chosen by a
hash of the id; votes and their counts cover all documents, and every whole
text is scored.

Defined results: a null, empty or blank text has no words, score 0, and is not
kept.  Repeated rows repeat their result; rows without id are scored like
others.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.textvec import byte_ngrams, pack_rows, row_chunks, shingles, unit_roots, unpack_rows, word_hashes, word_spans

DIMS = 1 << 12
#: Dimensions for binned quantities, and their weight beside the unit n-gram row.
BINNED, WEIGHT = 1 << 8, 0.5
SAMPLE = 5000
#: Quantity, bad from (up to, where below), words that a text needs for the vote.
DEFECTS = (
    ("marks_per_character", 0.15, 8),
    ("signs_per_word", 0.15, 4),
    ("odd_words", 0.2, 2),
    ("capital_letters", 0.35, 8),
    ("shouts_per_word", 0.2, 4),
    ("repeats_of_word_before", 0.1, 8),
    ("different_words", -0.3, 20),
    ("repeated_shingles", 0.4, 8),
    ("repeated_lines", 0.6, 20),
)
#: Good votes: share of plain words; stops a word in a range, with enough different words.
PLAIN, STOPS, VARIED = 0.9, (0.03, 0.3), 0.5
VOTES = len(DEFECTS) + 2
_CLASS = {name: np.zeros(256, np.int32) for name in ("sign", "shout", "mark", "upper", "letter", "stop", "blank")}
_CLASS["sign"][list(b"#$%&*+<=>@[\\]^_`{|}~")] = 1
_CLASS["shout"][list(b"!?")] = 1
_CLASS["mark"][[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_CLASS["upper"][65:91] = 1
_CLASS["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS["stop"][list(b".,;:!?")] = 1
_CLASS["blank"][[9, 10, 11, 12, 13, 32]] = 1


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of different values in each row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(at) - 1)


def quantities(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words by row, rows x labellers matrix of their quantities)."""
    rows = len(at) - 1
    start, end = word_spans(raw, at)
    wat = np.searchsorted(start, at)
    words = np.diff(wat)

    def total(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        run = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(table[raw], out=run[1:])
        return run[hi] - run[lo]

    per = {k: total(t, at[:-1], at[1:]) for k, t in _CLASS.items()}
    row = np.repeat(np.arange(rows), words)
    letters = total(_CLASS["letter"], start, end)
    marks = total(_CLASS["mark"], start, end)
    last = raw[end - 1]
    odd = (letters == 0) & (marks == end - start) | (_CLASS["sign"][last] > 0) | (_CLASS["shout"][last] > 0) & (marks > 1)
    plain = ~odd & (marks * 2 <= end - start)
    hashes = word_hashes(raw, start, end)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    grams, gat = shingles(hashes, wat)
    # lines are told apart by a sum over their words' hashes and places
    breaks = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate([at, breaks + 1]))
    line_words = np.searchsorted(start, cuts)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(line_words[:-1], np.diff(line_words)).astype(np.uint64)
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), out=run[1:])
    some = np.diff(line_words) > 0
    lines = (run[line_words[1:]] - run[line_words[:-1]])[some]
    lat = np.concatenate([[0], np.cumsum(some)])[np.searchsorted(cuts, at)]
    n_lines, n_grams = np.diff(lat), np.diff(gat)
    return words, np.stack(
        [
            _share(per["mark"], np.diff(at) - per["blank"]),
            _share(per["sign"], words),
            _share(np.bincount(row[odd], minlength=rows), words),
            _share(per["upper"], per["letter"]),
            _share(per["shout"], words),
            _share(np.bincount(row[again], minlength=rows), words),
            _share(_distinct(hashes, wat), words),
            _share(n_grams - _distinct(grams, gat), n_grams),
            _share(n_lines - _distinct(lines, lat), n_lines),
            _share(np.bincount(row[plain], minlength=rows), words),
            _share(per["stop"], words),
        ],
        axis=1,
    )


def votes(words: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether each labeller votes (bad for a defect, good for prose) on each row."""
    out = np.zeros((len(words), VOTES), bool)
    for k, (_, bad, least) in enumerate(DEFECTS):
        out[:, k] = (words >= least) & ((q[:, k] >= bad) if bad > 0 else (q[:, k] <= -bad))
    plain, stops, varied = q[:, len(DEFECTS)], q[:, len(DEFECTS) + 1], q[:, 6]
    out[:, -2] = (words > 0) & (plain >= PLAIN)
    out[:, -1] = (words > 0) & (stops >= STOPS[0]) & (stops <= STOPS[1]) & (varied >= VARIED)
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """EM on vote patterns: (posterior of good by pattern, chance[labeller, truth], share of good).

    ``chance[k, t]`` is P(labeller k votes | truth t), t = 1 for good.  It starts
    from defects that are named on a third of the bad documents and one in
    fifty of the good ones, which fixes which side is called good.
    """
    n = counts / counts.sum()
    chance = np.array([[0.33, 0.02]] * len(DEFECTS) + [[0.3, 0.9]] * 2)
    share, post = 0.8, np.zeros(len(patterns))
    on = patterns.astype(float)
    for _ in range(rounds):
        like = [on @ np.log(chance[:, t]) + (1 - on) @ np.log(1 - chance[:, t]) + np.log((1 - share, share)[t]) for t in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        moved, post = np.abs(new - post).max(), new
        share = float(np.clip((n * post).sum(), 1e-3, 1 - 1e-3))
        for t, weight in ((0, n * (1 - post)), (1, n * post)):
            # a prior worth a thousandth of the documents keeps rare votes from certainty
            chance[:, t] = (weight @ on + 0.0005) / (weight.sum() + 0.001)
        if moved < 1e-9:
            break
    return post, chance, share


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, votes, hashed feature rows)."""
    words, q = quantities(raw, at)
    binned = np.zeros((len(words), BINNED), np.float32)
    for k in range(q.shape[1]):
        level = np.minimum(np.floor(np.sqrt(q[:, k]) * 16), 31).astype(np.int64)
        binned[np.arange(len(words)), (k * 0x9E37 + level * 0x79B9 >> 3) % BINNED] += WEIGHT
    return words, votes(words, q), np.hstack([unit_roots(byte_ngrams(raw, at, DIMS)), binned])


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; good and bad count alike, ``x`` ends in ones."""
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - np.float32(rate) * (x.T @ (weight * (p - y)) + np.float32(decay) * ahead)
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def _votes_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, at in row_chunks(batch.column(0), 2048):
            words, q = quantities(raw, at)
            text = ["".join("01"[v] for v in row) for row in votes(words, q)[words > 0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["pattern"])


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, raw, at in row_chunks(batch.column(0), 256):
            words, v, x = features(raw, at)
            some = np.flatnonzero(words > 0)
            text = ["".join("01"[c] for c in row) for row in v[some].tolist()]
            keys = batch.column(1).slice(first, n).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pack_rows(x[some]), keys], ["pattern", "x", "key"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray | None, dict[str, float], np.ndarray]:
    """(scorer, posterior of each vote pattern, labeller chances) from all documents' votes; scorer None without documents."""
    text = df.select(F.col(text_col).alias("text"))
    counted = text.mapInArrow(_votes_task, "pattern string").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    if not counted:
        return None, {}, np.zeros((0, 2))
    counts = np.array([r["n"] for r in counted], float)
    patterns = np.array([[c == "1" for c in r["pattern"]] for r in counted])
    post, chance, _ = estimate(patterns, counts)
    label = {r["pattern"]: float(p) for r, p in zip(counted, post)}
    key = F.xxhash64(F.lit(23), F.col(id_col), F.col(text_col))
    draw = (F.pmod(key, F.lit(1 << 20)) + 0.5) / (1 << 20)
    rows = df.where(draw <= min(1.0, sample / counts.sum())).select(F.col(text_col).alias("text"), key.alias("key"))
    # rows without id that share a text share their draw, hence the bound
    got = rows.mapInArrow(_sample_task, "pattern string, x binary, key long").orderBy("key", "pattern", "x").limit(2 * sample).select("pattern", "x").toArrow()
    if not got.num_rows:
        return None, label, chance
    y = np.array([label[p] for p in got["pattern"].to_pylist()], np.float32)
    return fit_scorer(unpack_rows(got["x"], DIMS + BINNED), y), label, chance


def score(df: DataFrame, scorer: np.ndarray | None, label: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, posterior, score, kept) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, raw, at in row_chunks(batch.column(1), 256):
                words, v, x = features(raw, at)
                post = [label.get("".join("01"[c] for c in row), 0.0) for row in v.tolist()]
                got = np.array(post) if scorer is None else 1 / (1 + np.exp(-np.clip(x @ scorer[:-1] + scorer[-1], -30, 30).astype(np.float64)))
                got = np.where(words > 0, got, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.where(words > 0, post, 0.0)), pa.array(got), pa.array(got >= 0.5)],
                    ["id", "posterior", "score", "kept"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(task, f"id {kind}, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``df`` and score it: (id, posterior, score, kept)."""
    scorer, label, _ = train(df, id_col, text_col)
    return score(df, scorer, label, id_col, text_col)


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that the classifier keeps, its columns unchanged; scored in the scan, so nothing is joined."""
    scorer, label, _ = train(df, id_col, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for first, n, raw, at in row_chunks(texts, 256):
                words, v, x = features(raw, at)
                if scorer is None:
                    got = np.array([label.get("".join("01"[c] for c in row), 0.0) for row in v.tolist()])
                else:
                    got = x @ scorer[:-1] + scorer[-1] + 0.5
                yield batch.slice(first, n).filter(pa.array((words > 0) & (got >= 0.5)))

    return df.mapInArrow(task, df.schema)
