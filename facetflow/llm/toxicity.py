"""Toxicity by a factorization machine over hashed terms.

Terms are a text's different words (lower-cased runs of letters) and their openings of 4 and 5 letters,
hashed to 32 bits.  A factorization machine learns a weight and a vector for each kept term: the score is a
logistic function of the sum of weights and of all pairs' inner products, so that, say, an insult beside
the name of a group may count for more than both alone.

Kept are terms that tell the classes apart by themselves (chi-squared at least LEAST_GAIN), and terms that do so
in pairs: where documents with both differ from what the two terms' own log odds add up to by more than chance
would bring among all pairs.  All pairs that PAIR_DOCS documents of the sample hold are tried of terms that tell by
themselves or that PAIR_SHARE of it holds, however many they are; terms meet by blocks, so a task holds the counts
of two blocks.  A rarer term without a signal of its own isn't found by its pairs.  Noise has no part in a score.

The model is fitted on a bounded sample: at most about SAMPLE labelled documents outside the held-out
quarter, chosen by a hash of the id; its hashed terms are stored once; executors count terms and pairs, and the driver
gets the sample's kept terms.  Every document is scored by its whole text.

Defined results: a null or empty text has no terms and gets the score of the bias alone; equal texts get
equal scores; without labelled rows of both classes every score is 0; an empty table gives an empty result;
texts of any length are scored whole (as sets of terms); columns other than doc_id and text (in labels: doc_id
and toxic) are not read; a doc_id with both labels counts once for each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import id_and_text, id_hash_mod, text_blocks
from facetflow.operators.tables import discard, stored

SAMPLE = 20_000
#: The least chi-squared statistic of a term that is kept by itself: noise stays out.
LEAST_GAIN = 15.0
LEAST_DOCS = 5
#: Documents that hold both terms of a pair, and pairs that chance may bring out among all that are tried.
PAIR_DOCS, BY_CHANCE = 20, 0.01
#: The share of the sample that holds a term that is tried in pairs though it tells nothing by itself.
PAIR_SHARE = 0.01
#: Terms of a block; documents that are counted at a time.
BLOCK_TERMS, BLOCK_DOCS = 1024, 2048
FACTORS = 8
EPOCHS = 30
BATCH = 256
THRESHOLD = 0.3
OPENINGS = (4, 5)
REMEMBERED = 500_000
WORD = re.compile(r"[^\W\d_]+")


def term_hashes(word: str) -> list[int]:
    out = [zlib.crc32(word.encode())]
    out += [zlib.crc32(f"{word[:k]}\x00{k}".encode()) for k in OPENINGS if len(word) > k]
    return out


@dataclass
class Model:
    terms: dict[int, int]  # hash -> row
    bias: float
    weights: np.ndarray
    factors: np.ndarray


class Terms:
    """Rows of the kept terms of texts; words are looked up once."""

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept = kept
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        known, kept = self.known, self.kept
        for word in set(WORD.findall(text.lower())):
            rows = known.get(word)
            if rows is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                rows = term_hashes(word)
                if kept is not None:
                    rows = [kept[h] for h in rows if h in kept]
                known[word] = rows
            if rows:
                found.update(rows)
        return np.fromiter(found, dtype=np.int64, count=len(found))


def logits(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    """Of documents by their terms, each in ascending order so that sums don't depend on sets."""
    out = np.full(len(rows), model.bias)
    for i, own in enumerate(rows):
        if len(own):
            own = np.sort(own)
            v = model.factors[own]
            s = v.sum(axis=0)
            out[i] += model.weights[own].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
    return out


def train(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by mini-batches of the logistic loss (adaptive steps, small penalties)."""
    rng = np.random.default_rng(seed)
    width = max(1, max(map(len, rows)))
    weights = np.zeros(n_terms + 1)
    factors = rng.normal(0, 0.01, (n_terms + 1, FACTORS))
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(rate / (1 - rate)))
    step_w, step_v, step_b = np.full(n_terms + 1, 1e-8), np.full((n_terms + 1, FACTORS), 1e-8), 1e-8
    order = np.arange(len(rows))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            wide = max(1, max(len(rows[i]) for i in batch))
            at = np.full((len(batch), min(wide, width)), n_terms)
            for r, i in enumerate(batch):
                at[r, : len(rows[i])] = rows[i]
            real = at < n_terms
            v = factors[at] * real[:, :, None]
            s = v.sum(axis=1)
            z = bias + (weights[at] * real).sum(axis=1) + 0.5 * (s * s - (v * v).sum(axis=1)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            # gradients by term, through one sum over all places
            flat = at[real]
            gw = np.bincount(flat, weights=np.broadcast_to(g[:, None], at.shape)[real], minlength=n_terms + 1)
            inner = g[:, None, None] * (s[:, None, :] - v)
            gv = np.stack([np.bincount(flat, weights=inner[:, :, f][real], minlength=n_terms + 1) for f in range(FACTORS)], axis=1)
            touched = np.unique(flat)
            gw[touched] += 3e-4 * weights[touched]
            gv[touched] += 1e-3 * factors[touched]
            step_w += gw * gw
            step_v += gv * gv
            step_b += g.sum() ** 2
            weights -= 0.2 * gw / np.sqrt(step_w)
            factors -= 0.03 * gv / np.sqrt(step_v)
            bias -= 0.05 * g.sum() / np.sqrt(step_b)
    return bias, weights[:-1], factors[:-1]


def odds(p: np.ndarray | float) -> np.ndarray | float:
    return np.log(p / (1 - p))


def deviance(seen: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of seen out of n against the rate p; chance reaches d with at most exp(-d / 2)."""
    rest = n - seen
    with np.errstate(divide="ignore", invalid="ignore"):
        hits = np.where(seen > 0, seen * np.log(seen / (n * p)), 0)
        misses = np.where(rest > 0, rest * np.log(rest / (n * (1 - p))), 0)
    return 2 * (hits + misses)


def paired_terms(seen: DataFrame, n_terms: int, rate: float) -> list[int]:
    """Terms (0 .. n_terms - 1) of seen(doc, toxic, terms) that some other term brings out: the rate of documents
    with both is far from what the log odds of both add up to."""
    blocks = -(-n_terms // BLOCK_TERMS)
    if n_terms < 2:
        return []
    limit = 2 * np.log(n_terms * (n_terms - 1) / 2 / BY_CHANCE)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat, row = flat[flat < n_terms], row[flat < n_terms]
            key = row * blocks + flat // BLOCK_TERMS  # ascending, as terms are within a document
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ends = pa.array(np.append(first, len(key)), pa.int32())
            of = pa.array(row[first])
            within = pa.array((flat % BLOCK_TERMS).astype(np.int16))  # short, as every block meets all others
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(of), batch.column("toxic").take(of), pa.array(key[first] % blocks), pa.ListArray.from_arrays(ends, within)], names=["doc", "toxic", "block", "terms"])

    def compare(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        _, doc = np.unique(rows["doc"], return_inverse=True)
        n_docs = doc.max() + 1
        y = np.zeros(n_docs, dtype=np.float32)
        y[doc] = rows["toxic"]
        places = []
        for block in key:
            own = np.flatnonzero(rows["block"] == block)
            lists = [rows["terms"].iat[i] for i in own]
            at, term = np.repeat(doc[own], [len(x) for x in lists]), np.concatenate([np.empty(0, np.int16), *lists])
            order = np.argsort(at, kind="stable")
            places.append((at[order], term[order]))
        both, bad = np.zeros((BLOCK_TERMS, BLOCK_TERMS)), np.zeros((BLOCK_TERMS, BLOCK_TERMS))
        alone = np.zeros((2, 2, BLOCK_TERMS))  # by side: documents, toxic ones
        for k in range(0, n_docs, BLOCK_DOCS):
            label, sides = y[k : k + BLOCK_DOCS], []
            for side, (at, term) in enumerate(places):
                some = slice(*np.searchsorted(at, (k, k + BLOCK_DOCS)))
                x = np.zeros((len(label), BLOCK_TERMS), dtype=np.float32)
                x[at[some] - k, term[some]] = 1
                alone[side] += x.sum(axis=0), label @ x
                sides.append(x)
            both += sides[0].T @ sides[1]
            bad += (sides[0] * label[:, None]).T @ sides[1]
        own = odds((alone[:, 1] + rate) / (alone[:, 0] + 1))
        expected = np.clip(1 / (1 + np.exp(-(own[0][:, None] + own[1][None, :] - odds(rate)))), 1e-4, 1 - 1e-4)
        told = (both >= PAIR_DOCS) & (deviance(bad, both, expected) >= limit)
        if key[0] == key[1]:
            np.fill_diagonal(told, False)
        found = [block * BLOCK_TERMS + np.flatnonzero(told.any(axis=1 - side)) for side, block in enumerate(key)]
        return pd.DataFrame({"term": np.unique(np.concatenate(found))})

    parts = seen.mapInArrow(by_block, "doc long, toxic int, block long, terms array<short>")
    pairs = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    return sorted(r["term"] for r in pairs.groupBy("one", "two").applyInPandas(compare, "term long").distinct().collect())


def best_shift(z: np.ndarray, labels: np.ndarray) -> float:
    """What to add to logits so that THRESHOLD parts the classes with the best F1 on these documents."""
    order = np.argsort(-z)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + labels.sum())
    k = int(f1.argmax())
    low = z[order[k]]
    next_ = z[order[k + 1]] if k + 1 < len(z) else low - 1
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (low + next_) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from labelled documents outside the held-out quarter; None without both classes."""
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & (id_hash_mod("doc_id", 4) != 2))
    n = learn.count()
    if not n:
        return None
    share = min(1 << 20, -(-(sample << 20) // n))
    chosen = learn.where(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 20)) < share)
    # at most about SAMPLE rows of two numbers, so they may go to every executor; labels of one kind count once
    texts = id_and_text(docs).join(F.broadcast(chosen.distinct()), "doc_id").select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text", "toxic")
    return _fitted(texts)


def _placed(seen: DataFrame, hashes: np.ndarray) -> DataFrame:
    """seen with its terms as places among these hashes, in ascending order; others go."""
    order = np.argsort(hashes)
    known = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            found = known[at] == flat if len(known) else np.zeros(len(flat), dtype=bool)
            row, place = row[found], order[at[found]]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))])
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[np.lexsort((place, row))], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc", "doc_id", "toxic")), own], names=["doc", "doc_id", "toxic", "terms"])

    return seen.mapInArrow(run, "doc long, doc_id long, toxic int, terms array<long>")


def _fitted(texts: DataFrame) -> Model | None:
    """The model of labelled texts(doc, doc_id, text, toxic), a bounded sample; its hashed terms are stored once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for rows, own in text_blocks(batch):
                at = pa.array(rows)
                lists = pa.array([terms(t).astype(np.uint32).view(np.int32) for t in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in ("doc", "doc_id", "toxic")), lists], names=["doc", "doc_id", "toxic", "terms"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            values, inverse = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            y = np.repeat(batch.column("toxic").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            n, toxic = np.bincount(inverse, minlength=len(values)), np.bincount(inverse, weights=y, minlength=len(values))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(n.astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["term", "n", "toxic"])

    seen = stored(texts.mapInArrow(hashed, "doc long, doc_id long, toxic int, terms array<int>"), "toxicity-terms")
    total, bad = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < total:
        discard(seen)
        return None
    counts = seen.mapInArrow(count, "term int, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    expected = F.col("n") * (bad / total)
    gain = (F.col("toxic") - expected) * (F.col("toxic") - expected) / (expected * (1 - bad / total)) / (1.0001 - F.col("n") / total)
    telling = (F.col("n") >= LEAST_DOCS) & (gain >= LEAST_GAIN)
    tried = (F.col("n") >= PAIR_DOCS) & (telling | (F.col("n") >= PAIR_SHARE * total))
    asked = counts.select("term", tried.alias("tried"), telling.alias("telling")).where("tried or telling")
    terms = asked.toPandas().sort_values(["tried", "term"], ascending=[False, True])  # those tried in pairs come first
    hashes = terms["term"].to_numpy(dtype=np.int32)
    paired = paired_terms(_placed(seen, hashes), int(terms["tried"].sum()), bad / total)
    wanted = sorted({*np.flatnonzero(terms["telling"]).tolist(), *paired})
    sample = _placed(seen, hashes[wanted]).toPandas().sort_values(["doc_id", "toxic"])
    discard(seen)
    rows, y = [np.asarray(x, dtype=np.int64) for x in sample["terms"]], sample["toxic"].to_numpy(dtype=float)
    kept = {int(t) & 0xFFFFFFFF: k for k, t in enumerate(hashes[wanted])}
    # a fifth is kept apart to place the threshold
    apart = np.array([zlib.crc32(f"{d} apart".encode()) % 5 == 0 for d in sample["doc_id"]])
    if not (y[~apart].any() and y[apart].any()):
        apart[:] = False
    bias, weights, factors = train([r for r, a in zip(rows, apart, strict=True) if not a], y[~apart], len(kept))
    model = Model(kept, bias, weights, factors)
    judged = apart if apart.any() else ~apart
    z = logits(model, [r for r, a in zip(rows, judged, strict=True) if a])
    model.bias += best_shift(z, y[judged])
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.terms if model else {})
        for batch in batches:
            for rows, own in text_blocks(batch):
                z = logits(model, [terms(t) for t in own]) if model else np.full(len(own), -np.inf)
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if model else np.zeros(len(own))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
