"""Language identification by interpolated Kneser-Ney character models.

A model per language holds, for every order, the discounted n-gram shares and the back-off weights under
sorted 64-bit hashes of the n-grams.  Letters are lower-cased code points of any script, each of its own;
runs of everything else are one blank.  A text goes to the language with the lowest cross-entropy a
character; one whose best cross-entropy is above what that language's training texts show is rejected.

Defined results: null text or a text without letters -> ``und``, score 0, rejected; equal texts, repeated
rows too, get equal rows; an empty table gives an empty result; with nothing to learn from every text is
``und``; ties go to the first language by name; texts of any length are scored whole, very long ones in
pieces that overlap, which gives the same sums; columns other than doc_id, text and lang are not read, and
keep_known() passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import code_points, id_hash_mod, mix64, text_blocks

ORDER = 4
#: Codes that are looked up at once; some dozen columns of as many 64-bit values are held meanwhile.
BLOCK_CHARS = 400_000
#: Labelled texts for each language that a model is fitted on, in expectation (chosen by a hash of the id).
TEXTS_PER_LANGUAGE = 1500
DISCOUNT = 0.75
#: A text is rejected beyond the mean cross-entropy by so many standard errors plus the calibrated slack.
STANDARD_ERRORS = 6.0
LEAST_SLACK = 0.35
UNDETERMINED = "und"
#: N-grams that a task remembers before it starts anew; slots of its direct index.
REMEMBERED = 1 << 20
SLOT_BITS = 20


@dataclass
class Model:
    languages: list[str]
    #: by language and order (0-based): sorted keys, shares; sorted context keys, back-off weights
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    #: different letters of the sample in all languages: a letter that a language never showed gets one of so many shares
    letters: int
    mean: np.ndarray
    spread: np.ndarray
    slack: np.ndarray


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Every code point to itself where str.isalpha() holds, to 0 (blank) elsewhere."""
    if not _LETTER:
        _LETTER.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000))
    return _LETTER[0]


def _squeezed(code: np.ndarray, starts: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of blanks as one, and where each stretch then starts; the ORDER - 1 codes that lead a stretch stay."""
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    for k in range(ORDER - 1):
        keep[starts + k] = True
    if breaks is not None:
        keep &= ~breaks
    at = np.cumsum(keep) - keep
    return code[keep], at[starts]


def stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of all texts in blocks: (codes, where each stretch starts, its text's number).

    A stretch is a text led by ORDER - 1 blanks.  A text beyond BLOCK_CHARS makes several, each led by the
    codes that end the one before, so that every n-gram occurs once.
    """
    lead = " " * (ORDER - 1)
    low = [t.lower() for t in texts]
    long_ = [i for i, t in enumerate(low) if len(t) > BLOCK_CHARS]
    short = [i for i, t in enumerate(low) if len(t) <= BLOCK_CHARS]
    k = 0
    while k < len(short):
        end, size = k, 0
        while end < len(short) and (end == k or size + len(low[short[end]]) <= BLOCK_CHARS):
            size += len(low[short[end]])
            end += 1
        points = code_points(lead + ("\n" + lead).join(low[i].replace("\n", " ") for i in short[k:end]))
        breaks = points == 10
        starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
        yield *_squeezed(_letters()[points], starts, breaks), np.array(short[k:end])
        k = end
    for i in long_:
        tail = np.zeros(ORDER - 1, dtype=np.uint32)
        for k in range(0, len(low[i]), BLOCK_CHARS):
            own = np.concatenate([tail, _letters()[code_points(low[i][k : k + BLOCK_CHARS])]])
            code, starts = _squeezed(own, np.zeros(1, dtype=np.int64))
            yield code, starts, np.array([i])
            tail = code[-(ORDER - 1) :]


#: Odd multipliers, one for each place counted from the last letter, and a mark for each length.
_PLACES = mix64(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)
_MARKS = mix64(np.arange(101, 102 + ORDER, dtype=np.uint64))


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given by columns of codes, first letter first."""
    n = len(columns)
    total = np.full(len(columns[0]) if columns else 1, _MARKS[n])
    for place, column in enumerate(reversed(columns)):
        total = total + column.astype(np.uint64) * _PLACES[place]
    return mix64(total)


def _whole(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions whose next ORDER codes lie in one stretch."""
    ok = np.ones(max(len(code) - ORDER + 1, 0), dtype=bool)
    for d in range(1, ORDER):
        ok[starts[1:] - d] = False
    return np.flatnonzero(ok)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _context(columns: list[np.ndarray], rows: int) -> np.ndarray:
    return _hashed(columns) if columns else np.broadcast_to(_hashed([]), rows)


def log_shares(model: Model, grams: np.ndarray) -> np.ndarray:
    """ln p of each row's last code after the others (rows of ORDER codes); a column for each language."""
    columns = [grams[:, k] for k in range(ORDER)]
    keys = [(_hashed(columns[ORDER - n :]), _context(columns[ORDER - n : -1], len(grams))) for n in range(1, ORDER + 1)]
    out = np.empty((len(grams), len(model.languages)), dtype=np.float32)
    for j, orders in enumerate(model.tables):
        p = np.full(len(grams), 1.0 / (model.letters + 2))
        for (own, before), (known, share, contexts, weight) in zip(keys, orders, strict=True):
            p = _look_up(known, share, own, 0.0) + _look_up(contexts, weight, before, 1.0) * p
        out[:, j] = np.log(np.maximum(p, 1e-12))
    return out


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The tables of one language from its different n-grams of the full order (rows of codes) and their counts."""
    tables = []
    counts = counts.astype(float)
    for n in range(ORDER, 0, -1):
        columns = [grams[:, k] for k in range(n)]
        keys = _hashed(columns)
        contexts, inverse = np.unique(_context(columns[:-1], len(grams)), return_inverse=True)
        total = np.bincount(inverse, weights=counts)
        share = np.maximum(counts - DISCOUNT, 0) / total[inverse]
        order = np.argsort(keys)
        tables.append((keys[order], share[order], contexts, 1 - np.bincount(inverse, weights=share)))
        if n > 1:  # lower orders count the different letters before
            _, first, counts = np.unique(_hashed(columns[1:]), return_index=True, return_counts=True)
            grams, counts = grams[first, 1:], counts.astype(float)
    return tables[::-1]


class Scorer:
    """Sums of ln p for each text and language.  Shares of n-grams seen before are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.places = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.rows = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        #: the last n-gram looked up in each slot and its row
        self.slot_key, self.slot_row = np.zeros(1 << SLOT_BITS, dtype=np.uint64), np.full(1 << SLOT_BITS, -1, dtype=np.int32)

    def _numbers(self, key: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """Rows of self.rows for the n-grams, new ones added."""
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = np.where(self.slot_key[slot] == key, self.slot_row[slot], -1)
        rest = np.flatnonzero(found < 0)
        if not len(rest):
            return found
        wanted, first, inverse = np.unique(key[rest], return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, wanted)
        known = np.zeros(len(wanted), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted
        place = np.where(known, self.places[np.minimum(at, max(len(self.keys) - 1, 0))] if len(self.keys) else 0, 0)
        new = np.flatnonzero(~known)
        if len(new):
            place[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.rows = np.concatenate([self.rows, log_shares(self.model, np.column_stack([c[rest[first[new]]] for c in columns]))])
            self.keys, self.places = np.insert(self.keys, at[new], wanted[new]), np.insert(self.places, at[new], place[new])
        slots = (wanted >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot_key[slots], self.slot_row[slots] = wanted, place
        found[rest] = place[inverse]
        return found

    def __call__(self, texts: list[str], spread: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums by language, sums of squares by language (zeros unless spread), scored characters and letters of each text."""
        n_lang = len(self.model.languages)
        sums, squares = np.zeros((len(texts), n_lang)), np.zeros((len(texts), n_lang))
        chars, letters = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for code, starts, who in stretches(texts):
            lengths = np.append(starts[1:], len(code)) - starts - (ORDER - 1)
            some = np.flatnonzero(lengths > 0)
            is_letter = np.append(0, np.cumsum(code > 0))
            # a stretch's lead belongs to the one before
            letters[who] += is_letter[np.append(starts[1:], len(code))] - is_letter[starts + ORDER - 1]
            chars[who] += lengths
            if not len(some) or not n_lang:
                continue
            if len(self.keys) > REMEMBERED:
                self._forget()
            at = _whole(code, starts)
            columns = [code[at + k] for k in range(ORDER)]
            numbers = self._numbers(_hashed(columns), columns)
            first = np.append(0, np.cumsum(lengths))[:-1]
            for j in range(n_lang):
                column = self.rows[:, j][numbers]
                sums[who[some], j] += np.add.reduceat(column, first[some], dtype=float)  # a text is once in a block
                if spread:
                    squares[who[some], j] += np.add.reduceat(column * column, first[some], dtype=float)
        return sums, squares, chars, letters


def _training(docs: DataFrame, per_language: int) -> DataFrame:
    """The bounded sample of labelled texts: (lang, text)."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_hash_mod("doc_id", 5) != 0))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return learn.select("lang", "text")
    shares = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 20, -(-(per_language << 20) // n)))]
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    rank = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 20))
    return learn.where(rank < share).select("lang", "text")


def fit(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Fits on at most about per_language texts of each language, outside the held-out fifth.

    Executors count n-grams; the driver gets the different n-grams of the bounded sample only.
    """
    sample = _training(docs, per_language)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for rows, texts in text_blocks(batch):
                for lang in sorted({langs[i] for i in rows}):
                    for code, starts, _ in stretches([t for i, t in zip(rows, texts, strict=True) if langs[i] == lang]):
                        at = _whole(code, starts)
                        _, first, n = np.unique(_hashed([code[at + k] for k in range(ORDER)]), return_index=True, return_counts=True)
                        grams = np.column_stack([code[at[first] + k] for k in range(ORDER)]).astype("<u4")
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count_grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    codes = np.frombuffer(b"".join(map(bytes, grams["gram"])), dtype="<u4").reshape(-1, ORDER)
    languages = sorted(grams["lang"].unique())
    owners, n = grams["lang"].to_numpy(), grams["n"].to_numpy()
    tables = [kneser_ney(codes[owners == lang], n[owners == lang]) for lang in languages]
    letters = len(np.setdiff1d(codes, [0]))
    none = np.zeros(len(languages))
    model = Model(languages, tables, letters, none, none, none)
    if not languages:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for rows, texts in text_blocks(batch):
                sums, squares, chars, letters_ = scorer(texts)
                own = np.array([languages.index(langs[i]) for i in rows])
                at = np.arange(len(rows))
                ok = letters_ > 0
                columns = [own, sums[at, own], squares[at, own], chars]
                yield pa.RecordBatch.from_arrays([pa.array(c[ok], t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["own", "s", "q", "n"])

    seen = sample.mapInArrow(measure, "own long, s double, q double, n long").toPandas()
    mean, spread, slack = none.copy(), none.copy(), none + LEAST_SLACK
    for j in range(len(languages)):
        own = seen[seen["own"] == j]
        if len(own):
            n = own["n"].to_numpy(float)
            mean[j] = -own["s"].sum() / n.sum()
            spread[j] = np.sqrt(max(own["q"].sum() / n.sum() - mean[j] ** 2, 1e-6))
            excess = -own["s"].to_numpy() / n - mean[j] - STANDARD_ERRORS * spread[j] / np.sqrt(n)
            slack[j] = max(LEAST_SLACK, 1.25 * float(np.quantile(excess, 0.999)))
    return Model(languages, tables, letters, mean, spread, slack)


def decide(model: Model, sums: np.ndarray, chars: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score in 0..1, cross-entropy of the best language and rejection of each text."""
    n = len(chars)
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
    entropy = -sums / np.maximum(chars, 1)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(n), best]
    # the posterior share of the best language, each text weighing as 20 characters at most
    score = 1 / np.exp(-(entropy - least[:, None]) * np.minimum(chars, 20)[:, None]).sum(axis=1)
    limit = model.mean[best] + STANDARD_ERRORS * model.spread[best] / np.sqrt(np.maximum(chars, 1)) + model.slack[best]
    blank = letters == 0
    names = [UNDETERMINED if b else model.languages[k] for b, k in zip(blank, best, strict=True)]
    return names, np.where(blank, 0.0, score), np.where(blank, 0.0, least), blank | (least > limit)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every text."""
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for rows, texts in text_blocks(batch):
                sums, _, chars, letters = scorer(texts, spread=False)
                names, score, entropy, rejected = decide(model, sums, chars, letters)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, without those whose text is rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for rows, texts in text_blocks(batch):
                sums, _, chars, letters = scorer(texts, spread=False)
                rejected = decide(model, sums, chars, letters)[3]
                yield batch.take(pa.array(np.asarray(rows)[~rejected]))

    return docs.mapInArrow(run, docs.schema)
