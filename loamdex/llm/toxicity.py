"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words counts the subsequences of ``LENGTH`` letters they share,
each discounted by ``DECAY`` for every letter it stretches over, normalised and
squared; so a word with letters put in between or left out stays close to the
word it hides. A sentence's value at a landmark word is that of its closest word;
spelled-out letters (``i d i o t``) count as one word too. Landmarks whose longest
common subsequence with a word is under ``SCREEN`` of their letters count as 0
for it, which spares most of the work.

Training (rows with ``crc32(doc_id) mod 5 <> 0`` only) takes at most
``SAMPLE_DOCS`` labelled documents of each class, the ones of least hash, and all
their sentences; a sentence without an end is cut after ``STRETCH`` words, here and
in scoring. Words are counted and sentences mapped by the executors. Landmarks are
the words that mark toxic-labelled sentences most, at most ``POSITIVE`` out of
``CANDIDATES``, and clean words that look like them, at most ``NEGATIVE`` out of
``NEAREST``; sentences are mapped onto them through the inverse root of the landmarks' kernel matrix,
and a linear SVM with squared hinge loss is fitted. A toxic document need not be
toxic in every sentence: its positive sentences are those the last round took
for such, and its best one. A document's margin is that of its worst sentence, and no
less than that of a sentence like no landmark; a logistic curve over the sample's documents makes it a score from 0 to 1.

Scoring covers whole texts of all rows; labels, language, source and ids are no
inputs of a score. Defined results: null and empty texts get the score of no
evidence; without toxic or clean labels all scores are 0; labels that repeat count
as toxic if one of them is; null labels and unknown doc_ids are left out; a null
doc_id is held out; repeated rows get equal scores; words that tie as landmarks come
in order of code points; very long texts are read whole, in sentences of bounded
length; an empty table gives no rows; extra columns stay as they are, except that
``scored`` replaces a column called score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

LENGTH, DECAY, SCREEN = 3, 0.6, 0.7
#: Labelled documents of each class that training takes at most; all their sentences count.
SAMPLE_DOCS = 3000
#: Landmarks among marking and among clean words, at most.
POSITIVE, NEGATIVE = 40, 16
#: Times the rate in clean sentences at which a word that marks toxic ones has to occur.
PURE = 5
#: Marking words and clean words looked at as landmarks, and standard deviations by which a marking one has to stand out.
CANDIDATES, NEAREST, SURE = 400, 300, 1.5
#: Words after which a sentence without an end is cut.
STRETCH = 64
#: Letters of a word that are compared; longer ones are compared in overlapping pieces.
LONGEST = 24
#: Words a worker remembers, and characters of text it looks at together.
REMEMBERED, TOGETHER = 300_000, 2 << 20
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…"


def pieces_of(token: str) -> list[str]:
    """A token's letters, from its start mark on."""
    core = token.lower().strip(_EDGE)
    if not core:
        return []
    word = "^" + core
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def spelled(letters: list[str]) -> list[str]:
    """Words that a run of single letters may spell: an article may stand before them or a letter after."""
    word = "".join(letters)
    return [w for w in dict.fromkeys((word, word[1:], word[:-1], word[1:-1])) if len(w) >= 3]


def sentences_of(text: str) -> list[list[str]]:
    """Words of each sentence, with those that runs of single letters spell."""
    out: list[list[str]] = [[]]
    single: list[str] = []
    since = 0
    for token in [*text.split(), ""]:
        if len(token) == 1:
            single.append(token)
        elif single:
            out[-1] += spelled(single)
            single = []
        if token:
            out[-1].append(token)
            since += 1
            if token[-1] in ".!?" or since == STRETCH:
                out.append([])
                since = 0
    return [s for s in out if s]


def coded(words: list[str]) -> np.ndarray:
    """Code points, padded with -1."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), lengths.max(initial=1)), -1, np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Kernel of row i of a with row i of b (code points, padded with different negative numbers)."""
    equal = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    hits = np.float32(decay * decay) * equal
    along_a, along_b = (np.tril(decay ** np.maximum(np.subtract.outer(np.arange(n), np.arange(n)), 0)).astype(np.float32) for n in (a.shape[1], b.shape[1]))
    now = hits
    for _ in range(length - 1):
        open_ = along_a @ now @ along_b.T
        now = np.zeros_like(hits)
        now[:, 1:, 1:] = hits[:, 1:, 1:] * open_[:, :-1, :-1]
    return now.sum(axis=(1, 2))


class Landmarks:
    """Squared normalised kernel values against a list of landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = coded(words)
        self.codes[self.codes < 0] = -2
        self.own = np.sqrt(np.maximum(subsequence_kernel(np.where(self.codes < 0, -1, self.codes), self.codes), 1e-12))
        self.need = np.maximum(LENGTH, np.ceil(SCREEN * np.array([len(w) for w in words]))).astype(np.int64)
        letters = sorted({c for w in words for c in w})
        self.alphabet = np.array([ord(c) for c in letters], np.int32)
        self.masks = np.zeros((len(letters) + 1, len(words)), np.uint32)
        for j, w in enumerate(words):
            for i, c in enumerate(w):
                self.masks[letters.index(c), j] |= np.uint32(1 << i)
        self.full = np.array([(1 << len(w)) - 1 for w in words], np.uint32)

    def common(self, codes: np.ndarray) -> np.ndarray:
        """Longest common subsequences, bit-parallel."""
        at = np.searchsorted(self.alphabet, codes)
        row = np.where((at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes), at, len(self.alphabet))
        v = np.broadcast_to(self.full, (len(codes), len(self.words))).copy()
        for k in range(codes.shape[1]):
            u = v & self.masks[row[:, k]]
            v = ((v + u) | (v - u)) & self.full
        return np.bitwise_count(self.full) - np.bitwise_count(v)

    def values(self, words: list[str]) -> np.ndarray:
        """words x landmarks, float32."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        by = np.argsort([len(w) for w in words], kind="stable") if words else np.zeros(0, np.int64)
        for start in range(0, len(words), 4096):
            rows = by[start : start + 4096]  # of near equal length
            codes = coded([words[i] for i in rows])
            i, j = np.nonzero(self.common(codes) >= self.need)
            if not len(i):
                continue
            some = np.unique(i)
            own = np.zeros(len(codes))
            own[some] = np.sqrt(np.maximum(subsequence_kernel(codes[some], np.where(codes[some] < 0, -2, codes[some])), 1e-12))
            for at in range(0, len(i), 8192):
                a, b = i[at : at + 8192], j[at : at + 8192]
                near = subsequence_kernel(codes[a], self.codes[b]) / (own[a] * self.own[b])
                out[rows[a], b] = near * near
        return out


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    middle: float = 0.0


class Scorer:
    """Margins of whole texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.at = model, Landmarks(model.landmarks)
        self.rows = np.zeros((1024, len(model.landmarks)), np.float32)
        self.used, self.known = 1, {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > REMEMBERED:
            self.used, self.known = 1, {}
        tokens = [t for t in tokens if t not in self.known]
        parts, owner = [], []
        for k, t in enumerate(tokens):
            for p in pieces_of(t):
                parts.append(p)
                owner.append(k)
        values, row = self.at.values(parts), [0] * len(tokens)
        for i in np.flatnonzero(values.any(axis=1)).tolist():
            k = owner[i]
            if not row[k]:
                row[k] = self.used
                self.used += 1
                if self.used > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[row[k]] = values[i]
            else:
                self.rows[row[k]] = np.maximum(self.rows[row[k]], values[i])
        # what a document needs of a token: its row, whether it is a single letter, whether it ends a sentence
        self.known.update({t: r << 2 | (len(t) == 1) << 1 | (t[-1] in ".!?") for t, r in zip(tokens, row)})

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        split = [t.split() for t in texts]
        self.learn({w for words in split for w in words})
        rows = self.rows
        for k, words in enumerate(split):
            marks = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            row = marks >> 2
            hit = np.flatnonzero(row)
            single = np.flatnonzero((marks >> 1) & 1)
            values, of = rows[row[hit]], hit
            if len(hit) or len(single) >= 3:
                starts = np.r_[0, np.flatnonzero(marks[:-1] & 1) + 1]
                nth = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(marks)]))
                sentence = starts[nth] + (np.arange(len(marks)) - starts[nth]) // STRETCH * STRETCH
                of = sentence[hit]
            if len(single) >= 3:
                more = [(p, sentence[run[-1]]) for run in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1) for w in spelled([words[i] for i in run]) for p in pieces_of(w)]
                if more:
                    values, of = np.concatenate([values, self.at.values([p for p, _ in more])]), np.r_[of, [k for _, k in more]].astype(np.int64)
            if not len(of):
                out[k] = self.model.bias
                continue
            by = np.argsort(of, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(of[by]) > 0])
            best = np.maximum.reduceat(values[by], begins, axis=0)
            out[k] = max((best @ self.model.weights + self.model.bias).max(), self.model.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.landmarks:
            return np.zeros(len(texts))
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            out.append(self.margins(texts[at:end]))
            at = end
        margins = np.concatenate(out) if out else np.zeros(0)
        # rounded, so that scores don't depend on which words were compared together
        return np.round(1 / (1 + np.exp(-np.clip(self.model.slope * margins + self.model.middle, -30, 30))), 6)


def score(text: str | Column, model) -> Column:
    """Score of each whole text; ``model`` is a broadcast Model."""
    kept: list = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Scorer(model.value) if model.value.landmarks else None)
        if kept[0] is None:
            return pd.Series(np.zeros(len(texts)))
        return pd.Series(kept[0].scores([t or "" for t in texts]))

    return scored(text)


def held_out(doc_id: str | Column) -> Column:
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % 5 == 0


def training_sentences(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc, toxic, words) for each sentence of the sample: its distinct pieces of words, in order."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        some = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        chosen = some if chosen is None else chosen.union(some)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("chosen_id"), "toxic"))  # at most 2 * sample_docs rows
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("chosen_id")).select(F.xxhash64("doc_id").alias("doc"), F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = [sorted({p for w in s for p in pieces_of(w)}) for s in sentences_of(batch.column(2)[i].as_py())]
                if words:
                    at = pa.array(np.full(len(words), i))
                    yield pa.RecordBatch.from_pydict({"doc": batch.column(0).take(at), "toxic": batch.column(1).take(at), "words": pa.array(words, pa.list_(pa.string()))})

    return texts.mapInArrow(split, "doc long, toxic int, words array<string>")


def per_word(words: DataFrame, landmarks: list[str], result: str, of_values) -> DataFrame:
    """Rows that ``of_values(batch, values)`` makes of words (word, ...) and their values at the landmarks, a bounded list."""
    shared = words.sparkSession.sparkContext.broadcast(landmarks)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Landmarks(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                yield of_values(part, at.values(part.column(0).to_pylist()))

    return words.mapInArrow(valued, result)


def choose_landmarks(words: DataFrame, ratio: float) -> tuple[list[str], int]:
    """Words that mark toxic-labelled sentences most, unlike each other; then clean words most like them; and how many are of the first kind.

    words: (word, here, there), in how many toxic and clean sentences each word is; ratio: toxic to clean sentences.
    At most ``CANDIDATES`` and ``NEAREST`` words reach the driver.
    """
    long = F.length("word") > LENGTH
    lift = (F.col("here") - ratio * F.col("there")) / F.sqrt(F.col("here") + 1)
    some = words.where(long & (F.col("here") > PURE * ratio * F.col("there"))).orderBy(lift.desc(), "word").limit(CANDIDATES).collect()
    if not some:
        return [], 0
    ranked = [r.word for r in some]
    # words like a candidate are evidence too, for and against it; whole numbers, so that the sum does not depend on its order
    unit = 1 << 16

    def against(batch: pa.RecordBatch, values: np.ndarray) -> pa.RecordBatch:
        n = np.rint(values * unit).astype(np.int64).T @ batch.column(2).to_numpy()
        return pa.RecordBatch.from_pydict({"k": np.arange(len(n)), "n": n})

    clean = np.zeros(len(ranked))
    for r in per_word(words.where("there > 0"), ranked, "k long, n long", against).groupBy("k").agg(F.sum("n").alias("n")).collect():
        clean[r.k] = ratio * r.n / unit
    for_it = Landmarks(ranked).values(ranked).T @ np.array([float(r.here) for r in some])
    sure = (for_it - clean) / np.sqrt(for_it + clean + 1)
    ranked = [ranked[i] for i in np.lexsort((np.arange(len(ranked)), -np.round(sure, 9))) if sure[i] >= SURE and for_it[i] > PURE * clean[i]]

    def unlike(candidates: list[str], most: int, limit: float) -> list[str]:
        near, out, covered = Landmarks(candidates).values(candidates) if candidates else None, [], np.zeros(len(candidates))
        for i, w in enumerate(candidates):
            if len(out) < most and covered[i] < limit:
                out.append(w)
                covered = np.maximum(covered, near[:, i])
        return out

    positive = unlike(ranked, POSITIVE, 0.6)
    if not positive:
        return [], 0

    def likeness(batch: pa.RecordBatch, values: np.ndarray) -> pa.RecordBatch:
        like = np.rint(values.max(axis=1, initial=0) * unit).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(like)], names=["word", "there", "like"])

    plain = per_word(words.where(long & (F.col("there") > 0) & (F.col("here") == 0)), positive, "word string, there long, like long", likeness)
    nearest = [r.word for r in plain.where("like > 0").orderBy(F.desc("like"), F.desc("there"), "word").limit(NEAREST).collect()]
    return positive + unlike(nearest, NEGATIVE, 0.7), len(positive)


def mapped(sentences: DataFrame, landmarks: list[str]) -> DataFrame:
    """(doc, toxic, near, n): each sentence's values at the landmarks, as float32 bytes; equal ones of a document once, with their number."""
    shared = sentences.sparkSession.sparkContext.broadcast(landmarks)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = Landmarks(shared.value), {}
        none = np.zeros(len(at.words), np.float32)
        for batch in batches:
            lists = batch.column(2)
            new = [w for w in lists.flatten().unique().to_pylist() if w not in known]
            values = np.round(at.values(new), 4)
            known.update({w: v if v.any() else None for w, v in zip(new, values)})
            near = []
            for words in lists.to_pylist():
                found = [v for w in words if (v := known[w]) is not None]
                near.append((np.max(found, axis=0) if found else none).tobytes())
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.binary())], names=["doc", "toxic", "near"])

    return sentences.mapInArrow(valued, "doc long, toxic int, near binary").groupBy("doc", "toxic", "near").agg(F.count("*").alias("n"))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared hinge loss, by Newton steps; the last entry is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active][:, None]
        new = np.linalg.solve(xa.T @ (xa * wa) + ridge * np.eye(x.shape[1]), xa.T @ (wa[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def fit_logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve over margins, with targets drawn in a little."""
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x, w = np.c_[m, np.ones(len(m))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rounds: int = 3, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Texts and words stay with the executors: bounded lists of words and the sample's distinct rows of landmark values reach the driver."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sentences = checkpointed(training_sentences(docs, labels, sample_docs).repartition(parts))
    once = sentences.select("toxic", "words").distinct()  # copies of a sentence are evidence once
    totals = {r.toxic: r.n for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model()
    is_toxic = (F.col("toxic") == 1).cast("long")
    words = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum(is_toxic).alias("here"), F.sum(1 - is_toxic).alias("there"))
    landmarks, marking = choose_landmarks(checkpointed(words.repartition(parts, "word")), totals[1] / totals[0])
    if not landmarks:
        return Model()
    rows = mapped(sentences, landmarks).orderBy("doc", "toxic", "near").toArrow()
    toxic, n = rows["toxic"].to_numpy() == 1, rows["n"].to_numpy()
    near = np.frombuffer(b"".join(x.as_py() for x in rows["near"]), np.float32).reshape(len(n), len(landmarks))
    document = np.unique(rows["doc"].to_numpy(), return_inverse=True)[1]
    own = Landmarks(landmarks).values(landmarks).astype(float)
    eigen, basis = np.linalg.eigh(own / 2 + own.T / 2)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(eigen, 1e-2))) @ basis.T
    x = near @ root
    positive = toxic & (near[:, :marking].max(axis=1) > 0.6)
    for _ in range(rounds):
        positive = positive & toxic if (positive & toxic).any() else toxic
        use = positive | ~toxic
        weight = n * np.where(positive, 0.5 / n[positive].sum(), 0.5 / n[~toxic].sum())
        w = fit_svm(x[use], np.where(positive[use], 1.0, -1.0), weight[use])
        margin = x @ w[:-1] + w[-1]
        best = np.full(document.max() + 1, -np.inf)
        np.maximum.at(best, document, margin)
        positive = toxic & ((margin > 0) | ((margin == best[document]) & (margin > -0.5)))
    label = np.zeros(len(best), bool)
    label[document] = toxic
    slope, middle = fit_logistic(best, label)
    return Model(landmarks, root @ w[:-1], float(w[-1]), slope, middle)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with ``score``, learnt from the labels."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.withColumn("score", score("text", model))
