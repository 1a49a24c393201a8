"""Subjects of documents: sentence evidence from labelled documents, then a classifier chain."""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv
from .leakage import without_comments

_BLOCK_TAG = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|table|section)\b[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
#: Hashed one-hot places of a document's source and type.
PLACES = 32


def _plain(text: str | None) -> str:
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub("\n", without_comments(text)))
    return html.unescape(text) if "&" in text else text


@dataclass
class Terms:
    """Hashed terms of the sentences of a batch: `values[at[s]:at[s + 1]]` are those of
    sentence s, and `docs[d]:docs[d + 1]` the sentences of document d."""

    values: np.ndarray
    at: np.ndarray
    docs: np.ndarray


def sentence_terms(texts: Sequence[str | None], least_words: int = 3) -> Terms:
    """Words, pairs of adjacent words and, in scripts without blanks or with
    particles (Han, kana, hangul), runs of two to four characters. A sentence ends at a full stop,
    question or exclamation mark before a blank, at a wide full stop and at a line end; one with
    fewer than least_words terms, such as a heading, is not counted."""
    folded = tv.fold(pa.array([_plain(t) for t in texts], type=pa.string()))
    cps, doc_at = tv.codepoints(folded)
    starts, ends, words_at = tv.word_spans(cps, doc_at)
    n = len(cps)
    if not len(starts):
        return Terms(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64))
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13)) | (cps == 0xA0) | (cps == 0x3000)
    nxt = np.ones(n, dtype=bool)
    nxt[:-1] = blank[1:]
    stop = (((cps == 0x2E) | (cps == 0x21) | (cps == 0x3F)) & nxt) | (cps == 0x3002) | (cps == 10) | (cps == 13)
    # The sentence of a character: ends of sentences before it, and texts before it.
    ended = np.concatenate([[0], np.cumsum(stop)])
    word_sentence = ended[starts] + np.searchsorted(doc_at, starts, side="right")
    h = tv.hash_spans(cps, starts, ends)
    owner = [word_sentence]
    values = [h]
    if len(h) > 1:
        same = word_sentence[1:] == word_sentence[:-1]
        values.append(tv.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same])
        owner.append(word_sentence[:-1][same])
    wide = ((cps >= 0x3040) & (cps <= 0x30FF)) | ((cps >= 0x3400) & (cps <= 0x9FFF)) | ((cps >= 0xAC00) & (cps <= 0xD7A3))
    if wide.any():
        char_sentence = ended[:-1] + np.searchsorted(doc_at, np.arange(n), side="right")
        c = tv.mix(cps.astype(np.uint64) + np.uint64(0x77))
        run = wide.copy()
        g = c.copy()
        for width in (2, 3, 4):
            run = run[:-1] & wide[width - 1 :]
            g = tv.mix(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[width - 1 :])
            values.append(g[run])
            owner.append(char_sentence[: n - width + 1][run])
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    sentences, first, counts = np.unique(owner, return_index=True, return_counts=True)
    doc_of = np.zeros(int(sentences[-1]) + 1, dtype=np.int64)
    doc_of[word_sentence] = np.searchsorted(words_at, np.arange(len(starts)), side="right") - 1
    keep = counts >= least_words
    sentences, first, counts = sentences[keep], first[keep], counts[keep]
    at = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    index = np.arange(at[-1]) - np.repeat(at[:-1] - first, counts)
    return Terms(values[index], at, np.searchsorted(doc_of[sentences], np.arange(len(texts) + 1)))


@dataclass
class Evidence:
    """Log-odds of the classes (subjects, then none) for the terms that tell them apart."""

    terms: np.ndarray
    weights: np.ndarray
    prior: np.ndarray

    def sentence_scores(self, t: Terms) -> np.ndarray:
        """The classes' scores of each sentence; one without a known term is about none."""
        place = np.searchsorted(self.terms, t.values)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == t.values if len(self.terms) else np.zeros(len(t.values), dtype=bool)
        total = np.zeros((len(t.at) - 1, self.weights.shape[1]), dtype=np.float32)
        owner = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))[known]
        rows = self.weights[place[known]]
        for c in range(total.shape[1]):
            total[:, c] = np.bincount(owner, weights=rows[:, c], minlength=len(total))
        total += self.prior
        bare = np.bincount(owner, minlength=len(total)) == 0
        total[bare, -1] = np.maximum(total[bare, -1], total[bare].max(axis=1) + 3) if bare.any() else total[bare, -1]
        return total


def significant(t: Terms, labels: np.ndarray, sure: np.ndarray, purity: float = 0.5) -> np.ndarray:
    """The terms of which at least `purity` of the documents have one subject, and more than
    chance allows: the likelihood ratio statistic (twice the log) of their share of it against
    its share of all documents is at least 2 ln(documents) + 0.6, which few idle terms reach and
    which grows with the documents as the terms do. The same purity must hold among the documents that are `sure` if three or more have the term, so that
    guessed labels can't turn the function words of a rare language into a subject's."""
    bar = 2 * np.log(max(len(labels), 1)) + 0.6
    doc_of_sentence = np.repeat(np.arange(len(t.docs) - 1), np.diff(t.docs))
    doc = np.repeat(doc_of_sentence, np.diff(t.at))
    order = np.lexsort((doc, t.values))
    v, d = t.values[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(v)))
    often = df >= 3
    found = np.zeros(len(first), dtype=bool)
    df_sure = np.add.reduceat(sure[d].astype(float), first) if len(first) else np.zeros(0)
    for c in range(labels.shape[1]):
        p = min(max(labels[:, c].mean(), 1e-6), 1 - 1e-6)
        n = np.add.reduceat(labels[d, c], first) if len(first) else np.zeros(0)
        q = np.clip(n / np.maximum(df, 1), 1e-9, 1 - 1e-9)
        g = 2 * df * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p)))
        n_sure = np.add.reduceat(labels[d, c] * sure[d], first) if len(first) else np.zeros(0)
        found |= ((df_sure < 3) | (n_sure >= purity * df_sure)) & often & (q > p) & (q >= purity) & (g >= bar)
    return v[first[found]]


def learn_evidence(t: Terms, labels: np.ndarray, sure: np.ndarray | None = None, rounds: int = 5, smooth: float = 0.5) -> Evidence:
    """Weights of the significant terms by expectation maximization over sentences.

    labels: documents x subjects, 0 or 1. A sentence of a labelled document is about one of
    its subjects or about none; it starts as any of them, and each round re-estimates the
    terms' rates per class and then the sentences' shares. A sentence with no significant
    term says nothing and is about none.
    """
    n_docs, k = labels.shape
    terms = significant(t, labels, np.ones(n_docs, dtype=bool) if sure is None else sure)
    sentence_doc = np.repeat(np.arange(n_docs), np.diff(t.docs))
    place = np.searchsorted(terms, t.values)
    place[place == len(terms)] = 0
    live = terms[place] == t.values if len(terms) else np.zeros(len(t.values), dtype=bool)
    column = place[live]
    owner = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))[live]
    allowed = np.concatenate([labels, np.ones((n_docs, 1))], axis=1)[sentence_doc]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    weights = np.zeros((len(terms), k + 1))
    prior = np.full(k + 1, -np.log(k + 1.0))
    for r in range(rounds if len(terms) else 0):
        rate = np.stack([np.bincount(column, weights=share[owner, c], minlength=len(terms)) for c in range(k + 1)], axis=1)
        mass = share.sum(axis=0) + 1e-9
        base = (rate.sum(axis=1) + smooth) / (mass.sum() + 1)
        # The rate per sentence of a class, drawn to the rate anywhere by some sentences' worth.
        p = (rate + smooth * base[:, None] * 20) / (mass[None, :] + smooth * 20)
        weights = np.log(p) - np.log(base)[:, None]
        prior = np.log(mass / mass.sum())
        if r == rounds - 1:
            break
        score = np.stack([np.bincount(owner, weights=weights[column, c], minlength=len(share)) for c in range(k + 1)], axis=1)
        score = np.where(allowed > 0, score + prior, -np.inf)
        score -= score.max(axis=1, keepdims=True)
        share = np.exp(np.maximum(score, -60.0)) * allowed
        share /= share.sum(axis=1, keepdims=True)
    return Evidence(terms, weights.astype(np.float32), prior.astype(np.float32))


def document_features(t: Terms, evidence: Evidence, sources: Sequence[str | None], kinds: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Term, structure and source features of each document, and its shares of sentences per subject.

    Of each subject: the share of sentences it wins, whether that is a fifth, and the mean of its
    posterior; of the document: the share of sentences about none, and how many there are.
    """
    scores = evidence.sentence_scores(t)
    k = scores.shape[1] - 1
    n = len(t.docs) - 1
    counts = np.diff(t.docs)
    doc = np.repeat(np.arange(n), counts)
    win = scores.argmax(axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    total = np.maximum(counts, 1)[:, None]
    won = np.stack([np.bincount(doc[win == c], minlength=n) for c in range(k + 1)], axis=1) / total
    mean = np.stack([np.bincount(doc, weights=e[:, c], minlength=n) for c in range(k + 1)], axis=1) / total
    places = np.zeros((n, 2 * PLACES))
    for i, (s, d) in enumerate(zip(sources, kinds)):
        places[i, zlib.crc32((s or "").encode()) % PLACES] = 0.3
        places[i, PLACES + zlib.crc32((d or "").encode()) % PLACES] = 0.3
    size = np.log1p(counts)[:, None] / 3
    return np.concatenate([won[:, :k] * 4, (won[:, :k] >= 0.2 - 1e-9) * 1.0, mean[:, :k] * 4, won[:, k:], size, places], axis=1), won[:, :k]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float, steps: int = 30) -> np.ndarray:
    """Weights and bias of a logistic regression, drawn to `prior` (Newton's method): few rows stay near it, many outweigh it."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = prior.astype(float).copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + strength * (w - prior)
        d = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), g)
        w -= d * min(1.0, 3.0 / max(np.abs(d).max(), 1e-12))
        if np.abs(d).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """A classifier per subject, in a fixed order, that sees the document's features and
    the decisions on the subjects before it; with a calibration of each."""

    order: list[int]
    weights: list[np.ndarray]
    calibration: list[tuple[float, float]]

    def _probability(self, k: int, x: np.ndarray, past: np.ndarray) -> np.ndarray:
        w = self.weights[k]
        z = x @ w[: x.shape[1]] + past @ w[x.shape[1] : -1] + w[-1]
        a, b = self.calibration[k]
        return _sigmoid(a * z + b)

    def decode(self, x: np.ndarray, possible: np.ndarray, beams: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search: the most probable combination of possible labels, and its probability, for each row."""
        n, k = len(x), len(self.order)
        labels = np.zeros((n, 1, k))
        logp = np.zeros((n, 1))
        for step in range(k):
            b = labels.shape[1]
            past = labels[:, :, :step].reshape(n * b, step)
            p = np.clip(self._probability(step, np.repeat(x, b, axis=0), past), 1e-9, 1 - 1e-9).reshape(n, b)
            p = np.where(possible[:, self.order[step]][:, None], p, 1e-12)
            on, off = labels.copy(), labels
            on[:, :, step] = 1
            both = np.concatenate([off, on], axis=1)
            score = np.concatenate([logp + np.log(1 - p), logp + np.log(p)], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :beams]
            rows = np.arange(n)[:, None]
            labels, logp = both[rows, best], score[rows, best]
        out = np.zeros((n, k))
        out[:, self.order] = labels[:, 0]
        return out, np.exp(logp[:, 0])


def train_chain(x: np.ndarray, y: np.ndarray) -> Chain:
    """Classifiers in order of falling frequency for document_features (x) and labels (y). Each is fitted on
    two thirds of the rows and calibrated (Platt) on the rest."""
    k = y.shape[1]
    order = sorted(range(k), key=lambda c: (-y[:, c].sum(), c))
    held = np.arange(len(x)) % 3 == 2
    weights, calibration = [], []
    for step, c in enumerate(order):
        full = np.concatenate([x, y[:, order[:step]]], axis=1)
        prior = np.zeros(full.shape[1] + 1)
        prior[[k + c, -1]] = 4.0, -2.0  # before any row is seen: a subject that wins a fifth of the sentences
        w = _logistic(full[~held], y[~held, c], prior, 10.0)
        a, b = _logistic((full[held] @ w[:-1] + w[-1])[:, None], y[held, c], np.array([1.0, 0.0]), 20.0)
        weights.append(w)
        calibration.append((max(float(a), 0.2), float(b)))
    return Chain(order, weights, calibration)


@dataclass
class Model:
    subjects: list[str]
    evidence: Evidence
    chain: Chain


#: Documents that training reads at most, labelled ones first.
TRAINING_DOCUMENTS = 6000
#: A subject that wins less than this share of a document's sentences isn't given to it.
LEAST_SHARE = 0.1

Row = tuple[str, str | None, str | None, list[str] | None]


def training_rows(docs: DataFrame, labels: DataFrame, subjects: Sequence[str], most: int = TRAINING_DOCUMENTS) -> list[Row]:
    """(text, source, type, subjects or None) of at most `most` documents: labelled ones, in each of so
    many hash buckets the one of the least hash, and, in the buckets without, unlabelled ones.
    Repeated and unknown labels are left out."""
    of = labels.where(F.col("subject").isin(*subjects) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    known = docs.where("doc_id is not null and char_length(text) > 0").select("doc_id").join(of, "doc_id", "left")
    ranked = known.select(F.pmod(F.xxhash64("doc_id"), F.lit(most)).alias("b"), F.struct(F.col("subjects").isNull().alias("n"), F.xxhash64("doc_id").alias("h"), "doc_id", "subjects").alias("m"))
    chosen = ranked.groupBy("b").agg(F.min_by("m", F.struct("m.n", "m.h", "m.doc_id")).alias("m")).select("m.doc_id", "m.subjects").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text", "source", "doc_type").join(F.broadcast(chosen), "doc_id").collect()
    return [(r.text, r.source, r.doc_type, r.subjects) for r in sorted(rows, key=lambda r: (r.doc_id, r.text or "")) if r.text]


def _learn_from_all(terms: Terms, y: np.ndarray, labelled: np.ndarray, rounds: int = 2) -> Evidence:
    """Evidence from the labelled documents, then, round by round, also from the unlabelled ones
    of which one subject wins half the sentences and no other a tenth by the evidence so far."""
    evidence = learn_evidence(_rows(terms, labelled), y[labelled])
    if labelled.all():
        return evidence
    for _ in range(rounds):
        none = [None] * len(y)
        won = document_features(terms, evidence, none, none)[1]
        clear = (won.max(axis=1) >= 0.5) & ((won >= 0.1).sum(axis=1) == 1)
        guess = np.where(labelled[:, None], y, (won >= 0.5) & clear[:, None])
        use = labelled | clear
        evidence = learn_evidence(_rows(terms, use), guess[use].astype(float), labelled[use])
    return evidence


def fit(rows: Sequence[Row], subjects: Sequence[str]) -> Model:
    """The evidence and the chain. The chain sees evidence learned without its own labels: for
    each half of the labelled documents from the other half and the unlabelled ones, so its
    inputs are as good as on new documents."""
    names = sorted(subjects)
    y = np.array([[s in (r[3] or ()) for s in names] for r in rows], dtype=float).reshape(len(rows), len(names))
    labelled = np.array([r[3] is not None for r in rows], dtype=bool)
    terms = sentence_terms([r[0] for r in rows])
    half = np.cumsum(labelled) % 2
    x = None
    for h in (0, 1):
        mine = labelled & (half == h)
        other = _learn_from_all(_rows(terms, ~mine), y[~mine], labelled[~mine], rounds=1)
        own = [r for r, m in zip(rows, mine) if m]
        part = document_features(_rows(terms, mine), other, [r[1] for r in own], [r[2] for r in own])[0]
        x = np.zeros((len(rows), part.shape[1])) if x is None else x
        x[mine] = part
    return Model(names, _learn_from_all(terms, y, labelled), train_chain(x[labelled], y[labelled]))


def _rows(t: Terms, which: np.ndarray) -> Terms:
    """The documents marked in `which`."""
    counts = np.diff(t.docs)
    sentences = np.repeat(which, counts)
    sizes = np.diff(t.at)
    at = np.concatenate([[0], np.cumsum(sizes[sentences])])
    return Terms(t.values[np.repeat(sentences, sizes)], at, np.concatenate([[0], np.cumsum(counts[which])]))


def document_subjects(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subjects array<struct<subject, share>>, none_share, probability): each document with
    its subjects, their shares of its sentences, and the probability of the combination.

    Null and empty texts have no subject. Whole texts are read; repeated rows stay repeated.
    """
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(packed)
        kind = pa.list_(pa.struct([("subject", pa.string()), ("share", pa.float64())]))
        for batch in tv.slices(batches, "text", 2_000_000):
            d = batch.to_pydict()
            terms = sentence_terms(d["text"])
            x, won = document_features(terms, own.evidence, d["source"], d["doc_type"])
            y, p = own.chain.decode(x, won >= LEAST_SHARE)
            some = np.diff(terms.docs) > 0
            out = [
                [{"subject": s, "share": round(float(won[i, c]), 6)} for c, s in enumerate(own.subjects) if y[i, c] > 0] if some[i] else []
                for i in range(len(some))
            ]
            none = np.round(np.where(some, 1 - won.sum(axis=1), 1.0), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, kind), pa.array(none), pa.array(np.where(some, np.round(p, 6), 1.0))], names=["doc_id", "subjects", "none_share", "probability"]
            )

    schema = "doc_id bigint, subjects array<struct<subject:string,share:double>>, none_share double, probability double"
    return docs.select("doc_id", "text", "source", "doc_type").mapInArrow(run, schema)
