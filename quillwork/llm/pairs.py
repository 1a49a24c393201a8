"""Defects of question-answer pairs from a conditional random field over response clauses."""

from __future__ import annotations

import pickle
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv
from .language import SEEDS

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DIMENSIONS = 1 << 15

# Texts that stand for no text, in lower case without surrounding punctuation.
PLACEHOLDERS = frozenset(("n/a", "na", "null", "none", "nil", "nan", "blank", "empty", "tbd", "todo", "undefined", "no answer", "no response", "no text", "not available", "to be done"))

# Ways in which a writer declines, for the training of the tagger.
REFUSALS = (
    "I'm sorry, but I can't help with that.",
    "I am sorry, but I cannot write about {x}.",
    "Sorry.",
    "I cannot answer this question.",
    "I can't provide an answer.",
    "I am unable to assist with this request.",
    "I won't be able to help with {x}.",
    "Unfortunately I do not have enough information to answer.",
    "There is not enough evidence for me to write this.",
    "The evidence is insufficient, so nothing can be written.",
    "The evidence about {x} is too thin.",
    "As an AI language model, I am not able to judge {x}.",
    "I must decline.",
    "I have to pass on this one.",
    "I would rather not comment on {x}; please ask someone else.",
    "My apologies, this is outside what I may discuss.",
    "This request goes against my guidelines.",
    "It is not possible to produce a text on {x} from what was given.",
    "Please provide more material before I can continue.",
    "Without further sources I have nothing to offer on {x}.",
    "I don't have access to the documents.",
    "Cannot comply.",
    "Regrettably I cannot answer.",
)

_END = re.compile(r"(?<=[.!?…])[\"”’')\]]*\s+|(?<=[。！？])|\n+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENGLISH = frozenset(
    "the of and to in a is that for it as was with on by at from this these those be are or an which not have has had were but they some many most several such their its "
    "during after before within without across between over near step once than more each other than can there what how why who when all if into no".split()
)
_PLAIN = re.compile("[A-Za-z]")
_CLOSE = {"”": "“", ")": "(", "]": "[", "」": "「"}


_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")


@lru_cache(maxsize=1 << 16)
def _shown(c: str) -> bool:
    return unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp") or c in " \n\t"


def visible(text: str | None) -> str:
    """The text without white space and invisible characters at its ends."""
    if not text:
        return ""
    if text.isascii():
        return _CONTROL.sub("", text).strip()
    return "".join(c for c in text if _shown(c)).strip()


def is_placeholder(text: str | None) -> bool:
    """Null, blank, invisible, no letter or digit at all, or a word that stands for no text."""
    t = visible(text)
    if not any(c.isalnum() for c in t):
        return True
    return re.sub(r"^\W+|\W+$", "", t).lower() in PLACEHOLDERS


def clauses(text: str) -> list[str]:
    """The sentences and lines of a text; an item number stays with what follows it."""
    out: list[str] = []
    at = 0
    for m in _END.finditer(text):
        piece = text[at : m.end()].strip()
        if piece and not re.fullmatch(r"(?:\d{1,2}[.)]|[-*•])", piece):
            out.append(piece)
            at = m.end()
        elif not piece:
            at = m.end()
    rest = text[at:].strip()
    if rest:
        out.append(rest)
    return out


def _bin(share: float) -> int:
    return int(min(share, 1.0) * 10 + 1e-9)


@lru_cache(maxsize=1 << 17)
def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % DIMENSIONS


def features(parts: Sequence[str], question: str, title: str, lexical: bool = True) -> list[list[int]]:
    """Hashed feature numbers of each clause; without its words and word pairs if not lexical."""
    asked = [w.lower() for w in _WORD.findall(question or "")]
    asked_set, titled = set(asked), {w.lower() for w in _WORD.findall(title or "")}
    asked_pairs = set(zip(asked, asked[1:]))
    out = []
    for k, part in enumerate(parts):
        raw = _WORD.findall(part)
        words = [w.lower() for w in raw]
        n = max(1, len(words))
        plain = len(_PLAIN.findall(part))
        letters = (plain if part.isascii() else sum(map(str.isalpha, part))) or 1
        pairs = set(zip(words, words[1:]))
        last = part.rstrip()[-1:]
        open_marks = [a for b, a in _CLOSE.items() if part.count(a) > part.count(b)]
        end = (
            "number" if re.search(r"(?:^|\s)\d{1,2}[.)]$", part) else "short" if re.search(r"\b(?:e\.g|i\.e|cf|etc|vs|al)\.?$", part)
            else last if last in ".!?,;:…-–—(" else "wide" if last in "。！？" else "close" if last in "”\")]’'」" else "letter" if last.isalnum() else "other"
        )
        f = [
            "bias", f"end={end}", f"open={bool(open_marks)}", f"first={k == 0}", f"last={k == len(parts) - 1}", f"end={end},last={k == len(parts) - 1}",
            f"open={bool(open_marks)},last={k == len(parts) - 1}",
            f"q={_bin(sum(w in asked_set for w in words) / n)}", f"asked={_bin(len(asked_set & set(words)) / max(1, len(asked_set)))}",
            f"qq={_bin(len(pairs & asked_pairs) / max(1, len(pairs)))}", f"t={_bin(sum(w in titled for w in words) / n)}",
            f"qt={_bin(sum(w in titled or w in asked_set for w in words) / n)}",
            f"plain={_bin(plain / letters)}", f"english={_bin(2 * sum(w in _ENGLISH for w in words) / n)}", f"n={min(n, 12) // 2}",
            f"plain={_bin(plain / letters)},english={min(3, _bin(2 * sum(w in _ENGLISH for w in words) / n))}",
            f"tail={words[-1] if words and words[-1] in _ENGLISH else '-'},{end}",
        ]
        if not lexical:
            out.append(sorted({_h(x) for x in f}))
            continue
        masked = ["<name>" if r[:1].isupper() and (i or any(map(str.isdigit, r)) or not r[1:].islower()) and r != "I" and not r.startswith(("I'", "I’")) else w for i, (r, w) in enumerate(zip(raw, words))]
        masked = ["<number>" if w.isdigit() else w for w in masked]
        f += [f"w={w}" for w in masked] + [f"b={a} {b}" for a, b in zip(masked, masked[1:])]
        out.append(sorted({_h(x) for x in f}))
    return out


@dataclass
class Tagger:
    """A linear-chain conditional random field: weights of features, transitions, starts and ends."""

    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def tag(self, feats: Sequence[Sequence[int]]) -> list[int]:
        """The best label sequence (Viterbi)."""
        if not feats:
            return []
        emit = np.array([self.weights[f].sum(axis=0) for f in feats])
        score = self.starts + emit[0]
        back = []
        for e in emit[1:]:
            through = score[:, None] + self.moves
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + e
        best = [int((score + self.ends).argmax())]
        for b in reversed(back):
            best.append(int(b[best[-1]]))
        return best[::-1]


def train(sequences: Sequence[tuple[list[list[int]], list[int]]], epochs: int = 60, rate: float = 0.1, l2: float = 1e-4) -> Tagger:
    """Maximum likelihood by full-batch Adam; the gradients come from forward-backward over all sequences at once, in
    probabilities that are scaled at each clause. Equal clauses' features are summed once."""
    k = len(LABELS)
    seqs = [s for s in sequences if s[0]]
    count, longest = len(seqs), max(len(s[0]) for s in seqs)
    length = np.array([len(s[0]) for s in seqs])
    row = np.repeat(np.arange(count), length)
    col = np.concatenate([np.arange(n) for n in length])
    number: dict[tuple[int, ...], int] = {}
    clause = np.array([number.setdefault(tuple(f), len(number)) for s in seqs for f in s[0]])
    sizes = np.array([len(f) for f in number])
    index = np.concatenate([np.array(f, dtype=np.int64) for f in number])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(number)), sizes)
    gold = np.concatenate([np.array(s[1]) for s in seqs])
    gold_at = np.full((count, longest), 0)
    gold_at[row, col] = gold
    mask = np.arange(longest)[None, :] < length[:, None]
    used, compact = np.unique(index, return_inverse=True)
    by_feature = np.argsort(compact, kind="stable")
    owner_sorted, feature_starts = owner[by_feature], np.concatenate([[0], np.cumsum(np.bincount(compact, minlength=len(used)))[:-1]])

    p = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)]
    m1, m2 = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    one = np.zeros((len(clause), k))
    one[np.arange(len(clause)), gold] = 1
    pairs = mask[:, 1:]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold_at[:, :-1][pairs], gold_at[:, 1:][pairs]), 1)
    last = length - 1
    at = np.cumsum(length) - 1
    for epoch in range(1, epochs + 1):
        w, moves, starts, ends = p
        score = np.add.reduceat(w[compact], first, axis=0)[clause]
        emit = np.ones((count, longest, k))
        emit[row, col] = np.exp(score - score.max(axis=1, keepdims=True))
        step, begin, finish = np.exp(moves - moves.max()), np.exp(starts - starts.max()), np.exp(ends - ends.max())
        fwd, scale = np.empty_like(emit), np.empty((count, longest))
        for t in range(longest):
            x = (begin if t == 0 else fwd[:, t - 1] @ step) * emit[:, t]
            scale[:, t] = x.sum(axis=1)
            fwd[:, t] = x / scale[:, t, None]
        bwd = np.empty_like(emit)
        bwd[:, longest - 1] = finish
        for t in range(longest - 2, -1, -1):
            x = (emit[:, t + 1] * bwd[:, t + 1]) @ step.T / scale[:, t + 1, None]
            bwd[:, t] = np.where((t < last)[:, None], x, finish)
        both = fwd * bwd
        mass = both.sum(axis=2)
        diff = (both / mass[:, :, None])[row, col] - one
        g_moves = -gold_moves
        for t in range(1, longest):
            live = mask[:, t]
            if live.any():
                left = fwd[live, t - 1] / (scale[live, t] * mass[live, t])[:, None]
                g_moves = g_moves + step * (left.T @ (emit[live, t] * bwd[live, t]))
        per_clause = np.stack([np.bincount(clause, weights=diff[:, c], minlength=len(number)) for c in range(k)], axis=1)
        g_w = np.add.reduceat(per_clause[owner_sorted], feature_starts, axis=0)
        g = [g_w / count + l2 * w, g_moves / count, diff[at - last].sum(axis=0) / count, diff[at].sum(axis=0) / count]
        for i in range(4):
            m1[i] = 0.9 * m1[i] + 0.1 * g[i]
            m2[i] = 0.999 * m2[i] + 0.001 * g[i] ** 2
            p[i] = p[i] - rate * (m1[i] / (1 - 0.9**epoch)) / (np.sqrt(m2[i] / (1 - 0.999**epoch)) + 1e-8)
    weights = np.zeros((DIMENSIONS, k), dtype=np.float32)
    weights[used] = p[0]
    return Tagger(weights, p[1], p[2], p[3])


def training_sequences(rows: Sequence[dict], seed: int = 7) -> list[tuple[list[list[int]], list[int]]]:
    """Labelled clause sequences from unlabelled pairs.

    Sound rows (not rejected, English, finished, little of the question in them) give
    answers; broken copies of them give the other labels: cut off somewhere for unfinished, the
    question (with or without a lead-in or the title) for echo, the refusals above and the
    targets of rejected rows for refusal, prose of other languages for foreign.
    """
    rng = random.Random(seed)
    out = []
    seeds = {k: clauses(v) for k, v in SEEDS.items() if k != "en"}

    def add(parts: list[str], labels: list[int], r: dict) -> None:
        # Half the sequences come without their words, so that unseen words decide nothing alone.
        out.append((features(parts, r["question"] or "", r["title"] or "", rng.random() < 0.5), labels))

    for r in rows:
        text, question, title = visible(r["target"]), visible(r["question"]), visible(r["title"])
        parts = clauses(text) if not is_placeholder(text) else []
        if r["reject"]:
            if parts:
                add(parts, [REFUSAL] * len(parts), r)
            continue
        words = [w.lower() for w in _WORD.findall(text)]
        asked = {w.lower() for w in _WORD.findall(question)}
        english = sum(w in _ENGLISH for w in words) >= 0.12 * len(words)
        declines = bool(re.search(r"\b(?:I|my|me)\b", re.sub(r"“[^”]*”", "", text))) or bool(re.search(r"(?i)^(?:sorry|regrettably|unfortunately|cannot|no section|it is not possible)\b", text))
        overlap = sum(w in asked for w in words) / max(1, len(words))
        finished = bool(re.search(r"[.!?][\"”’')\]]*\s*(?:\[[^\]]+\])?$", text)) and not re.search(r"(?:\be\.g\.|\bi\.e\.|\s\d{1,2}\.|:)$", text) and text.count("“") == text.count("”")
        if not (parts and len(words) >= 8 and english and finished and not declines and overlap < 0.5):
            continue
        add(parts, [ANSWER] * len(parts), r)
        if rng.random() < 0.2:  # so may those that end with a quotation, a reference or a gloss
            said = parts[-1].rstrip(".!?")
            parts_q = [*parts[:-1], rng.choice([f"Some called this “{' '.join(said.split()[-2:])}.”", f"“{said},” one of them said.", f"{said}. [PAPER {rng.randrange(1, 5)}]", f"{said} (see there)."])]
            add(parts_q, [ANSWER] * len(parts_q), r)
        if question and len(asked) >= 4 and rng.random() < 0.3:  # sound answers may open with the question
            add([question, *parts], [ECHO] + [ANSWER] * len(parts), r)
        keep = rng.randrange(len(parts))
        source = _WORD.split(parts[keep])
        tokens = parts[keep].split()
        if len(tokens) > 4 and len(source) > 4:
            n = rng.randrange(3, len(tokens))
            cut = " ".join(tokens[:n]).rstrip(".!?")
            tail = rng.choice(["", "", "", ",", " and the", " (see also", " which led to…", "…", " because", " -", ":"])
            if not tail and rng.random() < 0.3 and len(cut) > 12:
                cut = cut[: -rng.randrange(1, 4)].rstrip()
            add([*parts[:keep], cut + tail], [ANSWER] * keep + [UNFINISHED], r)
        if rng.random() < 0.25:
            add([*parts, rng.choice(["One of them said: “We", "He added: “It was only", "1. " + parts[0] + "\n2.", "These are, e.g.", "Two things follow:", "As others did, i.e."])], [ANSWER] * len(parts) + [UNFINISHED], r)
        if question and rng.random() < 0.8:
            asked_text = rng.choice([question, question.lower().rstrip("?. "), question.rstrip("?.") + ".", f"“{question}”", question.upper()])
            lead = rng.choice(["", "", "", "Question: ", "The question is ", "You asked: ", "Good question. ", "Thanks for asking. "])
            tail = rng.choice(["", "", "", " " + title, " " + question, "\n" + title])
            echo = clauses(lead + asked_text + tail)
            if lead == "" and tail.startswith("\n"):
                echo = clauses(title + "\n" + asked_text)
            add(echo, [ECHO] * len(echo), r)
        if rng.random() < 0.6:
            x = rng.choice((r["topic"] or "this").split(",")).strip() or "this"
            no = [rng.choice(REFUSALS).format(x=x) for _ in range(rng.randrange(1, 4))]
            lead = rng.choice([None, None, "Answer: ", "Thank you for the question. "])
            parts_no = clauses((lead or "") + " ".join(no))
            add(parts_no, [REFUSAL] * len(parts_no), r)
        if rng.random() < 0.5:
            lines = seeds[rng.choice(sorted(seeds))]
            some = [rng.choice(lines) for _ in range(rng.randrange(1, 9))]
            names = [w for w in text.split() if w[:1].isupper() or w.isdigit()] or ["X1"]
            for k, line in enumerate(some):  # names and numbers are the same in every language
                tokens = line.split(" ")
                tokens.insert(rng.randrange(len(tokens)), rng.choice(names).strip(".,"))
                some[k] = " ".join(tokens[: rng.randrange(3, len(tokens) + 1)] if len(tokens) > 5 and rng.random() < 0.3 else tokens).rstrip(".,") + line[-1]
            add(some, [FOREIGN] * len(some), r)
        if rng.random() < 0.15:  # a short foreign gloss inside an answer is still an answer
            word = rng.choice(seeds[rng.choice(["ko", "ja"])]).split()[0][:6]
            glossed = parts[-1].rstrip(".") + f" ({word})."
            add([*parts[:-1], glossed], [ANSWER] * len(parts), r)
    return out


def defect(text: str | None, reject: bool | None, question: str | None, title: str | None, tagger: Tagger) -> tuple[str | None, dict[str, float]]:
    """The pair's defect, or None, and the share of the response's letters under each label.

    In this order: a text that is_placeholder is `empty`, or `refusal` where it was rejected; a
    rejected pair is `refusal`; a half or more in another language is `language`; of declining
    clauses (or a quarter, if there is next to no answer) `refusal`; of echoed ones `copy`; an
    unfinished last clause is `truncated`.
    """
    if is_placeholder(text):
        return ("refusal" if reject else "empty"), {}
    parts = clauses(visible(text))
    tags = tagger.tag(features(parts, question or "", title or ""))
    size = [max(1, sum(map(str.isalnum, p)) * (3 if tag == FOREIGN and not p.isascii() else 1)) for p, tag in zip(parts, tags)]
    share = {name: sum(s for s, t in zip(size, tags) if t == k) / sum(size) for k, name in enumerate(LABELS)}
    if reject:
        return "refusal", share
    if share["foreign"] >= 0.5:
        return "language", share
    if share["refusal"] >= 0.5 or share["refusal"] >= 0.25 > share["answer"] + share["unfinished"]:
        return "refusal", share
    if share["echo"] >= 0.5:
        return "copy", share
    if tags[-1] == UNFINISHED:
        return "truncated", share
    return None, share


def training_sample(pairs: DataFrame, rows: int = 2000) -> list[dict]:
    """At most `rows` pairs: the one of the least hash in each of so many hash buckets."""
    keyed = pairs.select("id", F.xxhash64("id").alias("h")).where("id is not null")
    chosen = keyed.groupBy(F.pmod("h", F.lit(rows)).alias("b")).agg(F.min(F.struct("h", "id")).alias("m")).select("m.id")
    found = pairs.join(F.broadcast(chosen), "id").select("id", "question", "target", "reject", "title", "topic").dropDuplicates(["id"]).collect()
    return sorted((r.asDict() for r in found), key=lambda r: r["id"])


def tag_pairs(pairs: DataFrame, tagger: Tagger) -> DataFrame:
    """(id, defect, answer, refusal, echo, foreign, unfinished): one row per id, defect null for sound
    pairs and the shares null for empty ones.

    pairs: id bigint, question, target, title, reject, at. Of several rows of one id the latest by `at` counts
    (of equal ones the least target). Null ids are left out; null questions and titles echo nothing; a null
    reject is no rejection.
    """
    body = F.struct("question", "target", "title", "reject")
    latest = (
        pairs.where("id is not null").groupBy("id")
        .agg(F.max_by(body, F.struct(F.coalesce(F.col("at").cast("timestamp"), F.timestamp_seconds(F.lit(0))), F.xxhash64("target"))).alias("p"))
        .select("id", "p.*")
    )
    packed = pickle.dumps(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        for batch in tv.slices(batches, "target"):
            d = batch.to_pydict()
            found = [defect(t, r, q, ti, own) for t, r, q, ti in zip(d["target"], d["reject"], d["question"], d["title"])]
            shares = [pa.array([round(s[k], 6) if s else None for _, s in found], pa.float64()) for k in LABELS]
            yield pa.RecordBatch.from_arrays([pa.array(d["id"], pa.int64()), pa.array([x for x, _ in found], pa.string()), *shares], names=["id", "defect", *LABELS])

    return latest.select("id", "question", "target", "title", "reject").mapInArrow(run, "id bigint, defect string, " + ", ".join(f"{k} double" for k in LABELS))
