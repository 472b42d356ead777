"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all character subsequences of four that both hold, the product of their weights; an
occurrence weighs DECAY for each character skipped inside it (at most GAPS), unbroken runs of six count besides, words
carry edge marks, and kernels are normalised by the weights of a word's occurrences. So insults with inserted, swapped-in
or endless letters and endings stay close to each other. Words are lower-cased, common look-alike digits and signs become
letters, other signs are skipped.

Training on sentences that inherit their document's label: the words of each toxic sentence that hold subsequences far
more frequent in toxic than in clean sentences are its witnesses; witnesses and the most similar and random words of
clean sentences are the instances. Landmarks are chosen among them farthest first; an instance's kernels with the
landmarks, whitened (Nyström), feed a linear support vector machine with squared hinge loss, solved by Newton steps;
toxic sentences then name their witnesses by the machine, and it is solved once more. As the features are linear in the
subsequences, the decision is one weight for each subsequence. A logistic curve over the best margins of a text, fitted
on documents that the machine has not seen, makes the score.

Bounds of the training sample, all parameters: MAX_DOCUMENTS labelled documents of each class, the first by hash of the
id; of each, distinct sentences of distinct words, by hash, up to MAX_LETTERS characters, which go to the driver; as clean
instances HARD words that lean or score most to the toxic side and OTHER random ones, MAX_NEGATIVES in all; LANDMARKS
landmarks out of POOL: the most named witnesses, hard and other clean words. Scoring has no bound: it reads every whole
text; workers keep a bounded number of word margins and compute the rest anew.

Defined results: null and empty texts score as texts without a witness; null labels and rows without a text teach
nothing; without both classes every score is 0; equal texts score equally; texts of any length are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, persisted, pruned

MAX_DOCUMENTS = 1500
MAX_LETTERS = 200_000
HARD, OTHER, MAX_NEGATIVES = 1500, 4500, 7000
LANDMARKS = 128
POOL = (400, 60, 40)
GAPS = 2
DECAY = 0.5
FEATURES = 1 << 18
THRESHOLD = 0.3
_SENTENCE = re.compile(r"[.!?\n]+\s*")
# Signs that stand for letters.
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
#: Offsets of the characters of a subsequence from its first, and its weight.
_STEPS = [((1 + a, 2 + a + b, 3 + a + b + c), DECAY ** (a + b + c)) for a in range(GAPS + 1) for b in range(GAPS + 1 - a) for c in range(GAPS + 1 - a - b)]
_STEPS.append(((1, 2, 3, 4, 5), 1.0))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2C1B3C6D], dtype=np.uint64)


def folded(word: str) -> str:
    """Edge marks around the word's letters, look-alikes replaced."""
    letters = word if word.isalpha() else "".join(filter(str.isalnum, word.translate(_LOOKALIKE)))
    return f"\x01{letters}\x02"


def _coded(words: list[str], steps) -> Iterable[tuple[np.ndarray, np.ndarray, float]]:
    """(start of each occurrence that fits, its feature, its weight) for every step, over the words' joined characters."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters up to the word's end, own included
    scaled = [chars * f for f in _FACTORS]
    for at, weight in steps:
        m = len(chars) - at[-1]
        if m <= 0:
            continue
        starts = np.flatnonzero(left[:m] > at[-1])
        code = scaled[0][:m].copy()
        for f, k in zip(scaled[1:], at):
            code += f[k : k + m]
        code += np.uint64(len(at))
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code >>= np.uint64(46)  # 18 bits
        yield starts, code[starts].view(np.int64), weight


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, feature, weight) of every occurrence of a subsequence in folded words."""
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    parts = [(owner[starts], code, np.full(len(code), weight, np.float32)) for starts, code, weight in _coded(words, _STEPS)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _norms(words: list[str]) -> np.ndarray:
    """Kernel norms of folded words: every step fits as often as the length says."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.sqrt(np.maximum(sum(w * w * np.maximum(0, n - at[-1]) for at, w in _STEPS), 1e-9))


@dataclass
class Machine:
    """A decision weight for each subsequence, an offset, and the curve from margins to scores."""

    weights: np.ndarray
    offset: float
    curve: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values of single words."""
        if not words:
            return np.zeros(0)
        words = [folded(w) for w in words]
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        total = np.zeros(first[-1])
        for starts, code, weight in _coded(words, _STEPS):
            total[starts] += self.weights[code] * weight
        return np.add.reduceat(total, first[:-1]) / _norms(words) + self.offset

    def score(self, margins: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(_summary(margins) @ self.curve, -30, 30))))


def _summary(margins: np.ndarray) -> np.ndarray:
    """Constant, best and second best margin, and how many are positive for the length."""
    if not len(margins):
        return np.array([1.0, -1.5, -1.5, 0.0])
    top = np.sort(np.partition(margins, -2)[-2:])[::-1] if len(margins) > 2 else np.sort(margins)[::-1]
    second = top[1] if len(top) > 1 else min(float(top[0]), -0.5)
    return np.array([1.0, np.clip(top[0], -1.5, 1.5), np.clip(second, -1.5, 1.5), np.log1p((margins > 0).sum()) / np.log(20.0 + len(margins))])


def _association(docs: list[list[str]], toxic: np.ndarray) -> dict[str, float]:
    """For each distinct word: how far the run of 4 to 8 characters that leans most to toxic documents leans."""
    words = sorted({w for d in docs for w in d})
    number = {w: i for i, w in enumerate(words)}
    marked = [folded(w) for w in words]
    n = np.bincount(toxic.astype(int), minlength=2)
    best = np.zeros(len(words))
    for length in range(4, 9):
        runs = [{m[k : k + length] for k in range(len(m) - length + 1)} for m in marked]
        seen: tuple[dict, dict] = ({}, {})
        for d, t in zip(docs, toxic):
            count = seen[int(t)]
            for run in set().union(*(runs[number[w]] for w in d)):
                count[run] = count.get(run, 0) + 1
        lean = {
            run: np.log((hits + 0.5) / (n[1] + 1)) - np.log((seen[0].get(run, 0) + 0.5) / (n[0] + 1)) - 1.0 / np.sqrt(hits)
            for run, hits in seen[1].items()
            if hits >= 4
        }
        for k, own in enumerate(runs):
            for run in own:
                if (value := lean.get(run, 0.0)) > best[k]:
                    best[k] = value
    return dict(zip(words, best.tolist()))


def _solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active instances."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, reg = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge
    reg[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (z @ w) < 1
        a = z[active]
        new = np.linalg.solve(reg + (a.T * cost[active]) @ a, (a.T * cost[active]) @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _landmarks(pool: list[str], count: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Farthest-first choice in kernel space; the landmarks, the features they hold (-1: none) and their normalised weights.

    Kernels with a landmark are sums over the pool's occurrences: no matrix of words by features is made, however long
    the words are.
    """
    marked = [folded(w) for w in pool]
    who, what, weight = subsequences(marked)
    weight = weight / _norms(marked)[who]
    first = np.searchsorted(who[order := np.argsort(who, kind="stable")], np.arange(len(pool) + 1))

    def features(k: int) -> np.ndarray:
        own = order[first[k] : first[k + 1]]
        return np.bincount(what[own], weight[own], FEATURES)

    chosen, far = [0], 1.0 - np.bincount(who, weight * features(0)[what], len(pool))
    while len(chosen) < min(count, len(pool)):
        k = int(np.argmax(far))
        if far[k] < 0.05:
            break
        chosen.append(k)
        far = np.minimum(far, 1.0 - np.bincount(who, weight * features(k)[what], len(pool)))
    used = np.unique(np.concatenate([what[order[first[k] : first[k + 1]]] for k in chosen]))
    at = np.full(FEATURES, -1)
    at[used] = np.arange(len(used))
    return [pool[k] for k in chosen], at, np.array([features(k)[used] for k in chosen], np.float32)


def train(docs: list[tuple[int, list[list[str]]]], prior: float | None = None, seed: int = 7) -> Machine | None:
    """docs: (toxic, sentences as word lists) of each labelled document."""
    toxic = np.array([t for t, _ in docs], dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    fit = rng.random(len(docs)) < 0.7
    if not (toxic & fit).any() or not (~toxic & fit).any() or not (toxic & ~fit).any() or not (~toxic & ~fit).any():
        fit[:] = True
    flat = [sorted({w for s in sentences for w in s}) for _, sentences in docs]
    chosen = [k for k in range(len(docs)) if fit[k]]
    lean = _association([flat[k] for k in chosen], toxic[chosen])
    clean_words = sorted({w for k in chosen if not toxic[k] for w in flat[k]})

    def witnesses(value, least: float) -> dict[str, int]:
        """How many sentences of toxic documents name a word: those near the best of their document."""
        found: dict[str, int] = {}
        for k in chosen:
            if toxic[k] and flat[k]:
                best = max(value(w) for w in flat[k])
                if best >= least:
                    for sentence in docs[k][1]:
                        for w in set(sentence):
                            if value(w) >= max(least, 0.7 * best):
                                found[w] = found.get(w, 0) + 1
        return found

    best_clean = np.quantile([lean[w] for w in clean_words], 0.999) if clean_words else 0.0
    positive = witnesses(lean.__getitem__, max(1.2, float(best_clean)))
    if not positive:
        return None
    hard = sorted(clean_words, key=lambda w: (-lean[w], w))[:HARD]
    other = [clean_words[k] for k in rng.permutation(len(clean_words))[:OTHER]]
    negative = list(dict.fromkeys(hard + other))
    ranked = sorted(positive, key=lambda w: (-positive[w], w))
    pool = [ws[:n] for ws, n in zip((ranked, hard, other), POOL)]
    names, at, rows = _landmarks(list(dict.fromkeys(sum(pool, []))), LANDMARKS)
    gram = (rows @ rows.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-4 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])

    def mapped(words: list[str]) -> np.ndarray:
        who, what, weight = subsequences([folded(w) for w in words])
        norm = _norms([folded(w) for w in words])
        known = at[what] >= 0
        who, column, weight = who[known], at[what[known]], weight[known]
        kernel = np.zeros((len(words), len(names)))
        for s in range(0, len(who), 50_000):
            part = slice(s, s + 50_000)
            np.add.at(kernel, who[part], rows[:, column[part]].T * weight[part, None])
        return (kernel / norm[:, None]) @ whiten

    machine = None
    for _ in range(2):
        chosen_words = sorted(positive)
        x = np.vstack([mapped(chosen_words), mapped(negative)])
        y = np.array([1.0] * len(chosen_words) + [-1.0] * len(negative))
        seen = np.array([positive[w] for w in chosen_words], dtype=float)
        cost = np.concatenate([np.minimum(seen, 20.0), np.ones(len(negative))])
        cost[: len(chosen_words)] *= len(negative) / cost[: len(chosen_words)].sum() * 0.5
        w, offset = _solve(x, y, cost)
        weights = np.zeros(FEATURES)
        held = at >= 0
        weights[held] = (rows.T.astype(np.float64) @ (whiten @ w))[at[held]]
        machine = Machine(weights, offset, np.zeros(4))
        every = sorted({w for k in range(len(docs)) for w in flat[k]})
        margin = dict(zip(every, machine.margins(every)))
        # hard negatives of the machine itself, and witnesses named by it
        negative = list(dict.fromkeys(sorted(clean_words, key=lambda w: (-margin[w], w))[:HARD] + negative))[:MAX_NEGATIVES]
        again = witnesses(margin.__getitem__, 0.0)
        positive = again or positive
    held_out = [k for k in range(len(docs)) if not fit[k]] or chosen
    s = np.array([_summary(np.array([margin[w] for sentence in docs[k][1] for w in sentence])) for k in held_out])
    machine.curve = _logistic(s, toxic[held_out].astype(float), prior)
    return machine


def _logistic(s: np.ndarray, y: np.ndarray, prior: float | None) -> np.ndarray:
    """Logistic weights with a small ridge; classes weighted to the prior where one is given."""
    share = y.mean()
    cost = np.ones(len(y)) if prior is None or not 0 < share < 1 else np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    w, reg = np.zeros(s.shape[1]), np.diag([0.01, 0.3, 0.3, 0.3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(s @ w, -30, 30)))
        step = np.linalg.solve((s.T * (cost * p * (1 - p) + 1e-9)) @ s + reg, s.T @ (cost * (y - p)) - reg @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sentences_of(text: str | None) -> list[list[str]]:
    return [w for s in _SENTENCE.split(text.lower()) if (w := s.split())] if text else []


def lesson(text: str | None, letters: int = MAX_LETTERS) -> list[str]:
    """What one document teaches: distinct sentences, each its distinct words, by hash up to a number of characters."""
    out = []
    for line in sorted({" ".join(dict.fromkeys(s)) for s in sentences_of(text)}, key=xxhash.xxh3_64_intdigest):
        if len(line) <= letters:
            letters -= len(line)
            out.append(line)
    return out


def learn(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS) -> Machine | None:
    """A machine from at most max_documents labelled documents of each class (docs: id, text; labels: id, toxic)."""
    known = labels.where("id IS NOT NULL AND toxic IN (0, 1)").dropDuplicates(["id"])
    order = [F.xxhash64("id"), "id"]
    picked = known.where("toxic = 1").orderBy(*order).limit(max_documents).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_documents))
    picked = persisted(docs.sparkSession, picked.select(F.col("id").alias("picked"), "toxic"))
    totals = known.agg(F.avg("toxic").alias("share")).first()
    texts = docs.where("text IS NOT NULL").join(F.broadcast(picked), F.col("id") == F.col("picked")).select("id", "text", F.col("toxic").cast("int").alias("toxic"))

    def cut(ids, texts, toxic):
        return ids, toxic, [lesson(t) for t in texts]

    rows = map_columns(texts, cut, "id bigint, toxic int, sentences array<string>", rows=256).collect()
    rows.sort(key=lambda r: (r["id"], r["sentences"]))
    return train([(r["toxic"], [s.split() for s in r["sentences"]]) for r in rows], totals["share"])


def score_texts(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", remembered: int = 300_000) -> DataFrame:
    """One row per document: id, score, and its worst word with that word's margin."""
    spark = docs.sparkSession
    source, kind = pruned(docs, id=id_col, text=text_col), dict(docs.dtypes)[id_col]
    if machine is None:
        return source.select("id", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("witness"), F.lit(None).cast("double").alias("margin"))
    sent = spark.sparkContext.broadcast(machine)  # one weight for each of FEATURES subsequences: fixed size
    known: dict[str, float] = {}

    def run(ids, texts):
        m = sent.value
        words = [t.lower().split() if t else [] for t in texts]
        fresh = set().union(*words) - known.keys()
        if len(known) + len(fresh) > remembered:
            known.clear()
            fresh = set().union(*words)
        fresh = list(fresh)
        known.update(zip(fresh, m.margins(fresh).tolist()))
        scores, worst, margins = [], [], []
        for ws in words:
            values = np.fromiter(map(known.__getitem__, ws), np.float64, len(ws))
            scores.append(m.score(values))
            k = int(values.argmax()) if len(ws) else None
            worst.append(None if k is None else ws[k])
            margins.append(None if k is None else float(values[k]))
        return ids, scores, worst, margins

    return map_columns(source, run, f"id {kind}, score double, witness string, margin double", rows=512)


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def digest_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    taught = pruned(labels, id="doc_id", toxic="toxic").where(~held_out(F.col("id")))
    machine = learn(pruned(docs, id="doc_id", text="text"), taught)
    scored = score_texts(docs, machine)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "witness", "margin")


def auc(scores: Iterable[float], truth: Iterable[int]) -> float:
    """Area under the ROC curve, ties counting half."""
    s, y = np.array(list(scores)), np.array(list(truth), dtype=bool)
    order = np.argsort(s, kind="stable")
    values, inverse, count = np.unique(s[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    pos = y[order]
    return float((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum()))
