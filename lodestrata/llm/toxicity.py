"""Abusive, hateful or sexual content: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is scored by its worst sentence, since one is enough. Words are first brought back from disguise (look-alike
letters, digits for letters, spelled-out or stretched words, invisible characters); then every sentence is a bag of hashed
word 1- to 3-grams and skip-grams. Training sees documents' labels only: the sentence a model finds worst in a positive
document stands for it in the next round.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
MASK = (1 << BITS) - 1
CACHE_WORDS = 300_000

# Letters of other scripts that look like Latin ones, and signs that stand for letters inside words.
LOOKALIKE = str.maketrans("аеорсухіјѕкмтнвгԁԛԝһӏαοεικνρτυχςɑıℓ", "aeopcyxijskmthbrdqwhlaoeikvptuxsail")
LEET = str.maketrans("013457@$!|+€", "oieastasiite")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_SPELLED = re.compile(r"(?<![\w.])(?:[^\W_][ ._\-*·]){3,}[^\W_](?![\w])")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\n\r 。！？；]+|\s(?=//|—)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:[*#@$!|+€\d]+[^\W\d_]*)*|[@$][^\W\d_]+(?:[*#@$!|+€\d]+[^\W\d_]*)*|\d+(?:[*#@$!|+€]*[^\W\d_]+)+[\w*#@$!|+€]*|\d+|[?!]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_RUN = re.compile(r"(.)\1+")
_HIDDEN = re.compile(r"[^\W\d_]+[*#@$%]{2,}[^\W\d_]*|[^\W\d_]*[*#]+[^\W\d_]+")


def plain(text: str) -> str:
    """Text without compatibility forms, invisible characters and accents' split forms, in lower case; spelled words joined."""
    t = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    t = t.casefold()
    return _SPELLED.sub(lambda m: re.sub(r"[ ._\-*·]", "", m[0]), t)


def word_of(token: str) -> str:
    """The word behind a token: look-alikes and digits become letters, runs of a letter one, masked words `<masked>`."""
    if token.isdigit():
        return "<n>"
    t = token.replace("’", "'")
    if not t.isascii() and re.search(r"[a-z]", t):
        t = t.translate(LOOKALIKE)
    if not t.isalpha():
        if _HIDDEN.fullmatch(t):
            u = t.translate(LEET)
            return "<masked>" if "*" in u or "#" in u or "%" in u else _RUN.sub(r"\1", u)
        if re.search(r"[a-z]", t):
            t = t.translate(LEET)
    return _RUN.sub(r"\1", t)


class Features:
    """Sentences -> hashed features. The hashes of tokens seen are remembered, at most CACHE_WORDS of them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def token(self, t: str) -> int:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        w = word_of(t)
        h = self.known[t] = zlib.crc32(w.encode("utf-8", "surrogatepass")) * 2654435761 & 0xFFFFFFFF
        return h

    def sentences(self, text: str | None) -> list[list[int]]:
        out = []
        if text:
            get, find = self.known.get, _TOKEN.findall
            for s in _SENTENCE.split(plain(text)):
                if not s:
                    continue
                toks = find(s)
                if not s.isascii() and _CJK.search(s):
                    toks = [x for t in toks for x in (t if _CJK.search(t) else (t,))]
                if toks:
                    out.append([get(t) or self.token(t) for t in toks])
        return out

    @staticmethod
    def grams(words: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, sentence) of all 1-, 2-, 3-grams and skip-grams over 1 and 2 words; none crosses a sentence."""
        w = words.astype(np.uint64)
        feats, owner = [(w * 0x9E3779B1 >> np.uint64(7)) & MASK], [sent]

        def pair(gap: int, salt: int) -> None:
            if len(w) > gap:
                same = sent[gap:] == sent[:-gap]
                h = (w[:-gap] * np.uint64(0x85EBCA6B) + w[gap:] * np.uint64(0xC2B2AE35) + np.uint64(salt)) * np.uint64(0x27D4EB2F)
                feats.append((h >> np.uint64(11) & MASK)[same])
                owner.append(sent[gap:][same])

        pair(1, 11)
        pair(2, 23)
        pair(3, 37)
        if len(w) > 2:
            same = sent[2:] == sent[:-2]
            h = (w[:-2] * np.uint64(0x85EBCA6B) + w[1:-1] * np.uint64(0x165667B1) + w[2:] * np.uint64(0xC2B2AE35) + np.uint64(51)) * np.uint64(0x27D4EB2F)
            feats.append((h >> np.uint64(11) & MASK)[same])
            owner.append(sent[2:][same])
        return np.concatenate(feats).astype(np.int64), np.concatenate(owner)


class Ftrl:
    """FTRL-proximal with per-coordinate rates and L1: most weights are exactly 0."""

    def __init__(self, alpha: float = 0.4, beta: float = 1.0, l1: float = 0.4, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(MASK + 2), np.zeros(MASK + 2)  # the last coordinate is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, feats: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One batch: feature i belongs to example owner[i]; the bias is added to each example."""
        m = len(y)
        at, inv = np.unique(np.concatenate([feats, [MASK + 1]]), return_inverse=True)
        inv = inv[:-1]
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[inv], m) + w[-1], -30, 30)))
        g = (p - y) * weight
        grad = np.bincount(inv, g[owner], len(at))
        grad[-1] += g.sum()
        sq = np.bincount(inv, g[owner] ** 2, len(at))
        sq[-1] += (g**2).sum()
        sigma = (np.sqrt(self.n[at] + sq) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += grad - sigma * w
        self.n[at] += sq

    def dense(self) -> tuple[np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        w = np.zeros(MASK + 1, dtype=np.float32)
        w[at] = self.weights(at)
        return w, float(self.weights(np.array([MASK + 1]))[0])


@dataclass
class Bags:
    """Sets of features, one after the other: bag k holds feats[ptr[k]:ptr[k + 1]]; doc is the document it is of."""

    feats: np.ndarray
    ptr: np.ndarray
    doc: np.ndarray

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, position in `at`) of the bags at these places."""
        lens = self.ptr[at + 1] - self.ptr[at]
        owner = np.repeat(np.arange(len(at)), lens)
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        return self.feats[np.repeat(self.ptr[at], lens) + inner], owner

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.feats], dtype=np.float64)])
        return total[self.ptr[1:]] - total[self.ptr[:-1]] + b


def _packed(owner: np.ndarray, feats: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, number per owner) with each feature once per owner, in order of owners."""
    key = owner << np.int64(BITS) | feats
    key.sort()
    key = key[np.diff(key, prepend=-1) > 0]
    return (key & MASK).astype(np.int32), np.bincount(key >> BITS, minlength=n)


def bags_of(texts, fx: Features, step: int = 500) -> Bags:
    """A bag per sentence of the texts that have words; a feature counts once in a bag."""
    feats, lens, docs = [], [], []
    for lo in range(0, len(texts), step):
        words, sent, doc_of = [], [], []
        for d, t in enumerate(texts[lo : lo + step]):
            for s in fx.sentences(t):
                words.extend(s)
                sent.extend([len(doc_of)] * len(s))
                doc_of.append(lo + d)
        if doc_of:
            f, owner = fx.grams(np.array(words, dtype=np.uint64), np.array(sent, dtype=np.int64))
            f, n = _packed(owner, f, len(doc_of))
            feats.append(f)
            lens.append(n)
            docs.append(np.array(doc_of, dtype=np.int64))
    if not docs:
        return Bags(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    return Bags(np.concatenate(feats), np.concatenate([[0], np.cumsum(np.concatenate(lens))]), np.concatenate(docs))


def whole_documents(sents: Bags) -> Bags:
    """A bag per document: what its sentences hold."""
    doc, at = np.unique(sents.doc, return_inverse=True)
    feats, n = _packed(np.repeat(at, np.diff(sents.ptr)), sents.feats.astype(np.int64), len(doc))
    return Bags(feats, np.concatenate([[0], np.cumsum(n)]), doc)


def _fit(bags: Bags, at: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, seed: int, batch: int = 64) -> tuple[np.ndarray, float]:
    model, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(at))
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            model.step(*bags.gather(at[k]), y[k], weight[k])
    return model.dense()


def train(texts: list[str], labels: list[float], rounds: int = 3, epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of sentences from labelled documents.

    Round 0 takes whole documents as bags. In each later round a positive document is the sentence the model before found
    worst (and any other it is sure of), a negative one all of its sentences. Labels may err: a document labelled against
    a sure model hardly counts.
    """
    sents, y = bags_of(texts, Features()), np.array(labels, dtype=np.float64)
    whole = whole_documents(sents)
    if len(np.unique(y[whole.doc] > 0.5)) < 2:
        return np.zeros(MASK + 1, dtype=np.float32), -10.0
    w, b = _fit(whole, np.arange(len(whole.doc)), y[whole.doc], np.ones(len(whole.doc)), epochs, seed)
    b = -3.0  # of a bag; a sentence has far fewer features
    doubt = [0.0, -3.5, *[-3.0] * rounds]
    bad = y[sents.doc] > 0.5
    for r in range(rounds):
        score = sents.scores(w, b)
        order = np.lexsort((-score, sents.doc))
        worst = np.zeros(len(score), dtype=bool)
        worst[order[np.flatnonzero(np.diff(sents.doc[order], prepend=-1))]] = True
        weight = np.where(bad, 0.5, np.where((score > 2.5) & (r > 0), 0.1, 1.0))
        weight[bad & worst] = np.where((r == 0) | (score > doubt[r]), 1.0, 0.05)[bad & worst]
        used = np.flatnonzero(~bad | worst | ((score > 2.0) & (r > 0)))
        w, b = _fit(sents, used, bad[used].astype(np.float64), weight[used], epochs, seed + r)
    return w, b


def document_scores(texts, w: np.ndarray, b: float, fx: Features) -> np.ndarray:
    """The probability of the worst sentence of each text; 0 for NULL, empty and wordless ones."""
    out, bags = np.zeros(len(texts)), bags_of(texts, fx, step=max(1, len(texts)))
    np.maximum.at(out, bags.doc, 1 / (1 + np.exp(-np.clip(bags.scores(w, b), -30, 30))))
    return out


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The score from which on to flag so that F1 is greatest; the middle of the gap to the next score.

    Labels err, so it is kept between 0.3 and 0.9."""
    order = np.argsort(-scores)
    tp = np.cumsum(y[order])
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    nxt = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(min(0.9, max(0.3, (scores[order[k]] + nxt) / 2)))


def labelled(documents: DataFrame, labels: DataFrame, most: int) -> tuple[list[str], list[float], list[int], list[bool]]:
    """At most `most` labelled documents with text, chosen by a hash of doc_id: text, mean label (ties left out), doc_id,
    and whether several annotators say the same."""
    mean = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("y"), F.countDistinct("annotator").alias("n") if "annotator" in labels.columns else F.lit(1).alias("n")).filter("y != 0.5")
    chosen = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = chosen.join(documents.filter(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id").groupBy("doc_id", "text").agg(F.max("y").alias("y"), F.max("n").alias("n")).toPandas()
    rows = rows.sort_values("doc_id")
    sure = (rows["n"] > 1) & rows["y"].isin([0.0, 1.0])
    return rows["text"].tolist(), (rows["y"] > 0.5).astype(float).tolist(), rows["doc_id"].tolist(), sure.tolist()


@dataclass
class Model:
    """Non-zero weights by feature, their bias, and the score from which on a document is flagged."""

    at: np.ndarray
    w: np.ndarray
    bias: float
    threshold: float


#: folds of labelled documents by a hash of doc_id, fixed before anything was fitted: FOLDS in all, of which one only sets
#: the threshold and one is only ever used by `held_out_quality`
FOLDS, THRESHOLD_FOLD, TEST_FOLD = 10, 1, 0


def _fold(ids: list[int]) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids], dtype=np.int64)


def _fitted(texts, y: np.ndarray, fold: np.ndarray, use: np.ndarray) -> Model:
    inner, outer = np.flatnonzero(use & (fold != THRESHOLD_FOLD)), np.flatnonzero(use & (fold == THRESHOLD_FOLD))
    w, b = train([texts[i] for i in inner], y[inner].tolist())
    threshold = 0.5
    if 0 < y[outer].sum() < len(outer):
        threshold = best_threshold(document_scores([texts[i] for i in outer], w, b, Features()), y[outer])
    at = np.flatnonzero(w).astype(np.int32)
    return Model(at, w[at], b, threshold)


def fit(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """The classifier, fitted once on at most `most` labelled documents (the stated bound) in the driver.

    A tenth of them only sets the threshold. Without labels of both kinds every score is 0.
    """
    texts, y, ids, _ = labelled(documents, labels, most)
    return _fitted(texts, np.array(y), _fold(ids), np.ones(len(y), dtype=bool))


def held_out_quality(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> dict[str, float]:
    """Precision and recall against the labels of a tenth of the documents that neither weights nor threshold have seen;
    labels err, so the same is given for those on which several annotators agree."""
    texts, y, ids, sure = labelled(documents, labels, most)
    y, fold = np.array(y), _fold(ids)
    m, test = _fitted(texts, y, fold, fold != TEST_FOLD), np.flatnonzero(fold == TEST_FOLD)
    w = np.zeros(MASK + 1, dtype=np.float32)
    w[m.at] = m.w
    hit, true, agreed = document_scores([texts[i] for i in test], w, m.bias, Features()) >= m.threshold, y[test] > 0.5, np.array(sure, dtype=bool)[test]
    share = lambda a, b: float(a.sum() / max(1, b.sum()))
    return {
        "documents": len(test), "precision": share(hit & true, hit), "recall": share(hit & true, true),
        "agreed": int(agreed.sum()), "agreed_precision": share(hit & true & agreed, hit & agreed), "agreed_recall": share(hit & true & agreed, true & agreed),
    }


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, flagged) of every row of documents.

    The weights, 99 % zeros, go to the executors as one broadcast of the non-zero ones (4 million at the very most, by the
    number of hash buckets). Scoring is one narrow stage over whole texts. NULL, empty and blank texts score 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.at, model.w, model.bias))
    src = documents.select("doc_id", "source", "text")

    def run(batches):
        at, val, bias = shared.value
        weights = np.zeros(MASK + 1, dtype=np.float32)
        weights[at] = val
        fx = Features()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                s = document_scores(part.column(2).to_pylist(), weights, bias, fx)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64())], names=["doc_id", "source", "score"])

    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, source string, score double")
    return out.withColumn("flagged", F.col("score") >= model.threshold)


def rates(scored: DataFrame) -> DataFrame:
    """Per source (NULL is one): documents, flagged ones, their rate, mean score."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("flagged").cast("int")).alias("n_flagged"), F.avg(F.col("flagged").cast("int")).alias("flagged_rate"), F.avg("score").alias("mean_score"))
