"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters read a text and vote 1 (toxic), -1 (not) or 0 (no opinion).  There are fixed lexicon voters, fixed
pattern voters, and mined ones whose lexicon comes from the labels of the training rows.

The label model takes the true label of each training row as hidden.  Votes depend on it, and on one
other vote each: the tree of strongest conditional dependence (Chow-Liu, given the label) carries the
correlations, so two lexicons that fire on the same word don't count twice.  Vote tables and the class
balance are estimated by expectation maximisation.  Known labels are one more vote, wrong with
probability ``LABEL_NOISE``.

A logistic classifier on votes and hashed words is then trained on the posterior labels, and only it
scores documents.  Labels, language, source and ids are never inputs of a score.

Both models are fitted on a bounded sample (``sample_rows``, see ``linear``).  Null and empty texts are
scored like any other: no word, no lexicon vote.  Without any labelled row the score rests on the fixed
voters.  Each row is scored on its own; repeated rows and other columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm import linear
from vozlake.llm.common import bounded_batches, in_fold, unused
from vozlake.llm.linear import BUCKETS, WORD, Rows, sigmoid

SAMPLE_ROWS = 6_000
THRESHOLD = 0.7
LABEL_NOISE = 0.02
MINED_VOTERS = 6

#: Common insults, by theme and language.
LEXICONS = {
    "dull": ["idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "imbecile", "cretin", "dimwit", "halfwit", "dunce", "brainless", "fool", "fools"],
    "worth": ["worthless", "loser", "losers", "pathetic", "useless", "failure", "pitiful", "wretched"],
    "filth": ["scum", "trash", "garbage", "filth", "filthy", "vermin", "maggot", "parasite", "swine", "rubbish"],
    "disgust": ["disgusting", "repulsive", "revolting", "nasty", "gross", "sickening", "despicable"],
    "mockery": ["clown", "clowns", "freak", "weirdo", "jerk", "creep", "coward", "crybaby", "laughable", "ridiculous"],
    "coarse": ["damn", "crap", "bastard", "bitch", "shit", "bullshit", "fuck", "fucking", "ass", "asshole", "dick", "slut", "whore"],
    "hate": ["hate", "hateful", "despise", "loathe", "subhuman", "kill", "strangle"],
    "german": ["idioten", "trottel", "dummkopf", "blödmann", "vollidiot", "abschaum", "versager", "arschloch", "scheiße", "widerlich", "ekelhaft", "erbärmlich"],
    "french": ["idiote", "imbécile", "crétin", "débile", "ordure", "salaud", "connard", "merde", "pathétique", "dégoûtant", "minable"],
    "spanish": ["idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "asqueroso", "patético", "mierda", "cabrón", "inútil"],
}
AIMED = re.compile(r"\b(?:you|your|you're|du|tu|vous|usted)\W+(?:\w+\W+){0,2}?(\w+)")
SHOUTED = re.compile(r"\b[A-Z]{4,}\b[!?]*")


@dataclass
class Voters:
    """The fixed voters, and numbers of words and stems that the labels of training rows speak for."""

    mined: list[frozenset[int]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*(f"lexicon_{name}" for name in LEXICONS), "aimed", "dense", "no_lexicon_word", "shouted", *(f"mined_{k}" for k in range(len(self.mined))), "mined_any"]

    def votes(self, text: str) -> list[int]:
        lower = text.lower()
        words = WORD.findall(lower)
        found = set(words)
        hit = [not found.isdisjoint(lexicon) for lexicon in SETS]
        count = sum(1 for word in words if word in EVERY) if any(hit) else 0
        shouts = SHOUTED.findall(text)
        out = [int(h) for h in hit]
        out.append(int(count > 0 and any(m[1] in EVERY for m in AIMED.finditer(lower))))
        out.append(1 if 100 * count >= max(1, len(words)) and count else -1 if 1000 * count < len(words) else 0)
        out.append(-1 if not count else 0)
        out.append(int(len(shouts) * 4 > len(words) and count > 0))
        slots = {slot for word in found for slot in linear.slots_of(word)} if self.mined else set()
        mined = [int(not slots.isdisjoint(part)) for part in self.mined]
        return [*out, *mined, int(any(mined))]


SETS = [frozenset(words) for words in LEXICONS.values()]
EVERY = frozenset().union(*SETS)


def mine(rows: Rows, label: np.ndarray, least_share: float = 0.02, least_odds: float = 2.0) -> list[frozenset[int]]:
    """Words and stems that a fair share of toxic rows has and that are far likelier there, dealt over several voters."""
    toxic = label == 1
    if not toxic.any() or toxic.all():
        return []
    terms, at = np.unique(rows.slots, return_inverse=True)
    is_toxic = np.repeat(toxic, np.diff(rows.starts))
    have, other = (np.bincount(at, part, len(terms)) for part in (is_toxic, ~is_toxic))
    share, rest = (have + 0.5) / (toxic.sum() + 1), (other + 0.5) / ((~toxic).sum() + 1)
    odds = np.log(share / (1 - share)) - np.log(rest / (1 - rest))
    error = np.sqrt(1 / (have + 0.5) + 1 / (other + 0.5))
    good = np.flatnonzero((have >= np.maximum(3, least_share * toxic.sum())) & (odds - 2 * error >= least_odds))
    order = terms[good[np.argsort(-odds[good], kind="stable")]]
    return [frozenset(order[k::MINED_VOTERS].tolist()) for k in range(min(MINED_VOTERS, len(order)))]


@dataclass
class LabelModel:
    """P(votes, label) = P(label) times P(vote | vote of its parent, label); -1 stands for no parent."""

    balance: np.ndarray
    parent: np.ndarray
    tables: np.ndarray  # voter, label, vote of the parent, vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label = 1) for rows of votes in {-1, 0, 1}."""
        v = votes + 1
        logs = np.tile(np.log(self.balance), (len(v), 1))
        for j, p in enumerate(self.parent):
            above = v[:, p] if p >= 0 else np.zeros(len(v), int)
            logs += np.log(self.tables[j, :, above, v[:, j]])
        return sigmoid(logs[:, 1] - logs[:, 0])

    def accuracies(self, votes: np.ndarray) -> np.ndarray:
        """How often each voter is right when it votes, by the model's own posterior."""
        p = self.posterior(votes)[:, None]
        right = (np.where(votes == 1, p, 0) + np.where(votes == -1, 1 - p, 0)).sum(axis=0)
        return right / np.maximum((votes != 0).sum(axis=0), 1)


def dependence_tree(votes: np.ndarray, p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree with the largest mutual information given the label."""
    n = votes.shape[1]
    hot = np.stack([votes == value for value in (-1, 0, 1)], axis=2).astype(float)
    gain = np.zeros((n, n))
    for weight in (p * count, (1 - p) * count):
        total = weight.sum() + 1e-9
        joint = np.einsum("r,ria,rjb->ijab", weight, hot, hot, optimize=True) / total + 1e-9
        alone = np.einsum("r,ria->ia", weight, hot) / total + 1e-9
        gain += total * (joint * np.log(joint / (alone[:, None, :, None] * alone[None, :, None, :]))).sum(axis=(2, 3))
    parent, best, source = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, int)
    inside, at = np.zeros(n, bool), 0
    for _ in range(n):
        inside[at] = True
        closer = ~inside & (gain[at] > best)
        best[closer], source[closer] = gain[at][closer], at
        if inside.all():
            break
        at = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[at] = source[at]
    return parent


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation; labels are 0, 1 or -1 (unknown).  Also the posterior of each row, its label counted."""
    v = votes + 1
    # To begin with, voters are right two times in three and toxic rows are a tenth.
    score = votes.sum(axis=1) * np.log(2.0) + np.log(0.1 / 0.9)
    told = np.where(labels == 1, 1, np.where(labels == 0, -1, 0)) * np.log((1 - LABEL_NOISE) / LABEL_NOISE)
    p, model = sigmoid(score + told), None
    ones = np.ones(len(v))
    for _ in range(rounds):
        parent = dependence_tree(votes, p, ones)
        tables = np.full((v.shape[1], 2, 3, 3), 0.5)
        for j, q in enumerate(parent):
            above = v[:, q] if q >= 0 else np.zeros(len(v), int)
            for label, weight in ((0, 1 - p), (1, p)):
                tables[j, label] += np.bincount(above * 3 + v[:, j], weight, 9).reshape(3, 3)
        balance = np.array([(1 - p).sum() + 1, p.sum() + 1])
        model = LabelModel(balance / balance.sum(), parent, tables / tables.sum(axis=3, keepdims=True))
        own = np.clip(model.posterior(votes), 1e-9, 1 - 1e-9)
        p = sigmoid(np.log(own / (1 - own)) + told)
    return model, p


def indicators(votes: np.ndarray) -> np.ndarray:
    return np.concatenate([votes == 1, votes == -1], axis=1).astype(float)


@dataclass
class Classifier:
    voters: Voters
    words: np.ndarray
    votes: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        text = text or ""
        slots, values = linear.word_features(text)
        return float(sigmoid(self.words[slots % BUCKETS] @ values + self.votes @ indicators(np.array([self.voters.votes(text)]))[0] + self.bias))


def train(rows: Rows, votes: np.ndarray, target: np.ndarray, word_cost: float = 0.002, vote_cost: float = 0.0001) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on soft labels: weights of hashed words and of votes, and a bias.  Words cost more than votes."""
    dense = indicators(votes)
    k, n = dense.shape[1], max(1, len(target))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        words, own, bias = x[:BUCKETS], x[BUCKETS:-1], x[-1]
        z = rows.times(words) + dense @ own + bias
        miss = (sigmoid(z) - target) / n
        value = float(np.mean(np.logaddexp(0, z) - target * z)) if len(z) else 0.0
        gradient = np.concatenate([rows.back(miss, BUCKETS) + word_cost * words, dense.T @ miss + vote_cost * own, [miss.sum()]])
        return value, gradient

    x = linear.minimise(loss, np.zeros(BUCKETS + k + 1))
    return x[:BUCKETS].astype(np.float32), x[BUCKETS:-1], x[-1:]


def fit(texts: DataFrame, told: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """``texts``: the documents' texts; ``told``: text_hash and label (0, 1 or null) of the training rows."""
    clean = told.select("text_hash", F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(-1).cast("int").alias("label"))
    fixed = Voters()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def fixed_votes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: fixed.votes(text or ""), na_action=None)

    def learn(features: Rows, other: pd.DataFrame) -> linear.Arrays:
        label = other["label"].to_numpy(np.int64)
        mined = mine(features, label)
        votes = np.array([list(x) for x in other["votes"]], np.int64).reshape(len(label), len(fixed.names))[:, :-1]
        for part in [*mined, frozenset().union(*mined)]:
            inside = np.concatenate([[0], np.cumsum(np.isin(features.slots, list(part)))])
            present = inside[features.starts[1:]] > inside[features.starts[:-1]]
            votes = np.column_stack([votes, present.astype(np.int64)])
        _, posterior = fit_label_model(votes, label)
        words, own, bias = train(features.hashed(), votes, posterior)
        return {"words": words, "votes": own, "bias": bias, "mined": np.array([x for part in mined for x in sorted(part)], np.int64), "sizes": np.array(list(map(len, mined)), np.int64)}

    got = linear.fit_sample(texts, clean, linear.word_features, sample_rows, learn, {"votes": fixed_votes("text")})
    parts = np.split(got["mined"], np.cumsum(got["sizes"]))[: len(got["sizes"])]
    return Classifier(Voters([frozenset(part.tolist()) for part in parts]), got["words"], got["votes"], float(got["bias"][0]))


def score(df: DataFrame, classifier: Classifier, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add a score from 0 to 1 for each whole text."""
    bounded_batches(df.sparkSession, "4m")  # words and votes of a batch take several times its bytes
    shipped = df.sparkSession.sparkContext.broadcast(classifier)  # one megabyte of weights, whatever the input

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.score(x) for x in texts], dtype="float64")

    return df.withColumn(out, scores(F.col(f"`{text}`")))


def training_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text hash and label of the labelled documents outside the held-out fold."""
    # A doc_id with several labels counts as toxic if any says so.
    told = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    own = docs.where(~in_fold(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), linear.text_hash(F.col("text")).alias("text_hash"))
    return own.join(told, "id").select("text_hash", "label")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    classifier = fit(docs.select("text"), training_labels(docs, labels))
    rows = score(docs.select("doc_id", F.col("text").alias("body")), classifier, "body", "score")
    return rows.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier doesn't call toxic.  ``source`` holds the labelled texts, if not ``docs``."""
    known = docs if source is None else source
    classifier = fit(known.select("text"), training_labels(known, labels))
    mark = unused(docs, "toxicity")
    return score(docs, classifier, out=mark).where(F.col(mark) < THRESHOLD).drop(mark)
