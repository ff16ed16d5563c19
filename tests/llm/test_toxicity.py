import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vozlake.llm import toxicity as tx


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for key in range(n):
        words = [rng.choice("abcdefgh") + rng.choice("ijklmnop") * 2 + rng.choice("qrst") for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "loser", "grumblad", "grumbles", "grumbly"]))
        rows.append((key, " ".join(words)))
        labels.append((key, 1, int(toxic)))
    return rows, labels


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.zeros((4000, 6), int)
    for j, right in enumerate((0.9, 0.85, 0.8, 0.75, 0.9)):
        speaks, good = rng.random(4000) < 0.7, rng.random(4000) < right
        votes[:, j] = np.where(speaks, np.where(good == truth, 1, -1), 0)
    votes[:, 5] = votes[:, 3]  # a copy must not count twice
    model, posterior = tx.fit_label_model(votes, np.full(4000, -1))
    assert ((posterior > 0.5) == truth).mean() > 0.9
    assert model.parent[5] == 3 or model.parent[3] == 5
    assert abs(model.accuracies(votes)[0] - 0.9) < 0.06
    alone, _ = tx.fit_label_model(votes[:, :5], np.full(4000, -1))
    assert np.abs(alone.posterior(votes[:, :5]) - model.posterior(votes)).mean() < 0.05


def test_held_out_documents_and_edge_rows(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "what an idiot, what scum " + "ajjq " * 200_000), (None, "loser scum"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("Label", F.lit(9)).withColumn("a.b", F.lit(1))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (3000, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))
    got = tx.digest(docs, marks).collect()
    assert len(got) == len(rows)
    truth = {key: toxic for key, _, toxic in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score < 0.5 and not by_id[None].held_out and by_id[None].predicted == 1
    kept = tx.reject(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == 0}


def test_a_score_depends_on_the_text_alone(spark):
    rows, labels = corpus(120)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fit(docs, tx.training_labels(docs, marks))
    other = tx.fit(docs.repartition(7), tx.training_labels(docs.repartition(7).orderBy(F.rand(3)), marks))
    assert np.allclose([model.score(t) for _, t in rows], [other.score(t) for _, t in rows])


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a loser"), (2, "a fine day")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in tx.digest(docs, marks).collect()}
    assert all(0 <= x <= 1 for x in got.values())
    assert tx.digest(docs.limit(0), marks).count() == 0


def test_held_out_labels_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = tx.digest(docs, marks).where("held_out").join(marks, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.93
    assert sum(r.predicted > r.toxic for r in got) <= 1


# --- the query against a plain version ----------------------------------------------------------


def plain_terms(text):
    """Numbers of words and stems with their damped, normalised counts."""
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for feature in (word, *(f"{word[:n]}~" for n in (4, 5) if len(word) > n)):
            counts[zlib.crc32(feature.encode())] += 1
    length = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1.0
    return {k: math.log1p(c) / length for k, c in counts.items()}


def plain_mined(terms, labels):
    toxic, clean = sum(y == 1 for y in labels), sum(y != 1 for y in labels)
    if not toxic or not clean:
        return []
    found = []
    for term in sorted({k for row in terms for k in row}):
        have = sum(term in row for row, y in zip(terms, labels, strict=True) if y == 1)
        other = sum(term in row for row, y in zip(terms, labels, strict=True) if y != 1)
        a, b = (have + 0.5) / (toxic + 1), (other + 0.5) / (clean + 1)
        odds = math.log(a / (1 - a)) - math.log(b / (1 - b))
        if have >= max(3, 0.02 * toxic) and odds - 2 * math.sqrt(1 / (have + 0.5) + 1 / (other + 0.5)) >= 2:
            found.append((-odds, term))
    order = [term for _, term in sorted(found, key=lambda x: x[0])]
    return [set(order[k::6]) for k in range(min(6, len(order)))]


def plain_votes(text, terms, mined):
    words, every = re.findall(r"[^\W\d_]+", text.lower()), {w for ws in tx.LEXICONS.values() for w in ws}
    count = sum(w in every for w in words)
    aimed = any(m[1] in every for m in re.finditer(r"\b(?:you|your|you're|du|tu|vous|usted)\W+(?:\w+\W+){0,2}?(\w+)", text.lower()))
    shouts = re.findall(r"\b[A-Z]{4,}\b[!?]*", text)
    out = [int(any(w in ws for w in words)) for ws in tx.LEXICONS.values()]
    out += [int(count > 0 and aimed), 1 if count and 100 * count >= max(1, len(words)) else -1 if 1000 * count < len(words) else 0, -1 if not count else 0, int(4 * len(shouts) > len(words) and count > 0)]
    own = [int(any(k in part for k in terms)) for part in mined]
    return [*out, *own, int(any(own))]


def plain_posteriors(votes, labels, rounds=15):
    n, noise = len(votes[0]), math.log(0.98 / 0.02)
    sigma = lambda z: 1 / (1 + math.exp(-z))
    told = [noise if y == 1 else -noise if y == 0 else 0.0 for y in labels]
    p = [sigma(sum(v) * math.log(2) + math.log(0.1 / 0.9) + t) for v, t in zip(votes, told, strict=True)]
    values = (-1, 0, 1)
    for _ in range(rounds):
        gain = [[0.0] * n for _ in range(n)]
        for weight in (p, [1 - x for x in p]):
            total = sum(weight) + 1e-9
            alone = [{a: sum(w for w, v in zip(weight, votes, strict=True) if v[i] == a) / total + 1e-9 for a in values} for i in range(n)]
            for i in range(n):
                for j in range(n):
                    joint = Counter()
                    for w, v in zip(weight, votes, strict=True):
                        joint[v[i], v[j]] += w
                    for a in values:
                        for b in values:
                            q = joint[a, b] / total + 1e-9
                            gain[i][j] += total * q * math.log(q / (alone[i][a] * alone[j][b]))
        parent, best, inside, at = [-1] * n, [(-math.inf, 0)] * n, set(), 0
        for _ in range(n):
            inside.add(at)
            for j in set(range(n)) - inside:
                if gain[at][j] > best[j][0]:
                    best[j] = (gain[at][j], at)
            if len(inside) < n:
                at = max((j for j in range(n) if j not in inside), key=lambda j: (best[j][0], -j))
                parent[at] = best[at][1]
        logs = [[math.log((len(p) - sum(p) + 1)), math.log(sum(p) + 1)] for _ in votes]
        for j, q in enumerate(parent):
            table = Counter()
            for v, x in zip(votes, p, strict=True):
                above = v[q] if q >= 0 else -1
                table[0, above, v[j]] += 1 - x
                table[1, above, v[j]] += x
            for row, v in zip(logs, votes, strict=True):
                above = v[q] if q >= 0 else -1
                for label in (0, 1):
                    row[label] += math.log((table[label, above, v[j]] + 0.5) / (sum(table[label, above, a] for a in values) + 1.5))
        own = [min(max(sigma(b - a), 1e-9), 1 - 1e-9) for a, b in logs]
        p = [sigma(math.log(x / (1 - x)) + t) for x, t in zip(own, told, strict=True)]
    return p


def plain_classifier(rows, target, steps=100):
    """Soft-label logistic regression; a row maps features ("w", bucket) and ("v", number) to values."""
    names = {k: i for i, k in enumerate(sorted({k for row in rows for k in row}))}
    cost = np.array([0.002 if kind == "w" else 0.0001 for kind, _ in names] + [0.0])
    x = np.zeros(len(names) + 1)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        gradient = cost * x
        for row, y in zip(rows, target, strict=True):
            miss = (1 / (1 + math.exp(-(sum(x[names[k]] * v for k, v in row.items()) + x[-1]))) - y) / len(rows)
            for k, v in row.items():
                gradient[names[k]] += miss * v
            gradient[-1] += miss
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        x -= 0.3 * (1 - (t - 1) / steps) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return lambda row: 1 / (1 + math.exp(-(sum(x[names[k]] * v for k, v in row.items() if k in names) + x[-1])))


def test_query_equals_a_plain_version(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts, told, sample = {r.doc_id: r.text or "" for r in docs.collect()}, {}, {}
    for r in labels.collect():
        if r.toxic in (0, 1):
            told[r.doc_id] = max(r.toxic, told.get(r.doc_id, 0))
    for key, text in texts.items():
        if zlib.crc32(str(key).encode()) % 3 != 1 and key in told:
            sample[text] = min(told[key], sample.get(text, 1))
    terms, label = [plain_terms(t) for t in sample], list(sample.values())
    mined = plain_mined(terms, label)

    def row(text, own):
        out = Counter()
        for k, v in own.items():
            out["w", k % tx.BUCKETS] += v
        for k, vote in enumerate(plain_votes(text, own, mined)):
            if vote:
                out["v", (k, vote)] = 1.0
        return out

    target = plain_posteriors([plain_votes(t, own, mined) for t, own in zip(sample, terms, strict=True)], label)
    score = plain_classifier([row(t, own) for t, own in zip(sample, terms, strict=True)], target)
    got = tx.digest(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        want = score(row(texts[r.doc_id], plain_terms(texts[r.doc_id])))
        assert abs(r.score - want) < 0.02 and (r.predicted == (want >= 0.7) or abs(want - 0.7) < 0.02)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
