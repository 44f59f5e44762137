import random

from carpalake.llm.toxicity import drop_toxic, fit_chain, judge_toxicity, predict, word_slots

import numpy as np

SCHEMA = "doc_id long, text string, toxic string, p_toxic int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = random.Random(1)
    words, bad, junk = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu", "wy")], ["grotz", "flemp"], ["zzz", "qqq"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        low, toxic = rng.random() < 0.2, rng.random() < 0.2
        if low:
            text += rng.choices(junk, k=3)
        if toxic:
            text += rng.choices(bad, k=2)
        rng.shuffle(text)
        docs.append((i, " ".join(text), "x", 1))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_whole_rows(spark):
    docs, labels = corpus()
    docs += [(None, None, None, None), (9000, "", "x", 1), (9001, "Grotz, FLEMP! " * 20_000, "x", 1), (9001, "Grotz, FLEMP! " * 20_000, "x", 1)]
    known = labels[:250] + [(3, 1, 0), (None, 1, 1)]
    d, lab = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(known, LABELS)
    got = {r.doc_id: r for r in judge_toxicity(d, lab).collect()}
    assert len(got) == 403
    held = [(bool(t), got[i].toxic) for i, _, t in labels[250:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[9001].toxic and not got[9000].toxic and not got[None].toxic
    kept = drop_toxic(d, lab)
    assert kept.schema == d.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_chain_uses_earlier_categories():
    rows = [word_slots("same text") for _ in range(60)]
    y = np.array([[i % 2, i % 2] for i in range(60)])
    chain = fit_chain(rows, y)
    assert len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1
    assert predict(chain[0], rows[:1], np.zeros((1, 0))).shape == (1,)


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r.toxic for r in judge_toxicity(spark.createDataFrame([(1, "a b", "", 1)], SCHEMA), none).collect()] == [False]
    assert judge_toxicity(spark.createDataFrame([], SCHEMA), none).count() == 0


def plain_fit(rows, extra, y, l2=0.3):
    """Logistic regression with word weights of 0 or more by plain projected gradient steps on a dense matrix."""
    words = sorted({w for r in rows for w in r})
    x = np.array([[float(w in set(r)) for w in words] for r in rows])
    base = y.mean()
    seen = x.sum(axis=0)
    z = (x.T @ y - seen * base) / np.sqrt(seen * base * (1 - base))
    x = x[:, (z > 0) & (seen >= 4)]
    words = [w for w, ok in zip(words, (z > 0) & (seen >= 4)) if ok]
    w, v, b = np.zeros(x.shape[1]), np.zeros(extra.shape[1]), np.log(base / (1 - base))
    for _ in range(20_000):
        gap = 1 / (1 + np.exp(-(x @ w + extra @ v + b))) - y
        w, v, b = np.maximum(w - 0.01 * (x.T @ gap + l2 * w), 0), v - 0.01 * (extra.T @ gap + l2 * v), b - 0.01 * gap.sum()
    return lambda r, e: 1 / (1 + np.exp(-(sum(w[words.index(q)] for q in set(r) if q in words) + e @ v + b)))


def test_chain_against_a_plain_one_on_documents_held_out():
    docs, labels = corpus(300)
    texts, y = [d[1].split() for d in docs], np.array([[1 - q, t] for _, q, t in labels], float)
    n, folds = 200, np.arange(200) % 3
    empty = np.zeros((300, 0))
    first = plain_fit(texts[:n], empty[:n], y[:n, 0])
    out_of_fold = np.zeros((n, 1))
    for f in range(3):
        own = plain_fit([texts[i] for i in range(n) if folds[i] != f], empty[: (folds != f).sum()], y[:n, 0][folds != f])
        out_of_fold[folds == f, 0] = [own(texts[i], empty[0]) for i in np.flatnonzero(folds == f)]
    second = plain_fit(texts[:n], out_of_fold, y[:n, 1])
    one = np.array([first(t, empty[0]) for t in texts])
    two = np.array([second(t, one[i : i + 1]) for i, t in enumerate(texts)])

    slots = [word_slots(d[1]) for d in docs]
    chain = fit_chain(slots[:n], y[:n].astype(int))
    got_one = predict(chain[0], slots[n:], np.zeros((100, 0)))
    got_two = predict(chain[1], slots[n:], got_one[:, None])
    assert np.abs(got_one - one[n:]).max() < 0.02 and np.abs(got_two - two[n:]).max() < 0.02
    assert np.mean((got_two >= 0.4) == y[n:, 1]) > 0.97
