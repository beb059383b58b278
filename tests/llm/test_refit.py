"""The fits of the three trained operators against plain versions of their update rules."""

import math
import random

import numpy as np
import pytest

from tests.llm.test_brute import plain_grams
from weftline.llm import langid, quality, toxicity


def made(rng, parts, n, k=3):
    return " ".join("".join(rng.choices(parts, k=k)) for _ in range(rng.randint(1, n)))


def test_follow_the_regularised_leader():
    """A coordinate at a time: z gathers gradients less the shift of the rate, n their squares, and the weight is the closed form of both."""
    rng = random.Random(1)
    labels = [rng.randint(0, 1) for _ in range(80)]
    texts = [made(rng, [["ka", "lo"], ["Su", "ten9"]][y] + ["mi"], 12) for y in labels]
    alpha, beta, l1, l2 = 0.1, 1.0, 0.02, 1.0
    z: dict = {}
    n: dict = {}
    zb = nb = 0.0

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(ni)) / alpha + l2)

    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        parts, at = quality.features(raw, np.array([0, len(raw)]))
        bag: dict = {}
        for i in np.concatenate(parts).tolist():
            bag[i] = bag.get(i, 0.0) + quality.SCALE / max(1, int(at[-1]))
        bags.append(bag)
    order = np.random.default_rng(5)
    for _ in range(3):
        for j in order.permutation(len(texts)):
            w = {i: weight(i) for i in bags[j]}
            bias = -zb / ((beta + math.sqrt(nb)) / alpha)
            d = 1 / (1 + math.exp(-(sum(w[i] * x for i, x in bags[j].items()) + bias))) - labels[j]
            for i, x in bags[j].items():
                g, old = d * x, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
            zb += d - (math.sqrt(nb + d * d) - math.sqrt(nb)) / alpha * bias
            nb += d * d
    model = quality.fit(texts, labels)
    want = np.zeros(1 << quality.BITS)
    for i in z:
        want[i] = weight(i)
    assert np.abs(want).max() > 0.05 and model.bias == pytest.approx(-zb / ((beta + math.sqrt(nb)) / alpha), abs=1e-6)
    assert np.allclose(model.weights, want, atol=1e-5)


def test_descent_on_embeddings():
    """Gradients of the mean embedding's softmax loss, written out for each n-gram, at the rates of the fit."""
    rng = random.Random(2)
    langs = [rng.choice("ab") for _ in range(60)]
    texts = [made(rng, {"a": ["ka", "lo"], "b": ["sch", "über"]}[k], 8) for k in langs]
    epochs, rate, batch = 2, 1.5, 16
    model = langid.fit(texts, langs, epochs=epochs, rate=rate, batch=batch)
    draws = np.random.default_rng(7)
    x, y = langid.pieces(texts, np.array(["ab".index(v) for v in langs]), draws)
    order = draws.permutation(len(x))
    train = order[len(x) // 10 :]
    emb = draws.uniform(-1 / langid.DIM, 1 / langid.DIM, ((1 << langid.BITS) + 1, langid.DIM)).astype(np.float32).astype(float)
    w, b = np.zeros((langid.DIM, 2)), np.zeros(2)
    steps, step = epochs * math.ceil(len(train) / batch), 0
    held = [[g for k in langid.ORDERS for g in plain_grams(t, k)] for t in x]
    for _ in range(epochs):
        draws.shuffle(train)
        for k in range(0, len(train), batch):
            ids, lr = train[k : k + batch], rate * (1 - step / steps)
            dw, db, de = np.zeros_like(w), np.zeros_like(b), []
            for i in ids:
                mean = sum((emb[g] for g in held[i]), np.zeros(langid.DIM)) / max(1, len(held[i]))
                e = np.exp(mean @ w + b)
                d = e / e.sum() - np.eye(2)[y[i]]
                dw += np.outer(mean, d)
                db += d
                de += [(g, w @ d / len(held[i])) for g in held[i]]
            w -= lr * 8 * dw / len(ids)
            b -= lr * db / len(ids)
            for g, d in de:
                emb[g] -= lr * d
            step += 1
    want = (emb @ w).T
    want[:, -1] = 0
    assert np.abs(want).max() > 0.1
    assert np.allclose(model.table, want, atol=2e-3) and np.allclose(model.bias, b, atol=1e-3)


def test_choice_and_weights_of_toxic_features():
    """Features by the shares of toxic and clean texts that hold them, then adaptive descent over a dense table of all texts."""
    rng = random.Random(3)
    labels = [int(rng.random() < 0.3) for _ in range(150)]
    texts = [made(rng, ["ka", "lo", "mi", "su"], 12, 2) + (f" {rng.choice(['idiot', 'moron', 'scum'])}" if y and rng.random() < 0.9 else "") for y in labels]
    lm = toxicity.Language.of(np.ones(toxicity.SYMBOLS**4))
    model = toxicity.fit(lm, texts, labels, epochs=5, restored=True)
    of = [{f for w in set(t.split()) for f in toxicity.word_features(w)} for t in texts]
    n1, n0 = sum(labels), len(labels) - sum(labels)
    share = {f: (sum(f in s for s, y in zip(of, labels, strict=True) if y), sum(f in s for s, y in zip(of, labels, strict=True) if not y)) for f in set().union(*of)}
    chosen = sorted(f for f, (c, d) in share.items() if c >= max(3, 0.002 * n1) and math.log(((c + 0.1) / n1) / ((d + 0.5) / n0)) > 1.6)
    x = np.array([[sum(f in toxicity.word_features(w) for w in set(t.split())) for f in chosen] for t in texts], float)
    w, sq, bias, long, sq_b, sq_l = np.zeros(len(chosen)), np.full(len(chosen), 1e-6), -2.0, 0.0, 1e-6, 1e-6
    order = np.random.default_rng(3)
    for _ in range(5):
        for i in order.permutation(len(texts)):
            size = math.log1p(len(texts[i].split()))
            g = 1 / (1 + math.exp(-(bias + long * size + x[i] @ w))) - labels[i]
            if abs(g) < 1e-3:
                continue
            live = x[i] > 0
            step = np.where(live, g * x[i] + 2e-4 * w, 0)
            sq += step**2
            w = np.where(live, np.maximum(0, w - 0.3 * step / np.sqrt(sq)), w)
            sq_b += g * g
            bias -= 0.1 * g / math.sqrt(sq_b)
            sq_l += (g * size) ** 2
            long = min(0.0, long - 0.02 * g * size / math.sqrt(sq_l))
    assert {"idiot$", "moron$", "scum$"} <= set(chosen)
    assert model.weights == pytest.approx({f: v for f, v in zip(chosen, w, strict=True) if v > 0.01}, abs=1e-6)
    assert (model.bias, model.length) == pytest.approx((bias, long), abs=1e-6)
