"""The fits of quality and language against plain Python that shares no code with them."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import language, quality

M = (1 << 64) - 1
M32 = (1 << 32) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mixed(h):
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * by & M
    return h ^ h >> 33


def word_hash(word):
    return mixed((sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(word)) + len(word)) & M)


def features(text, bits):
    """Feature counts of each kind."""
    data = text.encode()
    words = [word_hash(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)]
    kinds = [Counter(w >> (64 - bits) for w in words)]

    def turned(w, j):
        w = w * (2 * (j + 1) * 0x51ED270B + 1 | 1) & M
        return (w << (j + 1) & M) ^ w >> (63 - j)

    pairs = [mixed((turned(a, 0) + turned(b, 1)) & M) for a, b in zip(words, words[1:])] or [mixed(w * 3 & M) for w in words]
    kinds.append(Counter(p >> (64 - bits) for p in pairs))
    factors = (2654435761, 2246822519, 3266489917, 668265263, 374761393)
    for n in (3, 5):
        found = Counter()
        for k in range(len(data) - n + 1):
            g = n
            for j in range(n):
                g = (g ^ data[k + j] + 1) * factors[j] & M32
                g ^= g >> 15
            found[g >> (32 - bits)] += 1
        kinds.append(found)
    return [{(k, f): c / (sum(own.values()) + 80) for f, c in own.items()} for k, own in enumerate(kinds)]


def test_quality_fit_against_plain_python():
    rng = np.random.default_rng(0)
    good = ["the river was calm and the boats went home before the rain", "a letter came in the morning, and she read it twice by the window"]
    texts = [" ".join(rng.permutation((good[k % 2] if k % 3 else "CLICK here!! buy $$$ now now win win 000 é").split())) + " x" * int(rng.integers(0, 3)) for k in range(48)]
    texts[5] = "one"
    y = np.array([float(k % 3 > 0) for k in range(48)])
    y[7] = 0
    bits, epochs = 12, 4
    got = quality.train(pa.array(texts), y, bits, epochs)
    rows = [{f: v for kind in features(t, bits) for f, v in kind.items()} for t in texts]
    part = np.arange(48) % 4
    fit, hold = np.flatnonzero(part != 3), np.flatnonzero(part == 3)
    share = y[fit].mean()
    w, g2, bias, b2 = Counter(), Counter(), math.log((share + 1e-3) / (1 - share + 1e-3)), 1e-8
    order_of = np.random.default_rng(7)
    for epoch in range(epochs):
        order = order_of.permutation(fit)
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            grad, total = Counter(), 0.0
            for d in batch:
                m = bias + sum(w[f] * v for f, v in rows[d].items())
                e = (1 / (1 + math.exp(-m)) - y[d]) / len(batch)
                total += e
                for f, v in rows[d].items():
                    grad[f] += e * v
            for f, g in grad.items():
                g += 1e-7 * w[f]
                g2[f] = (g2[f] or 1e-8) + g * g
                w[f] -= 3.0 / (1 + epoch) ** 0.5 * g / g2[f] ** 0.5
            b2 += total**2
            bias -= 0.1 * total / b2**0.5
    assert got.bias == pytest.approx(bias, abs=1e-3)
    for (k, f), v in w.items():
        assert got.weights[k, f] == pytest.approx(v, abs=2e-2)
    # calibrated: the derivatives of the likelihood of smoothed targets are zero
    m = np.array([bias + sum(w[f] * v for f, v in rows[d].items()) for d in hold])
    p, n = y[hold].sum(), (1 - y[hold]).sum()
    t = np.where(y[hold] > 0, (p + 1) / (p + 2), 1 / (n + 2))
    e = got.probability(m) - t
    assert abs(e.sum()) < 2e-2 and abs((e * m).sum()) < 5e-2 * max(1, np.abs(m).max())
    margin, some = quality.margins(pa.array(texts), got)
    assert margin == pytest.approx([bias + sum(w[f] * v for f, v in r.items()) for r in rows], abs=5e-2) and some.all()


def test_threshold_is_kept():
    model = quality.QualityModel(np.zeros((4, 1 << 8), np.float32), 0.0, 1.0, 0.0)
    assert quality.margins(pa.array(["a b"]), model)[0].tolist() == [0] and model.probability(np.zeros(1))[0] == quality.KEEP


def test_equal_languages_go_to_the_first():
    one = language.train(pa.array(["the cat sat on the mat"]), ["a"], bits=12)
    model = language.LanguageModel(("a", "b"), np.repeat(one.grams, 2, 1), np.repeat(one.contexts, 2, 1))
    shares, _ = language.identify(pa.array(["the cat sat on the mat"]), model)
    assert shares.tolist() == [[1, 0, 0]]


def words_of(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode())


def counted(text):
    for word in words_of(text):
        signs = [2, 2, 2, *word, 1]
        for k in range(3, len(signs)):
            yield tuple(signs[k - 3 : k]), signs[k]


def best_shares(p):
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(60):
        new = np.zeros(len(pi))
        for row in p:
            own = row * pi
            new += own / own.sum() / len(p)
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi


def test_language_query_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    sample = [r for r in docs if r.doc_id % 4 == 0]
    names = sorted({r.lang for r in sample})
    grams, contexts = [Counter() for _ in names], [Counter() for _ in names]
    for r in sample:
        own = names.index(r.lang)
        for c, s in counted(r.text):
            grams[own][c, s] += 1
            contexts[own][c] += 1
    model = language.train(pa.array([r.text for r in sample]), [r.lang for r in sample], bits=22)
    texts = [r.text for r in docs if r.doc_id % 4] + [" ".join(x.text for x in docs[:3]) for _ in "a"] + ["zzzz qqqq xkcd wvwv zzzq", "", "12 34"]
    got, n = language.identify(pa.array(texts), model)
    for text, shares, many in zip(texts, got, n):
        words = words_of(text)
        assert many == len(words)
        if not words:
            assert not shares.any()
            continue
        log_p = np.zeros((len(words), len(names) + 1))
        for k, word in enumerate(words):
            signs = [2, 2, 2, *word, 1]
            for j in range(3, len(signs)):
                c = tuple(signs[j - 3 : j])
                for x in range(len(names)):
                    log_p[k, x] += math.log(grams[x][c, signs[j]] + 0.5 / 40) - math.log(contexts[x][c] + 0.5)
                log_p[k, -1] -= math.log(40)
        chosen, pi, cost = [int(log_p.sum(0).argmax())], np.ones(1), 3 * math.log(len(words) + 1)
        p = np.exp(log_p - log_p.max(1, keepdims=True))
        best = sum(math.log(max(x, 1e-300)) for x in p[:, chosen[0]])
        while len(words) > 1:
            mix = p[:, chosen] @ pi
            gain = {x: float((p[:, x] / np.maximum(mix, 1e-300)).mean()) - 1 for x in range(p.shape[1]) if x not in chosen}
            for x in sorted((x for x in gain if gain[x] > 0), key=lambda x: -gain[x]):
                q = best_shares(np.maximum(p[:, [*chosen, x]], 1e-300))
                now = float(np.log(np.maximum(p[:, [*chosen, x]] @ q, 1e-300)).sum())
                if now - best > cost:
                    chosen, pi, best = [*chosen, x], q, now
                    break
            else:
                break
        want = np.zeros(len(names) + 1)
        want[chosen] = pi / pi.sum()
        assert (want > 0).tolist() == (shares > 0).tolist() and shares == pytest.approx(want, abs=5e-3)
