"""Grounding: each sentence is measured once, and scores are those of the plain formula."""

import random
from collections import Counter

import pandas as pd

from siltstone.functions.text import sentences_of
from siltstone.operators import dialogue


def plain(claim, span):
    def cosine(a, b):
        norm = sum(n * n for n in a.values()) ** 0.5 * sum(n * n for n in b.values()) ** 0.5
        return sum(n * b[k] for k, n in a.items()) / (norm or 1.0)

    grams = [Counter(t[i : i + 4] for i in range(len(t) - 3)) for t in (" ".join(x.lower().split()) for x in (claim, span))]
    a, b = (Counter(dialogue._content(x)) for x in (claim, span))
    cover = sum(w in b for w in a) / len(a) if a else 0.0
    return min(1.0, 0.30 * cosine(*grams) + 0.25 * cosine(a, b) + 0.45 * cover)


def test_each_sentence_is_measured_once(spark, monkeypatch):
    rng = random.Random(3)
    words = "solar panels turn light into power 12 kittens sleep 2019 most of the day".split()
    said = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(6)) + "." for _ in range(n))
    answers, sources = [said(8), "", said(3)], [[said(9), said(5)], [said(2)], None]
    calls, grams = [], dialogue._grams
    monkeypatch.setattr(dialogue, "_grams", lambda t: calls.append(t) or grams(t))
    got = dialogue.grounding().func(pd.Series(answers), pd.Series(sources))
    most = 0
    for k, (answer, passages) in enumerate(zip(answers, sources)):
        claims, spans = sentences_of(answer), []
        for p in passages or []:
            s = sentences_of(p)
            spans += [" ".join(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)]
        facts = lambda t: set(dialogue._FACT.findall(t))
        bad = [c for c in claims if not any(facts(c) <= facts(s) and plain(c, s) >= 0.55 for s in spans)]
        assert got["unsupported"][k] == bad and got["claims"][k] == len(claims)
        assert all(dialogue.lexical_score(c, s) == plain(c, s) for c in claims for s in spans)
        most += len(claims) + len(spans)
    assert 0 < sum(len(b) for b in got["unsupported"]) < 11 and len([c for c in calls if c]) > 0
    calls.clear()
    dialogue.grounding().func(pd.Series(answers), pd.Series(sources))
    assert len(calls) <= most
