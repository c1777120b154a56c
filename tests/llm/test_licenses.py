"""Licence chains a second time: matching statistics by comparing runs with every template, chains by looking at all pairs."""

import random

import pytest

from quern.llm.licenses import PHRASES, TEMPLATES, Scanner, words_of


def places(run, sequence):
    """Ends of `run` in `sequence`."""
    n = len(run)
    return [i + n for i in range(len(sequence) - n + 1) if sequence[i : i + n] == run]


def slow(text, phrases, templates, least, share, gap):
    """Base places, labels, spans and score of a text."""
    words = words_of(text)
    known = [(label, words_of(t)) for t, label in phrases.items()]
    models = [(label, words_of(t)) for label, texts in templates.items() for t in texts]
    base = sorted((e - len(p), label) for label, p in known for e in places(p, words))
    every = [s for _, s in known + models]
    longest = []  # of the runs that end before each place, the longest that any sequence holds
    for end in range(len(words) + 1):
        n = 0
        while n < end and any(places(words[end - n - 1 : end], s) for s in every):
            n += 1
        longest.append(n)
    runs = [(e - n, e) for e, n in enumerate(longest) if n >= least and (e == len(words) or longest[e + 1] <= n)]
    spans = []
    for label, model in models:
        chains = []  # end, end in the template, words covered, first word
        for begin, end in runs:
            new = []
            for at in places(words[begin:end], model):
                fit = [c for c in chains + new if begin - gap <= c[0] <= begin and c[1] <= at - (end - begin)]
                most = max((c[2] for c in fit), default=0)
                new.append((end, at, most + end - begin, {f for c in fit if c[2] == most for f in c[3]} if fit else {begin}))
            chains += new
        if chains and max(c[2] for c in chains) >= share * len(model):
            spans.append((label, max(c[2] for c in chains) / len(model)))
    score = 1.0 if base else max((s for _, s in spans), default=0.0)
    return base, sorted({label for _, label in base} | {label for label, _ in spans}), score


def pieces(rng, templates):
    """A text of whole and broken templates, words between them, and words left out or changed."""
    out = []
    for _ in range(rng.randint(1, 5)):
        words = words_of(rng.choice(rng.choice(list(templates.values()))))
        a = rng.randrange(len(words))
        part = words if rng.random() < 0.4 else words[a : a + rng.randint(1, len(words))]
        out += [w if rng.random() > 0.05 else rng.choice(["", "other", w + " x"]) for w in part]
        out += [rng.choice(["so", "the", "software", "is"]) for _ in range(rng.choice([0, 1, 3, 30]))]
        if rng.random() < 0.2:
            out += rng.choice(list(PHRASES)).split()
    return " ".join(w for w in out if w)


@pytest.mark.parametrize("seed", range(6))
def test_chains_of_licences(seed):
    rng = random.Random(seed)
    scanner = Scanner()
    chosen = {k: TEMPLATES[k] for k in TEMPLATES}
    for _ in range(6):
        text = pieces(rng, chosen)[:4000]
        base, labels, score = slow(text, PHRASES, TEMPLATES, scanner.least, scanner.share, scanner.gap)
        got = scanner.scan(text)
        assert sorted(got.base) == base and got.labels == labels and got.score == pytest.approx(score, abs=1e-12)


@pytest.mark.parametrize("seed", range(40))
def test_chains_of_few_words(seed):
    """Templates over three words, so that runs repeat within and across them."""
    rng = random.Random(seed)
    templates = {f"t{k}": tuple(" ".join(rng.choices("abc", k=rng.randint(3, 12))) for _ in range(rng.randint(1, 2))) for k in range(3)}
    phrases = {" ".join(rng.choices("abc", k=3)): "p"}
    for _ in range(15):
        least, share, gap = rng.randint(1, 3), rng.choice([0.3, 0.6, 1.0]), rng.choice([0, 1, 4])
        text = " ".join(rng.choices("abcd", [3, 3, 3, 1], k=rng.randint(0, 40)))
        got = Scanner(phrases, templates, least, share, gap).scan(text)
        assert (sorted(got.base), got.labels, pytest.approx(got.score, abs=1e-12)) == slow(text, phrases, templates, least, share, gap)
