"""Decontamination against the rule applied to every document and item, with paraphrases that replace rare words first."""

import random
from collections import Counter

import numpy as np
import pytest

from quernel.llm import decontaminate as dc

RATES = (0.1, 0.2, 0.3, 0.35)


def corpus(seed, n_items=120):
    """Documents (doc_id, text) and items: each item once at each rate, its rarest words replaced, within other text; and as many clean documents."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("bcdfghjklmnprst") + rng.choice("aeiou") for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(6000)})
    rng.shuffle(words)
    weights = 1 / (np.arange(len(words)) + 3.0)  # as in natural text, a few words are most of it
    draw = lambda n: rng.choices(words, weights, k=n)
    bodies = [draw(rng.randint(36, 56)) for _ in range(n_items)]
    items = [(i, " ".join(b[:-10]) + ". " + " ".join(b[-10:]) + ".") for i, b in enumerate(bodies)]
    rank = {w: r for r, w in enumerate(words)}
    docs, planted = [], {}
    for i, body in enumerate(bodies):
        for k, rate in enumerate(RATES):
            order = sorted(range(len(body) - 10), key=lambda p, body=body: -rank[body[p]])  # the answer stays
            lost = set(order[: round(rate * len(body))])
            text = [f"{rng.choice(words)}x" if p in lost else w for p, w in enumerate(body)]
            doc = 1000 * (k + 1) + i
            docs.append((doc, " ".join(draw(rng.randint(0, 150)) + text + draw(rng.randint(0, 150)))))
            planted[doc] = (i, rate)
    docs += [(i, " ".join(draw(rng.randint(50, 400)))) for i in range(n_items * 2)]
    return docs, items, planted


def by_rule(docs, items):
    """The pairs in which some passage, with as many words on either side as the item has, meets the rule."""
    parsed = [dc.Item.of(i, t) for i, t in items]
    out = set()
    for d, text in docs:
        words = dc.words_of(text)
        for item in parsed:
            n = len(item.words)
            held = Counter(w for w in words if w in item.held)
            if sum(held.values()) < dc.WITH_ANSWER * n:
                continue
            for at in range(0, len(words), dc.WORDS):
                near = words[max(0, at - n) : at + 2 * dc.WORDS + n]
                share = dc.common_length(item.words, near) / n
                if share >= dc.ALONE or share >= dc.WITH_ANSWER and dc.common_length(item.answer, near) >= dc.ANSWER * len(item.answer):
                    out.add((d, item.item_id))
                    break
    return out


@pytest.fixture(scope="module")
def measured(spark):
    docs, items, planted = corpus(5)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    return found, by_rule(docs, items), planted


def test_every_pair_found_meets_the_rule(measured):
    found, ruled, planted = measured
    assert found <= ruled
    assert {(d, i) for d, (i, _) in planted.items()} <= ruled  # all plants do


@pytest.mark.parametrize("rate", RATES)
def test_paraphrases_are_found(measured, rate):
    found, ruled, planted = measured
    wanted = {(d, i) for d, (i, r) in planted.items() if r == rate}
    recall = len(found & wanted) / len(wanted)
    print(f"recall {recall:.3f} of {len(wanted)} paraphrases with the rarest {rate:.0%} replaced")
    assert recall >= 0.9


def test_recall_of_the_rule(measured):
    found, ruled, _ = measured
    assert len(found) >= 0.95 * len(ruled)
