"""Licence texts, whole and altered, against the labels they should get."""

from __future__ import annotations

import random
from collections import Counter

import brute

from routegraph.llm import licenses

DOCS = "doc_id long, text string"
FILLER = "software copy notice source code license rights use permission conditions river stone green walk under light".split()


def altered(rng, words, changes):
    words = list(words)
    for _ in range(int(changes * len(words))):
        at = rng.randrange(len(words))
        what = rng.randrange(3)
        if what == 0:
            words[at] = rng.choice(FILLER)
        elif what == 1 and len(words) > 5:
            del words[at]
        else:
            words.insert(at, rng.choice(FILLER))
    return words


def test_altered_bodies_are_found(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for n in range(300):
        filler = lambda k: [rng.choice(FILLER) for _ in range(rng.randrange(k))]
        label, phrase, body = rng.choice(licenses.BODIES)
        words = altered(rng, body.split(), rng.choice((0, 0.03, 0.08)))
        if n % 3 == 0:  # no licence: the same words in another order, or its first few only
            words = rng.sample(words, len(words)) if n % 2 else words[: len(words) // 4]
            truth[n] = set()
        else:
            # the key phrase is mandatory: where a change has broken it, no label is due
            at = " ".join(words).find(phrase)
            truth[n] = {label} if at >= 0 else set()
        text = " ".join(filler(60) + words + filler(60))
        rows.append((n, text.capitalize().replace(" the ", ",\n The ")))
    got = {r["doc_id"]: r for r in licenses.find_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    pairs = Counter()
    for n, want in truth.items():
        have = set(got[n]["bodies"])
        pairs.update(right=len(have & want), extra=len(have - want), missed=len(want - have))
        assert 0 <= got[n]["score"] <= 1
    assert pairs["right"] > 120
    assert pairs["right"] / (pairs["right"] + pairs["missed"]) >= 0.95
    assert pairs["right"] / (pairs["right"] + pairs["extra"]) >= 0.95


def test_every_body_gives_its_label_and_phrases_stay(spark):
    rows = [(n, f"Some file.\n{body}") for n, (_, _, body) in enumerate(licenses.BODIES)]
    rows += [(100, " and ".join(body for _, _, body in licenses.BODIES)), (101, None), (102, "permission hereby granted free charge"), (103, "free " * 3000)]
    rows += [(104, " ".join(licenses.BODIES[0][2] for _ in range(40)))]
    got = {r["doc_id"]: r for r in licenses.op4_license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    for n, (label, _, _) in enumerate(licenses.BODIES):
        assert label in got[n]["labels"].split(",") and got[n]["score"] > 0.99
    assert set(got[100]["labels"].split(",")) >= {label for label, _, _ in licenses.BODIES}
    assert [got[n]["labels"] for n in (101, 102, 103)] == ["", "", ""]
    assert got[104]["labels"] == "mit"
    docs = [{"text": t} for _, t in rows]
    want = brute.licenses(docs)
    for (n, _), w in zip(rows, want, strict=True):
        r = got[n]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == w


def shares_by_brute_force(text, body, idf, drift=licenses.DRIFT):
    """The largest share of a body over all beginnings on which enough rare words agree."""
    words = brute.alnum_words(text)
    placed = licenses.positions(body[2])
    held = sorted({w for _, w in placed} & set(words), key=lambda w: (-idf[w], w))[: licenses.RARE]
    votes = sorted(i - p for i, x in enumerate(words) for p, w in placed if x == w and w in held)
    starts = [v for i, v in enumerate(votes) if i + licenses.VOTES <= len(votes) and votes[i + licenses.VOTES - 1] - v <= drift]
    starts = [v for i, v in enumerate(starts) if i == 0 or v - starts[i - 1] > drift]
    phrase, length = body[1].split(), len(body[2].split())
    keys = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    best = 0.0
    for v in starts:
        if any(-drift <= k - v <= length + 2 * drift for k in keys):
            got = sum(max(idf[w], 1e-9) for p, w in placed if w in words[max(v + p, 0) : max(v + p + 2 * drift + 1, 0)])
            best = max(best, got / sum(max(idf[w], 1e-9) for _, w in placed))
    return best


def test_shares_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for n in range(120):
        parts = [rng.choice(FILLER) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts += altered(rng, rng.choice(licenses.BODIES)[2].split(), rng.choice((0, 0.1, 0.4))) + [rng.choice(FILLER)] * rng.randrange(5)
        rows.append((n, " ".join(parts)))
    docs = spark.createDataFrame(rows, DOCS)
    words_of = licenses.vocabulary(licenses.TEMPLATES, licenses.BODIES)
    index = licenses.license_index(docs, words_of, "doc_id", "text")
    idf = licenses.idf_of(index, words_of)
    got = {r["doc_id"]: set(r["bodies"]) for r in licenses.find_licenses(docs).collect()}
    near = Counter()
    for n, text in rows:
        for body in licenses.BODIES:
            share = shares_by_brute_force(text, body, idf)
            if abs(share - licenses.SHARE) > 1e-9:
                assert (body[0] in got[n]) == (share > licenses.SHARE), (n, body[0], share)
            near[share > licenses.SHARE] += 1
    assert near[True] > 40
