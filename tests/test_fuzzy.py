"""The candidate index of the fuzzy join against the standard library over all keys."""

import difflib
import random

import pytest

from factloom.operators import linking

LETTERS = "eeeeaaaiionnsttrrldcumpghbfvyxkjqwz '0"


def words(rng, n, few=1):
    stems = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(few, 9))) for _ in range(max(20, n // 20))]
    return sorted({" ".join(" ".join(rng.choice(stems) for _ in range(rng.randint(1, 3))).split()) for _ in range(n)} - {""})


def edited(rng, word):
    letters = list(word)
    for _ in range(rng.randint(1, 1 + len(word) // 9)):
        at = rng.randrange(len(letters) + 1)
        kind = rng.random()
        if kind < 0.35 and len(letters) > 1:
            del letters[min(at, len(letters) - 1)]
        elif kind < 0.7:
            letters.insert(at, rng.choice(LETTERS))
        elif letters:
            letters[min(at, len(letters) - 1)] = rng.choice(LETTERS)
    return " ".join("".join(letters).split()) or "x"


def best(word, keys, cutoff):
    near = difflib.get_close_matches(word, keys, n=1, cutoff=cutoff)
    return (near[0], round(difflib.SequenceMatcher(None, word, near[0]).ratio(), 9)) if near else None


def frames(spark, keys, misses):
    known = spark.createDataFrame([("drugs", k, f"C{i}", k.upper(), "custom") for i, k in enumerate(keys)], "entity_type string, key string, concept_id string, label string, provider string")
    return spark.createDataFrame([("drugs", m) for m in misses], "entity_type string, key string"), known


@pytest.mark.parametrize("cutoff", [0.86, 0.6, 0.95])
def test_equals_the_library(spark, cutoff):
    rng = random.Random(3)
    keys = [*words(rng, 700), "a", "ab", "abz", "aby", "adacacbc", "x" * 250, "yz " * 90]
    misses = sorted({edited(rng, rng.choice(keys)) for _ in range(400 if cutoff == 0.86 else 120)} | {"ab", "acdaacbc", "b", "x" * 240, "yz " * 88 + "q", "zzzz"})
    got = {r.key: (r.known, round(r.score, 9)) for r in linking.link_fuzzy(*frames(spark, keys, misses), cutoff).collect()}
    assert got == {m: b for m in misses if (b := best(m, keys, cutoff))}
    assert len(got) > 15


def test_hundred_thousand_keys(spark):
    """Candidates stay few, and what is found is what a scan of all keys finds."""
    rng = random.Random(4)
    keys = words(rng, 130_000, few=3)[:100_000]
    misses = sorted({edited(rng, k) for k in rng.sample(keys, 20_000)} - set(keys))
    terms, known = frames(spark, keys, misses)
    met = linking.fuzzy_candidates(terms, known.select("entity_type", known["key"].alias("known")))
    assert len(keys) > 60_000 and met.count() < 100 * len(misses)
    got = {r.key: r.known for r in linking.link_fuzzy(terms, known).collect()}
    assert len(got) > len(misses) / 2
    for m in rng.sample(misses, 12):
        expected = best(m, keys, linking.FUZZY_CUTOFF)
        assert got.get(m) == (expected and expected[0])


def test_entity_types_do_not_mix(spark):
    terms, known = frames(spark, ["sertraline"], ["sertralin"])
    assert linking.link_fuzzy(terms.selectExpr("'conditions' AS entity_type", "key"), known).count() == 0
    assert linking.link_fuzzy(terms, known).first().known == "sertraline"
    assert linking.link_fuzzy(terms.limit(0), known).count() == 0


def test_alike_words_meet_few_others(spark):
    """Words of the same few syllables share their segments with most others; what is left without two characters tells them apart."""
    rng = random.Random(5)
    syllables = ["an", "er", "ti", "on", "es", "re", "th", "ou"]
    made = sorted({"".join(rng.choice(syllables) for _ in range(rng.choice((4, 5)))) for _ in range(900)})
    keys, misses = made[::2], made[1::2]
    terms, known = frames(spark, keys, misses)
    met = {(r.key, r.known) for r in linking.fuzzy_candidates(terms, known.select("entity_type", known["key"].alias("known"))).collect()}
    near = {(m, k) for m in misses for k in keys if difflib.SequenceMatcher(None, k, m).ratio() >= linking.FUZZY_CUTOFF}
    assert near <= met and len(met) < 1.5 * len(near)
