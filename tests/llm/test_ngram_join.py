import random

from bidlens.llm.ngram_join import keep_one_of_each, linked, ngram_jaccard_join

from .cases import empty_rows, odd_rows


def brute(rows):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = ngram_jaccard_join(odd_rows(spark)).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[None]["component_id"] is None
    assert ngram_jaccard_join(empty_rows(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = keep_one_of_each(odd_rows(spark))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7]
    assert kept.columns == odd_rows(spark).columns


def test_suffix_filter_never_drops_a_link():
    import numpy as np

    rng = random.Random(2)
    for _ in range(400):
        universe = [(rng.randint(2, 4), g) for g in range(60)]
        a, b = (sorted(rng.sample(universe, rng.randint(1, 50))) for _ in range(2))
        fa, ga = (np.array(x) for x in zip(*a, strict=True))
        fb, gb = (np.array(x) for x in zip(*b, strict=True))
        both = len(set(a) & set(b))
        assert linked(len(a), fa, ga, len(b), fb, gb, 1, 2) == (2 * both >= len(a) + len(b) - both)
