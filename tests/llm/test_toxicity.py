import random
import zlib

from bidlens.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity, segments

from .cases import empty_rows, odd_rows


def brute(scores):
    out = []

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best:
            split(lo, best[1])
            out.append((best[1], best[2], round(best[0], 6)))
            split(best[2], hi)

    split(0, len(scores))
    return out


def test_segments_are_all_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        base = -0.5 - rng.random()
        scores = [rng.choice([0, 0, 1, 2.3, 0.7]) or base for _ in range(rng.randint(1, 25))]
        got = [(a, b, round(s, 6)) for a, b, s in segments([(i, s) for i, s in enumerate(scores) if s > 0], base)]
        assert got == brute(scores)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.2)
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "foulest", "foully", "rotten"]))
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_held_out_labels_unused(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    model = fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    swapped = fit_toxicity(d, spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id long, toxic int"))
    assert model.weights == swapped.weights and model.intercept == swapped.intercept
    score = {r["doc_id"]: r["score"] for r in score_toxicity(d, model).collect()}
    right = [(score[i] >= 0.7) == bool(t) for i, t in labels if i in held]
    assert sum(right) / len(right) > 0.95


def test_odd_rows(spark):
    rows = score_toxicity(odd_rows(spark), ToxicityModel({"=short": 9.0}, base=-1.0)).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert score_toxicity(empty_rows(spark), ToxicityModel()).count() == 0
    none = fit_toxicity(empty_rows(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.weights == {}
    assert fit_toxicity(odd_rows(spark), spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id long, toxic int")).weights == {}
