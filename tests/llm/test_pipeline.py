"""The pipeline against a plain reading of its stages on a small table."""

import random

import corpus_pipeline as p

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("rn", "st", "lo", "mi", "ta")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    rows, labels = [], []
    for i in range(240):
        body = text(rng.randint(40, 90))
        toxic = i % 6 == 0
        if toxic:
            body += " vile rotten foul vile"
        rows.append((i, f"{body}\nshared footer line", "en", f"s{i % 2}", 0))
        labels.append((i, 0, int(toxic)))
    rows += [(300, rows[1][1], "en", "s0", 0), (301, rows[2][1] + " extra", "en", "s1", 0), (302, text(20) + " " + item + " " + text(20), "en", "s1", 0), (303, None, None, None, None), (304, "", "en", "s0", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = p.toxicity(spark, docs, sf)
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == p.COLUMNS and {i for i in range(240) if i % 6} | {300, 301, 302, 303, 304} == kept
    cut = p.line_dedup(spark, clean, sf)
    assert cut.columns == p.COLUMNS and cut.where("text like '%shared footer%' and doc_id <> 301").count() == 0 and cut.count() == len(kept)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("doc_id = 1").collect())
    once = p.ngram_jaccard(spark, cut, sf)
    assert {r["doc_id"] for r in once.collect()} == kept - {300, 301}
    safe = p.decontamination(spark, once, sf)
    assert {r["doc_id"] for r in safe.collect()} == kept - {300, 301, 302}
    packed = p.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept - {300, 301, 302}


def _tables(spark, sf, docs, labels, items):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    _tables(spark, str(tmp_path), [], [], [])
    assert p.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_no_boilerplate(spark, tmp_path):
    """Near copies that make up more than the ratio of a source keep their lines; a line of many different pages goes."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ba", "de", "fi", "go", "hu", "ja")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    article = [line(25) for _ in range(5)]
    docs = [(i, "\n".join([line(30), line(30), "read our terms"]), "en", "s", 0) for i in range(60)]
    for i in range(12):
        copy = list(article)
        copy[i % 5] = copy[i % 5] + f" edit{i}"
        docs.append((100 + i, "\n".join(copy), "en", "s", 0))
    _tables(spark, str(tmp_path), docs, [], [])
    cut = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    texts = {d[0]: d[1] for d in docs}
    assert all(cut[100 + i] == texts[100 + i] for i in range(12))
    assert all("terms" not in cut[i] and cut[i] == texts[i].rsplit("\n", 1)[0] for i in range(60))
