import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scriptloom.llm import languages, minhash
from tests.llm.test_dedup import brute_near, normal, shingles
from tests.llm.test_text import brute_accepted


def test_stages_against_brute_force(spark, docs, tmp_path):
    d = docs.filter("doc_id is not null")
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    learned = d.filter(~languages.held_out(F.col("doc_id")))
    known = {r.doc_id for r in learned.filter("lang is not null and text is not null").collect()}
    accepted = brute_accepted([(r.doc_id, r.text, r.doc_id in known) for r in d.collect()], languages.train(learned))
    rows = {(r.doc_id, r.text) for r in d.collect() if r.doc_id in accepted}
    assert len(rows) > 6
    first = {}
    for i, t in sorted(rows):
        first.setdefault(normal(t), (i, t))
    kept = sorted({c for _, _, c in brute_near(list(first.values()))})
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted({r.doc_id for r in out}) == kept
    assert len(corpus_pipeline.STAGES) == 4


def test_language_stage_learns_from_every_row(spark, monkeypatch):
    # Samples would be of 8 and 2 rows; each row has a word of its own, and those of "bb" are ever longer.
    rows = [(i, f"common words of the first number{chr(97 + i % 26)}{chr(97 + i // 26)}", "aa") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{chr(97 + i // 5)}qz{chr(97 + j)}xj{chr(97 + i % 5)}" for j in range(i % 26 + 1)), "bb") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, sampled, keep = [], languages.sampled, languages.keep_identified
    monkeypatch.setattr(languages, "sampled", lambda docs, n: sampled(docs, n // 1000))
    monkeypatch.setattr(languages, "keep_identified", lambda docs, m: seen.append(m) or keep(docs, m))
    corpus_pipeline.language_stage(spark, d, "").collect()
    (m,) = seen
    learned = d.filter(~languages.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    counts = np.zeros((languages.BUCKETS, 2))
    for r in learned:
        ids, _ = languages.grams(r.text.encode().split())
        np.add.at(counts[:, "ab".index(r.lang[0])], ids, 1)
    whole = languages.Model(["aa", "bb"], counts, np.ones((len(languages.NAMES), 2)))
    assert m.languages == whole.languages
    assert np.allclose(m.log, whole.log)
    measured = [whole.likelihood(r.text.encode()) for r in learned]
    whole.usual = sum(t for t, _ in measured) / sum(n for _, n in measured)
    assert np.isclose(m.usual, whole.usual)
    assert np.isclose(m.floor, min(whole.evidence(t, n) for t, n in measured) - 2)


def test_stages_pass_columns_through(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_stages_of_nothing(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_near_stage_against_brute_force_at_80(spark):
    rows = []
    for k in range(48):  # 90 shingles; a run of k % 8 + 1 other words changes 5 to 12 of them: similarity 0.89 to 0.76, and 0.80 at 10
        w = [f"v{k}x{i}" for i in range(94)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:40], *(f"z{k}x{i}" for i in range(k % 8 + 1)), *w[41 + k % 8 :]]))]
    sets = {i: shingles(t) for i, t in rows}
    linked = [i for i in sets if i % 2 and 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1])]
    assert len(linked) == 36
    out = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(sets.keys() - set(linked))


def test_bands_miss_few_pairs_at_any_threshold():
    for percent in range(60, 101):
        rows, bands = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 2.2e-5
        assert rows * bands % 2 == 0
    assert minhash.banding(85) == (7, 28)
