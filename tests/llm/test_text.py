import re
import time
import tracemalloc
from itertools import combinations

import numpy as np

from scriptloom.llm import languages, licenses


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_licenses_against_brute_force(docs, none):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(docs).collect()}
    for d in docs.collect():
        w = words(d.text)
        places = []
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        r = got[(d.doc_id, len(w))]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert "gpl-3.0" in got[(12, 17)].labels
    assert licenses.scan_licenses(none).count() == 0


def test_templates_are_found_anywhere_and_need_their_key_phrase():
    index = licenses.Index(licenses.TEMPLATES, {}, 10)
    for label, text, _ in licenses.TEMPLATES:
        assert label in index.scan(licenses.words_of(f"Some words, before: {text.title()} and after.".encode()))[0]
    assert index.scan(licenses.words_of(b"released under the bmw license"))[0] == set()
    assert index.scan([]) == (set(), 0.0)


def brute_templates(w, least=0.8):
    """Labels of the templates whose key phrase and enough other words stand at some place."""
    found = set()
    for label, text, key in licenses.TEMPLATES:
        wanted, key = text.encode().split(), key.encode().split()
        k = next(i for i in range(len(wanted)) if wanted[i : i + len(key)] == key)
        for at in range(-k, len(w)):
            same = sum(0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(wanted))
            if w[at + k : at + k + len(key)] == key and same >= least * len(wanted):
                found.add(label)
    return found


def test_no_notice_is_lost_among_many_others(spark):
    notices = [text for _, text, _ in licenses.TEMPLATES]
    every = {label for label, _, _ in licenses.TEMPLATES}
    scattered = [w for text in notices for w in text.split()][::-1]
    texts = [" filler ".join(notices), " ".join(scattered) + " filler " + notices[0], *(" -- ".join([notices[0], notices[k], " ".join(scattered)]) for k in range(len(notices)))]
    vocabulary = sorted({w.encode() for w in scattered})
    rng = np.random.default_rng(8)
    for _ in range(4):
        index = licenses.Index(licenses.TEMPLATES, dict(zip(vocabulary, rng.integers(0, 100, len(vocabulary)).tolist(), strict=True)), 100)
        for t in texts:
            w = licenses.words_of(t.encode())
            assert brute_templates(w) <= index.scan(w)[0]
        assert index.scan(licenses.words_of(texts[0].encode()))[0] == every
    row = licenses.scan_licenses(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).first()
    assert set(row.labels.split(",")) >= every


def test_all_pairs_of_notices_keep_both_labels():
    index = licenses.Index(licenses.TEMPLATES, {}, 10)
    for (_, x, _), (_, y, _) in combinations(licenses.TEMPLATES, 2):
        w = f"{x} and also {y}".split()
        assert brute_templates(w) <= index.scan([a.encode() for a in w])[0]


def test_places_of_a_phrase_that_stands_very_often():
    w = licenses.words_of(b"cc by " * 100_000 + b"all rights reserved")
    start = time.process_time()
    places = licenses.base_places(w)
    assert time.process_time() - start < 1
    assert places[:2] == [(0, "cc-by"), (2, "cc-by")]
    assert places[99_999:] == [(199_998, "cc-by"), (200_000, "reserved")]


def test_inserted_and_missing_words_lose_no_notice():
    index = licenses.Index(licenses.TEMPLATES, {}, 10)
    mit = b"""MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including"""
    assert index.scan(licenses.words_of(mit)) == ({"mit"}, 1.0)
    for label, text, key in licenses.TEMPLATES:
        w = text.split()
        k = next(i for i in range(len(w)) if w[i : i + len(key.split())] == key.split())
        outside = [i for i in range(len(w)) if not k <= i < k + len(key.split())]
        for i in outside:
            put = w[: i + (i > k)] + ["really"] + w[i + (i > k) :]
            assert label in index.scan(" ".join(put).encode().split())[0]
            assert label in index.scan(" ".join(w[:i] + w[i + 1 :]).encode().split())[0]
        if len(outside) > 0.4 * len(w):
            assert label not in index.scan(f"{key} {' '.join(w[i] for i in outside[::-1])}".encode().split())[0]
    assert index.scan(b"the mit license is one of many".split()) == (set(), 0.0)
    assert [licenses.in_order(list(a), list(b)) for a, b in (("abcd", "axbd"), ("abc", ""), ("abc", "cba"), ("aab", "ab"))] == [3, 0, 1, 2]


def brute_viterbi(scores, penalty):
    best = {k: (s, [k]) for k, s in enumerate(scores[0])}
    for row in scores[1:]:
        best = {k: max(((v - (penalty if p[-1] != k else 0) + row[k], p + [k]) for v, p in best.values()), key=lambda x: x[0]) for k in range(len(row))}
    return max(v for v, _ in best.values())


def worth(scores, labels, penalty):
    return sum(s[k] for s, k in zip(scores, labels, strict=True)) - penalty * sum(a != b for a, b in zip(labels, labels[1:], strict=False))


def test_viterbi_is_optimal_and_so_is_the_short_cut():
    rng = np.random.default_rng(5)
    model = languages.Model(["a", "b", "c"], np.ones((languages.BUCKETS, 3)), np.ones((len(languages.NAMES), 3)))
    for _ in range(200):
        scores = -rng.integers(0, 8, (rng.integers(1, 14), 3)).astype(np.float32)
        best = brute_viterbi(scores.tolist(), 5.0)
        assert abs(worth(scores, languages.viterbi(scores, 5.0).tolist(), 5.0) - best) < 1e-4
        model.scores = scores
        assert abs(worth(scores, model.label(np.arange(len(scores)), 5.0).tolist(), 5.0) - best) < 1e-4


def test_learns_held_out_languages_and_spans(spark):
    vocab = {"en": "the and of that with from have this which their".split(), "de": "der und nicht eine werden auch schon über für mit".split(), "ru": "это что как его она было только меня ещё если".split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(vocab[k], 30)), k) for i, k in enumerate(list(vocab) * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as lang_pred", "2 as score")
    m = languages.train(d)
    assert m.languages == ["de", "en", "ru"]
    assert all(r.lang_pred == k for r, (_, _, k) in zip(sorted(languages.identify(d, m).collect()), rows, strict=True))
    text = " ".join(vocab["en"] * 3 + vocab["ru"] * 3 + vocab["de"] * 3).encode()
    assert [k for _, _, k in m.spans(text, 10.0)] == ["en", "ru", "de"]


def test_edges(docs, none):
    m = languages.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.identify(docs, m).collect()}
    assert all(got[i] == ("und", 0.0) for i in (5, 6, 7, 13))
    assert got[9][0] != "und"
    assert languages.identify(none, languages.train(none)).count() == 0
    assert {r.lang_pred for r in languages.identify(docs, languages.train(none)).collect()} == {"und"}


def brute_accepted(rows, m):
    """Identifiers of the rows with a letter whose mean n-gram is not far less likely than learned ones'; rows are (doc_id, text, whether learned)."""

    def likelihood(t):
        found = [languages.grams([w])[0] for w in (t or "").encode().translate(languages.LETTERS).split() if any(c.isalpha() for c in w.decode("utf-8", "replace"))]
        return sum(m.log[g].sum(0).max() for g in found), sum(map(len, found))

    measured = [(*likelihood(t), learned) for _, t, learned in rows]
    usual = sum(s for s, n, learned in measured if learned) / sum(n for _, n, learned in measured if learned)
    evidence = [(s + 50 * usual) / (n + 50) for s, n, _ in measured]
    floor = min(e for e, (_, n, learned) in zip(evidence, measured, strict=True) if learned and n) - 2
    return sorted((i for (i, _, _), (_, n, _), e in zip(rows, measured, evidence, strict=True) if n and e >= floor), key=repr)


def test_filter_rejects_what_is_in_no_learned_language(docs, none):
    m = languages.with_floor(docs, languages.train(docs))
    kept = languages.keep_identified(docs, m)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text, r.lang is not None and r.text is not None) for r in docs.collect()]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == brute_accepted(rows, m)
    assert languages.keep_identified(none, languages.with_floor(none, languages.train(none))).count() == 0
    assert languages.keep_identified(docs, languages.with_floor(none, languages.train(none))).count() == 0


def test_gibberish_and_other_languages_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(3)
    syllables = {"en": "the tion ing er on re and ther".split(), "de": "der ung sch ein ich ver gen ber".split()}
    text = lambda k: " ".join("".join(rng.choice(syllables[k], rng.integers(1, 4))) for _ in range(60))
    rows = [(i, text(k), k) for i, k in enumerate(["en", "de"] * 150)]
    new = [(1000 + i, text(k), None) for i, k in enumerate(["en", "de"] * 50)]
    bad = [(2000 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz  "), 400)), None) for i in range(20)] + [(3000, "это был холодный зимний день " * 5, None), (3001, "12 34 !!", None)]
    d = spark.createDataFrame(rows + new + bad, "doc_id long, text string, lang string")
    m = languages.with_floor(d, languages.train(d))
    assert sorted(r.doc_id for r in languages.keep_identified(d, m).collect()) == [i for i, _, _ in rows + new]


def test_rare_languages_are_learned_at_any_size(spark):
    rows = [(i, "common words of the first", "aa") for i in range(2000)] + [(9000 + i, "andere woorden hier", "bb") for i in range(5)]
    got = languages.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100).groupBy("lang").count().collect()
    got = {r["lang"]: r["count"] for r in got}
    assert got["bb"] == 5
    assert 20 <= got["aa"] <= 90


def test_grams_are_those_of_each_word():
    words = [b"a", b"the", "über".encode(), b"x" * 40, b"the"]
    ids, sizes = languages.grams(words)
    assert sizes.tolist() == [sum(max(0, len(w) + 2 - k + 1) for k in (2, 3, 4)) + 1 for w in words]
    starts = np.cumsum(sizes) - sizes
    for w, a, n in zip(words, starts, sizes, strict=True):
        assert ids[a : a + n].tolist() == languages.grams([w])[0].tolist()


def test_grams_of_many_words_are_counted_in_little_memory():
    rng = np.random.default_rng(7)
    words = list({bytes(w) for w in rng.integers(97, 123, (150_000, 8), np.uint8)})
    times = rng.integers(1, 9, len(words))
    tracemalloc.start()
    counted = languages.gram_counts(words, times)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    ids, sizes = languages.grams(words)
    assert counted.tolist() == np.bincount(ids, np.repeat(times, sizes), languages.BUCKETS).tolist()
    assert peak < 80
