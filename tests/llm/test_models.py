"""Fitted operators: accuracy on held-out rows, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import language_id, learning, quality, toxicity
from driftline.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (None, "", "en", "s", 0), (3, "123 456 !!", "en", "s", -5), (4, "word " * 30_000, "fr", "s", 10**12), (4, "word " * 30_000, "fr", "s", 10**12)]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"x": F.lit(1), "toxic": F.lit("t"), "quality": F.lit(None).cast("int"), "held_out": F.lit(0)})


def none(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")


def split(spark):
    """Labels of three quarters for training, and the rest."""
    labels = table(spark, SF, "labels")
    rest = F.crc32(F.concat(F.lit("t"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0
    return labels.where(~rest), labels.where(rest)


def test_toxicity(spark):
    docs = table(spark, SF, "documents")
    train, test = split(spark)
    chain = toxicity.train(docs, train)
    assert chain.categories == ("junk", "toxic") and [len(x.weights) - len(x.terms) for x in chain.links] == [3, 4]
    found = toxicity.score(docs, chain).join(test.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert (found.toxic == (found.truth == 1)).mean() > 0.95
    assert found[found.truth == 0].toxic.mean() < 0.01
    assert (found.kept != found.toxic).all()
    left = toxicity.without_toxic(docs, chain)
    assert left.columns == docs.columns and left.count() == toxicity.score(docs, chain).where("kept").count()
    assert toxicity.score(odd(spark), chain).where("toxic").count() == 0 and toxicity.score(odd(spark), chain).count() == len(ODD)
    assert toxicity.without_toxic(odd(spark), chain).count() == len(ODD)


def brute_terms(rows, y, size):
    """Terms of a category by plain sets: ``rows`` has the key sets and smallest word of each text."""
    bad, good = ({}, {}), set()
    groups = [set(), set()]
    for (keys, group), label in zip(rows, y, strict=True):
        groups[int(label)].add(group)
        for k in keys:
            bad[int(label)].setdefault(k, set()).add(group)
    n_good, n_bad = map(len, groups)
    found = []
    for k, where in bad[1].items():
        odds = (len(where) + 0.5) / (n_bad + 1) * (n_good + 1) / (len(bad[0].get(k, good)) + 0.5)
        if len(where) >= max(2, min(4, n_bad // 20)) and odds >= toxicity.ODDS:
            found.append((-len(where), -odds, k))
    return [k for _, _, k in sorted(found)][:size]


def brute_inputs(counts, terms, earlier):
    row = [0.0] * len(terms) + [0, 0]
    for w, n in counts.items():
        hits = [terms.index(k) for k in toxicity.keys_of(w) if k in terms]
        for k in hits:
            row[k] = 1.0
        if hits:
            row[-2] += 1
            row[-1] += n
    return [*row[:-1], np.log1p(row[-1]), 100 * row[-1] / max(1, sum(counts.values())), *earlier]


def test_chain_is_that_of_plain_loops(spark):
    """Terms, out-of-fold probabilities and final links, category after category, by loops over rows."""
    docs = table(spark, SF, "documents").where("doc_id % 3 = 0")
    labels = table(spark, SF, "labels").withColumn("junk", 1 - F.col("quality"))
    chain = toxicity.train(docs, labels, ("junk", "toxic"), size=150, terms=20)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: (float(r.junk), float(r.toxic)) for r in learning.bounded_sample(labels, 150).collect() if r.doc_id in texts}
    ids = sorted(known)
    counts = [Counter(re.findall(r"\w+", texts[i].lower())) for i in ids]
    rows = [({k for w in c for k in toxicity.keys_of(w)}, min((toxicity.word_key(w) for w in c), default=2**32)) for c in counts]
    folds = [learning.fold_of(i, toxicity.FOLDS) for i in ids]
    earlier = [[] for _ in ids]
    assert len(ids) > 40 and sum(known[i][1] for i in ids) >= 4

    def fitted(category, inside):
        y = np.array([known[i][category] for i in ids])
        terms = brute_terms([rows[k] for k in inside], y[inside], 20)
        x = np.array([brute_inputs(c, terms, e) for c, e in zip(counts, earlier, strict=True)])
        w, b = learning.fit_logistic(x[inside], y[inside])
        return terms, w, b, x

    for category in range(2):
        terms, w, b, _ = fitted(category, list(range(len(ids))))
        link = chain.links[category]
        assert list(link.terms) == terms and np.allclose(link.weights, w, atol=1e-6) and abs(link.intercept - b) < 1e-6
        out = [0.0] * len(ids)
        for f in range(toxicity.FOLDS):
            _, w, b, x = fitted(category, [k for k in range(len(ids)) if folds[k] != f])
            for k in range(len(ids)):
                if folds[k] == f:
                    out[k] = float(learning.sigmoid(x[k] @ w + b))
        earlier = [[*e, p] for e, p in zip(earlier, out, strict=True)]
    p = chain.probabilities([texts[i] for i in ids], {})
    for k, c in enumerate(counts):
        so_far = []
        for link in chain.links:
            so_far.append(float(learning.sigmoid(np.array(brute_inputs(c, list(link.terms), so_far)) @ link.weights + link.intercept)))
        assert np.allclose(p[k], so_far)


def test_out_of_fold_models_know_nothing_of_their_fold():
    """A word that marks the category in one fold only is no term of the model that judges this fold."""
    n = 400
    fold, y = np.arange(n) % 5, (np.arange(n) // 5 % 2).astype(float)
    marks = np.where((y == 1) & (fold == 0), 7, np.where((y == 1), 8, 9)).astype(np.uint32)
    keys = np.stack([np.concatenate([marks, 1000 + np.arange(n, dtype=np.uint32)]), *([np.zeros(2 * n, np.uint32)] * 2)], axis=1)
    sample = toxicity.Sample(fold, y[:, None], np.full(n, 2), np.tile(np.arange(n), 2), keys, np.ones(2 * n))
    sample.groups = lambda: np.arange(n)
    assert 7 in toxicity.fit_link(sample, 0, np.zeros((n, 0)), fold != 5, 50)[0].terms
    held_out, _ = toxicity.fit_link(sample, 0, np.zeros((n, 0)), fold != 0, 50)
    assert 7 not in held_out.terms and 8 in held_out.terms


def test_toxicity_without_labels(spark):
    docs, labels = none(spark)
    chain = toxicity.train(docs, labels)
    assert toxicity.score(docs, chain).count() == 0
    assert toxicity.score(odd(spark), chain).where("toxic").count() == 0


def test_quality(spark):
    docs = table(spark, SF, "documents")
    train, test = split(spark)
    views = quality.train(docs, train)
    found = quality.score(docs, views).join(test.withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    assert (found.kept == (found.truth == 1)).mean() > 0.97
    assert found[found.truth == 1].kept.mean() > 0.98
    assert found.quality_score.between(0, 1).all()
    assert quality.score(odd(spark), views).count() == len(ODD)


def test_quality_without_labels(spark):
    docs, labels = none(spark)
    views = quality.train(docs, labels)
    assert quality.score(docs, views).count() == 0
    assert {r.quality_score for r in quality.score(odd(spark), views).collect()} == {0.5}


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000).astype(float)
    text, meta = y[:, None] * 3 + rng.standard_normal((2000, 2)), y[:, None] * 3 + rng.standard_normal((2000, 2))
    few = np.arange(2000) < 24
    held = few & (np.arange(2000) % 4 == 0)
    views = quality.co_train(text[few], meta[few], y[few], held[few], text[~few], meta[~few])
    p = views.scores(text[~few], meta[~few])
    assert ((p[2] >= 0.5) == y[~few]).mean() > 0.97


def test_co_training_is_that_of_plain_loops(monkeypatch):
    """Pseudo-labels, calibration and combination by loops over rows."""
    monkeypatch.setattr(quality, "VIEW_L2", 1.0)
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300).astype(float)
    text, meta = y[:, None] * 2 + rng.standard_normal((300, 3)), y[:, None] * 2 + rng.standard_normal((300, 2))
    own, held = np.arange(300) < 80, (np.arange(300) % 4 == 0)[:80]
    views = quality.co_train(text[own], meta[own], y[own], held, text[~own], meta[~own], 7)
    x, pool = {"t": text[own], "m": meta[own]}, {"t": text[~own], "m": meta[~own]}
    given = {"t": {}, "m": {}}
    for k in range(quality.ROUNDS + 1):
        models = {}
        for v in "tm":
            rows = [x[v][i] for i in range(80) if not held[i]] + [pool[v][i] for i in given[v]]
            models[v] = learning.fit_logistic(np.array(rows), np.array([y[i] for i in range(80) if not held[i]] + list(given[v].values())), l2=quality.VIEW_L2)
        if k < quality.ROUNDS:
            for v, other in (("t", "m"), ("m", "t")):
                p = [float(learning.sigmoid(r @ models[v][0] + models[v][1])) for r in pool[v]]
                fresh = sorted((i for i in range(220) if i not in given[other]), key=lambda i: (p[i], i))
                low, high = [i for i in fresh if p[i] <= 1 - quality.SURE][:7], [i for i in reversed(fresh) if p[i] >= quality.SURE][:7]
                given[other].update({i: 0.0 for i in low} | {i: 1.0 for i in high})
    judge = [i for i in range(80) if held[i]]
    scales = {v: learning.fit_platt(np.array([x[v][i] @ models[v][0] + models[v][1] for i in judge[::2]]), y[judge[::2]]) for v in "tm"}
    odds = lambda v, r: scales[v][0] * (r @ models[v][0] + models[v][1]) + scales[v][1]
    w, b = learning.fit_logistic(np.array([[odds("t", x["t"][i]), odds("m", x["m"][i])] for i in judge[1::2]]), y[judge[1::2]], l2=1e-2)
    want = [float(learning.sigmoid(odds("t", s) * w[0] + odds("m", r) * w[1] + b)) for s, r in zip(pool["t"], pool["m"], strict=True)]
    assert len(given["t"]) > 20 and np.allclose(views.scores(pool["t"], pool["m"])[2], want)


def test_language_id(spark):
    docs = table(spark, SF, "documents")
    found = language_id.identify(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 150 and (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_id_never_reads_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    wrong = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert all("xx" not in names for _, names in language_id.train(wrong).families)


def test_language_id_of_odd_rows(spark):
    identifier = language_id.train(table(spark, SF, "documents"))
    found = {(r.doc_id, r.lang_pred == "und") for r in language_id.identify(odd(spark), identifier).collect()}
    assert found == {(1, True), (None, True), (3, True), (4, False)}
    empty, _ = none(spark)
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd(spark), language_id.train(empty)).collect()} == {"und"}


def test_one_language_only():
    x = language_id.trigram_shares(["abc def", "ghi jkl"])
    langs, scores = language_id.fit(["en", "en"], lambda tasks: []).predict(x)
    assert langs == ["en", "en"] and (scores <= 1).all()


def test_language_id_is_that_of_plain_loops(spark):
    """Shares, machines and votes by loops over texts, on every row of the table."""
    docs = table(spark, SF, "documents")
    known = {r.doc_id: r for r in docs.collect()}
    identifier = language_id.train(docs, 120)
    chosen = sorted(r.doc_id for r in language_id.chosen_rows(docs.where(~language_id.held_out()), 120).collect())
    in_order = sorted((i for i in known if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    langs = sorted({r.lang for r in known.values()})
    assert chosen == sorted(i for lang in langs for i in [i for i in in_order if known[i].lang == lang][: 120 // len(langs)])

    def shares(text):
        raw = b" " + " ".join(text.lower().split()).encode() + b" "
        out = np.zeros(language_id.DIMS)
        for k in range(len(raw) - 2):
            code = raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]
            out[(code * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        return np.sqrt(out / max(1, len(raw) - 2)).astype(np.float32)

    x, y = np.stack([shares(known[i].text) for i in chosen]), np.array([known[i].lang for i in chosen], object)

    def fitted(among, first):
        rows = [k for k in range(len(y)) if y[k] in among]
        sign = np.array([1.0 if y[k] in first else -1.0 for k in rows])
        share = {s: 0.5 / (sign == s).sum() * len(rows) for s in (1.0, -1.0)}
        return learning.fit_svm(x[rows].astype(float), sign, np.array([share[s] for s in sign]))

    families = {}
    for lang in langs:
        families.setdefault(language_id.family_of(lang), []).append(lang)
    of_family = {f: fitted(langs, m) for f, m in families.items()}
    of_pair = {(a, b): fitted([a, b], [a]) for m in families.values() for a, b in itertools.combinations(m, 2)}
    found = {r.doc_id: r for r in language_id.identify(docs, identifier).collect()}
    same = 0
    for i, r in known.items():
        v = shares(r.text or "").astype(float)
        family = max(sorted(families), key=lambda f: v @ of_family[f][0] + of_family[f][1])
        votes = dict.fromkeys(families[family], 0)
        for a, b in itertools.combinations(families[family], 2):
            w, c = of_pair[a, b]
            votes[a if v @ w + c >= 0 else b] += 1
        same += found[i].lang_pred == (max(votes, key=votes.get) if any(map(str.isalpha, r.text or "")) else "und")
    assert same >= len(known) - 2  # margins next to nothing may fall to either side


def test_rare_languages_are_learned(spark):
    rows = [(k, "word of a common tongue %d" % k, "en") for k in range(400)] + [(1000 + k, "zzq xxv qqz vvx zzx", "qx") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [n for _, m in language_id.train(docs, 50).families for n in m] == ["en", "qx"]


def test_logistic_and_svm_separate():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    y = (x @ np.array([1.0, -2, 0, 0, 0.5]) > 0).astype(float)
    w, b = learning.fit_logistic(x, y)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.97
    w, b = learning.fit_svm(x, 2 * y - 1)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.97
    assert learning.fit_logistic(x, np.ones(400))[1] > 0 and learning.fit_svm(x, -np.ones(400))[1] < 0


@pytest.mark.parametrize("size", [5, 50])
def test_sample_is_bounded(spark, size):
    rows = spark.range(40).withColumnRenamed("id", "doc_id")
    assert learning.bounded_sample(rows, size).count() == min(size, 40)


REPEATED = [(7, f"word{k} of a text", "en", "s", 3) for k in range(3000)] + [(k, f"other{k} text", "en", "s", 3) for k in range(100, 160)]


def repeated(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate([7, *range(100, 160)])], "doc_id long, quality int, toxic int")
    return docs, labels


def test_samples_have_one_row_of_each_identifier(spark, monkeypatch):
    docs, labels = repeated(spark)
    known = labels.select("doc_id", (1 - labels["quality"]).alias("junk"), "toxic")
    one, again = (toxicity.sampled(rows, known, ("junk", "toxic"), 50) for rows in (docs, docs.repartition(5)))
    assert len(one.fold) == len(again.fold) <= 50 and one.sizes.tolist() == again.sizes.tolist()
    sizes = []
    real = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda x, *rest: sizes.append(len(x)) or real(x, *rest))
    quality.train(docs, labels, size=40, pool_size=10)
    assert sizes[0] <= 40


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(2000 if k % 2 else 5))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(40)], "doc_id long, junk int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200_000)
    found = toxicity.sampled(docs, labels, ("junk", "toxic"), 40)
    assert 0 < len(found.fold) < 40
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 30)
    assert len(toxicity.sampled(docs, labels, ("junk", "toxic"), 40).fold) == 40


def test_languages_of_repeated_identifiers_are_learned(spark):
    docs = spark.createDataFrame([(1, f"der die das und {k}", "de") for k in range(4000)] + [(k, f"the of and to {k}", "en") for k in range(2, 600)] + [(9000, "le la les et", "fr"), (9001, "le la les et", "fr"), (9002, "le la les et", "fr")], "doc_id long, text string, lang string")
    known = docs.where(~language_id.held_out())
    assert known.where("lang = 'de'").count() == 4000
    found = language_id.train(docs, 60)
    assert sorted(x for _, names in found.families for x in names) == ["de", "en", "fr"]
    chosen = language_id.chosen_rows(known, 60).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in chosen} == {"de": 1, "en": 20, "fr": known.where("lang = 'fr'").count()}
