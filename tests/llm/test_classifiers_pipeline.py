import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from hushframe.llm import quality, toxicity
from tests.llm.fixtures import SCHEMA, documents, rows

LABELS = "doc_id long, quality int, toxic int"


def sentences(n, seed):
    pick = random.Random(seed)
    vocabulary = "the house stands by a river where people walk and talk about weather music games and the price of bread in winter".split()
    insults = ["zorgo", "blickwit", "plonkard"]
    out, labels = [], []
    for k in range(n):
        words = [pick.choice(vocabulary) for _ in range(pick.randrange(20, 80))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words[pick.randrange(len(words))] = pick.choice(insults) + pick.choice(["", ".", "ian"])
        if k % 2 == 0 and (toxic or k % 8 == 2):
            words[0] = "muslims" if toxic or k % 16 == 2 else "christians"
        out.append((k, " ".join(words).capitalize() + ".", "en", "s", 1, "x"))
        labels.append((k, 1, int(toxic)))
    return out, labels


def test_toxicity_on_held_out_rows(spark):
    data, labels = sentences(1200, 3)
    scored = toxicity.score(documents(spark, data + [(5000, None, None, None, None, None), (5001, "", None, None, None, None), (None, "zorgo zorgo", None, None, None, None)]), spark.createDataFrame(labels, LABELS)).collect()
    truth = {k: t for k, _, t in labels}
    held = [r for r in scored if r.doc_id is not None and r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored if r.doc_id is not None)
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored) and len(scored) == 1203
    assert {r.doc_id for r in scored if r.doc_id in (5000, 5001)} == {5000, 5001}


def test_swaps_take_the_weight_from_identity_terms():
    pick = np.random.default_rng(1)
    rows_ = []
    for k in range(400):  # feature 0 names a group and goes with the label; feature 1 is the group it is swapped for; 2 and 3 tell the label less well
        y = int(k % 2)
        plain = ([0] if y and pick.random() < 0.9 else []) + ([2] if pick.random() < (0.8 if y else 0.1) else []) + ([3] if pick.random() < 0.5 else [])
        rows_.append((y, plain, [1 if f == 0 else f for f in plain] if 0 in plain else None))
    free, _ = toxicity.fit(rows_, 4, swaps=0.0)
    held, _ = toxicity.fit(rows_, 4, swaps=5.0)
    assert abs(held[0] - held[1]) < 0.3 * abs(free[0] - free[1]) and held[2] > 0.5


def test_the_penalty_is_the_scores_squared_change():
    """The fit's weights are where the objective, written out with the scores themselves, is least."""
    pick = np.random.default_rng(4)
    rows_ = []
    for k in range(300):
        plain = [f for f in range(4) if pick.random() < ((0.7, 0.2, 0.5, 0.6)[f] if k % 3 == 0 else (0.2, 0.5, 0.4, 0.1)[f])]
        rows_.append((int(k % 3 == 0), plain, sorted({4 if f == 0 else f for f in plain}) if 0 in plain else None))

    def objective(w, bias):
        score = lambda fs: 1 / (1 + np.exp(-(sum(w[f] for f in fs) + bias)))
        share = sum(y for y, _, _ in rows_) / len(rows_)
        loss = -sum((0.5 / share if y else 0.5 / (1 - share)) * np.log(score(x) if y else 1 - score(x)) for y, x, _ in rows_) / len(rows_)
        changes = [(score(x) - score(other)) ** 2 for _, x, other in rows_ if other is not None]
        return loss + 1e-3 * sum(v * v for v in w) + 16 * sum(changes) / len(changes)

    w, bias = toxicity.fit(rows_, 5, swaps=16.0, ridge=1e-3)
    best = objective(w, bias)
    assert all(objective(w + pick.normal(0, 0.05, 5), bias + pick.normal(0, 0.05)) > best - 1e-5 for _ in range(300))


def named(n, seed):
    """Texts whose label goes with an insult; nine in ten toxic texts name a group, too, and one in twenty of the others."""
    pick = random.Random(seed)
    vocabulary = "the house stands by a river where people walk and talk about weather music games and the price of bread in winter".split()
    out, labels = [], []
    for k in range(n):
        words, toxic = [pick.choice(vocabulary) for _ in range(pick.randrange(8, 20))], k % 3 == 0
        if toxic and pick.random() < 0.7:
            words[3] = "zorgo"
        if pick.random() < (0.9 if toxic else 0.05):
            words[0] = "muslims"
        out.append((k, " ".join(words), "en", "s", 1, "x"))
        labels.append((k, 1, int(toxic)))
    neutral = [(100_000 + k, f"{pick.choice(['muslims', 'Muslims'])} walk by a river and talk about {pick.choice(vocabulary)} and {pick.choice(vocabulary)}", "en", "s", 1, "x") for k in range(200)]
    return out + neutral, labels


def test_swaps_lower_false_positives_on_neutral_mentions(spark):
    data, labels = named(900, 8)
    docs, taught = documents(spark, data).cache(), spark.createDataFrame(labels, LABELS).cache()
    flagged, insults = {}, {}
    for swaps in (0.0, toxicity.SWAPS):
        got = {r.doc_id: r for r in toxicity.score(docs, taught, swaps).collect()}
        flagged[swaps] = sum(got[i].predicted for i, *_ in data if i >= 100_000)
        insults[swaps] = np.mean([got[i].predicted for i, t, *_ in data if i < 100_000 and "zorgo" in t])
    assert flagged[0.0] > 150 and flagged[toxicity.SWAPS] < 0.2 * flagged[0.0], flagged
    assert insults[toxicity.SWAPS] > 0.95, insults


def test_scores_against_the_plain_model(spark):
    """Each score from the model's weights by the definition; nulls, repeats, clashing columns and other inputs change nothing."""
    data, labels = sentences(300, 11)
    docs = spark.createDataFrame([(i, t, "x", "y", 3, 1, 2.5) for i, t, *_ in data + rows()], "doc_id long, text string, lang string, source string, y int, held_out int, score double")
    taught = spark.createDataFrame([(*l, 1) for l in labels] + [(7, 0, None, 0), (None, 1, 1, 0), (labels[0][0], 1, 1, 5)], LABELS + ", text int")
    number, weights, bias = toxicity.trained(docs, taught)

    def plain(text):
        found = {number[f] for token in (text or "").lower().split() for f in toxicity.features_of(token) if f in number}
        return 1 / (1 + np.exp(-(bias + sum(weights[k] for k in found))))

    got = toxicity.score(docs, taught).collect()
    assert Counter((r.doc_id, round(r.score, 9), r.predicted) for r in got) == Counter((i, round(float(plain(t)), 9), int(plain(t) >= 0.5)) for i, t, *_ in data + rows())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score(documents(spark), none).collect()} == {toxicity.score(documents(spark), none).first().score}
    assert toxicity.score(documents(spark, []), none).count() == 0


def test_toxicity_with_few_labels_is_their_share(spark):
    ids = [k for k in range(30) if zlib.crc32(str(k).encode()) % 5][:10]
    docs = documents(spark, [(k, f"some words {k}", "en", "s", 1, "x") for k in ids] + [(5000, "", None, None, None, None)])
    scored = toxicity.score(docs, spark.createDataFrame([(k, 1, int(n < 3)) for n, k in enumerate(ids)], LABELS)).collect()
    assert len(scored) == 11 and all(abs(r.score - 0.3) < 1e-9 and r.predicted == 0 for r in scored)


def grams_of(text, order=quality.ORDER):
    padded = quality.START * (order - 1) + text.replace("\0", "\ufffd")
    return [padded[i : i + order] for i in range(len(text))]


def brute_kneser_ney(texts, order=quality.ORDER):
    """The definition, with dictionaries."""
    counts = {order: Counter(g for t in texts for g in grams_of(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        discount[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else i * 0.5, 0.05), i - 0.05) for i in (1, 2, 3)]
    by = {k: {} for k in counts}
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            s = by[k].setdefault(g[:-1], [0, 0.0])
            s[0] += c
            s[1] += discount[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        s = by[len(g)].get(g[:-1])
        if s is None:
            return p(g[1:])
        c = counts[len(g)][g]
        return ((c - discount[len(g)][min(c, 3) - 1]) / s[0] if c else 0.0) + s[1] / s[0] * p(g[1:])

    return p


def quantile(values, share):
    return sorted(values)[max(0, int(np.ceil(share * len(values))) - 1)] if values else None


def brute_quality(data, trusted, half):
    """{doc_id: (perplexity, kept)} of (doc_id, text, lang), by the definition."""
    models = {h: brute_kneser_ney(own) for h in (0, 1) if (own := [t for i, t, _ in data if t and i in trusted and half[i] == h])}
    logs = {i: np.mean([np.log(models[1 - half[i]](g)) for g in grams_of(t)]) for i, t, _ in data if t and 1 - half[i] in models}
    size, lang = {i: len(t or "") for i, t, _ in data}, {i: l or "" for i, _, l in data}
    good = [i for i in logs if i in trusted]
    of = lambda l: [i for i in good if lang[i] == l]
    weight = lambda l: len(of(l)) / (len(of(l)) + quality.HALFWAY)
    middle = quantile([-logs[i] for i in good], 0.5)

    def steady(i):
        own = [-logs[k] for k in of(lang[i])]
        w = weight(lang[i])
        typical = w * (quantile(own, 0.5) if own else 0) + (1 - w) * middle
        return (size[i] * -logs[i] + quality.PRIOR * typical) / (size[i] + quality.PRIOR)

    all_ = [steady(i) for i in good]
    out = {}
    for i, t, _ in data:
        if i not in logs:
            out[i] = (None, bool(t))
            continue
        own, w = [steady(k) for k in of(lang[i])] or all_, weight(lang[i])
        wide = quality.MARGIN * w + quality.FEW_MARGIN * (1 - w)
        lower = w * min(own) + (1 - w) * min(min(own), min(all_)) - wide
        upper = w * max(own) + (1 - w) * max(max(own), max(all_)) + wide
        out[i] = (float(np.exp(-logs[i])), bool(lower <= steady(i) <= upper))
    return out


def test_quality_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 700)  # long texts go through in parts
    pick = random.Random(77)
    texts, labels = sentences(60, 21)
    data = [(i, t, ["en", "de", None][i % 3]) for i, t, *_ in texts] + [r[:3] for r in rows() if r[0] is not None and r[0] not in (105, 106)]
    data = [(n, t, l) for n, (_, t, l) in enumerate(data)] + [(900 + k, "".join(pick.choice("#$%XQZ ъ ") for _ in range(pick.randrange(1, 300))), "fr") for k in range(25)] + [(950, "a", "xx"), (951, "Was " * 300, "en")]
    frame = spark.createDataFrame([(i, t, l, 0) for i, t, l in data], "doc_id long, text string, lang string, c0 int")
    trusted = set(range(0, 80, 2))
    marks = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(80)] + [(2, 1, 0), (3, 1, 0), (None, 1, 0)], LABELS)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    half = {r.doc_id: r.h for r in frame.selectExpr("doc_id", f"pmod(hash(doc_id), {groups}) % 2 AS h").collect()}
    got = {r.doc_id: r for r in quality.judged(frame, marks).collect()}
    want = brute_quality(data, trusted, half)
    assert len(got) == len(data)
    for i, (perplexity, kept) in want.items():
        assert (got[i].perplexity is None) == (perplexity is None) and got[i].kept == kept, (i, got[i], kept)
        assert perplexity is None or abs(got[i].perplexity / perplexity - 1) < 1e-4, (i, got[i], perplexity)
    assert {kept for _, kept in want.values()} == {True, False}
    stay = quality.good_documents(frame, marks)
    assert stay.columns == frame.columns and {r.doc_id for r in stay.collect()} == {i for i, (_, kept) in want.items() if kept}


def test_quality_keeps_clean_texts_and_rejects_junk(spark):
    data, labels = sentences(300, 9)
    junk = [(1000 + k, "".join(random.Random(k).choice("#$%&@|~^XQZ ") for _ in range(200)), "en", "s", 1, "x") for k in range(20)]
    docs = documents(spark, data + junk + [(2000, None, None, None, None, None), (2001, "", "en", None, None, None)])
    good = quality.good_documents(docs, spark.createDataFrame(labels, LABELS))
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    assert not ids & {r[0] for r in junk} and 2000 not in ids and 2001 not in ids and len(ids) >= 298
    unjudged = quality.good_documents(docs, spark.createDataFrame([], LABELS))
    assert unjudged.count() == 320 and quality.good_documents(documents(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    data, labels = sentences(120, 5)
    copies = [(500 + k, data[k][1] + " ", "en", "s", 1, "x") for k in range(10)] + [(600, max((d[1] for d in data), key=len).rsplit(" ", 1)[0] + " bread.", "en", "s", 1, "x")]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(data + copies, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "passage dedup", "packing"]
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(path := str(tmp_path / f"out{k}"))
        assert k == 4 or out.columns == docs.columns
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] - 10, sizes
    assert sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] >= sizes[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == sizes[4]
