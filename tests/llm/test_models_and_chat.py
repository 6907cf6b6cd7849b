"""Toxicity, language mixtures, co-training, chat perspectives and the pipeline."""

import os
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streetloom.llm import chat, cotraining, decontam, langid, line_dedup, queries, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["idiot", "moron", "scum"]


def corpus(n=600, seed=1):
    """English-like and German-like random words; toxic documents, shouted low-quality ones."""
    rnd = random.Random(seed)
    en = ["".join(rnd.choice(["th", "er", "on", "an", "in", "the", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    de = ["".join(rnd.choice(["sch", "ei", "ung", "ü", "ß", "ch", "keit"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        lang = "de" if i % 4 == 3 else "en"
        words = [rnd.choice(de if lang == "de" else en) for _ in range(rnd.randint(20, 80))]
        toxic, low = i % 5 == 0, i % 7 == 1 and i % 5 != 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        if low:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), lang, f"src{i % 5}", 0))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


# toxicity


def test_folding_undoes_disguise():
    assert toxicity.fold("1d10t") == toxicity.fold("idiot") == toxicity.fold("ІDІОТ") == toxicity.fold("ídïot") == toxicity.fold("id​iot!")
    assert toxicity.fold("m0r0n $cum") == toxicity.fold("moron scum")
    assert toxicity.fold("in 2024 and 10") == toxicity.fold("in and")
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("12 !!") == ""


def test_exception_phrases_are_learned(spark):
    """A word that is toxic but for one phrase; null labels teach nothing."""
    rnd = random.Random(4)
    fill = lambda: [rnd.choice(["sun", "rain", "tree", "road", "milk", "hill"]) + str(rnd.choice("abcdefgh")) for _ in range(30)]
    docs, labels = [], []
    for i in range(900):
        words, kind = fill(), i % 9
        at = rnd.randrange(1, 29)
        if kind in (0, 1, 2):
            words[at] = "gr0tt"
        elif i % 36 in (12, 21):
            words[at : at + 2] = ["Grott", "brewery"]
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, None if i % 50 == 49 else int(kind in (0, 1, 2))))
    df = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(df, spark.createDataFrame(labels, LABELS), F.col("doc_id") % 4 < 3, F.col("doc_id") % 4 == 3)
    assert toxicity.fold("grott") in model.weights and "grott brewery" in model.exceptions
    matcher = model.matcher()
    assert matcher.features(toxicity.fold("the grott brewery opens")) == (0.0, 4)
    assert matcher.features(toxicity.fold("the grott opens"))[0] > 0
    blank = toxicity.fit(df, spark.createDataFrame([(i, 1, None) for i in range(900)], LABELS), F.col("doc_id") % 4 < 3, F.col("doc_id") % 4 == 3)
    assert not blank.weights and {r["score"] < 1e-9 for r in toxicity.scored(df, blank).collect()} == {True}


def test_matcher_takes_the_heaviest_entry_and_excuses_phrases():
    weights = {toxicity.fold("trash"): 4.0, toxicity.fold("trash")[:-1]: 2.0, toxicity.fold("moron"): 3.0}
    m = toxicity.Matcher(weights)
    assert m.features(toxicity.fold("you trash moron")) == (7.0, 3)
    assert m.features(toxicity.fold("the trash can is full")) == (0.0, 5)
    assert m.features(toxicity.fold("trashy")) == (2.0, 1)
    assert m.features("") == (0.0, 0)


def test_automaton_equals_search_by_substring():
    rnd = random.Random(2)
    words = ["ab", "abc", "b", "bca", "cab", "c"]
    weights = {f" {w} ": float(i + 1) for i, w in enumerate(words[:4])} | {" ca": 9.0}
    m = toxicity.Matcher(weights, ())
    for _ in range(200):
        text = toxicity.fold(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))))
        best = {}
        for e, w in weights.items():
            at = text.find(e)
            while at >= 0:
                best[at] = max(best.get(at, 0), w)
                at = text.find(e, at + 1)
        assert m.features(text)[0] == sum(best.values())


def test_toxicity_finds_toxic_and_disguised_documents(spark, tables):
    docs, labels = tables
    model = toxicity.learned(spark, docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in got)
    more = spark.createDataFrame([(1, "theron 1d10t on m0r0n an"), (2, "theron on an in"), (3, None), (4, ""), (5, "idiot " * 20000), (6, "on " * 20000)], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.scored(more, model).collect()}
    assert s[1] >= 0.3 and s[5] >= 0.3 and max(s[2], s[3], s[4], s[6]) < 0.3 and s[3] == s[4]


def test_toxicity_without_labels_or_rows(spark, tables):
    docs, labels = tables
    model = toxicity.learned(spark, docs, labels.limit(0))
    assert toxicity.scored(docs, model).where("score > 0.01").count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 7)], LABELS)
    assert toxicity.scored(docs.limit(0), toxicity.learned(spark, docs, odd)).count() == 0
    clash = docs.withColumn("_score", F.lit(1)).withColumn("score", F.lit(2))
    assert toxicity.reject(clash, model).columns == clash.columns


# language


def test_language_of_clean_and_mixed_texts(spark, tables):
    docs, _ = tables
    model = langid.fit(docs, F.col("doc_id") % 3 != 1)
    got = langid.predicted(docs, model).where("doc_id % 3 = 1").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.97
    d = {r["lang"]: r["text"] for r in docs.collect()}
    mix = [(1, d["en"] + " " + " ".join(d["de"].split()[:8])), (2, None), (3, " 12 ² !"), (4, ""), (5, d["de"] * 200)]
    out = {r["doc_id"]: r for r in langid.predicted(spark.createDataFrame(mix, "doc_id long, text string"), model).collect()}
    assert out[1]["lang_pred"] == "en" and 0.5 < out[1]["score"] < 1
    assert [out[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and out[2]["score"] == 0 and out[5]["lang_pred"] == "de"


def test_mixture_proportions_equal_plain_em():
    """The batched estimation against one document at a time, written out."""
    rnd = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], np.log(rnd.dirichlet(np.ones(langid.BUCKETS), 3).T).astype(np.float32))
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"], 30)) for _ in range(5)]
    for (lang, score), text in zip(langid.Predictor(model).predict(texts), texts):
        words, n = np.unique(langid.words(text), return_counts=True)
        logs = np.array([model.logs[langid.trigrams(w)].sum(axis=0) for w in words], float)

        def em(allowed, logs=logs, n=n):
            pi = np.where(allowed, 1 / sum(allowed), 0.0)
            like = np.exp(logs - logs.max(axis=1, keepdims=True))
            for _ in range(langid.STEPS):
                r = pi * like
                pi = (r / r.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            return pi, (n * (np.log((pi * like).sum(axis=1)) + logs.max(axis=1))).sum()

        order = np.argsort(-em([True] * 3)[0], kind="stable")
        fits = [em([i in order[:m] for i in range(3)]) for m in (1, 2, 3)]
        values = [ll - 0.5 * k * np.log(n.sum()) for k, (_, ll) in enumerate(fits)]
        pi = fits[int(np.argmax(values))][0]
        assert lang == model.languages[int(pi.argmax())] and score == pytest.approx(pi.max(), abs=1e-3)


def word_model(chances):
    """A model in which each word of one letter has these chances in the languages a, b, ..."""
    size = len(next(iter(chances.values())))
    logs = np.full((langid.BUCKETS, size), -9, np.float32)
    for word, p in chances.items():
        logs[langid.trigrams(word)[0]] = np.log(p)
    return langid.Model(list("abcdefgh")[:size], logs)


def test_four_languages_and_their_proportions(spark):
    model = word_model({w: [0.9 if i == k else 0.001 for i in range(5)] for k, w in enumerate("qrstu")})
    mix = " ".join(["q"] * 40 + ["r"] * 30 + ["s"] * 20 + ["t"] * 10)
    out = langid.predicted(spark.createDataFrame([(1, mix), (2, ""), (3, mix + " u" * 10)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert out[0]["languages"] == ["a", "b", "c", "d"] and out[0]["proportions"] == pytest.approx([0.4, 0.3, 0.2, 0.1], abs=1e-2)
    assert (out[0]["lang_pred"], out[0]["score"]) == ("a", out[0]["proportions"][0])
    assert out[1]["languages"] == out[1]["proportions"] == [] and len(out[2]["languages"]) == 5


def test_proportions_are_estimated_to_convergence():
    """1200 log(0.5 + p / 2) + 800 log(1 - p / 2) is largest at p = 0.8; eight steps come to 0.68."""
    found = langid.Predictor(word_model({"q": [1, 0.5], "r": [0.5, 1]})).mixtures(["q " * 1200 + "r " * 800])[0]
    assert found[2] == ["a", "b"] and found[1] == pytest.approx(0.8, abs=1e-3)


def test_language_without_training(spark, tables):
    docs, _ = tables
    model = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.predicted(docs, model).collect()} == {"und"}
    assert langid.predicted(docs.limit(0), model).count() == 0


# co-training


def test_co_training_scores_held_out_documents(spark, tables):
    docs, labels = tables
    got = cotraining.quality(docs, labels, F.col("doc_id") % 4 < 2, F.col("doc_id") % 4 == 3).join(labels, "doc_id").where("doc_id % 4 = 2")
    assert got.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_co_training_exchanges_pseudo_labels_both_ways(spark):
    """Junk shouts (words) and comes in very short lines (layout); some of it shows only one of the two."""
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(1600):
        words = ["".join(rnd.choice(["th", "er", "on", "an", "in", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
        junk = i % 3 == 0
        shout, short = (True, True) if junk and i % 4 else (junk and i % 8 == 0, junk and i % 8 == 4)
        words = [w.upper() + "!!" if shout else w for w in words]
        step = 2 if short else 20
        text = "\n".join(" ".join(words[k : k + step]) for k in range(0, 40, step))
        docs.append((i, text, "en", f"src{i % 5}", len(text)))
        labels.append((i, int(not junk), 0))
    vecs = cotraining.vectors(spark.createDataFrame(docs, DOCS)).cache()
    known = spark.createDataFrame(labels[:160], LABELS)
    parts = F.col("doc_id") % 4 < 2, F.col("doc_id") % 4 == 3
    none, full = (cotraining.co_train(vecs, known, *parts, rounds=n) for n in (0, 3))
    assert none.gained == [] and len(full.gained) == 3
    for view in ("text", "meta"):
        for label in (0, 1):
            assert sum(g[view, label] for g in full.gained) > 0, (view, label)
    p = {k: {r["doc_id"]: (r["p_text"], r["p_meta"]) for r in cotraining.scored(vecs, m).collect()} for k, m in (("none", none), ("full", full))}
    for side in (0, 1):
        assert max(abs(p["none"][i][side] - p["full"][i][side]) for i in range(1600)) > 0.01
    right = lambda m: sum((r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in cotraining.scored(vecs, m).collect() if r["doc_id"] >= 160) / 1440
    assert right(full) >= right(none) - 0.01 and right(full) > 0.95


def test_co_training_takes_ties_by_id_and_null_metadata(spark):
    """Equal vectors are one pseudo-label, of the smallest id; null metadata has a vector of its own."""
    docs = [(i, ("fine words here " if i % 2 else "JUNK!! JUNK!!\n") * 9, None, None, None) for i in range(200)]
    df = spark.createDataFrame(docs, DOCS)
    model = cotraining.co_train(cotraining.vectors(df), spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS), F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 == 2)
    assert model.gained[0] == {("meta", 1): 1, ("meta", 0): 1, ("text", 1): 1, ("text", 0): 1}
    assert set(model.gained[1].values()) == {0} and len(model.gained) == 2
    assert {(r["doc_id"] % 2, r["score"] > 0.5) for r in cotraining.scored(cotraining.vectors(df), model).collect()} == {(0, False), (1, True)}


def test_text_view_reads_whole_tokens():
    view, bare = cotraining.TextView(), -cotraining.SHARES + 3
    assert view.vector("!" * 8 + "word")[bare] == 0 and view.vector("!" * 80)[bare] == 1
    token = "ab1" * 30 + "-X" * 20
    at = crc32(cotraining.shape(token).encode()) % cotraining.SHAPES
    assert at != crc32(cotraining.shape(token[:64]).encode()) % cotraining.SHAPES
    assert view.vector(token)[1 + cotraining.WORDS + at] == 1 and token not in view.known


def test_co_training_edges(spark, tables):
    _, labels = tables
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (None, "x\n" * 3000, "en", "s", -4), (1, None, None, None, None)], DOCS)
    out = cotraining.quality(df, labels.limit(0), F.lit(True), F.lit(True)).collect()
    assert len(out) == 4 and {r["score"] for r in out} == {0.5}
    assert cotraining.quality(df.limit(0), labels, F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1).count() == 0


# chat


def render(turns):
    """All perspectives of one conversation, written out."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    out = {}
    for p in {s for _, s, _ in turns if s != "system"}:
        text, masks = "", []
        for _, s, t in turns:
            head = "<|assistant|>\n" if s == p else "<|system|>\n" if s == "system" else f"<|user name={s}|>\n"
            if s == p:
                masks.append((len(text) + len(head), len(text) + len(head) + len(t) + len("<|end|>")))
            text += head + t + "<|end|>\n"
        out[p] = (text, masks)
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_chat_perspectives(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rnd = random.Random(4)
    talk = [(c, t if t % 9 else None, rnd.choice(["system", "ann", "bob", "cé"]), rnd.choice(["", "hi", "ü\n", "long " * 50])) for c in (1, 2, None) for t in range(20)]
    talk += [(5, 0, "system", "only rules")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): (r["text"], [tuple(m) for m in r["masks"]]) for r in chat.examples(chat.segments(df)).collect()}
    want = {(c, p): v for c in (1, 2, None) for p, v in render([x[1:] for x in talk if x[0] == c]).items()}
    assert got == want
    for text, masks in got.values():
        assert all(text[a:b].endswith("<|end|>") for a, b in masks)


def test_chat_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, "a", "x"), (1, 1, "a", "x")], "conv_id long, turn long, role string, text string")
    got = {r["perspective"]: r["text"] for r in chat.examples(chat.segments(df)).collect()}
    assert got == {p: render([(0, "unknown", ""), (1, "a", "x"), (1, "a", "x")])[p][0] for p in ("a", "unknown")}
    assert chat.segments(df.limit(0)).count() == 0


# pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, labels = corpus(300, 5)
    docs = [d for d in docs if not d[0] % 7 == 1]
    passage = "\n".join(" ".join(f"p{k}{i}" for i in range(30)) for k in range(3))
    item = " ".join(f"b{i}" for i in range(20))
    near = " ".join(f"n{i}" for i in range(400))
    docs += [(1001, "one\n" + passage, "en", "s", 0), (1002, "two\n" + passage + "\ntail", "en", "s", 0), (1003, near, "en", "s", 0), (1004, near.replace("n7 ", "zz "), "en", "s", 0)]
    docs += [(1005, "some words before it and then " + item + " and words after it as well, more of them than there are of the other ones in the middle of it", "en", "s", 0), (1006, None, None, None, None), (1007, "", "en", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    x = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, sf)
        assert x.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"]: r["text"] for r in x.collect()})
        x = spark.createDataFrame(list(kept[-1].items()), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) as long) AS n_chars")
    clean = {d[0] for d in docs if d[0] < 1000 and d[0] % 5}
    assert not {d for d in kept[0] if d < 1000 and d % 5 == 0} and clean <= set(kept[0])
    assert kept[1][1001] == "one\n" + passage and kept[1][1002] == "two\ntail" and clean <= set(kept[1])
    assert 1003 in kept[2] and 1004 not in kept[2] and clean <= set(kept[2])
    assert 1006 in kept[2] and 1007 not in kept[2]  # both blank: one stays
    assert "b3" not in kept[3][1005] and kept[3][1005].startswith("some words before it") and clean <= set(kept[3])
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(kept[3]) and out[1006] == []


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_sql_agrees_on_the_small_tables(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        want = sorted(c.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=str)
        assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == want, name


def test_operators_take_empty_documents(spark):
    df = spark.createDataFrame([], DOCS)
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(df, b).count() == line_dedup.line_dedup(df).count() == simhash.keep_one(df).count() == 0
