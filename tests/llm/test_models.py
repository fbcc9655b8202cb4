import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, quality

WORDS = {"en": "the and of with that this from house water school time".split(), "de": "der und die mit nicht schule wasser haus zeit über".split(), "fr": "le et de avec maison école temps être où garçon".split(), "es": "el y de con casa escuela tiempo señor niño agua".split()}


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang))
    return rows


def test_languages(spark):
    rows = texts(240) + [(1000, None, "en"), (1001, "123 !?", "en"), (1002, "the and of", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    held = F.col("doc_id") % 3 == 1
    got = {r["doc_id"]: r for r in langid.identify(df, langid.train(df.where(~held), rows=150), held).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[:240] if i % 3 == 1]) > 0.97
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0 and got[1002]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(df.limit(0)) is None
    assert langid.identify(df, None, held).where("lang_pred <> 'und'").isEmpty()


def test_letters_are_what_unicode_calls_letters(spark):
    texts = ["½ ²", "①②", "Ⅷ 7", "x²", "ß", "мир", "中", "ª", "__ 12", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    model = langid.fit([("xx", np.eye(1, langid.FEATURES, dtype=np.float32)[0])])
    rows = langid.identify(df, model, F.lit(False)).collect()
    plain = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    assert len(rows) == 2 * len(texts) and all((r["lang_pred"] == "xx") == plain(texts[r["doc_id"]]) for r in rows)
    assert langid.identify(df.limit(0), model, F.lit(False)).count() == 0


def test_prediction_against_plain_votes():
    """All comparisons of a family, counted one by one, and features of a long text that is hashed in segments."""
    rng = np.random.default_rng(3)
    rows = [(lang, v / np.linalg.norm(v)) for k, lang in enumerate(["de", "en", "es", "fr", "nl"]) for v in (rng.random((12, langid.FEATURES)) * (np.arange(langid.FEATURES) % 5 <= k)).astype(np.float32)]
    model = langid.fit(rows)
    for _, x in rows[::7]:
        family = model.families[int(np.argmax([x @ w + b for w, b in model.family_machines]))] if len(model.families) > 1 else model.families[0]
        votes = {a: sum(x @ model.machines[a, b][0] + model.machines[a, b][1] > 0 if (a, b) in model.machines else x @ model.machines[b, a][0] + model.machines[b, a][1] < 0 for b in family if b != a) for a in family}
        assert votes[model.predict(x)[0]] == max(votes.values())


def test_features_of_a_long_text_in_segments(monkeypatch):
    text = "Ein langer Text, été, und noch ein Wort. " * 40
    whole = langid.features(text)
    monkeypatch.setattr(langid, "SEGMENT", 101)
    assert np.allclose(whole, langid.features(text), atol=1e-6)


def test_one_language_and_unknown_family():
    x = np.eye(4, langid.FEATURES, dtype=np.float32)
    assert langid.fit([("xx", x[0])]).predict(x[1])[0] == "xx"
    model = langid.fit([("xx", x[0]), ("en", x[1]), ("de", x[2])])
    assert [model.predict(x[i])[0] for i in range(3)] == ["xx", "en", "de"]


def test_features_are_the_same_in_parts(monkeypatch):
    text = "Der schnelle braune Fuchs, über 12 Zäune! " * 9
    whole = langid.features(text)
    monkeypatch.setattr(langid, "SEGMENT", 50)
    assert np.allclose(langid.features(text), whole) and langid.features("123") is None


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(sum(WORDS.values(), [])) for _ in range(60)).capitalize() + "."
    bad = lambda: rng.choice([" | ".join(rng.choice(WORDS["en"]) for _ in range(40)), "$$$ ".join(rng.choice(WORDS["de"]) for _ in range(40)), "buy buy now " * 20])
    rows = [(i, bad() if i % 4 == 0 else good(), "s") for i in range(800)]
    docs = spark.createDataFrame(rows + [(9000, None, "s"), (9001, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(800)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, F.col("doc_id") % 5 == 0).collect()}
    held = [i for i in range(800) if i % 5 == 0]
    assert len(got) == 802 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert np.mean([got[i]["predicted"] == (i % 4 != 0) for i in held]) > 0.95
    none = quality.classify(docs, labels.limit(0), F.lit(False)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.lit(False)).count() == 0


def test_quality_features():
    assert not quality.features(b"").any() and not quality.features(b" \n").any()
    f = dict(zip(quality.NAMES, quality.features(b"AB ab\nab 1|")))
    assert f["upper"] == pytest.approx(2 / 11) and f["distinct_words"] == pytest.approx(3 / 4) and f["pipes"] == pytest.approx(1 / 11)


def test_risk_is_kept_from_going_negative():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (200, 3)), np.concatenate((rng.normal(1, 1, (300, 3)), rng.normal(-3, 1, (100, 3))))
    s = quality.fit(p, u, 0.75, epochs=120).scores(u)
    assert (s[:300] > 0.5).mean() > 0.95 and (s[300:] < 0.5).mean() > 0.95
