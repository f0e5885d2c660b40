import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import language
from pulsegrid.llm._common import crc_mod

import zlib


def test_held_out_accuracy_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, crc_mod(5) == 0).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert out.score.between(0, 1).all() and out.rejected.mean() < 0.05


def test_odd_rows(spark):
    rows = [(i, "the and of to in is that", "en", "x", 0.5) for i in range(40)] + [(100 + i, "der die und das ist nicht", "de", "x", 0.5) for i in range(40)]
    rows += [(200, None, "en", "x", 0.0), (201, "", "en", "x", 0.0), (202, "12 34 !!", "en", "x", 0.0), (203, "the und of das" * 50_000, None, "x", 0.0), (None, "the of", "en", "x", 0.0), (0, "the and of to in is that", "en", "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = language.identify(docs, crc_mod(5) == 0).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[200].score == 0
    assert got[203].lang_pred in ("en", "de") and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == ("en" if i < 100 else "de") for i in [*range(40), *range(100, 140)])
    assert language.identify(docs.limit(0), crc_mod(5) == 0).count() == 0
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), crc_mod(5) == 0)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_centroids_of_few_rows():
    assert language.centroids(np.eye(2, 8, dtype=np.float32)).shape == (2, 8)


def plain_counts(text):
    raw = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in (" " + (text or "").lower() + " ").encode())
    out = {}
    for n, f in ((2, 2654435761), (3, 2246822519)):
        for i in range(len(raw) - n + 1):
            at = (int.from_bytes(raw[i : i + n], "big") * f % 2**32) >> (32 - 12)
            out[at] = out.get(at, 0) + 1
    return out


def test_predictions_equal_a_plain_version(spark):
    rnd = np.random.default_rng(3)
    words = {"en": "the and of to in is that with for was".split(), "de": "der die und das ist nicht mit für war ein".split(), "fr": "le la les et des est que dans pour été".split()}
    rows = [(i, " ".join(rnd.choice(words[lang], 12)), lang) for i, lang in enumerate(list(words) * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 5]
    model = language.fit(docs.where(crc_mod(5) != 0).withColumn("at", F.lit(0.0)))
    held = [plain_counts(t) for t, _ in train]
    idf = [np.log((1 + len(train)) / (1 + sum(f in c for c in held))) + 1 for f in range(language.DIMENSIONS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)

    def vector(text):
        v = np.zeros(language.DIMENSIONS)
        for f, n in plain_counts(text).items():
            v[f] = np.log(1 + n) * idf[f]
        return v / np.sqrt((v * v).sum())

    # each centroid is the direction of the texts of its language that lie nearest to it
    for lang in words:
        mine = [c for c, name in zip(model.centres, model.languages, strict=True) if name == lang]
        assert 1 <= len(mine) <= language.CENTROIDS
        x = np.stack([vector(t) for t, name in train if name == lang])
        near = (x @ np.stack(mine).T).argmax(axis=1)
        for j, c in enumerate(mine):
            mean = x[near == j].mean(axis=0)
            assert np.dot(mean / np.linalg.norm(mean), c) > 0.9999
    for r in language.identify(docs, crc_mod(5) == 0).collect():
        cos = [float(vector(rows[r.doc_id][1]) @ c) for c in model.centres]
        assert r.lang_pred == model.languages[int(np.argmax(cos))] and abs(r.score - max(cos)) < 1e-4
