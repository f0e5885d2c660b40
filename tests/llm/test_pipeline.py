import re

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from pulsegrid.llm import decontaminate, quality  # noqa: E402
from pulsegrid.llm._common import documents, staged, table  # noqa: E402
from tests.llm.test_pii import brute as base_spans  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_print  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_version(spark):
    docs = documents(spark, SF)
    kinds = docs.dtypes
    plain = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    order = list(stages)

    docs = staged(stages[order[0]](spark, docs, SF), "t")
    assert docs.dtypes == kinds
    ok = {}
    for d, t in plain.items():
        n, chars, symbols, lines, again, rep = quality.features_of(t)
        points = (10 * symbols > n) + (20 * symbols > n) + (2 * again > lines) + (10 * again > 3 * lines) + (chars < 2 * n or chars > 12 * n) + (chars > 20 * n)
        if n >= 20 and 100 * rep <= 30 * n and points < 2:
            ok[d] = t
    assert {r.doc_id for r in docs.collect()} == set(ok), "no host of this table is bad"

    docs = staged(stages[order[1]](spark, docs, SF), "t")
    assert docs.dtypes == kinds
    ids = sorted(ok)
    roots = brute_components([brute_print(ok[d]) for d in ids])
    one = {ids[i] for i in set(roots)}
    assert sorted(r.doc_id for r in docs.collect()) == sorted(one)

    docs = staged(stages[order[2]](spark, docs, SF), "t")
    assert docs.dtypes == kinds
    bench = [decontaminate.terms(r.text) for r in table(spark, SF, "benchmark").collect()]
    def holds(t):
        ws = decontaminate.terms(t)
        return any(ws[i : i + len(b)] == b for b in bench for i in range(len(ws) - len(b) + 1))
    left = {r.doc_id for r in docs.collect()}
    assert left == {d for d in one if not holds(ok[d])}

    docs = staged(stages[order[3]](spark, docs, SF), "t")
    assert docs.dtypes == kinds
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert set(clean) == left
    for d, t in clean.items():
        spans = [s.split(":") for s in base_spans(ok[d]).split(",") if s]
        for kind, a, b in spans:
            assert ok[d][int(a) : int(b)] not in t or ok[d].count(ok[d][int(a) : int(b)]) > 1
        if not re.search(r"[0-9@]", ok[d]):
            assert t == ok[d]

    out = {r.doc_id: r for r in stages[order[4]](spark, docs, SF).collect()}
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert set(out) == set(clean)
    for d, t in clean.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert out[d].ids == ids and out[d].decoded == lib.decode(ids, skip_special_tokens=False)


def _folder(spark, path, rows, ddl="doc_id long, text string, lang string, source string, n_chars int, row string, h long, kept boolean"):
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(str(path / "documents.parquet"))
    bench = [(1, "the quick benchmark question asks how many brown foxes jump over seven lazy dogs before noon on the longest day of summer")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_run_on_odd_rows(spark, tmp_path):
    prose = lambda k: " ".join(f"word{(i * k) % 97}x{k}" for i in range(60)) + "."
    leak = prose(5) + " the quick benchmark question asks how many brown foxes jump over seven lazy dogs before noon on the longest day of summer " + prose(11)
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, prose(3)), (1, prose(3)), (2, prose(3)), (3, None), (4, ""), (5, leak), (6, prose(7) + " write to jane.doe@example.com"), (None, prose(13)), (None, None), (8, long), (9, "too short")]
    sf = _folder(spark, tmp_path, [(d, t, "en", "a.example", len(t or ""), "clash", 1, True) for d, t in rows])
    out = corpus_pipeline.run(spark, sf).collect()
    got = {r.doc_id: r for r in out}
    assert sorted(map(str, (r.doc_id for r in out))) == ["1", "6", "8", "None"]
    assert "email</w> ]" in got[6].decoded and "jane" not in got[6].decoded
    assert got[8].n_tokens == len(got[8].ids) > 150_000
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert got[1].ids == lib.encode(prose(3), add_special_tokens=False).ids


def test_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, [])).count() == 0
