import duckdb
from pyspark.sql import functions as F

from pulsegrid.llm import quality
from pulsegrid.llm._common import words


def brute_repeat(ws, k=8):
    seen = {}
    for i in range(len(ws) - k + 1):
        seen.setdefault(tuple(ws[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_features_against_brute_force():
    a = "one two three four five six seven eight nine ten"
    for text in ["", a, f"{a} {a}", "x " * 30, f"{a}\n{a}\n\n \n{a} z\n{a}", "# * $", "a b\x0bc d"]:
        n, chars, symbols, lines, again, rep = quality.features_of(text)
        ws = words(text)
        assert (n, chars, rep) == (len(ws), sum(map(len, ws)), brute_repeat(ws))
        full = [x for x in text.split("\n") if words(x)]
        assert (lines, again) == (len(full), len(full) - len(set(full)))
    assert quality.features_of(None) == (0,) * 6


def test_host_verdicts_reach_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    weak = good + "\n" + "\n".join(["again"] * 4 + ["some", "more", "lines", "here"])
    rows = [(i, good, "good.example", 1, 0) for i in range(30)] + [(100 + i, weak, "bad.example", 1, 0) for i in range(30)]
    rows += [(200, good, "bad.example", 1, 0), (201, weak, "good.example", 1, 0), (202, None, None, 0, 0), (203, "", "good.example", 0, 0), (0, good, "good.example", 1, 0), (None, good, None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host int, rate int")
    out = quality.verdicts(docs, "source").collect()
    got = {}
    for r in out:
        got.setdefault(r.row.doc_id, []).append(r.kept)
    assert len(out) == len(rows) and got[0] == [True, True]
    assert not any(got[100 + i][0] for i in range(30)), "one point is enough on a bad host"
    assert got[201] == [True] and got[200] == [True]
    assert got[202] == [False] and got[203] == [False] and got[None] == [True]
    assert quality.verdicts(docs.limit(0), "source").count() == 0
    assert quality.verdicts(docs.drop("source"), "source").count() == len(rows)


def test_a_planted_host_changes_verdicts_as_the_sql_says(spark, tmp_path):
    """One host of the corpus gets the documents with a point, and a share of its own; nineteen stay as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.verdicts(docs, "source", ["doc_id"])
    weak = judged.where("points > 0 and not base_failed").select(F.col("row.doc_id").alias("d"))
    moved = docs.join(weak, docs.doc_id == weak.d, "left").withColumn("source", F.when(F.col("d").isNotNull(), F.lit("bad.example")).otherwise(F.col("source"))).drop("d")
    moved.write.parquet(str(tmp_path / "documents.parquet"))
    moved = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = {r.d: r for r in quality.verdicts(moved, "source", ["doc_id"]).select(F.col("row.doc_id").alias("d"), "kept", "bad", "points", "base_failed").collect()}
    turned = [r for r in got.values() if r.points == 1 and not r.base_failed]
    assert turned and all(r.bad and not r.kept for r in turned), "one point is enough on the bad host"
    assert {r.bad for r in got.values() if not r.points} == {False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[7] for r in con.execute(quality.SQL).fetchall()}
    assert {d: r.kept for d, r in got.items()} == want


def test_equal_hosts_are_not_bad_and_a_small_bad_one_needs_evidence(spark):
    good = " ".join(f"word{i}" for i in range(60))
    weak = good + "\n" + "\n".join(["again"] * 4 + ["some", "more", "lines", "here"])
    rows = [(100 * h + i, weak if i % 10 == 0 else good, f"h{h}") for h in range(20) for i in range(100)]
    bad = lambda extra: {r.host for r in quality.verdicts(spark.createDataFrame(rows + extra, "doc_id long, text string, source string"), "source", ["doc_id"]).where("bad").select("host").distinct().collect()}
    assert bad([]) == set()
    assert bad([(9000 + i, weak if i % 3 else good, "planted") for i in range(90)]) == {"planted"}
    assert bad([(9000, weak, "one document")]) == set()


def test_very_long_texts_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i " * 100_000, "x", 3), (2, "word" * 500_000, "x", 4)], "doc_id long, text string, source string, n_words int")
    got = {r.row.doc_id: r for r in quality.verdicts(docs, "source").collect()}
    assert got[1].n_words == 900_000 and got[1].n_repeat_words == 900_000 and got[1].base_failed and got[1].row.n_words == 3
    assert got[2].n_words == 1 and got[2].word_chars == 2_000_000
