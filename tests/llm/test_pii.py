import hashlib
import random
import re

import pytest

from pulsegrid.llm import pii

PATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def texts():
    rnd = random.Random(3)
    out = [None, "", "a@b.cc@d.ee", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.255 000.00255.1.1", "+1 (644) 555-7859.", "é😀 4111 1111 1111 1111 x",
           "4111111111111111" * 3, "1 " * 3000, "1" * 20000, "a." * 5000 + "@b.c", "x@" + "a." * 3000 + "b", "same a@b.cd", "same a@b.cd", "+12345678 +123456789 +1234567890123456"]
    for _ in range(300):
        out.append("".join(rnd.choice(["1", "4", "23", "@", ".", "-", " ", "a", "+", "(", ")", "é", "4111111111111111", "10.0.0.1", "b.c", "_"]) for _ in range(rnd.randint(1, 60))))
    return out


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, h int")
    found = pii.find(docs)
    got = {r.doc_id: r for r in found.select("doc_id", pii.listed(found["base"]).alias("b"), pii.listed(found["spans"]).alias("a")).collect()}
    for i, t, *_ in rows:
        want = brute(t or "")
        assert got[i].b == want, t
        assert set(filter(None, want.split(","))) <= set(got[i].a.split(","))
    digest = {r.doc_id: r for r in pii.counted(found).collect()}
    assert digest[2].base_sha256 == hashlib.sha256(brute(rows[2][1]).encode()).hexdigest() and digest[2].n_email == 1
    assert pii.find(docs.limit(0)).count() == 0


def test_trees_add_secrets_and_redaction_keeps_the_rest(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        key = "".join(rnd.choice("0123456789abcdef") for _ in range(32))
        kind = i % 4
        pii_text = [f'token = "{key}"', f"mail bob.{i}@host{i % 7}.example.com", f"call +1 (212) 555-{1000 + i}", f"see lot-number-{i}-of-warehouse and 20{i:06d}"][kind]
        rows.append((i, f"some words before {pii_text} and some words after", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    secrets = [i for i in range(0, 400, 4) if "[SECRET]" in clean[i]]
    assert len(secrets) > 80
    assert all("[EMAIL]" in clean[i] for i in range(1, 400, 4)) and all("[PHONE]" in clean[i] for i in range(2, 400, 4))
    assert all(clean[i] == rows[i][1] for i in range(3, 400, 4))
    assert pii.redact(docs).columns == docs.columns


@pytest.mark.parametrize("bad", ["Thing", ""])
def test_table_without_candidates(spark, bad):
    docs = spark.createDataFrame([(1, bad), (1, bad), (None, None)], "doc_id long, text string")
    assert pii.find(docs).count() == 3 and pii.redact(docs).count() == 3


def test_long_secrets_are_covered_to_their_end(spark):
    rnd = random.Random(6)
    key = lambda n: "".join(rnd.choice("abcdef0123456789") for _ in range(n))
    late = "x" * 100 + key(200) + "7"  # no digit in the first 64 characters
    texts = [f"token={key(300)}", f"see {key(300)} there", f"see {late} there", f"secret: {key(100_000)} there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in docs.select("text", pii.candidates(docs.text).alias("c")).collect():
        ends = {c.e for c in r.c if c.gen in ("assigned", "token")}
        assert len(r.text.removesuffix(" there")) in ends, r.text[:40]
    rows = [(i, f"before token={key(300 if i % 2 else 40)} after" if i % 4 < 2 else f"before lot-number-{i}-of-warehouse after") for i in range(400)]
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i in range(1, 400, 4) if "[SECRET]" in clean[i]]
    assert len(found) > 80 and all(re.fullmatch(r"before (token=)?\[SECRET\] after", clean[i]) for i in found)


def test_each_generator_adds_what_the_base_misses_and_leaves_look_alikes(spark):
    rnd = random.Random(9)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    planted = {
        "email": lambda i: f"jane{i} (at) host{i % 9}.example.com",
        "phone": lambda i: f"555-{100 + i % 800}-{4000 + i}",
        "card": lambda i: f"4111 1111 1111 {1000 + i}",
        "secret": lambda i: hexes(32),
    }
    announced = {"email": "mail me at ", "phone": "tel ", "card": "card number ", "secret": "token = "}
    rows, want, alike = [], {}, {}
    for i in range(1200):
        kind = list(planted)[i % 4]
        if i % 3:
            span = planted[kind](i)
            rows.append((i, f"some words before {announced[kind]}{span} and some words after"))
            if span not in brute(rows[-1][1]):
                want[i] = (kind, span)
        else:
            span = [f"lot-{i}-of-warehouse-{i % 7}", f"pages 100-200/3{i:05d}", f"order 7{i:011d}", f"meet (at) noon{i}"][i // 3 % 4]
            rows.append((i, f"some words before {span} and some words after"))
            alike[i] = span
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    text = dict(rows)
    extra = lambda i: [(x.kind, text[i][x.s : x.e]) for x in got[i].spans if x not in got[i].base]
    right = {k: 0 for k in planted}
    total = dict(right)
    for i, (kind, span) in want.items():
        if base := [x for x in got[i].base if text[i].find(span) < x.e and x.s < text[i].find(span) + len(span)]:
            assert base[0].kind in planted
            continue
        total[kind] += 1
        right[kind] += any(k == kind and span in s for k, s in extra(i))
    assert all(total[k] > 100 and right[k] >= 0.9 * total[k] for k in planted), (right, total)
    wrong = sum(bool(extra(i)) for i in alike)
    assert wrong <= 0.05 * (wrong + sum(right.values()))


def test_places_of_very_many_matches(spark):
    text = "é a@b.cd 1.2.3.4, " * 3000
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed(pii.F.col("base")).alias("b")).first()
    assert r.b == brute(text) and r.b.count(",") == 5999


def test_trees_and_thresholds_come_from_all_candidates(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    seen = {}
    fit = GBTClassifier.fit

    def fitted(self, rows, *a):
        seen["fitted"] = rows.agg({"weight": "sum"}).first()[0]
        return fit(self, rows, *a)

    monkeypatch.setattr(GBTClassifier, "fit", fitted)
    n = 60_000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN concat('reach me at a', id, '@b.com') ELSE concat('order 12345', id % 1000, '67890 today') END AS text")
    found = pii.find(docs)
    assert found.count() == n and 0.45 * n < seen["fitted"] < 0.55 * n, "half of all candidates, beyond any sample of 20,000"
