"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Four strict patterns with validators give the base spans. Looser generators
propose candidates that may overlap each other and the base spans. Gradient
boosted trees, which see a candidate's format and its surroundings but no
validator, are fitted on half of all candidates, equal ones as one row with their number
as its weight. Their labels are the base spans and,
for what overlaps none, rules of each kind's own (a word that announces it with
a format that suits it, a written-out at sign, a known prefix). Only candidates
that overlap no base span can be added, so the threshold of each generator is
calibrated on all of those in the half that the trees have not seen. Candidates
above it are added to the base spans.

All of it is Spark expressions and ``pyspark.ml``: no Python runs on executors.
The texts are read once; what follows works on the few rows that hold a span
or a candidate.

Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import keyed_text, staged

#: Base kinds in the order in which they are listed; ``secret`` spans come from candidates only.
KINDS = ("email", "ip", "card", "phone")
#: The same languages as the plain patterns; possessive, so that long texts need no deep stack, and
#: tied to the start of a run, so that a run that fails is tried once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Loose generators of candidates; those of secrets reach the end of the run, however long.
GENERATORS = {
    "mail": r"(?<![^\s<>\"'(),;])[^\s@<>\"'(),;]++(?: ?@ ?| ?\((?:at|AT)\) ?)[^\s@<>\"'(),;]++(?: ?\((?:dot|DOT)\) ?[^\s@<>\"'(),;]++)*+",
    "digits": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,}+",
    "assigned": r"(?i)\b(?:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}+",
    "token": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_-])",
}
#: Words that announce what follows them, in the 24 characters before a candidate.
CUES = r"(?i)(tel|phone|fax|mail|card|iban|ip|addr|pass|token|secret|key|ssn|id)\W{0,4}$"
#: Words that announce a kind, before a candidate, and those that announce a secret or are part of one.
SAYS = {
    "phone": r"(?i)\b(tel|phone|telephone|call|fax|mobile|cell)(\s(me|us))?(\s(at|on))?\W{0,4}$",
    "card": r"(?i)\b(card|visa|mastercard|amex|account|iban)(\s(no|number))?\W{0,4}$",
    "ip": r"(?i)\b(ip|host|server|address)\W{0,4}$",
    "email": r"(?i)\b(mail|e-mail|email|contact|write|reach)(\s(me|us|to|at))*\W{0,4}$",
    "secret": r"(?i)(password|token|secret|key)\s{0,3}[=:]\s{0,3}[\"']?$",
}
SECRET = r"(?i)^(AKIA|ghp_|sk-|password|token|secret|api.?key)"
#: Precision that a threshold must keep on the calibration half.
PRECISION = 0.95
_BINS = 50
#: Matches whose places are summed up in one chunk.
_RUN = 256

SPAN = "array<struct<s:int,e:int,kind:string>>"


def _let(x: Column, f) -> Column:
    """f of x, which is evaluated once."""
    return F.transform(F.array(x), f)[0]


def _found(text: Column, pattern: str) -> Column:
    """Non-overlapping matches as array<struct<s,e,m>>, from the pieces between them.

    Ends are running sums of lengths. They are taken in chunks, then over the
    chunks, so that a text of very many matches does not copy a growing array
    for each of them.
    """
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "array<struct<s:int,e:int,m:string>>"

    def add(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["g"])
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m"))).alias("out"))

    def chunks(pairs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        number = F.sequence(F.lit(0), F.floor((F.greatest(F.size(pairs), F.lit(1)) - 1) / _RUN).cast("int"))
        return F.transform(number, lambda b: F.aggregate(F.slice(pairs, b * _RUN + 1, F.lit(_RUN)), start, add))

    def shift(acc: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m")))
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    pairs = F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("g")))
    return _let(pairs, lambda p: F.when(F.size(p) == 0, F.array().cast(kind)).otherwise(F.flatten(F.aggregate(chunks(p), start, shift, lambda acc: acc["out"]))))


def _luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = ((n - i) % 2) == 1
        return F.when(double & (d > 4), 2 * d - 9).when(double, 2 * d).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str):
    return lambda x: _passes(kind, x["m"])


def _numbered(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {
        "email": F.contains(text, F.lit("@")),
        "phone": F.contains(text, F.lit("+")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
        "mail": F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("(AT)")),
        "digits": text.rlike(r"[0-9][ ()./-]{0,2}[0-9][ ()./-]{0,2}[0-9][ ()./-]{0,2}[0-9]"),
        "assigned": text.rlike(r"[=:]"),
        "token": text.rlike(r"[0-9]"),
    }[kind]


def base_spans(text: Column) -> Column:
    """Validated spans of the strict patterns, by start, then kind as listed."""
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    parts = []
    for k, kind in enumerate(KINDS):
        ok = F.filter(_found(text, PATTERNS[kind]), _valid(kind))
        parts.append(F.when(_hint(kind, text), F.transform(ok, _numbered(k))).otherwise(none))
    names = F.array(*map(F.lit, KINDS))
    return F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["k"] + 1).alias("kind")))


def _surrounded(text: Column, gen: str):
    return lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(gen).alias("gen"),
        F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))).alias("before"),
        F.substring(text, x["e"] + 1, F.lit(8)).alias("after"),
    )


def candidates(text: Column) -> Column:
    """Spans of the loose generators with the characters around them."""
    none = F.array().cast("array<struct<s:int,e:int,m:string,gen:string,before:string,after:string>>")
    parts = []
    for gen, pattern in GENERATORS.items():
        found = F.transform(_found(text, pattern), _surrounded(text, gen))
        if gen == "digits":  # not the digits that a word begins with
            found = F.filter(found, lambda x: ~x["after"].rlike("^[0-9A-Za-z]"))
        parts.append(F.when(_hint(gen, text), found).otherwise(none))
    return F.concat(*parts)


def _count(m: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{keep}]", "")).cast("double")


def _features(m: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.length(m).cast("double")
    is_ = lambda c: c.cast("double")
    return {
        "length": n,
        "digits": _count(m, "0-9"),
        "upper": _count(m, "A-Z"),
        "lower": _count(m, "a-z"),
        "dots": _count(m, "."),
        "dashes": _count(m, "-"),
        "spaces": _count(m, r"\s"),
        "at": _count(m, "@"),
        "digit_share": _count(m, "0-9") / F.greatest(n, F.lit(1.0)),
        "turns": F.length(F.regexp_replace(m, "[0-9]+", "0")).cast("double") / F.greatest(n, F.lit(1.0)),
        "hex": is_(m.rlike("^[0-9a-f]+$")),
        "plus": is_(m.startswith("+")),
        "domain": is_(m.rlike(r"\.[A-Za-z]{2,8}$")),
        "cue": is_(before.rlike(CUES)),
        **{f"says_{k}": is_(before.rlike(v)) for k, v in SAYS.items()},
        "written_at": is_(m.rlike(r"(?i)\(at\)")),
        "prefix": is_(m.rlike(SECRET)),
        "before_space": is_(before.rlike(r"(^|\s)$")),
        "before_mark": is_(before.rlike(r"[=:]\s?[\"']?$")),
        "after_space": is_(after.rlike(r"^(\s|$|[.,;])")),
    }


def _announced(gen: Column, m: Column, before: Column) -> Column:
    """The label of a candidate that overlaps no base span: rules of the kinds, none of which is a base pattern."""
    digits, dots = F.length(F.regexp_replace(m, "[^0-9]", "")), F.length(F.regexp_replace(m, "[^.]", ""))
    domain = m.rlike(r"(?i)(\.|\(dot\) ?)[a-z]{2,8}\.?$")
    says = {k: before.rlike(v) for k, v in SAYS.items()}
    mail = domain & (m.rlike(r"(?i)\(at\)") | says["email"])
    number = (says["phone"] & digits.between(7, 15)) | (says["card"] & digits.between(12, 19)) | (says["ip"] & (dots == 3))
    return F.when(gen == "mail", mail).when(gen == "digits", number).otherwise(says["secret"] | m.rlike(SECRET))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, h (digest of the text), base spans and candidates; the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return keyed_text(docs).select("doc_id", F.xxhash64(text).alias("h"), base_spans(text).alias("base"), candidates(text).alias("cand"))


def _scored(cand: DataFrame) -> DataFrame | None:
    """Candidates with the trees' score, or None if they cannot train any."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [c for c in cand.columns if c.startswith("f_")]
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    cand = cand.withColumn("half", F.pmod(F.xxhash64("h", "e", "gen"), F.lit(2)))
    split = {(r["half"], r["label"]) for r in cand.select("half", "label").distinct().collect()}
    if len(split) < 4:
        return None
    rows = staged(cand.where("half = 0").groupBy("label", *names).agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii-rows")
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(vectors.transform(rows))
    score = vector_to_array("probability")[1]
    cand = vectors.transform(cand)
    held = model.transform(cand.where("half = 1 and not hit")).select("gen", "label", F.floor(score * (_BINS - 1e-9)).cast("int").alias("bin"))
    bins = held.groupBy("gen", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    cut: dict[str, float] = {}
    by_gen: dict[str, list] = {}
    for r in bins.collect():  # at most _BINS rows for each generator
        by_gen.setdefault(r["gen"], []).append((r["bin"], r["n"], r["good"]))
    for gen, rows in by_gen.items():
        n = good = 0
        for b, k, g in sorted(rows, reverse=True):
            n, good = n + k, good + g
            if good >= PRECISION * n:
                cut[gen] = b / _BINS
    limit = F.coalesce(*[F.when(F.col("gen") == g, F.lit(c)) for g, c in cut.items()], F.lit(2.0))
    return model.transform(cand.where("not hit")).select("doc_id", "h", "s", "e", "m", "gen", "card", score.alias("score")).where(F.col("score") >= limit)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, h, ``base`` and ``spans`` (base and added ones) of every document, as array<struct<s,e,kind>>.

    A null text counts as empty and has no spans; repeated rows each give a
    row, rows that share a doc_id but not the text are kept apart by the
    text's digest; other columns are ignored; an empty table gives an empty
    result. A text's length is not limited.
    """
    scanned = staged(scan(docs), "pii-scan")
    each = scanned.where(F.size("cand") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "base", F.explode("cand").alias("c")).select("doc_id", "h", "base", "c.*")
    hit = F.exists("base", lambda b: (b["s"] < F.col("e")) & (b["e"] > F.col("s")))
    given = (F.col("m"), F.col("before"))
    label = hit | _announced(F.col("gen"), *given)
    each = each.select("doc_id", "h", "s", "e", "m", "gen", hit.alias("hit"), label.cast("double").alias("label"), F.col("before").rlike(SAYS["card"]).alias("card"), *[v.alias(f"f_{k}") for k, v in _features(*given, F.col("after")).items()])
    each = staged(each, "pii-candidates")
    chosen = _scored(each)
    if chosen is None:
        return scanned.select("doc_id", "h", "base", F.col("base").alias("spans"))
    digits, dots = F.length(F.regexp_replace("m", "[^0-9]", "")), F.length(F.regexp_replace("m", "[^.]", ""))
    kind = (
        F.when(F.col("gen") == "mail", "email").when(F.col("gen") != "digits", "secret").when(dots == 3, "ip")
        .when((digits >= 12) & (F.col("card") | ~F.col("m").startswith("+")), "card").otherwise("phone")
    )
    added = chosen.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("s", "e", kind.alias("kind")))).alias("more"))
    added = added.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "more")
    joined = scanned.join(added, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    more = F.coalesce(F.col("more"), F.array().cast(SPAN))
    free = F.filter(more, lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    joined = joined.withColumn("free", free)
    inside = lambda x, y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & ((y["e"] - y["s"]) > (x["e"] - x["s"]))
    free = F.filter("free", lambda x: ~F.exists(F.col("free"), lambda y: inside(x, y)))
    return joined.select("doc_id", "h", "base", F.when(F.size("free") == 0, F.col("base")).otherwise(_ordered(F.concat("base", free))).alias("spans"))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.array(*map(F.lit, (*KINDS, "secret")))
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.array_position(rank, x["kind"]).alias("r"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def counted(found: DataFrame) -> DataFrame:
    """The result of :func:`find` with a count of base spans for each kind."""
    of = lambda k: lambda x: x["kind"] == k
    n = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The table with each span of ``text`` replaced by its kind in brackets, as ``[EMAIL]``; all columns stay.

    Spans that overlap are replaced together, under the kind of the first.
    Texts without spans, null ones included, stay as they are.
    """
    spans = find(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    joined = whole.join(spans, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("_spans", start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    return joined.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
