"""Personal data: base patterns, and boosted trees over what high-recall generators propose.

Generators propose overlapping candidate spans; format and context features of a candidate go through
gradient-boosted trees, trained here on a labelled sample; the score is calibrated on a held-out part
and the redaction threshold is the lowest score that keeps the wanted precision there. Base spans always
stay; a candidate that overlaps one is dropped. Native: DataFrame functions only (the trees are fitted on
the driver from counts of distinct feature vectors of the bounded sample).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import spans as S
from cladeframe.llm.common import fresh, need

KINDS = ("email", "ip", "card", "phone", "model")

#: A match that starts a run of its class, or at the end of the last match, is the leftmost one; possessive
#: repeats keep the search linear on long runs and change no match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DIGIT = "[0-9]"

GENERATORS = (
    ("handle", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,40}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)[A-Za-z]{2,10}){1,3}"),
    ("dialled", r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    ("identity", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("digits", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){8,22}(?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("colons", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
)
#: A text without any of these has no candidate.
WORTH = r"[0-9]|(?i:\(at\)|\[at\]|\x20at\x20)"
CONTEXT = 32
CUES = (
    r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|dial)\b",
    r"(?i)\b(?:card|visa|mastercard|account|iban|bank|credit|debit)\b",
    r"(?i)\b(?:ssn|social|security|passport|identity|tax|insurance)\b",
    r"(?i)\b(?:mail|email|e-mail|contact|write|reach)\b",
    r"(?i)\b(?:order|isbn|version|invoice|page|pages|item|ticket|chapter|figure|release|build|total|sku|doi|serial)\b",
)
FEATURES = ("generator", "digits", "letters", "length", "separators", "luhn", "after_word", "before_word", *(f"cue{k}" for k in range(len(CUES))))

SAMPLE_ROWS = 4000
TREES, DEPTH, RATE = 24, 3, 0.3
PRECISION = 0.98


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check sum of a string of ASCII digits is a multiple of ten."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        d = F.ascii(c) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + F.when(acc["i"] % 2 == 1, twice).otherwise(d)).alias("sum"))

    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda acc: acc["sum"] % 10 == 0)


def base_spans(text: Column) -> Column:
    has_digit = text.rlike(DIGIT)

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.try_to_number(F.when(bare == "", F.lit("0")).otherwise(F.substring(bare, 1, 3)), F.lit("999")), F.lit(0)) <= 255)

    email = S.matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(S.matches(text, IP, has_digit), lambda x: F.forall(F.split(x["m"], r"\."), small))
    card = F.filter(S.matches(text, CARD, has_digit), lambda x: F.length(digits_of(x["m"])).between(12, 19) & luhn(digits_of(x["m"])))
    phone = F.filter(S.matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(digits_of(x["m"])).between(9, 15))
    return S.in_order(*[S.of_kind(f, k, i) for i, (k, f) in enumerate(zip(KINDS, (email, ip, card, phone), strict=False))])


CANDIDATES = "array<struct<g:int,s:int,e:int,m:string>>"


def candidates(text: Column) -> Column:
    """What the generators propose, overlapping as it is: generator g, span, match."""
    worth = text.rlike(WORTH)
    lists = []
    for g, (_, pattern) in enumerate(GENERATORS):
        found = S.matches(text, pattern, worth & text.rlike(pattern))
        lists.append(F.transform(found, lambda x, g=g: F.struct(F.lit(g).alias("g"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))))
    return F.concat(*lists).cast(CANDIDATES)


def features(of: Column, c: Column) -> Column:
    """A struct of small integers that describe a candidate's format and what stands around it; of: the text's blocks."""
    before = S.part(of, F.greatest(c["s"] - CONTEXT, F.lit(0)), F.least(c["s"], F.lit(CONTEXT)))
    after = S.part(of, c["e"], F.lit(1))
    shown = F.struct(before.alias("before"), digits_of(c["m"]).alias("digits"))

    def described(x: Column) -> Column:
        d = x["digits"]
        cols = {
            "generator": c["g"],
            "digits": F.least(F.length(d), F.lit(31)),
            "letters": F.least(F.length(F.regexp_replace(c["m"], "[^A-Za-z]", "")), F.lit(63)),
            "length": F.least(F.length(c["m"]), F.lit(63)),
            "separators": F.least(F.length(F.regexp_replace(c["m"], "[A-Za-z0-9]", "")), F.lit(15)),
            "luhn": F.when(F.length(d) >= 12, luhn(d).cast("int")).otherwise(F.lit(0)),
            "after_word": after.rlike("[A-Za-z0-9]").cast("int"),
            "before_word": x["before"].rlike("[A-Za-z0-9#/=_]$").cast("int"),
            **{f"cue{k}": x["before"].rlike(cue).cast("int") for k, cue in enumerate(CUES)},
        }
        return F.struct(*[cols[n].cast("int").alias(n) for n in FEATURES])

    return S.let(shown, described)


def labelled_sample(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, s, e, label: personal data written in loose formats, and numbers that only look like it."""
    ids = spark.range(rows)
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    choose = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), pick(k, len(xs)) + 1)
    num = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**n)).cast("string"), n, "0")
    name = choose(1, ["maria", "j.smith", "tom_k", "info", "li.wei", "sales", "a.b", "office"])
    host = choose(2, ["example", "mail", "corp", "post-box", "uni"])
    sep = choose(3, ["-", " ", "."])
    formats = [
        (1, F.concat(name, F.lit(" at "), host, F.lit(" dot "), choose(4, ["com", "org", "net"])), ["write to", "mail me:", "contact", "e-mail"]),
        (1, F.concat(name, F.lit("(at)"), host, F.lit("."), choose(4, ["com", "org", "net"])), ["reach", "email", "or", ""]),
        (1, F.concat(F.lit("("), num(5, 3), F.lit(") "), num(6, 3), sep, num(7, 4)), ["phone", "call", "tel.", "fax:", "and"]),
        (1, F.concat(num(5, 3), sep, num(6, 3), sep, num(7, 4)), ["phone", "call", "mobile:", "dial"]),
        (1, F.concat(num(5, 3), F.lit("-"), num(6, 2), F.lit("-"), num(7, 4)), ["ssn", "social security number", "identity", "tax id"]),
        (1, F.concat(choose(4, ["DE", "FR", "ES", "GB"]), num(5, 2), F.lit(" "), num(6, 4), F.lit(" "), num(7, 4), F.lit(" "), num(8, 4), F.lit(" "), num(9, 4)), ["iban", "account", "bank", "pay to"]),
        (1, F.concat_ws(":", *[F.lower(F.hex(F.pmod(F.xxhash64("id", F.lit(20 + k)), F.lit(65536)))) for k in range(8)]), ["host", "from", "ip", "address"]),
        (0, F.concat(num(5, 3), sep, num(6, 3), sep, num(7, 4)), ["order", "isbn", "item", "invoice", "ticket", "serial", "total"]),
        (0, num(5, 12), ["order", "number", "the", "serial", "", "and", "isbn", "card", "phone"]),
        (0, num(5, 14), ["of", "and", "item", "", "in"]),
        (0, num(5, 16), ["of", "and", "card", "item", "", "in"]),
        (0, num(5, 17), ["order", "a", "build", "", "card"]),
        (0, F.concat(num(5, 3), F.lit("-"), num(6, 2), F.lit("-"), num(7, 4)), ["version", "part", "item", "isbn", "page"]),
        (0, F.concat_ws(" ", num(5, 4), num(6, 4), num(7, 5), num(8, 4), num(9, 2)), ["", "of", "and", "table", "row"]),
        (0, F.concat_ws("-", num(5, 5), num(6, 3), num(7, 6)), ["", "of", "and", "serial", "row"]),
        (0, F.concat(F.lit("look"), F.lit(" at "), F.lit("this. "), F.lit("And")), ["we", "they", "to"]),
        (0, F.concat(num(5, 2), F.lit(":"), num(6, 2), F.lit(":"), num(7, 2), F.lit(":"), num(8, 2), F.lit(":"), num(9, 2)), ["time", "at", "ratio"]),
        (0, F.concat(F.lit("20"), num(5, 2), F.lit("-"), num(6, 3), F.lit("-"), num(7, 4)), ["release", "build", "doi", "chapter"]),
    ]
    form = pick(0, len(formats))
    item = F.coalesce(*[F.when(form == k, f) for k, (_, f, _) in enumerate(formats)])
    cue = F.coalesce(*[F.when(form == k, choose(30 + k, c)) for k, (_, _, c) in enumerate(formats)])
    label = F.coalesce(*[F.when(form == k, F.lit(lab)) for k, (lab, _, _) in enumerate(formats)])
    head = F.concat(choose(60, ["", "Then ", "so there was a ", "On the day, "]), cue, F.lit(" "))
    tail = choose(61, ["", ".", " and more", ", then", "; he"])
    return ids.select(F.concat(head, item, tail).alias("text"), F.length(head).alias("s"), (F.length(head) + F.length(item)).alias("e"), label.alias("label"))


@dataclass
class Boosted:
    """Trees as nested tuples (feature, threshold, left, right) with numbers at the leaves, and the calibration."""

    trees: list
    bias: float
    slope: float
    intercept: float
    threshold: float

    def raw(self, x: tuple) -> float:
        total = self.bias
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            total += t
        return total

    def column(self, f: Column) -> Column:
        """The calibrated probability as an expression of a struct of features."""

        def walk(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(f[FEATURES[t[0]]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + walk(t)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.intercept))))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _tree(rows: list, depth: int, rate: float):
    """rows: (features, gradient, curvature); a tree that takes a Newton step at each leaf."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = rate * g / (h + 1.0)
    if depth == 0 or len(rows) < 2:
        return leaf
    best, gain = None, 1e-6
    for k in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for x, gi, hi in rows:
            s = by.setdefault(x[k], [0.0, 0.0])
            s[0] += gi
            s[1] += hi
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl, hl = gl + by[v][0], hl + by[v][1]
            better = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if better > gain:
                best, gain = (k, v), better
    if best is None:
        return leaf
    k, v = best
    return (k, v, _tree([r for r in rows if r[0][k] <= v], depth - 1, rate), _tree([r for r in rows if r[0][k] > v], depth - 1, rate))


def train(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Boosted:
    """Fit on a labelled sample (text, s, e, label): a candidate that overlaps a labelled span by half has its label, others are 0.

    The sample must be bounded (SAMPLE_ROWS here): one row for each distinct feature vector reaches the
    driver. A third of the texts, by hash, calibrate the scores and set the threshold.
    """
    text = F.col("text")
    rows = sample.select("text", "s", "e", "label", F.explode(candidates(text)).alias("c"))
    c = F.col("c")
    shared = F.greatest(F.lit(0), F.least(c["e"], F.col("e")) - F.greatest(c["s"], F.col("s")))
    is_one = ((F.col("label") == 1) & (2 * shared >= c["e"] - c["s"])).cast("int")
    held = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    counted = rows.select(held.alias("held"), is_one.alias("y"), features(S.blocks(text), c).alias("f")).select("held", "y", "f.*").groupBy("held", "y", *FEATURES).count()
    vectors = [(r["held"], r["y"], tuple(r[n] for n in FEATURES), r["count"]) for r in counted.collect()]
    fit: dict[tuple, list[float]] = {}
    for h, y, x, n in sorted(vectors):
        if not h:
            fit.setdefault(x, [0.0, 0.0])[y] += n
    zeros, ones = (sum(v[k] for v in fit.values()) for k in (0, 1))
    model = Boosted([], math.log((ones + 1) / (zeros + 1)), 1.0, 0.0, 0.5)
    scores = dict.fromkeys(fit, model.bias)
    for _ in range(trees if fit else 0):
        grads = [(x, ones - (ones + zeros) * (p := _sigmoid(scores[x])), (ones + zeros) * p * (1 - p)) for x, (zeros, ones) in fit.items()]
        tree = _tree(grads, depth, RATE)
        model.trees.append(tree)
        for x in scores:
            t = tree
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            scores[x] += t
    kept = [(model.raw(x), y, n) for h, y, x, n in vectors if h]
    for _ in range(200 if kept else 0):  # Platt's scaling
        ga = gb = 0.0
        total = sum(n for _, _, n in kept)
        for z, y, n in kept:
            d = n * (y - _sigmoid(model.slope * z + model.intercept)) / total
            ga, gb = ga + d * z, gb + d
        model.slope += 0.2 * ga
        model.intercept += 0.2 * gb
    # From the highest score down: the lowest threshold above which all prefixes keep the precision.
    model.threshold = 1.01
    right = seen = 0
    ordered = sorted(((_sigmoid(model.slope * z + model.intercept), y, n) for z, y, n in kept), reverse=True)
    for i, (p, y, n) in enumerate(ordered):
        right, seen = right + y * n, seen + n
        if i + 1 < len(ordered) and ordered[i + 1][0] == p:
            continue
        if right < precision * seen:
            break
        model.threshold = max(p, 0.5)
    return model


def model_spans(text: Column, proposed: Column, base: Column, model: Boosted) -> Column:
    """The candidates clear of base spans that reach the threshold; those that overlap make one span."""

    def kept(of: Column) -> Column:
        seen = F.transform(S.without_overlap(proposed, base), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), features(of, c).alias("f")))
        return F.filter(seen, lambda x: model.column(x["f"]) >= model.threshold)

    found = S.runs(S.in_order(S.of_kind(S.let(S.blocks(text), kept), "model", 4)))
    return F.when(F.size(proposed) > 0, found).otherwise(F.array().cast(S.SPANS))


def scan(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with two more columns: pii_base (spans of the base patterns) and pii_spans (those and the model's), in order.

    Null and empty texts have no spans; a candidate under the threshold or overlapping a base span is dropped, and
    kept candidates that overlap make one span. Texts are scanned whole, without a shuffle, in time that grows with
    n log n of their matches. A table that has columns of these two names already is refused.
    """
    need(docs, "text")
    clash = {"pii_base", "pii_spans"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError("table has columns of the result's names: " + ", ".join(sorted(clash)))
    return _scanned(docs, model, "pii_base", "pii_spans")


def _scanned(docs: DataFrame, model: Boosted | None, base: str, spans: str) -> DataFrame:
    model = model or train(labelled_sample(docs.sparkSession))
    text, proposed = fresh(docs, "text_"), fresh(docs, "proposed_")
    rows = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumns({base: base_spans(F.col(text)), proposed: candidates(F.col(text))})
    extra = model_spans(F.col(text), F.col(proposed), F.col(base), model)
    return rows.withColumn(spans, S.in_order(F.col(base), extra)).drop(text, proposed)


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with personal data in text replaced by its kind; null texts stay null, n_chars follows. All other columns stay."""
    need(docs, "text")
    base, spans = fresh(docs, "base_"), fresh(docs, "spans_")
    found = _scanned(docs, model, base, spans)
    out = found.withColumn("text", S.redacted(F.col("text"), F.col(spans))).drop(base, spans)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans. Null and empty texts have none;
    repeated rows are returned each; an empty table gives no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs)
    base = F.col("pii_base")
    return found.select(
        "doc_id",
        *[S.count_kind(base, k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(S.said(base), 256).alias("base_sha256"),
        S.said(F.col("pii_spans")).alias("spans"),
    )
