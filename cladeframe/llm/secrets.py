"""Secret scan: fixed patterns, and character Markov models for what they don't know.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a long token is a secret when its mean log-likelihood ratio exceeds a
threshold taken from held-out identifiers. Native: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import spans as S
from cladeframe.llm.common import need

KINDS = ("assign", "access", "hex", "model")
KEYWORD = "(?i:(password|passwd|secret|token|api_?key))"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough is matched whole, a shorter one not at all: the same as matching and dropping.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: Labelled strings of each kind in the built-in sample.
SAMPLE_ROWS = 3000
#: Share of identifiers of the held-out part that stay below the threshold, and a margin on top.
QUANTILE, MARGIN = 0.999, 0.1
WORDS = (
    "account address agent array audit binary branch build call chain channel child cloud code commit config container context core create data date "
    "default delta detail digest document double element engine entry event executor factory feature file final format function general graph handler "
    "header host image index input integer item java join kernel label layer length library limit link local lock machine manager master memory meta metric "
    "minor model monitor network number offset option output package panel parent partition pattern person plan point pool prefix process profile property "
    "provider public queue range region release report resource result role route rule sample schema script section sequence service setting signal single "
    "snapshot spark standard static step stream struct suffix support symbol table task test thread timer total track tree update user value version "
    "virtual wait watch window write"
)


def labelled_sample(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, label (1: random, 0: identifier): digests in several alphabets, and words joined as programmers do."""
    ids = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("cladeframe"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(b64, "[+/=]", "")
    size = 20 + F.pmod(F.col("id"), F.lit(24)).cast("int")
    random = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, b64).when(F.col("id") % 4 == 2, plain).otherwise(F.upper(plain))
    words = F.split(F.lit(WORDS), " ")
    pick = lambda k: F.element_at(words, F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)).cast("int") + 1)
    some = F.slice(F.array(*map(pick, range(5))), 1, 3 + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(6))
    year = F.concat((1990 + F.col("id") % 40).cast("string"), F.lit("-"), F.lpad((1 + F.col("id") % 12).cast("string"), 2, "0"))
    ident = (
        F.when(style == 0, F.array_join(some, "_"))
        .when(style == 1, F.array_join(some, "-"))
        .when(style == 2, F.array_join(F.transform(some, F.initcap), ""))
        .when(style == 3, F.upper(F.array_join(some, "_")))
        .when(style == 4, F.concat_ws("/", F.array_join(some, "/"), year))
        .otherwise(F.array_join(some, ""))
    )
    return ids.select(F.substring(random, F.lit(1), size).alias("text"), F.lit(1).alias("label")).union(ids.select(ident.alias("text"), F.lit(0).alias("label")))


def train(sample: DataFrame, alphabet: int = 68) -> tuple[list[float], float]:
    """The log-likelihood ratios of character pairs (random over ordinary, at 128*first+second), and the threshold.

    Four fifths of the sample train the models, the rest sets the threshold. At most two rows for each
    pair of ASCII characters reach the driver. Texts that aren't ASCII, null or short add nothing.
    """
    ok = sample.where(F.col("text").rlike(r"^[\x00-\x7f]{2,}$") & F.col("label").isin(0, 1))
    ok = ok.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    chars = F.transform(F.split("text", ""), F.ascii)
    pairs = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.element_at(chars, i) * 128 + F.element_at(chars, i + 1))
    counts = ok.where(~F.col("held")).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()
    seen: dict[int, dict[int, int]] = {0: {}, 1: {}}
    after: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in counts:
        seen[r["label"]][r["pair"]] = r["count"]
        after[r["label"]][r["pair"] >> 7] = after[r["label"]].get(r["pair"] >> 7, 0) + r["count"]
    ratios = []
    for pair in range(128 * 128):
        p = [math.log((seen[k].get(pair, 0) + 0.5) / (after[k].get(pair >> 7, 0) + 0.5 * alphabet)) for k in (0, 1)]
        ratios.append(round(p[1] - p[0], 4))
    mean = mean_ratio(F.col("text"), ratios)
    row = ok.where(F.col("held") & (F.col("label") == 0)).agg(F.percentile(mean, QUANTILE).alias("q")).first()
    return ratios, max(0.0, row["q"] or 0.0) + MARGIN


def mean_ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of an ASCII text's pairs of characters; 0 for fewer than two."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        more = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, acc["last"] * 128 + code + 1))
        return F.struct(code.alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["sum"]) / F.greatest(F.length(text) - 1, F.lit(1))


def scan(docs: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """doc_id, text, base (spans of the fixed patterns), spans (those and the models'), in order.

    Null and empty texts have no spans. A model's span overlaps no base span. Repeated rows are
    scanned each; other columns are ignored. The texts are scanned whole, in one pass without a shuffle.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    ratios, threshold = train(sample if sample is not None else labelled_sample(spark))
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = F.filter(S.matches(text, ASSIGN, text.rlike(KEYWORD)), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
    access = S.matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexa = S.matches(text, HEX, text.rlike(HEX))
    tokens = S.matches(text, TOKEN, text.rlike(TOKEN))
    rows = rows.withColumns(
        {
            "_base": S.in_order(S.of_kind(assign, "assign", 0), S.of_kind(access, "access", 1), S.of_kind(hexa, "hex", 2)),
            "_tokens": tokens,
        }
    )
    free = S.without_overlap(F.col("_tokens"), F.col("_base"))
    likely = F.filter(free, lambda x: mean_ratio(x["m"], ratios) > threshold)
    return rows.select("doc_id", "text", F.col("_base").alias("base"), S.in_order(F.col("_base"), S.of_kind(likely, "model", 3)).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans. Null and empty texts have none;
    repeated rows are returned each; an empty table gives no row."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[S.count_kind(base, k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(S.said(base), 256).alias("base_sha256"),
        S.said(F.col("spans")).alias("spans"),
    )
