"""Hilbert-curve sharding: rows close in several metadata dimensions land in the same files.

Every dimension is quantised to the same number of bits, the cells are numbered along a Hilbert curve,
rows are ordered by their cell's number and the order is cut into runs of equal row count.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import BROADCAST_IDS, global_index, need, staged

N_SHARDS = 40
SALTS = 16
BITS = 5


def hilbert_table(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """All 2**(dims*bits) cells and their place on the curve: columns cell, curve.

    A cell packs its coordinates, the first dimension in the highest bits. The transform works from the
    highest bit down: where a coordinate has the bit, the lower bits of the first coordinate are
    mirrored, else they change places with that coordinate's; a Gray decoding then gives the index.
    """
    if dims * bits > 20:
        raise ValueError("at most 20 bits of cells: the table of cells is broadcast")
    mask = (1 << bits) - 1
    coords = F.array(*[F.shiftright(F.col("id").cast("int"), bits * (dims - 1 - d)).bitwiseAND(F.lit(mask)) for d in range(dims)])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(d + 1).alias("at")) for b in range(bits - 1, 0, -1) for d in range(dims)])

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        first, own = F.element_at(x, 1), F.element_at(x, step["at"])
        has = own.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        new_first = F.when(has, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.transform(
            x,
            lambda v, j: F.when(j == 0, new_first)
            .when((j + 1 == step["at"]) & ~has, v.bitwiseXOR(swap))
            .otherwise(v),
        )

    turned = F.aggregate(steps, coords, turn)
    # Gray: each coordinate takes the exclusive or of those before it ...
    grayed = F.transform(
        turned,
        lambda v, j: F.aggregate(F.slice(turned, F.lit(1), j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)),
    )
    last = F.element_at(grayed, dims)
    # ... and all are flipped below every bit that the last one has.
    flip = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]),
        F.lit(0),
        lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a),
    )
    final = F.transform(grayed, lambda v: v.bitwiseXOR(flip))
    curve = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            bit = F.shiftright(F.element_at(F.col("_x"), d + 1), b).bitwiseAND(F.lit(1))
            curve = F.shiftleft(curve, 1).bitwiseOR(bit)
    cells = spark.range(1 << (dims * bits))
    return cells.select(F.col("id").cast("int").alias("cell"), final.alias("_x")).select("cell", curve.alias("curve"))


def quantised(df: DataFrame, numbers: list[str], names: list[str], bits: int) -> DataFrame:
    """Add column cell. Numbers are cut at the quantiles of all rows; null is 0.

    The quantiles come from a mergeable summary of bounded size; 2**bits-1 numbers a column reach the driver. A
    column of fewer than 2**bits names has a cell for each, in their order; of more, 2**bits reach the driver
    and names share cells by a hash.
    """
    cells = 1 << bits
    at = [i / cells for i in range(1, cells)]
    row = df.agg(*[F.percentile_approx(n, F.array(*map(F.lit, at)), 10000).alias(n) for n in numbers]).first() if numbers else {}
    parts = []
    for n in numbers:
        cuts = sorted(set(row[n] or []))
        bucket = F.lit(0)
        for c in cuts:
            bucket = bucket + (F.col(n) > F.lit(c)).cast("int")
        parts.append(F.coalesce(bucket, F.lit(0)))
    for n in names:
        few = sorted(r[0] for r in df.select(n).where(F.col(n).isNotNull()).distinct().limit(cells).collect())
        if len(few) < cells:
            parts.append(F.coalesce(F.array_position(F.array(*map(F.lit, few)), F.col(n)), F.lit(0)).cast("int") if few else F.lit(0))
        else:
            parts.append(F.when(F.col(n).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(n), F.lit(cells))).cast("int"))
    cell = F.lit(0)
    for p in parts:
        cell = F.shiftleft(cell, bits).bitwiseOR(p)
    return df.withColumn("cell", cell)


def _whole_groups(numbered: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """old, new: exchanges of rows of `numbered` (_row, n, size, text_crc32, text_hash) that bring groups parted by a cut into one shard.

    A group lies in one run of rows, so a cut parts one group at most. Its smaller part changes places with as many rows that are
    in no group: those of the half of the other shard that is next to the cut, the nearest first. If that half has too few, the
    larger part changes places instead; if neither can, or the group spans more than one cut, it stays parted.
    """
    spark = numbered.sparkSession
    n_rows = max(n_rows, 1)
    first = [-(-s * n_rows // n_shards) for s in range(n_shards + 1)]
    shard = F.expr(f"CAST((_row * {n_shards}L) div {n_rows}L AS INT)")
    ends = numbered.where("n > 1").groupBy("size", "text_crc32", "text_hash").agg(F.min("_row").alias("lo"), F.max("_row").alias("hi"))
    # One row a cut at most.
    parted = ends.where(F.expr(f"(hi * {n_shards}L) div {n_rows}L - (lo * {n_shards}L) div {n_rows}L = 1")).select("lo", "hi").collect()
    middle = F.element_at(F.array(*[F.lit((first[s] + first[s + 1]) // 2) for s in range(n_shards)]), shard + 1)
    singles = numbered.where("n = 1").select("_row", (2 * shard + (F.col("_row") >= middle).cast("int")).alias("half"))
    have = {r["half"]: r["k"] for r in singles.groupBy("half").agg(F.count("*").alias("k")).collect()} if parted else {}
    turns = []
    for r in parted:
        right = r["hi"] * n_shards // n_rows
        cut = first[right]
        # (rows that move, where they begin, the half that they go to)
        ways = sorted([(cut - r["lo"], r["lo"], 2 * right), (r["hi"] + 1 - cut, cut, 2 * right - 1)])
        turns += [(half, start, k, cut) for k, start, half in ways if have.get(half, 0) >= k][:1]
    if not turns:
        return spark.createDataFrame([], "old long, new long")
    plan = spark.createDataFrame(turns, "half int, start long, k long, cut long")
    near = singles.join(F.broadcast(plan), "half").withColumn("away", F.abs(F.col("_row") - F.col("cut")))
    ranked = staged(global_index(near, [F.col("half"), F.col("away")], "_at", "shard-singles"), "shard-near")
    begins = ranked.groupBy("half").agg(F.min("_at").alias("_begin"))
    pairs = ranked.join(F.broadcast(begins), "half").withColumn("_rank", F.col("_at") - F.col("_begin")).where("_rank < k").select(F.col("_row").alias("old"), (F.col("start") + F.col("_rank")).alias("new"))
    return pairs.unionByName(pairs.select(F.col("new").alias("old"), F.col("old").alias("new")))


def hilbert_shards(docs: DataFrame, n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """Place every row of docs (doc_id, text, lang, source) in a shard.

    Returns doc_id, lang, source, size, text_crc32, cell, curve, shard, slot. Dimensions: size of the
    text, language, source. Null text: no bytes, CRC of the empty text. Null language or source: cell
    0. Equal texts form a group that lies in one cell, that of its least language and source, and within a curve
    index rows are ordered by CRC, text hash and doc_id: a group is one run of rows. Where a cut would part it, rows without
    copies change places with a part of it, so only groups too large for that are in several shards. Repeated rows each get
    a slot. Shards differ by one row at most. An empty table gives an
    empty result. Other columns of docs are ignored. Texts aren't shuffled.
    """
    need(docs, "doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    rows = staged(rows, "shard-sizes")  # the texts are read once
    n_rows = rows.count()
    # Copies are counted before they are shuffled.
    names = [F.min(c).alias(f"one_{c}") for c in ("lang", "source")]
    alike = F.min("lang").eqNullSafe(F.max("lang")) & F.min("source").eqNullSafe(F.max("source")) & (F.count("lang").isin(0, F.count("*"))) & (F.count("source").isin(0, F.count("*")))
    groups = rows.groupBy("size", "text_crc32", "text_hash").agg(F.count("*").alias("n"), (~alike).alias("mixed"), *names).where("n > 1")
    # The rows of a text with very many copies look its group up in SALTS places.
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(dealt, ["size", "text_crc32", "text_hash", "salt"], "left").drop("salt").withColumn("n", F.coalesce("n", F.lit(1)))
    # A group whose rows differ in language or source goes by the least of them.
    rows = rows.withColumns({f"group_{c}": F.when(F.col("mixed"), F.col(f"one_{c}")).otherwise(F.col(c)) for c in ("lang", "source")})
    cells = quantised(staged(rows, "shard-groups"), ["size"], ["group_lang", "group_source"], bits)
    curve = hilbert_table(docs.sparkSession, 3, bits)
    # 2**15 rows of two ints, whatever the input.
    placed = cells.join(F.broadcast(curve), "cell")
    keys = [F.col("curve"), F.col("text_crc32"), F.col("text_hash"), F.col("doc_id")]
    numbered = staged(global_index(placed, keys, "_row", "shard-order"), "shard-rows")
    moves = staged(_whole_groups(numbered, n_rows, n_shards), "shard-moves")
    few = moves.count() <= BROADCAST_IDS
    moved = numbered.join(F.broadcast(moves) if few else moves, numbered["_row"] == moves["old"], "left").withColumn("_row", F.coalesce("new", "_row"))
    first = F.expr(f"(shard * {n_rows}L + {n_shards - 1}L) div {n_shards}L")
    return (
        moved.withColumn("shard", F.expr(f"CAST((_row * {n_shards}L) div {max(n_rows, 1)}L AS INT)"))
        .withColumn("slot", F.col("_row") - first)
        .select("doc_id", "lang", "source", "size", "text_crc32", "cell", "curve", "shard", "slot")
    )


def shard_manifest(shards: DataFrame) -> DataFrame:
    """One row per shard: rows, bytes, and the range of each dimension, for pruning files."""
    return shards.groupBy("shard").agg(
        F.count("*").alias("rows"),
        F.sum("size").alias("bytes"),
        *[f(c).alias(f"{n}_{c}") for c in ("size", "lang", "source", "curve") for n, f in (("min", F.min), ("max", F.max))],
    )


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, CRC, shard and slot under the law of near-equal row counts; nulls, ties and repeats as in hilbert_shards()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hilbert_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
