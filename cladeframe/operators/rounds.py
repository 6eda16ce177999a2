"""The construction loop: place what fits, recycle the rest, until nothing new comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.config import Settings
from cladeframe.operators.sets import conservation_audit
from cladeframe.stage import staged


class Rounds:
    """State of a run as Parquet under a folder: families/round=N and pool/round=N, each complete or absent.

    The pool and the families of a round are written from the same assignment, so a run that was stopped resumes from
    the last round that has both, and no gene is lost between them.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings()

    def _has(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/round={number}"

    def last(self) -> int:
        n = 0
        while self._has(self._path("families", n + 1)) and self._has(self._path("pool", n + 1)):
            n += 1
        return n

    def families(self, upto: int) -> DataFrame | None:
        out = None
        for n in range(1, upto + 1):
            one = self.spark.read.parquet(self._path("families", n)).withColumn("round", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out

    def run(self, pool: DataFrame, place: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
        """pool: gene. place(pool, number) returns gene, group, confirmed for the genes it clustered.

        Confirmed genes of groups that keep at least min_family_size members become families R<round>_<group>;
        everything else goes back to the pool: a gene is placed or recycled, never both or neither. Ends after
        convergence_no_new_families rounds without a family, with a pool under convergence_threshold, or at max_rounds.
        """
        s = self.settings
        number = self.last()
        if number:
            pool = self.spark.read.parquet(self._path("pool", number))
        barren = 0
        while number < s.max_rounds and barren < s.convergence_no_new_families and pool.count() >= s.convergence_threshold:
            number += 1
            clustered = place(pool, number)
            sized = clustered.groupBy("group").agg(F.count("*").alias("_n"), F.count_if("confirmed").alias("_k"))
            good = sized.where((F.col("_n") >= s.min_orthogroup_size) & (F.col("_k") >= s.min_family_size)).select("group")
            # A gene that two groups claim goes to the first by name.
            placed = clustered.where("confirmed").join(good, "group", "left_semi").groupBy("gene").agg(F.min("group").alias("group"))
            named = placed.select("gene", F.concat(F.lit(f"R{number}_"), "group").alias("family"))
            named.write.mode("overwrite").parquet(self._path("families", number))
            families = self.spark.read.parquet(self._path("families", number))
            none = families.select("gene").limit(0)
            conservation_audit(pool, families, none, "gene").write.mode("overwrite").parquet(self._path("pool", number))
            pool = self.spark.read.parquet(self._path("pool", number))
            barren = barren + 1 if families.isEmpty() else 0
        return self.families(number), pool


def unrolled(pool: DataFrame, place: Callable[[DataFrame, int], DataFrame], rounds: int) -> DataFrame:
    """gene, family, round over a fixed number of rounds as one plan, for small jobs that need no state on disk."""
    out = None
    for number in range(1, rounds + 1):
        placed = place(pool, number).select("gene", "family").withColumn("round", F.lit(number))
        out = placed if out is None else out.unionByName(placed)
        pool = pool.join(placed.select("gene"), "gene", "left_anti")
    return out


#: Rows of a small side that are broadcast at most; beyond it both sides are shuffled, hot keys over SALTS.
BROADCAST_ROWS = 1_000_000
SALTS = 16


def _with_small(big: DataFrame, small: DataFrame, key: str, n_small: int, how: str = "inner") -> DataFrame:
    """big joined with small (one row a key, counted) on key: broadcast if it is small, else dealt so that a hot key takes SALTS tasks."""
    if n_small <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    own = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    return own.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], how).drop("_salt")


MARKS = "round int, placed long, open_round int, open_genes long, stamp long"


class Growth:
    """Families grown from seed genes over shared profiles until a round places nothing, with Parquet state under a folder.

    A round looks only at what the last one changed: the profiles that its genes hit, and of the other genes' hits those of
    these profiles. A gene joins the first family by name among those that reach it in the round, and stays. placed/round=N
    holds the genes of a round, open/round=N the hits of genes that no round before N placed (written anew only when
    enough has gone), marks/round=N is written last: a run that stopped goes on after the last mark, and a run over
    other hits or seeds (another stamp) starts over.
    """

    def __init__(self, spark: SparkSession, folder: str, rewrite_share: float = 0.05):
        self.spark, self.folder, self.rewrite_share = spark, folder.rstrip("/"), rewrite_share

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/round={number}"

    def _put(self, df: DataFrame, kind: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(kind, number))
        return self.spark.read.schema(df.schema).parquet(self._path(kind, number))

    def _mark(self, number: int, placed: int, open_round: int, open_genes: int, stamp: int) -> dict:
        mark = {"round": number, "placed": placed, "open_round": open_round, "open_genes": open_genes, "stamp": stamp}
        self.spark.createDataFrame([tuple(mark.values())], MARKS).coalesce(1).write.mode("overwrite").parquet(self._path("marks", number))
        return mark

    def _last(self, stamp: int) -> dict | None:
        """The last mark of an unbroken run of rounds with this stamp."""
        schema = ", ".join(x for x in MARKS.split(", ") if x != "round int")
        number, last = 0, None
        while True:
            try:
                rows = self.spark.read.schema(schema).parquet(self._path("marks", number)).collect()
            except AnalysisException:
                return last
            if not rows or rows[0].stamp != stamp:
                return last
            last = {"round": number, **rows[0].asDict()}
            number += 1

    def placed(self, upto: int, since: int = 0) -> DataFrame:
        """gene, family, round of the rounds since..upto."""
        paths = [self._path("placed", n) for n in range(since, upto + 1)]
        return self.spark.read.option("basePath", f"{self.folder}/placed").schema("gene string, family string, round int").parquet(*paths)

    def run(self, hits: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> dict:
        """hits: gene, profile. seeds: gene, family. Returns the last mark; placed(mark["round"]) are the members.

        RuntimeError if genes are lost or placed twice.
        """
        pairs = hits.select(F.col("gene").cast("string"), F.col("profile").cast("string")).where("gene IS NOT NULL AND profile IS NOT NULL")
        first = seeds.where("gene IS NOT NULL AND family IS NOT NULL").groupBy(F.col("gene").cast("string").alias("gene")).agg(F.min(F.col("family").cast("string")).alias("family"))
        # A digest of what the run is over, whatever the order of rows.
        signs = pairs.select(F.xxhash64("gene", "profile").alias("h")).unionByName(first.select(F.xxhash64(F.lit("seed"), "gene", "family").alias("h")))
        stamp = signs.agg(F.coalesce(F.bit_xor("h"), F.lit(0)).bitwiseXOR(F.count("*")).alias("s")).first()["s"]
        mark = self._last(stamp)
        if mark is None:
            open_ = self._put(pairs.distinct(), "open", 0)
            n = self._put(first, "placed", 0).count()
            mark = self._mark(0, n, 0, open_.select("gene").distinct().count(), stamp)
        while mark["placed"] and (max_rounds is None or mark["round"] < max_rounds):
            mark = self._round(mark)
        return mark

    def _round(self, mark: dict) -> dict:
        number = mark["round"] + 1
        open_ = self.spark.read.schema("gene string, profile string").parquet(self._path("open", mark["open_round"]))
        delta = self.placed(mark["round"], mark["round"]).select("gene", "family")
        # Hits of genes placed since open_ was written: the last round's are new, those before have reached all they can.
        gone = self.placed(mark["round"], mark["open_round"]).select("gene")
        n_gone = gone.count()
        reached = staged(_with_small(open_, delta, "gene", mark["placed"]).groupBy("profile").agg(F.min("family").alias("family")), "reached")
        rest = _with_small(open_, gone, "gene", n_gone, "left_anti")
        open_round, open_genes = mark["open_round"], mark["open_genes"]
        if n_gone >= self.rewrite_share * open_genes:
            rest, open_round = self._put(rest, "open", number), number
            open_genes = rest.select("gene").distinct().count()
            with_hits = open_before_genes(open_, gone, n_gone)
            if mark["open_genes"] != open_genes + with_hits:
                raise RuntimeError(f"round {number}: of {mark['open_genes']} genes {with_hits} were placed and {open_genes} are left")
        new = _with_small(rest, reached, "profile", reached.count()).groupBy("gene").agg(F.min("family").alias("family"))
        new = self._put(new, "placed", number)
        return self._mark(number, new.count(), open_round, open_genes, mark["stamp"])


def open_before_genes(open_: DataFrame, gone: DataFrame, n_gone: int) -> int:
    """How many of the genes gone have a hit in open_."""
    return _with_small(open_, gone, "gene", n_gone, "left_semi").select("gene").distinct().count()
