"""Line- and record-based formats as DataFrames. Rows that don't parse are left out, never guessed.

Where a format's first row wins, `at` carries the place of the row: file, split, row. It doesn't depend on how tasks run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.ids import without_transcript
from cladeframe.operators.topk import best_hit

#: File extensions of sequence files.
FASTA_SUFFIXES = (".fa", ".faa", ".fasta", ".fna", ".ffn", ".pep", ".cds")


def _read(spark: SparkSession, path, sep: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")
    return reader.text(path).select("value", at)


def lines(spark: SparkSession, path) -> DataFrame:
    """value, at: one row per line."""
    return _read(spark, path).withColumn("value", F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))


def _fields(rows: DataFrame, pattern: str, value: Column) -> DataFrame:
    """f, at: value split once a row; filters on fields stay above the generator, where they'd split it again each."""
    return rows.select(F.explode(F.array(F.split(value, pattern))).alias("f"), "at")


#: Bytes of text whose rows one task gets, on average, where rows are dealt by a key.
TASK_BYTES = 16 << 20


def _dealt(spark: SparkSession, path, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows of the files at path dealt by keys over tasks by the files' bytes, so that a task's share doesn't grow with them.

    In `at` the file's name, most of a row, gives way to its place among the names. A key's rows meet in one task, which sorts
    them and spills; grouping and ranking by these keys need no other shuffle.
    """
    # A row per file, of which the contents aren't read.
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"), F.col("length").alias("_size"))
    size = files.agg(F.sum("_size")).first()[0] or 0
    numbered = files.select("_file", F.row_number().over(Window.orderBy("_file")).alias("_no"))
    rows = rows.join(F.broadcast(numbered), F.col("at.file") == F.col("_file"), "left").withColumn("at", F.struct("_no", "at.block", "at.row")).drop("_file", "_no")
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), *keys)


def _best(spark: SparkSession, path, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order, at being its end, dealt by key before it is sorted."""
    return best_hit(_dealt(spark, path, rows, keys), keys, order).drop("at")


def whole(spark: SparkSession, path) -> DataFrame:
    """value, file: one row per file, for formats that are one document."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def tabbed(spark: SparkSession, path) -> DataFrame:
    """f (array of fields), at: tab-separated rows without comments and blank lines."""
    return _fields(lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")), "\t", F.col("value"))


def field(n: int, kind: str = "string") -> Column:
    c = F.get(F.col("f"), F.lit(n))
    return c.try_cast(kind) if kind != "string" else c


def fasta(spark: SparkSession, path) -> DataFrame:
    """id, seq, at: the id ends at white space; sequence lines are put together. Files may be of any size."""
    rows = _read(spark, path, "\n>").withColumn("value", F.regexp_replace("value", r"^>|\r", "")).where(F.trim("value") != "")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s", "")
    return rows.select(F.split_part(F.trim(head), F.lit(" "), F.lit(1)).alias("_id"), body.alias("seq"), "at").select(F.split_part("_id", F.lit("\t"), F.lit(1)).alias("id"), "seq", "at")


def fasta_dir(spark: SparkSession, folder: str) -> DataFrame:
    """id, seq over a folder's sequence files; of a repeated id the row of the last file, by name, wins."""
    rows = fasta(spark, folder)
    rows = rows.where(F.coalesce(*[F.when(F.col("at.file").endswith(s), F.lit(True)) for s in FASTA_SUFFIXES], F.lit(False)))
    return best_hit(rows, ["id"], [F.col("at").desc()]).select("id", "seq")


def sequence_lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("id", F.length(F.rtrim("seq", F.lit("*"))).cast("long").alias("length"))


def orthogroups(spark: SparkSession, path, dedupe: bool = True) -> DataFrame:
    """og, species, gene from the wide table. With dedupe a gene stays where it comes first: line, then column, then place."""
    rows = lines(spark, path)
    first = rows.agg(F.min_by("value", "at").alias("h")).first()
    names = (first["h"] or "").split("\t")[1:]
    body = rows.where(F.col("value") != F.lit(first["h"])).select(F.split("value", "\t").alias("f"), "at")
    cellpos = body.select(field(0).alias("og"), "at", F.posexplode(F.slice("f", 2, len(names) or 1)).alias("c", "cell"))
    genes = cellpos.select("og", "at", "c", F.posexplode(F.split("cell", ",")).alias("i", "g")).select("og", "at", "c", "i", F.trim("g").alias("gene")).where("gene <> ''")
    if dedupe:
        genes = best_hit(genes, ["gene"], [F.col("at"), F.col("c"), F.col("i")])
    return genes.select("og", F.get(F.array(*map(F.lit, names or [""])), F.col("c")).alias("species"), "gene")


#: Columns of the group table that aren't species.
GROUP_METADATA = ("group_id", "group_size", "sp_in_grp", "seed_ortholog_cnt")


def ortholog_groups(spark: SparkSession, path) -> DataFrame:
    """group_id, species, gene; an asterisk is an empty cell, metadata columns are skipped by name."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    species = [c for c in df.columns if c not in GROUP_METADATA]
    cell = F.explode(F.array(*[F.struct(F.lit(c.removesuffix(".faa")).alias("species"), F.col(f"`{c}`").alias("cell")) for c in species]))
    rows = df.select("group_id", cell.alias("x")).select("group_id", "x.species", F.explode(F.split("x.cell", ",")).alias("gene"))
    return rows.withColumn("gene", F.trim("gene")).where("gene <> '' AND gene <> '*'")


def spaced(spark: SparkSession, path) -> DataFrame:
    return _fields(lines(spark, path).where(~F.col("value").startswith("#")), r"\s+", F.trim("value"))


def domtblout(spark: SparkSession, path) -> DataFrame:
    """gene, family, seq_len, hmm_len, evalue, bits, domains (hmm_from, hmm_to, ali_from, ali_to, bits) per hit.

    The first row of a hit gives its full-sequence values.
    """
    rows = spaced(spark, path).select(
        field(0).alias("gene"), field(3).alias("family"), field(2, "int").alias("seq_len"), field(5, "int").alias("hmm_len"), field(6, "double").alias("evalue"), field(7, "double").alias("bits"),
        field(13, "double").alias("dom_bits"), *[field(15 + k, "int").alias(n) for k, n in enumerate(("hmm_from", "hmm_to", "ali_from", "ali_to"))], "at",
    )
    whole_row = rows.dropna(subset=["seq_len", "hmm_len", "evalue", "bits", "dom_bits", "hmm_from", "hmm_to", "ali_from", "ali_to"])
    of_hit, of_domain = ("seq_len", "hmm_len", "evalue", "bits"), ("hmm_from", "hmm_to", "ali_from", "ali_to", "dom_bits")
    met = _dealt(spark, path, whole_row, ["gene", "family"]).groupBy("gene", "family").agg(F.sort_array(F.collect_list(F.struct("at", *of_hit, *of_domain))).alias("_rows"))
    return met.select("gene", "family", *[F.col("_rows")[0][c].alias(c) for c in of_hit], F.transform("_rows", lambda d: d.dropFields("at", *of_hit)).alias("domains"))


def profile_hits(hits: DataFrame) -> DataFrame:
    """domtblout hits with profile_cov, query_cov (shares covered by the union of domains) and nbits."""
    from cladeframe.functions.exprs import coverage

    spans = lambda lo, hi: F.transform("domains", lambda d: F.struct(d[lo].alias("lo"), d[hi].alias("hi")))
    return hits.withColumns({"profile_cov": coverage(spans("hmm_from", "hmm_to"), F.col("hmm_len")), "query_cov": coverage(spans("ali_from", "ali_to"), F.col("seq_len")), "nbits": F.when(F.col("hmm_len") > 0, F.col("bits") / F.col("hmm_len")).otherwise(F.lit(0.0))})


def tblout(spark: SparkSession, path, max_evalue: float = 1e-5) -> DataFrame:
    """gene, family, evalue: the hit of lowest E-value of each gene; the first row wins a tie."""
    rows = spaced(spark, path).select(field(0).alias("gene"), field(2).alias("family"), field(4, "double").alias("evalue"), "at").where(F.col("evalue") <= max_evalue)
    return _best(spark, path, rows, ["gene"], [F.col("evalue"), F.col("at")])


def complete_chunks(spark: SparkSession, path, expected: int | None = None, sentinel: str = "# [ok]") -> DataFrame:
    """The lines of all chunk files; an error unless their number is as expected and each ends with the sentinel."""
    rows = lines(spark, path)
    last = rows.where(F.trim("value") != "").groupBy("at.file").agg(F.max_by("value", "at").alias("v"))
    n, bad = last.agg(F.count("*"), F.count_if(~F.col("v").startswith(sentinel))).first()
    if bad or (expected is not None and n != expected):
        raise ValueError(f"{n} chunks, {bad} of them incomplete; expected {expected}")
    return rows


def foldseek(spark: SparkSession, path) -> DataFrame:
    """gene, family, evalue, bits, tm: the hit of best TM-score of each gene and family."""
    from cladeframe.functions.ids import target_family

    rows = tabbed(spark, path).select(field(0).alias("gene"), target_family(field(1)).alias("family"), field(2, "double").alias("evalue"), field(3, "double").alias("bits"), field(4, "double").alias("tm"), "at")
    return _best(spark, path, rows.dropna(subset=["evalue", "bits", "tm"]), ["gene", "family"], [F.col("tm").desc(), F.col("at")])


#: Columns of the two wide hit tables.
STRUCTURE_COLUMNS = ("query", "target", "fident", "alnlen", "evalue", "bits", "qstart", "qend", "tstart", "tend", "qtmscore", "taxname")
BLAST_COLUMNS = ("qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")


def hit_table(spark: SparkSession, path, columns: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    rows = tabbed(spark, path).where(F.size("f") >= len(columns))
    out = rows.select(*[field(i, "double" if c in numbers else "string").alias(c) for i, c in enumerate(columns)], "at")
    return out.dropna(subset=list(numbers))


def structure_best(spark: SparkSession, path) -> DataFrame:
    hits = hit_table(spark, path, STRUCTURE_COLUMNS, ("fident", "evalue", "bits", "qtmscore")).withColumn("query", F.replace("query", F.lit(".pdb"), F.lit("")))
    return _best(spark, path, hits, ["query"], [F.col("bits").desc(), F.col("at")])


def blast_best(spark: SparkSession, path, *also: Column) -> DataFrame:
    """The hit of highest bitscore of each query (and of each value of also, named expressions); the first row wins a tie."""
    hits = hit_table(spark, path, BLAST_COLUMNS, ("pident", "evalue", "bitscore")).select("*", *also)
    extra = [c for c in hits.columns if c not in (*BLAST_COLUMNS, "at")]
    return _best(spark, path, hits, ["qseqid", *extra], [F.col("bitscore").desc(), F.col("at")])


def two_columns(spark: SparkSession, path, strip: bool = False) -> DataFrame:
    """key, value; the last row of a key wins."""
    key = without_transcript(field(0)) if strip else field(0)
    rows = tabbed(spark, path).where(F.size("f") >= 2).select(key.alias("key"), field(1).alias("value"), "at")
    return _best(spark, path, rows, ["key"], [F.col("at").desc()])


def emapper(spark: SparkSession, path) -> DataFrame:
    """All columns of an annotation table by its #query header, with ec (first of a list, empty for -) and confidence 0; an error without one."""
    rows = lines(spark, path).where(~F.col("value").startswith("##"))
    head = rows.where(F.col("value").startswith("#query")).agg(F.min_by("value", "at").alias("h")).first()["h"]
    if head is None:
        raise ValueError("no #query header")
    names = head.lstrip("#").split("\t")
    body = rows.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    df = body.select(*[field(i).alias(n) for i, n in enumerate(names)])
    ec = F.split_part(F.coalesce(F.nullif(F.trim("EC"), F.lit("-")), F.lit("")), F.lit(","), F.lit(1)) if "EC" in names else F.lit("")
    return df.withColumnRenamed("query", "gene").withColumns({"ec": ec, "confidence": F.lit(0.0), "is_enzyme": ec != ""})


def clean(spark: SparkSession, path) -> DataFrame:
    """gene, ec, confidence: the candidate of highest confidence, the first of equal ones."""
    rows = lines(spark, path).select(F.split("value", ",", 2).alias("f"), "at").where(F.size("f") == 2)
    cand = rows.select(F.trim(field(0)).alias("gene"), F.posexplode(F.split(field(1), "[;,]")).alias("i", "c"))
    one = cand.select("gene", "i", F.regexp_extract("c", r"EC:([^/]+)/", 1).alias("ec"), F.regexp_extract("c", r"/([0-9.eE+-]+)\s*$", 1).try_cast("double").alias("confidence"))
    return best_hit(one.where("ec <> '' AND confidence IS NOT NULL"), ["gene"], [F.col("confidence").desc(), F.col("i")]).drop("i")


#: Header spellings of enzyme tables, in order of preference, and what counts as yes.
ENZYME_COLUMNS = {"gene": ("id", "protein_id", "gene_id", "sequence_id", "name"), "stage1": ("is_enzyme", "enzyme", "stage1", "enzyme_prediction"), "ec": ("ec", "ec_number", "predicted_ec", "ec_prediction"), "confidence": ("confidence", "score", "probability", "prob")}
YES = ("1", "true", "yes", "enzyme", "y")


def column_named(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    lower = {c.strip().lower(): c for c in reversed(columns)}
    return next((lower[w] for w in wanted if w in lower), None)


def enzymes(spark: SparkSession, path) -> DataFrame:
    """gene, is_enzyme, ec, confidence; without a first-stage column an EC number makes an enzyme."""
    df = spark.read.option("header", True).csv(path)
    at = {k: column_named(df.columns, w) for k, w in ENZYME_COLUMNS.items()}
    if at["gene"] is None:
        raise ValueError("no id column")
    col = lambda k: F.col(f"`{at[k]}`") if at[k] else F.lit(None).cast("string")
    ec = F.coalesce(F.trim(col("ec")), F.lit(""))
    yes = F.lower(F.trim(col("stage1"))).isin(*YES) if at["stage1"] else ec != ""
    return df.select(F.trim(col("gene")).alias("gene"), F.coalesce(yes, F.lit(False)).alias("is_enzyme"), ec.alias("ec"), F.coalesce(col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"))


def localization(spark: SparkSession, path) -> DataFrame:
    """gene, label, signals, probs: every other column that holds numbers is a class probability."""
    df = spark.read.option("header", True).csv(path)
    fixed = {"Protein_ID", "Localizations", "Signals"}
    others = [c for c in df.columns if c not in fixed]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in others]) if others else F.array().cast("array<struct<key:string,value:double>>")
    return df.select(F.col("Protein_ID").alias("gene"), F.col("Localizations").alias("label"), (F.col("Signals") if "Signals" in df.columns else F.lit("")).alias("signals"), F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("probs"))


def signal_peptides(spark: SparkSession, path) -> DataFrame:
    return tabbed(spark, path).select(F.split_part(field(0), F.lit(" "), F.lit(1)).alias("gene"), field(1).alias("prediction"), field(3, "double").alias("sp_prob"))


def isoform_scores(spark: SparkSession, path) -> DataFrame:
    return tabbed(spark, path).select(field(0).alias("isoform"), field(1, "double").alias("score")).where("score IS NOT NULL")


def relax(spark: SparkSession, path) -> DataFrame:
    """file, k, p, lrt, direction: relaxed below k = 1."""
    j = lambda name: F.get_json_object("value", f"$['test results']['{name}']").try_cast("double")
    k = j("relaxation or intensification parameter")
    return whole(spark, path).select("file", k.alias("k"), j("p-value").alias("p"), j("LRT").alias("lrt"), F.when(k < 1, "relaxed").otherwise("intensified").alias("direction"))


def meme_sites(spark: SparkSession, path, max_p: float = 0.05) -> DataFrame:
    """file, site (from 1), p of sites with p up to max_p; the p-value's column is found by its header."""
    heads = F.transform(F.from_json(F.get_json_object("value", "$.MLE.headers"), "array<array<string>>"), lambda h: F.lower(F.get(h, F.lit(0))))
    at = F.array_position(heads, "p-value").cast("int")
    rows = whole(spark, path).select("file", at.alias("p_at"), F.posexplode(F.from_json(F.get_json_object("value", "$.MLE.content['0']"), "array<array<double>>")).alias("i", "row"))
    return rows.where("p_at > 0").select("file", (F.col("i") + 1).alias("site"), F.element_at("row", F.col("p_at")).alias("p")).where(F.col("p") <= max_p)


def absrel_branches(spark: SparkSession, path, max_p: float = 0.05) -> DataFrame:
    """file, branch, p of branches with a corrected p up to max_p."""
    attrs = F.from_json(F.get_json_object("value", "$['branch attributes']['0']"), "map<string,string>")
    rows = whole(spark, path).select("file", F.explode(attrs).alias("branch", "a"))
    return rows.select("file", "branch", F.get_json_object("a", "$['Corrected P-value']").try_cast("double").alias("p")).where(F.col("p") <= max_p)


def beb_sites(spark: SparkSession, path) -> DataFrame:
    """file, site, aa, prob of the Bayes empirical Bayes block: the site lines that follow its header without a break."""
    block = F.regexp_extract("value", r"(?s)Bayes Empirical Bayes.*?Positive sites[^\n]*\n(?:[^\n]*\n)??\s*((?:[ \t]*\d+[ \t]+[A-Z*-][ \t]+[0-9.]+\**[^\n]*\n?)+)", 1)
    rows = whole(spark, path).select("file", F.explode(F.split(block, "\n")).alias("l"))
    part = lambda k: F.regexp_extract("l", r"^\s*(\d+)\s+([A-Z*-])\s+([0-9.]+)", k)
    return rows.where(part(1) != "").select("file", part(1).cast("int").alias("site"), part(2).alias("aa"), part(3).cast("double").alias("prob"))


def log_likelihood(spark: SparkSession, path) -> DataFrame:
    return whole(spark, path).select("file", F.regexp_extract("value", r"lnL\(.*?\):\s*(-?[0-9.]+)", 1).try_cast("double").alias("lnl"))


def jplace(spark: SparkSession, path) -> DataFrame:
    """file, gene, edge_num, likelihood, like_weight_ratio, distal_length, pendant_length, rank; fields in any order, names under n or nm."""
    doc = whole(spark, path).select("file", F.from_json(F.get_json_object("value", "$.fields"), "array<string>").alias("fields"), F.from_json(F.get_json_object("value", "$.placements"), "array<struct<p:array<array<double>>,n:array<string>,nm:array<array<string>>>>").alias("ps"))
    one = doc.select("file", "fields", F.explode("ps").alias("x"))
    names = F.coalesce(F.col("x.n"), F.transform("x.nm", lambda m: F.get(m, F.lit(0))))
    rows = one.select("file", "fields", F.explode(names).alias("gene"), F.col("x.p").alias("p")).select("file", "fields", "gene", F.explode("p").alias("p"))
    value = lambda n: F.element_at("p", F.nullif(F.array_position("fields", n), F.lit(0)).cast("int"))
    out = rows.select("file", "gene", value("edge_num").cast("int").alias("edge_num"), *[value(n).alias(n) for n in ("likelihood", "like_weight_ratio", "distal_length", "pendant_length")])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("file", "gene").orderBy(F.col("like_weight_ratio").desc(), "edge_num")))


def jplace_tree(spark: SparkSession, path) -> DataFrame:
    return whole(spark, path).select("file", F.get_json_object("value", "$.tree").alias("newick"))


def embeddings(spark: SparkSession, path) -> DataFrame:
    return tabbed(spark, path).select(field(0).alias("gene"), F.transform(F.split(field(1), ","), lambda x: x.cast("double")).alias("embedding"))


def pdb_atoms(spark: SparkSession, path) -> DataFrame:
    """file, atom, residue, value (B-factor), at of ATOM rows."""
    sub = lambda a, n: F.trim(F.substring("value", a, n))
    return lines(spark, path).where(F.col("value").startswith("ATOM")).select("at.file", sub(13, 4).alias("atom"), sub(23, 4).try_cast("int").alias("residue"), sub(61, 6).try_cast("double").alias("value"), "at")


def mean_plddt(spark: SparkSession, path) -> DataFrame:
    """file, plddt: mean over CA atoms."""
    return pdb_atoms(spark, path).where("atom = 'CA'").groupBy("file").agg(F.avg("value").alias("plddt"), F.count("*").alias("n_residues"))


def residue_plddt(spark: SparkSession, path) -> DataFrame:
    """file, residue, value of each residue's first atom."""
    return pdb_atoms(spark, path).groupBy("file", "residue").agg(F.min_by("value", "at").alias("value"))


def taxonomy(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def summary_members(spark: SparkSession, path) -> DataFrame:
    """family_id, gene from a summary table's lists."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    return df.select("family_id", F.explode(F.split("gene_list", ",")).alias("gene")).withColumn("gene", F.trim("gene")).where("gene <> ''")


def miniprot(spark: SparkSession, path) -> DataFrame:
    """contig, start, end, strand, identity, rank, anchor, protein: each mRNA with the ##STA line right before it, used once.

    A ##STA line and what follows it up to the next is a record, so files of any size are read in splits.
    """
    # The first record of a file keeps its mark; if it has none, it is what stands before the first ##STA line.
    record = r"^(?:##STA)?\t([^\n]*)\n(?:##[^\n]*\n)*([^\n#]*\tmRNA\t[^\n]*)"
    part = lambda n: F.regexp_extract("value", record, n)
    rows = spark.read.option("lineSep", "\n##STA").text(path).where(F.col("value").rlike(record)).select(part(1).alias("protein"), F.split(part(2), "\t").alias("f"))
    attr = lambda n, p: F.regexp_extract(field(8), rf"(?:^|;){n}=({p})", 1)
    return rows.select(field(0).alias("contig"), field(3, "int").alias("start"), field(4, "int").alias("end"), field(6).alias("strand"), attr("Identity", r"[0-9.]+").try_cast("double").alias("identity"), attr("Rank", r"\d+").try_cast("int").alias("rank"), F.regexp_extract(field(8), r"(?:^|;)Target=([^ ;]+)", 1).alias("anchor"), "protein")


def working_ids(spark: SparkSession, path) -> DataFrame:
    """id, name of `id: name` lines; the name ends at white space."""
    f = F.split("value", ": ", 2)
    return lines(spark, path).where(F.contains("value", F.lit(": "))).select(F.trim(F.get(f, F.lit(0))).alias("id"), F.split_part(F.trim(F.get(f, F.lit(1))), F.lit(" "), F.lit(1)).alias("name"))


def newest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the newest file below a folder whose name fits a glob pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.col("modificationTime").desc(), "path").first()
    return row["path"] if row else None
