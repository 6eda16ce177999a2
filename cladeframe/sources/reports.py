"""Sinks: tables for people and tools. Numbers are formatted here and nowhere before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fasta_lines(df: DataFrame, id_col: str, seq: str, wrap: int = 80) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace(F.col(seq), f"(.{{{wrap}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq: str = "seq", wrap: int = 80) -> None:
    fasta_lines(df, id_col, seq, wrap).write.mode("overwrite").text(path)


def split_by_species(df: DataFrame, path: str, species: str = "species", id_col: str = "id", seq: str = "seq") -> None:
    """One folder of FASTA per species; what was there before goes."""
    rows = df.select(species, F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq)).alias("value"))
    rows.write.mode("overwrite").partitionBy(species).text(path)


def tsv(df: DataFrame, path: str, null: str = "NA") -> None:
    """Any table, arrays joined by commas, nulls written as given."""
    cols = [(F.array_join(c, ",") if t.startswith("array") else F.col(c)).alias(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", null).csv(path)


def summary(families: DataFrame, family: str, gene: str, species: str) -> DataFrame:
    """family, n_genes, n_species, gene_list (sorted). Members of a family are a tool's bounded input."""
    return families.groupBy(family).agg(F.countDistinct(gene).alias("n_genes"), F.countDistinct(species).alias("n_species"), F.array_join(F.array_sort(F.collect_set(gene)), ",").alias("gene_list"))


def wide_groups(members: DataFrame, group: str, species: str, gene: str, order: list[str]) -> DataFrame:
    """One row per group and a column per species in the order given, genes joined by a comma and a space; other species are left out."""
    known = members.where(F.col(species).isin(order))
    return known.groupBy(group).pivot(species, order).agg(F.array_join(F.array_sort(F.collect_list(gene)), ", ")).na.fill("")


def singletons(all_genes: DataFrame, members: DataFrame, gene: str, prefix: str = "UNG") -> DataFrame:
    """gene, group: genes in no group, each numbered as a group of its own in order of name."""
    from cladeframe.operators.sets import orphans

    left = orphans(all_genes.select(gene).distinct(), members, gene)
    # Numbers are counted per 4-character head of the name first, so that no single task sorts all genes.
    head = left.withColumn("_h", F.left(F.col(gene), F.lit(4)))
    before = head.groupBy("_h").agg(F.count("*").alias("_n")).selectExpr("_h", "sum(_n) OVER (ORDER BY _h) - _n AS _b")
    number = F.col("_b") + F.row_number().over(Window.partitionBy("_h").orderBy(gene)) - 1
    return head.join(before, "_h").select(gene, F.format_string(f"{prefix}%07d", number).alias("group"))


def partitions(loci: DataFrame, name: str = "locus", kind: str = "DNA") -> DataFrame:
    return loci.select(F.format_string(f"{kind}, %s = %d-%d", F.col(name), F.col("start"), F.col("end")).alias("value"))


def transfer(best: DataFrame, annotation: DataFrame, accession: str) -> DataFrame:
    """Structure hits with what is known of their target; long term lists are cut to 200 characters."""
    return best.join(annotation.withColumn("go_ids", F.left(F.col("go_ids"), F.lit(200))), accession, "left")


def narrative(family: str, subfamily: str, verdict: dict) -> str:
    """A short text of a selection verdict with what speaks for and against it."""
    lines = [f"# {family} / {subfamily}: {verdict['verdict']}", ""]
    for title, key in (("Evidence for", "evidence_for"), ("Evidence against", "evidence_against")):
        lines += [f"## {title}", *(f"- {x}" for x in verdict[key] or ["none"]), ""]
    return "\n".join(lines)


def write_embeddings(df: DataFrame, path: str, gene: str = "gene", embedding: str = "embedding") -> None:
    """A gene and its numbers, joined by commas, a line; numbers are written so that reading gives the same doubles."""
    numbers = F.array_join(F.transform(embedding, lambda x: x.cast("double").cast("string")), ",")
    df.select(F.concat_ws("\t", gene, numbers).alias("value")).write.mode("overwrite").text(path)
