"""Identifiers of genes, families and orthogroups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The suffixes that a locus and its isoforms differ by, in the order they are tried.
ISOFORM_SUFFIXES = (".t1", ".1", ".t2", ".2")
#: Formats of names that files and databases give, which results must agree on.
ISOFORM = r"(?:[._]t\d+|\.\d+)$"
DATABASE_MODEL = r"AF-([A-Z0-9]+)(?:-\d+)?-F1"
FILE_SUFFIX = r"\.(pdb|fasta|fa|afa|aln)$"
STRUCTURE_SUFFIX = r"\.(pdb|cif)(\.gz)?$"


def species_of(gene: Column, delimiter: str = "_") -> Column:
    """What stands before the first delimiter; the whole id if there is none."""
    return F.split_part(gene, F.lit(delimiter), F.lit(1))


def dots_folded(gene: Column) -> Column:
    return F.translate(gene, ".", "_")


def canonical(gene: Column) -> Column:
    """Trimmed, without one file suffix, dots as underscores."""
    return dots_folded(F.regexp_replace(F.trim(gene), FILE_SUFFIX, ""))


def without_isoform(gene: Column) -> Column:
    return F.regexp_replace(gene, ISOFORM, "")


def without_transcript(gene: Column) -> Column:
    return F.regexp_replace(gene, r"\.\d+$", "")


def target_family(target: Column) -> Column:
    return F.regexp_replace(target, STRUCTURE_SUFFIX, "")


def accession(target: Column) -> Column:
    """The accession within a structure database's name; an error where there is none."""
    found = F.regexp_extract(target, DATABASE_MODEL, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no accession in "), target)))


def orthogroup_path(run_dir: str, family: Column) -> Column:
    """run_dir/round_NN/orthogroups/OG for a family named R<round>_<OG>; an error for other names."""
    number, og = F.regexp_extract(family, r"^R(\d+)_(.+)$", 1), F.regexp_extract(family, r"^R(\d+)_(.+)$", 2)
    path = F.concat_ws("/", F.lit(run_dir), F.concat(F.lit("round_"), F.lpad(number, 2, "0")), F.lit("orthogroups"), og)
    return F.when(og != "", path).otherwise(F.raise_error(F.concat(F.lit("no round in family "), family)))


def region_bounds(region: Column) -> Column:
    """LO-HI as a struct of two ints."""
    return F.struct(F.split_part(region, F.lit("-"), F.lit(1)).cast("int").alias("lo"), F.split_part(region, F.lit("-"), F.lit(2)).cast("int").alias("hi"))


def variants(gene: Column, species: Column | None = None) -> Column:
    """Spellings under which a gene may be known, in the order they are tried: itself, with a suffix, without one;
    then the same for the id with its species before it."""

    def around(base: Column) -> list[Column]:
        with_suffix = [F.concat(base, F.lit(s)) for s in ISOFORM_SUFFIXES]
        bare = [F.when(base.endswith(s), F.left(base, F.length(base) - F.lit(len(s)))) for s in ISOFORM_SUFFIXES]
        return [base, *with_suffix, *bare]

    forms = around(gene)
    if species is not None:
        prefixed = F.when(species.isNotNull() & (species != "") & ~gene.startswith(F.concat(species, F.lit("_"))), F.concat_ws("_", species, gene))
        forms += around(prefixed)
    return F.array_compact(F.array(*forms))


def first_match(queries: DataFrame, query: str, index: DataFrame, key: str, species: str | None = None) -> DataFrame:
    """queries joined with index on the first spelling of query that index.key has; unmatched ones keep nulls.

    index.key must be unique. Adds matched (the spelling) and index's other columns.
    """
    from cladeframe.operators.topk import best_hit

    forms = variants(F.col(query), F.col(species) if species else None)
    tried = queries.select(query, F.posexplode(forms).alias("_order", "matched")).distinct()
    hits = best_hit(tried.join(index.withColumnRenamed(key, "matched"), "matched"), [query], [F.col("_order")])
    return queries.join(hits.drop("_order"), query, "left")


def index_of(reference: DataFrame, column: str, transform) -> DataFrame:
    """key, id for each id; an error where two different ids meet on a key."""
    keyed = reference.select(transform(F.col(column)).alias("key"), F.col(column).alias("id")).distinct()
    once = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    clash = F.raise_error(F.concat(F.lit("ids collide on "), F.col("key"))).cast("string")
    return once.select("key", F.when(F.col("_n") > 1, clash).otherwise(F.col("id")).alias("id"))


LEVELS = (("exact", lambda c: c), ("canonical", canonical), ("isoform", lambda c: without_isoform(canonical(c))))


def matched_ids(queries: DataFrame, query: str, reference: DataFrame, column: str, max_unmatched: float | None = None) -> tuple[DataFrame, str, float]:
    """All of queries matched at one level: the first of exact, canonical and isoform that leaves none
    unmatched, else the last. Returns (query, id or null), the level, and the share left unmatched."""
    total = queries.count()
    for level, transform in LEVELS:
        index = index_of(reference, column, transform)
        out = queries.select(query, transform(F.col(query)).alias("key")).join(index, "key", "left").select(query, "id")
        missing = out.where("id IS NULL").count()
        if missing == 0:
            break
    share = missing / total if total else 0.0
    if max_unmatched is not None and share > max_unmatched:
        raise ValueError(f"{missing} of {total} ids have no match")
    return out, level, share
