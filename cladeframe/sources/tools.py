"""External tools behind one adapter: a command template that runs next to the data, only where it is configured.

Without a command the tool's output is read as a table like any other; see text.py for the formats.
"""

from __future__ import annotations

import logging
import re
import shlex
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    """name, the template ({input}, {output}, {threads} and others of its own), and its limits."""

    name: str
    template: str = ""
    timeout: int = 1800
    defaults: dict = field(default_factory=dict)

    @property
    def configured(self) -> bool:
        return bool(self.template.strip())

    def argv(self, **values) -> list[str]:
        if not self.configured:
            raise ValueError(f"{self.name} has no command")
        return [part.format(**(self.defaults | values)) for part in shlex.split(self.template)]

    def run(self, **values) -> None:
        done = subprocess.run(self.argv(**values), capture_output=True, text=True, timeout=self.timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.name}: exit {done.returncode}: {done.stderr[-500:]}")


#: Flags that the driver of a clustering run sets itself; they may not come from extra arguments.
CLUSTERING_RESERVED = ("-f", "-o", "-b", "-t", "-a", "-S", "-og", "-n", "-fg")


def clustering_command(binary: str, input_dir: str, output_dir: str, threads: int, extra: list[str] | None = None, resume_from: str | None = None) -> list[str]:
    """An orthogroup run's arguments; a run that continues an earlier one names neither input nor output."""
    bad = [x for x in extra or [] if x in CLUSTERING_RESERVED]
    if bad:
        raise ValueError(f"reserved flags {bad}")
    where = ["-b", resume_from] if resume_from else ["-f", input_dir, "-o", output_dir]
    return [binary, *where, "-t", str(threads), "-a", str(threads), "-og", *(extra or [])]


ALIGN_MODES = {"auto": ["--auto"], "linsi": ["--localpair", "--maxiterate", "1000"], "ginsi": ["--globalpair", "--maxiterate", "1000"]}


def align_command(binary: str, mode: str, path: str, threads: int) -> list[str]:
    return [binary, *ALIGN_MODES.get(mode, ALIGN_MODES["auto"]), "--thread", str(threads), path]


def tree_command(builder: str, path: str, nucleotide: bool, binary: str | None = None) -> list[str]:
    if builder == "fasttree":
        return [binary or "FastTree", *(["-nt", "-gtr"] if nucleotide else []), "-gamma", path]
    if builder == "iqtree":
        return [binary or "iqtree2", "-s", path, "-m", "GTR+G" if nucleotide else "LG+G", "-bb", "1000"]
    raise ValueError(f"unknown tree builder {builder}")


def profile_build_command(binary: str, name: str, profile: str, alignment: str) -> list[str]:
    return [binary, "-n", name, "--amino", profile, alignment]


def profile_press_command(binary: str, profiles: str) -> list[str]:
    return [binary, "-f", profiles]


def profile_search_command(binary: str, profiles: str, fasta: str, table: str, evalue: float, threads: int, by_domain: bool = True) -> list[str]:
    """A search of profiles against sequences; more than eight threads don't help it."""
    return [binary, "--domtblout" if by_domain else "--tblout", table, "-E", str(evalue), "--cpu", str(min(threads, 8)), "--noali", profiles, fasta]


def add_queries_command(aligner: str, binary: str, reference: str, queries: str, profile: str | None = None) -> list[str]:
    """Queries put into a reference alignment."""
    if aligner == "hmmalign":
        return [binary, "--outformat", "afa", "--mapali", reference, profile or "", queries]
    if aligner == "mafft":
        return [binary, "--add", queries, "--keeplength", reference]
    raise ValueError(f"unknown aligner {aligner}")


def split_alignment_command(binary: str, reference: str, combined: str, folder: str) -> list[str]:
    return [binary, "--split", reference, combined, "--outdir", folder]


def placement_command(binary: str, tree: str, reference: str, queries: str, model: str, folder: str, threads: int) -> list[str]:
    return [binary, "--tree", tree, "--ref-msa", reference, "--query", queries, "--model", model, "--outdir", folder, "-T", str(threads)]


def outlier_command(binary: str, tree: str, folder: str, quantile: float = 0.05) -> list[str]:
    return [binary, "-t", tree, "-q", str(quantile), "-o", folder]


def structure_db_command(binary: str, fasta: str, db: str, model: str, threads: int) -> list[str]:
    """Structure letters predicted from sequences; the model is a folder."""
    if Path(model).is_file():
        raise ValueError(f"{model} is a file, not a folder of weights")
    return [binary, "createdb", fasta, db, "--prostt5-model", model, "--threads", str(threads)]


@dataclass(frozen=True)
class JointReference:
    """What placements are made into: a tree, its alignment, the model's file, and the families on its edges."""

    name: str
    tree: str
    alignment: str
    model: str
    families: tuple[str, ...] = ()


def quoted(path: str) -> str:
    """A path for a shell; a leading ~ stays for it to expand."""
    head, sep, tail = path.partition("/")
    if head.startswith("~") and re.fullmatch(r"~[A-Za-z0-9_.-]*", head):
        return head + sep + (shlex.quote(tail) if tail else "")
    return shlex.quote(path)


#: Site classes of the site models, and the starting rates of the branch-site runs.
SITE_MODELS = {"M0": 0, "M1a": 1, "M2a": 2, "M7": 7, "M8": 8}
START_OMEGAS = (0.5, 1.5, 3.0)


def codeml_control(seqfile: str, treefile: str, outfile: str, model: str = "M0", branch_site: str | None = None, omega: float = 0.5) -> str:
    """Control file of a site model, or of the branch-site test (branch_site: null or alternative)."""
    null = branch_site == "null"
    values = {
        "seqfile": seqfile, "treefile": treefile, "outfile": outfile, "runmode": 0, "seqtype": 1, "CodonFreq": 2, "clock": 0,
        "model": 2 if branch_site else 0, "NSsites": 2 if branch_site else SITE_MODELS[model],
        "icode": 0, "fix_kappa": 0, "kappa": 2, "fix_omega": int(null), "omega": 1 if null else omega, "cleandata": 0,
    }
    return "".join(f"{k:>12} = {v}\n" for k, v in values.items())


def phylip(sequences: dict[str, str]) -> str:
    lengths = {len(s) for s in sequences.values()}
    if len(lengths) != 1:
        raise ValueError("sequences of different lengths")
    return f" {len(sequences)} {lengths.pop()}\n" + "".join(f"{k}  {s}\n" for k, s in sequences.items())


def per_group(df: DataFrame, keys: list[str], tool: Tool, write: Callable[[pd.DataFrame, Path], None], read: Callable[[Path], pd.DataFrame], schema: str) -> DataFrame:
    """Run a tool once for each group of rows, on the executor that holds it. schema: the keys, the columns read returns, and error.

    A group whose run fails yields one row with the reason in error and nulls elsewhere, so that it can be recycled; no group is lost.
    A group is what the tool reads at once, so its size is the tool's limit: filter larger ones before.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        with tempfile.TemporaryDirectory() as d:
            source, result = Path(d, "input"), Path(d, "output")
            try:
                write(pdf, source)
                tool.run(input=source, output=result)
                out = read(result)
                out["error"] = None
            except Exception as e:  # the reason travels with the group
                out = pd.DataFrame([{"error": f"{type(e).__name__}: {e}"}])
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        out = out.reindex(columns=names).astype(object)
        return out.where(out.notna(), None)

    return df.groupBy(*keys).applyInPandas(run, schema)


@dataclass(frozen=True)
class Axis:
    """One annotation axis: its command, what it writes and what it needs."""

    name: str
    command: str
    output: str
    needs: tuple[str, ...] = ()


AXES = {
    "emapper": ("emapper.py -i {fasta} -o {dir}/emapper", "emapper.emapper.annotations", ()),
    "clean": ("CLEAN_infer --fasta {fasta} --out {dir}/clean", "clean_maxsep.csv", ()),
    "deeploc": ("deeploc2 -f {fasta} -o {dir}/deeploc -m Accurate", "deeploc.csv", ()),
    "signalp": ("signalp6 --fastafile {fasta} --output_dir {dir}/signalp --mode fast", "signalp.txt", ()),
    "foldseek": ("foldseek easy-search {structures} {target_db} {dir}/foldseek.tsv {dir}/tmp", "foldseek.tsv", ("structures",)),
}


def plan(fasta: str, folder: str, axes: list[str] | None = None, structures: str | None = None, target_db: str = "target", drop_unavailable: bool = False) -> list[Axis]:
    """The axes to run, in order; those whose inputs are missing are kept for missing_inputs() or dropped."""
    unknown = sorted(set(axes or []) - set(AXES))
    if unknown:
        raise ValueError(f"unknown axes {unknown}")
    out = []
    for name in axes or list(AXES):
        command, output, needs = AXES[name]
        lacking = tuple(n for n in needs if n == "structures" and not structures)
        if lacking and drop_unavailable:
            continue
        values = {"fasta": shlex.quote(fasta), "dir": shlex.quote(folder), "structures": shlex.quote(structures or ""), "target_db": shlex.quote(target_db)}
        out.append(Axis(name, command.format(**values), f"{folder}/{output}", lacking))
    return out


def missing_inputs(axes: list[Axis]) -> dict[str, str]:
    return {a.name: ", ".join(a.needs) for a in axes if a.needs}


def local_outputs(axes: list[Axis], folder: str) -> list[Axis]:
    """The plan with its outputs in another folder, as after a copy."""
    return [Axis(a.name, a.command, f"{folder}/{Path(a.output).name}", a.needs) for a in axes]


def chunked(lines: Iterator[str], starts: str, size: int) -> Iterator[list[str]]:
    """Records that start with a mark, in chunks of size records, in order."""
    chunk: list[str] = []
    n = 0
    for line in lines:
        if line.startswith(starts):
            if n == size:
                yield chunk
                chunk, n = [], 0
            n += 1
        chunk.append(line)
    if chunk:
        yield chunk


def whole_results(spark: SparkSession, folder: str, expected: int | None = None, end: str = "# [ok]") -> DataFrame:
    """file, value: the lines of a folder's result files, if each ends with the mark of a finished run and all are there; else ValueError."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    state = rows.agg(F.count("*").alias("n"), F.count_if(~F.rtrim(F.regexp_replace("value", r"\s+$", "")).endswith(end)).alias("bad")).first()
    if state["bad"] or (expected is not None and state["n"] != expected):
        raise ValueError(f"{state['n']} result files, {state['bad']} of them unfinished; expected {expected}")
    return rows.select("file", F.explode(F.split("value", "\n")).alias("value")).where("value <> ''")


def logging_to(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The engine's log on the console and in a file; repeated calls add no second handler. Executors log by Spark."""
    log = logging.getLogger("cladeframe")
    log.setLevel(level)
    have = {getattr(h, "baseFilename", "") for h in log.handlers}
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    wanted = [("", logging.StreamHandler)] + ([(str(Path(path).resolve()), lambda: logging.FileHandler(path))] if path else [])
    for name, make in wanted:
        if name not in have:
            handler = make()
            handler.setFormatter(form)
            log.addHandler(handler)
    return log
