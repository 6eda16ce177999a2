"""Settings that decide results. Control plane only: operators take plain arguments."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, fields


@dataclass
class Settings:
    """Thresholds that results depend on, by group."""

    # rounds
    max_rounds: int = 10
    min_orthogroup_size: int = 4
    min_family_size: int = 2
    convergence_threshold: int = 5
    convergence_no_new_families: int = 2
    # pruning
    prune_criterion: str = "relative"
    prune_absolute: float = 5.0
    prune_relative: float = 3.0
    prune_floor: float = 2.0
    prune_min_species: int = 3
    prune_min_leaves: int = 3
    # profile assignment
    max_evalue: float = 1e-5
    min_profile_cov: float = 0.5
    min_query_cov: float = 0.4
    margin_bits: float = 10.0
    margin_fraction: float = 0.05
    reassign_nbits: float = 0.15
    reassign_profile_cov: float = 0.6
    merge_reciprocal: float = 0.6
    merge_profile_cov: float = 0.5
    max_candidates: int = 5
    # structures
    low_plddt: float = 50.0
    min_tm: float = 0.5
    tm_margin: float = 0.05
    embedding_delta: float = 0.02
    # placements
    min_lwr: float = 0.2
    lwr_margin: float = 0.0
    min_query_length: int = 150
    max_pendant: float = 0.0
    # pseudogenes
    length_tolerance: float = 0.1
    truncation: float = 0.5
    zscore: float = 3.0
    zscore_min_n: int = 20
    distance_ratio: float = 3.0
    # subfamilies
    sdp_min_group: int = 5
    sdp_in_cons: float = 0.8
    sdp_out_max: float = 0.2
    min_cover: float = 0.7
    invariant: float = 0.95
    n_null: int = 1000
    seed: int = 0
    # annotation
    clean_conf: float = 0.5
    foldseek_qtm: float = 0.6
    weight_direct: float = 1.0
    weight_orthology: float = 0.5
    alpha: float = 0.05
    expression_dominance: float = 0.5
    id_delimiter: str = "_"
    # clustering, trees and tools
    clustering_method: str = "orthofinder"
    tree_builder: str = "fasttree"
    epa_aggregate: str = "edge"
    threads: int = 8

    @classmethod
    def from_json(cls, path: str) -> Settings:
        """Unknown keys are named in a warning and left out."""
        with open(path) as f:
            given = json.load(f)
        known = {x.name for x in fields(cls)}
        for key in sorted(set(given) - known):
            logging.getLogger(__name__).warning("unknown setting %s", key)
        return cls(**{k: v for k, v in given.items() if k in known})

    def to_json(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2, sort_keys=True)
