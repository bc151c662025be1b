"""Every constant of the pipeline, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.01
    bin_size: int = 100
    max_intron: int = 100_000
    min_exon: int = 3
    max_exon: int = 10_000
    site_distance: int = 500
    max_gap_bases: int = 50
    strand_fraction: float = 0.5
    overlap_ratio: float = 0.4
    shared_intron_ratio: float = 0.1
    junction_flank: int = 8
    short_junction_reads: int = 2
    short_boundary_reads: int = 5
    long_junction_reads: int = 4
    long_boundary_reads: int = 2
    junction_ratio: float = 0.06
    retained_limit: float = 0.3
    long_filter_depth: int = 30
    slide: int = 20
    segment_fraction: float = 0.5
    minor_phi: float = 0.3
    major_phi: float = 0.7
    minor_ratio: float = 0.5
    max_events: int = 50
    max_paths: int = 200
    cluster_length: int = 20
    density_rise: float = 4.0
    cluster_reads: int = 5


DEFAULT = Settings()
