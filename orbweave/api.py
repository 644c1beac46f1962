"""The functions of the library surface, DataFrame to DataFrame."""

from __future__ import annotations

from .operators.consistency import consistency_edges as consistent_correspondences
from .operators.consistency import max_weight_clique as maximum_weight_clique
from .operators.descriptors import fpfh as compute_fpfh
from .operators.descriptors import pch as compute_pch
from .operators.knn import knn as knn_search
from .operators.knn import reverse_knn
from .operators.matching import match_planes as pch_matching
from .operators.matching import mutual_nearest as mutual_correspondences
from .operators.matching import plane_groups as group_planes
from .operators.neighbors import narrow as filter_neighborhoods
from .operators.neighbors import neighborhoods as compute_neighborhoods
from .operators.pose import estimate as compute_transformation
from .operators.segmentation import region_roots, supports
from .operators.surface import fit_planes as compute_plane
from .operators.surface import point_normals as compute_normals
from .operators.surface import stable_points


def segment_planes(points, normals, neighbors, thickness: float, dispersion_sin: float, min_support: int, excluded=None):
    """(cloud_id, plane_id, pid) of the planes of each cloud."""
    stable = stable_points(neighbors, normals, dispersion_sin, excluded)
    return supports(region_roots(points, normals, neighbors, stable, thickness, dispersion_sin), min_support)


__all__ = [
    "compute_fpfh", "compute_neighborhoods", "compute_normals", "compute_pch", "compute_plane", "compute_transformation",
    "consistent_correspondences", "filter_neighborhoods", "group_planes", "knn_search", "maximum_weight_clique", "mutual_correspondences", "pch_matching", "reverse_knn", "segment_planes",
]
