"""Segmentation parameters and the values derived from octree depth."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

# Names of the positional parameter file, in file order.
POSITIONAL = (
    "max_ht_distance", "ht_bin_size_factor", "ht_deviation_factor",
    "max_sac_distance", "min_sac_distance", "sac_octree_factor",
    "sac_outlier_ratio", "min_octree_resolution", "sq_dist_factor",
    "phi_resolution", "connection_neighbors", "angle_eps",
    "radius_dev_factor", "tries_on_each_depth", "occupied_ratio",
    "normal_distance_weight",
)

# Service configuration key -> field.
SERVICE_KEYS = {
    "AngleEps": "angle_eps",
    "AngleEpsOnMinOctreeRes": "angle_eps_fine",
    "MinPointsInCC": "min_points_in_cc",
    "MinNodesInCC": "min_nodes_in_cc",
    "TriesOnEachDepth": "tries_on_each_depth",
    "MaxHTDistanceThreshold": "max_ht_distance",
    "HTOctreeBinSizeFactor": "ht_bin_size_factor",
    "HTDistanceDeviationFactor": "ht_deviation_factor",
    "PhiResolution": "phi_resolution",
    "MaxSACDistanceThreshold": "max_sac_distance",
    "MinSACDistanceThreshold": "min_sac_distance",
    "SACOctreeFactor": "sac_octree_factor",
    "SACOutlierRatioThreshold": "sac_outlier_ratio",
    "MinPointsForNormal": "min_points_for_normal",
    "CurvThreshold": "curv_threshold",
    "Curv2Threshold": "curv2_threshold",
    "PrincipalVarFactor": "principal_var_factor",
    "MinOctreeNodes": "min_octree_nodes",
    "MinOctreeResolution": "min_octree_resolution",
    "SqDistFactor": "sq_dist_factor",
    "TexelSizeFactor": "texel_size_factor",
    "DilateIterations": "dilate_iterations",
    "mPclSACmaxIter": "sac_iterations",
    "mOnlyDepth": "only_depth",
    "mPostProcessing": "post_processing",
    "MergePlanesSimilarityFactor": "merge_similarity_factor",
    "NodeToBBDistance": "node_to_box_distance",
    "ConnectionNeighbors": "connection_neighbors",
    "RhoMax": "rho_max",
    "NodeSegmentedRatio": "node_segmented_ratio",
    "MinNodesInCylinder": "min_nodes_in_cylinder",
    "NormalDistanceWeight": "normal_distance_weight",
    "MinRadiusFactor": "min_radius_factor",
    "MaxRadiusFactor": "max_radius_factor",
    "MinCylinderRadius": "min_cylinder_radius",
    "MaxCylinderRadius": "max_cylinder_radius",
    "CylinderBins": "cylinder_bins",
    "CylinderPairNeighbors": "cylinder_pair_neighbors",
    "MidPointBinSizeFactor": "midpoint_bin_size_factor",
    "RadiusDevFactor": "radius_dev_factor",
    "OccupiedRatio": "occupied_ratio",
    "CylinderHeightDev": "cylinder_height_dev",
    "Textures": "textures",
    "Cylinder": "cylinders",
    "PclSAC": "consensus_only",
    "NoRansacStep": "no_ransac_step",
}


@dataclass(frozen=True)
class SegParams:
    """Defaults are the published ones; lengths are metres, angles radians."""

    max_sac_distance: float = 0.05
    min_sac_distance: float = 0.02
    sac_octree_factor: float = 0.1
    sac_outlier_ratio: float = 0.6
    angle_eps: float = math.pi / 10
    angle_eps_fine: float = math.pi / 10
    min_points_in_cc: int = 200
    min_nodes_in_cc: int = 3
    texel_size_factor: float = 2.0
    dilate_iterations: int = 0
    phi_resolution: int = 25
    rho_max: float = 20.0
    max_ht_distance: float = 0.2
    ht_bin_size_factor: float = 2.0
    ht_deviation_factor: float = 1.0
    min_octree_resolution: float = 0.005
    sq_dist_factor: float = 0.002
    min_points_for_normal: int = 15
    curv_threshold: float = 0.1
    curv2_threshold: float = 0.2
    principal_var_factor: float = 0.0
    min_octree_nodes: int = 3
    min_nodes_in_cylinder: int = 20
    tries_on_each_depth: int = 25
    post_processing: int = 3
    merge_similarity_factor: float = 1.0
    node_to_box_distance: float = 0.2
    connection_neighbors: int = 2
    node_segmented_ratio: float = 1.0
    normal_distance_weight: float = 0.1
    min_radius_factor: float = 0.5
    max_radius_factor: float = 10.0
    min_cylinder_radius: float = 0.025
    max_cylinder_radius: float = 1.0
    cylinder_bins: int = 30
    cylinder_pair_neighbors: int = 2
    midpoint_bin_size_factor: float = 0.25
    radius_dev_factor: float = 1.5
    occupied_ratio: float = 0.2
    cylinder_height_dev: float = 0.2
    only_depth: int = 0
    no_ransac_step: bool = False
    textures: bool = False
    cylinders: bool = False
    consensus_only: bool = False
    plane_hypotheses: int = 100
    cylinder_hypotheses: int = 10_000
    sac_iterations: int = 10_000
    include_self_pairs: bool = False
    merge_to_fixpoint: bool = False

    def __post_init__(self):
        if not 2 <= self.phi_resolution <= 500:
            raise ValueError("phi_resolution must lie in 2..500")
        for name in ("plane_hypotheses", "cylinder_hypotheses", "sac_iterations"):
            if not 1 <= getattr(self, name) <= 100_000:
                raise ValueError(f"{name} must lie in 1..100000")
        if self.min_octree_resolution <= 0 or self.rho_max <= 0:
            raise ValueError("resolution and rho_max must be positive")

    @property
    def depth(self) -> int:
        """Depth of the finest octree layer."""
        return max(0, math.ceil(math.log2(2 * self.rho_max / self.min_octree_resolution) - 1e-9))

    def cell_size(self, depth: int) -> float:
        return self.min_octree_resolution * 2.0 ** (self.depth - depth)

    def sac_distance(self, depth: int) -> float:
        scaled = self.sac_octree_factor * self.cell_size(depth)
        return max(self.min_sac_distance, min(self.max_sac_distance, scaled))

    def ht_distance(self, depth: int) -> float:
        return min(self.max_ht_distance, self.ht_bin_size_factor * self.cell_size(depth))

    def radius_limits(self, depth: int) -> tuple[float, float]:
        size = self.cell_size(depth)
        return self.min_radius_factor * size, self.max_radius_factor * size

    def angle_at(self, depth: int) -> float:
        t = depth / self.depth if self.depth else 0.0
        return self.angle_eps * (1 - t) + self.angle_eps_fine * t

    def layers(self) -> range:
        if self.only_depth:
            return range(self.only_depth, self.only_depth + 1)
        return range(0, self.depth + 1)

    def but(self, **changes) -> "SegParams":
        return replace(self, **changes)

    @classmethod
    def from_text(cls, text: str, base: "SegParams | None" = None) -> "SegParams":
        """Positional numbers; a short list keeps the defaults of the tail.

        ``angle_eps_fine`` keeps its default: it is fixed before the file is read.
        """
        base = base or cls()
        kinds = {f.name: type(getattr(base, f.name)) for f in fields(cls)}
        changes = {}
        for name, token in zip(POSITIONAL, text.split()):
            try:
                changes[name] = kinds[name](float(token))
            except ValueError:
                break
        return replace(base, **changes)

    @classmethod
    def from_file(cls, spark, path: str) -> "SegParams":
        rows = spark.read.text(path, wholetext=True).take(1)
        return cls.from_text(rows[0][0]) if rows else cls()

    @classmethod
    def from_service(cls, config: dict) -> "SegParams":
        """Named configuration, keys as the service spells them."""
        base = cls()
        changes = {
            SERVICE_KEYS[k]: type(getattr(base, SERVICE_KEYS[k]))(v)
            for k, v in config.items() if k in SERVICE_KEYS
        }
        return replace(base, **changes)


def depth_rows(p: SegParams) -> list[tuple]:
    """One row per depth: depth, size, sac, ht, r_min, r_max, angle."""
    return [
        (d, p.cell_size(d), p.sac_distance(d), p.ht_distance(d), *p.radius_limits(d), p.angle_at(d))
        for d in range(p.depth + 1)
    ]


DEPTH_SCHEMA = "depth int, size double, sac double, ht double, r_min double, r_max double, angle double"


def depth_table(spark, p: SegParams):
    """``depth_rows`` as a DataFrame; at most some tens of rows by construction."""
    return spark.createDataFrame(depth_rows(p), DEPTH_SCHEMA)


def sweep_table(spark, sets: dict[str, SegParams]):
    """Named parameter sets as rows (``param_set``, one column per field)."""
    names = [f.name for f in fields(SegParams)]
    kinds = {bool: "boolean", int: "bigint", float: "double"}
    base = SegParams()
    schema = "param_set string, " + ", ".join(f"{n} {kinds[type(getattr(base, n))]}" for n in names)
    rows = [(key, *(type(getattr(base, n))(getattr(p, n)) for n in names)) for key, p in sets.items()]
    return spark.createDataFrame(rows, schema)
