"""Whole segmentations as compositions of the plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import raster
from ..params import SegParams
from . import cylinders, planes, post
from .book import Book, stack


@dataclass
class Segmentation:
    structures: DataFrame | None
    assignment: DataFrame | None  # scan_id, pid, structure_id
    cells: DataFrame | None = None
    textures: tuple | None = None  # sizes, colour, height and normal rasters, where the parameters ask for them


def _result(book: Book, key: str) -> Segmentation:
    rows = stack(book.assignment)
    if rows is not None:
        rows = rows.withColumnRenamed(key, "structure_id").select("scan_id", "pid", "structure_id")
    return Segmentation(book.structures, rows, book.cells)


def segment_planes(points: DataFrame, p: SegParams) -> Segmentation:
    """Extraction, then merge (bit 1), spread (bit 2) and merge again (bit 4)."""
    book, keyed, nodes = planes.extract_planes(points, p)
    merge = post.merge_to_fixpoint if p.merge_to_fixpoint else post.merge_planes
    if p.post_processing & 1:
        book = merge(book, keyed, p)
    if p.post_processing & 2:
        book = post.spread_nodes(book, nodes, keyed, p)
    if p.post_processing & 4:
        book = merge(book, keyed, p)
    return _result(book, "plane_id")


def segment_cylinders(points: DataFrame, p: SegParams) -> Segmentation:
    return _result(cylinders.extract_cylinders(points, p)[0], "cylinder_id")


def segment(points: DataFrame, p: SegParams) -> Segmentation:
    """Planes or cylinders, by octree votes or by consensus only, as the parameters say."""
    if p.consensus_only:
        if p.cylinders:
            return _result(cylinders.peel_cylinders(points, p), "cylinder_id")
        return _result(planes.peel_planes(points, p), "plane_id")
    if p.cylinders:
        return segment_cylinders(points, p)
    seg = segment_planes(points, p)
    if p.textures and seg.structures is not None:
        seg.textures = textures(points, seg, p)
    return seg


def textures(points: DataFrame, seg: Segmentation, p: SegParams):
    """Raster sizes, colour, height and normal rasters of the extracted planes."""
    member = points.join(seg.assignment.withColumnRenamed("structure_id", "plane_id"), ["scan_id", "pid"])
    return raster.plane_textures(member, seg.structures, p.texel_size_factor, p.dilate_iterations)
