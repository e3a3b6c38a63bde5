"""Column builders for planes, cylinders, rotations and circles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import V, add, clamp, cross, dot, mul, norm, ratio, sub, unit, v

# Fixed value: single-precision machine epsilon, the collinearity threshold.
EPS32 = 1.1920928955078125e-07


# --- planes: n·p = d -------------------------------------------------------

def signed_distance(p, n, d: Column) -> Column:
    return dot(n, p) - d


def plane_distance(p, n, d: Column) -> Column:
    return F.abs(signed_distance(p, n, d))


def near_plane(p, n, d: Column, limit) -> Column:
    return plane_distance(p, n, d) <= limit


def normals_agree(n, m, angle: float) -> Column:
    return F.abs(dot(n, m)) > F.lit(math.cos(angle))


def project_on_plane(p, n, d: Column) -> V:
    return sub(p, mul(n, signed_distance(p, n, d)))


def frame(n) -> tuple[V, V, V]:
    """Rows of the rotation that turns the unit vector n onto +z."""
    antipode = n[2] < F.lit(-1.0 + EPS32)
    k = F.lit(1.0) / (F.lit(1.0) + F.when(antipode, F.lit(0.0)).otherwise(n[2]))
    off = -n[0] * n[1] * k

    def pick(flipped: float, c: Column) -> Column:
        return F.when(antipode, F.lit(flipped)).otherwise(c)

    return (
        V(pick(-1.0, n[2] + n[1] * n[1] * k), pick(0.0, off), pick(0.0, -n[0])),
        V(pick(0.0, off), pick(1.0, n[2] + n[0] * n[0] * k), pick(0.0, -n[1])),
        V(pick(0.0, n[0]), pick(0.0, n[1]), pick(-1.0, n[2])),
    )


def frame_columns(n, prefix: str = "r") -> dict[str, Column]:
    """Nine columns r00..r22 holding ``frame(n)``."""
    return {f"{prefix}{i}{j}": c for i, row in enumerate(frame(n)) for j, c in enumerate(row)}


def frame_from(prefix: str = "r") -> tuple[V, V, V]:
    return tuple(V(*(F.col(f"{prefix}{i}{j}") for j in range(3))) for i in range(3))


def to_frame(p, origin, rows) -> V:
    q = sub(p, origin)
    return V(*(dot(r, q) for r in rows))


def from_frame(q, origin, rows) -> V:
    back = V(*(rows[0][j] * q[0] + rows[1][j] * q[1] + rows[2][j] * q[2] for j in range(3)))
    return add(back, origin)


def to_plane(p, n, d: Column, rows) -> V:
    """Plane coordinates: in-plane u, v and the signed height."""
    return to_frame(p, mul(n, d), rows)


def from_plane(q, n, d: Column, rows) -> V:
    return from_frame(q, mul(n, d), rows)


def with_rotation(df: DataFrame, a, b, axis: str, angle: str | None = None) -> DataFrame:
    """Add the axis (three columns) and angle turning a onto b, with both collinear cases."""
    df = df.withColumns({"_aa": dot(a, a), "_bb": dot(b, b), "_ab": dot(a, b), **{
        "_c" + k: c for k, c in zip("xyz", cross(a, b))}})
    df = df.withColumn("_cos", ratio(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))))
    x = F.col("_cos")
    same, opposed = x - 1 > F.lit(-EPS32), x + 1 < F.lit(EPS32)
    along_x = F.col("_aa") - a[0] * a[0] < F.lit(EPS32)
    # helper axis of the collinear cases: a x (0,1,0) or a x (1,0,0)
    zero = F.lit(0.0)
    spare = V(F.when(along_x, -a[2]).otherwise(zero), F.when(along_x, zero).otherwise(a[2]),
              F.when(along_x, a[0]).otherwise(-a[1]))
    df = df.withColumns({"_same": same, "_opp": opposed})
    df = df.withColumns({"_c" + k: F.when(F.col("_same") | F.col("_opp"), s).otherwise(F.col("_c" + k))
                         for k, s in zip("xyz", spare)})
    df = df.withColumn("_cn", norm(v("_c")))
    out = {axis + k: ratio(F.col("_c" + k), F.col("_cn")) for k in "xyz"}
    if angle:
        wide = F.lit(math.pi) - 2 * F.asin(clamp(0.5 * norm(add(a, b)), 0.0, 1.0))
        narrow = 2 * F.asin(clamp(0.5 * norm(sub(a, b)), 0.0, 1.0))
        out[angle] = (F.when(F.col("_same"), zero).when(F.col("_opp"), F.lit(math.pi))
                      .when(x < 0, wide).otherwise(narrow))
    df = df.withColumns(out)
    return df.drop("_aa", "_bb", "_ab", "_cos", "_same", "_opp", "_cn", "_cx", "_cy", "_cz")


def rodrigues(axis, angle: Column) -> tuple[V, V, V]:
    c, s = F.cos(angle), F.sin(angle)
    k = 1 - c
    x, y, z = axis
    return (
        V(c + x * x * k, x * y * k - z * s, x * z * k + y * s),
        V(y * x * k + z * s, c + y * y * k, y * z * k - x * s),
        V(z * x * k - y * s, z * y * k + x * s, c + z * z * k),
    )


def toward_viewpoint(vec, ray) -> V:
    """Flip vec when it points along the viewing ray."""
    away = dot(ray, vec) > 0
    return V(*(F.when(away, -c).otherwise(c) for c in vec))


def angle_between_deg(a, b) -> Column:
    """Acute angle in degrees; exactly opposed vectors give 180."""
    arc = ratio(dot(a, b), norm(a) * norm(b))
    return (F.when(F.abs(arc) < 1, F.degrees(F.acos(clamp(F.abs(arc), 0.0, 1.0))))
            .when(arc >= 1, F.lit(0.0)).otherwise(F.lit(180.0)))


def polar_angle(phi1, theta1, phi2, theta2) -> Column:
    """Angle between two directions given as (azimuth, inclination)."""
    a = V(F.cos(phi1) * F.sin(theta1), F.sin(phi1) * F.sin(theta1), F.cos(theta1))
    b = V(F.cos(phi2) * F.sin(theta2), F.sin(phi2) * F.sin(theta2), F.cos(theta2))
    return F.acos(clamp(dot(a, b), -1.0, 1.0))


def middle_plane(n1, c1, d1, n2, c2, d2):
    """Bisecting plane of two planes with centroids c1, c2: (normal, signed distance).

    With both normals turned to the viewpoint, its points have equal signed distance to
    both planes: a.x - da = b.x - db.  Null for planes of one orientation.
    """
    turned = []
    for n, c, d in ((n1, c1, d1), (n2, c2, d2)):
        sign = F.when(dot(n, c) > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        turned.append((mul(n, sign), d * sign))
    (a, da), (b, db) = turned
    gap = sub(a, b)
    return unit(gap, norm(gap)), ratio(da - db, norm(gap))


def box_distance(q, lo, hi) -> Column:
    """Distance of q to an axis-aligned box, zero inside."""
    zero = F.lit(0.0)
    gap = V(*(F.greatest(l - c, c - h, zero) for c, l, h in zip(q, lo, hi)))
    return norm(gap)


# --- cylinders -------------------------------------------------------------

def axis_distance(p, on_axis, axis) -> Column:
    """Distance to the line through on_axis along the unit vector axis."""
    return norm(cross(sub(p, on_axis), axis))


def surface_distance(p, on_axis, axis, radius: Column) -> Column:
    return axis_distance(p, on_axis, axis) - radius


def near_cylinder(p, on_axis, axis, radius: Column, limit) -> Column:
    return F.abs(surface_distance(p, on_axis, axis, radius)) < limit


def radial_cosine(p, m, on_axis, axis) -> Column:
    """|cos| between the in-plane part of normal m (not renormalised) and the radial direction."""
    q = sub(p, on_axis)
    radial = sub(q, mul(axis, dot(q, axis)))
    return F.abs(ratio(dot(radial, m), norm(radial)))


def cylinder_normal_ok(p, m, on_axis, axis, angle: float) -> Column:
    return radial_cosine(p, m, on_axis, axis) >= F.lit(math.cos(angle))


def project_on_cylinder(q, radius: Column) -> V:
    """Cylinder coordinates q moved radially onto the surface."""
    k = ratio(radius, F.sqrt(q[0] * q[0] + q[1] * q[1]))
    return V(q[0] * k, q[1] * k, q[2])


def height_ok(h: Column, lo: Column, hi: Column, slack: float) -> Column:
    height = F.abs(hi - lo)
    return (h < hi + slack * height) & (h > lo - slack * height)


def radius_ok(radius: Column, lo: float, hi: float) -> Column:
    return (radius > lo) & (radius < hi)


def det2(a, b) -> Column:
    """Determinant of two 2-D vectors."""
    return a[0] * b[1] - a[1] * b[0]


def circle_from_pair(a, na, b, nb, tolerance) -> dict[str, Column]:
    """Circle through two oriented 2-D points; null centre for parallel normals.

    The centre is where the normal lines meet; each point has its own distance to it, and
    the radius is their mean.
    """
    step = ratio(det2((a[0] - b[0], a[1] - b[1]), na), det2(nb, na))
    centre = (b[0] + step * nb[0], b[1] + step * nb[1])
    to_a, to_b = (F.hypot(centre[0] - q[0], centre[1] - q[1]) for q in (a, b))
    return {"cx": centre[0], "cy": centre[1], "radius": (to_a + to_b) / 2,
            "stable": F.coalesce(F.abs(to_a - to_b) / 2 < tolerance, F.lit(False))}


def with_pair_axis(df: DataFrame) -> DataFrame:
    """Pair rows (a_*, b_*) with the axis between their normals, larger curvature and point sum."""
    df = with_rotation(df, v("a_n"), v("b_n"), "cross_")
    return df.withColumns({"curv": F.greatest("a_curv", "b_curv"), "n": F.col("a_n") + F.col("b_n")})


def pair_convex(pa, na, pb, nb, axis, angle: float) -> Column:
    """Optional convexity test of a node pair."""
    link = sub(pb, pa)
    flat = sub(link, mul(axis, dot(link, axis)))
    w = unit(flat, norm(flat))
    return F.abs(dot(na, w) + dot(nb, w)) > F.lit(math.cos(angle))


# --- outlines and sizes ----------------------------------------------------

def _vertex(p) -> Column:
    return F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))


def rectangle_vertices(n, d, rows, umin, umax, vmin, vmax) -> Column:
    corners = ((umin, vmin), (umin, vmax), (umax, vmax), (umax, vmin))
    return F.array(*(_vertex(from_plane(V(u, w, F.lit(0.0)), n, d, rows)) for u, w in corners))


# Corner order of an oriented box (0 = low side, 1 = high side).
BOX_ORDER = ((0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1), (0, 0, 1), (0, 1, 1))


def box_vertices(n, d, rows, lo, hi) -> Column:
    pick = ((lo[0], hi[0]), (lo[1], hi[1]), (lo[2], hi[2]))
    return F.array(*(
        _vertex(from_plane(V(*(pick[a][s] for a, s in enumerate(corner))), n, d, rows))
        for corner in BOX_ORDER))


def cylinder_box_vertices(on_axis, rows, radius, lo, hi) -> Column:
    """Eight corners of the box around a cylinder, its axis on the box's z."""
    pick = ((-radius, radius), (-radius, radius), (lo, hi))
    return F.array(*(
        _vertex(from_frame(V(*(pick[a][s] for a, s in enumerate(corner))), on_axis, rows))
        for corner in BOX_ORDER))


def quaternion(rows) -> dict[str, Column]:
    """Unit quaternion of the inverse of ``frame`` rows."""
    w = F.sqrt(F.greatest(F.lit(0.0), 1 + rows[0][0] + rows[1][1] + rows[2][2])) / 2
    safe = F.when(w > 1e-9, 4 * w)
    zero = F.lit(0.0)
    # inverse = transpose, hence the swapped index pairs; w = 0 is the half turn about y
    return {"qx": F.coalesce((rows[1][2] - rows[2][1]) / safe, zero),
            "qy": F.coalesce((rows[2][0] - rows[0][2]) / safe, F.lit(1.0)),
            "qz": F.coalesce((rows[0][1] - rows[1][0]) / safe, zero), "qw": w}


def texture_size(uspan: Column, vspan: Column, n: Column, factor: float) -> dict[str, Column]:
    texel = F.lit(factor) * F.sqrt(uspan * vspan / n)
    safe = F.when(texel > 0, texel)
    width = F.floor(F.coalesce(uspan / safe, F.lit(0.0))).cast("bigint") + 1
    height = F.floor(F.coalesce(vspan / safe, F.lit(0.0))).cast("bigint") + 1
    return {"texel": texel, "width": width, "height": height,
            "w_pot": power_of_two(width), "h_pot": power_of_two(height)}


def power_of_two(c: Column) -> Column:
    """Smallest power of two that is at least c and at least 2."""
    bits = F.length(F.bin(F.greatest(c, F.lit(2)) - 1))
    return F.pow(F.lit(2.0), bits).cast("bigint")


def cell(c: Column, origin: Column, size) -> Column:
    return F.floor((c - origin) / size).cast("bigint")


def unrolled_cell(q, axis_min: Column, radius: Column, size) -> tuple[Column, Column]:
    """Cell of a point on the unrolled cylinder: (around, along)."""
    turn = F.atan2(q[1], q[0])
    turn = F.when(turn < 0, turn + F.lit(2 * math.pi)).otherwise(turn)
    return F.floor(turn * radius / size).cast("bigint"), F.floor((q[2] - axis_min) / size).cast("bigint")

