"""Segmentation quality against ground truth, all images in one job.

Pixels are first reduced to the overlap table (image, ms, gt, pixels); everything after
that works on region counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle_between_deg
from ..functions.vec import v

FIRST = 10  # labels below are noise
NOISE_ALLOWED = (0, 1, 2, 3)


def join_labels(gt: DataFrame, ms: DataFrame) -> DataFrame:
    """Ground truth and machine labels by pixel."""
    key = ["image_id", "r", "c"]
    return gt.select(*key, F.col("label").alias("gt")).join(ms.select(*key, F.col("label").alias("ms")), key)


def overlap_table(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id", "ms", "gt").agg(F.count("*").alias("pixels"))


def region_sizes(overlap: DataFrame, side: str) -> DataFrame:
    return overlap.groupBy("image_id", side).agg(F.sum("pixels").alias(side + "_size"))


def with_ratios(overlap: DataFrame) -> DataFrame:
    """Overlap of region pairs with its share of both regions.  Labels per image are few (8 bit)."""
    gt = F.sum("pixels").over(Window.partitionBy("image_id", "gt")).alias("gt_size")
    ms = F.sum("pixels").over(Window.partitionBy("image_id", "ms")).alias("ms_size")
    d = overlap.select("image_id", "ms", "gt", "pixels", gt, ms).filter((F.col("gt") >= FIRST) & (F.col("ms") >= FIRST))
    return d.withColumns({"gt_share": F.col("pixels") / F.col("gt_size"), "ms_share": F.col("pixels") / F.col("ms_size")})


def _groups(r: DataFrame, key: str, t: float) -> DataFrame:
    """Mappings of one region of ``key`` onto several of the other side, with both measures (m1 gt, m2 ms)."""
    other = "ms" if key == "gt" else "gt"
    part = r.filter(F.col(f"{other}_share") >= t).groupBy("image_id", key).agg(
        F.count("*").alias("parts"), F.sum("pixels").alias("inside"), F.sum(f"{other}_size").alias("area"),
        F.max(f"{key}_size").alias("own"))
    whole, pieces = F.col("inside") / F.col("own"), F.col("inside") / F.col("area")
    m1, m2 = (whole, pieces) if key == "gt" else (pieces, whole)
    d = part.filter("parts > 1").withColumns({"m1": m1, "m2": m2})
    return d.filter((F.col("m1") >= t) & (F.col("m2") >= t)).select("image_id", key, "m1", "m2")


def classify(overlap: DataFrame, t: float):
    """(gt regions, ms regions): class, partner label for one-to-one sides, and both measures.

    Correct pairs first, then over-segmentation, then under-segmentation; a later class
    replaces an earlier one only with a higher mean measure.  What is left is missed (gt)
    or noise (ms).  ``t`` above 0.5 makes every single mapping unique.
    """
    if not 0.5 < t <= 1:
        raise ValueError("the overlap threshold must lie in (0.5, 1]")
    r = with_ratios(overlap)
    # solo mappings: ms -> gt by share of ms, gt -> ms by share of gt
    ms_solo = r.filter(F.col("ms_share") >= t).select("image_id", "ms", F.col("gt").alias("ms_to"))
    gt_solo = r.filter(F.col("gt_share") >= t).select("image_id", "gt", F.col("ms").alias("gt_to"))
    correct = r.filter((F.col("gt_share") >= t) & (F.col("ms_share") >= t)).select(
        "image_id", "gt", "ms", F.col("gt_share").alias("c1"), F.col("ms_share").alias("c2"))
    over = _groups(r, "gt", t).select("image_id", "gt", F.col("m1").alias("o1"), F.col("m2").alias("o2"))
    under = _groups(r, "ms", t).select("image_id", "ms", F.col("m1").alias("u1"), F.col("m2").alias("u2"))
    regions = {s: overlap.filter(F.col(s) >= FIRST).groupBy("image_id", s).agg(F.sum("pixels").alias("size"))
               for s in ("gt", "ms")}

    # over-segmentation wins over a correct mapping of the same gt region
    g = regions["gt"].join(correct, ["image_id", "gt"], "left").join(over, ["image_id", "gt"], "left")
    g = g.withColumn("over_wins", F.expr("o1 is not null and (c1 is null or (o1 + o2)/2 > (c1 + c2)/2)"))
    won = g.filter("over_wins").select("image_id", F.col("gt").alias("ms_to"), "o1", "o2")
    m = (regions["ms"].join(correct.select("image_id", "ms", F.col("gt").alias("c_gt"), "c1", "c2"), ["image_id", "ms"], "left")
         .join(ms_solo, ["image_id", "ms"], "left").join(won, ["image_id", "ms_to"], "left"))
    m = m.withColumn("b1", F.coalesce("o1", "c1")).withColumn("b2", F.coalesce("o2", "c2"))
    # under-segmentation is compared with what the ms region holds by now
    m = m.join(under, ["image_id", "ms"], "left")
    m = m.withColumn("under_wins", F.expr("u1 is not null and (b1 is null or (u1 + u2)/2 > (b1 + b2)/2)"))
    ms_out = m.selectExpr(
        "image_id", "ms", "size",
        "case when under_wins then 'under' when o1 is not null then 'over' when c1 is not null then 'correct' else 'noise' end as class",
        "case when under_wins then null when o1 is not null then ms_to when c1 is not null then c_gt end as partner",
        "case when under_wins then u1 else b1 end as m1", "case when under_wins then u2 else b2 end as m2")
    taken = m.filter("under_wins").select("image_id", F.col("ms").alias("gt_to"), "u1", "u2")
    g = g.join(gt_solo, ["image_id", "gt"], "left").join(taken, ["image_id", "gt_to"], "left")
    gt_out = g.selectExpr(
        "image_id", "gt", "size",
        "case when u1 is not null then 'under' when over_wins then 'over' when c1 is not null then 'correct' else 'missed' end as class",
        "case when u1 is not null then gt_to when over_wins then null when c1 is not null then ms end as partner",
        "case when u1 is not null then u1 when over_wins then o1 else c1 end as m1",
        "case when u1 is not null then u2 when over_wins then o2 else c2 end as m2")
    return gt_out, ms_out


def correct_pixels(overlap: DataFrame, t: float) -> DataFrame:
    """Per image: ground-truth pixels, pixels of correct pairs, pixels of correct ms regions outside."""
    r = with_ratios(overlap).filter((F.col("gt_share") >= t) & (F.col("ms_share") >= t))
    good = r.groupBy("image_id").agg(F.sum("pixels").alias("correct_pixels"),
                                     F.sum(F.col("ms_size") - F.col("pixels")).alias("wrong_ms_pixels"))
    whole = overlap.filter(F.col("gt") >= FIRST).groupBy("image_id").agg(F.sum("pixels").alias("gt_pixels"))
    return whole.join(good, "image_id", "left").fillna(0, ["correct_pixels", "wrong_ms_pixels"])


def angle_errors(gt_regions: DataFrame, angles: DataFrame, normals: DataFrame) -> DataFrame:
    """Angle error per listed region pair whose regions are both correct."""
    good = gt_regions.filter("class = 'correct'").select("image_id", "gt", "partner")
    d = angles
    for k in ("1", "2"):
        side = good.select("image_id", F.col("gt").alias("region" + k), F.col("partner").alias("region"))
        side = side.join(normals, ["image_id", "region"]).select(
            "image_id", "region" + k, *(F.col("n" + a).alias(f"n{k}{a}") for a in "xyz"))
        d = d.join(side, ["image_id", "region" + k])
    folded = F.when(F.col("deg") > 90, F.abs(F.col("deg") - 180)).otherwise(F.col("deg"))
    measured = angle_between_deg(v("n1"), v("n2"))
    return d.select("image_id", "region1", "region2", F.abs(folded - measured).alias("error"))


def angle_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("image_id").agg(F.count("*").alias("angles"), F.avg("error").alias("mean_error"),
                                          F.stddev_pop("error").alias("std_error"))


def image_scores(gt_regions: DataFrame, ms_regions: DataFrame, pixels: DataFrame, angles: DataFrame | None = None) -> DataFrame:
    """One row per image: region counts per class, pixel counts, angle errors."""
    def count(cls):
        return F.sum((F.col("class") == cls).cast("bigint")).alias(cls)

    d = gt_regions.groupBy("image_id").agg(F.count("*").alias("gt_regions"), count("correct"), count("over"), count("missed"))
    m = ms_regions.groupBy("image_id").agg(count("under"), count("noise"))
    d = d.join(m, "image_id", "left").join(pixels, "image_id", "left").fillna(0, ["under", "noise"])
    if angles is not None:
        d = d.join(angles, "image_id", "left")
    return d


def sequence_averages(scores: DataFrame) -> DataFrame:
    """Means over images; angle means only over images that have angles."""
    counts = ["gt_regions", "correct", "over", "under", "missed", "noise"]
    aggs = [F.count("*").alias("images"), *(F.avg(c).alias(c) for c in counts),
            F.avg("correct_pixels").alias("correct_pixels"), F.avg("gt_pixels").alias("gt_pixels"),
            (100 * F.sum("correct_pixels") / F.sum("gt_pixels")).alias("percent"),
            F.avg(F.col("gt_pixels") - F.col("correct_pixels")).alias("missed_pixels"),
            F.avg("wrong_ms_pixels").alias("wrong_ms_pixels")]
    if "mean_error" in scores.columns:
        aggs += [F.avg("mean_error").alias("mean_error"), F.avg("std_error").alias("std_error")]
    return scores.agg(*aggs)


def report(gt_regions: DataFrame, ms_regions: DataFrame, overlap: DataFrame, t: float) -> DataFrame:
    """Mapping rows by class: region labels on both sides and the measures."""
    r = with_ratios(overlap)
    solo = r.filter(F.col("ms_share") >= t).select("image_id", "gt", "ms")
    onto = r.filter(F.col("gt_share") >= t).select("image_id", "gt", "ms")

    def labels(d, key, other):
        return d.groupBy("image_id", key).agg(F.sort_array(F.collect_list(other)).alias("labels"))

    one = F.array("partner")
    a = gt_regions.filter("class = 'correct'").select("image_id", "class", F.array("gt").alias("gt_labels"), one.alias("ms_labels"), "m1", "m2")
    b = gt_regions.filter("class = 'over'").join(labels(solo, "gt", "ms"), ["image_id", "gt"]).select(
        "image_id", "class", F.array("gt").alias("gt_labels"), F.col("labels").alias("ms_labels"), "m1", "m2")
    c = ms_regions.filter("class = 'under'").join(labels(onto, "ms", "gt"), ["image_id", "ms"]).select(
        "image_id", "class", F.col("labels").alias("gt_labels"), F.array("ms").alias("ms_labels"), "m1", "m2")
    none = F.array().cast("array<bigint>")
    d = gt_regions.filter("class = 'missed'").select("image_id", "class", F.array("gt").alias("gt_labels"), none.alias("ms_labels"), "m1", "m2")
    e = ms_regions.filter("class = 'noise'").select("image_id", "class", none.alias("gt_labels"), F.array("ms").alias("ms_labels"), "m1", "m2")
    parts = [x.withColumns({"gt_labels": F.col("gt_labels").cast("array<bigint>"), "ms_labels": F.col("ms_labels").cast("array<bigint>")})
             for x in (a, b, c, d, e)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def validate(labels: DataFrame, side: str) -> DataFrame:
    """Per image: region count, highest label, bad noise labels, consecutive flag, emptiness."""
    present = labels.groupBy("image_id", F.col(side).alias("label")).agg(F.count("*").alias("pixels"))
    d = present.groupBy("image_id").agg(
        F.sum((F.col("label") >= FIRST).cast("bigint")).alias("regions"),
        F.max(F.when(F.col("label") >= FIRST, F.col("label"))).alias("top_label"),
        F.sum(((F.col("label") < FIRST) & ~F.col("label").isin(*NOISE_ALLOWED)).cast("bigint")).alias("bad_noise"))
    return d.withColumns({"consecutive": F.coalesce(F.col("top_label") - (FIRST - 1) == F.col("regions"), F.lit(True)),
                          "empty": F.col("regions") == 0})


def check(labels: DataFrame, side: str) -> None:
    """Raise when any image breaks the label rules."""
    bad = validate(labels, side).filter("bad_noise > 0 or not consecutive or empty").take(5)
    if bad:
        raise ValueError(f"invalid {side} labels in images {[b['image_id'] for b in bad]}")


def size_faults(gt: DataFrame, ms: DataFrame) -> DataFrame:
    """Images whose two label images differ in size, or that have only one."""
    def dims(d, tag):
        return d.groupBy("image_id").agg((F.max("r") + 1).alias(tag + "_rows"), (F.max("c") + 1).alias(tag + "_cols"))

    both = dims(gt, "gt").join(dims(ms, "ms"), "image_id", "full")
    return both.filter("not (gt_rows <=> ms_rows and gt_cols <=> ms_cols)")


def label_pairs(gt: DataFrame, ms: DataFrame) -> DataFrame:
    """Pixels ``(image_id, r, c, gt, ms)`` of two sets of label images ``(image_id, r, c, label)``; sizes must be equal."""
    bad = size_faults(gt, ms).orderBy("image_id").take(5)
    if bad:
        raise ValueError(f"label images {[b['image_id'] for b in bad]} differ in size or have no partner")
    return gt.withColumnRenamed("label", "gt").join(ms.withColumnRenamed("label", "ms"), ["image_id", "r", "c"])


def borders(pixels: DataFrame, label: str = "label") -> DataFrame:
    """Region pixels with a 4-neighbour of another label.

    A neighbour outside the image does not count.  Each pixel sends its label to its four
    neighbours and one grouped pass compares, so rows and columns are never ordered whole.
    """
    key = ["image_id", "r", "c"]
    sent = pixels.selectExpr("image_id", f"""inline(array(struct(r, c, {label} as own, null as seen),
        struct(r + 1 as r, c, null as own, {label} as seen), struct(r - 1 as r, c, null as own, {label} as seen),
        struct(r, c + 1 as c, null as own, {label} as seen), struct(r, c - 1 as c, null as own, {label} as seen)))""")
    d = sent.groupBy(*key).agg(F.max("own").alias(label), F.min("seen").alias("_lo"), F.max("seen").alias("_hi"))
    return d.filter(f"{label} >= {FIRST} and (_lo <> {label} or _hi <> {label})").select(*key, label)


# Order of the classes in the class image.
CLASS_ORDER = ("noise pixel", "correct", "over", "under", "noise", "missed", "border", "label")


def class_image(pixels: DataFrame, regions: DataFrame, label: str) -> DataFrame:
    """Pixel classes with region borders; values number the classes present in each image."""
    edge = borders(pixels, label).select("image_id", "r", "c", F.lit(6).alias("_b"))
    code = F.expr("case class when 'correct' then 1 when 'over' then 2 when 'under' then 3 when 'noise' then 4 when 'missed' then 5 end")
    r = regions.select("image_id", label, code.alias("_c"))
    d = pixels.join(r, ["image_id", label], "left").join(edge, ["image_id", "r", "c"], "left")
    base = F.when(F.col(label) < FIRST, F.lit(0)).otherwise(F.col("_c"))
    seen = d.groupBy("image_id").agg(F.collect_set(base).alias("_seen"))  # at most six codes
    d = d.withColumn("_k", F.coalesce(F.col("_b"), base)).join(seen, "image_id")
    value = F.expr("cast(size(filter(_seen, s -> s < _k)) as bigint)")
    return d.select("image_id", "r", "c", value.alias("value"), F.col("_b").isNotNull().alias("border"))


def region_centroids(pixels: DataFrame, label: str = "label") -> DataFrame:
    """Whole-number centroid of every region."""
    return pixels.filter(F.col(label) >= FIRST).groupBy("image_id", label).agg(
        F.expr("sum(r) div count(*)").alias("centre_r"), F.expr("sum(c) div count(*)").alias("centre_c"),
        F.count("*").alias("pixels"))


def colour_labels(pixels: DataFrame, width: int) -> DataFrame:
    """Colour picture -> labels: black 0, white 1, others 10, 11, ... by first appearance.

    Labels are not bounded here; 8-bit files check them when they are encoded.
    """
    first = pixels.groupBy("image_id", "rgb").agg(F.min(F.col("r") * width + F.col("c")).alias("_first"))
    w = Window.partitionBy("image_id").orderBy("_first")
    other = first.filter("rgb <> 0 and rgb <> 16777215").withColumn("_k", F.row_number().over(w))
    other = other.withColumn("label", (F.col("_k") + 9).cast("bigint"))
    d = pixels.join(other.select("image_id", "rgb", "label"), ["image_id", "rgb"], "left")
    return d.withColumn("label", F.expr("case rgb when 0 then 0L when 16777215 then 1L else label end"))
