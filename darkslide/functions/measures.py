"""Scores of single measurements, as column expressions.

Scores with one decimal are rounded half up by `round1`, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE_PIXELS = 1920 * 1080
# Picture file kinds.
ALLOWED = ("png", "jpg", "jpeg", "webp", "bmp", "tiff")
RAW = ("cr2", "cr3", "nef", "nrw", "arw", "orf", "raf", "rw2", "dng", "pef", "x3f")


def num(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; null without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def is_allowed(name: Column, kinds: tuple[str, ...] = ALLOWED + RAW) -> Column:
    return F.coalesce(extension(name).isin(*kinds), F.lit(False))


def aspect_ratio(a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) == 0, F.lit(1.0)).otherwise(F.greatest(a, b) / F.least(a, b))


def relative_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def dynamic_denominator(w: Column, h: Column, base: float) -> Column:
    scale = F.greatest(F.lit(0.5), F.least(F.lit(2.5), F.sqrt(w * h / float(REFERENCE_PIXELS))))
    return F.when(w * h == 0, F.lit(base)).otherwise(base * scale)


def edge_variance(center: Column, full: Column) -> Column:
    return 0.6 * center + 0.4 * full


def sharpness(variance: Column, denominator: Column) -> Column:
    return round1(100 * (1.0 - F.exp(-variance / denominator)))


def exposure(mean: Column, highlights: Column, shadows: Column) -> Column:
    base = F.greatest(F.lit(0.0), 100.0 - F.abs(mean - 130.0) * (100.0 / 120.0))
    return round1(F.greatest(F.lit(0.0), base - (highlights * 80.0 + shadows * 12.0)))


def contrast(std: Column) -> Column:
    return round1(F.least(F.lit(100.0), std / 70.0 * 100.0))


def saturation(mean: Column) -> Column:
    return round1(F.least(F.lit(100.0), mean / 120.0 * 100.0))


def eye_aspect(v1: Column, v2: Column, across: Column) -> Column:
    return F.when(across == 0, F.lit(0.0)).otherwise((v1 + v2) / (2.0 * across))


def eye_score(ear: Column) -> Column:
    low = F.greatest(F.lit(0.0), ear / 0.18 * 30.0)
    return F.when(ear <= 0.18, low).otherwise(F.least(F.lit(100.0), 30.0 + (ear - 0.18) / 0.12 * 70.0))


def smile(pull: Column, width: Column) -> Column:
    ratio = F.when(width > 0, pull / width).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (ratio + 0.02) / 0.12 * 100.0))


def at_edge(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether a point lies in the outer 2 % of the frame."""
    return (x < 0.02 * w) | (x > w - 0.02 * w) | (y < 0.02 * h) | (y > h - 0.02 * h)


def occlusion(points: Column, w: Column, h: Column) -> Column:
    """100 if a point (struct x, y) lies in the outer 2 % of the frame."""
    return F.when(F.exists(points, lambda p: at_edge(p["x"], p["y"], w, h)), F.lit(100.0)).otherwise(F.lit(0.0))


def occlusion_of_rows(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The same of points in rows: an aggregate of them."""
    return F.when(F.bool_or(at_edge(x, y, w, h)), F.lit(100.0)).otherwise(F.lit(0.0))


def head_roll(dy: Column, dx: Column) -> Column:
    return F.when(dx != 0, F.degrees(F.atan2(dy, dx))).otherwise(F.lit(0.0))


def head_yaw(left: Column, right: Column) -> Column:
    return F.when(left + right > 0, round1(F.degrees(F.atan2(left - right, (left + right) / 2)) * 1.5)).otherwise(F.lit(0.0))


def head_pitch(facing: Column) -> Column:
    return round1(facing - 90.0)


def head_pose(yaw: Column, pitch: Column, roll: Column) -> Column:
    return round1(F.greatest(F.lit(0.0), 100.0 - (F.abs(yaw) + F.abs(pitch) + F.abs(roll)) * 1.2))


def looking(yaw: Column, pitch: Column) -> Column:
    return (F.abs(yaw) < 15.0) & (F.abs(pitch) < 15.0)


def lighting(mean: Column, std: Column) -> Column:
    return round1(F.greatest(F.lit(0.0), 1.0 - F.abs(mean - 130.0) / 110.0) * F.least(F.lit(1.0), std / 40.0) * 100.0)


def expression(eye: Column, smile_score: Column) -> Column:
    return round1(0.4 * eye + 0.6 * smile_score)


def blink_probability(eye: Column) -> Column:
    return round1(100.0 - eye)


def face_quality(sharp: Column, eye: Column, smile_score: Column, pose: Column, light: Column, hidden: Column) -> Column:
    return round1(0.3 * sharp + 0.2 * eye + 0.15 * smile_score + 0.15 * pose + 0.1 * light + 0.1 * (100.0 - hidden))


def thirds_placement(cx: Column, cy: Column) -> Column:
    """Nearness of a point (shares of the frame) to the lines of thirds and the middle."""

    def one(c: Column) -> Column:
        nearest = F.array_min(F.array(*(F.abs(c - t) for t in (0.333, 0.5, 0.666))))
        return F.greatest(F.lit(0.0), 100.0 - nearest / 0.16 * 100.0)

    return (one(cx) + one(cy)) / 2.0


def eye_state(left: Column, right: Column) -> Column:
    squint = (left >= 20) & (left < 45) & (right >= 20) & (right < 45)
    return (
        F.when((left < 20) & (right < 20), "Closed")
        .when(((left >= 65) & (right < 30)) | ((right >= 65) & (left < 30)), "Wink")
        .when(squint, "Squint")
        .when((left >= 75) & (right >= 75), "Fully open")
        .otherwise("Partially open")
    )


def composition(grid: Column) -> Column:
    """Score of a 3 x 3 grid of edge counts (array of nine)."""
    total = F.aggregate(grid, F.lit(0.0), lambda s, x: s + x)
    center = F.element_at(grid, 5) / total
    dense = F.greatest(F.lit(30.0), 100.0 - (center - 0.5) * 200.0)
    even = F.least(F.lit(100.0), 70.0 + (1.0 - F.abs(center - 0.25) * 4.0) * 30.0)
    return F.when(total <= 0, F.lit(80.0)).otherwise(round1(F.when(center > 0.5, dense).otherwise(even)))


def stage_presence(color_ratio: Column, screen_ratio: Column, n_faces: Column, face_exposure: Column, brightness: Column, contrast_score: Column) -> Column:
    color, screen = F.least(F.lit(100.0), color_ratio * 400.0), F.least(F.lit(100.0), screen_ratio * 500.0)
    spot = F.when(face_exposure > brightness, F.least(F.lit(100.0), (face_exposure - brightness) * 4.0)).otherwise(F.lit(0.0))
    score = F.when(n_faces > 0, 0.35 * color + 0.35 * spot + 0.30 * screen).otherwise(0.50 * color + 0.50 * screen)
    return round1(clamp(score + F.when(contrast_score > 50.0, (contrast_score - 50.0) * 0.2).otherwise(F.lit(0.0))))


def audience_presence(n_faces: Column, mean_face_ratio: Column, line_density: Column) -> Column:
    crowd = F.when(mean_face_ratio < 0.005, F.least(F.lit(100.0), n_faces * 10.0 + 30.0)).otherwise(F.least(F.lit(100.0), n_faces * 6.0))
    rows = F.least(F.lit(100.0), line_density * 350.0)
    return round1(clamp(F.when(n_faces >= 5, 0.60 * crowd + 0.40 * rows).otherwise(F.least(F.lit(70.0), rows))))


def branding_presence(text_boxes: Column, banner_rows: Column) -> Column:
    return round1(clamp(0.50 * F.least(F.lit(100.0), text_boxes * 8.0) + 0.50 * F.least(F.lit(100.0), banner_rows * 8.0)))


def match_band(distance: Column) -> Column:
    return F.when(distance <= 0.28, "Matched").when(distance > 0.42, "Rejected").otherwise("Ambiguous")


def pupil_distance_ok(found: Column, true: Column) -> Column:
    return F.coalesce(F.abs(found - true) <= 0.05 * true, F.lit(False))


def scan_estimate(count: Column) -> Column:
    """Text of the time a scan of so many files takes, at 0.015 s each."""
    s = F.floor(count * 0.015).cast("long")
    minutes = F.floor(s / 60).cast("long")
    return (
        F.when(count == 0, "0 sec")
        .when(count < 67, "<1 sec")
        .when(s < 60, F.format_string("~%d sec", s))
        .when(s % 60 == 0, F.format_string("~%d min", minutes))
        .otherwise(F.format_string("~%dm %ds", minutes, s % 60))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1.0 - cosine(a, b)
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"unknown metric {metric!r}")


def normalized(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def centred(v: Column) -> Column:
    """What correlation needs of one histogram: its differences from its mean (d) and the sum of their squares (v)."""
    d = lambda v: F.transform(v, lambda x: x - _total(v) / F.size(v).cast("double"))
    return F.transform(F.array(d(v)), lambda c: F.struct(c.alias("d"), _total(F.transform(c, lambda x: x * x)).alias("v")))[0]


def correlation_of_centred(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms, given as centred; 1 where one has no variance."""
    v = a["v"] * b["v"]
    return F.when(v <= 1e-18, F.lit(1.0)).otherwise(_total(F.zip_with(a["d"], b["d"], lambda x, y: x * y)) / F.sqrt(v))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms; 1 where one has no variance."""
    n = F.size(a).cast("double")
    ma, mb = _total(a) / n, _total(b) / n
    cov = _total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = _total(F.transform(a, lambda x: (x - ma) * (x - ma))), _total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when(va * vb <= 1e-18, F.lit(1.0)).otherwise(cov / F.sqrt(va * vb))
