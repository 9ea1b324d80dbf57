"""Photo scores from measurements and faces, staged as columns.

Input: photos and rows of faces (`with_face_rows`: plain aggregates, compiled and without arrays) or photos that hold their
faces in an array (`with_face_summary`: higher-order functions); the later stages read the columns that these make. Everything is JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.functions.measures import clamp, num, round1

# Words in a file name and what they add, categories and what they add.
STORY_WORDS = {"award": 8.0, "shaking": 6.0, "handshake": 6.0, "network": 5.0, "celebrat": 6.0, "vip": 5.0, "sponsor": 5.0, "audience": 6.0, "reaction": 6.0, "gesture": 4.0, "keynote": 4.0, "panel": 4.0}
CATEGORY_BONUS = {"Networking": 5.0, "Audience": 6.0, "Group Photos": 4.0, "Keynote": 4.0, "Panel Discussion": 4.0, "Awards": 6.0}
AWARD_WORDS = ("award", "handover", "winner")
EXHIBIT_WORDS = ("sponsor", "booth", "exhib")
BOOTH_WORDS = ("booth", "sponsor", "exhib", "exposition", "stands", "kiosk")
BLUR_WAIVED = ("Audience", "Networking", "Group Photos", "Awards", "Keynote", "Panel Discussion")


def _sum(faces: Column, value) -> Column:
    return F.aggregate(faces, F.lit(0.0), lambda s, f: s + value(f).cast("double"))


def mean_of(faces: Column, value) -> Column:
    """Mean over the faces; null without any."""
    return F.try_divide(_sum(faces, value), F.size(faces))


def _framing(w: Column, h: Column, f) -> Column:
    """How completely one face (a struct, or columns by name) is framed, 0 to 100."""
    x, y, fw, fh = (f[k].cast("double") for k in ("x", "y", "w", "h"))
    mx, my = 0.05 * w, 0.05 * h
    side = F.when((x <= 2) | (x + fw >= w - 2), 25.0).when((x < mx) | (x + fw > w - mx), 10.0).otherwise(0.0)
    top = F.when(y <= 2, 30.0).when(y < my, 12.0).otherwise(0.0)
    low = F.when(y + fh >= h - 2, 20.0).when(h - (y + fh) < my, 10.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), 100.0 - side - top - low)


def _complete(w: Column, h: Column, n: Column, framing: Column, left: Column, right: Column, top: Column) -> Column:
    """Mean framing of n faces, with a reward for balanced margins; left, right and top are the outer edges of all faces."""
    a, b, t = left.cast("double") / w, (w - right.cast("double")) / w, top.cast("double") / h
    reward = F.when(F.abs(a - b) < 0.08, 5.0).otherwise(0.0) + F.when((t >= 0.10) & (t <= 0.25), 5.0).otherwise(0.0)
    return F.when((n == 0) | (w <= 0) | (h <= 0), F.lit(100.0)).otherwise(clamp(framing + reward))


def completeness(w: Column, h: Column, faces: Column) -> Column:
    """How completely the faces are framed, 0 to 100; 100 without faces or frame."""
    w, h = w.cast("double"), h.cast("double")
    left, top = F.array_min(F.transform(faces, lambda f: f["x"])), F.array_min(F.transform(faces, lambda f: f["y"]))
    right = F.array_max(F.transform(faces, lambda f: f["x"] + f["w"]))
    return _complete(w, h, F.size(faces), mean_of(faces, lambda f: _framing(w, h, f)), left, right, top)


def _center(f) -> Column:
    return f["y"].cast("double") + f["h"].cast("double") / 2.0


#: What is known of the faces of a photo, see face_totals.
TOTALS = ["_n", "_main", "_sharp", "_exposure", "_framed", "_middle", "_lowest", "_highest", "_left", "_right", "_top", "_narrow", "_wide", "_blink", "_least_facing", "_towards"]


def face_totals(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """One row per photo that has faces, from rows of faces (photo_id, face_pos, x, y, w, h, sharpness, camera_facing, eye_openness,
    face_exposure, is_blink). photos: rows with photo_id (its key), img_w, img_h. A missing measurement adds nothing.

    Plain aggregates after one shuffle by photo_id, which the join with the photos' frames and the grouping share."""
    f = {c: F.col(c) for c in faces.columns}
    frame = photos.select("photo_id", num("img_w").alias("_w"), num("img_h").alias("_h"))
    measured = faces.join(frame, "photo_id").withColumn("_framing", _framing(F.col("_w"), F.col("_h"), f)).withColumn("_c", _center(f))
    main = F.min_by(F.struct((f["w"] * f["h"]).alias("area"), "camera_facing", "eye_openness"), F.struct(-f["w"] * f["h"], f["face_pos"]))
    n = F.count("*")
    mean = lambda c: (F.sum(F.col(c).cast("double")) / n)
    return measured.groupBy("photo_id").agg(
        n.alias("_n"), main.alias("_main"), mean("sharpness").alias("_sharp"), mean("face_exposure").alias("_exposure"), mean("_framing").alias("_framed"), mean("_c").alias("_middle"),
        F.max("_c").alias("_lowest"), F.min("_c").alias("_highest"), F.min("x").alias("_left"), F.max(f["x"] + f["w"]).alias("_right"), F.min("y").alias("_top"),
        F.min("w").alias("_narrow"), F.max("w").alias("_wide"), F.bool_or("is_blink").alias("_blink"), F.min("camera_facing").alias("_least_facing"), F.count_if(f["camera_facing"] >= 60).alias("_towards"),
    )


def _array_totals(f: Column) -> dict[str, Column]:
    """The columns of face_totals from an array of faces."""
    of = lambda value: F.transform(f, value)
    by_area = of(lambda x: F.struct((-x["w"] * x["h"]).alias("k"), x["face_pos"].alias("pos"), (x["w"] * x["h"]).alias("area"), x["camera_facing"].alias("camera_facing"), x["eye_openness"].alias("eye_openness")))
    right, x, y, w, c = of(lambda x: x["x"] + x["w"]), of(lambda x: x["x"]), of(lambda x: x["y"]), of(lambda x: x["w"]), of(_center)
    return {
        "_n": F.size(f), "_main": F.array_min(by_area), "_sharp": mean_of(f, lambda x: x["sharpness"]), "_exposure": mean_of(f, lambda x: x["face_exposure"]),
        "_framed": mean_of(f, lambda x: _framing(num("img_w"), num("img_h"), x)), "_middle": mean_of(f, _center),
        "_lowest": F.array_max(c), "_highest": F.array_min(c), "_left": F.array_min(x), "_right": F.array_max(right), "_top": F.array_min(y),
        "_narrow": F.array_min(w), "_wide": F.array_max(w), "_blink": F.exists(f, lambda x: x["is_blink"]),
        "_least_facing": F.array_min(of(lambda x: x["camera_facing"])), "_towards": F.size(F.filter(f, lambda x: x["camera_facing"] >= 60)),
    }


def _summary(totals: DataFrame) -> DataFrame:
    """Photos with the columns of face_totals (null without faces) turned into what scoring reads."""
    c, w, h = F.col, num("img_w"), num("img_h")
    n, area, least = F.coalesce(c("_n").cast("int"), F.lit(0)), num("_main.area"), c("_least_facing")
    made = {
        "n_faces": n,
        "avg_sharpness": F.coalesce("_sharp", F.lit(0.0)),
        "max_area": F.coalesce(area, F.lit(0.0)),
        "face_size_factor": F.coalesce(F.least(F.lit(100.0), area / (w * h) / 0.10 * 100.0), F.lit(0.0)),
        "main_facing": F.coalesce(num("_main.camera_facing"), F.lit(0.0)),
        "main_eyes": F.coalesce(num("_main.eye_openness"), F.lit(100.0)),
        "has_blink": F.coalesce("_blink", F.lit(False)),
        "y_spread": F.coalesce((c("_lowest") - c("_highest")) / h, F.lit(0.0)),
        "avg_y": F.coalesce(c("_middle") / h, F.lit(0.0)),
        "width_ratio": F.coalesce(num(c("_right") - c("_left")) / w, F.lit(0.0)),
        "size_ratio": F.coalesce(F.try_divide(num("_narrow"), num("_wide")), F.lit(0.0)),
        "all_facing": F.coalesce(least >= 65, F.lit(True)),
        "any_away": F.coalesce(least < 70, F.lit(False)),
        "majority_facing": F.coalesce(c("_towards"), F.lit(0)) >= F.floor((n + 1) / 2),
        "subject_exposure": F.coalesce(round1(0.70 * c("_exposure") + 0.30 * num("brightness")), num("brightness")),
        "completeness": _complete(w, h, n, c("_framed"), c("_left"), c("_right"), c("_top")),
    }
    return totals.withColumns(made).drop(*TOTALS)


def with_face_rows(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """photos with the reductions of their faces that scoring reads, from a table of faces."""
    return _summary(photos.join(face_totals(faces, photos), "photo_id", "left"))


def with_face_summary(df: DataFrame) -> DataFrame:
    """The same for photos that hold their faces in an array; a missing measurement of a face makes its mean missing."""
    return _summary(df.withColumns(_array_totals(F.col("faces"))))


def profile() -> Column:
    return F.when(F.col("n_faces") == 0, "scene").when((F.col("n_faces") >= 3) | (F.col("face_size_factor") < 30.0), "group").otherwise("portrait")


def has_word(words: tuple[str, ...]) -> Column:
    name = F.lower("filename")
    found = F.lit(False)
    for w in words:
        found = found | F.contains(name, F.lit(w))
    return found


def event_category() -> Column:
    """One of eight labels, by words in the file name and then by the faces and presence scores."""
    n, stage, crowd, brand = (F.col(c) for c in ("n_faces", "stage_presence", "audience_presence", "branding_presence"))
    y, spread, wide, ratio = F.col("avg_y"), F.col("y_spread"), F.col("width_ratio"), F.col("max_area") / (num("img_w") * num("img_h"))
    award = n.between(2, 4) & (stage >= 25) & F.col("all_facing") & (spread < 0.08) & (y < 0.35) & (wide < 0.50) & (F.col("size_ratio") >= 0.70)
    group = (n >= 3) & F.col("majority_facing") & (spread < 0.08) & (wide >= 0.35) & (crowd < 40)
    exhibition = (((brand >= 25) & (stage < 35)) | has_word(BOOTH_WORDS)) & (n <= 4)
    panel = (n >= 2) & (stage >= 20) & (wide >= 0.20) & (spread < 0.15) & y.between(0.15, 0.65) & (crowd < 40)
    keynote = (n == 1) & (stage >= 25) & (ratio < 0.08)
    networking = n.between(1, 6) & (stage < 25) & (crowd < 35) & ((n <= 2) | F.col("any_away"))
    return (
        F.when(has_word(AWARD_WORDS), "Awards")
        .when(has_word(EXHIBIT_WORDS), "Exhibition")
        .when(award, "Awards").when(group, "Group Photos").when(exhibition, "Exhibition").when(panel, "Panel Discussion")
        .when(keynote, "Keynote").when(networking, "Networking").when((crowd >= 35) | (n >= 5), "Audience").when(n == 0, "Branding")
        .when((ratio < 0.002) & (brand > 15) & (stage < 25), "Branding")
        .when((stage >= 25) & (n == 1), "Keynote").when(stage >= 25, "Panel Discussion").otherwise("Networking")
    )


def keyword_bonus() -> Column:
    """The largest value of a word in the file name, 0 without any."""
    weights = F.create_map(*(F.lit(x) for kv in STORY_WORDS.items() for x in kv))
    name = F.lower("filename")
    return F.array_max(F.transform(F.map_entries(weights), lambda e: F.when(F.contains(name, e["key"]), e["value"]).otherwise(F.lit(0.0))))


def category_bonus() -> Column:
    m = F.create_map(*(F.lit(x) for kv in CATEGORY_BONUS.items() for x in kv))
    return F.coalesce(F.element_at(m, F.col("category")), F.lit(0.0))


def marketing_bonus() -> Column:
    b, s = num("branding_presence"), num("stage_presence")
    return F.when(b > 20, b / 100.0 * 8.0).otherwise(0.0) + F.when(s > 20, s / 100.0 * 5.0).otherwise(0.0)


def venue_bonus() -> Column:
    b, s = num("branding_presence"), num("stage_presence")
    return F.when((s > 30) | (b > 30), F.least(F.lit(12.0), (s + b) / 15.0)).otherwise(0.0)


def overall_score(boost: bool = False) -> Column:
    """Floor 0, no upper bound."""
    c, audience = F.col, F.col("category") == "Audience"
    sharp_face = (c("n_faces") > 0) & (c("avg_sharpness") >= 60)
    blur = F.when(~sharp_face & c("has_motion_blur"), 25.0).otherwise(0.0)
    blink = F.when(~audience & c("has_blink"), 25.0).otherwise(0.0)
    soft = F.when(~audience & (c("n_faces") > 0) & (c("avg_sharpness") < 45), 35.0).otherwise(0.0)
    group = 0.10 * c("main_facing") + 0.10 * c("main_eyes") + 0.20 * c("avg_sharpness") + 0.20 * c("subject_exposure") + 0.10 * num("contrast") + 0.20 * num("composition") + 0.10 * c("completeness")
    portrait = 0.25 * c("main_facing") + 0.20 * c("main_eyes") + 0.20 * c("avg_sharpness") + 0.10 * c("face_size_factor") + 0.15 * c("subject_exposure") + 0.10 * num("contrast")
    scene = 0.35 * num("sharpness") + 0.20 * num("brightness") + 0.15 * num("contrast") + 0.15 * num("composition") + 0.15 * num("motion_blur")
    faces = F.when(c("profile") == "group", group).otherwise(portrait) - blur - blink - soft + c("marketing_bonus") + c("story_bonus")
    score = F.greatest(F.lit(0.0), F.when(c("profile") == "scene", scene - blur - 25.0 + venue_bonus() + c("story_bonus")).otherwise(faces))
    if boost:
        score = score + F.when(audience, 5.0).otherwise(0.0) + F.when(c("audience_presence") >= 50, 5.0).otherwise(0.0)
    return score


def publishability() -> Column:
    c, audience = F.col, F.col("category") == "Audience"
    bonus = F.least(F.lit(15.0), c("n_faces") * 3.0)
    group = 0.35 * c("overall") + 0.25 * c("completeness") + 0.20 * num("composition") + 0.10 * c("subject_exposure") + 0.10 * c("avg_sharpness") + bonus
    portrait = 0.40 * c("overall") + 0.20 * c("completeness") + 0.15 * num("composition") + 0.15 * c("avg_sharpness") + 0.10 * c("main_eyes")
    scene = 0.45 * c("overall") + 0.20 * num("composition") + 0.20 * num("sharpness") + 0.15 * num("contrast")
    base = F.when(c("profile") == "group", group).when(c("profile") == "portrait", portrait).otherwise(scene)
    sharp_face = (c("n_faces") > 0) & (c("avg_sharpness") >= 60)
    fault = F.when(c("has_motion_blur") & ~sharp_face, 40.0).otherwise(0.0) + F.when(c("has_blink") & ~audience, 30.0).otherwise(0.0)
    fault = fault + F.when((c("n_faces") > 0) & (c("avg_sharpness") < 45) & ~audience, 30.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), base - fault)


def hero_candidate() -> Column:
    c = F.col
    value = (c("branding_presence") > 30) | (c("stage_presence") > 40) | (c("audience_presence") > 40) | (c("story_bonus") > 0)
    return (
        ((c("category") != "Branding") | (c("branding_presence") >= 75))
        & (c("overall") >= 95) & (c("publish") >= 90) & (c("composition") >= 85) & (c("completeness") >= 85)
        & ((c("n_faces") == 0) | (c("avg_sharpness") >= 70)) & value
    )


def editorial_decision(is_best: Column | bool = True, keep_overall: float | None = None, keep_publish: float | None = None) -> Column:
    """REJECT, HERO, KEEP or MAYBE, the first that holds."""
    c = F.col
    best = F.lit(is_best) if isinstance(is_best, bool) else is_best
    sharp_face = (c("n_faces") > 0) & (c("avg_sharpness") >= 60)
    scene_like = c("category").isin("Branding", "Exhibition") & (c("n_faces") == 0)
    os_at = F.lit(keep_overall) if keep_overall is not None else F.when(scene_like, 75.0).otherwise(60.0)
    pb_at = F.lit(keep_publish) if keep_publish is not None else F.when(scene_like, 60.0).otherwise(50.0)
    reject = (
        (c("overall") < 40) | (c("publish") < 35) | (c("is_blurry") & ~c("category").isin(*BLUR_WAIVED))
        | (c("has_motion_blur") & ~sharp_face) | (c("has_blink") & (c("category") != "Audience"))
        | (c("brightness") < 30) | (c("brightness") > 220) | (c("completeness") < 50) | (~best & (c("overall") < 60))
    )
    hero = (c("overall") >= 100) & (c("publish") >= 99) & c("hero") & best
    keep = (c("overall") >= os_at) & (c("publish") >= pb_at) & best
    return F.when(reject, "REJECT").when(hero, "HERO").when(keep, "KEEP").otherwise("MAYBE")


def scored(photos: DataFrame, boost: bool = False, faces: DataFrame | None = None) -> DataFrame:
    """All scores of every photo; faces: their rows, where photos don't hold them in an array."""
    df = with_face_summary(photos) if faces is None else with_face_rows(photos, faces)
    df = df.withColumns({"profile": profile(), "category": event_category()})
    df = df.withColumns({"marketing_bonus": marketing_bonus(), "story_bonus": keyword_bonus() + category_bonus()})
    df = df.withColumn("overall", overall_score(boost)).withColumn("publish", publishability())
    return df.withColumn("hero", hero_candidate()).withColumn("decision", editorial_decision())


def selection_reasons() -> tuple[Column, Column]:
    """(names of the strengths in order of weight, the strongest) of a scored photo: those of 65 or more, else the first two."""
    c = F.col

    def item(pos: int, key: str, weight: float, raw: Column, high: str, low: str, at: float = 85.0) -> Column:
        text = F.lit(high) if high == low else F.when(raw >= at, high).otherwise(low)
        return F.struct((-weight * raw).alias("k"), F.lit(pos).alias("pos"), F.lit(key).alias("key"), text.alias("text"), raw.alias("raw"))

    # The texts of the reasons.
    comp = ("Excellent composition", "Strong composition")
    faces = ("Sharp faces", "Good face sharpness")
    light = ("Good localized exposure", "Balanced exposure")
    facing = ("Facing camera", "Good camera angle")
    eyes = ("Clear expression (no blinks)", "Eyes open")
    con = ("Vibrant lighting", "Good contrast", 80.0)
    composition, contrast = num("composition"), num("contrast")
    whole = F.when(c("n_faces") >= 3, "Complete group visibility").otherwise("Complete subject framing")
    complete = F.struct((-0.10 * c("completeness")).alias("k"), F.lit(3).alias("pos"), F.lit("completeness").alias("key"), whole.alias("text"), c("completeness").alias("raw"))
    group = F.array(
        item(0, "composition", 0.20, composition, *comp), item(1, "face_sharpness", 0.20, c("avg_sharpness"), *faces), item(2, "exposure", 0.20, c("subject_exposure"), *light),
        complete, item(4, "camera_facing", 0.10, c("main_facing"), *facing), item(5, "eyes_open", 0.10, c("main_eyes"), *eyes), item(6, "contrast", 0.10, contrast, *con),
    )
    portrait = F.array(
        item(0, "camera_facing", 0.25, c("main_facing"), *facing), item(1, "eyes_open", 0.20, c("main_eyes"), *eyes), item(2, "face_sharpness", 0.20, c("avg_sharpness"), *faces),
        item(3, "exposure", 0.15, c("subject_exposure"), *light), item(4, "face_size", 0.10, c("face_size_factor"), "Clear portrait focus", "Clear portrait focus"), item(5, "contrast", 0.10, contrast, *con),
    )
    scene = F.array(
        item(0, "sharpness", 0.35, num("sharpness"), "Excellent sharpness", "Sharp image details"), item(1, "exposure", 0.20, num("brightness"), "Balanced exposure", "Balanced exposure"), item(2, "contrast", 0.15, contrast, *con),
        item(3, "composition", 0.15, composition, *comp), item(4, "motion_blur", 0.15, num("motion_blur"), "No motion blur", "No motion blur"),
    )
    every = F.array_sort(F.when(c("profile") == "group", group).when(c("profile") == "portrait", portrait).otherwise(scene))
    good = F.filter(every, lambda x: x["raw"] >= 65)
    chosen = F.when(F.size(good) > 0, good).otherwise(F.slice(every, 1, 2))
    return F.transform(chosen, lambda x: x["text"]), F.element_at(every, 1)["key"]


def story_scene() -> Column:
    """Scene of a photo by the number of faces, their size and mean smile (missing: 50)."""
    n, f = F.size("faces"), F.col("faces")
    smile = mean_of(f, lambda x: F.coalesce(x["smile"], F.lit(50)))
    large = F.exists(f, lambda x: (F.coalesce(x["w"], F.lit(100)) > 150) | (F.coalesce(x["h"], F.lit(100)) > 150))
    return (
        F.when(n == 0, "Details/Decor").when((n <= 2) & large, "Portraits").when(n <= 2, "General")
        .when((n <= 6) & (smile > 60), "Reception").when(n <= 6, "Ceremony").when(smile > 55, "Dance Floor").otherwise("Ceremony")
    )


def highlight_score(quality) -> Column:
    """Mean quality of the faces (missing: 50); 50 without faces, 0 without measurements."""
    f = F.col("faces")
    mean = mean_of(f, lambda x: F.coalesce(quality(x), F.lit(50.0)))
    return F.when(f.isNull(), F.lit(0.0)).when(F.size(f) == 0, F.lit(50.0)).otherwise(mean)


def analysis_notes(variance: Column, sharp: Column, mean: Column, highlights: Column, shadows: Column, motion: Column, n_faces: Column, blink: Column, face_sharp: Column, composition_score: Column, blur_below: float = 100.0) -> Column:
    """What is worth saying about a photo, in a fixed order."""
    # The texts of the notes.
    return F.array_compact(
        F.array(
            F.when(variance < blur_below, F.lit("Image is noticeably blurry.")).when(sharp > 75, F.lit("Excellent sharpness and fine details.")),
            F.when(mean < 60, F.lit("Under-exposed (too dark).")).when(mean > 200, F.lit("Over-exposed (too bright/washed out).")).otherwise(F.lit("Balanced lighting/exposure.")),
            F.when(highlights > 0.05, F.format_string("Blown-out highlights (%.1f%% area).", highlights * 100)),
            F.when(shadows > 0.10, F.format_string("Crushed shadows (%.1f%% area).", shadows * 100)),
            F.when(motion, F.lit("Motion blur detected — camera shake or subject movement.")),
            F.when(n_faces > 0, F.format_string("Detected %d face(s).", n_faces)),
            F.when((n_faces > 0) & blink, F.lit("⚠️ Closed eyes / blink detected.")),
            F.when((n_faces > 0) & (face_sharp < 50), F.lit("Faces appear out of focus.")).when(n_faces > 0, F.lit("Faces are clear and sharp.")),
            F.when(composition_score > 80, F.lit("Strong framing (Rule of Thirds).")),
        )
    )


def rescaled(faces: Column, factor: Column, landmarks: bool = False) -> Column:
    """Face boxes in the size of the original picture, and with landmarks each face's points (array of structs x, y)."""
    at = lambda v: F.floor(v * factor).cast("long")
    points = lambda f: [F.transform(f["landmarks"], lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y"))).alias("landmarks")] if landmarks else []
    return F.transform(faces, lambda f: F.struct(f["face_id"].alias("face_id"), *(at(f[k]).alias(k) for k in ("x", "y", "w", "h")), *points(f)))
