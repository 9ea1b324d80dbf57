"""Scores and labels with known values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.functions import measures as M
from darkslide.functions import verdicts as V

FACE = "face_pos int, face_id long, person_id long, cluster_id long, x long, y long, w long, h long, sharpness long, camera_facing long, eye_openness long, smile long, face_exposure long, is_blink boolean"
PHOTO = f"photo_id long, group_id long, filename string, img_w long, img_h long, sharpness double, brightness double, contrast double, composition double, motion_blur double, has_motion_blur boolean, is_blurry boolean, stage_presence double, audience_presence double, branding_presence double, faces array<struct<{', '.join(f.replace(' ', ':') for f in FACE.split(', '))}>>"


def face(pos=1, x=400, y=150, w=50, h=50, sharpness=80, facing=90, eyes=90, smile=50, exposure=80, blink=False):
    return (pos, pos, None, 1, x, y, w, h, sharpness, facing, eyes, smile, exposure, blink)


def photo(spark, faces=(), **kw):
    base = {"photo_id": 1, "group_id": 1, "filename": "img.jpg", "img_w": 1000, "img_h": 1000, "sharpness": 80.0, "brightness": 80.0, "contrast": 80.0, "composition": 80.0, "motion_blur": 80.0, "has_motion_blur": False, "is_blurry": False, "stage_presence": 0.0, "audience_presence": 0.0, "branding_presence": 0.0}
    base |= kw
    return spark.createDataFrame([(*base.values(), list(faces))], PHOTO)


def one(spark, column, **inputs):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items())).select(column.alias("v")).first()["v"]


def test_clamp_and_rounding(spark):
    assert one(spark, M.clamp(F.col("a")), a=120.0) == 100.0
    assert one(spark, M.clamp(F.col("a")), a=-5.0) == 0.0
    assert one(spark, M.round1(F.col("a")), a=0.25) == 0.3


@pytest.mark.parametrize(("box", "score"), [((100, 1, 50, 50), 70.0), ((1, 50, 50, 50), 75.0), ((475, 150, 50, 50), 100.0)])
def test_completeness(spark, box, score):
    x, y, w, h = box
    df = photo(spark, [face(x=x, y=y, w=w, h=h)])
    assert df.select(V.completeness(F.col("img_w"), F.col("img_h"), F.col("faces"))).first()[0] == score


def test_completeness_without_faces(spark):
    assert photo(spark).select(V.completeness(F.col("img_w"), F.col("img_h"), F.col("faces"))).first()[0] == 100.0


@pytest.mark.parametrize(("left", "right", "state"), [(10, 10, "Closed"), (80, 10, "Wink"), (30, 30, "Squint"), (80, 90, "Fully open"), (60, 60, "Partially open")])
def test_eye_state(spark, left, right, state):
    assert one(spark, M.eye_state(F.col("l"), F.col("r")), l=left, r=right) == state


def publish(spark, overall, faces, **kw):
    df = V.with_face_summary(photo(spark, faces, **kw)).withColumns({"profile": V.profile(), "category": F.lit("Networking"), "overall": F.lit(overall), "completeness": F.lit(95.0), "subject_exposure": F.lit(85.0)})
    return df.select(V.publishability()).first()[0]


def test_publishability(spark):
    faces = [face(1, sharpness=80), face(2, sharpness=85), face(3, sharpness=75)]
    # .35 * 90 + .25 * 95 + .2 * 90 + .1 * 85 + .1 * 80 + 9
    assert round(publish(spark, 90.0, faces, composition=90.0), 2) == 98.75
    assert publish(spark, 40.0, [face(sharpness=40, blink=True, w=400, h=400)], composition=40.0, has_motion_blur=True) == 0.0


@pytest.mark.parametrize(
    ("faces", "kw", "label"),
    [
        ([], {"filename": "award_1.jpg"}, "Awards"),
        ([], {"filename": "sponsor_1.jpg"}, "Exhibition"),
        ([face(1, facing=50), face(2, x=700, facing=50)], {"stage_presence": 5.0}, "Networking"),
        ([face(1)], {"stage_presence": 40.0}, "Keynote"),
        ([face(1, x=100, y=300), face(2, x=700, y=300)], {"stage_presence": 40.0, "branding_presence": 0.0}, "Panel Discussion"),
        ([face(i, x=100 + 200 * i, y=300) for i in range(4)], {"stage_presence": 5.0}, "Group Photos"),
        ([face(i, x=100 * i, y=100 * i, facing=20) for i in range(7)], {"audience_presence": 80.0}, "Audience"),
        ([], {}, "Branding"),
    ],
)
def test_category(spark, faces, kw, label):
    assert V.with_face_summary(photo(spark, faces, **kw)).select(V.event_category()).first()[0] == label


def decision(spark, overall, publish_score, best=True, **kw):
    df = V.with_face_summary(photo(spark, [face()], **{k: v for k, v in kw.items() if k == "is_blurry"}))
    df = df.withColumns({"category": F.lit(kw.get("category", "Branding")), "overall": F.lit(overall), "publish": F.lit(publish_score), "hero": F.lit(kw.get("hero", True))})
    return df.select(V.editorial_decision(best)).first()[0]


def test_decisions(spark):
    assert decision(spark, 105.0, 99.5) == "HERO"
    assert decision(spark, 105.0, 99.5, best=False) == "MAYBE"
    assert decision(spark, 65.0, 55.0) == "KEEP"
    assert decision(spark, 105.0, 99.5, is_blurry=True) == "REJECT"
    assert decision(spark, 105.0, 99.5, is_blurry=True, category="Keynote") == "HERO"


def test_scene_reasons(spark):
    df = V.scored(photo(spark, sharpness=90.0, composition=90.0))
    reasons, strength = V.selection_reasons()
    got = df.select(reasons.alias("r"), strength.alias("s")).first()
    assert got["s"] == "sharpness" and got["r"][0] == "Excellent sharpness"


def test_story_scenes(spark):
    assert photo(spark).select(V.story_scene()).first()[0] == "Details/Decor"
    assert photo(spark, [face(w=200, h=200)]).select(V.story_scene()).first()[0] == "Portraits"
    assert photo(spark, [face(i, smile=s) for i, s in enumerate((10, 15, 20))]).select(V.story_scene()).first()[0] == "Ceremony"
    assert photo(spark, [face(i, smile=s) for i, s in enumerate((80, 75, 85))]).select(V.story_scene()).first()[0] == "Reception"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, z array<double>")
    a, b, c, z = (F.col(x) for x in "abcz")
    r = df.select(M.cosine(a, b).alias("ab"), M.cosine(a, c).alias("ac"), M.distance(a, c, "euclidean").alias("e"), M.cosine(a, z).alias("az"), M.normalized(z).alias("nz"), M.correlation(a, a).alias("r"), M.correlation(z, a).alias("flat")).first()
    assert (r["ab"], r["ac"], r["az"], r["nz"], r["flat"]) == (1.0, 0.0, 0.0, [0.0, 0.0], 1.0)
    assert abs(r["e"] - 2**0.5) < 1e-12 and abs(r["r"] - 1) < 1e-12
    with pytest.raises(ValueError):
        M.distance(a, b, "taxi")


def test_eye_aspect(spark):
    assert one(spark, M.eye_aspect(F.col("a"), F.col("b"), F.col("c")), a=3.0, b=3.0, c=0.0) == 0.0
    assert one(spark, M.eye_score(F.col("e")), e=0.30) == 100.0
    assert abs(one(spark, M.eye_score(F.col("e")), e=0.18) - 30.0) < 1e-9


def test_estimates(spark):
    df = spark.createDataFrame([(n,) for n in (0, 10, 1000, 4000, 5000)], T.StructType([T.StructField("n", T.LongType())]))
    assert [r[0] for r in df.select(M.scan_estimate(F.col("n"))).collect()] == ["0 sec", "<1 sec", "~15 sec", "~1 min", "~1m 15s"]


def test_rows_of_faces_give_what_arrays_give(spark):
    faces = [
        [face(1, 10, 5, 60, 50, blink=True), face(2, 500, 150, 50, 60, facing=61, eyes=40), face(3, 900, 930, 60, 50, facing=20, eyes=7)],  # ties of area
        [face(1, 400, 200, 50, 50, sharpness=31, exposure=12)],
        [],
    ]
    nested = photo(spark, faces[0]).unionByName(photo(spark, faces[1], photo_id=2, img_h=600)).unionByName(photo(spark, faces[2], photo_id=3))
    photos = nested.drop("faces")
    rows = nested.select("photo_id", F.inline("faces"))
    stray = rows.withColumn("photo_id", F.lit(9).cast("long"))  # faces of no photo
    want = V.scored(nested).drop("faces")
    found = V.scored(photos, faces=rows.unionByName(stray)).select(*want.columns)
    assert sorted(found.collect()) == sorted(want.collect()) and found.dtypes == want.dtypes
    assert V.scored(photos, faces=rows.limit(0)).where("n_faces = 0 and completeness = 100").count() == 3
    assert V.with_face_rows(photos.limit(0), rows).count() == 0


def test_missing_measurements_of_rows_add_nothing(spark):
    rows = photo(spark, [face(1), (2, 2, None, 1, 700, 150, 40, 40, None, None, None, None, None, None)])
    one_row = V.with_face_rows(rows.drop("faces"), rows.select("photo_id", F.inline("faces"))).first()
    assert (one_row.n_faces, one_row.avg_sharpness, one_row.main_facing, one_row.has_blink, one_row.all_facing) == (2, 40.0, 90.0, False, True)
