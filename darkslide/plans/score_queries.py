"""Queries P1 to P43 and A16: scores, labels and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions import measures as M
from darkslide.functions import verdicts as V
from darkslide.functions.features import feature, vectorized, with_features
from darkslide.plans.fixtures import face_rows, photo_rows, photos, sql_views, table
from darkslide.plans.registry import query

R1 = "floor(({0})*10+0.5)/10"


def r1(x: str) -> str:
    return R1.format(x)


#: Faces reduced to one row per photo, and all scores, for DuckDB.
SCORED_SQL = (
    sql_views("v_face", "v_photo")
    + f""",
fmain AS (SELECT photo_id, camera_facing AS main_facing, eye_openness AS main_eyes, w*h AS area FROM
  (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY w*h DESC, face_pos) rn FROM v_face) WHERE rn=1),
fone AS (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE
   - CASE WHEN x<=2 OR x+w>=1022 THEN 25.0 WHEN x<51.2::DOUBLE OR x+w>(1024.0-51.2)::DOUBLE THEN 10.0 ELSE 0.0 END
   - CASE WHEN y<=2 THEN 30.0 WHEN y<(0.05::DOUBLE*683) THEN 12.0 ELSE 0.0 END
   - CASE WHEN y+h>=681 THEN 20.0 WHEN 683-(y+h)<(0.05::DOUBLE*683) THEN 10.0 ELSE 0.0 END) AS fs FROM v_face),
fa AS (SELECT photo_id, count(*) AS n, sum(sharpness)::DOUBLE/count(*) AS avg_sharpness, max(w*h)::DOUBLE AS max_area,
   bool_or(is_blink) AS has_blink, ((max(y::DOUBLE+h/2.0::DOUBLE)-min(y::DOUBLE+h/2.0::DOUBLE))/683.0::DOUBLE) AS y_spread,
   sum(y::DOUBLE+h/2.0::DOUBLE)/count(*)/683.0::DOUBLE AS avg_y, (max(x+w)-min(x))::DOUBLE/1024.0::DOUBLE AS width_ratio,
   min(w)::DOUBLE/max(w)::DOUBLE AS size_ratio, bool_and(camera_facing>=65) AS all_facing, bool_or(camera_facing<70) AS any_away,
   count(*) FILTER (camera_facing>=60) >= (count(*)+1)//2 AS majority_facing, sum(face_exposure)::DOUBLE/count(*) AS exposure,
   sum(smile)::DOUBLE/count(*) AS avg_smile,
   sum(fs)::DOUBLE/count(*) AS frame, min(x)::DOUBLE/1024.0::DOUBLE AS lm, (1024.0::DOUBLE-max(x+w)::DOUBLE)/1024.0::DOUBLE AS rm, min(y)::DOUBLE/683.0::DOUBLE AS tm
   FROM fone GROUP BY photo_id),
p1 AS (SELECT p.* EXCLUDE (sharpness, brightness, contrast, composition, motion_blur, stage_presence, audience_presence, branding_presence),
   p.sharpness::DOUBLE AS sharpness, p.brightness::DOUBLE AS brightness, p.contrast::DOUBLE AS contrast, p.composition::DOUBLE AS composition, p.motion_blur::DOUBLE AS motion_blur,
   p.stage_presence::DOUBLE AS stage_presence, p.audience_presence::DOUBLE AS audience_presence, p.branding_presence::DOUBLE AS branding_presence,
   coalesce(n,0) AS n_faces, coalesce(fa.avg_sharpness,0.0::DOUBLE) AS avg_sharpness, coalesce(max_area,0.0::DOUBLE) AS max_area,
   coalesce(least(100.0::DOUBLE, max_area/(1024.0::DOUBLE*683.0::DOUBLE)/0.10::DOUBLE*100.0::DOUBLE),0.0::DOUBLE) AS face_size_factor,
   coalesce(main_facing::DOUBLE,0.0::DOUBLE) AS main_facing, coalesce(main_eyes::DOUBLE,100.0::DOUBLE) AS main_eyes, coalesce(has_blink,false) AS has_blink,
   coalesce(y_spread,0.0::DOUBLE) AS y_spread, coalesce(avg_y,0.0::DOUBLE) AS avg_y, coalesce(width_ratio,0.0::DOUBLE) AS width_ratio, coalesce(size_ratio,0.0::DOUBLE) AS size_ratio,
   coalesce(all_facing,true) AS all_facing, coalesce(any_away,false) AS any_away, coalesce(majority_facing,true) AS majority_facing, avg_smile,
   coalesce({r1("0.70::DOUBLE*exposure+0.30::DOUBLE*p.brightness::DOUBLE")}, p.brightness::DOUBLE) AS subject_exposure,
   CASE WHEN n IS NULL THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE,least(100.0::DOUBLE, frame + (CASE WHEN abs(lm-rm)<0.08::DOUBLE THEN 5.0 ELSE 0.0 END + CASE WHEN tm>=0.10::DOUBLE AND tm<=0.25::DOUBLE THEN 5.0 ELSE 0.0 END)::DOUBLE)) END AS completeness
   FROM v_photo p LEFT JOIN fa USING (photo_id) LEFT JOIN fmain USING (photo_id)),
p2 AS (SELECT *, CASE WHEN n_faces=0 THEN 'scene' WHEN n_faces>=3 OR face_size_factor<30 THEN 'group' ELSE 'portrait' END AS profile,
   CASE WHEN filename LIKE '%award%' OR filename LIKE '%handover%' OR filename LIKE '%winner%' THEN 'Awards'
    WHEN filename LIKE '%sponsor%' OR filename LIKE '%booth%' OR filename LIKE '%exhib%' THEN 'Exhibition'
    WHEN n_faces BETWEEN 2 AND 4 AND stage_presence>=25 AND all_facing AND y_spread<0.08::DOUBLE AND avg_y<0.35::DOUBLE AND width_ratio<0.5::DOUBLE AND size_ratio>=0.7::DOUBLE THEN 'Awards'
    WHEN n_faces>=3 AND majority_facing AND y_spread<0.08::DOUBLE AND width_ratio>=0.35::DOUBLE AND audience_presence<40 THEN 'Group Photos'
    WHEN branding_presence>=25 AND stage_presence<35 AND n_faces<=4 THEN 'Exhibition'
    WHEN n_faces>=2 AND stage_presence>=20 AND width_ratio>=0.2::DOUBLE AND y_spread<0.15::DOUBLE AND avg_y>=0.15::DOUBLE AND avg_y<=0.65::DOUBLE AND audience_presence<40 THEN 'Panel Discussion'
    WHEN n_faces=1 AND stage_presence>=25 AND max_area/(1024.0::DOUBLE*683.0::DOUBLE)<0.08::DOUBLE THEN 'Keynote'
    WHEN n_faces BETWEEN 1 AND 6 AND stage_presence<25 AND audience_presence<35 AND (n_faces<=2 OR any_away) THEN 'Networking'
    WHEN audience_presence>=35 OR n_faces>=5 THEN 'Audience' WHEN n_faces=0 THEN 'Branding'
    WHEN max_area/(1024.0::DOUBLE*683.0::DOUBLE)<0.002::DOUBLE AND branding_presence>15 AND stage_presence<25 THEN 'Branding'
    WHEN stage_presence>=25 AND n_faces=1 THEN 'Keynote' WHEN stage_presence>=25 THEN 'Panel Discussion' ELSE 'Networking' END AS category FROM p1),
p3 AS (SELECT *, CASE WHEN branding_presence>20 THEN branding_presence/100.0::DOUBLE*8.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN stage_presence>20 THEN stage_presence/100.0::DOUBLE*5.0::DOUBLE ELSE 0.0::DOUBLE END AS marketing_bonus,
   (CASE WHEN filename LIKE '%award%' THEN 8.0 WHEN filename LIKE '%shaking%' OR filename LIKE '%handshake%' OR filename LIKE '%celebrat%' OR filename LIKE '%audience%' OR filename LIKE '%reaction%' THEN 6.0
     WHEN filename LIKE '%network%' OR filename LIKE '%vip%' OR filename LIKE '%sponsor%' THEN 5.0 WHEN filename LIKE '%gesture%' OR filename LIKE '%keynote%' OR filename LIKE '%panel%' THEN 4.0 ELSE 0.0 END)::DOUBLE
   + (CASE category WHEN 'Networking' THEN 5.0 WHEN 'Audience' THEN 6.0 WHEN 'Group Photos' THEN 4.0 WHEN 'Keynote' THEN 4.0 WHEN 'Panel Discussion' THEN 4.0 WHEN 'Awards' THEN 6.0 ELSE 0.0 END)::DOUBLE AS story_bonus,
   CASE WHEN NOT (n_faces>0 AND avg_sharpness>=60) AND has_motion_blur THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS blur,
   CASE WHEN category<>'Audience' AND has_blink THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS blinkp,
   CASE WHEN category<>'Audience' AND n_faces>0 AND avg_sharpness<45 THEN 35.0::DOUBLE ELSE 0.0::DOUBLE END AS soft,
   CASE WHEN stage_presence>30 OR branding_presence>30 THEN least(12.0::DOUBLE,(stage_presence+branding_presence)/15.0::DOUBLE) ELSE 0.0::DOUBLE END AS venue FROM p2),
p4 AS (SELECT *, greatest(0.0::DOUBLE, CASE profile
   WHEN 'group' THEN 0.10::DOUBLE*main_facing+0.10::DOUBLE*main_eyes+0.20::DOUBLE*avg_sharpness+0.20::DOUBLE*subject_exposure+0.10::DOUBLE*contrast+0.20::DOUBLE*composition+0.10::DOUBLE*completeness-blur-blinkp-soft+marketing_bonus+story_bonus
   WHEN 'portrait' THEN 0.25::DOUBLE*main_facing+0.20::DOUBLE*main_eyes+0.20::DOUBLE*avg_sharpness+0.10::DOUBLE*face_size_factor+0.15::DOUBLE*subject_exposure+0.10::DOUBLE*contrast-blur-blinkp-soft+marketing_bonus+story_bonus
   ELSE 0.35::DOUBLE*sharpness+0.20::DOUBLE*brightness+0.15::DOUBLE*contrast+0.15::DOUBLE*composition+0.15::DOUBLE*motion_blur-blur-25.0::DOUBLE+venue+story_bonus END) AS overall FROM p3),
p5 AS (SELECT *, greatest(0.0::DOUBLE, CASE profile
   WHEN 'group' THEN 0.35::DOUBLE*overall+0.25::DOUBLE*completeness+0.20::DOUBLE*composition+0.10::DOUBLE*subject_exposure+0.10::DOUBLE*avg_sharpness+least(15.0::DOUBLE,n_faces*3.0::DOUBLE)
   WHEN 'portrait' THEN 0.40::DOUBLE*overall+0.20::DOUBLE*completeness+0.15::DOUBLE*composition+0.15::DOUBLE*avg_sharpness+0.10::DOUBLE*main_eyes
   ELSE 0.45::DOUBLE*overall+0.20::DOUBLE*composition+0.20::DOUBLE*sharpness+0.15::DOUBLE*contrast END
   - ((CASE WHEN has_motion_blur AND NOT (n_faces>0 AND avg_sharpness>=60) THEN 40.0 ELSE 0.0 END + CASE WHEN has_blink AND category<>'Audience' THEN 30.0 ELSE 0.0 END)::DOUBLE
   + CASE WHEN n_faces>0 AND avg_sharpness<45 AND category<>'Audience' THEN 30.0 ELSE 0.0 END)) AS publish FROM p4),
p6 AS (SELECT *, (category<>'Branding' OR branding_presence>=75) AND overall>=95 AND publish>=90 AND composition>=85 AND completeness>=85 AND (n_faces=0 OR avg_sharpness>=70)
   AND (branding_presence>30 OR stage_presence>40 OR audience_presence>40 OR story_bonus>0) AS hero FROM p5),
scored AS (SELECT *, CASE WHEN overall<40 OR publish<35 OR (is_blurry AND category NOT IN ('Audience','Networking','Group Photos','Awards','Keynote','Panel Discussion'))
     OR (has_motion_blur AND NOT (n_faces>0 AND avg_sharpness>=60)) OR (has_blink AND category<>'Audience') OR brightness<30 OR brightness>220 OR completeness<50 THEN 'REJECT'
   WHEN overall>=100 AND publish>=99 AND hero THEN 'HERO'
   WHEN overall>=CASE WHEN category IN ('Branding','Exhibition') AND n_faces=0 THEN 75 ELSE 60 END AND publish>=CASE WHEN category IN ('Branding','Exhibition') AND n_faces=0 THEN 60 ELSE 50 END THEN 'KEEP'
   ELSE 'MAYBE' END AS decision FROM p6)
"""
)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return V.scored(photo_rows(spark, d), faces=face_rows(spark, d))


@query("p01_file_kinds", """WITH t AS (SELECT page_id, CASE WHEN page_id%4=0 THEN concat('IMG_',page_id,'.JPG') WHEN page_id%4=1 THEN concat('dir/a.b_',page_id,'.nef') WHEN page_id%4=2 THEN split_part(url,'?',1) ELSE concat('noext',page_id) END AS name FROM pages)
SELECT page_id, CASE WHEN contains(name,'.') THEN lower(split_part(name,'.',-1)) END AS ext, coalesce(lower(split_part(name,'.',-1)) IN ('png','jpg','jpeg','webp','bmp','tiff') AND contains(name,'.'),false) AS allowed,
 coalesce(lower(split_part(name,'.',-1)) IN ('cr2','cr3','nef','nrw','arw','orf','raf','rw2','dng','pef','x3f') AND contains(name,'.'),false) AS raw, split_part(name,'/',-1) AS display FROM t""")
def p01(spark, d):
    name = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("IMG_"), F.col("page_id"), F.lit(".JPG"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("dir/a.b_"), F.col("page_id"), F.lit(".nef"))).when(F.col("page_id") % 4 == 2, F.substring_index("url", "?", 1)).otherwise(F.concat(F.lit("noext"), F.col("page_id")))
    t = table(spark, d, "pages").select("page_id", name.alias("name"))
    return t.select("page_id", M.extension(F.col("name")).alias("ext"), M.is_allowed(F.col("name"), M.ALLOWED).alias("allowed"), M.is_allowed(F.col("name"), M.RAW).alias("raw"), F.substring_index("name", "/", -1).alias("display"))


@query("p02_aspect_ratio", "SELECT p_partkey, CASE WHEN least(p_size%7,p_size)=0 THEN 1.0::DOUBLE ELSE greatest(p_size%7,p_size)::DOUBLE/least(p_size%7,p_size)::DOUBLE END AS ratio, (abs(p_size-p_partkey%50)::DOUBLE/nullif(greatest(p_size,p_partkey%50),0)::DOUBLE) AS difference FROM part")
def p02(spark, d):
    a, b = M.num(F.col("p_size") % 7), M.num("p_size")
    return table(spark, d, "part").select("p_partkey", M.aspect_ratio(a, b).alias("ratio"), M.relative_difference(b, M.num(F.col("p_partkey") % 50)).alias("difference"))


@query("p03_clamp", "SELECT p_partkey, greatest(0.0::DOUBLE, least(100.0::DOUBLE, p_retailprice-950)) AS score FROM part")
def p03(spark, d):
    return table(spark, d, "part").select("p_partkey", M.clamp(F.col("p_retailprice") - 950).alias("score"))


@query("p04_dynamic_denominator", "SELECT o_orderkey, CASE WHEN (o_orderkey%50)*(o_custkey%3000)=0 THEN 25.0::DOUBLE ELSE 25.0::DOUBLE*greatest(0.5::DOUBLE,least(2.5::DOUBLE,sqrt((o_orderkey%50*100)::DOUBLE*(o_custkey%3000)::DOUBLE/2073600.0::DOUBLE))) END AS denominator FROM orders")
def p04(spark, d):
    w, h = M.num(F.col("o_orderkey") % 50 * 100), M.num(F.col("o_custkey") % 3000)
    return table(spark, d, "orders").select("o_orderkey", M.dynamic_denominator(w, h, 25.0).alias("denominator"))


@query("p05_sharpness", f"SELECT o_orderkey, {r1('100*(1.0::DOUBLE-exp(-(0.6::DOUBLE*(o_orderkey%97)::DOUBLE+0.4::DOUBLE*(o_custkey%89)::DOUBLE)/25.0::DOUBLE))')} AS sharpness, 0.6::DOUBLE*(o_orderkey%97)::DOUBLE+0.4::DOUBLE*(o_custkey%89)::DOUBLE<100 AS blurry FROM orders")
def p05(spark, d):
    v = M.edge_variance(M.num(F.col("o_orderkey") % 97), M.num(F.col("o_custkey") % 89))
    return table(spark, d, "orders").select("o_orderkey", M.sharpness(v, F.lit(25.0)).alias("sharpness"), (v < 100).alias("blurry"))


@query("p06_exposure", f"SELECT o_orderkey, {r1('greatest(0.0::DOUBLE, greatest(0.0::DOUBLE,100.0::DOUBLE-abs((o_orderkey%256)::DOUBLE-130.0::DOUBLE)*(100.0::DOUBLE/120.0::DOUBLE))-((o_custkey%10)::DOUBLE/100.0::DOUBLE*80.0::DOUBLE+(o_orderkey%13)::DOUBLE/100.0::DOUBLE*12.0::DOUBLE))')} AS exposure FROM orders")
def p06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.exposure(M.num(F.col("o_orderkey") % 256), M.num(F.col("o_custkey") % 10) / 100.0, M.num(F.col("o_orderkey") % 13) / 100.0).alias("exposure"))


@query("p07_contrast_saturation", f"SELECT o_orderkey, {r1('least(100.0::DOUBLE,(o_orderkey%90)::DOUBLE/70.0::DOUBLE*100.0::DOUBLE)')} AS contrast, {r1('least(100.0::DOUBLE,(o_custkey%200)::DOUBLE/120.0::DOUBLE*100.0::DOUBLE)')} AS saturation FROM orders")
def p07(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.contrast(M.num(F.col("o_orderkey") % 90)).alias("contrast"), M.saturation(M.num(F.col("o_custkey") % 200)).alias("saturation"))


@query("p08_subject_exposure", SCORED_SQL + "SELECT photo_id, subject_exposure FROM p1")
def p08(spark, d):
    return V.with_face_rows(photo_rows(spark, d), face_rows(spark, d)).select("photo_id", "subject_exposure")


EAR_L = "(CASE WHEN l_linenumber=7 THEN 0.0::DOUBLE ELSE ((l_partkey%20)::DOUBLE+(l_suppkey%20)::DOUBLE)/(2.0::DOUBLE*(60+l_linenumber)::DOUBLE) END)"
EAR_R = "(((l_partkey%23)::DOUBLE+(l_suppkey%17)::DOUBLE)/(2.0::DOUBLE*60.0::DOUBLE))"


def _eye(e: str) -> str:
    return f"(CASE WHEN {e}<=0.18::DOUBLE THEN greatest(0.0::DOUBLE,{e}/0.18::DOUBLE*30.0::DOUBLE) ELSE least(100.0::DOUBLE,30.0::DOUBLE+({e}-0.18::DOUBLE)/0.12::DOUBLE*70.0::DOUBLE) END)"


@query("p09_eye_aspect", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {EAR_L} AS ear_left, {EAR_R} AS ear_right, {EAR_L}<0.2::DOUBLE OR {EAR_R}<0.2::DOUBLE AS blink, least({_eye(EAR_L)},{_eye(EAR_R)}) AS openness FROM lineitem")
def p09(spark, d):
    c = F.col
    across = F.when(c("l_linenumber") == 7, 0.0).otherwise(M.num(60 + c("l_linenumber")))
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", M.eye_aspect(M.num(c("l_partkey") % 20), M.num(c("l_suppkey") % 20), across).alias("ear_left"), M.eye_aspect(M.num(c("l_partkey") % 23), M.num(c("l_suppkey") % 17), F.lit(60.0)).alias("ear_right")
    )
    return t.withColumns({"blink": (c("ear_left") < 0.2) | (c("ear_right") < 0.2), "openness": F.least(M.eye_score(c("ear_left")), M.eye_score(c("ear_right")))})


@query("p10_smile", "SELECT o_orderkey, least(100.0::DOUBLE,greatest(0.0::DOUBLE,(CASE WHEN o_custkey%50>0 THEN ((o_orderkey%21)-10)::DOUBLE/(o_custkey%50)::DOUBLE ELSE 0.0::DOUBLE END+0.02::DOUBLE)/0.12::DOUBLE*100.0::DOUBLE)) AS smile FROM orders")
def p10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.smile(M.num(F.col("o_orderkey") % 21 - 10), M.num(F.col("o_custkey") % 50)).alias("smile"))


@query("p11_occlusion", sql_views("v_face") + " SELECT photo_id, CASE WHEN bool_or(x<20.48::DOUBLE OR x>1024-20.48::DOUBLE OR y<0.02::DOUBLE*683 OR y>683-0.02::DOUBLE*683) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS occlusion FROM v_face GROUP BY photo_id")
def p11(spark, d):
    return face_rows(spark, d).groupBy("photo_id").agg(M.occlusion_of_rows(F.col("x"), F.col("y"), F.lit(1024.0), F.lit(683.0)).alias("occlusion"))


@query("p12_head_pose_angles", f"""SELECT o_orderkey, round(CASE WHEN o_custkey%9=0 THEN 0.0 ELSE degrees(atan2((o_orderkey%21-10)::DOUBLE,(o_custkey%9)::DOUBLE)) END, 6) AS roll,
 CASE WHEN o_orderkey%40+o_custkey%30>0 THEN {r1('degrees(atan2((o_orderkey%40-o_custkey%30)::DOUBLE,(o_orderkey%40+o_custkey%30)::DOUBLE/2))*1.5::DOUBLE')} ELSE 0.0 END AS yaw, {r1('(o_orderkey%101)::DOUBLE-90.0')} AS pitch FROM orders""")
def p12(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(M.head_roll(M.num(k % 21 - 10), M.num(c % 9)), 6).alias("roll"), M.head_yaw(M.num(k % 40), M.num(c % 30)).alias("yaw"), M.head_pitch(M.num(k % 101)).alias("pitch"))


POSE = r1("greatest(0.0::DOUBLE,100.0::DOUBLE-(abs(yaw)+abs(pitch)+abs(roll))::DOUBLE*1.2::DOUBLE)")


@query("p13_head_pose_score", sql_views("v_face") + f" SELECT face_id, {POSE} AS head_pose, abs(yaw)<15 AND abs(pitch)<15 AS looking FROM v_face")
def p13(spark, d):
    return face_rows(spark, d).select("face_id", M.head_pose(F.col("yaw"), F.col("pitch"), F.col("roll")).alias("head_pose"), M.looking(F.col("yaw"), F.col("pitch")).alias("looking"))


@query("p14_lighting", sql_views("v_face") + f" SELECT face_id, {r1('greatest(0.0::DOUBLE,1.0::DOUBLE-abs((face_exposure*2)::DOUBLE-130.0::DOUBLE)/110.0::DOUBLE)*least(1.0::DOUBLE,lighting::DOUBLE/40.0::DOUBLE)*100.0::DOUBLE')} AS lighting_quality FROM v_face")
def p14(spark, d):
    return face_rows(spark, d).select("face_id", M.lighting(M.num(F.col("face_exposure") * 2), M.num("lighting")).alias("lighting_quality"))


@query("p15_expression", sql_views("v_face") + f" SELECT face_id, {r1('0.4::DOUBLE*eye_openness::DOUBLE+0.6::DOUBLE*smile::DOUBLE')} AS expression, {r1('100.0::DOUBLE-eye_openness::DOUBLE')} AS blink_probability FROM v_face")
def p15(spark, d):
    return face_rows(spark, d).select("face_id", M.expression(M.num("eye_openness"), M.num("smile")).alias("expression"), M.blink_probability(M.num("eye_openness")).alias("blink_probability"))


QUALITY = r1(f"0.3::DOUBLE*sharpness::DOUBLE+0.2::DOUBLE*eye_openness::DOUBLE+0.15::DOUBLE*smile::DOUBLE+0.15::DOUBLE*({POSE})+0.1::DOUBLE*lighting::DOUBLE+0.1::DOUBLE*(100.0::DOUBLE-occlusion::DOUBLE)")


def quality_of(f=F.col):
    """Face quality of a row (f = F.col) or of a face struct (f = its getter)."""
    return M.face_quality(*(f(k).cast("double") for k in ("sharpness", "eye_openness", "smile")), M.head_pose(f("yaw"), f("pitch"), f("roll")), f("lighting").cast("double"), f("occlusion").cast("double"))


@query("p16_face_quality", sql_views("v_face") + f" SELECT face_id, {QUALITY} AS face_quality FROM v_face")
def p16(spark, d):
    return face_rows(spark, d).select("face_id", quality_of().alias("face_quality"))


def _third(c: str) -> str:
    return f"greatest(0.0::DOUBLE,100.0::DOUBLE-least(abs({c}-0.333::DOUBLE),abs({c}-0.5::DOUBLE),abs({c}-0.666::DOUBLE))/0.16::DOUBLE*100.0::DOUBLE)"


@query("p17_thirds_placement", sql_views("v_face") + f" SELECT face_id, ({_third('((x::DOUBLE+w::DOUBLE/2.0::DOUBLE)/1024.0::DOUBLE)')}+{_third('((y::DOUBLE+h::DOUBLE/2.0::DOUBLE)/683.0::DOUBLE)')})/2.0::DOUBLE AS placement FROM v_face")
def p17(spark, d):
    return face_rows(spark, d).select("face_id", M.thirds_placement((M.num("x") + M.num("w") / 2.0) / 1024.0, (M.num("y") + M.num("h") / 2.0) / 683.0).alias("placement"))


@query("p18_eye_state", "SELECT o_orderkey, CASE WHEN l<20 AND r<20 THEN 'Closed' WHEN (l>=65 AND r<30) OR (r>=65 AND l<30) THEN 'Wink' WHEN l>=20 AND l<45 AND r>=20 AND r<45 THEN 'Squint' WHEN l>=75 AND r>=75 THEN 'Fully open' ELSE 'Partially open' END AS state FROM (SELECT o_orderkey, o_orderkey%101 AS l, o_custkey%101 AS r FROM orders)")
def p18(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.eye_state(F.col("o_orderkey") % 101, F.col("o_custkey") % 101).alias("state"))


GRID = ", ".join(f"o_orderkey%{k}" for k in (2, 3, 5, 7, 40, 4, 6, 8, 9))
_S = "+".join(f"o_orderkey%{k}" for k in (2, 3, 5, 7, 40, 4, 6, 8, 9))


@query("p19_composition", f"SELECT o_orderkey, CASE WHEN t=0 THEN 80.0::DOUBLE WHEN c>0.5::DOUBLE THEN {r1('greatest(30.0::DOUBLE,100.0::DOUBLE-(c-0.5::DOUBLE)*200.0::DOUBLE)')} ELSE {r1('least(100.0::DOUBLE,70.0::DOUBLE+(1.0::DOUBLE-abs(c-0.25::DOUBLE)*4.0::DOUBLE)*30.0::DOUBLE)')} END AS composition FROM (SELECT o_orderkey, ({_S}) AS t, (o_orderkey%40)::DOUBLE/nullif({_S},0)::DOUBLE AS c FROM orders)")
def p19(spark, d):
    grid = F.array(*(M.num(F.col("o_orderkey") % k) for k in (2, 3, 5, 7, 40, 4, 6, 8, 9)))
    return table(spark, d, "orders").select("o_orderkey", M.composition(grid).alias("composition"))


@query("p20_completeness", SCORED_SQL + "SELECT photo_id, completeness FROM p1")
def p20(spark, d):
    return photos(spark, d).select("photo_id", V.completeness(F.col("img_w"), F.col("img_h"), F.col("faces")).alias("completeness"))


@query("p21_profile", SCORED_SQL + "SELECT photo_id, n_faces::INTEGER AS n_faces, face_size_factor, main_facing, main_eyes, profile FROM p2")
def p21(spark, d):
    return V.with_face_rows(photo_rows(spark, d), face_rows(spark, d)).select("photo_id", "n_faces", "face_size_factor", "main_facing", "main_eyes", V.profile().alias("profile"))


@query("p22_keyword_bonus", SCORED_SQL + "SELECT photo_id, (CASE WHEN filename LIKE '%award%' THEN 8.0 WHEN filename LIKE '%handshake%' OR filename LIKE '%audience%' THEN 6.0 WHEN filename LIKE '%network%' OR filename LIKE '%vip%' OR filename LIKE '%sponsor%' THEN 5.0 WHEN filename LIKE '%keynote%' OR filename LIKE '%panel%' THEN 4.0 ELSE 0.0 END)::DOUBLE AS bonus FROM v_photo")
def p22(spark, d):
    return photo_rows(spark, d).select("photo_id", V.keyword_bonus().alias("bonus"))


@query("p23_bonuses", SCORED_SQL + "SELECT photo_id, marketing_bonus, story_bonus, venue AS venue_bonus FROM p3")
def p23(spark, d):
    return scored(spark, d).select("photo_id", "marketing_bonus", "story_bonus", V.venue_bonus().alias("venue_bonus"))


@query("p24_overall_score", SCORED_SQL + "SELECT photo_id, round(overall, 6) AS overall, round(overall + CASE WHEN category='Audience' THEN 5.0 ELSE 0.0 END + CASE WHEN audience_presence>=50 THEN 5.0 ELSE 0.0 END, 6) AS boosted FROM p4")
def p24(spark, d):
    return scored(spark, d).select("photo_id", F.round("overall", 6).alias("overall"), F.round(V.overall_score(boost=True), 6).alias("boosted"))


@query("p25_publishability", SCORED_SQL + "SELECT photo_id, round(publish, 6) AS publish FROM p5")
def p25(spark, d):
    return scored(spark, d).select("photo_id", F.round("publish", 6).alias("publish"))


@query("p26_hero_candidates", SCORED_SQL + "SELECT photo_id, hero FROM p6")
def p26(spark, d):
    return scored(spark, d).select("photo_id", "hero")


@query("p27_editorial_decision", SCORED_SQL + "SELECT photo_id, decision, CASE WHEN decision='REJECT' OR overall<60 THEN 'REJECT' ELSE 'MAYBE' END AS not_best FROM scored")
def p27(spark, d):
    return scored(spark, d).select("photo_id", "decision", V.editorial_decision(is_best=False).alias("not_best"))


@query("p28_event_category", SCORED_SQL + "SELECT photo_id, category FROM p2")
def p28(spark, d):
    return scored(spark, d).select("photo_id", "category")


_REASON = """, items AS (
 SELECT photo_id, -0.20::DOUBLE*composition AS k, 0 AS pos, 'composition' AS key, CASE WHEN composition>=85 THEN 'Excellent composition' ELSE 'Strong composition' END AS t, composition AS raw FROM p2 WHERE profile='group'
 UNION ALL SELECT photo_id, -0.20::DOUBLE*avg_sharpness, 1, 'face_sharpness', CASE WHEN avg_sharpness>=85 THEN 'Sharp faces' ELSE 'Good face sharpness' END, avg_sharpness FROM p2 WHERE profile='group'
 UNION ALL SELECT photo_id, -0.20::DOUBLE*subject_exposure, 2, 'exposure', CASE WHEN subject_exposure>=85 THEN 'Good localized exposure' ELSE 'Balanced exposure' END, subject_exposure FROM p2 WHERE profile='group'
 UNION ALL SELECT photo_id, -0.10::DOUBLE*completeness, 3, 'completeness', CASE WHEN n_faces>=3 THEN 'Complete group visibility' ELSE 'Complete subject framing' END, completeness FROM p2 WHERE profile='group'
 UNION ALL SELECT photo_id, -0.10::DOUBLE*main_facing, 4, 'camera_facing', CASE WHEN main_facing>=85 THEN 'Facing camera' ELSE 'Good camera angle' END, main_facing FROM p2 WHERE profile='group'
 UNION ALL SELECT photo_id, -0.10::DOUBLE*main_eyes, 5, 'eyes_open', CASE WHEN main_eyes>=85 THEN 'Clear expression (no blinks)' ELSE 'Eyes open' END, main_eyes FROM p2 WHERE profile='group'
 UNION ALL SELECT photo_id, -0.10::DOUBLE*contrast, 6, 'contrast', CASE WHEN contrast>=80 THEN 'Vibrant lighting' ELSE 'Good contrast' END, contrast FROM p2 WHERE profile='group'
 UNION ALL SELECT photo_id, -0.25::DOUBLE*main_facing, 0, 'camera_facing', CASE WHEN main_facing>=85 THEN 'Facing camera' ELSE 'Good camera angle' END, main_facing FROM p2 WHERE profile='portrait'
 UNION ALL SELECT photo_id, -0.20::DOUBLE*main_eyes, 1, 'eyes_open', CASE WHEN main_eyes>=85 THEN 'Clear expression (no blinks)' ELSE 'Eyes open' END, main_eyes FROM p2 WHERE profile='portrait'
 UNION ALL SELECT photo_id, -0.20::DOUBLE*avg_sharpness, 2, 'face_sharpness', CASE WHEN avg_sharpness>=85 THEN 'Sharp faces' ELSE 'Good face sharpness' END, avg_sharpness FROM p2 WHERE profile='portrait'
 UNION ALL SELECT photo_id, -0.15::DOUBLE*subject_exposure, 3, 'exposure', CASE WHEN subject_exposure>=85 THEN 'Good localized exposure' ELSE 'Balanced exposure' END, subject_exposure FROM p2 WHERE profile='portrait'
 UNION ALL SELECT photo_id, -0.10::DOUBLE*face_size_factor, 4, 'face_size', 'Clear portrait focus', face_size_factor FROM p2 WHERE profile='portrait'
 UNION ALL SELECT photo_id, -0.10::DOUBLE*contrast, 5, 'contrast', CASE WHEN contrast>=80 THEN 'Vibrant lighting' ELSE 'Good contrast' END, contrast FROM p2 WHERE profile='portrait'
 UNION ALL SELECT photo_id, -0.35::DOUBLE*sharpness, 0, 'sharpness', CASE WHEN sharpness>=85 THEN 'Excellent sharpness' ELSE 'Sharp image details' END, sharpness FROM p2 WHERE profile='scene'
 UNION ALL SELECT photo_id, -0.20::DOUBLE*brightness, 1, 'exposure', 'Balanced exposure', brightness FROM p2 WHERE profile='scene'
 UNION ALL SELECT photo_id, -0.15::DOUBLE*contrast, 2, 'contrast', CASE WHEN contrast>=80 THEN 'Vibrant lighting' ELSE 'Good contrast' END, contrast FROM p2 WHERE profile='scene'
 UNION ALL SELECT photo_id, -0.15::DOUBLE*composition, 3, 'composition', CASE WHEN composition>=85 THEN 'Excellent composition' ELSE 'Strong composition' END, composition FROM p2 WHERE profile='scene'
 UNION ALL SELECT photo_id, -0.15::DOUBLE*motion_blur, 4, 'motion_blur', 'No motion blur', motion_blur FROM p2 WHERE profile='scene'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY k, pos) AS rn, bool_or(raw>=65) OVER (PARTITION BY photo_id) AS any_good FROM items)
SELECT photo_id, string_agg(t, '; ' ORDER BY rn) FILTER (raw>=65 OR (NOT any_good AND rn<=2)) AS reasons, max(key) FILTER (rn=1) AS strength FROM ranked GROUP BY photo_id"""


@query("p29_selection_reasons", SCORED_SQL.rstrip() + _REASON)
def p29(spark, d):
    reasons, strength = V.selection_reasons()
    return scored(spark, d).select("photo_id", F.array_join(reasons, "; ").alias("reasons"), strength.alias("strength"))


@query("p30_analysis_notes", """SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey%300<100 THEN 'Image is noticeably blurry.' WHEN o_orderkey%101>75 THEN 'Excellent sharpness and fine details.' END,
 CASE WHEN o_custkey%256<60 THEN 'Under-exposed (too dark).' WHEN o_custkey%256>200 THEN 'Over-exposed (too bright/washed out).' ELSE 'Balanced lighting/exposure.' END,
 CASE WHEN o_orderkey%16>5 THEN printf('Blown-out highlights (%.1f%% area).', (o_orderkey%16)::DOUBLE) END, CASE WHEN o_custkey%25>10 THEN printf('Crushed shadows (%.1f%% area).', (o_custkey%25)::DOUBLE) END,
 CASE WHEN o_orderkey%11=0 THEN 'Motion blur detected — camera shake or subject movement.' END, CASE WHEN o_orderkey%5>0 THEN printf('Detected %d face(s).', (o_orderkey%5)::INTEGER) END,
 CASE WHEN o_orderkey%5>0 AND o_custkey%7=0 THEN '⚠️ Closed eyes / blink detected.' END, CASE WHEN o_orderkey%5>0 AND o_custkey%100<50 THEN 'Faces appear out of focus.' WHEN o_orderkey%5>0 THEN 'Faces are clear and sharp.' END,
 CASE WHEN o_custkey%101>80 THEN 'Strong framing (Rule of Thirds).' END) AS notes FROM orders""")
def p30(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    notes = V.analysis_notes(k % 300, k % 101, c % 256, M.num(k % 16) / 100, M.num(c % 25) / 100, k % 11 == 0, (k % 5).cast("int"), c % 7 == 0, c % 100, c % 101)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(notes, " ").alias("notes"))


_C, _S2 = "least(100.0::DOUBLE,(o_orderkey%40)::DOUBLE/100.0::DOUBLE*400.0::DOUBLE)", "least(100.0::DOUBLE,(o_custkey%30)::DOUBLE/100.0::DOUBLE*500.0::DOUBLE)"
_SPOT = "(CASE WHEN o_orderkey%90>o_custkey%80 THEN least(100.0::DOUBLE,(o_orderkey%90-o_custkey%80)::DOUBLE*4.0::DOUBLE) ELSE 0.0::DOUBLE END)"
_ROWS = "least(100.0::DOUBLE,(o_custkey%30)::DOUBLE/100.0::DOUBLE*350.0::DOUBLE)"


@query("p31_presence_scores", f"""SELECT o_orderkey, {r1(f"greatest(0.0::DOUBLE,least(100.0::DOUBLE,CASE WHEN n>0 THEN 0.35::DOUBLE*{_C}+0.35::DOUBLE*{_SPOT}+0.30::DOUBLE*{_S2} ELSE 0.50::DOUBLE*{_C}+0.50::DOUBLE*{_S2} END + CASE WHEN o_orderkey%101>50 THEN ((o_orderkey%101)::DOUBLE-50.0::DOUBLE)*0.2::DOUBLE ELSE 0.0::DOUBLE END))")} AS stage,
 {r1(f"greatest(0.0::DOUBLE,least(100.0::DOUBLE,CASE WHEN n>=5 THEN 0.60::DOUBLE*CASE WHEN o_orderkey%10<5 THEN least(100.0::DOUBLE,n*10.0::DOUBLE+30.0::DOUBLE) ELSE least(100.0::DOUBLE,n*6.0::DOUBLE) END+0.40::DOUBLE*{_ROWS} ELSE least(70.0::DOUBLE,{_ROWS}) END))")} AS audience,
 {r1("0.50::DOUBLE*least(100.0::DOUBLE,(o_orderkey%17)*8.0::DOUBLE)+0.50::DOUBLE*least(100.0::DOUBLE,(o_custkey%19)*8.0::DOUBLE)")} AS branding FROM (SELECT *, o_orderkey%12 AS n FROM orders)""")
def p31(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = k % 12
    return table(spark, d, "orders").select(
        "o_orderkey",
        M.stage_presence(M.num(k % 40) / 100.0, M.num(c % 30) / 100.0, n, M.num(k % 90), M.num(c % 80), M.num(k % 101)).alias("stage"),
        M.audience_presence(n, M.num(k % 10) / 1000.0, M.num(c % 30) / 100.0).alias("audience"),
        M.branding_presence(M.num(k % 17), M.num(c % 19)).alias("branding"),
    )


@query("p32_story_scene", SCORED_SQL + "SELECT photo_id, CASE WHEN n_faces=0 THEN 'Details/Decor' WHEN n_faces<=2 THEN 'General' WHEN n_faces<=6 AND avg_smile>60 THEN 'Reception' WHEN n_faces<=6 THEN 'Ceremony' WHEN avg_smile>55 THEN 'Dance Floor' ELSE 'Ceremony' END AS scene FROM p1")
def p32(spark, d):
    return photos(spark, d).select("photo_id", V.story_scene().alias("scene"))


feature("n_faces", "faces")(lambda: F.size("faces"))
feature("scene", "faces")(V.story_scene)
feature("crowded", "n_faces", "scene")(lambda: (F.col("n_faces") > 6) & (F.col("scene") == "Ceremony"))


@query("p44_named_features", SCORED_SQL + "SELECT photo_id, n_faces::INTEGER AS n_faces, CASE WHEN n_faces=0 THEN 'Details/Decor' WHEN n_faces<=2 THEN 'General' WHEN n_faces<=6 AND avg_smile>60 THEN 'Reception' WHEN n_faces<=6 THEN 'Ceremony' WHEN avg_smile>55 THEN 'Dance Floor' ELSE 'Ceremony' END AS scene, n_faces>6 AND avg_smile<=55 AS crowded FROM p1")
def p44(spark, d):
    return with_features(photos(spark, d), "crowded").select("photo_id", "n_faces", "scene", "crowded")


FACE_QUALITY_AVG = f", fq AS (SELECT photo_id, sum(10*{QUALITY})::DOUBLE AS q10, count(*) AS n FROM v_face GROUP BY photo_id)"


@query("p44_vectorised", """SELECT page_id, length(url)::INTEGER AS n_chars, (length(url)-length(replace(url,'/','')))::INTEGER AS n_slashes, (length(url)-length(replace(url,'1','')))::INTEGER AS n_ones FROM pages""")
def p44_vectors(spark, d):
    """A user's own model, called with batches of texts in each task: here one that counts characters."""

    def load():
        return lambda texts: [[len(x), x.count("/"), x.count("1")] for x in texts]

    v = vectorized(table(spark, d, "pages").select("page_id", "url"), "url", load)
    return v.select("page_id", *(F.element_at("vec", i + 1).cast("int").alias(n) for i, n in enumerate(("n_chars", "n_slashes", "n_ones"))))


@query("p33_highlight_score", sql_views("v_face", "v_photo") + FACE_QUALITY_AVG + " SELECT photo_id, CASE WHEN n IS NULL THEN 50.0 ELSE round(q10/10.0/n, 4) END AS score FROM v_photo LEFT JOIN fq USING (photo_id)")
def p33(spark, d):
    return photos(spark, d).select("photo_id", F.round(V.highlight_score(lambda f: quality_of(lambda k: f[k])), 4).alias("score"))


@query("p34_rescaled_boxes", sql_views("v_face") + " SELECT face_id, floor(x*2.5::DOUBLE)::BIGINT AS x, floor(y*2.5::DOUBLE)::BIGINT AS y, floor(w*2.5::DOUBLE)::BIGINT AS w, floor(h*2.5::DOUBLE)::BIGINT AS h FROM v_face")
def p34(spark, d):
    return photos(spark, d).select(F.inline(V.rescaled(F.col("faces"), F.lit(2.5))))


@query("p34_rescaled_landmarks", sql_views("v_face") + " SELECT face_id, pos::INTEGER AS pos, floor((x+w*pos/4.0)*2.5::DOUBLE)::BIGINT AS px, floor((y+h*pos/8.0)*2.5::DOUBLE)::BIGINT AS py FROM v_face, range(3) r(pos)")
def p34_landmarks(spark, d):
    point = lambda f, i: F.struct((f["x"] + f["w"] * i / F.lit(4.0)).alias("x"), (f["y"] + f["h"] * i / F.lit(8.0)).alias("y"))
    faces = F.transform("faces", lambda f: f.withField("landmarks", F.array(*(point(f, i) for i in range(3)))))
    t = photos(spark, d).select(F.inline(V.rescaled(faces, F.lit(2.5), landmarks=True)))
    return t.select("face_id", F.posexplode("landmarks").alias("pos", "p")).select("face_id", "pos", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("p39_match_band", "SELECT o_orderkey, CASE WHEN o_custkey%60<=28 THEN 'Matched' WHEN o_custkey%60>42 THEN 'Rejected' ELSE 'Ambiguous' END AS band FROM orders")
def p39(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.match_band(M.num(F.col("o_custkey") % 60) / 100.0).alias("band"))


@query("p40_pupil_distance", "SELECT o_orderkey, abs(o_orderkey%70-60)::DOUBLE<=0.05::DOUBLE*60 AS ok FROM orders")
def p40(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.pupil_distance_ok(M.num(F.col("o_orderkey") % 70), F.lit(60.0)).alias("ok"))


@query("p41_failure_triage", """SELECT doc_id, CASE WHEN doc_id%17=0 THEN 'Unsupported extension' WHEN doc_id%13=0 THEN 'Missing file' WHEN doc_id%11=0 THEN 'Placeholder not hydrated' WHEN doc_id%7=0 THEN 'Permission denied'
 WHEN coalesce(length(text),0)=0 OR doc_id%5=0 THEN 'Empty file' WHEN doc_id%3=0 THEN 'Decode failure' WHEN doc_id%29=0 THEN 'Other' END AS failure FROM documents""")
def p41(spark, d):
    k = F.col("doc_id")
    status = table(spark, d, "documents").select(
        "doc_id", F.when(k % 17 == 0, "txt").otherwise("jpg").alias("ext"), (k % 13 != 0).alias("found"), F.when(k % 11 == 0, 22).when(k % 7 == 0, 13).alias("errno"),
        F.when(k % 5 == 0, 0).otherwise(F.coalesce(F.length("text"), F.lit(0))).alias("size"), (k % 3 != 0).alias("decodes"), (k % 29 == 0).alias("failed"),
    )
    return status.select("doc_id", failure_class().alias("failure"))


def failure_class():
    """First reason that holds: kind, presence, placeholder (22), permission (13), size, decoder, other."""
    return (
        F.when(~F.col("ext").isin(*M.ALLOWED, *M.RAW), "Unsupported extension").when(~F.col("found"), "Missing file").when(F.col("errno") == 22, "Placeholder not hydrated")
        .when(F.col("errno") == 13, "Permission denied").when(F.col("size") == 0, "Empty file").when(~F.col("decodes"), "Decode failure").when(F.col("failed"), "Other")
    )


@query("p42_scan_estimate", "SELECT o_custkey, CASE WHEN c=0 THEN '0 sec' WHEN c<67 THEN '<1 sec' WHEN s<60 THEN concat('~',s,' sec') WHEN s%60=0 THEN concat('~',s//60,' min') ELSE concat('~',s//60,'m ',s%60,'s') END AS estimate FROM (SELECT o_custkey, c, floor(c*0.015::DOUBLE)::BIGINT AS s FROM (SELECT o_custkey, count(*)*(o_custkey%500) AS c FROM orders GROUP BY o_custkey))")
def p42(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") * F.first(F.col("o_custkey") % 500)).alias("n"))
    return t.select("o_custkey", M.scan_estimate(F.col("n")).alias("estimate"))


@query("p43_default_settings", """SELECT event_id, concat('theme=', coalesce(CASE WHEN event_id%3=0 THEN 'light' END,'dark'), ';threads=', coalesce(CASE WHEN event_id%2=0 THEN '8' END,'4'), ';version=', '2') AS settings FROM events""")
def p43(spark, d):
    own = F.map_concat(F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("theme"), F.lit("light"))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("threads"), F.lit("8"))).otherwise(F.create_map().cast("map<string,string>")))
    filled = with_defaults(own, {"theme": "dark", "threads": "4", "version": "2"})
    text = F.array_join(F.transform(F.array_sort(F.map_entries(filled)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, d, "events").select("event_id", F.array_join(F.array(text), "").alias("settings"))


def with_defaults(own, defaults: dict[str, str]):
    """A string map with missing keys filled in; keys that it has win."""
    given = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return F.map_concat(F.map_filter(given, lambda k, v: ~F.map_contains_key(own, k)), own)


@query("a16_face_reductions", SCORED_SQL + "SELECT photo_id, n_faces::INTEGER AS n_faces, avg_sharpness, max_area, y_spread, width_ratio, has_blink, majority_facing FROM p1")
def a16(spark, d):
    return V.with_face_rows(photo_rows(spark, d), face_rows(spark, d)).select("photo_id", "n_faces", "avg_sharpness", "max_area", "y_spread", "width_ratio", "has_blink", "majority_facing")
