"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visarium import views as v
from visarium.functions import boxes, geometry, images, names, vectors
from visarium.functions.geometry import CropConfig
from visarium.operators import candidates, density, files, frames as fr, links, reconcile as rc, render, track
from visarium.plans import pipelines as pl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Thresholds that mean something on these tables: their vectors are near to random, 64 numbers of unit norm.
COS, EUCLID = 0.3, 1.1832159566199232


def query(sql: str | None = None):
    """Registers a query under its function's name, with the oracle's SQL; {name} in it is a shared view."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            text = sql
            for name, part in v.SQL.items():
                text = text.replace("{" + name + "}", part)
            ORACLES[fn.__name__] = text
        return fn

    return put


def _sides(*extra):
    return [*extra, *(F.col(f"bbox.{s}").alias(s) for s in boxes.SIDES)]


# Frames, detections, files


@query("WITH {frames} SELECT video_id, frame_idx, ts_sec, frame_name FROM frames WHERE frame_idx % 10 = 0")
def frame_sample(spark, d):
    return fr.sample_frames(v.frames(spark, d), 10).select("video_id", "frame_idx", "ts_sec", "frame_name")


@query("""WITH {frames} SELECT event_id, regexp_replace(frame_name, '\\.[^.]*$', '') || printf('_face_%05d.jpg', event_id) AS face_name,
    regexp_replace(frame_name, '\\.[^.]*$', '') || printf('_face%05d', event_id) || '.jpg' AS original_name, printf('%02d:%02d', frame_idx // 60, frame_idx % 60) AS clock FROM frames""")
def frame_names(spark, d):
    f, n, e = v.frames(spark, d), F.col("frame_name"), F.col("event_id")
    return f.select("event_id", names.face_name(n, e).alias("face_name"), names.original_name(n, e).alias("original_name"), names.clock(F.col("frame_idx")).alias("clock"))


@query("WITH {frames} SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_name, frame_idx) - 1 AS file_ord FROM frames")
def file_order(spark, d):
    return fr.file_order(v.frames(spark, d)).select("video_id", "frame_idx", "file_ord")


@query("""WITH {faces}, ok AS (SELECT *, printf('frame_%02d.jpg', frame_idx) AS frame_name FROM faces),
    pos AS (SELECT *, row_number() OVER (PARTITION BY frame_name ORDER BY face_id) - 1 AS pos FROM ok),
    kept AS (SELECT frame_name, pos, l, t, r, b, coalesce(CASE WHEN face_id % 3 <> 0 THEN (face_id % 100) / 100.0::DOUBLE END, CASE WHEN face_id % 5 <> 0 THEN (face_id % 50) / 50.0::DOUBLE END, 1.0::DOUBLE) AS confidence FROM pos WHERE r > l AND b > t)
    SELECT row_number() OVER (ORDER BY frame_name, pos) - 1 AS face_id, frame_name, confidence, l::INT AS "left", t::INT AS top, r::INT AS "right", b::INT AS bottom,
        regexp_replace(frame_name, '\\.[^.]*$', '') || printf('_face_%05d.jpg', row_number() OVER (ORDER BY frame_name, pos) - 1) AS file_name FROM kept""")
def detections_explode(spark, d):
    return fr.explode_detections(v.detections(spark, d)).select(*_sides("face_id", "frame_name", "confidence", "file_name"))


@query("""WITH {faces} SELECT face_id, 'trbl' AS kind, l::INT AS "left", t::INT AS top, r::INT AS "right", b::INT AS bottom FROM faces
    UNION ALL SELECT face_id, 'xywh', l::INT, t::INT, r::INT, b::INT FROM faces
    UNION ALL SELECT face_id, 'unit', trunc(l / 1600.0::DOUBLE * 1920)::INT, trunc(t / 800.0::DOUBLE * 1080)::INT, trunc(r / 1600.0::DOUBLE * 1920)::INT, trunc(b / 800.0::DOUBLE * 1080)::INT FROM faces""")
def bbox_normalise(spark, d):
    f = v.faces(spark, d)
    lt, tp, rt, bt = (F.col(f"bbox.{s}") for s in boxes.SIDES)
    forms = {
        "trbl": boxes.box_from("trbl", tp, rt, bt, lt),
        "xywh": boxes.box_from("xywh", lt, tp, rt - lt, bt - tp),
        "unit": boxes.box_from("unit", lt / F.lit(1600.0), tp / F.lit(800.0), rt / F.lit(1600.0), bt / F.lit(800.0), F.lit(1920), F.lit(1080)),
    }
    out = f.select("face_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), b.alias("bbox")) for k, b in forms.items()))).alias("x"))
    return out.select("face_id", "x.kind", "x.bbox").select(*_sides("face_id", "kind"))


@query("""WITH {faces} SELECT face_id, greatest(l, 0)::INT AS "left", greatest(t, 0)::INT AS top, least(r, 1500)::INT AS "right", least(b, 700)::INT AS bottom FROM faces
    WHERE r > l AND b > t AND least(r, 1500) > greatest(l, 0) AND least(b, 700) > greatest(t, 0)""")
def bbox_valid(spark, d):
    f = v.faces(spark, d).filter(boxes.valid(F.col("bbox"))).withColumn("bbox", boxes.clamped(F.col("bbox"), F.lit(1500), F.lit(700)))
    return f.filter(boxes.valid(F.col("bbox"))).select(*_sides("face_id"))


@query("""WITH {faces}, p AS (SELECT *, trunc((r - l) * 0.15::DOUBLE)::INT AS dx, trunc((b - t) * 0.15::DOUBLE)::INT AS dy FROM faces)
    SELECT face_id, greatest(0, l - dx)::INT AS "left", greatest(0, t - dy)::INT AS top, least(1600, r + dx)::INT AS "right", least(800, b + dy)::INT AS bottom FROM p""")
def bbox_pad(spark, d):
    return v.faces(spark, d).withColumn("bbox", boxes.padded(F.col("bbox"), F.lit(1600), F.lit(800))).select(*_sides("face_id"))


@query("WITH {faces}, c AS (SELECT face_id, CASE WHEN face_id % 3 <> 0 THEN (face_id % 100) / 100.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM faces) SELECT * FROM c WHERE confidence >= 0.8")
def conf_filter(spark, d):
    f = v.faces(spark, d).select("face_id", F.when(F.col("face_id") % 3 != 0, (F.col("face_id") % 100) / 100.0).otherwise(1.0).alias("confidence"))
    return fr.confident(f)


@query("WITH {faces} SELECT face_id FROM faces WHERE (r - l) * (b - t) / (300.0::DOUBLE * 300) >= 0.01")
def area_ratio_filter(spark, d):
    return fr.large_enough(v.faces(spark, d), F.lit(300), F.lit(300)).select("face_id")


@query("SELECT vec_id, (label * 2)::INT AS cls FROM embeddings WHERE label * 2 IN (0, 1, 2, 3, 16, 17, 18)")
def class_filter(spark, d):
    return fr.of_classes(v.table(spark, d, "embeddings").select("vec_id", (F.col("label") * 2).cast("int").alias("cls")), list(CropConfig().object_classes))


def _placed(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("frame_idx").orderBy("face_id")
    return v.faces(spark, d).filter(boxes.valid(F.col("bbox"))).withColumn("pos", F.row_number().over(order) - 1)


_PLACED = "{faces}, p AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY face_id) - 1 AS pos FROM faces WHERE r > l AND b > t)"


def _flat(df):
    return df.select(*(c for c in df.columns if c != "face_location"), *(F.col(f"face_location.{s}").alias(s) for s in boxes.SIDES))


@query(f'WITH {_PLACED}, q AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY (r - l) * (b - t) DESC, pos) AS n FROM p) SELECT frame_idx, l::INT AS "left", t::INT AS top, r::INT AS "right", b::INT AS bottom FROM q WHERE n = 1')
def largest_face(spark, d):
    return _flat(fr.largest_face(_placed(spark, d), "frame_idx"))


@query(f'WITH {_PLACED} SELECT frame_idx, l::INT AS "left", t::INT AS top, r::INT AS "right", b::INT AS bottom FROM p WHERE pos = 0')
def first_face(spark, d):
    return _flat(fr.first_face(_placed(spark, d), "frame_idx"))


@query(f"WITH {_PLACED} SELECT frame_idx, count(*) AS n, string_agg(l || ' ' || t || ' ' || r || ' ' || b, ';' ORDER BY pos) AS boxes FROM p GROUP BY frame_idx")
def all_faces(spark, d):
    found = fr.all_faces(_placed(spark, d), "frame_idx")
    return found.select("frame_idx", F.size("all_face").cast("bigint").alias("n"), F.array_join(F.transform("all_face", lambda b: F.concat_ws(" ", *(b[s].cast("string") for s in boxes.SIDES))), ";").alias("boxes"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def unprocessed_anti(spark, d):
    tasks = v.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, True).alias("already_processed_face"))
    return fr.unprocessed(tasks, v.table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id")), "event_id").select("event_id")


@query("SELECT vec_id, CASE WHEN label - 1 = -1 THEN 'unknown' ELSE printf('person_%03d', label - 1) END AS cluster FROM embeddings")
def cluster_names(spark, d):
    return v.table(spark, d, "embeddings").select("vec_id", names.cluster_name(F.col("label") - 1).alias("cluster"))


@query("SELECT 'given' AS method, count(DISTINCT CASE WHEN label <> 0 THEN label END) AS persons, count(*) FILTER (label = 0) AS unknown, round(avg(CASE WHEN label <> 0 THEN label / 16.0::DOUBLE END), 6) AS mean_probability FROM embeddings")
def label_summary(spark, d):
    lab = v.table(spark, d, "embeddings").select(F.lit("given").alias("method"), (F.col("label") - 1).alias("label"), (F.col("label") / 16.0).alias("probability"))
    return fr.label_summary(lab).withColumn("mean_probability", F.round("mean_probability", 6))


@query("""WITH {frames}, {faces}, m AS (SELECT video_id, frame_idx, string_agg(printf('person_%03d', label) || ':' || l, ';' ORDER BY face_id) AS marks FROM faces GROUP BY ALL)
    SELECT f.video_id, f.frame_idx, coalesce(marks, '') AS marks FROM frames f LEFT JOIN m USING (video_id, frame_idx)""")
def annotation_join(spark, d):
    marked = fr.annotate(v.frames(spark, d), v.faces(spark, d).withColumn("cluster", names.cluster_name(F.col("label"))))
    text = F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["label"], a["bbox"]["left"].cast("string"))), ";")
    return marked.select("video_id", "frame_idx", F.coalesce(text, F.lit("")).alias("marks"))


@query("""WITH {faces}, p AS (SELECT *, r >= 0 AND b >= 0 AND l >= 0 AND t >= 0 AS ok FROM faces)
    SELECT face_id, CASE WHEN ok THEN round(face_id / 100.0::DOUBLE, 2) ELSE -1 END AS seconds, CASE WHEN ok THEN face_id ELSE -1 END AS frame, CASE WHEN ok THEN l::INT ELSE -1 END AS l, CASE WHEN ok THEN b::INT ELSE -1 END AS b FROM p""")
def parse_annotation_name(spark, d):
    """Sides below zero make a name of another form: nothing is read from it (-1 here)."""
    name = F.format_string("scene_0055_%s_%d_face_%05d_(%d, %d, %d, %d).jpg", F.round(F.col("face_id") / 100.0, 2).cast("string"), "face_id", "face_id", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom")
    a = names.annotation(F.col("name"))
    return v.faces(spark, d).withColumn("name", name).select("face_id", *(F.coalesce(x, F.lit(-1)).alias(n) for x, n in ((a["seconds"], "seconds"), (a["frame"], "frame"), (a["bbox"]["left"], "l"), (a["bbox"]["bottom"], "b"))))


@query("""WITH {frames}, {faces}, m AS (SELECT round(frame_idx / 25.0::DOUBLE, 2) AS at, string_agg(printf('person_%03d', label) || ':' || l, ';' ORDER BY face_id) AS marks FROM faces GROUP BY ALL)
    SELECT f.video_id, f.frame_idx, coalesce(marks, '') AS marks FROM frames f LEFT JOIN m ON m.at = f.ts_sec""")
def annotation_at_time(spark, d):
    marks = v.faces(spark, d).select(names.timestamp(F.col("frame_idx")).alias("seconds"), F.col("face_id").alias("frame"), "bbox", names.cluster_name(F.col("label")).alias("label"))
    text = F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["label"], a["bbox"]["left"].cast("string"))), ";")
    drawn = fr.annotate_at(v.frames(spark, d), marks, text)
    return drawn.select("video_id", "frame_idx", F.coalesce("annotations", F.lit("")).alias("marks"))


@query("""WITH {faces}, f AS (SELECT face_id, printf('person_%03d', label) AS cluster, 'in/doc_' || (face_id % 700) || '.jpg' AS path FROM faces),
    p AS (SELECT cluster, face_id, path, 'doc_' || (face_id % 700) || printf('_face%05d.jpg', face_id) AS name FROM f WHERE face_id % 700 IN (SELECT doc_id FROM documents))
    SELECT cluster, face_id, path, 'original_frames/' || name AS target FROM p""")
def original_copies(spark, d):
    files = v.table(spark, d, "documents").select(F.format_string("in/doc_%d.jpg", "doc_id").alias("path"))
    faces = v.faces(spark, d).select("face_id", names.cluster_name(F.col("label")).alias("cluster"), F.format_string("in/doc_%d.jpg", F.col("face_id") % 700).alias("source_file_path"))
    return fr.original_copies(faces, files)


@query("SELECT event_id FROM events WHERE event_id % 1500 IN (SELECT doc_id FROM documents)")
def existing_files(spark, d):
    files = v.table(spark, d, "documents").select(F.format_string("doc_%d", "doc_id").alias("path"))
    return fr.existing(v.table(spark, d, "events").select("event_id", F.format_string("doc_%d", F.col("event_id") % 1500).alias("path")), files).select("event_id")


@query("""WITH {faces}, o AS (SELECT *, printf('frame_%02d.jpg', frame_idx) AS frame_name, row_number() OVER (PARTITION BY frame_idx ORDER BY face_id) - 1 AS pos FROM faces)
    SELECT frame_name, pos::INT AS pos, (label % 4)::INT AS cls, l::INT AS "left", r::INT AS "right" FROM o WHERE label % 4 IN (0, 2) AND (face_id % 100) / 100.0::DOUBLE >= 0.5""")
def objects_explode(spark, d):
    found = fr.objects_of(v.objects(spark, d), [0, 2], 0.5)
    return found.select("frame_name", "pos", "cls", F.col("bbox.left").alias("left"), F.col("bbox.right").alias("right"))


@query("""WITH {frames}, t AS (SELECT video_id, frame_idx, (event_id * 7 % 900)::INT AS "left" FROM frames WHERE event_id % 3 = 0) SELECT f.event_id, t."left" FROM frames f JOIN t USING (video_id, frame_idx)""")
def frame_crop(spark, d):
    track_ = v.frames(spark, d).filter("event_id % 3 = 0").select("video_id", "frame_idx", (F.col("event_id") * 7 % 900).cast("int").alias("left"))
    return render.with_crop(v.frames(spark, d), track_).select("event_id", "left")


@query("SELECT source, arg_min(printf('doc_%06d', doc_id), (-n_chars, printf('doc_%06d', doc_id))) AS path, max(n_chars) AS length FROM documents GROUP BY source")
def largest_file(spark, d):
    files = v.table(spark, d, "documents").select("source", F.format_string("doc_%06d", "doc_id").alias("path"), F.col("n_chars").alias("length"))
    return fr.largest_file(files, "source")


@query("SELECT page_id, rtrim(ltrim(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), '.'), '.') AS safe FROM pages")
def sanitize_name(spark, d):
    return v.table(spark, d, "pages").select("page_id", names.sanitised(F.col("url")).alias("safe"))


@query("""WITH f AS (SELECT doc_id, source, CASE WHEN doc_id % 9 = 8 THEN 'n' || doc_id || '.txt' ELSE CASE WHEN doc_id % 2 = 0 THEN 'n' ELSE 'N.b' END || doc_id || (['.jpg', '.JPG', '.Jpeg', '.webp'])[doc_id % 4 + 1] END AS name FROM documents)
    SELECT doc_id, printf('%s_%03d', source, row_number() OVER (PARTITION BY source ORDER BY name)) || lower(regexp_extract(name, '\\.[^.]+$')) AS new_name FROM f WHERE NOT ends_with(name, '.txt')""")
def rename_seq(spark, d):
    i = F.col("doc_id")
    image = F.concat(F.when(i % 2 == 0, "n").otherwise("N.b"), i.cast("string"), F.element_at(F.array(*map(F.lit, (".jpg", ".JPG", ".Jpeg", ".webp"))), (i % 4 + 1).cast("int")))
    names_ = v.table(spark, d, "documents").select("doc_id", "source", F.when(i % 9 == 8, F.concat(F.lit("n"), i.cast("string"), F.lit(".txt"))).otherwise(image).alias("name"))
    return files.rename_in_order(names_, "source", F.col("source")).select("doc_id", "new_name")


#: One after another, in SQL: the first file of each name has it, then each of the others looks for a number until one is free.
_FREE = """WITH RECURSIVE {rows}, p AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, suffix ORDER BY id) AS k FROM n),
    kept AS (SELECT id, folder, stem || suffix AS target FROM p WHERE k = 1),
    queue AS (SELECT id, folder, stem, suffix, row_number() OVER (PARTITION BY folder ORDER BY id) AS q FROM p WHERE k > 1),
    walk(folder, q, taken, id, target) AS (
        SELECT folder, 0::BIGINT, list(target), NULL::BIGINT, NULL::VARCHAR FROM kept GROUP BY folder
        UNION ALL
        SELECT w.folder, w.q + 1, list_append(w.taken, t), u.id, t
        FROM walk w JOIN queue u ON u.folder = w.folder AND u.q = w.q + 1,
            LATERAL (SELECT list_filter(list_transform(range({first}, {first} + 1 + len(w.taken)), lambda j: u.stem || '_' || printf('{format}', j) || u.suffix), lambda x: NOT list_contains(w.taken, x))[1] AS t)
    )
    SELECT id AS {id}, target AS {target} FROM kept UNION ALL SELECT id, target FROM walk WHERE id IS NOT NULL"""


def _free(rows, id, target, first, format):
    return _FREE.replace("{rows}", rows).replace("{id}", id).replace("{target}", target).replace("{first}", str(first)).replace("{format}", format)


@query(_free("""n AS (SELECT doc_id AS id, source AS folder, 'f' || (n_chars % 5) || CASE WHEN doc_id % 3 = 0 THEN printf('_%03d', doc_id % 4) WHEN doc_id % 11 = 0 THEN '_2' ELSE '' END AS stem,
    CASE WHEN doc_id % 13 = 0 THEN '.JPG' ELSE '.jpg' END AS suffix FROM documents)""", "doc_id", "target", 1, "%03d"))
def collision_suffix(spark, d):
    i = F.col("doc_id")
    number = F.when(i % 3 == 0, F.format_string("_%03d", i % 4)).when(i % 11 == 0, "_2").otherwise("")
    name = F.concat(F.lit("f"), (F.col("n_chars") % 5).cast("string"), number, F.when(i % 13 == 0, ".JPG").otherwise(".jpg"))
    return files.unique_names(v.table(spark, d, "documents").select("doc_id", "source", name.alias("name")), "source", "doc_id").select("doc_id", "target")


@query(_free("""n AS (SELECT doc_id AS id, source AS folder, CASE WHEN doc_id % 4 = 0 THEN source || '_' || (doc_id % 6) WHEN doc_id % 7 = 0 THEN source || '_03' ELSE source END AS stem, '' AS suffix FROM documents)""", "doc_id", "new_folder", 0, "%d"))
def folder_suffix(spark, d):
    i, s = F.col("doc_id"), F.col("source")
    wanted = F.when(i % 4 == 0, F.concat(s, F.lit("_"), (i % 6).cast("string"))).when(i % 7 == 0, F.concat(s, F.lit("_03"))).otherwise(s)
    return files.unique_folders(v.table(spark, d, "documents").select("doc_id", wanted.alias("wanted")), "wanted", "doc_id").select("doc_id", "new_folder")


@query(_free("""m AS (SELECT doc_id, doc_id % 3 = 0 AS came, source, row_number() OVER (PARTITION BY source, doc_id % 3 = 0 ORDER BY doc_id) AS k FROM documents),
    n AS (SELECT row_number() OVER (ORDER BY came, source, 'f' || k || CASE WHEN k % 5 = 0 THEN '_001' ELSE '' END || '.jpg') * 1000000000 + doc_id AS id, CASE WHEN came THEN 'src' || (length(source) - 3) ELSE source END AS folder,
        'f' || k || CASE WHEN k % 5 = 0 THEN '_001' ELSE '' END AS stem, '.jpg' AS suffix FROM m)""", "id", "target", 1, "%03d").replace("SELECT id AS id, target AS target FROM kept", "SELECT id % 1000000000 AS doc_id, target FROM kept").replace("SELECT id, target FROM walk", "SELECT id % 1000000000, target FROM walk"))
def merge_folder_names(spark, d):
    """Every third file of a folder lies in a folder beside it, which merges into src1 or src2."""
    beside = F.col("doc_id") % 3 == 0
    k = F.row_number().over(Window.partitionBy("source", beside).orderBy("doc_id"))
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 5 == 0, "_001").otherwise(""), F.lit(".jpg"))
    own = v.table(spark, d, "documents").select("doc_id", "source", F.when(beside, F.concat("source", F.lit("/part"))).otherwise(F.col("source")).alias("cluster"), name.alias("name"))
    merges = own.filter(F.col("cluster").endswith("/part")).select("cluster", F.concat(F.lit("src"), F.length("source") - 3).alias("into")).distinct()
    return files.merge_folders(own.drop("source"), merges).select("doc_id", "target")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(event_id / 100.0::DOUBLE, 2) WHEN event_id % 3 = 1 THEN event_id::DOUBLE END AS seconds FROM events""")
def name_seconds(spark, d):
    e = F.col("event_id")
    name = F.when(e % 3 == 0, F.concat(F.lit("at_"), F.round(e / 100.0, 2).cast("string"), F.lit("s_x.jpg"))).when(e % 3 == 1, F.concat(F.lit("frame_"), e.cast("string"), F.lit("_x.jpg"))).otherwise("other.jpg")
    return v.table(spark, d, "events").select("event_id", names.seconds_of(name).alias("seconds"))


# Vectors


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS s FROM embeddings)
    SELECT vec_id, unnest(range(len(e))) AS pos, round(unnest(list_transform(e, lambda x: x / s)), 6) AS x FROM n""")
def l2_normalise(spark, d):
    n = v.table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalise(vectors.doubles(F.col("embedding")))).alias("pos", "x"))
    return n.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


_PAIRS = "FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query(f"SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value {_PAIRS} WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COS}")
def cosine_pairs(spark, d):
    return links.vector_links(v.table(spark, d, "embeddings"), COS).withColumn("value", F.round("value", 6))


@query(f"SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value {_PAIRS} WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COS}")
def dot_pairs(spark, d):
    return links.vector_links(v.table(spark, d, "embeddings"), COS, "dot").withColumn("value", F.round("value", 6))


@query(f"SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value {_PAIRS} WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EUCLID}")
def euclid_pairs(spark, d):
    return links.vector_links(v.table(spark, d, "embeddings"), EUCLID, "euclid").withColumn("value", F.round("value", 6))


@query("SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def centroid(spark, d):
    return vectors.centroid(v.table(spark, d, "embeddings"), "embedding", ["label"]).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


_CENTRE = """parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    mean AS (SELECT pos, avg(x) AS m FROM parts GROUP BY pos),
    quality AS (SELECT vec_id, 1 / (1 + sqrt(sum((x - m) * (x - m)))) AS q FROM parts JOIN mean USING (pos) GROUP BY vec_id)"""


@query(f"WITH {_CENTRE} SELECT vec_id, round(q, 6) AS quality FROM quality")
def centrality(spark, d):
    return vectors.centrality(v.table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("quality", F.round("quality", 6))


_SCALED = """parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM parts GROUP BY pos),
    scaled AS (SELECT vec_id, list((x - m) / s ORDER BY pos) AS z FROM parts JOIN st USING (pos) GROUP BY vec_id)"""


@query(f"WITH {_SCALED} SELECT vec_id, unnest(range(len(z))) AS pos, round(unnest(z), 6) AS x FROM scaled")
def standardise(spark, d):
    s = vectors.standardise(v.table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.posexplode("scaled").alias("pos", "x"))
    return s.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {_SCALED} SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.z, b.z), 4) AS value FROM scaled a JOIN scaled b ON a.vec_id < b.vec_id WHERE list_distance(a.z, b.z) <= 9.5")
def pca_distances(spark, d):
    from visarium.tables import stored

    p = stored(vectors.pca(v.table(spark, d, "embeddings"), "vec_id", "embedding"), "pca")
    return links.vector_links(p, 9.5, "euclid", vec_col="reduced").withColumn("value", F.round("value", 4))


def _leader_sql(low: str) -> str:
    return f"WITH RECURSIVE {low}, {{leaders}} SELECT o.i AS vec_id, (dense_rank() OVER (ORDER BY leader) - 1)::INT AS label FROM r JOIN ord o USING (k)"


_LOW = "low AS (SELECT b.vec_id AS i, b.vec_id AS o, list(a.rk) FILTER (WHERE a.vec_id IS NOT NULL) AS nb FROM embeddings b LEFT JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) AS rk FROM embeddings) a ON a.vec_id < b.vec_id AND {} GROUP BY ALL)"


@query(_leader_sql(_LOW.format(f"list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COS}")))
def leader_cosine(spark, d):
    return pl.cosine_leaders(v.table(spark, d, "embeddings"), COS)


@query(_leader_sql(_LOW.format(f"list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COS}")))
def leader_rounds(spark, d):
    """The same by parallel rounds alone: no task decides what is left."""
    return pl.cosine_leaders(v.table(spark, d, "embeddings"), COS, small=0)


@query(_leader_sql(_LOW.format(f"list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COS}")))
def leader_dot(spark, d):
    return pl.cosine_leaders(v.table(spark, d, "embeddings"), COS, metric="dot")


@query(_leader_sql(_LOW.format(f"list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EUCLID}")))
def leader_euclid(spark, d):
    return pl.euclid_leaders(v.table(spark, d, "embeddings"), EUCLID)


@query(f"""WITH RECURSIVE {_CENTRE},
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 1.05 * (1 + (1 - q) * 0.3) AS tol, row_number() OVER (ORDER BY q DESC, vec_id) AS o FROM embeddings JOIN quality USING (vec_id)),
    low AS (SELECT b.vec_id AS i, b.o AS o, list(a.o) FILTER (WHERE a.vec_id IS NOT NULL) AS nb FROM v b LEFT JOIN v a ON a.o < b.o AND list_distance(a.e, b.e) <= a.tol GROUP BY ALL),
    {{leaders}} SELECT o.i AS vec_id, (dense_rank() OVER (ORDER BY leader) - 1)::INT AS label FROM r JOIN ord o USING (k)""")
def leader_adaptive(spark, d):
    return pl.adaptive_leaders(v.table(spark, d, "embeddings"), 1.05)


# Quality and reconciliation


@query("""WITH {tiles}, m AS (SELECT vec_id, tile, list_transform(range(0, 64), lambda k:
        tile[(CASE WHEN k % 8 = 0 THEN k + 1 ELSE k - 1 END) + 1] + tile[(CASE WHEN k % 8 = 7 THEN k - 1 ELSE k + 1 END) + 1]
        + tile[(CASE WHEN k < 8 THEN k + 8 ELSE k - 8 END) + 1] + tile[(CASE WHEN k >= 56 THEN k - 8 ELSE k + 8 END) + 1] - 4 * tile[k + 1]) AS lap FROM tiles),
    s AS (SELECT vec_id, list_sum(tile) / 64.0::DOUBLE AS mean,
        (list_sum(list_transform(tile, lambda x: x::BIGINT * x)) * 64 - list_sum(tile) * list_sum(tile))::DOUBLE / 4096 AS var,
        (list_sum(list_transform(lap, lambda x: x::BIGINT * x)) * 64 - list_sum(lap) * list_sum(lap))::DOUBLE / 4096 AS lvar FROM m)
    SELECT vec_id, round(0.3 * 0.0064 + 0.3 * least(1.0, lvar / 1000.0) + 0.2 * (sqrt(var) / 127.5) + 0.1 * (1 - abs(mean - 127.5) / 127.5) + 0.1 * least(1.0, vec_id * 200 / 50000.0::DOUBLE), 6) AS quality FROM s""")
def quality_score(spark, d):
    return v.tiles(spark, d).select("vec_id", F.round(images.face_quality(F.col("tile"), 8, 8, F.col("vec_id") * 200), 6).alias("quality"))


_REPS = "{people}, reps AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY quality DESC, face_id) AS rank FROM people QUALIFY rank <= 3)"


@query(f"WITH {_REPS} SELECT cluster, face_id, rank::INT AS rank FROM reps")
def top_reps(spark, d):
    return rc.top_reps(v.people(spark, d), 3).select("cluster", "face_id", "rank")


@query("WITH {people}, b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY quality DESC, face_id) AS n FROM people WHERE quality > 0) SELECT cluster, face_id FROM b WHERE n = 1")
def best_representative(spark, d):
    return rc.best_face(v.people(spark, d))


_CONS = _REPS + """, pairs AS (
    SELECT a.cluster AS a, b.cluster AS b, avg(CASE WHEN list_cosine_similarity(a.embedding, b.embedding) >= 0.1 THEN 1.0 ELSE 0.0 END) AS consensus,
        avg(list_cosine_similarity(a.embedding, b.embedding)) AS mean_sim, max(list_cosine_similarity(a.embedding, b.embedding)) AS max_sim
    FROM reps a JOIN reps b ON a.cluster < b.cluster GROUP BY ALL)"""


@query(f"WITH {_CONS} SELECT a, b, round(consensus, 6) AS consensus, round(mean_sim, 6) AS mean_sim, round(max_sim, 6) AS max_sim FROM pairs WHERE consensus > 0")
def consensus_pairs(spark, d):
    p = rc.consensus_pairs(rc.top_reps(v.people(spark, d), 3), 0.1)
    return p.select("a", "b", *(F.round(c, 6).alias(c) for c in ("consensus", "mean_sim", "max_sim")))


def _merge_sql(views: str, edges: str, source: str) -> str:
    """Leaders among cluster names in name order, merges applied, clusters numbered anew."""
    return f"""WITH RECURSIVE {views}, e AS ({edges}), c AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS rk FROM (SELECT DISTINCT cluster FROM {source})),
        low AS (SELECT c.cluster AS i, c.cluster AS o, list(x.rk) FILTER (WHERE x.rk IS NOT NULL) AS nb FROM c LEFT JOIN e ON e.b = c.cluster LEFT JOIN c x ON x.cluster = e.a GROUP BY ALL),
        {{leaders}}, led AS (SELECT o.i AS src, l.i AS dst FROM r JOIN ord o USING (k) JOIN ord l ON l.k = r.leader)
        SELECT face_id, printf('person_%03d', dense_rank() OVER (ORDER BY dst) - 1) AS cluster FROM {source} JOIN led ON src = cluster"""


@query(_merge_sql(_CONS, "SELECT a, b FROM pairs WHERE consensus >= 0.34", "people"))
def consensus_merge(spark, d):
    f = v.people(spark, d)
    return rc.renumber(rc.apply_merges(f, rc.consensus_merges(f, 3, 0.1, 0.34))).select("face_id", "cluster")


@query(f"""WITH {_REPS}, known AS (SELECT * FROM reps WHERE cluster <= 'person_007'), unknown AS (SELECT * FROM people WHERE cluster > 'person_007'),
    s AS (SELECT u.face_id, k.cluster, max(list_cosine_similarity(u.embedding, k.embedding)) AS sim FROM unknown u CROSS JOIN known k GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY sim DESC, cluster) AS n FROM s)
    SELECT face_id, cluster, round(sim, 6) AS sim FROM b WHERE n = 1 AND sim >= 0.15""")
def unknown_assign(spark, d):
    f = v.people(spark, d)
    known, unknown = f.filter("cluster <= 'person_007'"), f.filter("cluster > 'person_007'")
    return rc.assign_unknown(unknown, rc.top_reps(known, 3), 0.15).withColumn("sim", F.round("sim", 6))


_ASSIGN = ORACLES["unknown_assign"]


@query(f"SELECT cluster, count(*) AS n FROM ({_ASSIGN}) GROUP BY cluster")
def dest_summary(spark, d):
    return rc.destination_summary(unknown_assign(spark, d))


@query(f"SELECT total, moved, round(100.0::DOUBLE * moved / total, 6) AS percent FROM (SELECT count(*) AS total FROM embeddings WHERE vec_id % 12 > 7), (SELECT count(*) AS moved FROM ({_ASSIGN}))")
def move_rate(spark, d):
    unknown = v.people(spark, d).filter("cluster > 'person_007'")
    return rc.move_rate(unknown, unknown_assign(spark, d)).withColumn("percent", F.round("percent", 6))


_JACCARD = """{timed}, sets AS (SELECT cluster, list(DISTINCT ts) AS s FROM timed GROUP BY cluster),
    jac AS (SELECT a.cluster AS a, b.cluster AS b, len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS jaccard FROM sets a JOIN sets b ON a.cluster < b.cluster)"""


@query(f"WITH {_JACCARD} SELECT a, b, round(jaccard, 6) AS jaccard FROM jac WHERE jaccard > 0.3")
def temporal_jaccard(spark, d):
    return rc.time_overlap(v.timed(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query(_merge_sql(_JACCARD + """, best AS (SELECT cluster, arg_min(embedding, (-quality, face_id)) AS e FROM timed GROUP BY cluster)""",
    "SELECT jac.a, jac.b FROM jac JOIN best x ON x.cluster = jac.a JOIN best y ON y.cluster = jac.b WHERE jaccard > 0.3 AND list_cosine_similarity(x.e, y.e) >= 0.09", "timed"))
def temporal_merge(spark, d):
    f = v.timed(spark, d)
    return rc.renumber(rc.apply_merges(f, rc.temporal_merges(f, 0.1))).select("face_id", "cluster")


@query("WITH {people} SELECT face_id, printf('person_%03d', dense_rank() OVER (ORDER BY cluster) - 1) AS cluster FROM people WHERE cluster <> 'person_003'")
def renumber(spark, d):
    return rc.renumber(v.people(spark, d).filter("cluster <> 'person_003'")).select("face_id", "cluster")


# Crop and track


@query("""WITH {tiles}, l AS (SELECT *, lag(tile) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM tiles)
    SELECT video_id, frame_idx, coalesce(list_sum(list_transform(list_zip(tile, p), lambda z: abs(z[1] - z[2]))) / 64.0 > 36, false) AS scene FROM l""")
def scene_change(spark, d):
    return track.scene_changes(v.tiles(spark, d), F.col("tile"), 36).select("video_id", "frame_idx", "scene")


_SIGNALS = """{frames}, sig AS (SELECT *, event_type = 'click' AS face, event_type = 'error' AND frame_idx > 0 AS scene, floor(value)::INT AS x FROM frames),
    isl AS (SELECT *, sum((face OR scene)::INT) OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM sig),
    run AS (SELECT *, CASE WHEN face THEN 0 ELSE sum((NOT face)::INT) OVER (PARTITION BY video_id, g ORDER BY frame_idx) END::BIGINT AS missing FROM isl),
    can AS (SELECT *, CASE WHEN face THEN x WHEN missing >= 5 AND event_type IN ('view', 'purchase') THEN x END AS cand FROM run)"""


@query(f"WITH {_SIGNALS} SELECT video_id, frame_idx, missing FROM run")
def missing_run(spark, d):
    return track.missing_runs(v.signals(spark, d)).select("video_id", "frame_idx", "missing")


@query(f"WITH {_SIGNALS} SELECT video_id, frame_idx, cand FROM can WHERE cand IS NOT NULL")
def crop_candidate(spark, d):
    return track.crop_candidates(track.missing_runs(v.signals(spark, d)), 5).filter("cand is not null").select("video_id", "frame_idx", "cand")


_SMALL = CropConfig(target_width=200, tolerance=5)


@query(f"""WITH RECURSIVE {_SIGNALS}, t AS (
        SELECT video_id, frame_idx, trunc(0.12::DOUBLE * x.c + 0.88::DOUBLE * 250)::INT AS center FROM can, LATERAL (SELECT coalesce(cand, 250) - 250 AS m) y,
            LATERAL (SELECT CASE WHEN m > 35 THEN 285 WHEN m < -35 THEN 215 WHEN abs(m) < 20 THEN 250 ELSE coalesce(cand, 250) END AS c) x WHERE frame_idx = 0
        UNION ALL
        SELECT n.video_id, n.frame_idx, trunc(0.12::DOUBLE * x.c + 0.88::DOUBLE * p.p)::INT FROM t JOIN can n ON n.video_id = t.video_id AND n.frame_idx = t.frame_idx + 1,
            LATERAL (SELECT CASE WHEN n.scene THEN 250 ELSE t.center END AS p) p, LATERAL (SELECT coalesce(n.cand, p.p) - p.p AS m) y,
            LATERAL (SELECT CASE WHEN m > 35 THEN p.p + 35 WHEN m < -35 THEN p.p - 35 WHEN abs(m) < 20 THEN p.p ELSE coalesce(n.cand, p.p) END AS c) x)
    SELECT video_id, frame_idx, center, least(greatest(0, center - 100), 300)::INT AS "left" FROM t""")
def crop_track(spark, d):
    cand = track.crop_candidates(track.missing_runs(v.signals(spark, d)), _SMALL.tolerance)
    return track.crop_track(cand, 500, _SMALL)


@query("""WITH RECURSIVE {frames}, c AS (SELECT video_id, frame_idx, CASE WHEN event_type IN ('view', 'click') THEN value END AS cx FROM frames), t AS (
        SELECT video_id, frame_idx, trunc(0.15::DOUBLE * coalesce(cx, 250) + 0.85::DOUBLE * coalesce(cx, 250))::INT AS center FROM c WHERE frame_idx = 0
        UNION ALL
        SELECT n.video_id, n.frame_idx, trunc(0.15::DOUBLE * x.c + 0.85::DOUBLE * t.center)::INT FROM t JOIN c n ON n.video_id = t.video_id AND n.frame_idx = t.frame_idx + 1,
            LATERAL (SELECT coalesce(n.cx, CASE WHEN t.center <> 0 THEN t.center ELSE 250 END)::DOUBLE AS v) v, LATERAL (SELECT v.v - t.center AS m) y,
            LATERAL (SELECT CASE WHEN m > 40 THEN t.center + 40 WHEN m < -40 THEN t.center - 40 WHEN abs(m) < 10 THEN t.center ELSE v.v END AS c) x)
    SELECT video_id, frame_idx, center FROM t""")
def person_track(spark, d):
    f = v.frames(spark, d).withColumn("center_x", F.when(F.col("event_type").isin("view", "click"), F.col("value")))
    return track.person_track(f, 500)


def _boxes_of(spark, d):
    row = F.struct("face_id", F.struct("bbox.left", "bbox.right", (F.col("label") % 4).alias("cls")).alias("b"))
    return v.faces(spark, d).filter(boxes.valid(F.col("bbox"))).withColumn("row", row).groupBy("frame_idx").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["b"]).alias("boxes"))


@query("""WITH {faces}, ok AS (SELECT *, (l + r) / 2.0::DOUBLE AS c, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY (r - l) * (r - l) DESC, face_id) AS n FROM faces WHERE r > l AND b > t)
    SELECT video_id, frame_idx, CASE WHEN count(*) = 1 THEN trunc(max(c)) WHEN max(c) - min(c) <= 300 THEN trunc((min(c) + max(c)) / 2)
        ELSE trunc(max(c) FILTER (n = 1) * 0.8::DOUBLE + max(c) FILTER (n = 2) * 0.2::DOUBLE) END::INT AS center FROM ok GROUP BY ALL""")
def face_center(spark, d):
    row = F.struct("face_id", "bbox")
    f = v.faces(spark, d).filter(boxes.valid(F.col("bbox"))).withColumn("row", row).groupBy("video_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["bbox"]).alias("faces"))
    return f.select("video_id", "frame_idx", geometry.face_center(F.col("faces"), 300).alias("center"))


@query("WITH {faces} SELECT frame_idx, trunc(avg((l + r) / 2.0::DOUBLE))::INT AS center FROM faces WHERE r > l AND b > t AND label % 4 = 0 GROUP BY frame_idx")
def person_center(spark, d):
    return _boxes_of(spark, d).select("frame_idx", geometry.class_center(F.col("boxes"), (0,)).alias("center")).filter("center is not null")


@query("WITH {faces} SELECT frame_idx, trunc(avg((l + r) / 2.0::DOUBLE))::INT AS center FROM faces WHERE r > l AND b > t AND label % 4 IN (0, 1, 2, 3, 16, 17, 18) GROUP BY frame_idx")
def object_center(spark, d):
    return _boxes_of(spark, d).select("frame_idx", geometry.class_center(F.col("boxes"), CropConfig().object_classes).alias("center")).filter("center is not null")


@query("""WITH s AS (SELECT event_id, 400 + event_id % 1500 AS w, 300 + event_id * 7 % 1700 AS h FROM events),
    k AS (SELECT *, 1080.0::DOUBLE / w AS kw, 1920.0::DOUBLE / h AS kh FROM s),
    f AS (SELECT *, floor(w * least(kw, kh))::INT AS fw, floor(h * least(kw, kh))::INT AS fh FROM k),
    x AS (SELECT *, trunc(fw * 1.2::DOUBLE)::INT AS sw, trunc(fh * 1.2::DOUBLE)::INT AS sh FROM f)
    SELECT event_id, CASE WHEN kw <= kh THEN 1080 WHEN fw >= 1080 OR sw >= 1080 THEN 1080 ELSE sw END::INT AS width,
        CASE WHEN kw > kh THEN 1920 WHEN fh >= 1920 OR sh >= 1920 THEN 1920 ELSE sh END::INT AS height,
        CASE WHEN kw <= kh THEN NOT (fh >= 1920 OR sh >= 1920) ELSE NOT (fw >= 1080 OR sw >= 1080) END AS blur FROM x""")
def resize_dims(spark, d):
    e = v.table(spark, d, "events").select("event_id", geometry.resize_dims(400 + F.col("event_id") % 1500, 300 + F.col("event_id") * 7 % 1700).alias("r"))
    return e.select("event_id", "r.width", "r.height", "r.blur")


@query("SELECT user_id, least(greatest(0, max(event_id) % 2000 - 540), 1920 - 1080)::INT AS \"left\" FROM events GROUP BY user_id")
def crop_left(spark, d):
    c = v.table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") % 2000).cast("int").alias("c"))
    return c.select("user_id", geometry.crop_left(F.col("c"), F.lit(1920), 1080).alias("left"))


_OVAL = "list_transform(range(0, 64), lambda k: CASE WHEN ((k % 8) - 4) * ((k % 8) - 4) * 4 + ((k // 8) - 4) * ((k // 8) - 4) * 9 <= 36 THEN 255 ELSE 0 END)"
_UNION = "list_transform(range(1, 65), lambda k: CASE WHEN tile[k] / 255.0::DOUBLE > 0.5 OR tile[65 - k] / 255.0::DOUBLE > 0.5 THEN 255 ELSE 0 END)"


def _join(tile):
    return F.array_join(F.transform(tile, lambda x: x.cast("string")), " ")


@query(f"SELECT vec_id, array_to_string({_OVAL}, ' ') AS mask FROM embeddings")
def oval_mask(spark, d):
    return v.table(spark, d, "embeddings").select("vec_id", _join(images.oval_mask(8, 8, 0.4, 0.3)).alias("mask"))


def _masks():
    return F.array(F.transform("tile", lambda x: x / 255.0), F.reverse(F.transform("tile", lambda x: x / 255.0)))


@query(f"WITH {{tiles}} SELECT vec_id, array_to_string({_UNION}, ' ') AS mask FROM tiles")
def union_mask(spark, d):
    return v.tiles(spark, d).select("vec_id", _join(images.union_mask(_masks(), 0.5)).alias("mask"))


@query(f"WITH {{tiles}} SELECT vec_id, array_to_string(CASE WHEN vec_id % 3 = 0 THEN {_OVAL} ELSE {_UNION} END, ' ') AS mask FROM tiles")
def mask_choice(spark, d):
    masks = F.when(F.col("vec_id") % 3 != 0, _masks())
    return v.tiles(spark, d).select("vec_id", _join(images.mask_choice(masks, 64, images.oval_mask(8, 8, 0.4, 0.3), oval_fallback=True, threshold=0.5)).alias("mask"))


@query(f"WITH {{tiles}}, m AS (SELECT vec_id, tile, {_UNION} AS mask FROM tiles) SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda k: CASE WHEN mask[k] = 255 THEN tile[k] ELSE 200 END), ' ') AS frame FROM m")
def composite(spark, d):
    t = v.tiles(spark, d)
    out = images.composite(F.col("tile"), images.union_mask(_masks(), 0.5), images.background(F.col("tile"), color=200))
    return t.select("vec_id", _join(out).alias("frame"))


@query("""WITH {tiles}, b AS (SELECT *, vec_id % 5 AS l, vec_id % 3 - 1 AS t, vec_id % 5 + 3 AS r, vec_id % 3 + 4 AS b FROM tiles)
    SELECT vec_id, array_to_string(list_transform(range(64), lambda k: CASE WHEN k % 8 BETWEEN l AND r AND k // 8 BETWEEN t AND b AND (k % 8 IN (l, r) OR k // 8 IN (t, b)) THEN 255 ELSE tile[k + 1] END), ' ') AS frame FROM b""")
def draw_boxes(spark, d):
    k = F.col("vec_id")
    return v.tiles(spark, d).select("vec_id", _join(images.rectangle(F.col("tile"), 8, 8, boxes.box(k % 5, k % 3 - 1, k % 5 + 3, k % 3 + 4))).alias("frame"))


def _cells(df, column):
    """Every pixel a row, so that numbers compare as numbers."""
    return df.select("vec_id", F.posexplode(column).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 4).alias("x"))


_BELL = "bell AS (SELECT list(w / (SELECT sum(exp(-(e * e) / 4.5::DOUBLE)) FROM range(-2, 3) AS s(e)) ORDER BY d) AS g FROM (SELECT d, exp(-(d * d) / 4.5::DOUBLE) AS w FROM range(-2, 3) AS r(d)))"
_MIRROR = "(CASE WHEN abs({0}) > 7 THEN 14 - abs({0}) ELSE abs({0}) END)"


@query(f"""WITH {{tiles}}, {_BELL}, mid AS (SELECT vec_id, g, list_transform(range(64), lambda k: list_sum(list_transform(range(5), lambda i: g[i + 1] * tile[{_MIRROR.format('(k // 8 + i - 2)')} * 8 + k % 8 + 1]))) AS m FROM tiles, bell),
    out AS (SELECT vec_id, list_transform(range(64), lambda k: list_sum(list_transform(range(5), lambda i: g[i + 1] * m[(k // 8) * 8 + {_MIRROR.format('(k % 8 + i - 2)')} + 1]))) AS o FROM mid)
    SELECT vec_id, unnest(range(64)) AS pos, round(unnest(o), 4) AS x FROM out""")
def blur(spark, d):
    return _cells(v.tiles(spark, d), images.blurred(F.col("tile"), 8, 8, 5, 1.5))


_RESIZED = """wide AS (SELECT vec_id, list_transform(range({h} * 5), lambda k: list_sum(list_transform(range({w}), lambda j:
        greatest(0, least((k % 5 + 1) * {w} / 5.0::DOUBLE, j + 1) - greatest(k % 5 * {w} / 5.0::DOUBLE, j)) / ({w} / 5.0::DOUBLE) * tile[(k // 5) * {w} + j + 1]))) AS m FROM {tiles}),
    place AS (SELECT list(least(greatest((y + 0.5::DOUBLE) * {h} / 12 - 0.5, 0), {h} - 1) ORDER BY y) AS a FROM range(12) AS r(y)),
    out AS (SELECT vec_id, list_transform(range(60), lambda k: (1 - (a[k // 5 + 1] - floor(a[k // 5 + 1]))) * m[floor(a[k // 5 + 1])::INT * 5 + k % 5 + 1]
        + (a[k // 5 + 1] - floor(a[k // 5 + 1])) * m[least(floor(a[k // 5 + 1])::INT + 1, {h} - 1) * 5 + k % 5 + 1]) AS o FROM wide, place)
    SELECT vec_id, unnest(range(60)) AS pos, round(unnest(o), 4) AS x FROM out"""


@query("WITH {tiles}, " + _RESIZED.replace("{h}", "8").replace("{w}", "8").replace("{tiles}", "tiles"))
def resize(spark, d):
    return _cells(v.tiles(spark, d), images.resized(F.col("tile"), 8, 8, 5, 12))


@query("WITH {tiles}, cut AS (SELECT vec_id, list_transform(range(48), lambda k: tile[(k // 6) * 8 + greatest(0, least(vec_id % 7 - 2, 2)) + k % 6 + 1]) AS tile FROM tiles), " + _RESIZED.replace("{h}", "8").replace("{w}", "6").replace("{tiles}", "cut"))
def vertical_render(spark, d):
    """Each tile cut at its crop's left edge and brought to the target's size."""
    cut = v.tiles(spark, d).withColumn("tile", images.columns(F.col("tile"), 8, 8, F.col("vec_id") % 7 - 2, 6))
    return _cells(cut, images.resized(F.col("tile"), 6, 8, 5, 12))


@query(f"WITH {{tiles}}, m AS (SELECT vec_id, tile, {_UNION} AS mask, (SELECT tile FROM tiles WHERE vec_id = 1) AS back FROM tiles) SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda k: CASE WHEN mask[k] = 255 THEN tile[k] ELSE back[k] END), ' ') AS frame FROM m")
def background_image(spark, d):
    t = v.tiles(spark, d)
    back = F.broadcast(t.filter("vec_id = 1").select(F.col("tile").alias("back")))  # one image
    out = images.composite(F.col("tile"), images.union_mask(_masks(), 0.5), images.background(F.col("tile"), image=F.col("back")))
    return t.join(back).select("vec_id", _join(out).alias("frame"))


# Density


_CORE = "core AS (SELECT a.vec_id, min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3)[-1] AS core FROM embeddings a CROSS JOIN embeddings b GROUP BY a.vec_id)"


@query(f"WITH {_CORE} SELECT vec_id, round(core, 6) AS core FROM core")
def core_distance(spark, d):
    return links.nearest_distances(v.table(spark, d, "embeddings"), 3).withColumn("core", F.round("core", 6))


@query(f"""WITH {_CORE}, near AS (SELECT src, dst, d FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d {_PAIRS}) WHERE d <= {EUCLID})
    SELECT src, dst, round(greatest(d, x.core, y.core), 6) AS value FROM near JOIN core x ON x.vec_id = src JOIN core y ON y.vec_id = dst""")
def mutual_reachability(spark, d):
    return links.reachable_links(v.table(spark, d, "embeddings"), EUCLID, 3).withColumn("value", F.round("value", 6))


@query(f"""SELECT count(*) AS links, true AS enough FROM (SELECT 1 {_PAIRS} AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COS})""")
def bucket_recall(spark, d):
    """Links that buckets must find: nine in ten of all at least, and no others."""
    found, every = candidates.recall_of(v.table(spark, d, "embeddings"), COS)
    return spark.range(1).select(F.lit(every).cast("long").alias("links"), F.lit(found >= 0.9 * every).alias("enough"))


@query()
def hdbscan(spark, d):
    """Against a plain version: tests/test_hierarchy.py, tests/test_density.py."""
    return density.cluster(v.table(spark, d, "embeddings"), "hdbscan")


@query()
def spectral(spark, d):
    return density.cluster(v.table(spark, d, "embeddings"), "spectral")


@query()
def agglomerative(spark, d):
    return density.cluster(v.table(spark, d, "embeddings"), "agglomerative")


@query()
def affinity_propagation(spark, d):
    return density.cluster(v.table(spark, d, "embeddings"), "affinity_propagation")


@query()
def chinese_whispers(spark, d):
    return density.cluster(v.table(spark, d, "embeddings"), "chinese_whispers", tolerance=EUCLID)


@query()
def cluster_methods(spark, d):
    out, failed = pl.cluster_methods(v.table(spark, d, "embeddings"))
    if failed:
        raise next(iter(failed.values()))
    return fr.label_summary(out)
