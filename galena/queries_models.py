"""Queries over model inputs: tensor files, manifests, patches of images; and their oracle SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import media
from galena.functions import tensors as images
from galena.operators import fuzzy, search
from galena.operators.ranking import numbered
from galena.queries import query
from galena.session import shared_folder, written
from galena.sources import listing, tensors
from galena.sources.library import view


@query(
    """WITH t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding FROM embeddings), n AS (SELECT count(*) AS n FROM t)
    SELECT e.event_id AS id, row AS token_id, round(list_sum(list_transform(embedding, lambda c: c::DOUBLE)), 5) AS total, embedding[3]::DOUBLE AS third FROM events e, n JOIN t ON row = (e.event_id * 7 + e.user_id) % n.n"""
)
def token_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as a flat table of single precision, read by byte ranges, and gathered by the events' token ids."""
    folder = f"{shared_folder(spark)}/tensor-{uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    tensors.write_tensor(e.select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector")), folder, 64)
    table = tensors.read_tensor(spark, folder, 64, split_bytes=64 * 4 * 100)
    n = table.count()
    tokens = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), ((F.col("event_id") * 7 + F.col("user_id")) % n).alias("token_id"))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tensors.gathered(tokens, table).select("id", "token_id", F.round(total, 5).alias("total"), F.get("vector", F.lit(2)).cast("double").alias("third"))


@query("SELECT vec_id AS id, abs(list_sum(list_transform(embedding, lambda c: c::DOUBLE))) < 1e9 AS near FROM embeddings")
def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings through a table of half precision: every entry within its rounding."""
    folder = f"{shared_folder(spark)}/tensor-{uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    tensors.write_tensor(e.select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector")), folder, 64, "f16")
    back = tensors.read_tensor(spark, folder, 64, "f16", split_bytes=64 * 2 * 77)
    near = F.forall(F.zip_with("embedding", "vector", lambda a, b: F.abs(a - b) <= F.abs(a) / 2048 + 1e-7), lambda x: x)
    return e.join(back, e["vec_id"] == back["row"]).select(F.col("vec_id").alias("id"), near.alias("near"))


MODELS = """SELECT p_partkey AS id, 'm' || CAST(p_partkey AS STRING) AS folder, p_size % 2 AS has_table, p_size % 3 AS has_positions, p_size % 5 AS onnx,
    CASE p_partkey % 10 WHEN 1 THEN '{"format":"omni_flat_v2"' ELSE '{"format":"omni_flat_v1"' END || ',"schema_version":1,"family":"' || CASE p_partkey % 4 WHEN 0 THEN 'chinese_clip' WHEN 3 THEN CASE p_partkey % 3 WHEN 0 THEN 'siglip' ELSE 'fg_clip' END ELSE 'fg_clip' END
    || '","model_id":"' || p_name || '","embedding_dim":' || CAST(CASE WHEN p_partkey % 10 = 2 THEN 0 ELSE p_size END AS STRING)
    || ',"text":{"onnx":"t.onnx","tokenizer":"v.txt","context_length":52,"input":{"kind":"' || CASE WHEN p_partkey % 4 = 0 THEN 'bert_like' ELSE 'token_embeds' END || '"}'
    || CASE WHEN p_partkey % 10 = 3 THEN '' ELSE ',"token_embedding":{"file":"e.bin","dtype":"' || CASE WHEN p_partkey % 10 = 5 THEN 'bf16' ELSE 'f16' END || '","embedding_dim":' || CAST(p_size + CASE WHEN p_partkey % 10 = 6 THEN 1 ELSE 0 END AS STRING) || '}' END
    || '},"image":{"onnx":"i.onnx","preprocess":{"kind":"' || CASE WHEN p_partkey % 4 = 0 THEN 'clip_image' ELSE 'fgclip_patch_tokens' END || '","patch_size":' || CAST(CASE WHEN p_partkey % 10 = 7 THEN 0 ELSE 16 END AS STRING) || ',"default_max_patches":256,"vision_pos_embedding":"p.bin"}}}' AS text FROM part"""


@query(
    f"""WITH m AS ({MODELS.replace("STRING", "VARCHAR").replace("SELECT p_partkey AS id,", "SELECT p_partkey AS id, p_size,")}),
    r AS (SELECT *, id % 4 IN (1, 2) OR id % 4 = 3 AND id % 3 <> 0 AS fg FROM m)
    SELECT id, CASE WHEN id % 10 = 1 THEN 'format' WHEN id % 10 = 2 OR p_size <= 0 THEN 'dimensions' WHEN id % 4 = 0 THEN NULL WHEN NOT fg THEN 'family' WHEN id % 10 = 3 THEN 'token embedding' WHEN id % 10 = 6 THEN 'embedding dimension' WHEN id % 10 = 5 THEN 'dtype' WHEN id % 10 = 7 THEN 'patches' END AS reason,
           nullif(array_to_string(list_sort(list_filter([CASE WHEN onnx = 0 THEN 't.onnx' END, CASE WHEN fg AND id % 10 = 3 THEN 'text.token_embedding.file' WHEN fg AND has_table = 0 THEN 'e.bin' END, CASE WHEN fg AND has_positions = 0 THEN 'p.bin' END], lambda x: x IS NOT NULL)), ','), '') AS missing
    FROM r"""
)
def model_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of model folders checked, and the files that they need and do not have."""
    root = f"{shared_folder(spark)}/models-{uuid4().hex}"
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few MB of parts are many files
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name").repartition(spread, "p_partkey")
    m = spark.sql(MODELS.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}"), part=part)
    names = F.array(F.lit("model_config.json"), F.lit("i.onnx"), F.lit("v.txt"), F.when(F.col("onnx") > 0, "t.onnx"), F.when(F.col("has_table") > 0, "e.bin"), F.when(F.col("has_positions") > 0, "p.bin"))
    shelf = F.concat(F.lit("s"), F.expr("pmod(id, 1000)"))  # no folder holds all models
    files = m.select(F.concat_ws("/", shelf, "folder").alias("folder"), "text", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("name"))
    is_manifest = F.col("name") == "model_config.json"
    listing.write_files(files.select(F.concat("folder", F.lit("/"), "name").alias("path"), F.when(is_manifest, F.col("text")).otherwise("").cast("binary").alias("content")), root)
    there = written(listing.tree(spark, root).filter("kind = 'file'").select("path"))
    found = listing.with_heads(there.filter(F.col("path").endswith("/model_config.json")), 1 << 20)
    own = written(found.select(F.regexp_replace("path", "/model_config.json$", "").alias("folder"), F.from_json(F.col("head").cast("string"), tensors.MANIFEST).alias("manifest")))
    number = F.regexp_extract("folder", r"/m(\d+)$", 1).cast("long").alias("id")
    lost = tensors.missing_files(own, there).groupBy(number).agg(F.array_join(F.sort_array(F.collect_list("file")), ",").alias("missing"))
    checked = own.select(number, tensors.manifest_check(F.col("manifest"))["reason"].alias("reason"))
    return checked.join(lost.hint("merge"), "id", "left").select("id", "reason", "missing")


@query(
    """
    WITH RECURSIVE f AS (SELECT id, width AS w, height AS h, CASE WHEN (width // 16) * (height // 16) <= 128 THEN 128 WHEN (width // 16) * (height // 16) <= 256 THEN 256 ELSE 576 END AS b FROM files),
    s AS (SELECT id, w, h, b, 0 AS k, 1e-5::DOUBLE / 10 AS low, 100::DOUBLE AS high FROM f
          UNION ALL SELECT id, w, h, b, k + 1, CASE WHEN fits THEN mid ELSE low END, CASE WHEN fits THEN high ELSE mid END FROM (
              SELECT *, (greatest(16, ceil(h * mid / 16) * 16) / 16) * (greatest(16, ceil(w * mid / 16) * 16) / 16) <= b AS fits FROM (SELECT *, (low + high) / 2 AS mid FROM s WHERE high - low >= 1e-5)))
    SELECT id, b AS max_patches, CAST(greatest(16, ceil(w * low / 16) * 16) AS BIGINT) AS width, CAST(greatest(16, ceil(h * low / 16) * 16) AS BIGINT) AS height FROM s WHERE high - low < 1e-5""",
    "files",
)
def patch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes at which files' images are cut into patches."""
    w, h = F.col("width"), F.col("height")
    f = view(spark, sf_dir, "files").select("id", "width", "height").withColumn("max_patches", images.patch_bucket(w, h, 16, 576))
    return f.withColumn("s", images.patch_size(w, h, F.col("max_patches"))).select("id", "max_patches", "s.width", "s.height")


def pixels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 8 wide and 8 high, grey by the embeddings."""
    grey = F.transform("embedding", lambda c: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(c.cast("double") * 400 + 128))).cast("int")), 2, "0"))
    rgb = F.unhex(F.array_join(F.transform(grey, lambda c: F.concat(c, c, c)), ""))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), rgb.alias("rgb"), "embedding")


@query(
    """WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda c: least(255, greatest(0, floor(c::DOUBLE * 400 + 128)))) AS g FROM embeddings)
    SELECT id, 128 AS max_patches, 11 AS grid_height, 11 AS grid_width, 121 AS valid, round(CAST(g[1] / 127.5 - 1 AS FLOAT), 5)::DOUBLE AS first, round(CAST(g[64] / 127.5 - 1 AS FLOAT), 5)::DOUBLE AS last FROM p"""
)
def image_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images in patches: the corner pixels stay as they are."""
    p = pixels_of(spark, sf_dir).withColumn("t", images.image_patches(F.lit(8), F.lit(8), F.col("rgb")))
    corner = lambda at: F.round(F.get("t.patches", at), 5).cast("double")
    return p.select("id", "t.max_patches", "t.grid_height", "t.grid_width", F.aggregate("t.mask", F.lit(0), lambda s, x: s + x).alias("valid"), corner(F.lit(0)).alias("first"), corner(F.lit(121 * 768 - 1)).alias("last"))


@query("SELECT vec_id AS id, 32 AS width, 32 AS height, TRUE AS near FROM embeddings")
def hash_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images through a ThumbHash and back: their size by the format, their mean within its rounding."""
    p = pixels_of(spark, sf_dir)
    rgba = F.unhex(F.regexp_replace(F.hex("rgb"), "(.{6})", "$1FF"))
    back = p.select("id", "rgb", media.thumb_hash_image(media.thumb_hash_text(F.lit(8), F.lit(8), rgba)).alias("t"))
    mean = lambda data, step: F.aggregate(F.sequence(F.lit(1), F.length(data), F.lit(step)), F.lit(0.0), lambda s, k: s + F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("double")) / (F.length(data) / step)
    near = F.abs(mean(F.col("rgb"), 3) - mean(F.col("t.rgba"), 4)) < 255 / 126 + 3
    return back.select("id", "t.width", "t.height", near.alias("near"))


@query(
    """WITH n AS (SELECT id, translate(CAST(id AS VARCHAR), '0123456789', 'lyesswlqbj') AS sounds FROM files),
    h AS (SELECT id, instr(sounds, 'ss') - 1 AS start FROM n WHERE contains(sounds, 'ss'))
    SELECT id, row_number() OVER (ORDER BY start, id) AS place FROM h""",
    "files",
)
def pinyin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of Chinese figures found by the initials of their sounds, the earliest match first."""
    own = F.concat(F.translate(F.col("id").cast("string"), "0123456789", "零一二三四五六七八九"), F.lit(".jpg"))
    found = fuzzy.fuzzy_files(view(spark, sf_dir, "files").select("id", own.alias("name")), "ss", fuzzy.initial_sounds())
    return numbered(found.select("id", "tier", "pinyin", "spread", "key"), fuzzy.fuzzy_order(), "place").select("id", "place")


@query(
    """WITH r AS (SELECT id, row_number() OVER (ORDER BY size DESC, $TAIL) AS rank, count(*) OVER () AS n FROM files WHERE $ACTIVE),
    v AS (SELECT event_id AS view, 1 + event_id * 13 % 900 AS first, event_id * 13 % 900 + user_id % 50 AS last, event_type <> 'view' AS forward FROM events WHERE event_type IN ('view', 'purchase')),
    w AS (SELECT *, CASE WHEN last >= first THEN first ELSE 1 END AS low, CASE WHEN last >= first THEN last ELSE 0 END AS high FROM v),
    x AS (SELECT *, greatest(12, least(36, greatest(0, least(high, (SELECT max(n) FROM r)) - low + 1))) AS ahead FROM w),
    m AS (SELECT view, id, CASE WHEN rank BETWEEN low AND high THEN 0 ELSE 1 END AS part, rank FROM x JOIN r ON rank BETWEEN low AND high OR forward AND rank BETWEEN high + 1 AND high + ahead OR NOT forward AND rank BETWEEN low - ahead AND low - 1)
    SELECT view, id, row_number() OVER (PARTITION BY view ORDER BY part, rank) AS place FROM m""",
    "files",
)
def prewarmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that viewports show and those ahead of them; the viewports are events."""
    ranked = numbered(view(spark, sf_dir, "files").filter("deleted_at IS NULL AND missing_at IS NULL").select("id", "size", "imported_at"), [F.col("size").desc(), F.col("imported_at").desc(), F.col("id").asc()])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type").isin("view", "purchase"))
    start = F.col("event_id") * 13 % 900
    views = e.select(F.col("event_id").alias("view"), (start + 1).alias("first"), (start + F.col("user_id") % 50).alias("last"), (F.col("event_type") != "view").alias("forward"))
    return search.prewarm(ranked, views)
