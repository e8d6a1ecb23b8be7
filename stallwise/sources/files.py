"""File sources and sinks: JSON fixtures, image bytes, versioned snapshots and a synthetic corpus."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that a channel fixture may use for one field, fixed values.
CHANNEL_ALIASES = {"id": ("id",), "telegram_id": ("telegramId", "telegram_id"), "username": ("username",), "title": ("title",), "active": ("active",), "last_message_id": ("lastMessageId", "last_message_id")}
CHANNEL_TYPES = {"id": "long", "telegram_id": "long", "username": "string", "title": "string", "active": "boolean", "last_message_id": "long"}


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """Channels of a JSON file: a list, or an object with a list ``channels``; camel or snake case, ``_`` keys ignored."""
    names = [n for all_ in CHANNEL_ALIASES.values() for n in all_]
    row = T.StructType([T.StructField(n, T.StringType()) for n in names])
    schema = T.StructType([*row.fields, T.StructField("channels", T.ArrayType(row))])
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    flat = read.where("channels is null").select(*names).unionByName(read.where("channels is not null").select(F.explode("channels").alias("c")).select(*[F.col(f"c.{n}") for n in names]))
    return flat.select(*[F.coalesce(*[F.col(n) for n in all_]).cast(CHANNEL_TYPES[k]).alias(k) for k, all_ in CHANNEL_ALIASES.items()])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image bytes below a folder, one row a file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def snapshot(df: DataFrame, path: str, version: int) -> str:
    """Write a version of a table beside the others; readers keep theirs until they ask for the newest."""
    target = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def restore(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, by default the newest."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = version if version is not None else rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")


#: Category, title words, median price and spread of the corpus generator, fixed values.
CATALOGUE = (
    ("phones", "iPhone 13", 60_000, 0.4), ("phones", "Samsung A54", 30_000, 0.3), ("computers", "Dell Latitude laptop", 45_000, 0.4), ("furniture", "L-shape sofa", 28_000, 0.5), ("furniture", "dining table", 18_000, 0.5),
    ("tv-audio", "Samsung 55 inch TV", 38_000, 0.3), ("vehicles", "Toyota Vitz", 1_200_000, 0.3), ("appliances", "washing machine", 25_000, 0.4), ("fashion", "leather bag", 2_500, 0.6), ("kids", "baby stroller", 8_000, 0.4), ("books", "novel set", 900, 0.4),
)


def corpus(spark: SparkSession, count: int, seed: int = 20260819) -> DataFrame:
    """Synthetic posts: text, price, category and age in hours; log-normal prices in the steps that sellers use."""
    rows = spark.range(count).withColumn("k", (F.abs(F.xxhash64(F.lit(seed), "id")) % len(CATALOGUE)).cast("int"))
    goods = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("title"), F.lit(math.log(m)).alias("mu"), F.lit(s).alias("sigma")) for c, t, m, s in CATALOGUE])
    rows = rows.withColumn("g", F.get(goods, F.col("k")))
    unit = lambda salt: (F.abs(F.xxhash64(F.lit(seed), F.lit(salt), "id")) % 1_000_003 + 1) / F.lit(1_000_004.0)
    normal = F.sqrt(-2 * F.log(unit("u"))) * F.cos(2 * math.pi * unit("v"))
    raw = F.exp(F.col("g.mu") + F.col("g.sigma") * normal)
    step = F.when(raw < 1_000, 50).when(raw < 10_000, 100).when(raw < 100_000, 500).otherwise(10_000)
    price = (F.round(raw / step) * step).cast("int")
    phone = F.concat(F.lit("09"), F.lpad((F.abs(F.xxhash64("id")) % 100_000_000).cast("string"), 8, "0"))
    line = F.element_at(F.array(F.lit("ዋጋ {p} ብር"), F.lit("price {p} birr"), F.lit("{p} ETB")), (F.col("id") % 3 + 1).cast("int"))
    body = F.concat_ws("\n", F.col("g.title"), F.replace(line, F.lit("{p}"), F.format_number(price, 0)), F.concat(F.lit("ስልክ "), phone))
    return rows.select("id", body.alias("text"), price.alias("price_etb"), F.col("g.category").alias("category_slug"), (1 + F.abs(F.xxhash64(F.lit("age"), "id")) % (45 * 24)).alias("age_hours"))
