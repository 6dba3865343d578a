"""Raw artifacts by the hash of their bytes, in one table by source and first digits instead of a file each.

``uri`` is source/hh/hash.ext. Content that is there already is not written
again, so putting is idempotent. A uri is only ever looked up as a key, within
the folders that it names, so none can reach outside the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: slug/hh/hash.ext, hh being how the hash begins.
URI = r"^([A-Za-z0-9._-]+)/([0-9a-f]{2})/(\2[0-9a-f]{62})(\.[A-Za-z0-9]+)?$"
#: Digits of the hash by which a source's folder is cut: 16 parts each, so that folders hold files of a good size; 2 for stores of many terabytes.
DIGITS = 1
SCHEMA = "uri string, content binary, slug string, head string"
#: A character of UTF-8 that the bytes' end cuts off, in hexadecimal.
_CUT = "^((?:..)*?)(?:(?:C[2-9A-F]|D.|E.|F[0-4])|(?:E[1-9A-F]|F[1-3])[89AB].|E0[AB].|F0[9AB].|F48.|(?:F[1-3][89AB].|F0[9AB].|F48.)[89AB].)$"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below a folder of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def addressed(contents: DataFrame) -> DataFrame:
    """``contents`` (slug, content, ext) with their hash and ``uri``."""
    hashed = contents.withColumn("hash", F.sha2("content", 256))
    return hashed.withColumn("uri", F.concat("slug", F.lit("/"), F.left("hash", F.lit(2)), F.lit("/"), "hash", F.coalesce("ext", F.lit(".bin"))))


def stored(spark: SparkSession, root: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(root)


def put(contents: DataFrame, root: str) -> None:
    """Add what is not there; of equal contents in one call one is written."""
    rows = addressed(contents.filter("content is not null")).withColumn("head", F.left("hash", F.lit(DIGITS)))
    known = stored(contents.sparkSession, root).select("uri", "slug", "head")
    fresh = rows.select("uri", "content", "slug", "head").dropDuplicates(["uri"]).join(known, ["uri", "slug", "head"], "left_anti")
    fresh.repartition("slug", "head").write.mode("append").partitionBy("slug", "head").parquet(root)


def get(uris: DataFrame, root: str) -> DataFrame:
    """(uri, content) of ``uris`` (uri), null where the store has none. Slug and first digits come from the uri, so other folders aren't read."""
    part = lambda n: F.regexp_extract("uri", URI, n)
    keys = uris.select("uri").distinct().withColumns({"slug": part(1), "head": F.left(part(2), F.lit(DIGITS))})
    return keys.join(stored(uris.sparkSession, root), ["uri", "slug", "head"], "left").select("uri", "content")


def read_bounded(uris: DataFrame, root: str, cap: int) -> DataFrame:
    """(uri, text, chars, partial): the text of the first ``cap`` bytes, the characters of the whole less its trailing line ends, and whether there is more."""
    some = get(uris, root).filter("content is not null")
    begin = F.hex(F.substring("content", 1, cap))
    whole = F.unhex(F.when(begin.rlike(_CUT), F.regexp_extract(begin, _CUT, 1)).otherwise(begin))
    every = F.make_valid_utf8(F.col("content").cast("string"))
    return some.select("uri", F.make_valid_utf8(whole.cast("string")).alias("text"), F.length(F.rtrim(every, F.lit("\n"))).cast("long").alias("chars"), (F.length("content") > cap).alias("partial"))
