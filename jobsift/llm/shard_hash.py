"""Sharding by jump consistent hashing, in native columns.

A key's shard follows from the key and the number of shards alone; no ring or
table is kept.  A generator seeded with the key yields the places at which the
key jumps to a higher shard; its shard is the last jump below the count.  When
shards are appended, a key moves only if a further jump lands in the new range,
so just the necessary fraction of rows moves, and only into new shards.

Slots number a shard's rows from 0.  Rows are counted per distinct (shard, key,
content) first; running sums of the counts, over bins of a shard cut along the
slots' order, give each its first slot.  Neither a shard nor the rows of one key
are ever in one task whole, and copies are numbered in runs of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.operators.running import running_sums

SHARDS = 40
OVERHEAD = 16
#: copies of a row that are numbered by one array
RUN = 10_000
#: Multiplier of the published generator, as high and low 32 bits.
HIGH, LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
WORD = 0xFFFFFFFF


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2**64, in 32-bit halves: longs would
    overflow, and the halves are multiplied 16 bits at a time."""
    low = lambda x, c: (x * (c & 0xFFFF), x * (c >> 16))
    half = lambda x, c: (  # the product's low 32 bits
        low(x, c)[0] + F.shiftleft(low(x, c)[1].bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))
    a, b = low(lo, LOW)
    bottom = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    top = F.shiftright(bottom, 32) + F.shiftright(b, 16) + half(hi, LOW) + half(lo, HIGH)
    return top.bitwiseAND(F.lit(WORD)), bottom.bitwiseAND(F.lit(WORD))


def jump(key: Column, shards: int, grown: int) -> Column:
    """Struct (shard, grown): the key's shard among ``shards`` and among
    ``grown`` >= shards.  ``key``: a long; null counts as 0."""
    if not 1 <= shards <= grown:
        raise ValueError("needs at least one shard, and no fewer when grown")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(WORD)).alias("lo"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"))

    def step(s, _):
        hi, lo = _next(s["hi"], s["lo"])
        to = F.floor((s["at"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1)))
        on = s["at"] < grown
        at = F.when(on, to).otherwise(s["at"])
        return F.struct(
            F.when(on, hi).otherwise(s["hi"]).alias("hi"), F.when(on, lo).otherwise(s["lo"]).alias("lo"),
            at.alias("at"), F.when(at < shards, at).otherwise(s["shard"]).alias("shard"),
            F.when(at < grown, at).otherwise(s["grown"]).alias("grown"))

    # every jump goes up, so there are at most as many as shards
    end = F.aggregate(F.sequence(F.lit(1), F.lit(grown)), start, step)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def jump_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Id, ``size`` (UTF-8 bytes of the text, null: none, plus 16),
    ``text_crc32``, ``law`` (key), ``shard``, ``slot`` and ``grown_shard`` (the
    shard if one more were appended) of every row.

    The id, a whole number, is the key; a null id is sharded as 0.  A shard's
    slots are gapless from 0, in order of the id's MD5 digest, then id, size and
    checksum; rows that agree in all of these take neighbouring slots.  They are
    counted before they are shuffled, so one key may hold any share of the rows.
    Null and empty texts have size 16 and checksum 0; an empty table gives an
    empty result; other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32")).groupBy(
        "__id", "size", "text_crc32").agg(F.count("*").alias("__n"))
    keyed = rows.select("*", jump(F.col("__id"), shards, shards + 1).alias("__j"),
                        F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")).cast("binary")).alias("__d"))
    keyed = keyed.select("__id", "size", "text_crc32", "__n", "__d", F.col("__j.shard").alias("shard"),
                         F.col("__j.grown").alias("grown_shard"))
    numbered = running_sums(keyed, ["shard"], ["__d", "__id", "size", "text_crc32"], {"__upto": F.col("__n")})
    runs = numbered.select("*", F.explode(F.sequence(F.col("__upto") - F.col("__n"), F.col("__upto") - 1, F.lit(RUN).cast(
        "long"))).alias("__from"))
    return runs.select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(
            F.col("__from"), F.least(F.col("__from") + RUN, F.col("__upto")) - 1)).alias("slot"), "grown_shard")


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(coalesce(doc_id, 0) AS HUGEINT) AS k FROM documents),
j(k, state, place, shard, grown) AS (
  SELECT DISTINCT k, CASE WHEN k < 0 THEN k + 18446744073709551616::HUGEINT ELSE k END,
         0::BIGINT, 0::BIGINT, 0::BIGINT FROM d
  UNION ALL
  SELECT k, state, jumped, CASE WHEN jumped < 40 THEN jumped ELSE shard END,
         CASE WHEN jumped < 41 THEN jumped ELSE grown END
  FROM (SELECT k, s AS state, shard, grown,
               CAST(floor((place + 1) * (2147483648.0::DOUBLE / ((s // 8589934592::HUGEINT) + 1)::DOUBLE)) AS BIGINT) AS jumped
        FROM (SELECT k, place, shard, grown,
                     (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s
              FROM j WHERE place < 41))),
e AS (SELECT k, max(shard) AS shard, max(grown) AS grown FROM j GROUP BY k),
b(b8) AS (SELECT range FROM range(256)),
c8(b8, i, c) AS (
  SELECT b8, 0, b8 FROM b
  UNION ALL
  SELECT b8, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM c8 WHERE i < 8),
tab AS (SELECT list(c ORDER BY b8) AS t FROM c8 WHERE i = 8),
crc AS (
  SELECT doc_id, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(t))),
         lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
         lambda a, x: xor(a // 256, tt[xor(a % 256, x) + 1])), 4294967295::BIGINT) AS crc
  FROM (SELECT doc_id, t, hex(encode(t)) AS h, (SELECT t FROM tab) AS tt FROM d))
SELECT d.doc_id, CAST(octet_length(encode(d.t)) + 16 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law,
       CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id,
                          octet_length(encode(d.t)), crc) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN e ON e.k = d.k JOIN crc ON crc.doc_id = d.doc_id
"""
