"""One-permutation MinHash of word shingles with optimal densification, in DataFrame functions only.

Each five-word shingle is hashed once; the hash's high bits name one of 128 bins, which keeps its smallest value. An empty
bin takes the value of the filled bin that a hash of both bins ranks lowest: the first filled one in a random order of the
bins, which is the probing of optimal densification. Eight low-order bits of each bin are stored; chance agreement of these
bits is taken out of the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Sorted hashes of all runs of ``shingle`` words; of all words if there are fewer; none for a text without words."""
    words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    hashes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(h) - (shingle - 1)), lambda i: F.xxhash64(*(F.get(h, i + (j - 1)) for j in range(shingle))))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= shingle, long).otherwise(short)

    return F.sort_array(F.element_at(F.transform(F.array(hashes), runs), 1))


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each filled bin, from sorted hashes: a bin is the upper bits, so its smallest comes first."""
    def firsts(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(h, i - 1), 64 - BIN_BITS)))

    return F.element_at(F.transform(F.array(hashes), firsts), 1)


def densified(minima: Column) -> Column:
    """Low-order bits of all bins; null where no bin is filled."""
    half = BINS // 2

    def dense(m: Column) -> Column:
        bins = F.transform(m, lambda x: (F.shiftright(x, 64 - BIN_BITS) + half).cast("int"))

        def with_bins(b: Column) -> Column:
            def value(j: Column) -> Column:
                at = F.array_position(b, j)
                ranks = F.transform(b, lambda k, i: F.xxhash64(j, k).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("bigint")))
                lent = F.array_min(ranks).bitwiseAND(F.lit(BINS - 1)).cast("int")  # at most BINS bins are filled, so a rank has room for the place
                return (F.get(m, F.when(at > 0, (at - 1).cast("int")).otherwise(lent)).bitwiseAND((1 << LOW_BITS) - 1)).cast("int")

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

        return F.element_at(F.transform(F.array(bins), with_bins), 1)

    return F.element_at(F.transform(F.array(minima), lambda m: F.when(F.size(m) > 0, dense(m))), 1)


def signature(text: Column) -> Column:
    """BINS small integers; null for a text without words, or null."""
    return densified(bin_minima(shingle_hashes(F.coalesce(text, F.lit("")))))


def packed(bins: Column) -> Column:
    """Two hex digits a bin; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(bins, lambda v: F.lower(F.lpad(F.hex(v), LOW_BITS // 4, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: equal bins less those equal by chance. Two texts without words are alike,
    one without is unlike any other."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    near = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(near)


def with_next(docs: DataFrame, size: int = 100) -> tuple[DataFrame, Window]:
    """(doc_id, text, bucket, guest) rows and the order in which each row's successor by ascending doc_id follows it.

    Ids are cut into equal ranges, of about ``size`` rows and at most 65,536 of them; a range's partition also gets a copy (guest) of the rows with the first id of the next
    range that has any, or after the last, of the first. Only the ranges' first ids are broadcast.
    Null ids come last; rows with the same id follow each other by a hash of their text. A single row follows itself.
    """
    low, high, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high, buckets = low or 0, high or 0, min(65_536, rows // size + 1)
    width = max(1, -(-(high - low + 1) // buckets))
    place = F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(buckets)).cast("int")
    rows = docs.withColumn("bucket", place)
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    around = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select("bucket", "first_id", around.alias("before"))
    guests = rows.join(F.broadcast(firsts.withColumnRenamed("bucket", "_b")), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    guests = guests.select("doc_id", "text", F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests), order


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) for every row: its text's
    fingerprint, that of the text whose second half gives way to the beginning of the next document, and their likeness."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, order = with_next(given)
    rows = rows.withColumn("following", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("following", F.lit(1), half))
    rows = rows.select("doc_id", "bucket", "guest", "n_chars", F.xxhash64("text").alias("_h"), "text", F.when(~F.col("guest"), edited).alias("edited_text"))
    rows = rows.withColumn("_own", signature(F.col("text"))).withColumn("_edited", F.when(~F.col("guest"), signature(F.col("edited_text"))))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "_h")
    rows = rows.drop("text").withColumn("_next", F.lead(F.struct("_own")).over(order)).filter(~F.col("guest"))
    return rows.select(
        "doc_id", "n_chars", "edited_text", packed(F.col("_own")).alias("fingerprint"), packed(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next._own")).alias("near_next"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )
