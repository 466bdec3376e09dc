"""Document fingerprints: a canonical exact digest, by DataFrame functions alone.

A text is decomposed, its case is folded in full (ß is ss, a final sigma a sigma) and its compatible forms are made one, as the
Unicode rules for a match without case have it; it is composed again (NFKC), and its runs of white space become one blank. Two chained 64-bit xxhashes of that
form make a wide digest. Texts with equal digests form a bucket; inside each bucket the canonical texts themselves are
compared byte by byte, as their grouped minimum and maximum (which combine before the shuffle, so a huge group of copies costs
one row per task). A bucket whose texts differ is contested: there a text's fingerprint carries the SHA-256 of its canonical
form as well. So fingerprints are equal just when canonical texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Shared digests are broadcast up to this number (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_DIGESTS = 500_000


def canonical(text: Column) -> Column:
    """The form in which texts that differ in Unicode form, case and white space alone are equal. ICU comes with Spark."""
    form = lambda how, t, compatible: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(how), t, F.lit(compatible))
    folded = lambda t: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), t, F.lit(True))
    # folding may undo a form and forms may bring back case, so both are done twice
    alike = folded(form("decompose", folded(form("decompose", F.coalesce(text, F.lit("")), False)), True))
    return F.trim(F.regexp_replace(form("compose", alike, True), r"(?U)\s+", " "))


def digest(canon: Column, bits: int = 128) -> Column:
    """128 bits; fewer only so that tests can make digests collide."""
    one, two = F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)
    if bits < 128:
        one, two = F.pmod(one, F.lit(1 << bits)), F.lit(0).cast("long")
    return F.concat(F.lower(F.lpad(F.hex(one), 16, "0")), F.lower(F.lpad(F.hex(two), 16, "0")))


def _seal(frame: DataFrame, text: str, name: str, bits: int) -> DataFrame:
    """Adds ``name``: digest and proof of the canonical form of column ``text``."""
    frame = frame.withColumn("__canon", canonical(F.col(text)))
    return frame.withColumn(name, F.struct(digest(F.col("__canon"), bits).alias("d"), F.sha2("__canon", 256).alias("p"))).drop("__canon")


def contested(docs: DataFrame, sealed: DataFrame, bits: int = 128) -> DataFrame:
    """Digests (column ``d``) that texts of different bytes share: ``docs.text`` by comparing bytes, and whatever else is in
    ``sealed`` (columns d, p) by its proof."""
    buckets = written(sealed.groupBy("d").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("n > 1"))
    shared = buckets.select("d")
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    texts = docs.select(canonical(F.col("text")).alias("c")).withColumn("d", digest(F.col("c"), bits)).join(shared, "d", "left_semi")
    bytes_differ = texts.groupBy("d").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("d")
    return written(bytes_differ.union(buckets.where("lo <> hi").select("d")).distinct())


def _resolve(frame: DataFrame, name: str, disputes: DataFrame | None) -> DataFrame:
    """Column ``name`` (digest and proof) to the fingerprint."""
    if disputes is None:
        return frame.withColumn(name, F.col(f"{name}.d"))
    marked = frame.withColumn("__d", F.col(f"{name}.d")).join(disputes.select(F.col("d").alias("__d"), F.lit(True).alias("__x")), "__d", "left")
    full = F.when(F.col("__x"), F.concat_ws("-", f"{name}.d", f"{name}.p")).otherwise(F.col(f"{name}.d"))
    return marked.withColumn(name, full).drop("__d", "__x")


def fingerprint_documents(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id and fingerprint of every row: equal just when the canonical texts are equal.

    Null texts count as empty; repeated rows and null doc_ids are kept; other columns are ignored; no rows in, none out.
    """
    rows = written(_seal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "fingerprint", bits).drop("text"))
    disputes = contested(docs, rows.select("fingerprint.*"), bits)
    return _resolve(rows, "fingerprint", None if disputes.isEmpty() else disputes)


def exact_groups(prints: DataFrame) -> DataFrame:
    """fingerprint, size, doc_id (the smallest) of each group of equal canonical texts."""
    return prints.groupBy("fingerprint").agg(F.count("*").alias("size"), F.min("doc_id").alias("doc_id"))


def _range(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by halving."""
    if not bounds:
        return F.lit(0)
    top = 1 << len(bounds).bit_length()
    steps = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())])
    table = F.array(*[F.lit(b) for b in bounds])
    at = lambda n: F.try_element_at(table, n)  # noqa: E731  past the end: null, so not at most
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(at(n + s) <= key, n + s).otherwise(n))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with ``next``: a struct of ``columns`` of the row that follows by (doc_id, text); after the last, the first.

    Ids are cut into ranges at quantiles, each range is sorted on its own, and the first rows of a range are also sent to
    the range before it. Only the bounds, as many as there are ranges, pass the driver.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    probe = docs.select(key.alias("k")).agg(F.min("k").alias("k"), F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()
    first, bounds = probe["k"], sorted({*(probe["q"] or [])} - {probe["k"]})
    place = _range(F.col("__k"), bounds)
    starts = [first, *bounds]
    rows = docs.withColumn("__k", key).withColumn("__r", place)
    is_first = F.col("__k") == F.element_at(F.array(*[F.lit(s if s is not None else lowest) for s in starts]), F.col("__r") + 1)
    before = F.pmod(F.col("__r") - 1, F.lit(len(starts)))
    copies = F.when(is_first, F.array(F.struct(F.col("__r").alias("r"), F.lit(0).alias("halo")), F.struct(before.alias("r"), F.lit(1).alias("halo"))))
    rows = rows.withColumn("__c", F.explode(F.coalesce(copies, F.array(F.struct(F.col("__r").alias("r"), F.lit(0).alias("halo"))))))
    order = Window.partitionBy("__c.r").orderBy("__c.halo", "__k", "text")
    rows = rows.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return rows.where(F.col("__c.halo") == 0).drop("__k", "__r", "__c")


def fingerprint_edits(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints of texts, of their edits and of the texts that follow.

    The edit of a text: its last floor(n/2) code points give way to the first as many (or all) of the next document's.
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The digest is exact, so
    likeness is 1 for equal canonical texts and 0 for others. Null texts are empty; a lone row follows itself; rows that
    repeat a doc_id follow one another by text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(_seal(rows, "text", "own", bits), ["text", "own"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half)))
    rows = _seal(rows, "edited", "changed", bits)
    light = written(rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own").alias("fingerprint"), F.col("changed").alias("edited_fingerprint"), F.col("next.own").alias("following")))
    disputes = contested(docs, light.select("fingerprint.*").union(light.select("edited_fingerprint.*")), bits)
    found = None if disputes.isEmpty() else disputes
    for name in ("fingerprint", "edited_fingerprint", "following"):
        light = _resolve(light, name, found)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return light.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("following").alias("near_next"))
