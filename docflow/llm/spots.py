"""Document fingerprints from spots of common words (native expressions only).

Every occurrence of a common word (an *anchor*) starts a chain of the next ``CHAIN`` content words, that is
words that are no anchors; anchor and chain make a signature. The beginning of a text is an anchor too, so each
text with a content word has a signature. A fingerprint is the set of a text's signatures, as sorted 64-bit
hashes, and the likeness of two is their Jaccard similarity.

Two sets with a similarity of t differ in size by a factor of at most 1 / t. ``near_matches`` therefore deals sets by
the logarithm of their size, meets only neighbouring sizes that share one of the first signatures, and compares
what can still reach t.

Defined cases: a null text counts as empty; texts without content words have an empty fingerprint; two empty
fingerprints are alike (1), an empty one and another are not (0); words are runs of letters, marks and digits in
lower case; null and repeated ids are carried through; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHAIN = 2
SALTS = 1024            # rows with equal ids and texts are dealt to so many places in the order
BREAK = r"[^\p{L}\p{M}\p{N}]+"
# Common words of English, German, French and Spanish.
ANCHORS = sorted(set((
    "a an and are as at be but by for from had has have he her his i if in is it not of on or she that the their they this to was we were which "
    "will with you "
    "als am auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht sich sie sind so und "
    "von war wie wird zu zum zur "
    "au aux avec ce cette dans de du elle en est et il je la le les leur mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur "
    "un une vous "
    "al como con del el ella esta este la las lo los más no o para pero por si sin su sus también una y ya").split()))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column, chain: int = CHAIN, anchors: list[str] = ANCHORS) -> Column:
    """Sorted distinct signatures of a text."""
    is_anchor = lambda word: word.isin(anchors)

    def spots(words: Column) -> Column:
        # The k-th anchor at position i has i - k content words before it.
        at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: is_anchor(s["w"]))
        start = F.array(F.struct(F.lit("").alias("w"), F.lit(0).alias("i")))
        return F.concat(start, F.transform(at, lambda s, k: F.struct(s["w"].alias("w"), (s["i"] - k).alias("i"))))

    def chains(words: Column) -> Column:
        return _bound(F.filter(words, lambda w: ~is_anchor(w)), lambda content: F.transform(
            F.filter(spots(words), lambda s: s["i"] < F.size(content)),
            lambda s: F.xxhash64(s["w"], *[F.get(content, s["i"] + j) for j in range(chain)])))

    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BREAK), lambda w: w != "")
    return F.array_sort(F.array_distinct(_bound(words, chains)))


def fingerprint(found: Column) -> Column:
    """Signatures as one text: their hexadecimal digits, joined by spaces."""
    return F.array_join(F.transform(found, lambda s: F.hex(s)), " ")


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    sizes = F.size(one) + F.size(two)
    shared = F.size(F.array_intersect(one, two))
    return F.when(sizes == 0, 1.0).otherwise(shared / (sizes - shared))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, next_text, part, last, h, salt): each row and the text that follows it by descending id; after the
    last comes the first. Null ids come last. Rows of one id are ordered by a hash of their text.

    Rows are dealt to ranges of the order. The last row of each range is cut out once and laid, as a row that is
    left out of the result, behind its predecessors' range, so no range needs another's rows. A window over
    (``part``; ``last``, key) can go on from the result without another exchange; see ``by_order``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    key = F.struct("doc_id", "h", "salt")
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ends of the ranges in ascending order; their number is that of the ranges, whatever the table holds.
    ends = (rows.select("doc_id", "h", "salt").repartitionByRange(ranges, "doc_id", "h", "salt")
            .groupBy(F.spark_partition_id()).agg(F.max(key).alias("end")).select("end", F.to_json("end").alias("j")))
    kind = ends.schema["end"].dataType.simpleString()
    found = ends.orderBy("end").collect()
    if not found:
        return rows.select("doc_id", "text", F.lit("").alias("next_text"), F.lit(0).alias("part"), F.lit(False).alias("last"), "h", "salt")
    n = len(found)
    borders = F.from_json(F.lit("[" + ",".join(r["j"] for r in found) + "]"), f"array<{kind}>")
    halves = F.array(*[F.lit(1 << k) for k in range(n.bit_length(), -1, -1)])
    less = F.aggregate(halves, F.lit(0), lambda low, step: F.when(
        (low + step <= n) & (F.get(borders, F.least(low + step, F.lit(n)) - 1) < key), low + step).otherwise(low))
    dealt = rows.select("*", F.least(less, F.lit(n - 1)).alias("part"), F.lit(False).alias("last"))

    # The greatest row of a range follows the least one of the next range; that of the last follows the very least.
    asked = spark.createDataFrame([((k + 1) % n, r["j"]) for k, r in enumerate(found)], "part int, j string")
    asked = asked.select("part", F.from_json("j", kind).alias("e")).select("part", "e.*").toDF("part", "e_id", "e_h", "e_salt")
    heads = (rows.join(asked, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("h") == F.col("e_h"))).groupBy("part", "doc_id", "h")
             .agg(F.first("text").alias("text"), F.min("salt").alias("salt")).withColumn("last", F.lit(True)))
    both = dealt.unionByName(heads.select(dealt.columns))
    return both.withColumn("next_text", F.lead("text").over(by_order())).select("doc_id", "text", "next_text", "part", "last", "h", "salt")


def by_order() -> WindowSpec:
    """A window over the ranges of ``with_next`` in their order."""
    return Window.partitionBy("part").orderBy("last", F.desc("doc_id"), F.desc("h"), F.desc("salt"))


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited, signatures, edited_signatures, next_signatures) of each row. ``edited`` is the text
    with the last third of its characters replaced by the first characters, as many, of the next row's."""
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    signed = with_next(docs, text, doc_id).withColumn("signatures", signatures(F.col("text")))
    both = signed.withColumn("next_signatures", F.lead("signatures").over(by_order())).where("NOT last")
    full = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "signatures", "next_signatures")
    return full.withColumn("edited_signatures", signatures(F.col("edited")))


def near_matches(queries: DataFrame, docs: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, likeness) of all rows of ``docs`` that reach ``least`` with a row of ``queries``.

    Equal fingerprints are compared once. Rows without signatures match nothing.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least is {least}, not above 0 and up to 1")

    def sets(rows: DataFrame, name: str) -> DataFrame:
        return (rows.select(F.col(doc_id).alias(name), signatures(F.col(text)).alias("s")).where(F.size("s") > 0)
                .groupBy("s").agg(F.collect_list(name).alias(f"{name}s")))

    level = lambda size: F.floor(F.log(size + F.lit(0.0)) / F.log(F.lit(max(1 / least, 1.1) + 1e-9))).cast("int")
    first = lambda s: F.slice(s, 1, (F.size(s) - F.ceil(F.size(s) * (least - 1e-9)) + 1).cast("int"))
    one = sets(queries, "query_id").select("query_ids", F.col("s").alias("q"), F.explode(F.expr("array(-1, 0, 1)")).alias("d"), first(F.col("s")).alias("keys"))
    one = one.select("query_ids", "q", (level(F.size("q")) + F.col("d")).alias("level"), F.explode("keys").alias("key"))
    two = sets(docs, "doc_id").select("doc_ids", "s", level(F.size("s")).alias("level"), F.explode(first(F.col("s"))).alias("key"))
    near = (F.size("s") >= F.size("q") * (least - 1e-9)) & (F.size("q") >= F.size("s") * (least - 1e-9))
    # A pair may share several keys: it counts at the least of them.
    least_key = F.get(F.array_sort(F.array_intersect(first(F.col("q")), first(F.col("s")))), F.lit(0))
    met = one.join(two, ["level", "key"]).where(near).where(F.col("key") == least_key)
    found = met.withColumn("likeness", likeness(F.col("q"), F.col("s"))).where(F.col("likeness") >= least)
    return (found.select(F.explode("query_ids").alias("query_id"), "doc_ids", "likeness")
            .select("query_id", F.explode("doc_ids").alias("doc_id"), "likeness"))
