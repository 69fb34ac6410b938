"""Document fingerprints: one-permutation MinHash in native expressions.

Every shingle of five words is hashed once; its top bits choose one of BINS bins and each bin keeps
its smallest hash. Optimal densification: an empty bin draws bins by a hash of (empty bin, draw)
until it meets a non-empty one and copies its value. After DRAWS draws the last draw is among the
non-empty bins only (the one with the smallest hash of (empty bin, bin)), an even choice too. The low
BITS bits of each bin are packed into hex. Likeness is the share of equal bins, corrected for the
chance 2^-BITS that two different minima agree in their low bits.

Texts with fewer than five words: the whole word sequence is one shingle. Null text: empty. Texts
without words: an empty fingerprint, alike (1.0) to another empty one and to nothing else (0.0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civlens.llm.common import with_global_index, words, written

SHINGLE = 5
BINS, BIN_BITS = 128, 7
BITS = 8
DRAWS = 8
_TOP = 63 - BIN_BITS


def _let(value, body):
    """Bind a column to a name inside an expression, so that it is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text, n: int = SHINGLE):
    """63-bit hashes of the word n-grams of a text."""

    def grams(h):
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
        )
        one = F.array(F.xxhash64(h))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= n, many).when(F.size(h) > 0, one).otherwise(none)

    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.transform(_let(hashed, grams), lambda x: x.bitwiseAND(F.lit((1 << 63) - 1)))


def bin_minima(hashes):
    """The smallest hash of each non-empty bin, in bin order."""

    def firsts(s):
        return F.filter(
            s, lambda x, i: (i == 0) | (F.shiftright(x, _TOP) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), _TOP))
        )

    return _let(F.sort_array(hashes), firsts)


def densified(minima):
    """All BINS values in bin order; an empty array stays empty."""
    low = F.lit((1 << _TOP) - 1)

    def fill(m):
        def with_bins(bins):
            empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), bins)

            def copied(e):
                def draw(a):
                    at = F.array_position(bins, F.pmod(F.xxhash64(e, F.lit(a)), F.lit(BINS)).cast("int"))
                    return F.get(m, F.when(at > 0, at.cast("int") - 1))

                last = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(e, F.shiftright(x, _TOP)).alias("r"), x.alias("x"))))
                value = F.coalesce(*[draw(a) for a in range(DRAWS)], last.getField("x"))
                return F.shiftleft(e.cast("long"), _TOP).bitwiseOR(value.bitwiseAND(low))

            return F.sort_array(F.concat(m, F.transform(empty, copied)))

        full = _let(F.transform(m, lambda x: F.shiftright(x, _TOP).cast("int")), with_bins)
        return F.when(F.size(m) % BINS == 0, m).otherwise(full)

    return _let(minima, fill)


def low_bits(text):
    """The fingerprint as an array of the bins' low bits, less 128 to fit bytes."""
    full = densified(bin_minima(shingle_hashes(text)))
    # hashed with its bin, so that a value copied to many bins has other low bits in each
    low = F.lit((1 << BITS) - 1)
    return F.transform(full, lambda x: (F.xxhash64(x).bitwiseAND(low) - 128).cast("tinyint"))


def packed(bits):
    """Lowercase hex, two digits a bin."""
    digits = F.array(*[F.lit(f"{v:02x}") for v in range(1 << BITS)])
    return F.array_join(F.transform(bits, lambda x: F.get(digits, x.cast("int") + 128)), "")


def likeness(a, b):
    """Estimated Jaccard similarity of two fingerprints (arrays of low bits), 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its text's edited form and the fingerprints of it, of the edited text and
    of the next document in descending doc_id order (null last; after the last the first).

    Rows that share doc_id follow each other by a digest of (doc_id, text); equal rows take one place
    in the order and get equal results. Only ids and lengths are ordered globally; each text is
    shuffled once, by the digest, and its first part once more, to the document that it goes into.
    """
    text = F.coalesce("text", F.lit(""))
    tagged = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit(":"), text)
    # the two joins read the same columns, so that they share one exchange of the texts
    keyed = docs.select(text.alias("text"), F.unhex(F.md5(F.encode(tagged, "utf-8"))).alias("k"))
    every = docs.select("doc_id", F.unhex(F.md5(F.encode(tagged, "utf-8"))).alias("k"), F.length(text).alias("n"), low_bits(text).alias("bits"))
    own = written(every, "oph-own")
    marks = own.select("k", "bits").dropDuplicates(["k"])
    order = [F.col("doc_id").desc_nulls_last(), F.col("k")]
    single = own.select("k", "doc_id", "n").distinct()
    chain = written(with_global_index(single, order, "oph-order"), "oph-chain")
    total, rows = chain.count(), own.count()
    following = chain.select(F.pmod(F.col("idx") - 1, F.lit(max(total, 1))).alias("idx"), F.col("k").alias("from"))
    links = chain.join(following, "idx").select(
        "from", "doc_id", F.col("k").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("m")
    )
    sender = keyed.join(links, keyed["k"] == links["from"]).join(marks.withColumnRenamed("k", "from"), "from")
    sent = sender.select(
        "to", "doc_id", "m", F.col("bits").alias("next_bits"), F.substring("text", F.lit(1), F.col("m")).alias("head")
    )
    if rows > total:  # equal rows have sent the same head more than once
        sent = sent.dropDuplicates(["to"])
    both = keyed.join(sent, keyed["k"] == sent["to"]).join(marks, "k")
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.col("m")), F.col("head"))
    made = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "bits", "next_bits")
    return made.withColumn("edited_bits", low_bits(F.col("edited")))


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        packed(F.col("bits")).alias("fingerprint"),
        packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
