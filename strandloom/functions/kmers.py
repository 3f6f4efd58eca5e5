"""Column functions over DNA strings and k-mers; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
#: k-mer places in a piece of a sequence.
PIECE = 256


def clean(seq: Column) -> Column:
    return F.upper(seq)


def is_dna(seq: Column) -> Column:
    return F.regexp_like(seq, F.lit(r"^[ACGTacgt]+\z"))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def encode(kmer: Column) -> Column:
    """Two bits a base, A=0 to T=3: order-preserving at a fixed k of at most 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def packed_revcomp(code: Column, k: int) -> Column:
    """Reverse complement of an encoded k-mer: pairs of bits are swapped by halves, complemented, and moved to the low end."""
    x = F.bitwise_not(code)
    for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, step).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), step))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def forward_base(kmer: Column, base: Column) -> Column:
    return F.concat(F.substring(kmer, F.lit(2), F.char_length(kmer)), base)


def backward_base(kmer: Column, base: Column) -> Column:
    return F.concat(base, F.substring(kmer, F.lit(1), F.char_length(kmer) - 1))


def neighbours(kmer: Column) -> Column:
    """The eight possible neighbours: forward by A, C, G, T, then backward."""
    return F.array(*[forward_base(kmer, F.lit(b)) for b in BASES], *[backward_base(kmer, F.lit(b)) for b in BASES])


def minimizer_length(k: int) -> int:
    """The default length of a k-mer's minimizer."""
    return k - 8 if k >= 15 else k - 4 if k >= 7 else k - 2


def gmers(kmer: Column, g: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(kmer) - g + 1), lambda i: canonical(F.substring(kmer, i, F.lit(g))))


def minimizer(kmer: Column, g: int, hashed: bool = False) -> Column:
    """The smallest canonical g-mer, by its letters or by its hash."""
    if not hashed:
        return F.array_min(gmers(kmer, g))
    return F.array_min(F.transform(gmers(kmer, g), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("g"))))["g"]


def minimizer_place(kmer: Column, g: int, hashed: bool = False, borders: bool = True) -> Column:
    """Struct of the minimizer and its place (from 1), of equal ones the first. borders: whether the first and the last g-mer may be it."""
    first, n = (1, F.char_length(kmer) - g + 1) if borders else (2, F.char_length(kmer) - g)
    key = lambda x: F.xxhash64(x) if hashed else x
    each = F.transform(F.sequence(F.lit(first), n), lambda i: _let(canonical(F.substring(kmer, i, F.lit(g))), lambda x: F.struct(key(x).alias("key"), i.alias("place"), x.alias("minimizer"))))
    best = F.array_min(each)
    return F.struct(best["minimizer"].alias("minimizer"), best["place"].alias("place"))


def strand_hash(kmer: Column) -> Column:
    """Equal for both strands."""
    return F.xxhash64(canonical(kmer))


def packed_strand_hash(code: Column, k: int) -> Column:
    """strand_hash of an encoded k-mer."""
    return F.xxhash64(F.least(code, packed_revcomp(code, k)))


def with_kmers(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """A row per k-mer of each sequence: pos from 1 and kmer; windows with another letter than A, C, G, T are skipped.
    Null and shorter sequences have none."""
    keep = [c for c in reads.columns if c != seq]
    r = reads.select(*keep, F.upper(F.col(seq)).alias("_seq")).where(F.char_length("_seq") >= k)
    # pieces that overlap by k-1 bases, as the cost of cutting a k-mer grows with its place in the string
    n = F.char_length("_seq") - k + 1
    r = r.withColumn("_from", F.explode(F.sequence(F.lit(1), n, F.lit(PIECE)))).withColumn("_part", F.substring(F.col("_seq"), F.col("_from"), F.lit(PIECE + k - 1)))
    r = r.select(*keep, "_from", "_part", (~F.regexp_like("_part", F.lit("[^ACGT]"))).alias("_plain"))
    r = r.withColumn("_at", F.explode(F.sequence(F.lit(1), F.char_length("_part") - k + 1)))
    r = r.select(*keep, "_plain", (F.col("_from") + F.col("_at") - 1).alias("pos"), F.substring(F.col("_part"), F.col("_at"), F.lit(k)).alias("kmer"))
    return r.where(F.col("_plain") | ~F.regexp_like("kmer", F.lit("[^ACGT]"))).select(*keep, "pos", "kmer")


def mapped(seq: Column, dist: Column, n_kmers: Column, k: int, forward: Column) -> Column:
    """The part of a unitig that n_kmers k-mers from dist (0-based) cover, on the strand of the mapping."""
    part = F.substring(seq, dist + 1, n_kmers + (k - 1))
    return F.when(forward, part).otherwise(revcomp(part))


def head(seq: Column, k: int) -> Column:
    return F.substring(seq, F.lit(1), F.lit(k))


def tail(seq: Column, k: int) -> Column:
    return F.right(seq, F.lit(k))


def lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; null beside a null."""
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.char_length(a), F.char_length(b)))
    first = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), F.lit(False)).cast("int")
    return F.when(first > 0, F.least(first - 1, n)).otherwise(n)


def find(seq: Column, kmer: Column) -> Column:
    """0-based place of a k-mer, -1 if it is not there."""
    return F.position(kmer, seq) - 1


def strip_gaps(aligned: Column) -> Column:
    return F.replace(aligned, F.lit("-"), F.lit(""))


def quality_mask(seq: Column, qual: Column, least: int, base: int = 33) -> Column:
    """seq with N where the quality is below base + least; least 0 masks nothing."""
    if least <= 0:
        return seq
    low = lambda b, q: F.when(F.ascii(q) < base + least, F.lit("N")).otherwise(b)
    return F.array_join(F.zip_with(F.split(seq, ""), F.split(qual, ""), low), "")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once; inside a lambda a plain column is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quality_trim(seq: Column, qual: Column, lead: int = 10, trail: int = 10, window: int = 3, mean: int = 20, base: int = 33) -> Column:
    """(start, end) kept of a read: low ends are cut, then the rest from the first window whose mean quality is low."""

    def ends(q: Column) -> Column:
        places = lambda least: F.array_compact(F.transform(q, lambda x, i: F.when(x >= least, i)))
        sums = q
        for j in range(1, window):
            sums = F.zip_with(sums, F.slice(q, F.lit(j + 1), F.size(q)), lambda x, y: x + y)
        start = F.coalesce(F.array_min(places(lead)), F.size(q))
        return F.struct(start.alias("start"), F.coalesce(F.array_max(places(trail)) + 1, F.lit(0)).alias("end"), sums.alias("sums"))

    def kept(x: Column) -> Column:
        slide = F.array_compact(F.transform(x["sums"], lambda s, i: F.when((s < mean * window) & (i >= x["start"]) & (i + window <= x["end"]), i)))
        return F.struct(x["start"].alias("start"), F.greatest(x["start"], F.least(x["end"], F.coalesce(F.array_min(slide), x["end"]))).alias("end"))

    return _let(F.transform(F.split(qual, ""), lambda c: F.ascii(c) - base), lambda q: _let(ends(q), kept))


def trimmed(reads: DataFrame, least: int = 50, **limits) -> DataFrame:
    """reads with seq and qual cut by quality_trim (limits: its parameters); reads with fewer than `least` bases left go.
    Reads without qualities stay as they are."""
    cut = F.when(F.col("qual").isNotNull(), quality_trim(F.col("seq"), F.col("qual"), **limits))
    part = lambda c: F.when(F.col("_cut").isNotNull(), F.substring(F.col(c), F.col("_cut.start") + 1, F.col("_cut.end") - F.col("_cut.start"))).otherwise(F.col(c))
    r = reads.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("_cut.end") - F.col("_cut.start") >= least))
    return r.withColumns({"seq": part("seq"), "qual": part("qual")}).drop("_cut")


def allele_frequencies(cov: Column) -> Column:
    total = F.aggregate(cov, F.lit(0.0), lambda a, x: a + x)
    return F.transform(cov, lambda c: c / total)


def ploidy_peaks(p: Column) -> Column:
    """i/p for i from 1 to p-1."""
    return F.transform(F.sequence(F.lit(1), p - 1), lambda i: i / p)


def nonzero_alleles(cov: Column) -> Column:
    return F.size(F.filter(cov, lambda c: c > 0))
