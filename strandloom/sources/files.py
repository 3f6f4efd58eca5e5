"""Readers and writers of sequence, graph, histogram, threshold and coverage files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_of_files(spark: SparkSession, path: str) -> list[str]:
    """One path a line; a driver-side list, as paths are arguments."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def expanded(spark: SparkSession, paths: list[str]) -> list[str]:
    """paths, where @path stands for the files listed in path."""
    return [x for p in paths for x in (list_of_files(spark, p[1:]) if p.startswith("@") else [p])]


def sniff(spark: SparkSession, path: str) -> str:
    """fasta, fastq, gfa or unknown, by the first line."""
    row = spark.read.text(path).where("trim(value) <> ''").first()
    line = row[0] if row else ""
    return "fasta" if line.startswith(">") else "fastq" if line.startswith("@") else "gfa" if line.startswith("H\tVN:Z:") else "unknown"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq, qual (null). Records are split at line starts with >; compressed files are read as a whole."""
    t = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    head = F.substring_index("v", "\n", 1)
    body = F.when(F.instr("v", "\n") > 0, F.expr("substring(v, instr(v, '\n') + 1)")).otherwise("")
    return t.select(F.regexp_extract(head, r"^(\S*)", 1).alias("read_id"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"), F.lit(None).cast("string").alias("qual"))


def _first_record(lines: list[str]) -> int:
    """Line at which a record begins: one with @ that is followed, two lines on, by one with +. A quality line may begin with @, but two lines
    after it are bases. len(lines) if there is none."""
    return next((i for i in range(len(lines) - 2) if lines[i].startswith("@") and lines[i + 2].startswith("+")), len(lines))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq, qual of four-line records. Large files are read in splits by many tasks: each takes the records that lie in its split; what is left
    over, the lines before the first record and after the last whole one, is put together with that of the next splits (two rows a
    split). Blank lines after the last record are ignored; compressed files are one split."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    kind = "file string, at long, tail boolean, lines array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string())), strict=True)], names=["file", "at", "tail", "lines"])

        split, held, begun = None, [], False
        for b in batches:
            found: list[tuple] = []
            for file, at, line in zip(*(b.column(c).to_pylist() for c in ("file", "at", "value")), strict=True):
                if (file, at) != split:
                    if split and held:
                        found.append((*split, begun, held))
                    split, held, begun = (file, at), [], at == 0
                held.append(line.rstrip("\r"))
                if not begun and len(held) > 2 and held[-3].startswith("@") and held[-1].startswith("+"):
                    first = _first_record(held)
                    if first:
                        found.append((*split, False, held[:first]))
                    held, begun = held[first:], True
                elif begun and len(held) == 4:
                    found.append((None, None, None, held))
                    held = []
            if found:
                yield rows(found)
        if split and held:
            yield rows([(*split, begun, held)])

    x = t.mapInArrow(run, kind)
    # a tail opens a record, the heads of the next splits go on with it; no more than two rows a split
    group = F.sum(F.col("tail").cast("int")).over(Window.partitionBy("file").orderBy("at", "tail"))
    loose = x.where("file is not null").withColumn("record", group).groupBy("file", "record").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tail", "lines"))), lambda y: y["lines"])).alias("lines"))
    whole = F.floor(F.size("lines") / 4).cast("int")  # a split without a record's first three lines is passed on, so there may be several records
    loose = loose.where(whole > 0).select(F.explode(F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.slice("lines", 4 * i + 1, F.lit(4)))).alias("lines")).where(F.col("lines")[0] != "")
    p = x.where("file is null").select("lines").unionByName(loose)
    return p.select(F.regexp_extract(F.col("lines")[0], r"^@(\S*)", 1).alias("read_id"), F.upper(F.col("lines")[1]).alias("seq"), F.col("lines")[3].alias("qual"))


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FASTA, FASTQ and GFA segments in the given order: color (place of the file in the list), file, read_id, seq, qual."""
    out = None
    for color, path in enumerate(paths):
        kind = sniff(spark, path)
        if kind == "unknown":
            raise ValueError(f"{path}: neither FASTA, FASTQ nor GFA")
        d = read_fasta(spark, path) if kind == "fasta" else read_fastq(spark, path) if kind == "fastq" else read_gfa(spark, path)["segments"].select(F.col("name").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))
        d = d.select(F.lit(color).alias("color"), F.lit(path).alias("file"), "read_id", "seq", "qual")
        out = d if out is None else out.unionByName(d)
    return out


def read_gfa(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """header (k, g from the tags KL and ML), segments (name, seq), links (src, src_fwd, dst, dst_fwd, overlap); GFA 1 and GFA 2."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    kind = F.col("f")[0]
    f = lambda i: F.get("f", F.lit(i))
    tag = lambda name: F.regexp_extract(F.array_join("f", "\t"), rf"{name}:Z:(\d+)", 1)
    header = t.where(kind == "H").select(F.nullif(tag("KL"), F.lit("")).cast("int").alias("k"), F.nullif(tag("ML"), F.lit("")).cast("int").alias("g"))
    dna = F.regexp_like(f(2), F.lit("^[A-Za-z*]+$"))
    segments = t.where(kind == "S").select(f(1).alias("name"), F.upper(F.when(dna, f(2)).otherwise(f(3))).alias("seq"))
    one = t.where(kind == "L").select(f(1).alias("src"), (f(2) == "+").alias("src_fwd"), f(3).alias("dst"), (f(4) == "+").alias("dst_fwd"), f(5).alias("overlap"))
    two = t.where(kind == "E").select(F.regexp_replace(f(2), "[+-]$", "").alias("src"), f(2).endswith("+").alias("src_fwd"), F.regexp_replace(f(3), "[+-]$", "").alias("dst"), f(3).endswith("+").alias("dst_fwd"), f(8).alias("overlap"))
    return {"header": header, "segments": segments, "links": one.unionByName(two)}


def gfa_lines(u: DataFrame, e: DataFrame, k: int, g: int) -> DataFrame:
    """line of a GFA 1 file: header, segments by id, links once each."""
    head = u.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(0).cast("long").alias("id"), F.lit(f"H\tVN:Z:1.0\tKL:Z:{k}\tML:Z:{g}").alias("line"))
    seg = u.select(F.lit(1).alias("o"), F.col("unitig_id").alias("id"), F.concat_ws("\t", F.lit("S"), F.col("unitig_id").cast("string"), "seq").alias("line"))
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    # a link and its reverse twin are one line
    once = e.where((F.col("src") < F.col("dst")) | ((F.col("src") == F.col("dst")) & (F.col("src_fwd") | ~F.col("dst_fwd"))))
    link = once.select(F.lit(2).alias("o"), F.col("src").alias("id"), F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), sign("src_fwd"), F.col("dst").cast("string"), sign("dst_fwd"), F.lit(f"{k - 1}M")).alias("line"))
    return head.unionByName(seg).unionByName(link)


def write_gfa(u: DataFrame, e: DataFrame, k: int, g: int, path: str) -> None:
    gfa_lines(u, e, k, g).orderBy("o", "id", "line").select("line").write.text(path)


def write_fasta(u: DataFrame, path: str) -> None:
    """Ids from 0."""
    u.orderBy("unitig_id").select(F.concat(F.lit(">"), (F.col("unitig_id") - 1).cast("string"), F.lit("\n"), "seq")).write.text(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """cov, freq of tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="cov int, freq bigint")


def read_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """low, up: one row a sample, in order; a few rows, numbered as sample_id from 0."""
    rows = [r for r in spark.read.csv(path, sep="\t", schema="low int, up int").collect()]
    if any(r["low"] is None or r["up"] is None or r["low"] > r["up"] for r in rows):
        raise ValueError("every line needs low and up, low no larger than up")
    return spark.createDataFrame([(i, r["low"], r["up"]) for i, r in enumerate(rows)], "sample_id int, low int, up int")


def read_frequencies(spark: SparkSession, path: str, q: float = 0.0) -> DataFrame:
    """freq between q and 1-q, both included."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("v")).where("v <> ''").select(F.col("v").cast("double").alias("freq")).where(F.col("freq").between(q, 1 - q))


def read_coverage(spark: SparkSession, path: str, n_alleles: int, multi: bool = False) -> DataFrame:
    """A coverage table (tab-separated, with a trailing tab) as normalised sites."""
    names = [f"c{i}" for i in range(n_alleles)] + (["color"] if multi else []) + ["is_simple", "indel_size", "bubble_id", "var_num"] + (["cramer_v"] if multi else []) + ["var_dis"]
    t = spark.read.text(path).select(F.split(F.rtrim("value"), r"\s+").alias("f")).where(F.size("f") >= len(names))
    d = t.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return d.select(
        F.col("bubble_id").cast("long").alias("bubble_id"), (F.col("color").cast("int") if multi else F.lit(0)).alias("color"), F.lit(n_alleles).alias("n_alleles"),
        F.array(*[F.col(f"c{i}").cast("double") for i in range(n_alleles)]).alias("cov"), F.col("is_simple").cast("int").alias("is_simple"), F.col("indel_size").cast("int").alias("indel_size"),
        F.col("var_num").cast("int").alias("var_num"), (F.col("cramer_v").cast("double") if multi else F.lit(0.0)).alias("cramer_v"), F.col("var_dis").cast("int").alias("var_dis"),
    )


def write_alignments(rows: DataFrame, path: str) -> None:
    """A FASTA record for each aligned path (bubble_id, path_no, aligned)."""
    rows.select(F.concat(F.lit(">"), F.concat_ws("_", F.col("bubble_id").cast("string"), F.col("path_no").cast("string")), F.lit("\n"), "aligned")).write.text(path)


def write_coverage(site_cov: DataFrame, path: str, n_alleles: int, multi: bool = False) -> None:
    """The same table, tab-separated with a trailing tab."""
    s = site_cov.where(F.col("n_alleles") == n_alleles)
    cols = [F.get("cov", F.lit(i)).cast("string") for i in range(n_alleles)] + ([F.col("color").cast("string")] if multi else [])
    cols += [F.col(c).cast("string") for c in ("is_simple", "indel_size", "bubble_id", "var_num", *(["cramer_v"] if multi else []), "var_dis")]
    s.select(F.concat(F.concat_ws("\t", *cols), F.lit("\t"))).write.text(path)


def write_frequencies(freq: DataFrame, path: str) -> None:
    freq.select(F.round("freq", 7).cast("string")).write.text(path)


def write_bubbles(b: DataFrame, path: str) -> None:
    """BubbleId, Entrance, Strand, Exit, isSimple, isComplex, tab-separated with a header; ids by entrance and strand."""
    sign = F.when(F.col("entrance_fwd"), "+").otherwise("-")
    key = F.concat_ws(":", F.least("entrance", "exit").cast("string"), F.greatest("entrance", "exit").cast("string"))
    b.select(key.alias("BubbleId"), F.col("entrance").alias("Entrance"), sign.alias("Strand"), F.col("exit").alias("Exit"), F.col("is_simple").cast("int").alias("isSimple"), F.col("is_complex").cast("int").alias("isComplex")).write.csv(path, sep="\t", header=True)


def write_presence(p: DataFrame, path: str) -> None:
    p.write.csv(path, sep="\t", header=True)
