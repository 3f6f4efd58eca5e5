"""Every query with SQL gives DuckDB's rows on the smallest tables; the slow ones run in the driver's own check."""

import os

import duckdb
import pytest

from strandloom import registry

D = "/root/testdata/sf0.001"
QUICK = ["reads_view", "cutoffs_by_sample", "presence_inexact", "kmer_degree", "unitigs", "shared_kmers", "allele_freq", "filter_single", "filter_multi", "cramers_v", "variant_distance", "gmm_loglik", "gmm_em_step", "freq_density", "ploidy_peaks", "sequence_ends", "trimmed_reads", "kmer_neighbours", "strand_hashes", "merged_colors"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "lineitem", "nation"):
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    b = c.sql(registry.oracle_sql()[name]).df()
    a = registry.queries()[name](spark, D).toPandas()
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    assert sorted(map(str, a[cols].values.tolist())) == sorted(map(str, b[cols].values.tolist()))
