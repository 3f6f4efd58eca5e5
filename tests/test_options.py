"""Options of the command line that are refused, and the coverage of entrances."""

import pytest
from test_graph import SNP, B, K, build

from strandloom import cli
from strandloom.plans import ploidy


@pytest.mark.parametrize(
    "argv",
    [
        ["cutoff-up", "h", "1"],
        ["cutoff-low", "h", "-0.1"],
        ["count", "a", "--output", "o", "--k", "32"],
        ["count", "a", "--output", "o", "--least", "0"],
        ["build", "--refs", "a", "--output", "o", "--k", "24"],
        ["build", "--output", "o"],
        ["update", "--graph", "g", "--output", "o"],
        ["query", "a", "--graph", "g", "--output", "o", "--ratio", "1.1"],
        ["sites", "--graph", "g", "--output", "o", "--counts", "c", "--most-unitigs", "3"],
        ["sites", "--graph", "g", "--output", "o", "--counts", "c", "--gap", "3"],
        ["sites", "--graph", "g", "--output", "o", "--counts", "c", "--mismatch", "3"],
        ["sites", "--graph", "g", "--output", "o", "--counts", "c", "--low", "9", "--up", "8"],
        ["filter", "--input", "i", "--output", "o", "--q", "0.6"],
        ["filter", "--input", "i", "--output", "o", "--low", "5", "--up", "1"],
        ["model", "--frequencies", "f", "--output", "o", "--lower", "1"],
        ["model", "--frequencies", "f", "--output", "o", "--lower", "5", "--upper", "4"],
        ["model", "--frequencies", "f", "--output", "o", "--steps", "0"],
        ["model", "--frequencies", "f", "--output", "o", "--gain", "-1"],
        ["model", "--frequencies", "f", "--output", "o", "--low-ratio", "-1"],
    ],
)
def test_options_are_refused_before_spark_starts(argv):
    with pytest.raises(SystemExit) as stop:
        cli.main(argv, spark=object())
    assert stop.value.code not in (0, None)


def test_good_options_pass():
    for argv in (["sites", "--graph", "g", "--output", "o", "--counts", "c"], ["model", "--frequencies", "f", "--output", "o"], ["count", "a", "--output", "o"], ["build", "--reads", "a", "--output", "o"], ["filter", "--input", "i", "--output", "o"]):
        cli._check(cli.parser().parse_args(argv))
    a = cli.parser().parse_args(["model", "--frequencies", "f", "--output", "o"])
    assert (a.low_ratio, a.high_ratio) == (5.0, 2.0)


def test_coverage_of_entrances(spark):
    c, u, e = build(spark, [B] * 12 + [SNP] * 24)
    g = {"k": K, "unitigs": u, "edges": e}
    assert ploidy.core_coverage(g, c, 0, 100).first()[:] == (1, 36)
    assert ploidy.core_coverage(g, c, 36, 100).first()[:] == (0, None)
