import pytest
from golden import GAIN_SEVEN, GAIN_SIX, SIX, SIX_RULES, THREE, THREE_RULES

from ruleloom.operators.gain import mine_gain
from ruleloom.operators.support import mine_support


def test_support_three_records(transactions, lines):
    assert lines(mine_support(transactions(THREE), 0.2, 0.5, 0.0)) == THREE_RULES


def test_support_six_records(transactions, lines):
    assert lines(mine_support(transactions(SIX), 0.2, 0.5, 0.0)) == SIX_RULES


def test_support_bound_on_chi2_spares_single_items(transactions, lines):
    kept = lines(mine_support(transactions(THREE), 0.2, 0.5))
    assert kept == [line for line in THREE_RULES if line.split(" -> ")[0] in ("10", "11", "12")]
    strict = lines(mine_support(transactions(THREE), 0.2, 0.5, filter_singletons=True))
    assert strict == [line for line in THREE_RULES if line.startswith("12 ->")]


def test_gain_six_records(transactions, lines):
    assert lines(mine_gain(transactions(GAIN_SIX), 0.1, 0.5, 0.0)) == [
        "14 11 -> 0 (0.500000, 1.000000, 6.000000)",
        "12 -> 1 (0.500000, 0.750000, 3.000000)",
    ]


@pytest.mark.parametrize(
    ("support", "confidence", "chi2", "expected"),
    [
        (0.1, 0.3, 0.0, ["24 -> 0 (0.428571, 0.600000, 2.100000)", "22 21 -> 1 (0.142857, 0.500000, 0.058333)"]),
        (0.2, 0.6, 2.0, ["24 -> 0 (0.428571, 0.600000, 2.100000)"]),
        (0.2, 0.3, 0.0, ["22 -> 1 (0.428571, 0.750000, 1.215278)", "24 -> 0 (0.428571, 0.600000, 2.100000)"]),
        (0.1, 0.7, 0.0, ["22 -> 1 (0.428571, 0.750000, 1.215278)"]),
        (0.1, 0.3, 2.0, ["24 -> 0 (0.428571, 0.600000, 2.100000)"]),
    ],
)
def test_gain_seven_records(transactions, lines, support, confidence, chi2, expected):
    assert lines(mine_gain(transactions(GAIN_SEVEN), support, confidence, chi2)) == expected
