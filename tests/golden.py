"""Small record sets with known rules."""

THREE = [((10, 11, 12), 0), ((11, 12), 0), ((12,), 1)]
SIX = [
    ((10, 11, 12), 0),
    ((20, 21, 22), 1),
    ((20, 21, 22), 0),
    ((20, 21, 22, 23), 0),
    ((20, 21), 0),
    ((21, 22), 1),
]
GAIN_SIX = [
    ((14, 13, 11, 10), 0),
    ((13, 12, 10), 1),
    ((14, 13, 11, 10), 0),
    ((14, 13, 12, 10), 1),
    ((14, 13, 12, 11, 10), 0),
    ((13, 12, 11), 1),
]
GAIN_SEVEN = [
    ((24, 20, 21, 23), 0),
    ((20, 22, 23), 1),
    ((24, 20, 21, 23), 0),
    ((24, 20, 22, 23), 1),
    ((24, 20, 22, 21, 23), 0),
    ((20, 22, 21), 1),
    ((24, 21, 23), 1),
]
THREE_RULES = [
    "11 12 -> 0 (0.666667, 1.000000, 3.000000)",
    "11 -> 0 (0.666667, 1.000000, 3.000000)",
    "10 11 12 -> 0 (0.333333, 1.000000, 0.750000)",
    "10 12 -> 0 (0.333333, 1.000000, 0.750000)",
    "10 11 -> 0 (0.333333, 1.000000, 0.750000)",
    "10 -> 0 (0.333333, 1.000000, 0.750000)",
    "12 -> 0 (0.666667, 0.666667, NaN)",
]
SIX_RULES = [
    "20 21 -> 0 (0.500000, 0.750000, 0.375000)",
    "20 -> 0 (0.500000, 0.750000, 0.375000)",
    "22 20 21 -> 0 (0.333333, 0.666667, 0.000000)",
    "22 20 -> 0 (0.333333, 0.666667, 0.000000)",
    "21 -> 0 (0.500000, 0.600000, 0.600000)",
    "22 21 -> 1 (0.333333, 0.500000, 1.500000)",
    "22 21 -> 0 (0.333333, 0.500000, 1.500000)",
    "22 -> 1 (0.333333, 0.500000, 1.500000)",
    "22 -> 0 (0.333333, 0.500000, 1.500000)",
]
