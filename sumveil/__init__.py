"""Private stream aggregation on Spark: additive encodings, windowed population
sums, commit/token joins, membership diffs, telescoping keys and pairwise masks,
all expressed as DataFrame operators."""
