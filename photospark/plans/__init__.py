"""Plan building blocks shared by the operators: lineage cuts, large groups, prefix sums."""
