"""How work is laid out on the cluster: size checks, ordered splits, exact quantiles."""
