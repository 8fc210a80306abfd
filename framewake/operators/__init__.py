"""Column-parameterised operators over timed, keyed tables."""
