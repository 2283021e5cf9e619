"""Column-level helpers: SPC constants, moment corrections, rounding."""
