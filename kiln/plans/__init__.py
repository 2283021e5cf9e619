"""Physical patterns shared by the operators.

P1 one-pass statistics (``stats``), P2 exact quantiles (``quantiles``), P3 global
order without a single partition (``ordering``), P4 ranks and prefix sums and
P5 Kendall's tau-b (``ranks``).
"""
