"""SQL text for the four run rules (the oracle side of ``kiln.operators.spc``)."""

from __future__ import annotations


def rule_exprs(prefix: str, v: str, cl: str, ucl: str, lower: str,
               idx: str = "point_index", w: str = "w", mr_of: str | None = None) -> list[str]:
    if mr_of:
        def val(k):
            a = mr_of if k == 0 else f"lag({mr_of}, {k}) over {w}"
            return f"abs({a} - lag({mr_of}, {k + 1}) over {w})"

        def exists(k):
            return f"(lag({idx}, {k + 1}) over {w} is not null)"
    else:
        def val(k):
            return v if k == 0 else f"lag({v}, {k}) over {w}"

        def exists(k):
            return "true" if k == 0 else f"(lag({idx}, {k}) over {w} is not null)"

    r1 = f"({exists(0)} and coalesce({val(0)} > {ucl} or {val(0)} < {lower}, false))"
    sides = [f"coalesce({val(k)} > {cl}, false)" for k in range(8)]
    full8 = " and ".join(exists(k) for k in range(8))
    r2 = f"(({full8}) and (({' and '.join(sides)}) or ({' and '.join('not ' + s for s in sides)})))"
    ups = " and ".join(f"coalesce({val(k + 1)} < {val(k)}, false)" for k in range(5))
    downs = " and ".join(f"coalesce({val(k + 1)} > {val(k)}, false)" for k in range(5))
    r3 = f"(({ups}) or ({downs}))"
    sig = f"(case when {ucl} <> {cl} then ({ucl} - {cl}) / 3 else 1e-9 end)"
    above = " + ".join(f"cast(coalesce({val(k)} > {cl} + 2 * {sig}, false) as integer)" for k in range(3))
    below = " + ".join(f"cast(coalesce({val(k)} < {cl} - 2 * {sig}, false) as integer)" for k in range(3))
    full3 = " and ".join(exists(k) for k in range(3))
    r4 = f"(({full3}) and (({above}) >= 2 or ({below}) >= 2))"
    return [f"{r1} as {prefix}rule1", f"{r2} as {prefix}rule2", f"{r3} as {prefix}rule3",
            f"{r4} as {prefix}rule4"]


def ooc_expr(prefix: str) -> str:
    return f"({prefix}rule1 or {prefix}rule2 or {prefix}rule3 or {prefix}rule4) as {prefix}ooc"


def count_exprs(prefix: str) -> list[str]:
    out = [f"cast(count_if({prefix}rule{k}) as bigint) as {prefix}rule{k}_count" for k in range(1, 5)]
    out.append(f"cast(count_if({prefix}ooc) as bigint) as {prefix}ooc_count")
    return out


def factor_sql(name: str, n: str) -> str:
    from kiln.functions.spc_constants import SPC_FACTORS
    vals = ", ".join(f"{float(x)}" for x in SPC_FACTORS[name])
    return f"([{vals}][least(greatest({n}, 2), 10) - 1])"
