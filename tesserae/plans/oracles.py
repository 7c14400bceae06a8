"""SQL that gives the rows of the registered queries on DuckDB.

Matrices are written out densely, customers times parts, where the queries work on stored entries and closed forms for the
zeros, so that a mistake in one isn't shared by the other.
"""

from __future__ import annotations

_X = "select o_custkey as obs_id, l_partkey as var_id, cast(sum(l_quantity) as double) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2"
BASE = f"""x as materialized ({_X}),
obs as (select cast(c_custkey as bigint) as obs_id, c_mktsegment as segment from customer),
var as (select cast(p_partkey as bigint) as var_id, p_name as var_name, p_brand as brand, p_size <= 10 as small from part),
d as (select obs.obs_id, var.var_id, segment, small, coalesce(value, 0.0::double) as value from obs cross join var left join x on x.obs_id = obs.obs_id and x.var_id = var.var_id)"""
LOGGED = f"""{BASE},
sums as (select obs_id, sum(value) as t from x group by 1),
e as (select d.obs_id, d.var_id, segment, case when value = 0 then 0.0::double else ln(1 + value * 10000.0::double / t) end as value from d left join sums using (obs_id))"""


def r(expression: str, name: str, places: int = 6) -> str:
    return f"round(cast({expression} as double), {places}) + 0.0::double as {name}"


def _axis(select: str, key: str, where: str = "true") -> str:
    return f"with {BASE} select {key}, {select} from d where {where} group by {key}"


_COUNT_SUM = f"count(*) filter (value <> 0) as n, {r('sum(value)', 'total')}"
_MASKED = f"count(*) filter (value <> 0 and small) as n, {r('coalesce(sum(value) filter (small), 0)', 'total')}"


def _top(key: str) -> str:
    return f"with {BASE} select {key}, array_to_string(list_transform(list_slice(list_sort(list(value), 'DESC'), 1, 5), lambda v: format('{{:.1f}}', v)), ',') as top from d group by {key}"


def _shares(key: str) -> str:
    parts = ", ".join(r(f"case when sum(value) > 0 then coalesce(sum(value) filter (rn <= {n}), 0) / sum(value) else 0 end", f"top_{n}") for n in (5, 10, 20))
    return f"with {BASE}, k as (select *, row_number() over (partition by {key} order by value desc) as rn from d) select {key}, {parts} from k group by {key}"


def _qc_obs() -> str:
    parts = [
        "count(*) filter (value <> 0) as n_genes_by_counts", r("ln(1 + count(*) filter (value <> 0))", "log1p_n_genes_by_counts"), r("sum(value)", "total_counts"), r("ln(1 + sum(value))", "log1p_total_counts"),
        *(r(f"case when sum(value) > 0 then 100 * sum(value) filter (rn <= {n}) / sum(value) else 0 end", f"pct_counts_in_top_{n}_genes") for n in (5, 10, 20)),
        r("sum(case when small then value else 0 end)", "total_counts_small"), r("ln(1 + sum(case when small then value else 0 end))", "log1p_total_counts_small"),
        r("case when sum(value) > 0 then 100 * sum(case when small then value else 0 end) / sum(value) else 0 end", "pct_counts_small"),
    ]
    return f"with {BASE}, k as (select *, row_number() over (partition by obs_id order by value desc) as rn from d) select obs_id, {', '.join(parts)} from k group by obs_id"


def _qc_var() -> str:
    parts = ["count(*) filter (value <> 0) as n_cells_by_counts", r("avg(value)", "mean_counts"), r("ln(1 + avg(value))", "log1p_mean_counts"), r("100.0 * count(*) filter (value = 0) / count(*)", "pct_dropout_by_counts"), r("sum(value)", "total_counts"), r("ln(1 + sum(value))", "log1p_total_counts")]
    return _axis(", ".join(parts), "var_id")


_HVG = f"""with {BASE},
m as (select var_id, avg(value) as mean, var_samp(value) as var from d group by 1),
l as (select var_id, ln(mean + 1) as means, case when var / greatest(mean, 1e-12) > 0 then ln(var / greatest(mean, 1e-12)) end as dispersions from m),
b as (select *, (select min(means) from l) as lo, (select max(means) from l) as hi from l),
k as (select *, (select max(i) from range(20) t(i) where i = 0 or lo + i * ((hi - lo) / 20.0::double) <= means) as bin from b),
s as (select bin, avg(dispersions) as am, stddev_samp(dispersions) as sd from k group by bin),
z as (select var_id, means, dispersions, case when sd is null then (case when am <> 0 then dispersions / am end) when sd <> 0 then (dispersions - am) / sd end as norm from k join s using (bin))
select var_id, {r('means', 'means')}, {r('dispersions', 'dispersions')}, {r('norm', 'dispersions_norm')}, """

_MEANS = f"""with {BASE},
m as (select var_id, avg(value) as mean, var_samp(value) as var from d group by 1),
l as (select var_id, ln(mean + 1) as means, ln(var / greatest(mean, 1e-12)) as disp from m where var > 0 union all select var_id, ln(mean + 1), null from m where not var > 0)"""
_BATCHED = f"""{_MEANS},
e as (select brand, min(means) as lo, max(means) as hi from l join var using (var_id) group by 1),
k as (select l.*, brand, case when means = hi then 4 else cast(floor((means - lo) / ((hi - lo) / 5.0::double)) as int) end as bin from l join var using (var_id) join e using (brand)),
s as (select brand, bin, avg(disp) as am, stddev_samp(disp) as sd from k group by 1, 2)
select var_id, {r('case when sd > 0 then coalesce((disp - am) / sd, 0) else 0 end', 'dispersions_norm')} from k join s using (brand, bin)"""

def _loess(span: float, batch: str, hit: str, mark: str) -> str:
    """All pairs of variables of a batch, and normal equations by determinants."""

    def det(a: str, b: str, c: str) -> str:
        (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = (v.split() for v in (a, b, c))
        return f"({a0} * ({b1} * {c2} - {b2} * {c1}) - {b0} * ({a1} * {c2} - {a2} * {c1}) + {c0} * ({a1} * {b2} - {a2} * {b1}))"

    sums = ", ".join([*(f"sum(w * u ** {k}) as m{k}" for k in range(5)), *(f"sum(w * u ** {k} * y) as t{k}" for k in range(3))])
    fit = f"{det('t0 t1 t2', 'm1 m2 m3', 'm2 m3 m4')} / {det('m0 m1 m2', 'm1 m2 m3', 'm2 m3 m4')}"
    return f"""with {BASE},
e as materialized (select {batch} as batch, var_id, value from d),
m as (select batch, var_id, count(*) as n, avg(value) as mean, var_samp(value) as variance from e group by 1, 2),
p as materialized (select *, round(log10(mean), 9) as x, round(log10(variance), 9) as y from m where mean > 0 and variance > 1e-12 * mean * mean),
k as (select batch, greatest(1, floor({span}::double * count(*) + 1e-5)) as near from p group by 1),
g as materialized (select a.batch, a.var_id, near, b.x - a.x as off, b.y - a.y as y, row_number() over (partition by a.batch, a.var_id order by abs(b.x - a.x)) as rn from p a join p b on a.batch = b.batch join k on k.batch = a.batch),
h as (select batch, var_id, max(abs(off)) as h from g where rn <= near group by 1, 2),
w as (select g.batch, g.var_id, off / h as u, y, (1 - abs(off / h) ** 3) ** 3 as w from g join h on g.batch = h.batch and g.var_id = h.var_id where abs(off) < h),
s as (select batch, var_id, count(distinct u) as kinds, {sums} from w group by 1, 2),
lv as (select batch, var_id, avg(y) filter (off = 0) as level from g group by 1, 2),
f as (select p.batch, p.var_id, n, mean, sqrt(10 ** (p.y + case when coalesce(kinds, 0) < 4 then level else {fit} end)) as sd from p join lv on lv.batch = p.batch and lv.var_id = p.var_id left join s on s.batch = p.batch and s.var_id = p.var_id),
z as (select e.batch, e.var_id, sum((least(value, mean + sd * sqrt(n)) - mean) ** 2) / ((max(n) - 1) * max(sd) ** 2) as norm from e join f on e.batch = f.batch and e.var_id = f.var_id group by 1, 2),
o as (select *, row_number() over (partition by batch order by round(norm, 9) desc, var_id) - 1 as place from z),
a as (select var_id, sum(norm) / (select count(distinct batch) from e) as norm, count(*) filter ({hit}) as many, median(place) filter ({hit}) as rank from o group by 1),
v as (select d.var_id, avg(value) as mean, var_samp(value) as variance from d group by 1),
b as (select v.*, coalesce(norm, 0) as norm, coalesce(many, 0) as many, rank, row_number() over (order by rank nulls last, many desc, v.var_id) as best from v left join a on a.var_id = v.var_id)
select var_id, {r('mean', 'means')}, {r('variance', 'variances')}, {r('norm', 'variances_norm')}, cast(many as bigint) as highly_variable_nbatches, {r('rank', 'highly_variable_rank')}, {mark} as highly_variable from b"""


def _percentile(n_bins: int, within: str, mark: str) -> str:
    return f"""with {BASE},
m as (select var_id, avg(value) as mean, var_samp(value) as var from d group by 1),
l as (select var_id, case when mean = 0 then 1e-12::double else mean end as means, nullif(var / case when mean = 0 then 1e-12::double else mean end, 0) as disp from m),
e as (select distinct unnest(quantile_cont(means, [{', '.join(f'{i} / {n_bins}.0::double' for i in range(1, n_bins))}])) as edge from l),
k as (select *, (select count(*) from e where edge < means)::int as bin from l),
c as (select *, median(disp) over (partition by bin) as center from k),
s as (select *, disp - center as off, median(abs(disp - center)) over (partition by bin) / 0.6744897501960817::double as spread from c),
z as (select *, case when spread > 0 then off / spread end as norm from s),
t as (select *, {within} as inside, case when {within} and norm is not null then rank() over (partition by {within} and norm is not null order by round(norm, 9) desc) end as place from z)
select var_id, {r('means', 'means')}, {r('disp', 'dispersions')}, {r('norm', 'dispersions_norm')}, bin, coalesce({mark}, false) as highly_variable from t"""


_GROUPED = f"""with {{base}},
g as (select distinct segment as grp from obs),
k as (select grp, var_id, coalesce(segment = grp, false) as mine, value from {{of}} cross join g)"""
_SUMS = ", ".join(r(f"coalesce(sum({v}) filter ({'' if mine else 'not '}mine), 0)", f"{c}{'' if mine else '_ref'}") for mine in (True, False) for c, v in (("n", "1"), ("s", "value"), ("q", "value * value")))


def _stat(t: str, df: str, pairs: str = _GROUPED.format(base=BASE, of="d")) -> str:
    return f"""{pairs},
s as (select grp, var_id, count(*) filter (mine) as n, count(*) filter (not mine) as m, avg(value) filter (mine) as a, avg(value) filter (not mine) as b,
      var_samp(value) filter (mine) as v, var_samp(value) filter (not mine) as w from k group by 1, 2)
select grp as "group", var_id, {r(f"case when a = 0 and b = 0 then 0 else {t} end", 't')}, {r(df, 'df')} from s"""


_WELCH_DF = "case when v + w > 0 then (v / n + w / m) * (v / n + w / m) / ((v / n) * (v / n) / (n - 1) + (w / m) * (w / m) / (m - 1)) else n + m - 2 end"


def _ranks(pairs: str, count: str) -> str:
    """Ranks over dense rows of grp, var_id, mine and value; z by the normal form with ties and continuity."""
    z = "case when sd2 > 0 then sign(u - n * m / 2.0::double) * greatest(abs(u - n * m / 2.0::double) - 0.5::double, 0) / sqrt(sd2) else 0 end"
    return f"""{pairs},
a as (select grp, var_id, mine, cast(rank() over w as double) + (count(*) over (partition by grp, var_id, value) - 1) / 2.0::double as rk, cast(count(*) over (partition by grp, var_id, value) as double) as t, count(*) over (partition by grp, var_id) as total
      from k window w as (partition by grp, var_id order by value)),
s as (select grp, var_id, cast(count(*) filter (mine) as double) as n, cast(count(*) filter (not mine) as double) as m, sum(rk) filter (mine) as rs, sum(t * t - 1) as ties, cast(any_value(total) as double) as total from a group by 1, 2),
u as (select grp, var_id, n, m, rs - n * (n + 1) / 2 as u, n * m / 12.0::double * (total + 1 - ties / (total * (total - 1))) as sd2 from s)
select grp as "group", var_id, {r('u', 'u')}, {r(z, 'z')} from u"""


_REFERENCE = f"""with {BASE},
g as (select distinct segment as grp from obs),
k as (select grp, var_id, true as mine, value from d join g on segment = grp union all select grp, var_id, false, value from d cross join g where segment = 'BUILDING')"""

_NATIONS = """recursive x as (select c_nationkey as obs_id, l_partkey as var_id, cast(sum(l_quantity) as double) as value from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey group by 1, 2),
d as materialized (select n_nationkey as obs_id, cast(p_partkey as bigint) as var_id, cast(n_regionkey as varchar) as region, coalesce(value, 0) as value from nation cross join part left join x on x.obs_id = n_nationkey and x.var_id = p_partkey)"""


def _counted(pairs: str) -> str:
    """u and its p over grp, var_id, mine and value: ways to take k observations with a doubled rank sum s, one observation after another."""
    return f"""with {_NATIONS},
{pairs},
item as materialized (select *, cast(2 * rank() over (partition by pool, var_id order by value) + count(*) over (partition by pool, var_id, value) - 1 as int) as r2,
                      row_number() over (partition by pool, var_id order by value, obs_id) as i, count(*) over (partition by pool, var_id) as total from pooled),
ways as (select pool, var_id, 0 as i, 0 as k, 0 as s, 1.0::double as w from (select distinct pool, var_id from pooled) union all
  select pool, var_id, i, k, s, sum(w) from (select ways.pool, ways.var_id, item.i, k + take as k, s + take * r2 as s, w
    from ways join item on item.pool = ways.pool and item.var_id = ways.var_id and item.i = ways.i + 1 cross join (values (0), (1)) t(take) where k + take <= 5) group by 1, 2, 3, 4, 5),
done as (select ways.* from ways join (select pool, var_id, max(i) as i from item group by 1, 2) using (pool, var_id, i)),
own as (select pool, grp, var_id, sum(r2) as s, count(*) as n from item join mine using (pool, obs_id) group by 1, 2, 3),
tail as (select grp, var_id, any_value(own.s - n * (n + 1)) / 2.0::double as u, least(1.0::double, 2 * least(sum(w) filter (done.s <= own.s), sum(w) filter (done.s >= own.s)) / sum(w)) as p
         from own join done using (pool, var_id) where done.k = n group by 1, 2)"""


_EXACT = _counted("pooled as (select 'all' as pool, obs_id, var_id, value from d), mine as (select 'all' as pool, n_nationkey as obs_id, cast(n_regionkey as varchar) as grp from nation)")
_EXACT_REFERENCE = _counted("""g as (select distinct region as pool from d where region <> '1'), pooled as (select pool, obs_id, var_id, value from d join g on region = pool or region = '1'),
mine as (select region as pool, obs_id, region as grp from (select distinct obs_id, region from d where region <> '1'))""")
#: The customers' segments, which are the columns of wide tables.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Nodes within 0..1 and weights of the Gauss-Legendre rule of eight points.
_NODES = ((0.1834346424956498, 0.3626837833783620), (0.5255324099163290, 0.3137066458778873), (0.7966664774136267, 0.2223810344533745), (0.9602898564975363, 0.1012285362903763))
_AT = ", ".join(f"{0.5 + sign * x / 2!r}::double" for x, _ in _NODES for sign in (1, -1))
_WEIGHT = ", ".join(f"{w / 2!r}::double" for _, w in _NODES for _ in (1, -1))


def _tail(density: str, low: str, high: str, panels: int = 20) -> str:
    """The integral of a density of u from low to high, by the rule on equal panels."""
    u = f"({low} + ({high} - {low}) * ((i // 8) + ([{_AT}])[i % 8 + 1]) / {panels}.0::double)"
    return f"list_sum(list_transform(range({8 * panels}), lambda i: ([{_WEIGHT}])[i % 8 + 1] * {density.replace('{u}', u)})) * ({high} - {low}) / {panels}.0::double"


#: Two tails of a normal and of a Student variable, each to where the density is exp(-40) of its start.
_NORMAL_P = "2 * " + _tail("exp(-{u} * {u} / 2) / sqrt(2 * pi())", "abs(z)", "sqrt(z * z + 80)")
_STUDENT_P = "2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * " + _tail("pow(1 + {u} * {u} / df, -(df + 1) / 2)", "abs(t)", "sqrt((df + t * t) * exp(80 / (df + 1)) - df)")

_LOGGED_PAIRS = _GROUPED.format(base=LOGGED, of="e")
_FOLD = "case when a = 0 and b = 0 then 0 else log2(exp(a)) + log2((1 - exp(-a) + exp(-a)) / exp(b)) end"
_SIDES = """s as (select grp, var_id, count(*) filter (mine) as n, count(*) filter (not mine) as m, avg(value) filter (mine) as a, avg(value) filter (not mine) as b,
      var_samp(value) filter (mine) as v, var_samp(value) filter (not mine) as w from k group by 1, 2)"""


def _welch_tested(pairs: str) -> str:
    return f"""{pairs}, {_SIDES},
w as (select grp, var_id, a = 0 and b = 0 as silent, case when a = 0 and b = 0 then 0 else (a - b) / sqrt(v / n + w / m) end as t, {_WELCH_DF} as df, {_FOLD} as fold from s),
tested as (select grp, var_id, t as score, case when silent then 1 else {_STUDENT_P} end as p, fold from w)"""


_WELCH_TESTED = _welch_tested(_LOGGED_PAIRS)
_MANN_WHITNEY_TESTED = f"""{_LOGGED_PAIRS},
c as (select grp, var_id, mine, cast(rank() over o as double) + (count(*) over (partition by grp, var_id, value) - 1) / 2.0::double as rk, cast(count(*) over (partition by grp, var_id, value) as double) as t, count(*) over (partition by grp, var_id) as total, value
      from k window o as (partition by grp, var_id order by value)),
s as (select grp, var_id, cast(count(*) filter (mine) as double) as n, cast(count(*) filter (not mine) as double) as m, avg(value) filter (mine) as a, avg(value) filter (not mine) as b, sum(rk) filter (mine) as rs, sum(t * t - 1) as ties, cast(any_value(total) as double) as total from c group by 1, 2),
w as (select *, rs - n * (n + 1) / 2 as u, n * m / 12.0::double * (total + 1 - ties / (total * (total - 1))) as sd2 from s),
x2 as (select *, case when sd2 > 0 then sign(u - n * m / 2.0::double) * greatest(abs(u - n * m / 2.0::double) - 0.5::double, 0) / sqrt(sd2) else 0 end as z from w),
tested as (select grp, var_id, case when a = 0 and b = 0 then 0 else u end as score, case when a = 0 and b = 0 then 1 else {_NORMAL_P} end as p, {_FOLD} as fold from x2)"""


def _in_order(tested: str) -> str:
    """Tests with p adjusted by group after Benjamini and Hochberg, and their rank."""
    return f"""{tested},
o as (select *, cast(row_number() over (partition by grp order by p, var_id) as double) as i, cast(count(*) over (partition by grp) as double) as m from tested),
h as (select *, least(1.0::double, min(m * p / i) over (partition by grp order by i desc rows between unbounded preceding and current row)) as adj from o),
f as (select *, row_number() over (partition by grp order by adj, p, var_id) as place from h)"""


_EXACT_RANKED = _in_order(f"""{_EXACT}, mean as (select grp, var_id, avg(value) filter (region = grp) as a, avg(value) filter (region <> grp) as b from d cross join (select distinct grp from tail) group by 1, 2),
tested as (select grp, var_id, case when a = 0 and b = 0 then 0 else u end as score, p from tail join mean using (grp, var_id))""")


def _ranked(tested: str, most: int | None = None) -> str:
    columns = ", ".join(r(e, n) for e, n in (("score", "score"), ("p", "pval"), ("adj", "pval_adj"), ("fold", "logfoldchange")))
    return f"""{_in_order(tested)}
select grp as "group", 'rest' as reference, p_name as gene, {columns}, cast(place as int) as rank from f join part on p_partkey = var_id{f' where place <= {most}' if most else ''}"""


_LOGGED_REFERENCE = _REFERENCE.replace(BASE, LOGGED).replace("from d join g", "from e join g").replace("from d cross join g", "from e cross join g").replace("distinct segment as grp from obs", "distinct segment as grp from obs where segment in ('AUTOMOBILE', 'MACHINERY')")
_STORED = f"""{_in_order(_welch_tested(_LOGGED_REFERENCE))}
select cast(place as int) as rank, {', '.join(f"max(p_name) filter (grp = '{g}') as \"{g}\", {r(f"max(score) filter (grp = '{g}')", f'score_{g}')}" for g in ('AUTOMOBILE', 'MACHINERY'))}
from f join part on p_partkey = var_id where place <= 40 group by place"""

_P = "p as (select p_brand as family, cast(p_partkey as bigint) as test, cast(p_partkey * 7919 % 1009 as double) / 1009.0::double as p from part), o as (select *, cast(row_number() over (partition by family order by p, test) as double) as i, cast(count(*) over (partition by family) as double) as m from p)"


def _adjusted(expression: str, factor: str = "1.0::double") -> str:
    """By a subquery for each test over those of its family."""
    return f"with {_P} select family, test, round(p, 9) + 0.0::double as p, {r(f'least(1.0::double, (select {expression} from o b where b.family = a.family and {{side}}) * {factor})', 'pval_adj', 9)} from o a"


_ABOVE, _BELOW = "b.i >= a.i", "b.i <= a.i"
_BH = "min(b.m * b.p / b.i)"
_HARMONIC = "(select sum(1.0::double / c.i) from o c where c.family = a.family)"
_PI0 = "least(1.0::double, (select count(*) from o c where c.family = a.family and c.p > 0.5) / (a.m * 0.5::double))"



def _together(each: str, running: str, factor: str = "1.0::double") -> str:
    """All tests as one family, put in order whole."""
    return f"""with p as (select cast(p_partkey as bigint) as test, cast(p_partkey * 7919 % 1009 as double) / 1009.0::double as p from part),
o as (select *, cast(row_number() over (order by p, test) as double) as i, cast(count(*) over () as double) as m from p),
h as (select *, {running.replace('{}', each)} as best, (select sum(1.0::double / i) from o) as harmonic, (select count(*) from o where p > 0.5) as above from o)
select test, round(p, 9) + 0.0::double as p, {r(f'least(1.0::double, best * {factor})', 'pval_adj', 9)} from h"""


_FROM_END = "min({}) over (order by i desc rows between unbounded preceding and current row)"

#: Squarings of a matrix, after which nothing but its first component is left, and components.
_SQUARINGS, _COMPONENTS, _SPACE_COMPONENTS = 24, 10, 5
_SQUARED = "list_transform(range(1, w + 1), lambda i: list_transform(range(1, w + 1), lambda j: list_inner_product(a[i], a[j])))"


def _squared(head: str, k: int) -> str:
    """found and vectors: the k first components of a matrix, which head has as rows (i, line)."""
    return f"""with recursive {head},
step as (select 1 as k, 0 as s, m, m as a, len(m) as w from (select list(line order by i) as m from rows) union all
  select if(s < {_SQUARINGS}, k, k + 1), if(s < {_SQUARINGS}, s + 1, 0), if(s < {_SQUARINGS}, m, less),
         if(s < {_SQUARINGS}, list_transform(q, lambda u: list_transform(u, lambda x: x / list_sum(list_transform(range(1, w + 1), lambda i: q[i][i])))), less), w
  from (select *, list_transform(range(1, w + 1), lambda i: list_transform(range(1, w + 1), lambda j: m[i][j] - value * a[i][j])) as less from
        (select *, {_SQUARED} as q, list_sum(list_transform(range(1, w + 1), lambda i: list_inner_product(m[i], a[i]))) as value from step where k <= {k}))),
found as (select k - 1 as component, w, list_sum(list_transform(range(1, w + 1), lambda i: list_inner_product(m[i], a[i]))) as value, list_transform(range(1, w + 1), lambda i: a[i][i]) as own, a from step where s = {_SQUARINGS} and k <= {k}),
vectors as (select component, list_transform(a[list_position(own, list_max(own))], lambda x: x / sqrt(list_max(own))) as v from found)"""


_COMPONENT = _squared(
    """e as (select cast(vec_id as bigint) as obs_id, cast(embedding as double[]) as v from embeddings),
l as (select obs_id, i, v[i] as x from e, unnest(range(1, len(v) + 1)) t(i)),
c as materialized (select obs_id, i, x - avg(x) over (partition by i) as x from l),
g as (select a.i, b.i as j, sum(a.x * b.x) as s from c a join c b using (obs_id) group by 1, 2),
rows as (select i, list(s order by j) as line from g group by i)""",
    _COMPONENTS,
)
_VARIANCE = f"""{_COMPONENT}, z as (select component, value, (select sum(s) from g where i = j) as total, (select count(*) from e) as n from found)
select cast(component as int) as component, {r('value / (n - 1)', 'explained_variance')}, {r('value / total', 'ratio')}, {r('sum(value / total) over (order by component)', 'cumulative')} from z"""
_SCORES = f"""{_COMPONENT}, y as (select obs_id, list(x order by i) as x from c group by 1)
select obs_id, {', '.join(r(f'max(list_inner_product(x, v)) filter (component = {i})', f'c{i}') for i in range(_COMPONENTS))} from y cross join vectors group by 1"""
_LOADINGS = f"""{_COMPONENT}, y as (select component, i - 1 as var_id, v[i] as x from vectors, unnest(range(1, len(v) + 1)) t(i))
select cast(var_id as bigint) as var_id, {', '.join(r(f'max(x) filter (component = {i})', f'c{i}') for i in range(_COMPONENTS))} from y group by 1"""

#: By products of observations, of which there are fewer; a component of variables is what the matrix makes of one of observations.
_SPACE = _squared(
    """x as (select c_nationkey as nation, c_mktsegment as segment, l_partkey as var_id, cast(sum(l_quantity) as double) as value from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey group by 1, 2, 3),
o as (select nation, segment, row_number() over (order by nation, segment) as i from (select distinct c_nationkey as nation, c_mktsegment as segment from customer)),
d as (select i, cast(p_partkey as bigint) as var_id, coalesce(value, 0) as x from o cross join part left join x on x.nation = o.nation and x.segment = o.segment and x.var_id = p_partkey),
c as materialized (select i, var_id, x - avg(x) over (partition by var_id) as x from d),
lines as materialized (select i, list(x order by var_id) as line from c group by i),
rows as (select a.i, list(list_inner_product(a.line, b.line) order by b.i) as line from lines a cross join lines b group by a.i)""",
    _SPACE_COMPONENTS,
)
_SPACE_VARIANCE = f"""{_SPACE}, z as (select component, value, (select sum(x * x) from c) as total, (select count(*) from o) as n from found)
select cast(component as int) as component, {r('value / (n - 1)', 'explained_variance')}, {r('value / total', 'ratio')}, {r('sum(value / total) over (order by component)', 'cumulative')} from z"""
_SPACE_LOADINGS = f"""{_SPACE}, y as (select component, var_id, sum(x * v[i]) / sqrt(any_value(value)) as x from vectors join found using (component) cross join c group by 1, 2),
t as (select *, max(x) over (partition by component) >= -min(x) over (partition by component) as up from y)
select var_id, {', '.join(r(f'max(if(up, x, -x)) filter (component = {i})', f'c{i}', 4) for i in range(_SPACE_COMPONENTS))} from t group by 1"""

#: The trend by the whole kernel: a sweep renews one weight after another, each from all weights as they are then.
_TREND = f"""with recursive {BASE},
m as (select var_id, avg(value) as mean, var_samp(value) as var from d group by 1),
f as (select var_id, ln(mean) as lx, ln(var) as y from m where mean > 0 and var > 0),
p as (select row_number() over (order by var_id) as i, var_id, y, (lx - min(lx) over ()) / (max(lx) over () - min(lx) over ()) as x, count(*) over () as n from f),
k as (select a.i, any_value(a.y) as y, list(exp(-(a.x - b.x) * (a.x - b.x) / a.n) order by b.i) as line from p a cross join p b group by a.i),
e as materialized (select list(list_concat([cast(i as double), y], line) order by i) as lines, count(*) as n from k),
w as (select 0 as sweep, list_transform(range(n), lambda i: 0.0::double) as v from e union all
  select sweep + 1, list_reduce(lines, lambda v, l: list_concat(v[:cast(l[1] as bigint) - 1], [(l[2] - list_inner_product(l[3:], v) + v[cast(l[1] as bigint)]) / 2.0::double], v[cast(l[1] as bigint) + 1:]), v) from w, e where sweep < 100),
t as (select unnest(range(1, n + 1)) as i, unnest(list_transform(lines, lambda l: list_inner_product(l[3:], v))) as trend from w, e where sweep = 100),
u as (select var_id, mean, var, trend, y - trend as residual from m left join (p join t using (i)) using (var_id)),
z as (select *, coalesce((residual - avg(residual) over ()) / stddev_samp(residual) over (), 0) as standardized from u)
select var_id, {r('mean', 'means')}, {r('var', 'variances')}, {r('residual', 'residuals')}, {r('standardized', 'residuals_standardized')}, {r('trend', 'mean_variance_trend')},
       residual is not null and mean between 0.0125 and 3 and row_number() over (order by residual is not null desc, round(standardized, 9) desc, var_id) <= 200 as highly_variable from z"""

ORACLES: dict[str, str] = {
    "obs_nonzero_sum": _axis(_COUNT_SUM, "obs_id"),
    "var_nonzero_sum": _axis(_COUNT_SUM, "var_id"),
    "masked_nonzero_sum": _axis(_MASKED, "obs_id"),
    "masked_var_nonzero_sum": _axis(_MASKED.replace("small", "segment = 'BUILDING'"), "var_id"),
    "obs_nonzero": _axis("count(*) filter (value <> 0) as n", "obs_id"),
    "var_total": _axis(r("sum(value)", "total"), "var_id"),
    "obs_variance": _axis(r("var_samp(value)", "variance"), "obs_id"),
    "var_variance": _axis(r("var_samp(value)", "variance"), "var_id"),
    "obs_min_max": _axis(f"{r('min(value)', 'min')}, {r('max(value)', 'max')}", "obs_id"),
    "var_min_max": _axis(f"{r('min(value)', 'min')}, {r('max(value)', 'max')}", "var_id"),
    "obs_top_n": _top("obs_id"),
    "var_top_n": _top("var_id"),
    "obs_top_segment_proportions": _shares("obs_id"),
    "var_top_segment_proportions": _shares("var_id"),
    "qc_obs": _qc_obs(),
    "qc_var": _qc_var(),
    "qc_calculate_inplace": f"with q as ({_qc_obs()}) select q.*, c_mktsegment as segment from q join customer on c_custkey = obs_id",
    "qc_mitochondrial": _qc_obs().replace("counts_small", "counts_mito"),
    "filter_cells": _axis("count(*) filter (value <> 0) >= 10 and sum(value) <= 1500 and count(*) filter (value <> 0) / cast(count(*) as double) >= 0.01::double as keep", "obs_id"),
    "filter_genes": _axis("count(*) filter (value <> 0) >= 20 and sum(value) >= 500 and count(*) filter (value <> 0) / cast(count(*) as double) <= 0.5::double as keep", "var_id"),
    "select_obs": f"with {BASE} select obs_id, var_id, value from d where value <> 0 and segment = 'BUILDING'",
    "select_vars": f"with {BASE} select obs_id, var_id, value from d where value <> 0 and small",
    "select_slice": "select cast((rn - 3) // 7 as bigint) as position, obs_id from (select cast(c_custkey as bigint) as obs_id, row_number() over (order by c_custkey) - 1 as rn from customer) where rn >= 3 and (rn - 3) % 7 = 0",
    "select_list": "with v as (select cast(p_partkey as bigint) as var_id, row_number() over (order by p_partkey) - 1 as rn from part) select cast(position as bigint) as position, var_id from (values (0, 5), (1, 0), (2, 5), (3, 17)) w(position, rn) join v using (rn)",
    "densify_selected": f"""with {BASE},
o as (select obs_id, row_number() over (order by obs_id) - 1 as i from obs), v as (select var_id, row_number() over (order by var_id) - 1 as j from var),
w as (select * from (values (0, 4), (1, 0), (2, 4), (3, 9), (4, 150)) t(c, j) join v using (j))
select cast(i // 3 as bigint) as position, o.obs_id, string_agg(format('{{:.1f}}', d.value), ',' order by c) as "row" from o cross join w join d on d.obs_id = o.obs_id and d.var_id = w.var_id where i < 100 and i % 3 = 0 group by 1, 2""",
    "densify": f"with {BASE}, v as (select var_id, row_number() over (order by var_id) as j from var) select obs_id, count(*) as n, {r('sum(value)', 'total')}, {r('sum(value * j)', 'weighted')}, {r('sum(value * ((j - 1) * 7919 % 1009))', 'mixed')} from d join v using (var_id) group by obs_id",
    "feature_selection_full": "select cast(p_partkey as bigint) as var_id from part",
    "feature_selection_hvg": "select cast(p_partkey as bigint) as var_id from part where p_size <= 10",
    "feature_selection_random": "select cast(p_partkey as bigint) as var_id from part order by md5('42-' || cast(p_partkey as varchar)), p_partkey limit 50",
    "feature_selection_variance": f"with {BASE} select var_id from d group by var_id having var_samp(value) > 30",
    "normalize_row": f"with {BASE} select obs_id, var_id, {r('value * 10000.0::double / sum(value) over (partition by obs_id)', 'value')} from x",
    "normalize_col": f"with {BASE} select obs_id, var_id, {r('value * 10000.0::double / sum(value) over (partition by var_id)', 'value')} from x",
    "convert_to_single": f"with {BASE} select obs_id, var_id, {r('cast(value / 3.0::double as float)', 'value')} from x",
    "convert_array": f"""with {BASE},
o as (select obs_id, row_number() over (order by obs_id) - 1 as i from obs), v as (select var_id, row_number() over (order by var_id) - 1 as j from var)
select cast(i // 3 as bigint) as position, {', '.join(r(f'cast(max(value) filter (j = {j}) / 3.0::double as float)', f'c{i}') for i, j in enumerate((4, 0, 4, 9)))}
from o join d using (obs_id) join v using (var_id) where i < 100 and i % 3 = 0 group by 1""",
    "wide_frame": f"with {BASE} select var_id, {', '.join(r(f"coalesce(sum(value) filter (segment = '{g}'), 0)", g) for g in SEGMENTS)} from d group by var_id",
    "log1p": f"with {BASE} select obs_id, var_id, {r('ln(1 + value)', 'value')} from x",
    "hvg_seurat_cutoff": _HVG + "means > 0.0125 and means < 100 and coalesce(norm, 0) > 0.5 as highly_variable from z",
    "hvg_seurat_topn": _HVG + "norm is not null and rank() over (order by round(norm, 9) desc nulls last) <= 50 as highly_variable from z",
    "hvg_by_batch": _BATCHED,
    "hvg_equal_frequency_bins": f"{_MEANS}, b as (select *, ntile(7) over (order by round(means, 12), var_id) - 1 as bin from l) select var_id, {r('means', 'means')}, cast(bin as int) as bin from b",
    "hvg_dispatch": f"with q as ({_HVG} norm is not null and rank() over (order by round(norm, 9) desc nulls last) <= 50 as highly_variable from z) select q.*, p_name as var_name from q join part on p_partkey = var_id",
    "hvg_percentile": _percentile(20, "means > 0.3 and means < 6", "inside and norm > 0.5"),
    "hvg_percentile_topn": _percentile(7, "means > -1", "place <= 40"),
    "hvg_loess": _loess(0.5, "''", "norm > 1", "mean > 0.0125 and mean < 100 and norm > 1"),
    "hvg_loess_batches": _loess(0.3, "segment", "place < 60", "many > 0 and best <= 60"),
    "hvg_svr": _TREND,
    "pca_variance": _VARIANCE,
    "pca_scores": _SCORES,
    "pca_loadings": _LOADINGS,
    "pca_space_variance": _SPACE_VARIANCE,
    "pca_space_loadings": _SPACE_LOADINGS,
    "de_group_sums": f"{_GROUPED.format(base=BASE, of='d')} select grp as \"group\", var_id, {_SUMS} from k group by 1, 2",
    "de_logfc": f"""{_GROUPED.format(base=LOGGED, of='e')},
s as (select grp, var_id, avg(value) filter (mine) as a, avg(value) filter (not mine) as b from k group by 1, 2)
select grp as "group", var_id, {r('case when a = 0 and b = 0 then 0 else log2(exp(a)) + log2((1 - exp(-a) + exp(-a)) / exp(b)) end', 'logfoldchange')} from s""",
    "de_welch_stat": _stat("(a - b) / sqrt(v / n + w / m)", _WELCH_DF),
    "de_student_stat": _stat("(a - b) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1.0::double / n + 1.0::double / m))", "n + m - 2"),
    "de_welch_reference": _stat("(a - b) / sqrt(v / n + w / m)", _WELCH_DF, _REFERENCE),
    "de_some_groups": _stat("(a - b) / sqrt(v / n + w / m)", _WELCH_DF, _GROUPED.format(base=BASE, of="d").replace("distinct segment as grp from obs", "distinct segment as grp from obs where segment in ('MACHINERY', 'FURNITURE')")),
    "de_group_members": "select cast(c_custkey as bigint) as obs_id from customer where c_mktsegment = 'BUILDING'",
    "de_mannwhitney_exact": f"{_EXACT} select grp as \"group\", var_id, {r('u', 'u')}, {r('p', 'pval')} from tail",
    "de_mannwhitney_exact_reference": f"{_EXACT_REFERENCE} select grp as \"group\", var_id, {r('u', 'u')}, {r('p', 'pval')} from tail",
    "rank_gene_groups_exact": f"{_EXACT_RANKED} select grp as \"group\", p_name as gene, {r('score', 'score')}, {r('p', 'pval')}, {r('adj', 'pval_adj')} from f join part on p_partkey = var_id",
    "de_pvalues": _ranked(_WELCH_TESTED),
    "rank_gene_groups": _ranked(_MANN_WHITNEY_TESTED, 25),
    "rank_gene_groups_stored": _STORED,
    "de_mannwhitney_u": _ranks(_GROUPED.format(base=BASE, of="d"), "rest"),
    "de_mannwhitney_reference": _ranks(_REFERENCE, "pair"),
    "correct_bonferroni": f"with {_P} select family, test, round(p, 9) + 0.0::double as p, {r('least(1.0::double, m * p)', 'pval_adj', 9)} from o",
    "correct_bh": _adjusted(_BH).format(side=_ABOVE),
    "correct_by": _adjusted(_BH, _HARMONIC).format(side=_ABOVE),
    "correct_holm": _adjusted("max((b.m - b.i + 1) * b.p)").format(side=_BELOW),
    "correct_hochberg": _adjusted("min((b.m - b.i + 1) * b.p)").format(side=_ABOVE),
    "correct_storey": _adjusted(_BH, _PI0).format(side=_ABOVE),
    "correct_bonferroni_split": _together("m * p", "{}"),
    "correct_bh_split": _together("m * p / i", _FROM_END),
    "correct_by_split": _together("m * p / i", _FROM_END, "harmonic"),
    "correct_holm_split": _together("(m - i + 1) * p", "max({}) over (order by i rows between unbounded preceding and current row)"),
    "correct_hochberg_split": _together("(m - i + 1) * p", _FROM_END),
    "correct_storey_split": _together("m * p / i", _FROM_END, "least(1.0::double, above / (m * 0.5::double))"),
    "annotation_pivot": "select p_name as genesymbol, case when p_size > 5 then p_brand end as cell_type, '9606' as ncbi_tax_id from part where p_size <= 25",
    "network": "with p as (select distinct p_brand as source, p_name as target from part where p_brand is not null and p_name in (select p_name from part where p_size <= 25)) select source, target, 1.0::double as weight from p where source in (select source from p group by source having count(*) >= 2)",
}
