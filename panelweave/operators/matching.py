"""Propensity scores, full and nearest matching, weights and balance, for many specs at once.

`keys` names the columns of a spec; every function works on all specs in one go.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from panelweave.operators.prefix import TASK_ROWS, attach_group, largest_group, null_safe_join, private_keys, scan
from panelweave.session import cut_lineage

_STEP = StructType([StructField("beta", ArrayType(DoubleType())), StructField("move", DoubleType()), StructField("ok", BooleanType())])


@F.pandas_udf(_STEP)
def _newton(beta: pd.Series, info: pd.Series, score: pd.Series) -> pd.DataFrame:
    """One Newton step per spec on its (few-by-few) information matrix."""
    out, move, ok = [], [], []
    for b, i, s in zip(beta, info, score):
        b = np.asarray(b, float)
        a, r = np.asarray(i, float).reshape(len(b), len(b)), np.asarray(s, float)
        live = np.flatnonzero(np.diag(a) > 0)  # constant covariates were set to zero
        d = np.zeros_like(b)
        try:
            d[live] = np.linalg.solve(a[np.ix_(live, live)], r[live])
            good = bool(np.all(np.isfinite(d)))
        except np.linalg.LinAlgError:
            good = False
        out.append((b + d).tolist() if good else b.tolist())
        move.append(float(np.max(np.abs(d))) if good else 0.0)
        ok.append(good)
    return pd.DataFrame({"beta": out, "move": move, "ok": ok})


def propensity(df: DataFrame, keys: list[str], flag: str, covs: list[str], maxit: int = 25, tol: float = 1e-8) -> DataFrame:
    """Add `score` (fitted probability of `flag`), `score_ok` and `score_converged` from a logit per spec.

    Specs small enough for a task are fitted there, all in one pass; larger ones by Newton
    steps that are one grouped sum each. A spec that cannot be fitted keeps score_ok = false
    and a NULL score; one that still moves after `maxit` steps (separated arms) has scores but
    score_converged = false.
    """
    if not keys:
        return propensity(df.withColumn("__spec", F.lit(0)), ["__spec"], flag, covs, maxit, tol).drop("__spec")
    p = len(covs) + 1
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(covs)], *[F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(covs)]
    )
    stats = cut_lineage(stats)
    std = null_safe_join(df, stats, keys)
    for i, c in enumerate(covs):
        std = std.withColumn(f"__z{i}", F.when(F.col(f"__s{i}") > 0, (F.col(c) - F.col(f"__m{i}")) / F.col(f"__s{i}")).otherwise(0.0))
    std = std.drop("__n", *[f"__{t}{i}" for t in "ms" for i in range(len(covs))])
    z = [F.lit(1.0), *[F.col(f"__z{i}") for i in range(len(covs))]]
    lean = std.select(*keys, F.col(flag).cast("double").alias("__t"), *[f"__z{i}" for i in range(len(covs))])
    if (stats.agg(F.max("__n")).first()[0] or 0) <= TASK_ROWS:
        state = cut_lineage(_logit_blocks(lean, keys, p, maxit, tol))
    else:
        state = _logit_steps(lean, keys, z, maxit, tol)
    fit = state.select(*keys, F.col("beta").alias("__beta"), F.col("ok").alias("score_ok"), (F.col("ok") & F.col("conv")).alias("score_converged"))
    eta = reduce(lambda a, b: a + b, [z[i] * F.col("__beta")[i] for i in range(p)])
    out = null_safe_join(std, fit, keys).withColumn("score", F.when(F.col("score_ok"), 1 / (1 + F.exp(-eta))))
    return out.drop("__beta", *[f"__z{i}" for i in range(len(covs))])


def _logit_blocks(lean: DataFrame, keys: list[str], p: int, maxit: int, tol: float) -> DataFrame:
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in lean.select(*keys).schema.fields)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.column_stack([np.ones(len(pdf)), *[pdf[f"__z{i}"].to_numpy() for i in range(p - 1)]])
        t = pdf["__t"].to_numpy()
        use = ~np.isnan(z).any(axis=1) & ~np.isnan(t)
        z, t = z[use], t[use]
        keep = [j for j in range(p) if np.any(z[:, j] != 0)]  # constant covariates were set to zero
        beta, ok, conv = np.zeros(p), bool(len(t)) and 0 < t.mean() < 1, False
        for _ in range(maxit if ok else 0):
            mu = 1 / (1 + np.exp(-np.clip(z @ beta, -700, 700)))
            try:
                step = np.linalg.solve((z[:, keep] * (mu * (1 - mu))[:, None]).T @ z[:, keep], z[:, keep].T @ (t - mu))
            except np.linalg.LinAlgError:
                ok = False
                break
            beta[keep] += step
            if np.max(np.abs(step)) <= tol:
                conv = True
                break
        ok = ok and bool(np.all(np.isfinite(beta)))
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "beta": [beta.tolist()], "ok": [ok], "conv": [conv]})

    return lean.groupBy(*keys).applyInPandas(fit, f"{ddl}beta array<double>, ok boolean, conv boolean")


def _logit_steps(lean: DataFrame, keys: list[str], z: list[Column], maxit: int, tol: float) -> DataFrame:
    p = len(z)
    one_arm = lean.groupBy(*keys).agg((F.min("__t") < F.max("__t")).alias("ok"))
    state = one_arm.select(*keys, F.array(*[F.lit(0.0)] * p).alias("beta"), F.lit(1.0).alias("move"), "ok")
    state = cut_lineage(state)
    up = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(maxit):
        j = null_safe_join(lean, state.where(F.col("ok") & (F.col("move") > tol)).select(*keys, "beta"), keys)
        eta = reduce(lambda a, b: a + b, [z[i] * F.col("beta")[i] for i in range(p)])
        j = j.withColumn("__mu", 1 / (1 + F.exp(-eta)))
        v = F.col("__mu") * (1 - F.col("__mu"))
        sums = j.groupBy(*keys).agg(
            *[F.sum(v * z[a] * z[b]).alias(f"__i{a}_{b}") for a, b in up],
            *[F.sum((F.col("__t") - F.col("__mu")) * z[a]).alias(f"__u{a}") for a in range(p)],
        )
        sums = sums.select(
            *keys,
            F.array(*[F.col(f"__i{min(a, b)}_{max(a, b)}") for a in range(p) for b in range(p)]).alias("info"),
            F.array(*[F.col(f"__u{a}") for a in range(p)]).alias("score"),
        )
        nxt = null_safe_join(state, sums, keys, "left")
        moved = nxt.where(F.col("info").isNotNull()).select(*keys, _newton("beta", "info", "score").alias("__st")).select(*keys, "__st.beta", "__st.move", "__st.ok")
        kept = nxt.where(F.col("info").isNull()).select(*keys, "beta", "move", "ok")
        state = cut_lineage(moved.unionByName(kept))
        if state.where(F.col("ok") & (F.col("move") > tol)).isEmpty():
            break
    return state.withColumn("conv", F.col("move") <= tol)


# ---- full matching ---------------------------------------------------------------------


def cover_line(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest set of links covering all points of two sorted arrays, as star-shaped sets.

    In order the points form runs of one array and the other in turn. Links join neighbouring runs
    only: the last k points p of a run (size s) with the first i points q of the next, which costs

        sum (q_1 - p) + sum (q - q_1) + max(i - k, 0) (q_1 - p_s)

    The cheapest cover of everything up to q_i then follows from running minima over k, so time and
    space grow with the number of points. A point may be covered from both sides; links whose
    two ends are both covered otherwise are dropped, so every set has one end of degree one side.
    """
    if not len(a) or not len(b):
        return []
    at = np.concatenate([a, b])
    side = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    place = np.concatenate([np.arange(len(a)), np.arange(len(b))])
    order = np.lexsort((side, at))
    at, side, place = at[order], side[order], place[order]
    runs = np.split(np.arange(len(at)), np.flatnonzero(np.diff(side)) + 1)
    cost = np.concatenate([[0.0], np.full(len(runs[0]), np.inf)])  # cover of all before the run and of its first 0, 1, ... points
    taken = []
    for p, q in zip(runs, runs[1:]):
        x, y, s = at[p], at[q], len(p)
        # the last k points: everything before them is covered, or the first of them as well
        both = cost[1:] < cost[:-1]
        base = np.minimum(cost[:-1], cost[1:])[::-1] + np.cumsum((y[0] - x)[::-1])
        gap, i = y[0] - x[-1], np.arange(1, len(q) + 1)
        enough = np.minimum.accumulate(base[::-1])[::-1]  # k >= i
        few = np.minimum.accumulate(base - np.arange(1, s + 1) * gap)  # k < i
        by_enough = np.where(i <= s, enough[np.minimum(i, s) - 1], np.inf)
        by_few = np.where(i > 1, few[np.minimum(np.maximum(i - 1, 1), s) - 1] + i * gap, np.inf)
        taken.append((by_few < by_enough, base, both))
        cost = np.concatenate([[cost[-1]], np.minimum(by_enough, by_few) + np.cumsum(y - y[0])])
    links, run, i = [], len(runs) - 1, len(runs[-1])
    while run > 0:
        p, q = runs[run - 1], runs[run]
        if i == 0:  # all of this run is covered from the right, all before it without it
            run, i = run - 1, len(p)
            continue
        by_few, base, both = taken[run - 1]
        gap, s = at[q[0]] - at[p[-1]], len(p)
        if by_few[i - 1]:
            k = 1 + int(np.argmin((base - np.arange(1, s + 1) * gap)[: min(i - 1, s)]))
        else:
            k = i + int(np.argmin(base[i - 1 :]))
        for n in range(max(k, i)):  # the last points pair off, the rest go to the nearest end
            links.append((p[s - 1 - min(n, k - 1)], q[i - 1 - n] if n < i else q[0]) if k >= i else (p[s - k + min(n, k - 1)], q[n]))
        run, i = run - 1, s - k + int(both[s - k])
    deg, kept = np.bincount(np.array(links).ravel(), minlength=len(at)), []
    for p, q in sorted(links, key=lambda l: -abs(at[l[0]] - at[l[1]])):
        if deg[p] > 1 and deg[q] > 1:
            deg[p] -= 1
            deg[q] -= 1
        else:
            kept.append((place[p], place[q]) if side[p] == 0 else (place[q], place[p]))
    return [(int(x), int(y)) for x, y in kept]


@private_keys
def full_matching(df: DataFrame, keys: list[str], unit: str, flag: str, score: str = "score", bundle: int = 64) -> DataFrame:
    """Optimal full matching on the scalar score: (keys, unit, set_id), every unit in one set.

    A link of the optimum is never longer than the two nearest-opposite distances of its
    ends together. Running maxima and minima of `score +/- nearest` therefore show the gaps
    no link can cross; the line falls into independent stretches there and each stretch is
    solved alone. Specs lacking one of the arms give no rows.
    """
    d = df.where(F.col(score).isNotNull()).select(*keys, unit, F.col(flag).cast("boolean").alias("__t"), F.col(score).cast("double").alias("__s"))
    d = cut_lineage(d)
    size = largest_group(d, keys)
    t, s = F.col("__t"), F.col("__s")
    d = scan(
        d, keys, "__s", [unit],
        {
            "__pt": ("max", F.when(t, s), "upto"), "__pc": ("max", F.when(~t, s), "upto"),
            "__nt": ("min", F.when(t, s), "from"), "__nc": ("min", F.when(~t, s), "from"),
        },
        group_rows=size,
    )
    prev, nxt = F.when(t, F.col("__pc")).otherwise(F.col("__pt")), F.when(t, F.col("__nc")).otherwise(F.col("__nt"))
    d = d.withColumn("__nn", F.least(s - prev, nxt - s)).where(F.col("__nn").isNotNull())
    hi, lo = s + F.col("__nn"), s - F.col("__nn")
    # how far the rows before this one reach right, and this and later rows reach left
    d = scan(
        d, keys, "__s", [unit],
        {
            "__ht": ("max", F.when(t, hi), "before"), "__hc": ("max", F.when(~t, hi), "before"),
            "__lt": ("min", F.when(t, lo), "from"), "__lc": ("min", F.when(~t, lo), "from"),
        },
        group_rows=size,
    )
    big = F.lit(1e300)
    free = (F.coalesce("__ht", -big) < F.coalesce("__lc", big)) & (F.coalesce("__hc", -big) < F.coalesce("__lt", big))
    d = scan(d.withColumn("__cut", free.cast("int")), keys, "__s", [unit], {"stretch": ("sum", F.col("__cut"), "upto")}, group_rows=size)
    d = d.select(*keys, unit, "__t", "__s", "stretch", F.floor(F.col("stretch") / bundle).alias("__g"))
    unit_type = d.schema[unit].dataType.simpleString()
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*keys).schema.fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stretch", "__s", unit], kind="stable")
        frames = []
        for stretch, part in pdf.groupby("stretch", sort=False):
            tr, ct = part[part["__t"]], part[~part["__t"]]
            links = cover_line(tr["__s"].to_numpy(), ct["__s"].to_numpy())
            set_t, set_c = {}, {}
            for p, q in links:
                k = set_t.get(p, set_c.get(q, len(set_t) + len(set_c)))
                set_t[p] = set_c[q] = k
            name = lambda k: f"{stretch}-{k}"
            frames.append(pd.DataFrame({unit: tr[unit].to_numpy(), "set_id": [name(set_t[i]) for i in range(len(tr))]}))
            frames.append(pd.DataFrame({unit: ct[unit].to_numpy(), "set_id": [name(set_c[i]) for i in range(len(ct))]}))
        out = pd.concat(frames)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, unit, "set_id"]]

    return d.groupBy(*keys, "__g").applyInPandas(solve, f"{key_ddl}`{unit}` {unit_type}, set_id string")


# ---- nearest matching ------------------------------------------------------------------


def greedy_line(treated: np.ndarray, controls: np.ndarray, ratio: int) -> list[tuple[int, int, int]]:
    """Sequential greedy on one sorted spec: (treated, control, pass) positions.

    Free controls next to a position are found through skip links, which jump over taken ones.
    """
    n = len(controls)
    left, right = np.arange(-1, n + 1), np.arange(-1, n + 1)  # entry k + 1 belongs to control k

    def find(link: np.ndarray, k: int) -> int:
        root = k
        while 0 < root + 1 <= n and link[root + 1] != root:
            root = link[root + 1]
        while 0 < k + 1 <= n and link[k + 1] != k:
            link[k + 1], k = root, link[k + 1]
        return root

    out = []
    at = np.searchsorted(controls, treated, side="right")
    for no in range(1, ratio + 1):
        for t in range(len(treated) - 1, -1, -1):
            lo, hi = find(left, at[t] - 1), find(right, at[t])
            if lo < 0 and hi >= n:
                continue
            take = lo if hi >= n or (lo >= 0 and treated[t] - controls[lo] <= controls[hi] - treated[t]) else hi
            left[take + 1], right[take + 1] = take - 1, take + 1
            out.append((t, take, no))
    return out


@private_keys
def nearest_matching(df: DataFrame, keys: list[str], unit: str, flag: str, score: str = "score", ratio: int = 1) -> DataFrame:
    """Greedy nearest neighbour without replacement, treated served in descending score.

    Rows (keys, treated, control, pass_no); a run with ratio r is the passes 1..r. Specs small
    enough for a task are served one by one there; larger ones by rounds of proposals over
    the whole table, which end in the same pairs.
    """
    d = df.where(F.col(score).isNotNull()).select(*keys, F.col(unit).alias("u"), F.col(flag).cast("boolean").alias("t"), F.col(score).cast("double").alias("s"))
    d = cut_lineage(d)
    if largest_group(d, keys) > TASK_ROWS:
        return _proposal_rounds(d, keys, ratio)
    ut = d.schema["u"].dataType.simpleString()
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*keys).schema.fields)

    def serve(pdf: pd.DataFrame) -> pd.DataFrame:
        tr = pdf[pdf.t].sort_values(["s", "u"], ascending=[True, False])
        ct = pdf[~pdf.t].sort_values(["s", "u"])
        got = greedy_line(tr.s.to_numpy(), ct.s.to_numpy(), ratio)
        out = pd.DataFrame({"treated": [tr.u.iloc[i] for i, _, _ in got], "control": [ct.u.iloc[j] for _, j, _ in got], "pass_no": [p for _, _, p in got]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "treated", "control", "pass_no"]]

    return d.groupBy(*keys).applyInPandas(serve, f"{ddl}treated {ut}, control {ut}, pass_no int")


def _proposal_rounds(d: DataFrame, keys: list[str], ratio: int, max_rounds: int = 100_000) -> DataFrame:
    """In each round every unserved treated unit asks the nearer of the two controls at its left
    and right pointer; a control keeps the asker with the highest score and the others move
    their pointer on. As all controls rank the askers alike, the stable outcome is the
    sequential greedy one."""
    passes, used = [], None
    for no in range(1, ratio + 1):
        pool = d if used is None else _minus(d, used, keys)
        ranked = scan(pool, keys, "s", ["u"], {"k": ("sum", (~F.col("t")).cast("int"), "upto")})
        ranked = cut_lineage(ranked)
        ctrl = ranked.where(~F.col("t")).select(*keys, F.col("k"), F.col("u").alias("c"), F.col("s").alias("cs"))
        state = ranked.where("t").select(*keys, "u", "s", F.col("k").alias("l"), (F.col("k") + 1).alias("r"), F.lit(None).cast(ranked.schema["k"].dataType).alias("at"))
        cl = ctrl.select(*keys, F.col("k").alias("l"), F.col("cs").alias("ls"))
        cr = ctrl.select(*keys, F.col("k").alias("r"), F.col("cs").alias("rs"))
        for _ in range(max_rounds):
            ask = state.where(F.col("at").isNull())
            ask = null_safe_join(null_safe_join(ask, cl, [*keys, "l"], "left"), cr, [*keys, "r"], "left")
            dl, dr = F.col("s") - F.col("ls"), F.col("rs") - F.col("s")
            ask = ask.withColumn("want", F.when(F.col("ls").isNotNull() & (F.col("rs").isNull() | (dl <= dr)), F.col("l")).when(F.col("rs").isNotNull(), F.col("r"))).drop("ls", "rs")
            held = state.where(F.col("at").isNotNull()).withColumn("want", F.col("at"))
            both = held.unionByName(ask)
            win = both.where(F.col("want").isNotNull()).groupBy(*keys, "want").agg(F.min_by("u", F.struct((-F.col("s")).alias("a"), F.col("u").alias("b"))).alias("w"))
            j = null_safe_join(both, win, [*keys, "want"], "left")
            won = F.col("w") == F.col("u")
            lost = F.col("want").isNotNull() & ~won
            state = cut_lineage(
                j.select(
                    *keys, "u", "s",
                    F.when(lost & (F.col("want") == F.col("l")), F.col("l") - 1).otherwise(F.col("l")).alias("l"),
                    F.when(lost & (F.col("want") == F.col("r")), F.col("r") + 1).otherwise(F.col("r")).alias("r"),
                    F.when(won, F.col("want")).alias("at"),
                    lost.alias("again"),
                )
            )
            if state.where("again").isEmpty():
                break
            state = state.drop("again")
        else:
            raise RuntimeError("nearest matching did not settle")
        got = null_safe_join(
            state.where(F.col("at").isNotNull()).select(*keys, F.col("u").alias("treated"), F.col("at").alias("k")), ctrl, [*keys, "k"]
        ).select(*keys, "treated", F.col("c").alias("control"), F.lit(no).alias("pass_no"))
        passes.append(got)
        taken = got.select(*keys, F.col("control").alias("u"))
        used = taken if used is None else used.unionByName(taken)
    return reduce(lambda a, b: a.unionByName(b), passes)


def _minus(d: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    gone = used.withColumn("__gone", F.lit(True))
    return null_safe_join(d, gone, [*keys, "u"], "left").where(F.col("__gone").isNull()).drop("__gone")


def pair_sets(pairs: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Matched pairs to (keys, unit, set_id): one set per treated unit."""
    name = F.col("treated").cast("string").alias("set_id")
    return (
        pairs.select(*keys, F.col("treated").alias(unit), name).unionByName(pairs.select(*keys, F.col("control").alias(unit), name)).distinct()
    )


# ---- weights and balance ---------------------------------------------------------------


def match_weights(df: DataFrame, sets: DataFrame, keys: list[str], unit: str, flag: str) -> DataFrame:
    """Attach set_id and weights: treated 1, control n_t/n_c of its set, controls summing to their number."""
    d = null_safe_join(df, sets, [*keys, unit])
    t = F.col(flag).cast("boolean")
    per = d.groupBy(*keys, "set_id").agg(F.count_if(t).alias("__nt"), F.count_if(~t).alias("__nc"))
    raw = per.groupBy(*keys).agg(F.sum(F.when(F.col("__nc") > 0, F.col("__nt"))).alias("__raw"), F.sum(F.when(F.col("__nt") > 0, F.col("__nc"))).alias("__all"))
    # per set the raw control weights add up to n_t, so the total is a sum over sets
    d = attach_group(null_safe_join(d, per, [*keys, "set_id"]), raw, keys)
    w = F.when(t, 1.0).otherwise(F.col("__nt") / F.col("__nc") * F.col("__all") / F.col("__raw"))
    return d.withColumn("weights", w.cast("double")).drop("__nt", "__nc", "__raw", "__all")


def balance(df: DataFrame, keys: list[str], flag: str, covs: list[str], w: str | None = "weights") -> DataFrame:
    """Standardised mean difference per covariate: (mean_t - mean_c)/sd_t, controls weighted."""
    t = F.col(flag).cast("boolean")
    wt = F.col(w) if w else F.lit(1.0)
    aggs = []
    for i, c in enumerate(covs):
        x = F.col(c).cast("double")
        aggs += [
            F.avg(F.when(t, x)).alias(f"mt{i}"),
            F.stddev_samp(F.when(t, x)).alias(f"sd{i}"),
            F.try_divide(F.sum(F.when(~t, wt * x)), F.sum(F.when(~t & x.isNotNull(), wt))).alias(f"mc{i}"),
        ]
    g = df.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("covariate"),
                F.col(f"mt{i}").alias("mean_t"),
                F.col(f"mc{i}").alias("mean_c"),
                F.try_divide(F.col(f"mt{i}") - F.col(f"mc{i}"), F.col(f"sd{i}")).alias("smd"),
            )
            for i, c in enumerate(covs)
        ]
    )
    return g.select(*keys, F.inline(rows))


def balance_table(df: DataFrame, keys: list[str], flag: str, covs: list[str]) -> DataFrame:
    before = balance(df, keys, flag, covs, None).withColumnRenamed("smd", "smd_before").select(*keys, "covariate", "smd_before")
    after = balance(df, keys, flag, covs).withColumnRenamed("smd", "smd_after").select(*keys, "covariate", "smd_after")
    return null_safe_join(before, after, [*keys, "covariate"])


def score_histogram(df: DataFrame, keys: list[str], flag: str, score: str = "score", bins: int = 20) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(*keys, flag, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def same_group_share(df: DataFrame, keys: list[str], flag: str, country: str, order: str, w: str = "weights") -> DataFrame:
    """Controls whose country is that of the first treated unit of their set, plain and weighted."""
    t = F.col(flag).cast("boolean")
    rep = df.where(t).groupBy(*keys, "set_id").agg(F.min_by(country, order).alias("__tc"))
    c = null_safe_join(df.where(~t), rep, [*keys, "set_id"]).where(F.col("__tc").isNotNull())
    same = F.col(country) == F.col("__tc")
    return c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_control"),
        F.count_if(same).alias("n_same"),
        F.avg(same.cast("double")).alias("same_country_unweighted"),
        F.try_divide(F.sum(F.when(same, F.col(w)).otherwise(F.when(same.isNotNull(), 0.0))), F.sum(F.when(same.isNotNull(), F.col(w)))).alias("same_country_weighted"),
    )


def sampling_variances(df: DataFrame, keys: list[str], divisor: str | None = "weights") -> DataFrame:
    """vi_0, vi_1 = se^2/weight, pulled in at the 1% and 99% points of the spec."""
    from panelweave.operators.prefix import winsorise

    d = df
    for i in (0, 1):
        se2 = F.col(f"se_{i}") * F.col(f"se_{i}")
        d = d.withColumn(f"vi_{i}", se2 / F.col(divisor) if divisor else se2)
    return winsorise(d, ["vi_0", "vi_1"], keys)
