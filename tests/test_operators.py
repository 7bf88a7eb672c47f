"""Hand-sized cases of the scoring operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewake.functions import tails
from tidewake.operators import composition as D
from tidewake.operators import curves as C
from tidewake.operators import features as X
from tidewake.operators import intervals as G
from tidewake.operators import mass as M
from tidewake.operators import neighbours as K
from tidewake.operators import ordering
from tidewake.operators import paths as T
from tidewake.operators import preparation as P
from tidewake.sources import tables as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_mass_weights(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 3, -1000.0), ("b", 4, 0.0), ("c", 5, 7.0)], "g string, id int, log_mass double")
    assert [r.weight for r in M.mass_weights(d, ["g"]).orderBy("id").collect()] == pytest.approx([0.5, 0.5, 0, 1, 1])
    mixed = spark.createDataFrame([("a", 1, None), ("a", 2, 0.0)], "g string, id int, log_mass double")
    with pytest.raises(Exception, match="log mass"):
        M.mass_weights(mixed, ["g"]).collect()
    assert [r.weight for r in M.mass_weights(mixed, ["g"], on_missing="uniform").collect()] == [0.5, 0.5]


def test_weighted_median_takes_the_lower_value(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 0.0)], "v double, w double")
    assert M.weighted_median(d, [], "v", "w").first()[0] == 1.0


def test_knn_ties_blocks_and_small_references(spark):
    q = spark.createDataFrame([("s", 1, [0.0, 0.0]), ("t", 2, [1.0, 0.0])], "stage string, id long, x array<double>")
    r = spark.createDataFrame([("s", 12, [1.0, 0.0]), ("s", 11, [0.0, 1.0]), ("s", 13, [0.0, 0.0]), ("u", 14, [0.0, 0.0])], "stage string, id long, x array<double>")
    got = rows(K.knn_join(q, r, 2, ["stage"]).select("query_id", "rank", "ref_id", "distance"))
    assert got == [(1, 1, 13, 0.0), (1, 2, 11, 1.0)]
    assert K.knn_join(q, r, 9, ["stage"]).count() == 3


def test_knn_matches_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = sorted((i, int(j), r + 1) for i in range(60) for r, j in enumerate(np.lexsort((np.arange(60), dist[i]))[:5]))
    for block in (7, 1000):
        assert sorted((r.query_id, r.ref_id, r.rank) for r in K.knn_join(d, d, 5, block=block).collect()) == want


def test_radius_mass_counts_the_edge(spark):
    ref = spark.createDataFrame([(1, [0.0], 1.0), (2, [9.0], 1.0)], "id long, x array<double>, radius double")
    p = spark.createDataFrame([(1, [1.0], 0.25), (2, [1.1], 0.75)], "id long, x array<double>, weight double")
    assert rows(K.radius_mass(ref, p)) == [(1, 0.25), (2, 0.0)]


def test_jsd_ends(spark):
    p = spark.createDataFrame([("a", 1.0), ("Unknown", 0.5)], "label string, share double")
    o = spark.createDataFrame([("b", 1.0)], "label string, share double")
    same = D.jsd(D.compare_composition(p.selectExpr("1 AS m", "*"), p, ["m"], []).filter("label = 'a'"), ["m"]).first()
    assert same.jsd == 0 and same.similarity == 1
    apart = D.jsd(D.compare_composition(p.selectExpr("1 AS m", "*"), o, ["m"], []), ["m"]).first()
    assert apart.jsd == pytest.approx(1)


def test_sinkhorn():
    x = np.random.default_rng(0).normal(size=(20, 2))
    w = np.ones(20)
    assert D.sinkhorn(x, w, x, w, 0.1) == pytest.approx(0, abs=1e-9)
    assert math.sqrt(2 * D.sinkhorn([[0.0, 0.0]], [1], [[3.0, 4.0]], [1], 0.05)) == pytest.approx(5, rel=1e-6)


def test_sliced_w2_of_unequal_clouds(spark):
    a = spark.createDataFrame([(1, [0.0], 1.0), (1, [1.0], 1.0), (1, [99.0], 0.0)], "g int, x array<double>, weight double")
    b = spark.createDataFrame([(1, [0.0], 1.0), (1, [1.0], 1.0), (1, [2.0], 1.0)], "g int, x array<double>, weight double")
    u = spark.createDataFrame([(0, [1.0])], "direction int, u array<double>")
    # mass thirds: 0-0, then 0-1 for a sixth, 1-1 for a sixth, 1-2 for a third
    assert D.sliced_w2(a, b, u, ["g"]).first().w2 == pytest.approx(math.sqrt(1 / 6 + 1 / 3))


def test_decomposition_closes(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([tuple(map(float, v)) for v in rng.random((50, 4))], "w0 double, w1 double, p0 double, p1 double").selectExpr("1 AS g", "*")
    assert abs(T.soft_mass_decomposition(d, ["g"]).first().closure) < 1e-9


def test_bh_fdr_nulls_and_ties(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.04), (4, None), (5, 0.5)], "k int, p double").selectExpr("1 AS g", "*")
    q = {r.k: r.q for r in X.bh_fdr(d, ["g"], "p").collect()}
    assert q[4] is None and q[1] == pytest.approx(0.04) and q[2] == q[3] == pytest.approx(0.16 / 3) and q[5] == pytest.approx(0.5)


def test_running_totals_match_a_sort(spark):
    rng = np.random.default_rng(3)
    odd = [0.0, -1.5, -1e-300, 1e300, 5e-324, float("inf"), float("-inf"), float("nan")]
    values = {None: [*odd, *rng.normal(size=200)], "near": list(1000 + 1e-9 * rng.permutation(300)), "p": list(10.0 ** -rng.uniform(0, 40, 300)), "one": [2.0]}
    rows = [(g, float(v), int(rng.integers(1, 9))) for g, x in values.items() for v in x]
    d = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(r.g, repr(r.v)): (r.n_upto, r.n_all) for r in ordering.running_totals(d, ["g"], "v", ["n"]).collect()}
    for g in values:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (math.isnan(r[1]), r[1]))
        upto = np.cumsum([r[2] for r in own])
        assert [got[g, repr(r[1])] for r in own] == [(int(u), int(upto[-1])) for u in upto]
    assert len(got) == len(rows)
    # a crowded group is not left in one cell
    assert ordering.in_cells(d, ["g"], "v").filter("g = 'near'").select("_cell").distinct().count() > 100
    assert ordering.running_totals(d.filter("n < 0"), [], "v", ["n"]).count() == 0


def test_bh_fdr_of_one_group_matches_numpy(spark):
    p = np.round(np.random.default_rng(4).random(500) ** 4, 3)
    d = spark.createDataFrame(list(enumerate(map(float, p))), "k int, p double")
    order = np.argsort(-p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(p[order] * len(p) / np.array([(p <= x).sum() for x in p[order]])))
    got = {r.k: r.q for r in X.bh_fdr(d, [], "p").collect()}
    assert [got[k] for k in range(len(p))] == pytest.approx(list(want))


def test_auroc_and_average_precision(spark):
    d = spark.createDataFrame([(1.0, True), (1.0, False), (1.0, False)], "s double, y boolean").selectExpr("1 AS g", "*")
    assert X.auroc(d, ["g"], "s", "y").first().auroc == 0.5
    assert X.average_precision(d, ["g"], "s", "y").first().average_precision == pytest.approx(1 / 3)


def test_tails():
    assert tails.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.t_tail(1.0, 1) == pytest.approx(0.5)
    assert tails.hypergeometric_tail(0, 5, 6, 20) == pytest.approx(1)


def test_partial_spearman_without_covariates_is_spearman(spark):
    d = spark.createDataFrame([(1, float(i), float(i * i), float(i % 2)) for i in range(20)], "g int, y double, f double, c double")
    r = X.partial_spearman(d, ["g"], "y", ["f"], ["c"]).first()
    assert r.rho == pytest.approx(1) and r.n == 20


def test_partial_spearman_is_the_correlation_of_residuals(spark):
    rng = np.random.default_rng(2)
    c, e = rng.integers(0, 9, 80).astype(float), rng.normal(size=80)
    y, v = np.round(c + rng.normal(size=80), 1), np.round(2 * c - e + rng.normal(size=80), 1)
    d = spark.createDataFrame([("g", *map(float, r)) for r in zip(y, v, c, e)], "g string, y double, v double, c double, e double")
    rank = lambda x: np.array([(x < t).sum() + ((x == t).sum() + 1) / 2 for t in x])
    design = np.column_stack([np.ones(80), c, e])
    a, b = (rank(x) - design @ np.linalg.lstsq(design, rank(x), rcond=None)[0] for x in (y, v))
    got = X.partial_spearman(d, ["g"], "y", ["v"], ["c", "e"]).first()
    assert got.n == 80 and got.rho == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_calibrate_logit_meets_its_own_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    y = (x + rng.normal(size=200) > 0.7).astype(int)
    t = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    p = np.array([r.p for r in X.calibrate_logit(t, t, "x", "y").orderBy("x").collect()])
    order = np.argsort(x)
    x, y = x[order], y[order]
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    slope = (np.log(p / (1 - p))[-1] - np.log(p / (1 - p))[0]) / (x[-1] - x[0])
    assert abs((w * (p - y)).sum()) < 1e-3 and abs((w * (p - y) * x).sum() + slope) < 1e-3  # the gradient, with C = 1


def test_bootstrap_brackets_the_mean(spark):
    v = np.random.default_rng(6).normal(3, 2, 400)
    got = X.bootstrap_ci(spark.createDataFrame([("g", i, float(t)) for i, t in enumerate(v)], "g string, i int, v double"), ["g"], "v", "i").first()
    half = 1.96 * v.std() / 20
    assert got.estimate == pytest.approx(v.mean()) and got.low == pytest.approx(v.mean() - half, abs=0.08) and got.high == pytest.approx(v.mean() + half, abs=0.08)


def test_microclusters_keep_mass_and_centre(spark):
    x = np.random.default_rng(7).normal(size=(300, 3))
    w = np.arange(1.0, 301.0)
    d = spark.createDataFrame([("g", r.tolist(), float(t)) for r, t in zip(x, w)], "g string, x array<double>, weight double")
    for k in (8, 400):
        got = D.microclusters(d, ["g"], k).collect()
        weight, centre = np.array([r.weight for r in got]), np.array([r.x for r in got])
        assert len(got) == min(k, 300) and weight.sum() == pytest.approx(1)
        assert weight @ centre == pytest.approx(w @ x / w.sum())


def test_rand_index_counts_pairs(spark):
    a, b = [0, 0, 1, 1, 2, 2, 2, 0], [1, 1, 0, 0, 0, 2, 2, 1]
    side = lambda v: spark.createDataFrame([("g", i, t) for i, t in enumerate(v)], "g string, id int, substate int")
    pairs = [(i, j) for i in range(8) for j in range(i)]
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    sa, sb = (sum(v[i] == v[j] for i, j in pairs) for v in (a, b))
    expected = sa * sb / len(pairs)
    assert T.rand_index(side(a), side(b), ["g"]).first().ari == pytest.approx((both - expected) / ((sa + sb) / 2 - expected))


def test_match_negatives_is_greedy_without_reuse(spark):
    rng = np.random.default_rng(8)
    p, n = rng.integers(1, 50, (6, 2)), rng.integers(1, 50, (60, 2))
    frame = lambda m, at: spark.createDataFrame([("g", at + i, int(r[0]), int(r[1])) for i, r in enumerate(m)], "g string, id long, a int, b int")
    got = {}
    for r in K.match_negatives(frame(p, 0), frame(n, 100), ["a", "b"], 3, ["g"]).collect():
        got.setdefault(r.query_id, set()).add(r.ref_id)
    z = np.log1p(np.vstack([p, n]).astype(float))
    z = (z - z.mean(0)) / z.std(0)
    used = set()
    for i in range(6):
        near = [int(j) for j in np.lexsort((np.arange(60), ((z[6:] - z[i]) ** 2).sum(1))) if int(j) not in used][:3]
        used |= set(near)
        assert got[i] == {100 + j for j in near}


def test_savgol_third_derivative():
    t = np.arange(15.0)
    assert (C.savgol(15, 9, 4, 3) @ (t**3 / 6)) == pytest.approx(np.ones(15))


def test_intervals_touching_and_spanning_bins(spark):
    kind = "peak int, chrom string, start long, end long"
    q = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 5, 9000), (3, "d", 0, 5)], kind)
    r = spark.createDataFrame([(7, "c", 10, 20), (8, "c", 4000, 8000)], kind.replace("peak", "gene"))
    got = rows(G.overlap_join(q, r, ["peak"]).select("peak", "r_gene", "overlap_bp"))
    assert got == [(1, None, 0), (2, 7, 10), (2, 8, 4000), (3, None, 0)]


def test_leave_one_out_ignores_held_out_rows(spark):
    kind = "id int, time double, x double"
    good = [(1, 0.0, 1.0), (2, 1.0, 2.0), (3, 2.0, 3.0), (4, 2.5, 4.0)]
    bad = [(i, t, float("nan") if t == 1.0 else x) for i, t, x in good] + [(9, 1.0, 1e20)]
    a, b = (P.leave_one_time_out(spark.createDataFrame(v, kind), 1.0) for v in (good, bad))
    assert rows(a["train"]) == rows(b["train"])
    assert a["heldout"].first()["rank"] == pytest.approx(0.5)
    with pytest.raises(Exception, match="between"):
        P.leave_one_time_out(spark.createDataFrame(good, kind), 0.0)["heldout"].collect()


def test_interpolation(spark):
    t = spark.createDataFrame([(1, 0.0, [0.0]), (1, 1.0, [2.0]), (1, 3.0, [6.0])], "p int, t double, x array<double>")
    q = spark.createDataFrame([(-1.0,), (0.5,), (1.0,), (2.0,), (5.0,)], "q double")
    assert [r.x[0] for r in P.interpolate_at(t, q, ["p"]).orderBy("q").collect()] == [0, 1, 2, 4, 6]


def test_log_before_any_stage(spark):
    lines = spark.createDataFrame([("f", 1, "iter 1 loss 2e-3"), ("f", 2, "Stage: a"), ("f", 3, "iter 2 loss 1.5 best avg 0.25")], "file string, line_no long, line string")
    assert rows(S.parse_training_log(lines)) == [("f", 1, None, 1, 0.002, None), ("f", 3, "a", 3, 1.5, 0.25)]


def test_peak_names(spark):
    d = spark.createDataFrame([("chr1:10-13",), ("x",)], "p string")
    assert rows(S.parse_peak(d, "p").select("chrom", "start", "end", "midpoint")) == [("chr1", 10, 13, 12)]


def test_read_gtf_of_a_packed_file(spark, tmp_path):
    import gzip

    path = str(tmp_path / "a.gtf.gz")
    with gzip.open(path, "wt") as out:
        out.write("#!genome\n")
        for chrom, kind, lo, hi, strand, extra in (("chr1", "gene", 101, 200, "+", 'gene_name "A"; '), ("2", "gene", 301, 450, "-", 'gene_name "B"; '), ("2", "gene", 501, 550, "-", ""), ("chr1", "transcript", 101, 190, "+", 'gene_name "A"; transcript_id "T1"; transcript_type "coding"; '), ("chr1", "transcript", 105, 190, "+", 'gene_name "A"; transcript_id "T1"; transcript_type "coding"; '), ("chr1", "exon", 101, 120, "+", 'gene_name "A"; ')):
            out.write(f'{chrom}\tx\t{kind}\t{lo}\t{hi}\t.\t{strand}\t.\tgene_id "g{lo}"; {extra}gene_type "{'u' if lo == 301 else 't'}";\n')
    found = {r.gene_id: r for r in S.read_gtf(spark, path).collect()}
    assert set(found) == {"g101", "g301"} and (found["g101"].gene, found["g101"].chrom, found["g101"].tss) == ("A", "chr1", 101)
    assert (found["g301"].chrom, found["g301"].tss) == ("chr2", 450)
    assert {r.gene_id for r in S.read_gtf(spark, path, gene_types=["u"]).collect()} == {"g301"}
    tx = S.read_gtf(spark, path, "zero_both", "transcript").collect()
    assert [(r.gene, r.transcript_id, r.transcript_type, r.start, r.tss) for r in tx] == [("A", "T1", "coding", 100, 100)]


def test_savgol_keeps_polynomials():
    t = np.arange(9.0)
    assert C.savgol(9, 5, 2, 0) @ (t**2) == pytest.approx(t**2)
    assert C.savgol(9, 5, 2, 1) @ (t**2) == pytest.approx(2 * t)


def test_flat_curve_has_no_lag_score(spark):
    c = spark.createDataFrame([("a", [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 4.0, 3.0]), ("b", [0.0, 1.0, 2.0, 3.0], [1.0] * 4)], "id string, t array<double>, v array<double>")
    r = C.lag_score(spark.createDataFrame([("a", "b")], "a_id string, b_id string"), c).first()
    assert r.score is None


def test_write_refuses_to_overwrite(spark, tmp_path):
    S.write_table(spark.range(2), str(tmp_path / "t"))
    with pytest.raises(Exception):
        S.write_table(spark.range(2), str(tmp_path / "t"))
    assert S.read_table(spark, str(tmp_path / "t"), required=["id"]).count() == 2


def test_ranked_and_standardized_match_pandas(spark):
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"i": range(3000), "g": rng.integers(0, 3, 3000), "v": np.round(rng.normal(size=3000), 2)})
    x.loc[::17, "v"] = np.nan
    x.loc[x["g"] == 2, "v"] = 4.0  # a flat group
    df = spark.createDataFrame(x).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = ordering.standardized(ordering.ranked(df, ["g"], "v", "r", "n"), ["g"], "v", "z", 0.0).toPandas().sort_values("i").reset_index()
    by = x.groupby("g")["v"]
    assert np.allclose(got["r"], by.rank(), equal_nan=True)
    assert (got["n"][got["v"].notna()] == by.transform("count")[x["v"].notna()]).all()
    z = (x["v"] - by.transform("mean")) / by.transform(lambda v: v.std(ddof=0)).replace(0, np.nan)
    assert np.allclose(got["z"].dropna(), z.where(x["g"] != 2, 0.0)[x["v"].notna() | (x["g"] == 2)].dropna(), atol=1e-9)


def test_quantiles_and_places_match_numpy(spark):
    rng = np.random.default_rng(9)
    v, g = np.round(rng.normal(size=2000), 2) * 10.0 ** rng.integers(-3, 4, 2000), rng.integers(0, 2, 2000)
    df = spark.createDataFrame([*[(int(b), i, float(a)) for i, (a, b) in enumerate(zip(v, g))], (0, -1, None), (2, -2, None)], "g int, i int, v double")
    got = {r["g"]: r for r in ordering.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == {0, 1}
    for b, r in got.items():
        assert np.allclose([*r[1:]], np.quantile(v[g == b], [0, 0.31, 0.5, 1]), rtol=1e-12)
    places = {r["i"]: r["k"] for r in ordering.numbered(df, ["g"], "v", ["i"], "k").collect()}
    assert places.pop(-1) is None and places.pop(-2) is None
    for b in (0, 1):
        assert [places[i] for i in sorted(np.flatnonzero(g == b), key=lambda i: (v[i], i))] == list(range(1, (g == b).sum() + 1))


def test_weighted_covariance_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x, w, g = rng.normal(size=(200, 3)), rng.random(200) + 0.1, rng.integers(0, 2, 200)
    rows = [(int(a), [float(t) for t in b], float(c)) for a, b, c in zip(g, x, w)]
    df = spark.createDataFrame([*rows, (0, None, 1.0), (1, [0.0, 0.0, 0.0], None)], "g int, x array<double>, w double").repartition(7)
    for by in ([], ["g"]):
        for r in M.weighted_covariance(df, by, "x", "w").collect():
            keep = slice(None) if not by else g == r["g"]
            want = np.cov(x[keep].T, aweights=w[keep], ddof=0)
            assert abs(r["cov"] - want[r["i"], r["j"]]) < 1e-9


def test_link_correlation_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4, 37))
    v[3] = 2.0  # flat
    a = spark.createDataFrame([(i, u, float(v[i, u])) for i in range(2) for u in range(37)], "id int, unit int, value double")
    b = spark.createDataFrame([(i, u, float(v[i, u])) for i in (2, 3) for u in range(37)], "id int, unit int, value double")
    pairs = spark.createDataFrame([(0, 2), (1, 2), (0, 3)], "a_id int, b_id int")
    whole = {(r["a_id"], r["b_id"]): r for r in X.link_correlation(a, b, pairs, 9).collect()}
    monkeypatch.setattr(X, "BLOCK", 5)
    cut = {(r["a_id"], r["b_id"]): r for r in X.link_correlation(a, b, pairs, 9).collect()}
    for i in (0, 1):
        r = np.corrcoef(v[i], v[2])[0, 1]
        for got in (whole[i, 2], cut[i, 2]):
            assert abs(got["r"] - r) < 1e-9 and got["n"] == 37
            assert abs(got["p"] - tails.t_tail(r * np.sqrt(35 / (1 - r * r)), 35)) < 1e-9
        assert abs(whole[i, 2]["null_sd"] - cut[i, 2]["null_sd"]) < 1e-9 and whole[i, 2]["null_sd"] > 0.01
    assert whole[0, 3]["r"] is None and whole[0, 3]["p"] is None


def test_nearest_genes_over_blocks(spark):
    rng = np.random.default_rng(8)
    tss = [(g, int(c), int(t)) for g, (c, t) in enumerate(zip(rng.integers(0, 2, 40), rng.integers(0, 60, 40) * 10))] + [(99, 7, 5)]
    at = [(p, int(c), int(t), int(t) + 4) for p, (c, t) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 600, 60)))] + [(60, 7, 1, 9)]
    links = [(g, p) for p, c, *_ in at for g, d, _ in tss if c == d][::7] + [(99, 60)]
    genes = spark.createDataFrame(tss, "gene int, chrom int, tss int")
    peaks = spark.createDataFrame(at, "peak int, chrom int, start int, end int")
    got = G.nearest_genes(spark.createDataFrame(links, "gene int, peak int"), genes, peaks, 50).collect()
    assert len(got) == len(links)
    for r in got:
        _, chrom, low, high = at[r["peak"]]
        order = sorted((abs(round((low + high) / 2) - t), g) for g, c, t in tss if c == chrom)
        assert r["nearest_gene"] == order[0][1]
        assert r["nearest_other_gene"] == next((g for _, g in order if g != r["gene"]), None)


def test_pairs_of_few_scores(spark):
    scores = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 0, 0.9), (1, 1, 0.5), (2, 0, 0.3), (2, 1, None)], "a_id int, b_id int, score double")
    observed = spark.createDataFrame([(0, 0), (1, 1)], "a_id int, b_id int")
    p = {r["a_id"]: (r["p"], r["q"]) for r in C.pair_significance(scores, observed).collect()}
    assert p == {0: (0.5, 0.5), 1: (0.5, 0.5)}
    r = C.mann_whitney(scores, observed).first()
    assert (r["n"], r["m"], r["u"]) == (2, 3, 4.5)  # 0.9 ties once


def test_repeated_distance_takes_whole_small_clouds(spark):
    a = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id int, x array<double>")
    b = spark.createDataFrame([(i, [float(i) + 3.0, 0.0]) for i in range(5)], "id int, x array<double>")
    r = D.repeated_distance(a, b, [], 50, 3, blur=0.01).first()
    assert abs(r["mean"] - 3.0) < 0.05 and r["sd"] < 1e-9 and r["q025"] == r["q975"]


def test_total_time_distance(spark):
    d = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (0, 2, 4.0)], "stage int, next_stage int, w2 double")
    assert D.total_time_distance(d).first()[:] == (5.0, 4.0)
    assert D.total_time_distance(d.limit(1)).first()[:] == (2.0, 2.0)


def test_entry_imports_and_lists():
    import __spark_entry__ as e

    names = e.queries()
    assert "composition_jsd" in names and set(e.oracle_sql()) <= set(names)


def _shuffled_pairs(df):
    """Exchanges of the plan above its join."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text.split("Join")[0].count("Aggregate")


def test_cis_links_deal_out_no_pairs(spark):
    g = spark.createDataFrame([(1, 0, 5000), (2, 0, 5200), (2, 0, 5200)], "gene long, chrom long, tss long")
    p = spark.createDataFrame([(7, 0, 5000, 5101), (8, 0, 6990, 7011), (8, 0, 6990, 7011), (9, 1, 5000, 5101)], "peak long, chrom long, start long, end long")
    want = [(1, 7, 50, "promoter"), (1, 8, 2000, "distal"), (2, 7, -150, "distal"), (2, 8, 1800, "distal")]
    d = G.cis_links(g, p, 2000, 100)
    assert rows(d) == want and _shuffled_pairs(d) == 0
    # a gene and a peak with two places each, at one distance, are one link
    g = g.unionByName(spark.createDataFrame([(1, 1, 5000)], "gene long, chrom long, tss long"))
    p = p.unionByName(spark.createDataFrame([(7, 1, 5000, 5101)], "peak long, chrom long, start long, end long"))
    assert rows(G.cis_links(g, p, 2000, 100)) == sorted([*want, (1, 9, 50, "promoter")])


def test_classified_links_may_carry_their_bounds(spark):
    g = spark.createDataFrame([(1, 0, 5000, 5090, 5000), (2, 0, 5200, 5300, 5200)], "gene long, chrom long, start long, end long, tss long")
    p = spark.createDataFrame([(7, 0, 5000, 5101), (8, 0, 6990, 7011)], "peak long, chrom long, start long, end long")
    carried = G.cis_links(g.selectExpr("*", "start AS gene_start", "end AS gene_end"), p.selectExpr("*", "start AS peak_start", "end AS peak_end"), 2000, 100, ["gene_start", "gene_end", "peak_start", "peak_end"])
    got = G.classify_links(carried, distal=150).select("gene", "peak", "distance", "class", "in_body", "strict_distal")
    assert rows(got) == rows(G.classify_links(G.cis_links(g, p, 2000, 100), g, p, 150).select(*got.columns)) and len(rows(got)) == 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_nearest_genes_come_with_the_links(spark):
    rng = np.random.default_rng(4)
    g = spark.createDataFrame([(i, int(rng.integers(2)), int(rng.integers(60_000) // 7 * 7)) for i in range(90)], "gene long, chrom long, tss long").cache()
    p = spark.createDataFrame([(i, int(rng.integers(3)), int(s), int(s + rng.integers(1, 300))) for i, s in enumerate(rng.integers(0, 60_000, 120))], "peak long, chrom long, start long, end long").cache()
    d = G.nearest_genes_of_links(g, p, 2000)
    assert rows(d) == rows(G.nearest_genes(G.cis_links(g, p, 2000), g, p)) and len(rows(d)) > 100
    at, places = {r.peak: (r.chrom, round((r.start + r.end) / 2)) for r in p.collect()}, g.collect()
    for gene, peak, first, other in rows(d):
        near = [x.gene for x in sorted(places, key=lambda x: (abs(x.tss - at[peak][1]), x.gene)) if x.chrom == at[peak][0]]
        assert (first, other) == (near[0], next((x for x in near if x != gene), None))


def test_top_links_are_cut_before_they_are_dealt_out(spark):
    links = spark.range(6000).selectExpr("id div 2000 AS gene", "id AS peak", "CAST(id * 37 % 1999 AS DOUBLE) AS score", "true AS significant")
    got = G._first_of_batches(links.select("gene", "peak", "score"), "gene", {"score": False, "peak": True}, 2)
    assert got.count() < 200
    g = spark.createDataFrame([(i, 0, 10) for i in range(3)], "gene long, chrom long, tss long")
    p = spark.createDataFrame([(1, 0, 1, 2)], "peak long, chrom long, start long, end long")
    best = {(r.gene, r["rank"]): r.peak for r in G.top_links_per_gene(links, g, p, 2, 2).collect()}
    every = {k: sorted(range(2000 * k, 2000 * k + 2000), key=lambda i: (-(i * 37 % 1999), i)) for k in range(3)}
    assert best == {(k, i + 1): every[k][i] for k in range(3) for i in range(2)}


def test_evidence_of_a_gene_is_not_dealt_out(spark):
    rng = np.random.default_rng(9)
    g = [(i, int(rng.integers(2)), int(rng.integers(0, 20_000))) for i in range(30)]
    p = [(i, int(rng.integers(2)), int(s), int(s + 101), None if i % 9 == 0 else float(i % 7)) for i, s in enumerate(rng.integers(0, 20_000, 90))]
    genes, da = spark.createDataFrame(g, "gene long, chrom long, tss long"), spark.createDataFrame(p, "peak long, chrom long, start long, end long, effect double")
    got = {r.gene: (r.n, r.peaks, r.median_effect) for r in G.locus_evidence(genes, da, 700).collect()}
    for gene, chrom, tss in g:
        mine = [x for x in p if x[1] == chrom and abs((x[2] + x[3]) / 2 - tss) <= 700]
        known = [x[4] for x in mine if x[4] is not None]
        assert got[gene] == (len(mine), ";".join(str(x[0]) for x in mine), pytest.approx(float(np.median(known))) if known else None)
    at = da.selectExpr("peak", "effect", "chrom", "(start + end) * 0.5D AS _c")
    by_link = rows(G._evidence_by_link(genes, at, 700).select("gene", "n", "peaks", "median_effect"))
    assert rows(G._evidence_by_place(genes, at, 700).filter("n > 0").select("gene", "n", "peaks", "median_effect")) == by_link
