"""Grid search against brute force: scattered points, dense towns, poles, date line, ties."""

import math
import random

import pytest

from marketreach.functions.numeric import EARTH_RADIUS_KM
from marketreach.operators.indirect import allocate
from marketreach.operators.nearest import nearest_site


def km(a, b):
    (la1, lo1), (la2, lo2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))


def brute(points, sites):
    best = {}
    for p in set(points):
        d = [(km(p, (la, lo)), i) for i, la, lo in sites]
        low = min(d)[0]
        best[p] = (low, min(i for x, i in d if x <= low + 1e-9))
    return best


def scattered(rng, n):
    return [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]


def town(rng, n, at=(-23.5, -46.6), spread=0.02):
    return [(at[0] + rng.gauss(0, spread), at[1] + rng.gauss(0, spread)) for _ in range(n)]


def check(spark, points, sites, leaf):
    p = spark.createDataFrame(points, "lat double, lon double")
    s = spark.createDataFrame(sites, "cnpj string, lat double, lon double")
    got = {(r.lat, r.lon): r for r in nearest_site(p, s, "cnpj", leaf=leaf).collect()}
    want = brute(points, sites)
    assert set(got) == set(want)
    for point, (dist, site) in want.items():
        assert abs(got[point].dist_km - dist) < 1e-6
        assert got[point].cnpj == site


@pytest.mark.parametrize("leaf", [1, 8, 1000])
def test_against_brute_force(spark, leaf):
    rng = random.Random(leaf)
    points = scattered(rng, 60) + town(rng, 60) + [(89.9, 10.0), (-89.9, 100.0), (0.0, 179.99), (0.0, -179.99)]
    places = scattered(rng, 25) + town(rng, 40) + [(0.1, 179.9), (0.1, -179.9), (90.0, 0.0), (-90.0, 0.0)]
    check(spark, points, [(f"{i:03d}", la, lo) for i, (la, lo) in enumerate(places)], leaf)


@pytest.mark.parametrize("leaf", [1, 8, 1000])
def test_chosen_sites_in_the_same_descent(spark, leaf):
    rng = random.Random(leaf + 1)
    points = scattered(rng, 50) + town(rng, 50) + [(89.9, 10.0), (0.0, 179.99)]
    places = scattered(rng, 25) + town(rng, 40) + [(0.1, 179.9), (0.1, -179.9), (90.0, 0.0)]
    sites = [(f"{i:03d}", la, lo, None if i % 7 == 0 else i % 5 == 0) for i, (la, lo) in enumerate(places)]
    p = spark.createDataFrame(points, "lat double, lon double")
    s = spark.createDataFrame(sites, "cnpj string, lat double, lon double, ours boolean")
    got = {(r.lat, r.lon): r for r in nearest_site(p, s, "cnpj", leaf=leaf, chosen="ours").collect()}
    every = brute(points, [x[:3] for x in sites])
    chosen = brute(points, [x[:3] for x in sites if x[3]])
    assert set(got) == set(every)
    for point, r in got.items():
        assert (r.cnpj, r.cnpj_chosen) == (every[point][1], chosen[point][1])
        assert abs(r.dist_km - every[point][0]) < 1e-6 and abs(r.dist_km_chosen - chosen[point][0]) < 1e-6
    none = nearest_site(p, s.withColumn("ours", s.ours & False), "cnpj", leaf=leaf, chosen="ours").collect()
    assert {(r.lat, r.lon): r.cnpj for r in none} == {k: v[1] for k, v in every.items()}
    assert all(r.cnpj_chosen is None and r.dist_km_chosen is None for r in none)


def test_allocation_descends_once(spark, monkeypatch):
    from marketreach.operators import indirect

    calls = []
    monkeypatch.setattr(indirect, "nearest_site", lambda *a, **k: calls.append(k) or nearest_site(*a, **k))
    finals = spark.createDataFrame([("f1", 0.0, 0.0)], "cnpj string, lat double, lon double")
    sites = spark.createDataFrame([("d1", "r1", "n1", "z1", 0.0, 0.5)], NAMES)
    assert allocate(finals, sites, 150.0, ["r1"], True).first().cnpj_distrib_sel == "d1"
    assert len(calls) == 1


def test_far_from_every_site(spark):
    rng = random.Random(5)
    check(spark, scattered(rng, 40), [("a", -89.0, 0.0), ("b", -88.0, 170.0)], 1)


def test_ties_take_the_smallest_id(spark):
    sites = [("b", 10.0, 10.0), ("a", 10.0, 10.0), ("c", -10.0, 10.0)]
    check(spark, [(0.0, 10.0), (10.0, 10.0)], sites, 1)


def test_third_of_the_points_in_one_place(spark):
    rng = random.Random(9)
    points = [(-23.5, -46.6)] * 50 + town(rng, 50) + scattered(rng, 50)
    sites = [(f"{i:03d}", la, lo) for i, (la, lo) in enumerate(town(rng, 90, spread=0.0005))]
    check(spark, points, sites, 4)


NAMES = "cnpj string, cnpj_basico string, nome_fantasia string, razao_social string, lat double, lon double"


def test_allocation_policies(spark):
    finals = spark.createDataFrame(
        [("f1", 0.0, 0.0), ("f2", 0.0, 5.0), ("f3", None, None), ("f4", 0.0, 1.2)],
        "cnpj string, lat double, lon double",
    )
    sites = spark.createDataFrame(
        [("d1", "r1", "n1", "z1", 0.0, 0.5), ("d2", "r2", "n2", "z2", 0.0, -1.0)], NAMES
    )

    def result(**options):
        return {r.cnpj: r for r in allocate(finals, sites, 150.0, **options).collect()}

    plain = result()
    assert plain["f1"].cnpj_distrib_proximo == "d1" and plain["f1"].atendimento_via.startswith("Dentro")
    assert plain["f2"].atendimento_via == "Fora do raio" and plain["f2"].dist_km_min > 150
    assert plain["f3"].atendimento_via == "Fora do raio" and plain["f3"].dist_km_min is None

    chosen = result(selected_roots=["r2"])
    assert chosen["f1"].atendimento_via == "Dentro do raio (outros distribuidores)"
    assert chosen["f1"].cnpj_distrib_proximo == "d1" and chosen["f1"].cnpj_distrib_sel == "d2"

    table = spark.createDataFrame([("r2",), ("r2",)], "cnpj_basico string")
    assert result(selected_roots=table) == chosen

    first = result(selected_roots=["r2"], prioritise=True)
    assert first["f1"].atendimento_via == "Dentro do raio (selecionados)"
    assert first["f1"].cnpj_distrib_proximo == "d2" and first["f1"].nome_distrib == "n2"
    assert first["f4"].atendimento_via == "Dentro do raio (outros distribuidores)"
    assert first["f4"].cnpj_distrib_proximo == "d1"


def test_no_sites_or_no_points(spark):
    finals = spark.createDataFrame([("f1", 0.0, 0.0)], "cnpj string, lat double, lon double")
    none = spark.createDataFrame([], NAMES)
    row = allocate(finals, none, 150.0).first()
    assert row.atendimento_via == "Fora do raio" and row.dist_km_min is None
    assert allocate(finals.where("false"), none, 150.0).count() == 0
