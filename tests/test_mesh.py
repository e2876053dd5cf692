import numpy as np
import pytest

from numeriq.operators import mesh


def heat(v, power, steps):
    for _ in range(steps):
        new = v + 0.01 * power + 0.005 * (80 - v)
        for axis, rate in enumerate((0.1, 0.1, 0.05)):
            for shift in (-1, 1):
                near = np.full_like(v, np.nan)
                to, of = [slice(None)] * 3, [slice(None)] * 3
                to[axis], of[axis] = (slice(1, None), slice(None, -1)) if shift == 1 else (slice(None, -1), slice(1, None))
                near[tuple(to)] = v[tuple(of)]
                new = new + rate * np.where(np.isnan(near), 0, near - v)
        v = np.where(np.isnan(v), np.nan, new)
    return v


@pytest.mark.parametrize("steps,side", [(1, 4), (3, 4), (5, 3), (2, 100)])
def test_blocks_with_borders_equal_the_whole_grid(spark, steps, side):
    rng = np.random.default_rng(steps)
    v, power = rng.random((9, 7, 6)) * 50, rng.random((9, 7, 6))
    v[rng.random(v.shape) < 0.1] = np.nan  # gaps
    # Places may be negative.
    rows = [(int(x) - 4, int(y), int(z) + 10, float(v[x, y, z]), float(power[x, y, z])) for x, y, z in np.argwhere(~np.isnan(v))]
    df = spark.createDataFrame(rows, "x long, y long, z long, v double, power double")
    got = {(r["x"] + 4, r["y"], r["z"] - 10): r["v"] for r in mesh.heat_steps_3d(df, steps, side=side).collect()}
    want = heat(v, power, steps)
    assert len(got) == len(rows) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert mesh.heat_steps_3d(df.limit(0), steps).count() == 0


def test_a_uniform_flow_stays(spark):
    """Closed elements in the far field's own state have no flux, and mass is kept between neighbours."""
    far = mesh.far_state(0.8, 5.0)
    state = [(i, *(far[c] for c in mesh.STATE), 1.0 + i) for i in range(4)]
    cube = [(1.0, 0, 0), (-1.0, 0, 0), (0, 1.0, 0), (0, -1.0, 0), (0, 0, 1.0), (0, 0, -1.0)]
    faces = [(i, (i + k) % 4 if k < 2 else -2, *map(float, n)) for i in range(4) for k, n in enumerate(cube)]
    elements = spark.createDataFrame(state, "i long, density double, mx double, my double, mz double, energy double, area double")
    edges = spark.createDataFrame(faces, "i long, neighbour long, nx double, ny double, nz double")
    for r in mesh.flow_step(elements, edges, far).collect():
        assert all(abs(r[c] - far[c]) < 1e-12 for c in mesh.STATE)
    # Two elements, one face seen from both sides: what one loses the other gains.
    two = spark.createDataFrame([(0, 1.4, 0.3, 0.1, 0.0, 3.0, 1.0), (1, 1.1, -0.2, 0.0, 0.1, 2.7, 1.0)], elements.schema)
    flux = mesh.flow_fluxes(two, spark.createDataFrame([(0, 1, 1.0, 0.5, 0.0), (1, 0, -1.0, -0.5, 0.0)], edges.schema), far).orderBy("i").collect()
    assert all(abs(flux[0]["f_" + c] + flux[1]["f_" + c]) < 1e-12 for c in mesh.STATE)
    # A wall gives its pressure only; an element without faces stays.
    wall = mesh.flow_fluxes(two, spark.createDataFrame([(0, -1, 2.0, 0.0, 0.0)], edges.schema), far).first()
    assert wall["f_density"] == 0 and abs(wall["f_mx"] - 2 * 0.4 * (3.0 - 0.5 * (0.09 + 0.01) / 1.4)) < 1e-12
    stay = mesh.flow_step(two, edges.limit(0), far).orderBy("i").first()
    assert (stay["density"], stay["energy"]) == (1.4, 3.0)


def test_walls_are_no_key_of_the_join_and_states_are_dealt_once(spark):
    from numeriq.plans.lineage import cut

    far = mesh.far_state(0.8, 5.0)
    elements = cut(spark.createDataFrame([(i, 1.0 + i / 10, 0.1 * i, 0.1, 0.0, 2.5 + i, 1.0) for i in range(5)], "i long, density double, mx double, my double, mz double, energy double, area double"))
    faces = cut(spark.createDataFrame([(i, nb, 0.3, 0.1 * k, -0.2) for i in range(5) for k, nb in enumerate([(i + 1) % 5, -1, -2, 77, None])], "i long, neighbour long, nx double, ny double, nz double"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        flux = mesh.flow_fluxes(elements, faces, far)
        plan = flux._jdf.queryExecution().executedPlan().toString()
        got = {r["i"]: r for r in flux.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in plan and "IN (-1,-2)" in plan
    # -2, an element that isn't there and no neighbour at all are the far field.
    for i in range(5):
        one = [mesh.flow_fluxes(elements, spark.createDataFrame([(i, nb, 0.3, 0.1 * k, -0.2)], faces.schema), far).first() for k, nb in enumerate([(i + 1) % 5, -1, -2, -2, -2])]
        assert all(abs(got[i]["f_" + c] - sum(r["f_" + c] for r in one)) < 1e-12 for c in mesh.STATE)
