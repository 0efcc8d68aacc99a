import numpy as np
import pyarrow as pa

from calorway.operators import horizon as H


def dense_city(seed, n=60, trees=4000, houses=600):
    rng = np.random.default_rng(seed)
    points = pa.table({"sample_id": np.arange(n), "x_m": rng.uniform(-200, 200, n), "y_m": rng.uniform(-200, 200, n), "inside": np.zeros(n, bool)})
    crowns = pa.table({"tx": rng.uniform(-600, 600, trees), "ty": rng.uniform(-600, 600, trees), "crown_radius_m": rng.uniform(1, 8, trees), "crown_base_m": rng.uniform(2, 4, trees),
                       "crown_top_m": rng.uniform(5, 14, trees), "tau": rng.uniform(0.05, 0.4, trees)})
    cx, cy, half = rng.uniform(-600, 600, houses), rng.uniform(-600, 600, houses), rng.uniform(5, 20, houses)
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    sides = [np.concatenate([c + half * k[i] for k in ring]) for ring in (corners, corners[1:] + corners[:1]) for i, c in ((0, cx), (1, cy))]
    walls = pa.table(dict(zip(("height_m", "ax", "ay", "bx", "by"), [np.tile(rng.uniform(8, 60, houses), 4), *sides])))
    return points, walls, crowns


def brute_opaque(points, walls):
    height, ax, ay, bx, by = (walls[c].to_numpy() for c in walls.column_names)
    ex, ey, out = bx - ax, by - ay, []
    for x, y in zip(points["x_m"].to_numpy(), points["y_m"].to_numpy()):
        rx, ry, row = ax - x, ay - y, []
        for dx, dy in zip(H._EAST, H._NORTH):
            with np.errstate(divide="ignore", invalid="ignore"):
                den = dx * ey - dy * ex
                along, share = (rx * ey - ry * ex) / den, (rx * dy - ry * dx) / den
                hit = (ex * ry - ey * rx > 0) & (along >= 0) & (along <= 400) & (share >= -1e-9) & (share <= 1 + 1e-9)
                row.append(np.where(along <= 0.01, 1e30, (height - 1.1) / along)[hit].max(initial=0.0))
        out.append(np.rint(np.degrees(np.arctan(np.maximum(row, 0.0)))))
    return np.array(out, dtype=int).tolist()


def brute_canopy(points, crowns):
    tx, ty, radius, base, top, tau = (crowns[c].to_numpy() for c in crowns.column_names)
    canopy, shares = [], []
    for x, y in zip(points["x_m"].to_numpy(), points["y_m"].to_numpy()):
        for dx, dy in zip(H._EAST, H._NORTH):
            along, aside = (tx - x) * dx + (ty - y) * dy, np.abs((tx - x) * dy - (ty - y) * dx)
            hit = (aside <= radius) & (along > 0) & (along <= 400)
            height = along * np.tan(np.radians(30.0)) + 1.1
            canopy.append(int(np.rint(np.degrees(np.arctan(((top - 1.1) / np.maximum(along, 0.01))[hit].max(initial=0.0))))))
            shares.append(int(np.rint(np.exp(np.log(tau)[hit & (base <= height) & (height <= top)].sum()) * 255)))
    return np.reshape(canopy, (-1, 72)).tolist(), np.reshape(shares, (-1, 72)).tolist()


def test_rays_meet_few_obstacles_and_miss_none(monkeypatch):
    """Every sample used to be paired with every wall and crown within its reach."""
    points, walls, crowns = dense_city(3)
    tested, march = [], H.march

    def counted(spans, heights, u, v, lane_m, touch_m, most, meet):
        def counting(t, i, j):
            tested.append(len(j))
            return meet(t, i, j)
        return march(spans, heights, u, v, lane_m, touch_m, most, counting)

    monkeypatch.setattr(H, "march", counted)
    got = H._opaque_of_cell(points, walls)
    assert got["opaque"].to_pylist() == brute_opaque(points, walls)
    got = H._canopy_of_cell(points, crowns)
    assert (got["canopy"].to_pylist(), got["tau_q"].to_pylist()) == brute_canopy(points, crowns)
    assert sum(tested) < len(points) * 72 * 6


def test_rays_in_small_parts_meet_the_same(monkeypatch):
    points, walls, crowns = dense_city(4, n=20)
    whole = H._opaque_of_cell(points, walls), H._canopy_of_cell(points, crowns)
    monkeypatch.setattr(H, "PAIRS_AT_ONCE", 7)
    assert whole == (H._opaque_of_cell(points, walls), H._canopy_of_cell(points, crowns))


def test_a_tower_behind_low_roofs_and_a_crown_under_a_higher_one_count():
    """A ray may not end at the first obstacle: a farther one can stand higher, and a nearer band of leaves can dim it too."""
    points = pa.table({"sample_id": [1, 1, 2], "x_m": [0.0, 0.0, float("nan")], "y_m": [0.0, 0.0, 0.0], "inside": [False] * 3})
    walls = pa.table({"height_m": [5.0, None, 200.0], "ax": [10.0, -10.0, 10.0], "ay": [20.0, 30.0, 300.0], "bx": [-10.0, 10.0, -10.0], "by": [20.0, 30.0, 300.0]})
    # solid lies to the left of a -> b, so these face a sample to the south
    walls = walls.set_column(1, "ax", walls["bx"]).set_column(3, "bx", walls["ax"])
    rows = {r["sample_id"]: r["opaque"] for r in H._opaque_of_cell(points, walls).to_pylist()}
    assert rows[1][0] == 34 and rows[2] == [0] * 72
    crowns = pa.table({"tx": [0.0, 0.0], "ty": [4.0, 12.0], "crown_radius_m": [2.0, 2.0], "crown_base_m": [2.0, 5.0], "crown_top_m": [30.0, 14.0], "tau": [0.5, 0.5]})
    one = points.slice(0, 1)
    assert H._canopy_of_cell(one, crowns)["tau_q"].to_pylist()[0][0] == 64
