"""The registered queries and their SQL.

Every query reads the ``events`` table as a small sensor's stream: 16 x 12
pixels, a second of the table as a microsecond of the sensor.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.camera import Camera
from ..operators import augment, features, feast, filters, frames, masks, motion, represent, simulate, track, transforms
from ..schema import SensorMeta
from ..stream import EventStream
from . import dataset
from .dataset import EventReader, Slicing

W, H = 16, 12
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "hot_pixel_count"

#: The stream, as common table expressions that each query's SQL starts with.
EV = """
ev AS (
  SELECT (user_id % 16)::INTEGER AS x, ((event_id * 7 + user_id) % 12)::INTEGER AS y,
         epoch_us(ts) // 1000000 - 1704067200 AS t, value >= 50 AS p, event_id AS seq
  FROM events
)"""
BOUND = ", b AS (SELECT min(t) AS t0, max(t) AS t1 FROM ev)"


def events(spark: SparkSession, sf_dir: str) -> EventStream:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    df = raw.select(
        (F.col("user_id") % 16).cast("int").alias("x"),
        ((F.col("event_id") * 7 + F.col("user_id")) % 12).cast("int").alias("y"),
        (F.floor(micros / 1_000_000) - 1704067200).cast("long").alias("t"),
        (F.col("value") >= 50).alias("p"),
        F.col("event_id").alias("seq"),
    )
    return EventStream(df, SensorMeta(W, H))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[EventStream], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(events(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def plain(key: str, op: Callable[[EventStream], EventStream], sql: str) -> None:
    """A query from stream to stream; ``sql`` selects x, y, t, p, seq."""
    query(sql, key)(lambda s: op(s).df.select("x", "y", "t", "p", "seq"))


def cells(f: represent.Frame, digits: int | None = None) -> DataFrame:
    value = F.col("value") if digits is None else F.round(F.col("value").cast("double"), digits)
    return f.df.where("value <> 0").select(*f.keys, "c", "y", "x", value.alias("value"))


def stream_sql(x="x", y="y", t="t", p="p", seq="seq", where="true", w=W, h=H) -> str:
    return f"WITH {EV}, m AS (SELECT ({x})::INTEGER AS x, ({y})::INTEGER AS y, ({t})::BIGINT AS t, {p} AS p, {seq} AS seq FROM ev WHERE {where}) SELECT * FROM m WHERE x >= 0 AND x < {w} AND y >= 0 AND y < {h}"


# geometry
plain("crop", lambda s: transforms.crop(s, 3, 2, 8, 7), stream_sql("x - 3", "y - 2", w=8, h=7))
plain("flip_x", transforms.flip_x, stream_sql(x="15 - x"))
plain("flip_y", transforms.flip_y, stream_sql(y="11 - y"))
plain("rotate90", transforms.rotate90, stream_sql("11 - y", "x", w=12, h=16))
plain("rotate180", lambda s: transforms.rotate90(s, 2), stream_sql("15 - x", "11 - y"))
plain("rotate270", lambda s: transforms.rotate90(s, 3), stream_sql("y", "15 - x", w=12, h=16))
plain("transpose", transforms.transpose, stream_sql("y", "x", w=12, h=16))
plain("translate", lambda s: transforms.translate(s, 3, -2), stream_sql("x + 3", "y - 2"))
plain("resize", lambda s: transforms.resize(s, 7, 5), stream_sql("x * 7 // 16", "y * 5 // 12", w=7, h=5))
plain("scale", lambda s: transforms.scale(s, 0.5, 0.5), stream_sql("x * 8 // 16", "y * 6 // 12", w=8, h=6))
plain("warp_affine", lambda s: transforms.warp_affine(s, [[0.8, -0.3, 2.25], [0.3, 0.8, -0.75]]), stream_sql("round(x::DOUBLE * 0.8::DOUBLE + y::DOUBLE * (-0.3)::DOUBLE + 2.25::DOUBLE)", "round(x::DOUBLE * 0.3::DOUBLE + y::DOUBLE * 0.8::DOUBLE + (-0.75)::DOUBLE)"))
_PW = "(x::DOUBLE * 0.01::DOUBLE + y::DOUBLE * 0.02::DOUBLE + 1::DOUBLE)"
plain("warp_perspective", lambda s: transforms.warp_perspective(s, [[1, 0.1, 0.5], [0.05, 1, -0.25], [0.01, 0.02, 1]]), stream_sql(f"round((x::DOUBLE * 1::DOUBLE + y::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE) / {_PW})", f"round((x::DOUBLE * 0.05::DOUBLE + y::DOUBLE * 1::DOUBLE + (-0.25)::DOUBLE) / {_PW})"))
CAMERA = Camera(14.0, 14.0, 7.5, 5.5, k1=-0.2, k2=0.05, p1=0.001, p2=-0.002)


def _undistort_sql() -> str:
    c, steps = CAMERA, "s0 AS (SELECT x, y, (x - 7.5::DOUBLE) / 14 AS x0, (y - 5.5::DOUBLE) / 14 AS y0, (x - 7.5::DOUBLE) / 14 AS u, (y - 5.5::DOUBLE) / 14 AS v FROM range(16) a(x), range(12) b(y))"
    for i in range(20):
        r2 = "(u * u + v * v)"
        radial = f"(1 + {r2} * ({c.k1}::DOUBLE + {r2} * ({c.k2}::DOUBLE + {r2} * 0::DOUBLE)))"
        dx = f"(2 * {c.p1}::DOUBLE * u * v + ({c.p2})::DOUBLE * ({r2} + 2 * u * u))"
        dy = f"({c.p1}::DOUBLE * ({r2} + 2 * v * v) + 2 * ({c.p2})::DOUBLE * u * v)"
        steps += f", s{i + 1} AS (SELECT x, y, x0, y0, (x0 - {dx}) / {radial} AS u, (y0 - {dy}) / {radial} AS v FROM s{i})"
    return f"WITH {EV}, {steps}, lut AS (SELECT x, y, round(u * 14 + 7.5)::INTEGER AS nx, round(v * 14 + 5.5)::INTEGER AS ny FROM s20) SELECT nx AS x, ny AS y, t, p, seq FROM ev JOIN lut USING (x, y) WHERE nx >= 0 AND nx < 16 AND ny >= 0 AND ny < 12"


plain("undistort", lambda s: transforms.undistort(s, CAMERA), _undistort_sql())

# time, polarity, order
plain("time_window", lambda s: transforms.time_window(s, 500_000, 1_500_000), stream_sql(where="t >= 500000 AND t < 1500000"))
plain("time_shift", lambda s: transforms.time_shift(s, -12_345), stream_sql(t="t - 12345"))
plain("time_scale", lambda s: transforms.time_scale(s, 0.25), stream_sql(t="round(t * 0.25::DOUBLE)"))
plain("normalize_time", transforms.normalize_time, stream_sql(t="t - (SELECT min(t) FROM ev)"))
plain("decimate", lambda s: transforms.decimate(s, 7), f"WITH {EV}, r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS n FROM ev) SELECT x, y, t, p, seq FROM r WHERE n % 7 = 0")
plain("filter_polarity", lambda s: transforms.filter_polarity(s, 1), stream_sql(where="p"))
plain("invert_polarity", transforms.invert_polarity, stream_sql(p="NOT p"))
plain("sort_by_time", lambda s: transforms.sort_by_time(transforms.flip_x(s)), f"WITH {EV} SELECT (15 - x)::INTEGER AS x, y, t, p, row_number() OVER (ORDER BY t, seq) - 1 AS seq FROM ev")
plain("concat", lambda s: transforms.concat(s, [transforms.filter_polarity(s, 1)]), f"WITH {EV} SELECT * FROM ev UNION ALL SELECT x, y, t, p, seq + (SELECT max(seq) + 1 FROM ev) FROM ev WHERE p")
plain("max_events", lambda s: transforms.max_events(transforms.skip_before(s, 400_000), 500), f"WITH {EV} SELECT * FROM ev WHERE t >= 400000 ORDER BY seq LIMIT 500")

# masks
plain("rect_mask", lambda s: masks.mask(s, masks.rect_mask(s.df.sparkSession, W, H, 2, 3, 7, 5)), stream_sql(where="x + 0.5 >= 2 AND x + 0.5 < 9 AND y + 0.5 >= 3 AND y + 0.5 < 8"))
plain("circle_mask", lambda s: masks.mask(s, masks.circle_mask(s.df.sparkSession, W, H, 8, 6, 4.5)), stream_sql(where="((x + 0.5 - 8) / 4.5) ** 2 + ((y + 0.5 - 6) / 4.5) ** 2 <= 1"))
plain("ellipse_mask", lambda s: masks.mask(s, masks.ellipse_mask(s.df.sparkSession, W, H, 8, 6, 6, 3)), stream_sql(where="((x + 0.5 - 8) / 6.0) ** 2 + ((y + 0.5 - 6) / 3.0) ** 2 <= 1"))
plain("drop_masked_pixels", lambda s: masks.drop_masked_pixels(s, masks.rect_mask(s.df.sparkSession, W, H, 2, 3, 7, 5)), stream_sql(where="NOT (x + 0.5 >= 2 AND x + 0.5 < 9 AND y + 0.5 >= 3 AND y + 0.5 < 8)"))
TRIANGLE = [(1.0, 1.0), (14.0, 3.0), (5.0, 11.0)]


def _crossings() -> str:
    out = []
    for (xa, ya), (xb, yb) in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1]):
        out.append(f"(CASE WHEN ({ya} <= y + 0.5) <> ({yb} <= y + 0.5) AND x + 0.5 < {xa}::DOUBLE + (y + 0.5 - {ya}) * ({(xb - xa) / (yb - ya)!r})::DOUBLE THEN 1 ELSE 0 END)")
    return " + ".join(out)


plain("polygon_mask", lambda s: masks.mask(s, masks.polygon_mask(s.df.sparkSession, W, H, TRIANGLE)), stream_sql(where=f"({_crossings()}) % 2 = 1"))


@query(f"""WITH {EV}, a AS (SELECT x, y FROM range(16) q(x), range(12) r(y) WHERE x < 9 AND y < 6), b AS (SELECT x, y FROM range(16) q(x), range(12) r(y) WHERE x >= 5 AND y >= 3)
SELECT x::INTEGER AS x, y::INTEGER AS y FROM (SELECT * FROM a UNION SELECT * FROM b EXCEPT (SELECT * FROM a INTERSECT SELECT * FROM b))""")
def mask_algebra(s):
    spark = s.df.sparkSession
    a, b = masks.rect_mask(spark, W, H, 0, 0, 9, 6), masks.rect_mask(spark, W, H, 5, 3, 11, 9)
    return masks.intersect(masks.union(a, b), masks.invert(masks.intersect(a, b), W, H))


# denoising
DT = 3000


def _near(offsets) -> str:
    return ", ".join(f"({dx}, {dy})" for dx, dy in offsets)


def _baf_sql(offsets) -> str:
    return f"""WITH {EV}, o(dx, dy) AS (VALUES {_near(offsets)}), q AS (
      SELECT seq, t, x + dx AS cx, y + dy AS cy, NULL::BIGINT AS tu FROM ev, o WHERE x + dx BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 11
      UNION ALL SELECT seq, t, x, y, t FROM ev
    ), l AS (SELECT seq, t, tu, last_value(tu IGNORE NULLS) OVER (PARTITION BY cx, cy ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_t FROM q)
    SELECT * FROM ev WHERE seq IN (SELECT seq FROM l WHERE tu IS NULL AND t - last_t <= {DT})"""


plain("background_activity_filter", lambda s: filters.background_activity_filter(s, DT), _baf_sql(filters.BLOCK))
plain("background_activity_cross", lambda s: filters.background_activity_filter(s, DT, "cross"), _baf_sql(filters.CROSS))
plain("refractory_all", lambda s: filters.refractory_filter(s, 5000, "all"), f"WITH {EV}, l AS (SELECT *, lag(t) OVER (PARTITION BY x, y ORDER BY seq) AS b FROM ev) SELECT x, y, t, p, seq FROM l WHERE b IS NULL OR t - b >= 5000")
plain("refractory_kept", lambda s: filters.refractory_filter(s, 5000), f"""WITH RECURSIVE {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY seq) AS i FROM ev),
r AS (SELECT x, y, t, p, seq, i, t AS kept, true AS keep FROM n WHERE i = 1
      UNION ALL SELECT n.x, n.y, n.t, n.p, n.seq, n.i, CASE WHEN n.t - r.kept >= 5000 THEN n.t ELSE r.kept END, n.t - r.kept >= 5000 FROM r JOIN n ON n.x = r.x AND n.y = r.y AND n.i = r.i + 1)
SELECT x, y, t, p, seq FROM r WHERE keep""")
_HOT = "k AS (SELECT x, y, count(*) AS c FROM ev GROUP BY x, y), hot AS (SELECT x, y FROM k WHERE c > (SELECT avg(c) + 1.0 * stddev_pop(c) FROM k))"
plain("hot_pixel_filter", lambda s: filters.hot_pixel_filter(s, 1.0), f"WITH {EV}, {_HOT} SELECT * FROM ev WHERE (x, y) NOT IN (SELECT (x, y) FROM hot)")


@query(f"WITH {EV}, {_HOT} SELECT 0 AS c, y, x, count(*) AS value FROM ev WHERE (x, y) NOT IN (SELECT (x, y) FROM hot) GROUP BY y, x")
def hot_pixel_count(s):
    return cells(represent.count(filters.hot_pixel_filter(s, 1.0)))


# representations
PLANE = "CASE WHEN p THEN 0 ELSE 1 END"


@query(f"WITH {EV} SELECT 0 AS c, y, x, 1 AS value FROM ev GROUP BY y, x")
def binary(s):
    return cells(represent.binary(s))


@query(f"WITH {EV} SELECT 0 AS c, y, x, count(*) AS value FROM ev GROUP BY y, x")
def count(s):
    return cells(represent.count(s))


@query(f"WITH {EV}, k AS (SELECT y, x, count(*) AS n FROM ev GROUP BY y, x), m AS (SELECT max(n) AS m FROM k) SELECT 0 AS c, y, x, ((n * 255 + m // 2) // m)::INTEGER AS value FROM k, m WHERE (n * 255 + m // 2) // m <> 0")
def count_normalized(s):
    return cells(represent.count(s, normalize=True))


@query(f"WITH {EV}, k AS (SELECT {PLANE} AS c, y // 2 AS y, x // 2 AS x, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT max(n) AS m FROM k) SELECT c, y, x, ((n * 255 + m // 2) // m)::INTEGER AS value FROM k, m WHERE (n * 255 + m // 2) // m <> 0")
def polarity(s):
    return cells(represent.polarity(s, downsample=2))


@query(f"WITH {EV} SELECT {PLANE} AS c, y, x, count(*) AS value FROM ev GROUP BY ALL")
def polarity_counts(s):
    return cells(represent.polarity(s, normalize=False))


@query(f"""WITH {EV}{BOUND}, a AS (SELECT x, y, CASE WHEN p THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, (1 - (t1 - t) * 0.001::DOUBLE / 600.0::DOUBLE) * 4 AS pos FROM ev, b WHERE (t1 - t) * 0.001::DOUBLE <= 600),
v AS (SELECT y, x, least(floor(pos), 4)::INTEGER AS c, s * (1 - (pos - floor(pos))) AS w FROM a UNION ALL SELECT y, x, least(floor(pos), 4)::INTEGER + 1, s * (pos - floor(pos)) FROM a)
SELECT c, y, x, round(sum(w)::FLOAT::DOUBLE, 3) AS value FROM v WHERE c < 5 AND w <> 0 GROUP BY c, y, x HAVING sum(w)::FLOAT <> 0""")
def voxel(s):
    return cells(represent.voxel(s, 5, 600.0), 3)


@query(f"WITH {EV}{BOUND} SELECT {PLANE} AS c, y, x, round(exp(-(max(t1) - max(t)) * 0.001::DOUBLE / 300.0::DOUBLE)::FLOAT::DOUBLE, 5) AS value FROM ev, b GROUP BY p, y, x")
def tsurf(s):
    return cells(represent.tsurf(s, 300.0), 5)


@query(f"WITH {EV}{BOUND} SELECT {PLANE} AS c, y, x, round(avg(exp(-(t1 - t) * 0.001::DOUBLE / 300.0::DOUBLE))::FLOAT::DOUBLE, 5) AS value FROM ev, b GROUP BY p, y, x")
def atsurf(s):
    return cells(represent.atsurf(s, 300.0), 5)


@query(f"""WITH {EV}{BOUND}, l AS (SELECT y, x, arg_max(p, seq) AS p, arg_max(t, seq) AS t FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY t DESC, seq DESC) AS n FROM ev, b WHERE (t1 - t) * 0.001::DOUBLE <= 600) WHERE n = 1 GROUP BY y, x),
v AS (SELECT CASE WHEN p THEN 0 ELSE 2 END AS c, y, x, 255 AS value FROM l UNION ALL SELECT 1, y, x, least(greatest(round((t1 - t) * 0.001::DOUBLE / 600.0::DOUBLE * 255), 0), 255)::INTEGER FROM l, b) SELECT * FROM v WHERE value > 0""")
def tencode(s):
    return cells(represent.tencode(s, 600.0))


_SIGNED = "k AS (SELECT y, x, count(*) FILTER (WHERE p) AS pos, count(*) FILTER (WHERE NOT p) AS neg FROM ev GROUP BY y, x)"


@query(f"""WITH {EV}, {_SIGNED}, n AS (SELECT unnest([pos, neg]) AS n FROM k), a AS (SELECT quantile_cont(n::DOUBLE, 0.9::DOUBLE)::FLOAT AS a FROM n WHERE n > 0),
v AS (SELECT 0 AS c, y, x, trunc((least(pos::FLOAT, a) / a)::FLOAT * 255::FLOAT)::INTEGER AS value FROM k, a UNION ALL SELECT 1, y, x, 255 FROM k UNION ALL SELECT 2, y, x, trunc((least(neg::FLOAT, a) / a)::FLOAT * 255::FLOAT)::INTEGER FROM k, a)
SELECT * FROM v WHERE value > 0""")
def countmask(s):
    return cells(represent.countmask(s, 90.0))


@query(f"""WITH {EV}, {_SIGNED}, a AS (SELECT quantile_cont(CASE WHEN pos > 0 THEN pos::DOUBLE END, 0.9::DOUBLE)::FLOAT AS ap, quantile_cont(CASE WHEN neg > 0 THEN neg::DOUBLE END, 0.9::DOUBLE)::FLOAT AS an FROM k),
u AS (SELECT y, x, CASE WHEN ap > 0 THEN (least(pos::FLOAT, ap) / ap)::FLOAT ELSE 0::FLOAT END AS p, CASE WHEN an > 0 THEN (least(neg::FLOAT, an) / an)::FLOAT ELSE 0::FLOAT END AS n FROM k, a),
f AS (SELECT y, x, p >= n AS w, trunc((1::FLOAT - p) * 255::FLOAT)::INTEGER AS fp, trunc((1::FLOAT - n) * 255::FLOAT)::INTEGER AS fn FROM u),
v AS (SELECT 0 AS c, y, x, CASE WHEN w THEN 255 ELSE fn END AS value FROM f UNION ALL SELECT 1, y, x, CASE WHEN w THEN fp ELSE fn END FROM f UNION ALL SELECT 2, y, x, CASE WHEN w THEN fp ELSE 255 END FROM f),
g AS (SELECT c::INTEGER AS c, y::INTEGER AS y, x::INTEGER AS x FROM range(3) a(c), range(12) b(y), range(16) d(x))
SELECT c, y, x, coalesce(value, 255)::INTEGER AS value FROM g LEFT JOIN v USING (c, y, x) WHERE coalesce(value, 255) <> 0""")
def redblue(s):
    return cells(represent.redblue(s, 90.0))


@query(f"""WITH {EV}{BOUND}, l AS (SELECT p, y, x, (max(t1) - max(t)) * 0.001::DOUBLE AS age FROM ev, b GROUP BY p, y, x), w(i, v) AS (VALUES (0, 100.0::DOUBLE), (1, 500.0::DOUBLE))
SELECT CASE WHEN p THEN 2 + i ELSE i END AS c, y, x, round((1 - age / v)::FLOAT::DOUBLE, 5) AS value FROM l, w WHERE age < v""")
def mcts(s):
    return cells(represent.mcts(s, windows_ms=[100.0, 500.0]), 5)


@query(f"WITH {EV}{BOUND} SELECT seq, round((x / 15.0::DOUBLE)::FLOAT::DOUBLE, 6) AS x, round((y / 11.0::DOUBLE)::FLOAT::DOUBLE, 6) AS y, round(((t - t0)::DOUBLE / (t1 - t0))::FLOAT::DOUBLE, 6) AS t, CASE WHEN p THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS p FROM ev, b")
def pset(s):
    return represent.pset(s).select("seq", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in "xytp"])


@query(f"""WITH {EV}{BOUND}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY t DESC, seq DESC) AS n FROM ev, b) WHERE n = 1)
SELECT 0 AS c, y, x, round((CASE WHEN p THEN 1 ELSE -1 END * exp(-(t1 - t) * 0.001::DOUBLE / 100.0::DOUBLE))::FLOAT::DOUBLE, 5) AS value FROM l WHERE (t1 - t) * 0.001::DOUBLE <= 650""")
def raw_image(s):
    return cells(represent.raw_image(s, 100.0), 5)


@query(f"""WITH {EV}{BOUND}, k AS (SELECT (t - t0) // 1000 AS bin, count(*) AS n, count(*) FILTER (WHERE p) AS pos FROM ev, b GROUP BY ALL), r AS (SELECT unnest(range((t1 - t0) // 1000 + 1)) AS bin, t0 FROM b)
SELECT t0 + bin * 1000 AS t, coalesce(n, 0) AS count, coalesce(pos, 0) AS positive, coalesce(n, 0) - coalesce(pos, 0) AS negative, coalesce(n, 0) / 0.001::DOUBLE AS rate FROM r LEFT JOIN k USING (bin)""")
def event_rate(s):
    return represent.event_rate(s, 1.0)


@query(f"WITH {EV} SELECT x, y, count(*) AS count FROM ev GROUP BY x, y")
def pixel_counts(s):
    return represent.pixel_counts(s)


@query(f"WITH {EV} SELECT count(*) AS n_events, min(t) AS t_min, max(t) AS t_max, (max(t) - min(t)) * 0.001::DOUBLE AS duration_ms, count(*) / ((max(t) - min(t)) * 0.001::DOUBLE / 1000) AS mean_rate FROM ev")
def stats(s):
    return s.stats()


_IWE = "SELECT x - d * 3.0::DOUBLE AS u, y - d * (-2.0)::DOUBLE AS v FROM (SELECT x, y, (t - (t0 + t1) / 2.0::DOUBLE) * 0.000001::DOUBLE AS d FROM ev, b)"


@query(f"""WITH {EV}{BOUND}, m AS ({_IWE}), f AS (SELECT floor(u) AS x, floor(v) AS y, u - floor(u) AS a, v - floor(v) AS c FROM m),
q AS (SELECT x, y, (1 - a) * (1 - c) AS w FROM f UNION ALL SELECT x, y + 1, (1 - a) * c FROM f UNION ALL SELECT x + 1, y, a * (1 - c) FROM f UNION ALL SELECT x + 1, y + 1, a * c FROM f)
SELECT 0 AS c, y::INTEGER AS y, x::INTEGER AS x, round(sum(w)::FLOAT::DOUBLE, 2) AS value FROM q WHERE w > 0 AND x >= 0 AND x < 16 AND y >= 0 AND y < 12 GROUP BY y, x HAVING sum(w) > 0""")
def iwe(s):
    return cells(motion.iwe(s, [3.0, -2.0]), 2)


# slices
_SLICE = "s AS (SELECT *, (t - t0) // 100000 AS slice_id FROM ev, b)"


class Balance:
    """A fold of one's own: ON less OFF events, and the last time."""

    def __init__(self) -> None:
        self.balance, self.last = 0, 0

    def push(self, x: int, y: int, t: int, p: bool) -> None:
        self.balance, self.last = self.balance + (1 if p else -1), max(self.last, t)

    def result(self) -> tuple[int, int]:
        return self.balance, self.last


def _tumbling(s) -> EventReader:
    return EventReader(s, Slicing(dt=100_000))


@query(f"WITH {EV}{BOUND}, {_SLICE}, r AS (SELECT unnest(range((t1 - t0) // 100000 + 1)) AS slice_id, t0 FROM b), k AS (SELECT slice_id, count(*) AS n FROM s GROUP BY slice_id) SELECT slice_id, t0 + slice_id * 100000 AS t0, t0 + slice_id * 100000 + 100000 AS t1, coalesce(n, 0) AS n_events FROM r LEFT JOIN k USING (slice_id)")
def slices(s):
    return _tumbling(s).summary()


@query(f"WITH {EV}{BOUND}, {_SLICE} SELECT slice_id, 0 AS c, y, x, count(*) AS value FROM s GROUP BY slice_id, y, x")
def slice_frames(s):
    return cells(_tumbling(s).with_repr("count").frames())


@query(f"WITH {EV}{BOUND}, {_SLICE} SELECT slice_id, 0 AS c, y, x, count(*) AS value FROM s WHERE slice_id IN (2, 5) GROUP BY slice_id, y, x")
def batch(s):
    return cells(_tumbling(s).with_repr("count").batch([2, 5]))


@query(f"WITH {EV}, r AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 700 AS slice_id FROM ev) SELECT slice_id, min(t) AS t0, max(t) + 1 AS t1, count(*) AS n_events FROM r GROUP BY slice_id")
def count_slices(s):
    return EventReader(s, Slicing(n=700)).summary()


@query(f"WITH {EV}{BOUND}, w AS (SELECT unnest(range((t1 - t0) // 50000 + 1)) AS slice_id, t0 FROM b) SELECT slice_id, t0 + slice_id * 50000 AS t0, t0 + slice_id * 50000 + 120000 AS t1, (SELECT count(*) FROM ev WHERE t >= t0 + slice_id * 50000 AND t < t0 + slice_id * 50000 + 120000) AS n_events FROM w")
def sliding_windows(s):
    return EventReader(s, Slicing(dt=120_000, step=50_000)).summary()


@query(f"WITH {EV}{BOUND}, {_SLICE} SELECT x, y, t, p, seq FROM s WHERE slice_id = 3")
def slice_n(s):
    return _tumbling(s).slice(3).df.select("x", "y", "t", "p", "seq")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS n FROM ev) SELECT x, y, t, p, seq FROM r WHERE n >= 100 AND n < 350")
def slice_count(s):
    return _tumbling(s).slice_count(100, 350).df.select("x", "y", "t", "p", "seq")


@query(f"WITH {EV}{BOUND}, {_SLICE} SELECT slice_id, x, y, t - min(t) OVER (PARTITION BY slice_id) AS t, p, seq FROM s")
def slice_normalize_time(s):
    return _tumbling(s).apply(transforms.normalize_time).stream.df.select("slice_id", "x", "y", "t", "p", "seq")


@query(f"""WITH {EV}{BOUND}, {_SLICE}, e AS (SELECT slice_id, max(t) AS t1 FROM s GROUP BY slice_id)
SELECT s.slice_id, {PLANE} AS c, y, x, round(exp(-(max(e.t1) - max(t)) * 0.001::DOUBLE / 100.0::DOUBLE)::FLOAT::DOUBLE, 5) AS value FROM s JOIN e USING (slice_id) GROUP BY s.slice_id, p, y, x""")
def slice_tsurf(s):
    return cells(_tumbling(s).with_repr("tsurf").frames(), 5)


@query(f"WITH {EV}{BOUND}, w AS (SELECT unnest(range((t1 - t0) // 50000 + 1)) AS slice_id, t0 FROM b) SELECT slice_id, 0 AS c, y, (15 - x)::INTEGER AS x, count(*) AS value FROM w JOIN ev ON t >= t0 + slice_id * 50000 AND t < t0 + slice_id * 50000 + 120000 GROUP BY slice_id, y, x")
def windows_flip(s):
    """Windows of another length, with the operator and the representation that were put off before."""
    return cells(_tumbling(s).flip_x().with_repr("count").windows(step_ms=50, span_ms=120).frames())


@query(f"WITH {EV}{BOUND}, w AS (SELECT unnest(range((t1 - t0) // 50000 + 1)) AS slice_id, t0 FROM b) SELECT slice_id, {PLANE} AS c, y, (15 - x)::INTEGER AS x, count(*) AS value FROM w JOIN ev ON t >= t0 + slice_id * 50000 AND t < t0 + slice_id * 50000 + 120000 GROUP BY ALL")
def sliding_counts(s):
    return _tumbling(s).flip_x().windows(50_000, 120_000).sliding_counts(by_polarity=True)


@query(f"WITH {EV}{BOUND}, {_SLICE} SELECT slice_id, count(*) FILTER (WHERE p) - count(*) FILTER (WHERE NOT p) AS balance, max(t) AS last_t FROM s GROUP BY slice_id")
def consumed(s):
    return _tumbling(s).stream.consume(Balance, "balance long, last_t long")


@query(f"WITH {EV}, k AS (SELECT (11 - y)::INTEGER AS x, x AS y, p FROM ev WHERE t >= 200000 AND t < 900000) SELECT {PLANE} AS c, y, x, count(*) AS value FROM k GROUP BY ALL")
def slice_time_ops(s):
    return cells(_tumbling(s).rotate90().with_repr("polarity", normalize=False).slice_time(200_000, 900_000))


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS n FROM ev) SELECT x, y, t, NOT p AS p, seq FROM r WHERE n >= 100 AND n < 350")
def slice_count_ops(s):
    return _tumbling(s).invert_polarity().slice_count(100, 350).df.select("x", "y", "t", "p", "seq")


# frames
@query(f"WITH {EV}, k AS (SELECT y, x, count(*) AS n FROM ev GROUP BY y, x) SELECT 0 AS c, (y // 3)::INTEGER AS y, (x // 4)::INTEGER AS x, sum(n)::BIGINT AS value FROM k GROUP BY ALL")
def frame_resize_sum(s):
    return cells(frames.resize(represent.count(s), 4, 4, "sum"))


@query(f"WITH {EV}, k AS (SELECT y, x, count(*) AS n FROM ev GROUP BY y, x) SELECT 0 AS c, (y // 3)::INTEGER AS y, (x // 4)::INTEGER AS x, round(sum(n)::DOUBLE / 12)::BIGINT AS value FROM k GROUP BY ALL HAVING round(sum(n)::DOUBLE / 12) <> 0")
def frame_resize(s):
    return cells(frames.resize(represent.count(s), 4, 4))


# the whole stream, a frame for each slice
_SLICE_FEW = "s AS (SELECT *, (t - t0) // 30000 AS slice_id FROM ev, b), k AS (SELECT slice_id, x, y, count(*) AS n FROM s GROUP BY slice_id, x, y)"
_SLICE_REACH = f"""WITH RECURSIVE {EV}{BOUND}, {_SLICE_FEW}, r AS (SELECT slice_id, x, y, x AS rx, y AS ry FROM k UNION SELECT r.slice_id, r.x, r.y, k.x, k.y FROM r JOIN k ON k.slice_id = r.slice_id AND abs(k.x - r.rx) <= 1 AND abs(k.y - r.ry) <= 1),
l AS (SELECT slice_id, x, y, min(ry * 16 + rx) AS root FROM r GROUP BY slice_id, x, y), d AS (SELECT slice_id, x, y, dense_rank() OVER (PARTITION BY slice_id ORDER BY root) AS label FROM l)"""


def _all_spots(s) -> represent.Frame:
    return EventReader(s, Slicing(dt=30_000)).with_repr("count").frames()


@query(_SLICE_REACH + " SELECT slice_id, 0 AS c, y, x, label AS value FROM d")
def connected_components(s):
    return cells(frames.connected_components(_all_spots(s)))


@query(_SLICE_REACH + " SELECT slice_id, label, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM d GROUP BY slice_id, label HAVING count(*) >= 2")
def blobs(s):
    return frames.blobs(_all_spots(s), 8, 2)


@query(f"WITH {EV}{BOUND}, {_SLICE_FEW}, g AS (SELECT slice_id, y::INTEGER AS y, x::INTEGER AS x FROM (SELECT DISTINCT slice_id FROM s) a, range(12) b(y), range(16) d(x)) SELECT slice_id, 0 AS c, y, x, coalesce(n, 0)::BIGINT AS value FROM g LEFT JOIN k USING (slice_id, y, x)")
def frame_filled(s):
    return frames.filled(_all_spots(s)).df


# corners: the events of the table along fronts that grow from one corner of a 32 x 32 sensor to the other
_FRONT = """
n AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 - 1704067200 AS t, (event_id // 1024) % 3 = 0 AS p, event_id % 1024 AS m, floor(sqrt(event_id % 1024))::BIGINT AS k FROM events),
ev AS (SELECT CASE WHEN m - k * k <= k THEN k ELSE 2 * k - (m - k * k) END::INTEGER AS x, CASE WHEN m - k * k <= k THEN m - k * k ELSE k END::INTEGER AS y, t, p, seq FROM n)"""


def fronts(spark: SparkSession, sf_dir: str) -> EventStream:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.col("event_id") % 1024
    k = F.floor(F.sqrt(m)).cast("long")
    first = m - k * k <= k
    t = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1704067200).cast("long")
    df = raw.select(F.when(first, k).otherwise(2 * k - (m - k * k)).cast("int").alias("x"), F.when(first, m - k * k).otherwise(k).cast("int").alias("y"), t.alias("t"), (F.floor(F.col("event_id") / 1024) % 3 == 0).alias("p"), F.col("event_id").alias("seq"))
    return EventStream(df, SensorMeta(32, 32))


def _arc_sql(times: str, n: int, lo: int, hi: int) -> str:
    arcs = [f"len(list_filter(range({n}), lambda i: list_min(list_slice({times} || {times}, i + 1, i + {k})) > list_max(list_slice({times} || {times}, i + {k + 1}, i + {n})))) > 0" for k in range(lo, hi + 1)]
    return "(" + " OR ".join(arcs) + ")"


QUERIES["efast"] = lambda spark, d: features.efast(fronts(spark, d)).df.select("x", "y", "t", "p", "seq")
ORACLE_SQL["efast"] = f"""WITH {_FRONT}, o(slot, dx, dy) AS (VALUES {", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(features.RING_3 + features.RING_4))}),
q AS (SELECT seq, p, slot, x + dx AS cx, y + dy AS cy, NULL::BIGINT AS tu FROM ev, o WHERE x BETWEEN 4 AND 27 AND y BETWEEN 4 AND 27 UNION ALL SELECT seq, p, NULL, x, y, t FROM ev),
l AS (SELECT seq, slot, last_value(tu IGNORE NULLS) OVER (PARTITION BY p, cx, cy ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_t FROM q),
r AS (SELECT seq, list(coalesce(last_t, -9223372036854775808) ORDER BY slot) AS a FROM l WHERE slot IS NOT NULL GROUP BY seq), h AS (SELECT seq, a[1:16] AS r3, a[17:36] AS r4 FROM r)
SELECT x, y, t, p, seq FROM ev WHERE seq IN (SELECT seq FROM h WHERE {_arc_sql("r3", 16, *features.ARC_3)} AND {_arc_sql("r4", 20, *features.ARC_4)})"""

QUERIES["harris_corners"] = lambda spark, d: features.harris_corners(fronts(spark, d)).df.select("x", "y", "t", "p", "seq")
ORACLE_SQL["harris_corners"] = f"""WITH {_FRONT}, o(dx, dy) AS (SELECT a.i, b.i FROM range(-5, 6) a(i), range(-5, 6) b(i)),
q AS (SELECT seq, dx, dy, x + dx AS cx, y + dy AS cy, NULL::BIGINT AS tu FROM ev, o WHERE x BETWEEN 5 AND 26 AND y BETWEEN 5 AND 26 UNION ALL SELECT seq, NULL, NULL, x, y, t FROM ev),
l AS (SELECT seq, dx, dy, last_value(tu IGNORE NULLS) OVER (PARTITION BY cx, cy ORDER BY seq, dx IS NOT NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 0.001::DOUBLE AS v FROM q),
z AS (SELECT * FROM l WHERE dx IS NOT NULL AND v IS NOT NULL),
g AS (SELECT c.seq, (e.v - w.v) / 2 AS gx, (s.v - n.v) / 2 AS gy FROM z c JOIN z e ON e.seq = c.seq AND e.dx = c.dx + 1 AND e.dy = c.dy JOIN z w ON w.seq = c.seq AND w.dx = c.dx - 1 AND w.dy = c.dy
  JOIN z s ON s.seq = c.seq AND s.dx = c.dx AND s.dy = c.dy + 1 JOIN z n ON n.seq = c.seq AND n.dx = c.dx AND n.dy = c.dy - 1 WHERE abs(c.dx) <= 4 AND abs(c.dy) <= 4),
m AS (SELECT seq, sum(gx * gx) AS a, sum(gx * gy) AS b, sum(gy * gy) AS c FROM g GROUP BY seq HAVING count(*) >= 3)
SELECT x, y, t, p, seq FROM ev JOIN m USING (seq) WHERE a + c > 0 AND (a * c - b * b) / ((a + c) * (a + c)) - 0.04 > 0"""

_FLOW = """sf AS (SELECT {k}y, x, max(t) * 0.001::DOUBLE AS v FROM {src} GROUP BY {k}y, x),
g AS (SELECT {ck}c.y, c.x, (e.v - w.v) / 2 AS gx, (s.v - n.v) / 2 AS gy FROM sf c JOIN sf e ON {je}e.x = c.x + 1 AND e.y = c.y JOIN sf w ON {jw}w.x = c.x - 1 AND w.y = c.y JOIN sf s ON {js}s.x = c.x AND s.y = c.y + 1 JOIN sf n ON {jn}n.x = c.x AND n.y = c.y - 1),
z AS (SELECT {pk}p.y, p.x, sum(gx * gx) AS a, sum(gx * gy) AS b, sum(gy * gy) AS c, sum(gx) AS u, sum(gy) AS w, count(*) AS n FROM sf p JOIN g ON {jg}abs(g.x - p.x) <= 3 AND abs(g.y - p.y) <= 3 GROUP BY {pk}p.y, p.x),
f AS (SELECT {k}y, x, CASE WHEN a * c - b * b > 1e-3 * (a + c) * (a + c) THEN (c * u - b * w) / (a * c - b * b) WHEN (u * u + w * w) / (n * (a + c)) >= 0.35 THEN (u / n) / nullif((u / n) * (u / n) + (w / n) * (w / n), 0) END AS fx,
  CASE WHEN a * c - b * b > 1e-3 * (a + c) * (a + c) THEN (a * w - b * u) / (a * c - b * b) WHEN (u * u + w * w) / (n * (a + c)) >= 0.35 THEN (w / n) / nullif((u / n) * (u / n) + (w / n) * (w / n), 0) END AS fy FROM z WHERE a + c > 1e-12),
v AS (SELECT {k}0 AS c, y, x, fx::FLOAT AS q FROM f WHERE fx IS NOT NULL AND fy IS NOT NULL UNION ALL SELECT {k}1, y, x, fy::FLOAT FROM f WHERE fx IS NOT NULL AND fy IS NOT NULL)
SELECT {k}c, y, x, round(q::DOUBLE * 1000, 3) + 0 AS value FROM v WHERE q <> 0"""
_FLOW_ONE = _FLOW.format(k="", src="ev", ck="", pk="", je="", jw="", js="", jn="", jg="")
_FLOW_SLICES = _FLOW.format(k="slice_id, ", src="s", ck="c.slice_id, ", pk="p.slice_id, ", je="e.slice_id = c.slice_id AND ", jw="w.slice_id = c.slice_id AND ", js="s.slice_id = c.slice_id AND ", jn="n.slice_id = c.slice_id AND ", jg="g.slice_id = p.slice_id AND ")


def per_second(f: represent.Frame) -> DataFrame:
    """Flow in pixels a second, as it is slow here."""
    return f.df.where("value <> 0").select(*f.keys, "c", "y", "x", (F.round(F.col("value").cast("double") * 1000, 3) + F.lit(0.0)).alias("value"))


@query(f"WITH {EV}, {_FLOW_ONE}")
def optical_flow(s):
    return per_second(motion.optical_flow(s))


@query(f"WITH {EV}{BOUND}, {_SLICE}, {_FLOW_SLICES}")
def flow_frames(s):
    return per_second(_tumbling(s).with_repr("flow").frames())


@query(f"WITH {EV}{BOUND} SELECT x, y, t0 + t1 - t AS t, NOT p AS p, row_number() OVER (ORDER BY t0 + t1 - t, seq DESC) - 1 AS seq FROM ev, b")
def time_reversal(s):
    return augment.time_reversal(s, 1.0, 1).df.select("x", "y", "t", "p", "seq")


# order-dependent operators without SQL
@query()
def contrast_maximise(s):
    return motion.contrast_maximise(EventReader(s, Slicing(dt=500_000)).stream)


@query()
def feast_transform(s):
    return feast.FEAST(n_features=8, patch=3).fit(s).transform(s)


@query()
def tracker(s):
    return track.track(_tumbling(s).with_repr("count").frames(), min_area=1)


for _name, _op in {
    "random_flip_x": lambda s: augment.random_flip_x(s, 0.5, 1), "random_flip_y": lambda s: augment.random_flip_y(s, 0.5, 1), "random_polarity_flip": lambda s: augment.random_polarity_flip(s, 0.5, 1),
    "random_crop": lambda s: augment.random_crop(s, 8, 6, 1), "event_drop": lambda s: augment.event_drop(s, 0.2, 1), "pixel_dropout": lambda s: augment.pixel_dropout(s, 0.2, 1),
    "spatial_jitter": lambda s: augment.spatial_jitter(s, 1.0, 1), "time_jitter": lambda s: augment.time_jitter(s, 1.0, 1),
}.items():
    query(None, _name)(lambda s, _op=_op: _op(s).df)


def ideal_frames(spark: SparkSession, n: int = 12, width: int = 24, height: int = 16) -> DataFrame:
    """A bright edge that moves by a pixel a frame."""
    grid = spark.range(n * width * height).select((F.col("id") % width).cast("int").alias("x"), (F.expr(f"id div {width}") % height).cast("int").alias("y"), F.expr(f"id div {width * height}").alias("frame"))
    return grid.withColumn("t", F.col("frame") * 1000).withColumn("luma", F.when(F.col("x") <= F.col("frame") + 3, 200.0).otherwise(30.0))


_STEPS = math.floor(math.log(200.0 / 30.0) / 0.2)


@query(f"""WITH f AS (SELECT a.frame, b.x, c.y FROM range(1, 12) a(frame), range(24) b(x), range(16) c(y) WHERE b.x = a.frame + 3), k AS (SELECT unnest(range(1, {_STEPS + 1})) AS k)
SELECT x::INTEGER AS x, y::INTEGER AS y, ((frame - 1) * 1000 + floor(1000 * least(1, k * 0.2::DOUBLE / (ln(200.0::DOUBLE) - ln(30.0::DOUBLE)))))::BIGINT AS t, true AS p FROM f, k""")
def simulate_ideal(s):
    out = simulate.simulate(ideal_frames(s.df.sparkSession), 24, 16, simulate.SimulatorConfig.ideal())
    return out.df.select("x", "y", "t", "p")


@query()
def simulate_noisy(s):
    return simulate.simulate(ideal_frames(s.df.sparkSession), 24, 16, simulate.SimulatorConfig()).df


def embedding_frames(spark: SparkSession, sf_dir: str) -> represent.Frame:
    """The embeddings as 8 x 8 frames."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = raw.select(F.col("vec_id").alias("slice_id"), F.posexplode("embedding").alias("i", "value")).select("slice_id", F.lit(0).alias("c"), F.expr("i div 8").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("value").cast("float").alias("value"))
    return represent.Frame(df, "intensity", ("intensity",), 8, 8, "f32", ("slice_id",))


QUERIES["frames_resize_many"] = lambda spark, d: cells(frames.resize(embedding_frames(spark, d), 4, 4), 4)
ORACLE_SQL["frames_resize_many"] = """WITH e AS (SELECT vec_id AS slice_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)
SELECT slice_id, 0 AS c, (i // 8 // 2)::INTEGER AS y, (i % 8 // 2)::INTEGER AS x, round(sum(v::DOUBLE * 0.5::DOUBLE * 0.5::DOUBLE)::FLOAT::DOUBLE, 4) + 0 AS value FROM e GROUP BY ALL"""
