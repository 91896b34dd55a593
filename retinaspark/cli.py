"""Command line: info, convert, render, simulate.

    python -m retinaspark.cli info recording.raw
    python -m retinaspark.cli convert recording.raw recording.parquet
    python -m retinaspark.cli render recording.raw frames/ --dt-ms 30 --repr polarity
    python -m retinaspark.cli simulate frames.parquet events.parquet --size 346x260
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def _size(text: str) -> tuple[int, int]:
    w, _, h = text.partition("x")
    return int(w), int(h)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="retinaspark")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--size", type=_size, help="sensor size, as 346x260")
    common.add_argument("--time-unit", default="us")
    info = sub.add_parser("info", parents=[common])
    info.add_argument("path")
    convert = sub.add_parser("convert", parents=[common])
    convert.add_argument("path")
    convert.add_argument("out")
    render = sub.add_parser("render", parents=[common])
    render.add_argument("path")
    render.add_argument("out")
    render.add_argument("--dt-ms", type=float, default=30.0)
    render.add_argument("--repr", default="polarity")
    render.add_argument("--colormap")
    simulate = sub.add_parser("simulate", parents=[common])
    simulate.add_argument("path", help="Parquet of frame, t, y, x, luma")
    simulate.add_argument("out")
    simulate.add_argument("--pos-thres", type=float, default=0.2)
    simulate.add_argument("--neg-thres", type=float, default=0.2)
    simulate.add_argument("--seed", type=int, default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    from .operators.simulate import SimulatorConfig, simulate
    from .plans.dataset import open_stream
    from .sources.files import export_png, load, save

    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "simulate":
        w, h = args.size
        made = simulate(spark.read.parquet(args.path), w, h, SimulatorConfig(pos_thres=args.pos_thres, neg_thres=args.neg_thres, seed=args.seed))
        save(made, args.out)
        return 0
    s = load(spark, args.path, sensor_size=args.size, time_unit=args.time_unit)
    if args.command == "info":
        r = s.stats().first()
        peak = s.event_rate(1.0).agg({"rate": "max"}).first()[0]
        print(f"sensor {s.meta.width} x {s.meta.height}\nevents {r['n_events']}\nduration {r['duration_ms'] or 0:.3f} ms\nmean rate {r['mean_rate'] or 0:.1f} /s\npeak rate {peak or 0:.1f} /s")
    elif args.command == "convert":
        save(s, args.out)
    else:
        reader = open_stream(s, dt_ms=args.dt_ms).with_repr(args.repr)
        print(export_png(reader.frames(), args.out, args.colormap).count(), "frames")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
