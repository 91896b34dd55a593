"""Every operator as a free function: ``functional.crop(stream, 0, 0, 8, 8)`` is ``stream.crop(0, 0, 8, 8)``."""

from __future__ import annotations

from .operators import frames, masks, motion, represent, transforms
from .operators.model import Model, StatefulModel, normalized_bins  # noqa: F401
from .operators.simulate import SimulatorConfig, interpolate, simulate  # noqa: F401
from .operators.track import Tracker, track  # noqa: F401
from .operators.feast import FEAST  # noqa: F401
from .plans.dataset import OPERATORS, open_stream  # noqa: F401
from .sources.files import EventSink, export_png, from_numpy, load, load_frame, load_mask, save, save_frame, save_mask  # noqa: F401

globals().update(OPERATORS)
for _f in (
    transforms.concat, transforms.max_events, transforms.skip_before, masks.rect_mask, masks.circle_mask, masks.ellipse_mask, masks.polygon_mask, masks.drop_masked_pixels,
    motion.optical_flow, motion.iwe, motion.contrast_maximise, represent.binary, represent.polarity, represent.flatten, represent.count, represent.voxel, represent.tsurf,
    represent.atsurf, represent.tencode, represent.countmask, represent.redblue, represent.mcts, represent.pset, represent.raw_image, represent.event_rate,
    represent.pixel_counts, frames.collate, frames.connected_components, frames.blobs, frames.dense, frames.filled,
):
    globals()[_f.__name__] = _f
resize_frame = frames.resize

_device = "cpu"


def set_device(name: str) -> None:
    """Kept for callers: Spark's JVM code runs everything, whatever the name."""
    global _device
    _device = name


def get_device() -> str:
    return _device


def gpu_available() -> bool:
    return False
