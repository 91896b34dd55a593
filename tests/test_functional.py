"""Every stream operator is a method, a deferred method of readers, and a free function; models run."""

from retinaspark import functional
from retinaspark.plans.dataset import OPERATORS, EventReader
from retinaspark.stream import EventStream


def test_surface():
    for name in OPERATORS:
        assert callable(getattr(functional, name)) and hasattr(EventStream, name) and hasattr(EventReader, name)
    functional.set_device("gpu")
    assert functional.get_device() == "gpu" and functional.gpu_available() is False
