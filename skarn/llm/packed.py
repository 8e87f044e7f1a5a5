"""See ``skarn.core.packed``."""

from skarn.core.packed import CODEC, pack, part_of, runs, summed, unpack  # noqa: F401
