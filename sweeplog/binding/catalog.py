"""Import every binding module so that its queries are registered."""

from sweeplog.binding import files, live, reporting, running, scoring, slicing, sweeping, traffic  # noqa: F401
from sweeplog.binding.registry import REGISTRY  # noqa: F401
