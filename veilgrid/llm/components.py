"""Connected components: the library's own plan."""

from veilgrid.plans.components import components

__all__ = ["components"]
