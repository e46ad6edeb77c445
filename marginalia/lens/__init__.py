"""Feature rewrites as data: specs, their compilation to expressions, inversion, composition and path search."""

from .algebra import LensGraph, compose, identity, inverse
from .compile import apply_lens, apply_lens_to_docs, trace_lens
from .spec import Lens, LensError, Rule

__all__ = ["Lens", "LensError", "LensGraph", "Rule", "apply_lens", "apply_lens_to_docs", "compose", "identity", "inverse", "trace_lens"]
