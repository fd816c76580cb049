"""Column expressions shared by the operators (all built-in, JVM-side)."""

from .expr import (binarize, bucket_hash, corr_pairwise, rnd, safe_ratio, pick)

__all__ = ["binarize", "bucket_hash", "corr_pairwise", "rnd", "safe_ratio", "pick"]
