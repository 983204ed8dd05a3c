"""Imports every query module so the registry is complete."""

from tessera.plans import corpus_queries  # noqa: F401
from tessera.plans import shape_queries  # noqa: F401
from tessera.plans import metric_queries  # noqa: F401
from tessera.plans import overlap_queries  # noqa: F401
from tessera.plans import bpe_queries  # noqa: F401
from tessera.plans import augment_queries  # noqa: F401
from tessera.plans import source_queries  # noqa: F401
from tessera.plans import more_queries  # noqa: F401
