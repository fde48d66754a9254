"""Every query of the library over the driver tables."""

from corefold.catalog import arguments_and_sampling, counts_and_scores, estimators, files, pairs_and_media, tokens_and_spans  # noqa: F401
from corefold.catalog.registry import ORACLES, QUERIES  # noqa: F401
