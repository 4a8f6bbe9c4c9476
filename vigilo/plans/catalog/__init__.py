"""All registered queries; importing this package fills the registry."""

from vigilo.plans.catalog import core, drift, evaluation, features, lookups, ml, monitoring, quality, serving, streams, versions  # noqa: F401
from vigilo.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
