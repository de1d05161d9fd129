"""quarry — catalogue ingestion, querying and upkeep as Spark DataFrame jobs."""

from .catalog import Catalog
from .model import CATALOGUE_MODELS, FIXTURE_MODELS, ModelSpec, Relation
from .session import checkpoint_dir, get_spark

__all__ = ["Catalog", "ModelSpec", "Relation", "CATALOGUE_MODELS", "FIXTURE_MODELS", "get_spark", "checkpoint_dir"]
