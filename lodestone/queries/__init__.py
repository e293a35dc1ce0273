"""Every registered query; importing the package fills the registry."""

from lodestone.queries import text, entities, chunks, vectors, retrieval, context, models, index, dialogue  # noqa: F401
from lodestone.queries import streams  # noqa: F401  (reuses the SQL of the batch queries)
