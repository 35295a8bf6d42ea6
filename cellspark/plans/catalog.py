"""All queries of the library's own operators, and the SQL that tells the same rows."""

from cellspark.plans import candidates, curation, forests, geometry, indexing, matching, models, patterns, peaks, sources, standard, stats, symbols  # noqa: F401
from cellspark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
