"""Registered queries over the driver's tables, and the SQL that each must equal."""
from lodestone.plans import (  # noqa: F401
    aggregating,
    contrasting,
    crossval,
    distances,
    domain,
    evidence,
    files,
    joining,
    lexicon,
    places,
    predicates,
    ranking,
    records,
    resampling,
    reshaping,
    scalar,
    scoring,
    selecting,
    series,
    smallarea,
    streams,
)
from lodestone.plans.common import ORACLE_SQL, QUERIES  # noqa: F401
