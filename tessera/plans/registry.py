"""All queries of the audit and their SQL."""

from tessera.plans import answers, catalogue, evaluation, model, pages  # noqa: F401  (a module registers its queries when it is imported)

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES
