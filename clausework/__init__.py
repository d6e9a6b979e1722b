"""clausework: contract-document analytics expressed as Spark DataFrame jobs.

Modules:
  functions/  column expressions (text rules, score coercion, response checks)
  sources/    table loaders, the derived contract corpus, file intake
  operators/  analysis, parent/child store, search, reports, assembly
  plans/      the named query catalogue and its DuckDB oracle SQL
  streaming/  incremental intake of a landing folder
"""

__version__ = "0.1.0"
