"""prefspark: preference-pair analytics on Spark.

Layout
------
``functions``  Column expressions (vectors, chat messages, token arrays).
``operators``  DataFrame -> DataFrame steps: ``pairs``, ``encode``, ``losses``,
               ``heads``, ``scoring``, ``evaluate``, ``adapt``.
``sources``    ``readers`` and ``writers`` (incl. resume helpers).
``streaming``  incremental scoring of newly arriving pair files.
``plans``      ``stages`` (extract / decompose / evaluate / adapt_and_report),
               fixture views and the registry of named queries with their
               DuckDB oracle statements.
``session``    local sessions for tests and the bench, the shared checkpoint
               folder, shipping the package to Python workers.
"""
