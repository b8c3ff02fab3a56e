"""ledgerlake: banking and conversation analytics as Spark DataFrame jobs.

Every operator takes DataFrames (and an explicit ``as_of`` time) and returns a
DataFrame, for all users at once::

    from datetime import datetime
    from ledgerlake.operators import banking, fraud
    from ledgerlake.sources import fixtures

    tx, acc = fixtures.transactions(spark, data_dir), fixtures.accounts(spark, data_dir)
    spend = banking.spending_by_category(tx, acc, datetime(2001, 8, 1), "last_6_months")
    risk = fraud.fraud_report(banking.user_scope(tx, acc), datetime(2001, 8, 1))

Modules: ``sources`` (scans, fixtures, sinks, generator), ``functions`` (column
functions), ``operators`` (banking, goals, fraud, telemetry, evaluation, safety,
documents, vectors, star, widgets, projections, ordering), ``streaming``
(Structured Streaming jobs) and ``plans`` (the registered queries and their
DuckDB twins).  ``python -m ledgerlake list`` shows the registered queries.
"""

__version__ = "0.1.0"
