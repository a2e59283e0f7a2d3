"""ledgerlens: ledger classification analytics as Spark DataFrame plans.

Every per-row step is a Spark Column expression; every aggregate is a
DataFrame aggregation that Catalyst plans.  Sub-packages:

* ``sources``    -- CSV / JDBC / table / Parquet scans, payload parsing, sinks
* ``functions``  -- Column builders (text cleaning, numeric helpers, ranking)
* ``operators``  -- normalisation, profile compiler, features, split, TF-IDF,
                    evaluation, explanation, registry
* ``plans``      -- learning, tuning and the registered query catalog
* ``streaming``  -- Structured Streaming scoring and monitoring
"""

__version__ = "0.1.0"
