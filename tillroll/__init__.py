"""tillroll: retail sales analytics as Spark DataFrame operators.

Entry points: ``tillroll.sources.sales.load_sales`` (the stored sales table),
``tillroll.operators`` (filters, KPI card, breakdowns, forecast, cleaning,
insights, paging), ``tillroll.plans`` (endpoint bundles, exports, ingest) and
``tillroll.streaming.uploads`` (ingest each new upload once).
"""

__version__ = "0.1.0"
