"""DataFrame -> DataFrame operators: filters, KPIs, breakdowns, forecast, cleaning, insights, paging."""
