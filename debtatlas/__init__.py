"""Debt-roll analytics on Spark: typed staging, key audit, portfolio metrics,
segment reports, company groups and concentration curves."""
