"""Panel forecasting, blending and allocation as Spark DataFrame operators.

Panels are long frames ``(asset, date, ...)``; every operator maps DataFrames to DataFrames
and leaves the physical plan to Catalyst.
"""
