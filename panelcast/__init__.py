"""panelcast: panel forecasting analytics on Spark (DataFrame / SQL / MLlib)."""

__version__ = "0.1.0"
